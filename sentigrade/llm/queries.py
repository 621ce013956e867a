"""Queries over the corpus tables, one for each operator, with their check SQL where SQL has a form."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, bpe, jaccard, langid, merkle, mixing, parsing, pii, secrets, url_filter, vectors, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return blocks.extract(pages, blocks.fit(blocks.sample_words(pages)))


@query
def op2_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.compare_edited(table(spark, folder, "documents"))


@query
def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(pii.with_spans(table(spark, folder, "documents")))


@query
def op4_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    taken = mixing.mix(table(spark, folder, "documents")).taken()
    return taken.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


@query
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    found = langid.predict(documents.select("doc_id", "text"), langid.learn(documents))
    return found.select("doc_id", langid.held_out(found["doc_id"]).alias("held_out"), "lang_pred", "score")


@query
def op6_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, folder, "documents"))


@query
def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digest_round_trip(table(spark, folder, "documents"), RANKS, public_tokenizers.PATTERN)


@query
def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.round_trip(spark, table(spark, folder, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op9_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


@query
def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


@query
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(table(spark, folder, "documents"))


@query
def op12_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.report(secrets.with_secrets(table(spark, folder, "documents")))


@query
def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def _words(terms: tuple[str, ...]) -> str:
    return ", ".join(f"'{t}'" for t in terms)


SQL["op10_url_filter"] = rf"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(rest, '{url_filter._UPPER}', '{url_filter._LOWER}') AS low,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_filter._UPPER}', '{url_filter._LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, coalesce(rest, '') AS rest FROM parts)
), counted AS (
  SELECT *, len(list_filter([{_words(url_filter.STRICT)}], lambda t: list_contains(words, t))) AS strict_terms,
         len(list_filter([{_words(url_filter.SOFT)}], lambda t: list_contains(words, t))) AS soft_terms
  FROM (SELECT *, regexp_split_to_array(low, '[^a-z0-9]+') AS words FROM split)
), ruled AS (
  SELECT *, CASE {" ".join(
      f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.verdict} {r.text}'"
      for r in sorted(url_filter.RULES, key=lambda r: -len(r.text))
  )} END AS fit FROM counted
)
SELECT page_id, host, path, split_part(fit, ' ', 2) AS rule,
       coalesce(split_part(fit, ' ', 1), CASE WHEN strict_terms >= 1 OR soft_terms >= 2 THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
"""


def _merkle_sql(levels: int = 16, source_levels: int = 12) -> str:
    """Trees of up to 3 ** ``levels`` leaves, level by level; a tree of one node stays as it is."""

    def field(value: str) -> str:
        return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(text if c == "text" else c) for c in merkle.FIELDS) + ")"

    def climbed(name: str, count: int) -> list[str]:
        """{name}_nodes0 (tree, i, h, c) up to {name}_nodes{count}, and the runs of each level."""
        steps = []
        for k in range(count):
            steps.append(f"{name}_runs{k} AS MATERIALIZED (SELECT tree, i // 3 AS j, list(h ORDER BY i) AS run, any_value(c) AS c FROM {name}_nodes{k} GROUP BY tree, i // 3)")
            steps.append(
                f"{name}_nodes{k + 1} AS MATERIALIZED (SELECT tree, j AS i, CASE WHEN c = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h, "
                f"(c + 2) // 3 AS c FROM {name}_runs{k})"
            )
        return steps

    def folded(name: str, count: int) -> list[str]:
        """{name}_paths0 (with tree, p, v, proof) up to {name}_paths{count}: position, folded value and proof so far."""
        return [
            f"""{name}_paths{k + 1} AS MATERIALIZED (
              SELECT * EXCLUDE (c, before, after)
                REPLACE (p // 3 AS p, CASE WHEN c = 1 THEN v ELSE sha256(before || v || after) END AS v, CASE WHEN c = 1 THEN proof ELSE proof || before || after END AS proof)
              FROM (SELECT f.*, r.c, array_to_string(run[1:p % 3], '') AS before, array_to_string(run[p % 3 + 2:], '') AS after
                    FROM {name}_paths{k} f JOIN {name}_runs{k} r ON f.tree IS NOT DISTINCT FROM r.tree AND p // 3 = r.j))"""
            for k in range(count)
        ]

    bit = "list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))"
    crc = f"list_reduce(list_prepend(4294967295, {codes}), lambda s, d: {bit.replace('[x,', '[xor(s, d),')})"
    return ",\n".join(
        [
            f"""WITH rows AS (SELECT doc_id, source, {leaf("text")} AS leaf,
                   CASE WHEN {crc} & 1 = 1 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS changed FROM documents)""",
            """placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
                        count(*) OVER (PARTITION BY source) AS c FROM rows)""",
            "leaf_nodes0 AS (SELECT source AS tree, place AS i, leaf AS h, c FROM placed)",
            *climbed("leaf", levels),
            f"tops AS MATERIALIZED (SELECT tree AS source, h AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place, count(*) OVER () AS c FROM leaf_nodes{levels})",
            "top_nodes0 AS (SELECT 0 AS tree, place AS i, subroot AS h, c FROM tops)",
            *climbed("top", source_levels),
            "leaf_paths0 AS (SELECT doc_id, source AS tree, source, leaf, place AS p, changed AS v, '' AS proof FROM placed)",
            *folded("leaf", levels),
            f"""top_paths0 AS (SELECT doc_id, 0 AS tree, leaf, subroot, place AS p, v, proof
                  FROM leaf_paths{levels} l JOIN tops t ON l.source IS NOT DISTINCT FROM t.source)""",
            *folded("top", source_levels),
        ]
    ) + f"""
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, v AS folded_root, v = h AS verified
FROM top_paths{source_levels} CROSS JOIN (SELECT h FROM top_nodes{source_levels})"""


SQL["op11_merkle_manifest"] = _merkle_sql()
