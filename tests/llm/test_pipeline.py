"""The pipeline's stages on a small fixture against brute force, and the registered queries' columns."""

import os

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import corpus_pipeline
from sentigrade.llm import bpe, langid, mixing, queries
from sentigrade.session import materialize
from tools.check import compare, connect

from .test_jaccard import brute
from .test_pii import base

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

COLUMNS = {
    "op1": "page_id bigint url string text string n_chars bigint",
    "op2": "doc_id bigint n_chars bigint edited_sha256 string fingerprint string edited_fingerprint string near_edited double near_next double",
    "op3": "doc_id bigint n_email bigint n_ip bigint n_card bigint n_phone bigint base_sha256 string spans string",
    "op4": "doc_id bigint size bigint source_size bigint target double taken bigint",
    "op5": "doc_id bigint held_out boolean lang_pred string score double",
    "op6": "doc_id bigint n_shingles bigint component_id bigint",
    "op7": "doc_id bigint n_tokens bigint ids_sha256 string decoded_sha256 string",
    "op8": "page_id bigint payload_bytes bigint payload_digest string record_type string refers_to bigint",
    "op9": "vec_id bigint n_links bigint component_id bigint kept boolean",
    "op10": "page_id bigint host string path string rule string verdict string",
    "op11": "doc_id bigint leaf string subroot string root string proof_sha256 string folded_root string verified boolean",
    "op12": "doc_id bigint n_assign bigint n_access bigint n_hex bigint base_sha256 string spans string n_decoded bigint",
    "op13": "vec_id bigint component int n bigint deviation bigint whitened double explained double identity_error double",
}
TABLES = {"op1": "pages", "op8": "pages", "op9": "embeddings", "op10": "pages", "op13": "embeddings"}


def test_all_are_registered():
    names = entry_module.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert sorted(COLUMNS) == sorted(name.split("_")[0] for name in queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    op = name.split("_")[0]
    df = queries.QUERIES[name](spark, FOLDER)
    words = COLUMNS[op].split()
    assert dict(df.dtypes).items() >= dict(zip(words[::2], words[1::2])).items()
    assert df.count() == spark.read.parquet(f"{FOLDER}/{TABLES.get(op, 'documents')}.parquet").count() * (8 if op == "op13" else 1)
    if name in queries.SQL:
        assert compare(df, connect(FOLDER).sql(queries.SQL[name])) == ""


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(10**9, None, None, None, None), (10**9 + 1, "", "en", "src1", 0)], docs.schema)
    columns, state = docs.columns, docs.unionByName(odd).unionByName(docs.limit(3))
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        made[name, "in"] = state
        state = materialize(stage(spark, state, FOLDER), f"test-{name}")
        made[name] = state
        if name != "tokens":
            assert state.columns == columns and state.where(F.col("n_chars") != F.length("text")).count() == 0
    # 1: clean documents stay as they are, rows without a language go
    assert {r.doc_id for r in docs.join(made["languages"], "doc_id", "left_anti").collect()} == set()
    assert made["languages"].where("doc_id >= 1000000000").count() == 0
    assert made["languages"].join(docs, columns).count() == docs.count() + 3
    # 2: one of each group, the smallest id
    rows = [(r.doc_id, r.text) for r in made["near_duplicates", "in"].select("doc_id", "text").collect()]
    kept = sorted(r.doc_id for r in made["near_duplicates"].collect())
    assert kept == sorted({component for _, _, component in brute(rows, 5, 80)})
    # 3: all documents stay, base spans are gone, the rest is as it was
    before = {r.doc_id: r.text for r in made["private_data", "in"].collect()}
    after = {r.doc_id: r.text for r in made["private_data"].collect()}
    assert before.keys() == after.keys()
    for key, text in before.items():
        if not base(text)[1]:
            assert after[key] == text or any(f"[{k.upper()}]" in after[key] for k in ("email", "ip", "card", "phone"))
        else:
            assert not base(after[key])[1]
    # 4: sources near their targets
    sizes = {r.source: r.n for r in made["mix", "in"].groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    taken = {r.source: r.n for r in made["mix"].groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    for source, target in mixing.share_out(sizes).items():
        assert abs(taken.get(source, 0) - target) <= 2 * mixing.BLOCK_WORDS
    # 5: tokens of exactly the mix
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    want = [len(x) // 4 for x in next(bpe.encode_batches([[r.text for r in made["mix"].collect()]], ranks, public_tokenizers.PATTERN))]
    assert sorted(r.n_tokens for r in made["tokens"].collect()) == sorted(want)


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0
    assert langid.learn(docs.withColumnRenamed("doc_id", "x").selectExpr("x AS doc_id", "'' AS text", "'' AS lang")).languages == []
