"""Review-shaped views over the driver's tables.

One SQL text per view serves Spark and the checking database; only the expression for epoch
seconds differs.  Every view covers its whole tables; ``positive`` is NULL where a document has no label.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

EPOCH = {
    "spark": "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)",
    "check": "CAST(floor(epoch(ts)) AS BIGINT)",
}

MODELS = ("click", "error", "purchase", "signup", "view")

VIEWS = {
    "reviews": """
        SELECT d.source AS game_name, d.source AS app_name,
               CAST(substring(d.source, 4) AS BIGINT) AS app_id, d.doc_id AS row_id,
               d.text AS review_text, CAST(l.quality AS INT) AS positive,
               CASE WHEN floor(d.doc_id / 20) % 2 = 0 THEN 'early_access' ELSE 'post_release' END
                 AS review_type,
               d.source || CASE WHEN floor(d.doc_id / 20) % 2 = 0 THEN '_early_access'
                                ELSE '_post_release' END || '_reviews.csv' AS source_file
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "labelled_reviews": "SELECT * FROM reviews WHERE positive IS NOT NULL",
    "reviews_dup": """
        SELECT lang AS app_id, text AS review_text, doc_id AS row_id, source AS source_file
        FROM documents""",
    "comments": """
        SELECT conv_id % 20 AS app_id, 'src' || CAST(conv_id % 20 AS STRING) AS app_name, text,
               role, conv_id, turn
        FROM conversations""",
    "training_results": """
        SELECT event_type AS model,
               CASE WHEN event_type IN ('click', 'view') THEN 'Transformer' ELSE 'Classical' END AS type,
               CAST(floor(user_id / 5) AS BIGINT) AS seed, CAST(user_id % 5 AS INT) AS fold,
               total / (n * 50000.0e0) AS f1_score, top / 50000.0e0 AS accuracy,
               low / 50000.0e0 AS precision, (top + low) / 100000.0e0 AS recall,
               n * 0.5e0 AS train_time, total / (n * 1000.0e0) AS inference_time_ms,
               first_event AS timestamp, n AS n_events,
               CASE WHEN top >= 10000 THEN tp END AS tp, CASE WHEN top >= 10000 THEN tn END AS tn,
               CASE WHEN top >= 10000 THEN fp END AS fp, CASE WHEN top >= 10000 THEN fn END AS fn
        FROM (SELECT event_type, user_id, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total,
                     max(cents) AS top, min(cents) AS low,
                     lpad(CAST(min(event_id) AS STRING), 15, '0') AS first_event,
                     count(CASE WHEN cents >= 5000 THEN 1 END) AS tp,
                     count(CASE WHEN cents < 1000 THEN 1 END) AS tn,
                     count(CASE WHEN cents >= 1000 AND cents < 2500 THEN 1 END) AS fp,
                     count(CASE WHEN cents >= 2500 AND cents < 5000 THEN 1 END) AS fn
              FROM (SELECT event_type, user_id, event_id, CAST(round(value * 100) AS BIGINT) AS cents
                    FROM events) e
              GROUP BY event_type, user_id) g""",
    # A run is missing where too few events of its type were seen: many of 'error', some of 'signup'.
    "training_results_gaps": """
        SELECT * FROM training_results
        WHERE n_events >= CASE model WHEN 'error' THEN 15 WHEN 'signup' THEN 12 ELSE 0 END""",
    "registry": """
        SELECT CAST(n_nationkey AS BIGINT) AS app_id, n_name AS name,
               CAST(1704067200 + n_nationkey * 36000 AS BIGINT) AS start_date,
               CASE WHEN n_nationkey % 5 = 0 THEN 9999999999
                    ELSE CAST(1704067200 + n_nationkey * 36000 + 864000 AS BIGINT) END AS end_date,
               CASE WHEN n_regionkey < 3 THEN 'training' ELSE 'validation' END AS split
        FROM nation""",
    "raw_reviews_ts": """
        SELECT user_id % 25 AS app_id, {epoch} AS ts, event_type = 'signup' AS early_flag,
               event_id AS row_id, value
        FROM events""",
    "game_metadata": """
        SELECT p_partkey AS app_id, p_name AS app_name, p_brand AS developer,
               CASE WHEN p_size % 3 = 0 THEN p_brand || ', Brand#1' ELSE p_brand END AS publisher,
               CASE WHEN p_size % 10 = 0 THEN ''
                    ELSE CAST(2008 + p_partkey % 17 AS STRING) || '-'
                      || lpad(CAST(1 + p_partkey % 12 AS STRING), 2, '0') || '-'
                      || lpad(CAST(1 + p_partkey % 28 AS STRING), 2, '0') END AS release_date,
               CAST((p_partkey % 50) * power(10, p_partkey % 4) AS DOUBLE) AS current_price_usd,
               CASE p_type WHEN 'ECONOMY' THEN 'Casual' WHEN 'STANDARD' THEN 'Indie'
                    WHEN 'PROMO' THEN 'Early Access' WHEN 'SMALL' THEN 'Adventure'
                    WHEN 'MEDIUM' THEN 'RPG' ELSE 'Action' END
                 || CASE WHEN p_size % 2 = 0 THEN '|Strategy' ELSE ' | ' END
                 || '|' || replace(p_name, ' ', '|') AS genres,
               CASE p_size % 4 WHEN 0 THEN 'Single-player|Full Controller Support'
                    WHEN 1 THEN 'Multi-player|Steam Cloud'
                    WHEN 2 THEN 'Online Co-op|Partial Controller Support|Steam Cloud'
                    ELSE '' END AS categories,
               CASE p_partkey % 3 WHEN 0 THEN 'windows' WHEN 1 THEN 'windows|mac'
                    ELSE 'windows|linux|mac' END AS platforms,
               p_size AS required_age, p_type || ' ' || p_name AS short_description
        FROM part""",
    # Outcome columns as collected; revenue, tier and completeness are derived by the library.
    "outcomes": """
        SELECT l.app_id, p.p_name AS app_name, steamspy_owners_min, steamspy_owners_max, steamspy_players_forever,
               steamspy_avg_playtime, steamspy_positive, steamspy_negative,
               CASE WHEN n_lines >= 28 THEN score END AS steam_metacritic_score,
               CASE WHEN p.p_size < 48 THEN n_lines ELSE 0 END AS steam_total_reviews,
               CAST(CAST(last_ship AS DATE) AS STRING) AS steam_release_date,
               CASE WHEN p.p_size <> 7 THEN CAST((l.app_id % 50) * power(10, l.app_id % 4) AS DOUBLE) END
                 AS steam_current_price_usd,
               p.p_type AS steamspy_genre,
               CASE WHEN p.p_size % 2 = 0 THEN 'Multiplayer|Open World' ELSE 'Singleplayer' END
                 || CASE WHEN p.p_size % 3 = 0 THEN '|Co-op|Pixel Graphics' ELSE '|2D' END AS steamspy_tags,
               CASE p.p_size % 3 WHEN 0 THEN 'English, French, German' WHEN 1 THEN 'English' ELSE '' END
                 AS steamspy_languages
        FROM (SELECT l_partkey AS app_id, count(*) AS n_lines, max(l_shipdate) AS last_ship,
                     CAST(1000 * min(l_quantity) AS BIGINT) AS steamspy_owners_min,
                     CAST(1000 * max(l_quantity) AS BIGINT) AS steamspy_owners_max,
                     CAST(sum(l_linenumber) AS BIGINT) AS steamspy_players_forever,
                     CAST(sum(l_quantity) AS BIGINT) AS steamspy_avg_playtime,
                     count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS steamspy_positive,
                     count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS steamspy_negative,
                     40 + CAST(max(l_linenumber) + min(l_quantity) AS BIGINT) AS score
              FROM lineitem GROUP BY l_partkey) l
        JOIN part p ON l.app_id = p.p_partkey""",
    # Ranked columns are rounded, so that ties do not depend on the order of additions.
    "game_features": """
        SELECT l_partkey AS app_id, 'part' || CAST(l_partkey AS STRING) AS game_name,
               count(*) AS ea_review_count,
               round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0e0 ELSE 0.0e0 END), 8) AS ea_predicted_positive_ratio,
               round(avg(l_tax) * 10, 8) AS ea_avg_positive_probability,
               round(avg(CASE WHEN l_linestatus = 'O' THEN 1.0e0 ELSE 0.0e0 END), 8) AS ea_actual_positive_ratio,
               round(stddev_pop(l_discount), 8) AS ea_sentiment_std,
               round(avg(l_quantity), 8) AS ea_mean_review_length,
               round(avg(CASE WHEN l_quantity > 25 THEN 1.0e0 ELSE 0.0e0 END), 8) AS ea_long_review_ratio,
               round(coalesce(avg(CASE WHEN l_returnflag <> 'R' THEN l_quantity END), 0.0e0)
                     / avg(l_quantity), 8) AS ea_neg_pos_length_ratio,
               count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS pr_review_count,
               round(avg(CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_returnflag = 'R' THEN 1.0e0 ELSE 0.0e0 END END), 8)
                 AS pr_actual_positive_ratio
        FROM lineitem GROUP BY l_partkey""",
    "video_sentiment": """
        SELECT o_custkey AS app_id, 'part' || CAST(o_custkey AS STRING) AS app_name,
               count(*) AS yt_comment_count,
               round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0e0 ELSE 0.0e0 END), 8) AS yt_predicted_positive_ratio,
               CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100000000.0e0)
                 AS yt_avg_positive_probability,
               round(stddev_pop(o_totalprice) / 1000000, 10) AS yt_sentiment_std,
               round(avg(length(o_orderpriority)), 8) AS yt_mean_comment_length,
               round(avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0e0 ELSE 0.0e0 END), 8) AS yt_long_comment_ratio
        FROM orders GROUP BY o_custkey""",
}


def named_in(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", sql)]


class Tables:
    """Raw tables and views of one data folder as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in VIEWS:
                text = VIEWS[name].replace("{epoch}", EPOCH["spark"])
                used = named_in(text, [*TABLES, *VIEWS])
                for source in used:
                    text = re.sub(rf"\b(FROM|JOIN) {source}\b", rf"\1 {{{source}}}", text)
                self._known[name] = self.spark.sql(text, **{s: getattr(self, s) for s in used})
            elif name in TABLES:
                self._known[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._known[name]


def check_sql(sql: str, helpers: dict[str, str]) -> str:
    """``sql`` with the views and helper queries it uses as common table expressions."""
    texts = {n: t.replace("{epoch}", EPOCH["check"]) for n, t in {**VIEWS, **helpers}.items()}
    needed: list[str] = []

    def require(text: str, own: str = "") -> None:
        for name in named_in(text, texts):
            if name != own and name not in needed:
                require(texts[name], name)
                needed.append(name)

    require(sql)
    if not needed:
        return sql
    parts = ", ".join(f"{name} AS ({texts[name]})" for name in needed)
    return f"WITH {parts} {sql}"
