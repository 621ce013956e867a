"""Streams over landed files give the batch result, also when files land later."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sentigrade.operators.aggregates import game_sentiment
from sentigrade.operators.relational import clean_reviews
from sentigrade.streaming import reviews as streams
from sentigrade.workload import QUERIES, run_query

HEADER = "app_id,app_name,review_text,positive\n"


def test_ingest_continues_with_new_files(spark, tmp_path):
    landed, out, checkpoint = (tmp_path / n for n in ("landed", "out", "checkpoint"))
    landed.mkdir()
    (landed / "A_early_access_reviews.csv").write_text(HEADER + "1,A,a long enough review,1\n1,A,short,1\n")
    for expected in (1, 2):
        streams.ingest(streams.review_file_stream(spark, str(landed)), str(out), str(checkpoint)).awaitTermination()
        rows = spark.read.parquet(str(out)).collect()
        assert len(rows) == expected
        (landed / "B_post_release_reviews.csv").write_text(HEADER + "2,B,another long review text,0\n")
    assert {r.game_name for r in rows} == {"A", "B"}


def scored_stream(spark, path):
    schema = (
        "game_name string, review_type string, positive int, predicted int, probability double, review_text string, "
        "row_id bigint, app_id bigint"
    )
    return streams.file_stream(spark, path, spark.createDataFrame([], schema).schema, "parquet")


@pytest.mark.parametrize("compact_every", [1, 2, 50])
def test_running_aggregates_equal_batch(spark, tmp_path, compact_every):
    landed, state, checkpoint = (str(tmp_path / n) for n in ("landed", "state", "checkpoint"))
    df = spark.range(60).select(
        F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("game_name"),
        F.when(F.col("id") % 5 < 3, "early_access").otherwise("post_release").alias("review_type"),
        (F.col("id") % 2).cast("int").alias("positive"),
        (F.col("id") % 4 == 0).cast("int").alias("predicted"),
        # A small spread on a large mean, where sums of squares would cancel.
        (F.col("id") / 6e9 + 1000).alias("probability"),
        F.repeat(F.lit("word "), (F.col("id") + 20).cast("int")).alias("review_text"),
        F.col("id").alias("row_id"),
        (F.col("id") % 3).alias("app_id"),
    )
    for part in (df.where("row_id < 20"), df.where("row_id BETWEEN 20 AND 40"), df.where("row_id > 40")):
        part.write.mode("append").parquet(landed)
        streams.maintain_sentiment(scored_stream(spark, landed), state, checkpoint, compact_every=compact_every).awaitTermination()
    want = {r.game_name: r.asDict() for r in game_sentiment(df).collect()}
    found = {r.game_name: r.asDict() for r in streams.current_sentiment(spark, state).collect()}
    assert want.keys() == found.keys() and len(want) == 3
    for name, row in want.items():
        assert row.keys() == found[name].keys()
        for c, value in row.items():
            assert found[name][c] == (pytest.approx(value, rel=1e-6) if isinstance(value, float) else value), c


def test_kept_copies_are_released(spark, tmp_path):
    """State older than the kept span is dropped, so a copy after it passes."""
    landed, out, checkpoint = (str(tmp_path / n) for n in ("landed", "out", "checkpoint"))
    for day in (1, 2, 20, 40, 45):
        rows = spark.createDataFrame([("g", "same text", day), ("g", f"other {day}", day)], "app_id string, text string, day int")
        rows.select("app_id", "text", F.timestamp_seconds(F.col("day") * 86400 + 1704067200).alias("ts")).write.mode("append").parquet(landed)
        source = streams.file_stream(spark, landed, spark.read.parquet(landed).schema, "parquet")
        single = streams.dedup_stream(source, "ts", ["app_id"], "text", "10 days")
        query = streams.append_stream(single.select("app_id", "text", "ts"), out, checkpoint)
        query.awaitTermination()
    assert spark.read.parquet(out).where("text = 'same text'").count() == 2
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


def test_clean_reviews_keeps_order_of_steps(spark):
    df = spark.createDataFrame([("http://x.y/zzzzzzzzzzzzzzzz",), (None,), ("exactly10!",), ("eleven char",)], "review_text string")
    assert [r.cleaned_text for r in clean_reviews(df).collect()] == ["eleven char"]


def test_copies_any_time_apart_are_dropped(spark, tmp_path):
    landed, out, checkpoint = (str(tmp_path / n) for n in ("landed", "out", "checkpoint"))
    schema = "app_id string, text string"
    for batch in ([("g", "same"), ("g", "same"), (None, "same"), ("g", None)], [("g", "same"), ("h", "same"), (None, "same")], [("g", None), ("g", "new")], [("g", "same")]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(landed)
        stream = streams.file_stream(spark, landed, spark.read.parquet(landed).schema, "parquet")
        streams.first_arrivals(stream, out, checkpoint, ["app_id"], "text", buckets=4).awaitTermination()
    found = streams.read_arrivals(spark, out, "app_id string, text_digest string")
    known = {hashlib.sha256(t.encode()).hexdigest(): t for t in ("same", "new")}
    got = sorted(((r.app_id, known.get(r.text_digest)) for r in found.collect()), key=repr)
    assert got == sorted([("g", "same"), (None, "same"), ("g", None), ("h", "same"), ("g", "new")], key=repr)


def test_a_repeated_batch_gives_the_same_arrivals(spark, tmp_path):
    landed, out = str(tmp_path / "landed"), str(tmp_path / "out")
    spark.createDataFrame([("g", "a"), ("g", "b")], "app_id string, text string").write.parquet(landed)
    for attempt in range(2):  # a lost checkpoint starts with the first batch again
        stream = streams.file_stream(spark, landed, spark.read.parquet(landed).schema, "parquet")
        streams.first_arrivals(stream, out, str(tmp_path / f"checkpoint{attempt}"), ["app_id"], "text").awaitTermination()
    assert streams.read_arrivals(spark, out, "app_id string, text_digest string").count() == 2


@pytest.mark.parametrize("files", [1, 3])
def test_stream_queries_read_a_table_of_any_number_of_files(spark, tmp_path, files):
    rows = [(k, f"review number {k} of a good game", "en", f"src{k % 2}", 30) for k in range(40)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    table = tmp_path / "documents.parquet"
    documents.repartition(files).write.parquet(str(table if files > 1 else tmp_path / "written"))
    if files == 1:
        table.write_bytes(next((tmp_path / "written").glob("part-*")).read_bytes())
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    found = {name: run_query(QUERIES[name], spark, str(tmp_path)).count() for name in ("stream_ingest", "stream_dedup", "stream_sentiment")}
    assert found == {"stream_ingest": 40, "stream_dedup": 40, "stream_sentiment": 2}
