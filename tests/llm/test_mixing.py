"""Mixing: targets, permutations, and what every document gives."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentigrade.llm import mixing


def test_targets():
    got = mixing.share_out({"b": 100, "a": 10, None: 50, "c": 40})
    assert got["a"] == 20 and got["c"] == pytest.approx(80) and sum(got.values()) == pytest.approx(300)
    assert all(t <= 2 * s + 1e-9 for t, s in zip((got["b"], got[None]), (100, 50)))
    # a weighs 3, b 1, c 2, null 3: beyond a's and c's limits the rest goes 1 : 3, null is full, b takes what is left
    assert got[None] == 100 and got["b"] == pytest.approx(100)
    assert mixing.share_out({}) == {} and mixing.share_out({"x": 0}) == {"x": 0.0}


@pytest.mark.parametrize("size", [1, 2, 3, 10, 255, 256, 257, 5000])
def test_permutations(size):
    image = mixing.permute(np.arange(size), size, [1, 2, 3])
    assert sorted(image) == list(range(size))
    if size > 100:
        assert (image != mixing.permute(np.arange(size), size, [1, 2, 4])).mean() > 0.9


def test_shards_draw_all_slots():
    totals = np.array([700, 0, 1300, 41])
    seen = np.zeros((4, 1300), dtype=int)
    counts = []
    for shard in range(-(-2041 // 64)):
        start, count = mixing.draw_shard(totals, shard, 64, 5)
        counts.append(count)
        for k in range(4):
            seen[k, start[k] : start[k] + count[k]] += 1
    assert all((seen[k, : totals[k]] == 1).all() and not seen[k, totals[k] :].any() for k in range(4))
    assert [c.sum() for c in counts[:-1]] == [64] * 31 and len({tuple(c) for c in counts}) > 20


@pytest.mark.parametrize("good, bad, draws", [(1_500_000_000, 2_500_000_000, 2_000_000_000), (3_999_999_000, 1000, 1_000_000_000), (40, 60, 30), (3, 2, 2), (10**12, 10**13, 10**12)])
def test_draws_have_mean_and_variance_at_every_size(good, bad, draws):
    rng, n = np.random.default_rng(1), 4000
    got = np.array([mixing.hypergeometric(rng, good, bad, draws) for _ in range(n)], dtype=float)
    share, total = good / (good + bad), good + bad
    mean, variance = draws * share, draws * share * (1 - share) * (total - draws) / (total - 1)
    assert abs(got.mean() - mean) < 4 * (variance / n) ** 0.5
    assert abs(got.var() / variance - 1) < 4 * (2 / n) ** 0.5 + 0.03
    assert got.min() >= max(0, draws - bad) and got.max() <= min(good, draws)


def test_small_draws_follow_their_law():
    rng, n = np.random.default_rng(2), 20_000
    got = np.bincount([mixing.hypergeometric(rng, 7, 9, 6) for _ in range(n)], minlength=7) / n
    want = np.array([math.comb(7, k) * math.comb(9, 6 - k) / math.comb(16, 6) for k in range(7)])
    assert np.abs(got - want).max() < 4 * (0.25 / n) ** 0.5


def test_large_counts_are_split_whole():
    counts = np.array([3_000_000_000, 1_000_000_000, 5])
    left = [mixing.split_counts(counts, 2_000_000_000, [k]) for k in range(200)]
    assert all(x.sum() == 2_000_000_000 and (x <= counts).all() for x in left) and len({x[0] for x in left}) > 150


def test_an_id_on_many_rows(spark):
    rows = [(1, "a b c", "s", k % 2) for k in range(3000)] + [(None, f"w{k} x", "s", 0) for k in range(600)] + [(1, f"w{k}", "s", 0) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, part int").repartition(4)
    plan = mixing.mix(df, block_words=16, shard_slots=128)
    placed = plan.rows.select("start", "size").orderBy("start").collect()
    ends = np.cumsum([0, *(r.size for r in placed)])
    assert [r.start for r in placed] == ends[:-1].tolist() and len(placed) == 4200
    got = plan.taken()
    assert got.count() == 4200 and got.where("taken > 2 * size").count() == 0
    assert abs(got.agg(F.sum("taken")).first()[0] - 1.5 * ends[-1]) <= 32


@pytest.fixture(scope="module")
def documents(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(600):
        source = [None, "a", "b", "é", "z"][int(rng.choice(5, p=[0.1, 0.4, 0.3, 0.1, 0.1]))]
        words = [f"w{k}.{j}" for j in range(int(rng.integers(0, 120)))]
        rows.append((k, "  " * (k % 2) + " \n".join(words) + "\t" * (k % 3), source, 1.5))
    rows += [(None, "only one", "a", 0.0), (7, None, "a", 0.0), (8, rows[8][1], rows[8][2], 0.0), (9999, "x " * 20_000, "b", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, taken double").repartition(5)


def test_taken_is_near_target_and_bounded(spark, documents):
    settings = dict(block_words=16, shard_slots=128)
    plan = mixing.mix(documents, **settings)
    got = plan.taken()
    assert got.count() == documents.count() == 604
    assert got.where((F.col("taken") > 2 * F.col("size")) | (F.col("taken") < 0)).count() == 0
    by = got.groupBy("source").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"), F.max("target").alias("t"), F.max("source_size").alias("s"))
    for r in by.collect():
        assert r.size == r.s and abs(r.taken - r.t) <= 48
    assert got.exceptAll(mixing.mix(documents.repartition(3), **settings).taken()).count() == 0


def test_texts_hold_the_words_taken(spark, documents):
    settings = dict(block_words=16, shard_slots=128)
    mixed = mixing.mixed_texts(documents.where("doc_id NOT IN (7, 8)"), **settings)
    assert mixed.columns == documents.columns
    words = mixed.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("words"))
    sizes = documents.where("doc_id NOT IN (7, 8)").select("doc_id", mixing.word_count(F.col("text")).alias("size"), F.col("text").alias("whole"))
    both = words.join(sizes, "doc_id")
    assert both.where("words > 2 * size").count() == 0
    whole = mixed.join(sizes, "doc_id").where(F.col("text") == F.col("whole")).count()
    assert whole > 100
    total = documents.where("doc_id NOT IN (7, 8)").agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert abs(mixed.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] - 1.5 * total) < 200


def test_empty_table(spark, documents):
    assert mixing.mix(documents.limit(0)).taken().count() == 0
    assert mixing.mixed_texts(documents.limit(0)).count() == 0
