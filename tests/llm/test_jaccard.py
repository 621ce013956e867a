"""Jaccard join against all pairs that share a shingle."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sentigrade.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MANY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shingles(text, words=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = WORD.findall(low)
    if not found:
        return frozenset()
    return frozenset(tuple(found[k : k + words]) for k in range(max(1, len(found) - words + 1)))


def brute(rows, words=4, percent=85):
    sets = [shingles(text, words) for _, text in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    places = defaultdict(list)
    for k, own in enumerate(sets):
        for j, both in Counter(j for s in own for j in places[s]).items():
            if 100 * both >= percent * (len(own) + len(sets[j]) - both):
                parent[root(k)] = root(j)
        for s in own:
            places[s].append(k)
    smallest = {}
    for k, (key, _) in enumerate(rows):
        if key is not None:
            smallest[root(k)] = min(smallest.get(root(k), key), key)
    return sorted(((key, len(sets[k]), smallest.get(root(k)) if sets[k] else key) for k, (key, _) in enumerate(rows)), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    made, number = [], iter(range(10**6))

    def word():
        return rng.choice("abcdefgh") + str(rng.randrange(60))

    def add(words):
        made.append((next(number), rng.choice([" ", "\n", "  \t"]).join(words)))

    passage = [word() for _ in range(40)]
    for _ in range(120):
        add([word() for _ in range(rng.randint(1, 60))] + (passage if rng.random() < 0.4 else []))
    for size in (20, 60, 150):  # groups of near copies around the threshold
        base = [word() for _ in range(size)]
        for _ in range(90):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + size // 18)):
                copy[rng.randrange(size)] = f"x{rng.randrange(10**9)}"
            add([w.upper() if rng.random() < 0.1 else w for w in copy])
    chain = [word() for _ in range(90)]
    for k in range(50):  # ends are far apart, neighbours linked
        chain[(k * 7) % 90] = f"y{k}"
        add(chain)
    for _ in range(60):  # exact copies
        add(base)
    add(["long"] + [word() for _ in range(8000)])
    made += [(None, None), (None, ""), (90_001, " \n\t\x0b"), (90_002, "One"), (90_003, "oNE  "), (90_004, "a b c"), (90_005, "A B\x0cC")]
    made += [(None, made[5][1]), made[6], (90_006, None), (90_007, "É"), (90_008, "é"), (90_009, "a b"), (90_010, "a b")]
    rng.shuffle(made)
    return made


@pytest.mark.parametrize("words, percent, batch", [(4, 85, 10_000), (5, 80, 13), (1, 50, 10_000)])
def test_same_components_as_all_pairs(spark, rows, words, percent, batch):
    before = spark.conf.get(MANY)
    spark.conf.set(MANY, batch)
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", jaccard.F.lit(1)).repartition(5)
        got = jaccard.near_duplicates(df, words=words, percent=percent)
        assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, words, percent)
    finally:
        spark.conf.set(MANY, before)


def test_one_of_each_group_stays(spark, rows):
    df = spark.createDataFrame([(k, t, "z") for k, t in rows], "doc_id long, text string, n string").repartition(3)
    kept = jaccard.keep_one(df)
    found = kept.collect()
    want = {component for key, _, component in brute(rows) if key is not None}
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in found if r.doc_id is not None) == sorted(want)
    assert sum(r.doc_id is None for r in found) == sum(key is None for key, _ in rows)
    assert jaccard.keep_one(df.limit(0)).count() == 0 and jaccard.near_duplicates(df.limit(0)).count() == 0


def test_rows_of_other_texts_stay_under_a_repeated_key(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (5, c), (5, c), (6, b.upper()), (7, ""), (7, ""), (None, a)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(3, a), (5, b), (5, c), (7, ""), (7, ""), (None, a)], key=repr)


OPEN = "token long, cls struct<h1:long,h2:long>, root struct<h1:long,h2:long>, n long, rest long, parts long"


def found(rows, hot=(), percent=85, bounded=False):
    tokens = rows.sparkSession.createDataFrame([(t,) for t in hot], "token long")
    got = jaccard.candidates(rows, tokens, percent, bounded).collect()
    pairs = {(min(r.u.h1, r.v.h1), max(r.u.h1, r.v.h1)) for r in got if r.token is None}
    return sorted(pairs), sorted(r.token for r in got if r.token is not None)


def test_rows_of_one_component_never_pair(spark):
    rows = [(1, (k, 0), (0, 0), 10, 9, 0) for k in range(300)] + [(1, (1000, 0), (1000, 0), 10, 9, 0)]
    open_rows = spark.createDataFrame(rows, OPEN).repartition(3)
    for bounded in (False, True):
        assert found(open_rows, bounded=bounded) == ([(k, 1000) for k in range(300)], [])


def test_a_bucket_of_many_pairs_gives_those_with_its_centres_first(spark):
    rows = [(t, (1000 * t + k, 0), (1000 * t + k, 0), 10, 9, 0) for t, size in ((1, 200), (2, 3)) for k in range(size)]
    open_rows = spark.createDataFrame(rows, OPEN).repartition(3)
    pairs, tokens = found(open_rows, bounded=True)
    assert tokens == [1] and len(pairs) <= 200 * jaccard.CENTRES + 3 and {k for pair in pairs for k in pair} == {r[1][0] for r in rows}
    assert len(found(open_rows)[0]) == 200 * 199 // 2 + 3


def passes(a, b, percent):
    (_, _, r, n, rest, parts), (_, _, s, m, other, more) = a, b
    least = -(-percent * (n + m) // (100 + percent))
    differ = sum(abs((parts >> 8 * k & 255) - (more >> 8 * k & 255)) for k in range(8))
    sizes = 100 * min(n, m) >= percent * max(n, m)
    return r != s and sizes and min(rest, other) + 1 >= least and (rest + other - differ) // 2 + 1 >= least


@pytest.mark.parametrize("block, batch", [(4096, 10_000), (7, 10_000), (16, 5)])
def test_rows_across_components_pair_where_the_filters_pass(spark, monkeypatch, block, batch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for token in range(4):
        for k in range(60):
            n = rng.randint(1, 30)
            rest = n - 1 - rng.randint(0, n - jaccard.least_overlap(n, 60))
            parts = sum(rng.choice((rest // 8, 1 + rest // 8)) << 8 * j for j in range(8))
            rows.append((token, (100 * token + k, 0), (rng.randrange(9), 0), n, rest, parts))
    before = spark.conf.get(MANY)
    spark.conf.set(MANY, batch)
    try:
        open_rows = spark.createDataFrame(rows, OPEN).repartition(3)
        want = sorted((a[1][0], b[1][0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[0] == b[0] and passes(a, b, 60))
        assert len(want) > 50 and found(open_rows, hot=(0, 2), percent=60) == (want, [])
        some, tokens = found(open_rows, hot=(1,), percent=60, bounded=True)
        assert some and set(some) <= set(want) and set(tokens) <= {0, 1, 2, 3}
    finally:
        spark.conf.set(MANY, before)


def test_a_hot_class_is_looked_up_in_pieces(spark):
    rows = spark.createDataFrame([(k, 1, (7, 7)) for k in range(900)] + [(k, 1, (k, 0)) for k in range(900, 1000)] + [(1, 0, (5, 5))], "key long, n long, cls struct<h1:long,h2:long>")
    classes = rows.where("n > 0").groupBy("cls").agg(jaccard.F.count("*").alias("rows")).withColumn("c", jaccard.F.col("cls.h1"))
    got = jaccard.spread_lookup(rows, classes, 8).collect()
    assert len(got) == 1001 and all(r.c == (r.cls.h1 if r.n else None) for r in got)


def test_sets_of_words():
    texts = ["", " ", "a", "a b c d e", "A b\x0bC D e ", "x" * 3000 + " é", "a b c d a b c d a b c d"]
    sets = jaccard.shingle_sets(texts)
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert np.array_equal(sets[3], sets[4]) and jaccard.class_of(sets[3]) == jaccard.class_of(sets[4])
    alone = [jaccard.shingle_sets([t])[0] for t in texts]
    assert all(np.array_equal(a, b) for a, b in zip(sets, alone))


def test_candidates_of_a_group_of_copies_grow_with_its_rows(spark):
    rng = random.Random(1)
    base = [f"w{k}" for k in range(120)]

    def pairs(count):
        texts = [" ".join(f"x{rng.randrange(10**9)}" if j == rng.randrange(120) else w for j, w in enumerate(base)) for _ in range(count)]
        df = spark.createDataFrame(list(enumerate([" ".join(base), *texts])), "doc_id long, text string")
        ranks = jaccard.cell_ranks(jaccard.describe(df, "doc_id", "text", 4))
        live = jaccard.shared(jaccard.prefixes(df, "doc_id", "text", 4, 85, ranks))
        return live.select("h1", "h2", "c_h1", "c_h2").distinct().count()

    assert pairs(400) < 4 * 400 + 800
