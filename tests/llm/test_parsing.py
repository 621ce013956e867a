"""Locally consistent parsing: consistency of phrases, neighbours by id, likeness."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from sentigrade.llm import parsing


def names_of(text, level):
    symbol = parsing._mixed(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1))
    first = np.array([0])
    for _ in range(level):
        symbol, first = parsing.parse_level(symbol, first)
    return symbol.tolist()


def text_of(rng, words):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(words))


def test_equal_substrings_share_their_inner_phrases():
    rng = random.Random(2)
    middle = text_of(rng, 200)
    for level in (1, 2, 3):
        a, b = names_of(text_of(rng, 30) + middle + text_of(rng, 20), level), names_of(text_of(rng, 7) + middle, level)
        inside = names_of(middle, level)[12:-12]
        for whole in (a, b):
            start = whole.index(inside[0])
            assert whole[start : start + len(inside)] == inside


def test_phrases_are_short_and_cover_every_text():
    rng = random.Random(3)
    for text in ("a", "aa", "ab", "a" * 1000, "ab" * 500, "abc" * 400, text_of(rng, 500), "é日🎉" * 50):
        sizes = [len(names_of(text, level)) for level in range(1, 5)]
        assert sizes[0] >= 1 and all(b <= a for a, b in zip(sizes, sizes[1:]))
    long = text_of(rng, 2000)
    assert 2 <= len(long) / len(names_of(long, 1)) <= 4


def test_texts_in_one_portion_do_not_touch():
    rng = random.Random(4)
    texts = [text_of(rng, rng.randint(0, 80)) for _ in range(60)] + ["", "x", "xx"]
    alone = [parsing.sketches([t])[0] for t in texts]
    together = parsing.sketches(texts)
    assert all(np.array_equal(a, b) for x, y in zip(alone, together) for a, b in zip(x, y))
    assert [parsing.as_text(parsing.from_text(parsing.as_text(s))) for s in together] == [parsing.as_text(s) for s in together]


def test_likeness_follows_the_share_of_common_text():
    rng = random.Random(5)
    text, other = text_of(rng, 1000), text_of(rng, 1000)
    one, = parsing.sketches([text])
    values = [parsing.likeness(one, parsing.sketches([text[: len(text) * k // 4] + other[: len(text) * (4 - k) // 4]])[0]) for k in range(5)]
    assert values == sorted(values) and values[4] == 1 and values[0] < 0.05 and 0.2 < values[2] < 0.5


MASK = (1 << 64) - 1


def plain_mix(x):
    for _ in range(2):
        x = x * 0xD6E8FEB86659FD93 & MASK
        x ^= x >> 32
    return x


def plain_level(symbols):
    """One level of parsing, symbol by symbol."""
    runs = [(s, len(list(same))) for s, same in itertools.groupby(symbols)]
    symbols = [plain_mix((s + n * 0x9E3779B97F4A7C15) & MASK) for s, n in runs]
    labels = symbols
    for round_ in range(4):
        full = MASK if round_ == 0 else 255
        tossed = []
        for k, own in enumerate(labels):
            other = labels[k - 1] if k else ~own & full
            place = ((own ^ other) & -(own ^ other)).bit_length() - 1
            tossed.append(2 * place + (own >> place & 1))
        labels = tossed
    inner = range(1, len(labels) - 1)
    starts = [0, *(k for k in inner if labels[k] > labels[k - 1] and labels[k] > labels[k + 1])] if labels else []
    names = []
    for start, end in zip(starts, starts[1:] + [len(labels)]):
        total = sum(plain_mix(symbols[start + j] ^ ((j + 1) * 0x9E3779B97F4A7C15 & MASK)) for j in range(end - start))
        names.append(plain_mix((total & MASK) ^ ((end - start) * 0x9E3779B97F4A7C15 & MASK)))
    return names


def plain_sketch(text):
    symbols, found = [plain_mix(ord(c) + 1) for c in text], []
    for level in range(1, 5):
        symbols = plain_level(symbols)
        if level >= 2:
            found.append(sorted({s >> 32 for s in symbols})[:48])
    return found


def plain_likeness(a, b):
    shares = []
    for x, y in zip(a, b):
        union = sorted({*x, *y})[:48]
        if union:
            shares.append(sum(u in x and u in y for u in union) / len(union))
    return sum(shares) / len(shares) if shares else 1.0


def test_sketches_equal_plain_parsing():
    rng = random.Random(9)
    for text in ["", "a", "aa", "ab", "abab" * 30, "é日🎉" * 40, *(text_of(rng, rng.randint(1, 300)) for _ in range(20))]:
        (got,) = parsing.sketches([text])
        assert [x.tolist() for x in got] == plain_sketch(text)


def as_plain_text(sketch):
    return ".".join("".join(f"{name:08x}" for name in level) for level in sketch)


def brute(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (key, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = plain_sketch(text), plain_sketch(edited), plain_sketch(following)
        sha = hashlib.sha256(edited.encode()).hexdigest()
        out[key] = (key, len(text), sha, as_plain_text(a), as_plain_text(b), plain_likeness(a, b), plain_likeness(a, c))
    return sorted(out.values())


def test_an_id_on_many_rows_is_dealt_to_many_buckets(spark):
    rows = [(7, f"text {k}") for k in range(300)] + [(None, f"null {k}") for k in range(300)] + [(k, "x") for k in range(10, 110)] + [(7, "same")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    dealt = parsing.with_next(df, bucket_rows=20)
    sizes = {r.bucket: r["count"] for r in dealt.where("not tail").groupBy("bucket").count().collect()}
    assert sum(sizes.values()) == 750 and max(sizes.values()) < 100 and len(sizes) > 20
    tails = dealt.where("tail").groupBy("bucket").agg(parsing.F.countDistinct("key", "text").alias("n"), parsing.F.count("*").alias("m")).collect()
    assert {r.bucket for r in tails} == set(sizes) and max(r.m for r in tails) <= 4
    got = [r for r in parsing.compare_edited(df).collect()]
    assert len(got) == 750
    # All rows in one circle: what follows each, read from the edited texts.
    order = sorted(((-k if k is not None else 1 << 62, h, t) for k, h, t in df.select("doc_id", parsing.F.xxhash64("text"), "text").collect()))
    want = []
    for (_, _, text), (_, _, following) in zip(order, order[1:] + order[:1]):
        want.append(hashlib.sha256((text[: len(text) - len(text) // 2] + following[: len(text) // 2]).encode()).hexdigest())
    assert sorted(r.edited_sha256 for r in got) == sorted(want)


@pytest.mark.parametrize("bucket_rows", [1, 7, 1000])
def test_neighbours_by_id(spark, monkeypatch, bucket_rows):
    rng = random.Random(6)
    rows = [(rng.randrange(10**12), rng.choice([None, "", "é", text_of(rng, rng.randint(0, 50))])) for _ in range(90)]
    rows.append((5, text_of(rng, 4000)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", parsing.F.lit("x")).repartition(4)
    monkeypatch.setattr(parsing, "with_next", lambda *a, f=parsing.with_next: f(*a, bucket_rows=bucket_rows))
    got = sorted(map(tuple, parsing.compare_edited(df).collect()))
    assert [r[:5] for r in got] == [r[:5] for r in brute(rows)]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in brute(rows)])


def test_ties_null_ids_and_empty_tables(spark):
    rows = [(5, "abc"), (5, "abd"), (5, "abd"), (None, "zz"), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = parsing.compare_edited(df).collect()
    assert sorted(((r.doc_id, r.n_chars) for r in got), key=repr) == sorted(((k, len(t or "")) for k, t in rows), key=repr)
    assert len({r.fingerprint for r in got if r.n_chars == 3}) == 2
    assert parsing.compare_edited(df.limit(0)).count() == 0
    one = parsing.compare_edited(df.limit(1)).first()
    assert one.near_next == 1.0
    assert parsing.fingerprints(df).where("fingerprint is null").count() == 0
