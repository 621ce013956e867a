"""Merkle manifest against trees built plainly, level by level."""

import random
import zlib
from hashlib import sha256

import pytest

from sentigrade.llm import merkle

KIND = "doc_id long, source string, lang string, n_chars long, text string, root string, pos int"


def sha(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    values = [row[0], row[1], row[2], row[3], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def build(level):
    levels = [level]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[k : k + 3])) for k in range(0, len(last), 3)])
    return levels


def climb(levels, position, value):
    """Siblings from the bottom up, and the root that ``value`` at ``position`` leads to."""
    siblings = []
    for level in levels[:-1]:
        run = level[position - position % 3 : position - position % 3 + 3]
        own = position % 3
        siblings += run[:own] + run[own + 1 :]
        value = sha("".join([*run[:own], value, *run[own + 1 :]]))
        position //= 3
    return siblings, value


def brute(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        own = sorted(sources[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[4])))
        trees[source] = own, build([leaf_of(r, r[4]) for r in own])
    top = build([trees[s][1][-1][0] for s in order])
    root = top[-1][0] if rows else None
    out = []
    for place, source in enumerate(order):
        own, levels = trees[source]
        for position, row in enumerate(own):
            leaf = leaf_of(row, row[4])
            torn = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None
            below, value = climb(levels, position, leaf_of(row, row[4].replace("\n", "")) if torn else leaf)
            above, folded = climb(top, place, value)
            out.append((row[0], leaf, levels[-1][0], root, sha("".join(below + above)), folded, folded == root))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    made = []
    for k in range(700):
        source = None if k % 31 == 0 else "hot" if k % 3 else rng.choice(["é", "a", "b\n", "", "Z", "alone0", "alone1"])
        text = rng.choice([None, "", "one\ntwo", f"text {k}\n\nend", "ä" * rng.randrange(9), "x"])
        made.append((rng.choice([k, k, None, 7]) if k % 10 == 0 else k, source, rng.choice([None, "en"]), rng.choice([None, k]), text, "r", 1))
    made.append((5000, "long", "en", 1, "word\n" * 200_000, "r", 1))
    return made + [made[9]] * 40


@pytest.mark.parametrize("height", [1, 2, 7])
def test_same_as_plain_trees(spark, rows, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    got = merkle.manifest(spark.createDataFrame(rows, KIND).repartition(5))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = sorted(map(tuple, got.collect()), key=repr)
    assert found == sorted(brute(rows), key=repr)
    assert {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize("count", [0, 1, 2, 3, 4, 9, 10])
def test_small_tables(spark, count):
    rows = [(k, f"s{k % 2}" if count > 2 else "s", None, None, "t", "r", 1) for k in range(count)]
    got = merkle.manifest(spark.createDataFrame(rows, KIND)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_many_sources(spark):
    rows = [(k, f"s{k}", "x", k, "a\nb", "r", 1) for k in range(90)]
    assert sorted(map(tuple, merkle.manifest(spark.createDataFrame(rows, KIND)).collect())) == sorted(brute(rows))


def test_the_queue_stays_short(monkeypatch):
    longest = 0

    def push(queue, item, real=merkle.heapq.heappush):
        nonlocal longest
        real(queue, item)
        longest = max(longest, len(queue))

    monkeypatch.setattr(merkle.heapq, "heappush", push)
    leaves = [sha256(str(k).encode()).digest() for k in range(2000)]
    (found,) = merkle.climb(((0, 2000, k, leaf) for k, leaf in enumerate(leaves)), 0, 7)
    assert found[:3] == (0, 2000, 0) and found[3].hex() == build([leaf.hex() for leaf in leaves])[-1][0]
    assert len(list(merkle.descend(leaves, 7, b""))) == 2000 and longest < 25
