"""Exact Jaccard self-join of documents over word shingles: rare-first prefix filtering.

A document is the set of its different shingles of ``SHINGLE`` words.  Documents with equal sets form a
class, named by a 128-bit hash of the set, and only classes are compared.

1. One pass over the texts yields set size and class of every document, and counts shingles in a
   table of ``CELLS`` hashed cells.  The cells give one order for all shingles, rare ones first; its
   size is fixed, so it may travel to every task.
2. A second pass emits the prefix of each class: the first n - ceil(t n) + 1 shingles in that order.
   Shuffled by shingle, those of one class only are dropped, and each row learns the bucket's centre,
   the class whose prefix holds the shingle earliest.
3. First round: every class is paired with the centres of its buckets, which is linear in the rows.
   Second round: the rows of a bucket that are still in different components are tested against each other
   by the filters where they meet, inside a task; only pairs that pass become rows.  A bucket with more of
   them than ``PAIRS`` a row gives those with the first rows of a few components instead, and is gone
   through again with the components merged; once a round adds no link, all its pairs that pass are taken.
   Unrelated components of a common bucket cost no pairs, and no link that could join two is missed.
   Hot buckets are cut by set size and into blocks that meet as groups of their own.
4. Pairs pass the length, positional and suffix filters, and each is verified once on its whole sets.

The positional filter bounds the overlap by what follows the shared shingle on the shorter side.  The
suffix filter divides what follows into eight parts by hash; the parts' sizes bound how much differs.

Texts that are null or have no word have an empty set, link with nothing and are their own component.
Repeated rows share a class.  Rows with a null key get the smallest key of their component, null if
there is none.  Memory is bounded by a portion of texts or the longest one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import materialize
from .components import components
from .parsing import _mixed, portions

SHINGLE = 4
PERCENT = 85
CELLS = 1 << 22
SLICES = 64
CENTRES = 8
PAIRS = 8
BLOCK = 4096
HOT_PARTS = 256
BUCKET_ROW = ["h1", "h2", "r1", "r2", "n", "rest", "parts", "visit", "block"]
ROOT, N, REST, PARTS, VISIT, BLOCK_AT = 2, 4, 5, 6, 7, 8
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FACTOR = np.uint64(0xFF51AFD7ED558CCD)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[0x41:0x5B] += np.uint64(0x20)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, A-Z lower-cased, and the number of words of each text."""
    data = [text.encode("utf-8", "surrogatepass") for text in texts]
    raw = np.frombuffer(b" ".join([b"", *data, b""]), dtype=np.uint8)
    inside = ~_SPACE[raw]
    at = np.flatnonzero(inside)
    begin = np.flatnonzero(inside[at] & ~inside[at - 1]) if len(at) else at
    ends = np.cumsum([len(d) + 1 for d in data]) if data else np.zeros(0, dtype=np.int64)
    counts = np.bincount(np.searchsorted(ends, at[begin]), minlength=len(texts))
    if not len(at):
        return np.zeros(0, dtype=np.uint64), counts
    sizes = np.diff(np.append(begin, len(at)))
    place = (np.arange(len(at)) - np.repeat(begin, sizes)).astype(np.uint64)
    hashes = np.add.reduceat(_mixed(_LOWER[raw[at]] + (place + np.uint64(1)) * _ODD), begin)
    return _mixed(hashes ^ (sizes.astype(np.uint64) * _ODD)), counts


def shingle_sets(texts: list[str], words: int = SHINGLE) -> list[np.ndarray]:
    """The sorted different shingles of every text as 64-bit hashes."""
    hashes, counts = word_hashes(texts)
    size = max(len(hashes) - words + 1, 0)
    joined = np.full(size, words, dtype=np.uint64)
    for k in range(words):
        joined = _mixed(joined * _FACTOR + hashes[k : k + size])
    out = []
    start = 0
    for count in counts.tolist():
        if count >= words:
            out.append(np.unique(joined[start : start + count - words + 1]))
        elif count:
            value = np.array([count], dtype=np.uint64)
            for k in range(count):
                value = _mixed(value * _FACTOR + hashes[start + k : start + k + 1])
            out.append(value)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        start += count
    return out


def class_of(shingles: np.ndarray) -> tuple[int, int]:
    """128-bit hash of a set as two signed integers."""
    digest = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _sets_of(batch: pa.RecordBatch, column: int, words: int) -> Iterator[np.ndarray]:
    for part in portions(text or "" for text in batch.column(column).to_pylist()):
        yield from shingle_sets(part, words)


def _source(documents: DataFrame, key: str, text: str) -> DataFrame:
    return documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))


def describe(documents: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """One row for each document (key, n, h1, h2) and rows with counts of cells (slice, counts)."""
    source = _source(documents, key, text)
    names = ["key", "n", "h1", "h2", "slice", "counts"]
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, nothing = np.zeros(CELLS, dtype=np.uint32), None
        for batch in batches:
            rows = batch.num_rows
            nothing = batch.column(0).type
            sizes, classes, held, waiting = [], [], [], 0
            for one in _sets_of(batch, 1, words):
                sizes.append(len(one))
                classes.append(class_of(one))
                held.append((one >> np.uint64(42)).astype(np.uint32))
                waiting += len(one)
                if waiting > 2_000_000:
                    total += np.bincount(np.concatenate(held), minlength=CELLS).astype(np.uint32)
                    held, waiting = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=CELLS).astype(np.uint32)
            h1, h2 = zip(*classes) if classes else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                 pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names,
            )
        if nothing is not None:
            parts = np.minimum(total, 0xFFFF).astype(np.uint16).reshape(SLICES, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(SLICES, nothing), *(pa.nulls(SLICES, pa.int64()) for _ in range(3)),
                 pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names,
            )

    return source.mapInArrow(run, f"key {kind}, n long, h1 long, h2 long, slice int, counts binary")


def cell_ranks(described: DataFrame) -> np.ndarray:
    """How frequent the shingles of each cell are, on a scale of 16 bits."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(counts, dtype=np.uint16)
                if number in sums:
                    sums[number] += values
                else:
                    sums[number] = values.astype(np.uint64)
        for number, values in sums.items():
            ranks = np.minimum(2048 * np.log2(1.0 + values), 0xFFFF).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([ranks.tobytes()], pa.binary())], ["slice", "ranks"])

    slices = described.where("slice is not null").select("slice", "counts").repartition("slice")
    found = {r.slice: r.ranks for r in slices.mapInArrow(add, "slice int, ranks binary").collect()}
    blank = bytes(2 * CELLS // SLICES)
    return np.frombuffer(b"".join(found.get(k, blank) for k in range(SLICES)), dtype=np.uint16)


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def prefixes(documents: DataFrame, key: str, text: str, words: int, percent: int, ranks: np.ndarray) -> DataFrame:
    """token, h1, h2, n, rest (shingles behind it), parts (eight sizes of them, one byte each, full at 255)."""
    names = ["token", "h1", "h2", "n", "rest", "parts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # a class once in a task
        out: list[list[np.ndarray]] = [[] for _ in names]
        waiting = 0
        for batch in batches:
            for one in _sets_of(batch, 0, words):
                n = len(one)
                own = class_of(one)
                if not n or own in seen:
                    continue
                seen.add(own)
                order = np.lexsort((one, ranks[one >> np.uint64(42)]))
                length = n - least_overlap(n, percent) + 1
                first = one[order[:length]]
                part = (first & np.uint64(7)).astype(np.int64)
                sizes = np.bincount((one & np.uint64(7)).astype(np.int64), minlength=8)
                behind = sizes - np.cumsum(np.eye(8, dtype=np.int64)[part], axis=0)
                packed = np.minimum(behind, 255).astype(np.uint8).view(np.int64).ravel()
                rest = n - 1 - np.arange(length)
                values = (first.view(np.int64), np.full(length, own[0]), np.full(length, own[1]), np.full(length, n), rest, packed)
                for column, value in zip(out, values):
                    column.append(value)
                waiting += length
                if waiting >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names)
                    out, waiting = [[] for _ in names], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names)

    return _source(documents, key, text).select("text").mapInArrow(
        run, "token long, h1 long, h2 long, n long, rest long, parts long"
    )


def shared(rows: DataFrame) -> DataFrame:
    """Rows whose token stands in the prefix of two classes at least, with the bucket's centre (c_ columns).

    The partitions are sorted and read as a stream, so a bucket of any size needs no memory.
    """
    names = ["token", "h1", "h2", "n", "rest", "parts"]
    out_names = [*names, *(f"c_{c}" for c in names[1:])]
    sorted_rows = (
        rows.repartition("token")
        .withColumn("place", F.col("n") - F.col("rest"))
        .sortWithinPartitions("token", "place", "n", "h1", "h2")
        .select(*names)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 6), dtype=np.int64)  # the last row, not yet known to be shared
        centre = np.zeros((0, 6), dtype=np.int64)  # of that row's bucket
        open_bucket = False  # the last row's bucket is known to be shared
        for batch in batches:
            table = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)])
            if not len(table):
                continue
            # Tasks send a class more than once: its rows of one bucket are equal and adjacent.
            fresh = np.append(True, (table[1:] != table[:-1]).any(axis=1))
            begin = np.append(True, table[1:, 0] != table[:-1, 0])
            starts = np.flatnonzero(begin)
            group = np.cumsum(begin) - 1
            centres = table[starts].copy()
            if open_bucket or len(held):
                centres[0] = centre[0]
            known = np.bincount(group[fresh], minlength=len(starts)) > 1
            if open_bucket:
                known[0] = True
            emit = fresh & known[group]
            if open_bucket:
                emit[0] = False  # sent before
            last = len(table) - 1
            emit_last = emit[last]
            chosen = np.flatnonzero(emit)
            if len(chosen):
                both = np.concatenate([table[chosen], centres[group[chosen]][:, 1:]], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k])) for k in range(11)], out_names)
            open_bucket = bool(known[group[last]])
            held, centre = table[last:], centres[group[last]][None]

    columns = ", ".join(f"{c} long" for c in out_names)
    return sorted_rows.mapInArrow(run, columns)


def may_link(percent: int, left: str = "", right: str = "") -> Column:
    """Length, positional and suffix filter on two prefix rows of one token."""

    def col(side: str, name: str) -> Column:
        return F.col(f"{side}{name}")

    n, m = col(left, "n"), col(right, "n")
    least = F.ceil(F.lit(percent) * (n + m) / (100 + percent))  # overlap that the threshold asks for
    differ = F.lit(0).cast("long")
    for k in range(8):
        a, b = (F.shiftrightunsigned(col(side, "parts"), 8 * k).bitwiseAND(F.lit(255)) for side in (left, right))
        differ = differ + F.abs(a - b)
    rest, other = col(left, "rest"), col(right, "rest")
    return (
        (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m))
        & (F.least(rest, other) + 1 >= least)
        & (F.floor((rest + other - differ) / 2) + 1 >= least)
    )


def whole_sets(documents: DataFrame, wanted: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """cls and shingles of the documents with the keys in ``wanted``; a task sends a class once."""
    source = _source(documents, key, text)
    some = source.join(wanted.select(F.col("key").alias("_key")).distinct(), F.col("key").eqNullSafe(F.col("_key")), "left_semi")
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        rows, size = [], 0
        for batch in batches:
            for one in _sets_of(batch, 0, words):
                own = class_of(one)
                if own in seen:
                    continue
                seen.add(own)
                rows.append((*own, one.view(np.int64)))
                size += len(one)
                if size >= 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["h1", "h2", "shingles"])
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["h1", "h2", "shingles"])

    found = some.select("text").mapInArrow(run, "h1 long, h2 long, shingles array<long>")
    return found.select(F.struct("h1", "h2").alias("cls"), "shingles")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that link."""
    left = sets.select(F.col("cls").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("cls").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    all_of_them = F.size("a") + F.size("b") - both
    linked = F.lit(100) * both >= F.lit(percent) * all_of_them
    # Tasks that saw copies of a class send its set again, so a pair may come twice.
    return pairs.join(left, "u").join(right, "v").where(linked).select("u", "v").distinct()


def _survivors(table: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which positions (left, right) of bucket rows belong to different components and pass the three filters."""
    n, rest = table[:, N], table[:, REST]
    good = ((table[left, ROOT] != table[right, ROOT]) | (table[left, ROOT + 1] != table[right, ROOT + 1])) & (
        100 * np.minimum(n[left], n[right]) >= percent * np.maximum(n[left], n[right])
    )
    least = -(-percent * (n[left] + n[right]) // (100 + percent))
    at = np.flatnonzero(good & (np.minimum(rest[left], rest[right]) + 1 >= least))
    left, right, least = left[at], right[at], least[at]
    parts = np.ascontiguousarray(table[:, PARTS]).view(np.uint8).reshape(-1, 8).astype(np.int16)
    differ = np.abs(parts[left] - parts[right]).sum(axis=1)
    keep = (rest[left] + rest[right] - differ) // 2 + 1 >= least
    found = np.zeros(len(good), dtype=bool)
    found[at[keep]] = True
    return found


def _all_pairs(table: np.ndarray, group: np.ndarray, percent: int, most: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all surviving pairs inside the groups of a sorted table.

    With ``most``, a bound for each group, which is written over by what is left of it: the pairs of a
    group that goes beyond are given up, its bound is then negative.
    """
    end = np.searchsorted(group, group, side="right")
    n, visit, block = table[:, N], table[:, VISIT], table[:, BLOCK_AT]
    left, step = np.arange(len(table)), 0
    while True:
        step += 1
        left = left[left + step < end[left]]
        left = left[100 * n[left] >= percent * n[left + step]]  # sets only grow to the right
        if most is not None:
            left = left[most[group[left]] >= 0]
        if not len(left):
            return
        # Within one block (-1) all rows meet, in a pair of blocks those of different ones.
        right = left + step
        at = np.flatnonzero((visit[left] + visit[right] < 2) & ((block[left] < 0) | (block[left] != block[right])))
        at = at[_survivors(table, left[at], right[at], percent)]
        if len(at):
            if most is not None:
                most -= np.bincount(group[left[at]], minlength=len(most))
            yield left[at], right[at]


def _centre_pairs(table: np.ndarray, group: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Surviving pairs of a row with the first rows of up to ``CENTRES`` components of its group."""
    order = np.lexsort((table[:, ROOT + 1], table[:, ROOT], group))
    by = np.stack([group[order], table[order, ROOT], table[order, ROOT + 1]], 1)
    firsts = np.sort(order[np.append(True, (by[1:] != by[:-1]).any(axis=1))])  # of every component in a group
    starts = np.searchsorted(group[firsts], np.arange(group[-1] + 1))
    ends = np.append(starts[1:], len(firsts))
    for k in range(CENTRES):
        left = np.flatnonzero((starts + k < ends)[group])
        if not len(left):
            return
        right = firsts[starts[group[left]] + k]
        keep = _survivors(table, left, right, percent)
        if keep.any():
            yield left[keep], right[keep]


def dealt_rows(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Bucket rows with what forms the groups they meet in: token, band, a and b, and visit and block.

    A bucket is one group, but for the tokens in ``hot``: their rows meet in bands of set size as wide as
    the length filter, their own and that above it, and a band of more than ``BLOCK`` rows is cut into
    blocks, each pair of blocks a group.
    """
    whole = [F.lit(v).alias(c) for c, v in (("band", -1), ("a", 0), ("b", 0), ("visit", 0), ("block", -1))]
    plain = rows.join(hot, "token", "left_anti").select("*", *whole)
    if hot.isEmpty():
        return plain
    band = F.floor(F.col("n_band")).cast("int")
    both = F.array(F.struct(band.alias("band"), F.lit(0).alias("visit")), F.struct((band + 1).alias("band"), F.lit(1).alias("visit")))
    heavy = rows.join(hot, "token", "left_semi").select("*", F.explode(both).alias("t")).select(*rows.columns, "t.band", "t.visit")
    counts = heavy.groupBy("token", "band").agg(F.count("*").alias("rows"), F.min("visit").alias("low"))
    useful = counts.where("rows > 1 and low = 0").select("token", "band", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    tasks = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, F.col("block")).alias("a"), F.greatest(i, F.col("block")).alias("b"))
    )
    cut = heavy.join(useful, ["token", "band"]).withColumn("block", block).withColumn("t", F.explode(tasks))
    one = F.when(F.col("t.a") == F.col("t.b"), -1).otherwise(F.col("block"))
    return plain.unionByName(cut.select(*rows.columns, "band", "t.a", "t.b", "visit", one.alias("block")))


def candidates(rows: DataFrame, hot: DataFrame, percent: int, bounded: bool) -> DataFrame:
    """Pairs (u, v) of classes of different components that share a bucket and pass the filters.

    Rows meet inside a task, which holds a few thousand or one group; only pairs that pass become rows.
    With ``bounded``, a group with more of them than ``PAIRS`` a row gives the pairs with its centres only
    and a row that names its token (else null).
    """
    keys = ["token", "band", "a", "b"]
    names = [*keys, *BUCKET_ROW]
    width = math.log(1.0001 * 100 / percent)
    flat = dealt_rows(rows.withColumn("n_band", F.log("n") / width), hot)
    flat = flat.select(*keys, "cls.*", F.col("root.h1").alias("r1"), F.col("root.h2").alias("r2"), "n", "rest", "parts", "visit", "block")
    dealt = flat.repartition(*keys).sortWithinPartitions(*keys, "n", "h1", "h2").select(*(F.col(c).cast("long") for c in names))

    def batch_of(body: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
        both = np.concatenate([body[left, :2], body[right, :2]], axis=1)
        swap = (both[:, 0] > both[:, 2]) | ((both[:, 0] == both[:, 2]) & (both[:, 1] > both[:, 3]))
        both[swap] = both[swap][:, [2, 3, 0, 1]]
        both = np.unique(both, axis=0)
        columns = [pa.nulls(len(both), pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in both.T)]
        return pa.RecordBatch.from_arrays(columns, ["token", "u1", "u2", "v1", "v2"])

    def found(table: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        body = np.ascontiguousarray(table[:, len(keys) :])
        if not bounded:
            for left, right in _all_pairs(body, group, percent, None):
                yield batch_of(body, left, right)
            return
        most = PAIRS * np.bincount(group)
        pairs = list(_all_pairs(body, group, percent, most))
        over = most < 0
        if over.any():
            rows_over = np.flatnonzero(over[group])
            numbers = np.cumsum(np.append(False, group[rows_over][1:] != group[rows_over][:-1]))
            for left, right in _centre_pairs(body[rows_over], numbers, percent):
                yield batch_of(body[rows_over], left, right)
            tokens = pa.array(np.unique(table[rows_over, 0]))
            yield pa.RecordBatch.from_arrays([tokens, *[pa.nulls(len(tokens), pa.int64())] * 4], ["token", "u1", "u2", "v1", "v2"])
        for left, right in pairs:
            within = ~over[group[left]]
            if within.any():
                yield batch_of(body, left[within], right[within])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, len(names)), dtype=np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)])
            if not len(held):
                continue
            begin = np.append(True, (held[1:, : len(keys)] != held[:-1, : len(keys)]).any(axis=1))
            last = np.flatnonzero(begin)[-1]  # the last group may go on
            if last:
                yield from found(held[:last], np.cumsum(begin[:last]) - 1)
                held = held[last:]
        if len(held):
            yield from found(held, np.zeros(len(held), dtype=np.int64))

    named = [
        F.when(F.col("u1").isNotNull(), F.struct(F.col(f"{c}1").alias("h1"), F.col(f"{c}2").alias("h2"))).alias(c) for c in "uv"
    ]
    return dealt.mapInArrow(run, "token long, u1 long, u2 long, v1 long, v2 long").select("token", *named)


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("cls")).distinct()


def _grouped(documents: DataFrame, key: str, text: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """key, n and cls of every row; cls, smallest key and top, the class that names its component, of every class."""
    described = materialize(describe(documents, key, text, words), "jaccard-documents")
    ranks = cell_ranks(described)
    rows = described.where("slice is null").select("key", "n", F.struct("h1", "h2").alias("cls"))
    live = materialize(shared(prefixes(documents, key, text, words, percent, ranks)), "jaccard-prefixes")
    live = live.withColumns({"cls": F.struct("h1", "h2"), "c_cls": F.struct(F.col("c_h1").alias("h1"), F.col("c_h2").alias("h2"))})
    classes = rows.where("n > 0").groupBy("cls").agg(F.min("key").alias("key"), F.count("*").alias("rows"))
    first = live.where((F.col("cls") != F.col("c_cls")) & may_link(percent, "", "c_")).select(
        F.least("cls", "c_cls").alias("u"), F.greatest("cls", "c_cls").alias("v")
    )
    first = materialize(first.distinct(), "jaccard-pairs")
    sets = materialize(whole_sets(documents, classes.join(ends(first), "cls", "left_semi"), key, text, words), "jaccard-sets")
    links = materialize(verify(first, sets, percent), "jaccard-links")
    roots = components(links, "jaccard-components")
    checked = first

    def confirm(pairs: DataFrame) -> DataFrame:
        nonlocal sets
        unseen = classes.join(ends(pairs), "cls", "left_semi").join(sets.select("cls"), "cls", "left_anti")
        if not unseen.isEmpty():
            sets = sets.unionByName(materialize(whole_sets(documents, unseen, key, text, words), "jaccard-sets"))
        return materialize(verify(pairs, sets, percent), "jaccard-more")

    hot = materialize(live.groupBy("token").count().where(F.col("count") > BLOCK).select("token"), "jaccard-hot")
    open_rows, bounded = live.select("token", "cls", "n", "rest", "parts"), True
    while True:
        rooted = open_rows.join(roots.withColumnRenamed("u", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        found = materialize(candidates(rooted, hot, percent, bounded), "jaccard-candidates")
        pairs = found.where("token is null").select("u", "v").distinct().join(checked, ["u", "v"], "left_anti")
        pairs = materialize(pairs, "jaccard-further")
        more = None if pairs.isEmpty() else confirm(pairs)
        if more is not None and not more.isEmpty():
            roots = components(roots.select("u", F.col("root").alias("v")).unionByName(more), "jaccard-merged")
        else:
            more = None
        over = found.where("token is not null").select("token").distinct()
        if not bounded or over.isEmpty():
            break
        # Buckets that held too many pairs, with fewer components now; whole once a round adds no link.
        open_rows, checked, bounded = open_rows.join(over, "token", "left_semi"), checked.unionByName(pairs), more is not None
    tops = roots.withColumnRenamed("u", "cls")
    grouped = classes.join(tops, "cls", "left").select("cls", "key", "rows", F.coalesce("root", "cls").alias("top"))
    return rows, grouped


def spread_lookup(rows: DataFrame, classes: DataFrame, parts: int) -> DataFrame:
    """``rows`` left-joined to ``classes`` by cls, classes of more than a ``parts``-th of all rows in ``parts`` pieces.

    There are fewer than ``parts`` such classes, so their list may be sent to every task.
    """
    total = classes.agg(F.sum("rows")).first()[0] or 0
    hot = classes.where(F.col("rows") * parts > F.lit(total)).select("cls", F.lit(True).alias("hot"))
    classes, hot = classes.drop("rows"), F.broadcast(hot)
    pieces = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    many = classes.join(hot, "cls", "left").withColumn("piece", F.explode(pieces)).drop("hot")
    piece = F.when(F.col("hot"), F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")).otherwise(0)
    return rows.join(hot, "cls", "left").withColumn("piece", piece).drop("hot").join(many, ["cls", "piece"], "left").drop("piece")


def near_duplicates(
    documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """Key, ``n_shingles`` and ``component_id`` of every row."""
    rows, grouped = _grouped(documents, key, text, words, percent)
    smallest = grouped.groupBy("top").agg(F.min("key").alias("component_id"))
    component = grouped.join(smallest, "top").select("cls", "rows", "component_id")
    return (
        spread_lookup(rows, component, HOT_PARTS)
        .select(
            F.col("key").alias(key),
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"),
        )
    )


def with_class(rows: DataFrame, text: str, words: int) -> DataFrame:
    """``rows`` with the size of the set of their text, _size, and its class, _h1 and _h2."""
    schema = StructType([*rows.schema.fields, *(StructField(c, LongType()) for c in ("_size", "_h1", "_h2"))])
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(one), *class_of(one)) for one in _sets_of(batch, at, words)]
            more = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema.names)

    return rows.mapInArrow(run, schema)


def keep_one(
    documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """One row of every component, that with the smallest key and class, columns as they are.

    Of rows that repeat a key and a class the smallest stays; rows with a null key or an empty set stay.
    """
    described, grouped = _grouped(documents, key, text, words, percent)
    chosen = grouped.where("key is not null").groupBy("top").agg(F.min(F.struct("key", "cls")).alias("one"))
    chosen = materialize(chosen.select(F.col("one.key").alias("_kept"), F.col("one.cls.h1").alias("_h1"), F.col("one.cls.h2").alias("_h2")), "jaccard-kept")
    empty = described.where("n = 0 and key is not null").select(F.col("key").alias("_kept"))
    repeated = described.where("key is not null").groupBy(F.col("key").alias("_kept")).agg(F.count("*").alias("_n")).where("_n > 1").select("_kept")
    repeated = materialize(repeated, "jaccard-repeated")
    # The columns of documents travel in one struct, so none can clash.
    rows = documents.select(F.struct("*").alias("_doc"), F.col(key).alias("_kept"), F.col(text).cast("string").alias("_text"))
    alone = chosen.select("_kept").unionByName(empty).join(repeated, "_kept", "left_anti")
    once = rows.join(alone, "_kept", "left_semi").select("_doc")
    several = with_class(rows.join(repeated, "_kept", "left_semi").select("_doc", "_kept", "_text"), "_text", words)
    wordless = several.where("_size = 0").select("_doc")
    same = ["_kept", "_h1", "_h2"]
    one = several.where("_size > 0").join(chosen, same, "left_semi").groupBy(*same).agg(F.min("_doc").alias("_doc")).select("_doc")
    unnamed = rows.where("_kept is null").select("_doc")
    kept = once.unionByName(one).unionByName(wordless).unionByName(unnamed)
    return kept.select(*(F.col("_doc")[c].alias(c) for c in documents.columns))
