"""Document fingerprints by locally consistent parsing.

A text is a row of symbols, its code points.  One level of parsing names runs of equal symbols, then
tosses deterministic coins: a symbol's label becomes the place and value of the lowest bit in which it
differs from its predecessor's, which keeps neighbours different and shrinks labels from 64 bits to
fewer than six values in four rounds.  A phrase begins at every local maximum of the labels and is named
by a hash of its symbols; phrases are the symbols of the next level.  A phrase depends on a few
neighbours only, so equal substrings get the same phrases inside, wherever they stand.

The fingerprint keeps the ``KEPT`` smallest names of each of ``LEVELS`` (phrases of about 6, 15 and 35
characters).  The likeness of two fingerprints is the mean over levels of the bottom-k estimate of the
Jaccard index of their phrase sets; levels at which both are empty count for nothing, and two empty
texts are alike.

Null texts count as empty: their fingerprint has no names.  Equal texts have equal fingerprints.  Repeated rows are
rows of their own, equal ids follow one another by a hash of their text.  Only id and text are read, so further
columns and their names don't matter.  An empty table gives no rows.
Memory is bounded by a portion of texts of about ``PORTION`` characters or the longest single text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = (2, 3, 4)
KEPT = 48
PORTION = 1_000_000
BUCKET_ROWS = 2000
MOST_BUCKETS = 4096
NULL_PLACE = (1 << 63) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values; works in place on a fresh array."""
    x = x * _MIX
    x ^= x >> np.uint64(32)
    x *= _MIX
    x ^= x >> np.uint64(32)
    return x


def _toss(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Place of the lowest bit that differs from the predecessor's, doubled, plus the own bit there."""
    other = np.empty_like(label)
    other[1:] = label[:-1]
    other[first] = ~label[first]
    differ = label ^ other
    lowest = differ & (~differ + label.dtype.type(1))
    place = np.bitwise_count(lowest - label.dtype.type(1))
    return (place << np.uint8(1)) | ((label & lowest) != 0)


def parse_level(symbol: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of many rows of symbols, and where each row's phrases begin.

    ``first`` holds where rows begin in ``symbol``; no row is empty.
    """
    # Runs of equal symbols become one symbol each.
    fresh = np.empty(len(symbol), dtype=bool)
    fresh[0] = True
    np.not_equal(symbol[1:], symbol[:-1], out=fresh[1:])
    fresh[first] = True
    at = np.flatnonzero(fresh)
    length = np.diff(np.append(at, len(symbol))).astype(np.uint64)
    symbol = _mixed(symbol[at] + length * _ODD)
    first = np.searchsorted(at, first)
    # Four rounds leave labels below six that differ from both neighbours inside a row.
    label = symbol
    for _ in range(4):
        label = _toss(label, first)
    peak = np.zeros(len(label), dtype=bool)
    peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    last = np.append(first[1:], len(label)) - 1
    peak[last] = False
    peak[first] = True
    starts = np.flatnonzero(peak)
    sizes = np.diff(np.append(starts, len(label)))
    place = (np.arange(len(label)) - np.repeat(starts, sizes)).astype(np.uint64)
    names = np.add.reduceat(_mixed(symbol ^ (place * _ODD + _ODD)), starts)
    return _mixed(names ^ (sizes.astype(np.uint64) * _ODD)), np.searchsorted(starts, first)


def portions(texts: Iterable[str], most: int = PORTION) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _sketches(texts: list[str]) -> list[tuple[np.ndarray, ...]]:
    empty = tuple(np.zeros(0, dtype=np.uint32) for _ in LEVELS)
    full = [k for k, text in enumerate(texts) if text]
    out = [empty] * len(texts)
    if not full:
        return out
    sizes = np.array([len(texts[k]) for k in full])
    points = np.frombuffer("".join([texts[k] for k in full]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    symbol, first = _mixed(points.astype(np.uint64) + np.uint64(1)), np.concatenate(([0], np.cumsum(sizes)[:-1]))
    found: list[list[np.ndarray]] = [[] for _ in full]
    for level in range(1, max(LEVELS) + 1):
        symbol, first = parse_level(symbol, first)
        if level in LEVELS:
            short = (symbol >> np.uint64(32)).astype(np.uint32)
            for k, names in enumerate(np.split(short, first[1:])):
                if len(names) > 4 * KEPT:  # enough for KEPT different ones unless many repeat
                    low = np.unique(np.partition(names, 2 * KEPT)[: 2 * KEPT])
                    names = low if len(low) >= KEPT else names
                found[k].append(np.unique(names)[:KEPT])
    for k, levels in zip(full, found):
        out[k] = tuple(levels)
    return out


def sketches(texts: list[str]) -> list[tuple[np.ndarray, ...]]:
    """The smallest phrase names of each level for every text."""
    return [one for part in portions(texts) for one in _sketches(part)]


def as_text(sketch: tuple[np.ndarray, ...]) -> str:
    """Names as eight hexadecimal digits each, levels separated by a full stop."""
    return ".".join(names.astype(">u4").tobytes().hex() for names in sketch)


def from_text(fingerprint: str) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(bytes.fromhex(part), dtype=">u4").astype(np.uint32) for part in fingerprint.split("."))


def likeness(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> float:
    shares = []
    for x, y in zip(a, b):
        if len(x) or len(y):
            union = np.union1d(x, y)[:KEPT]
            both = np.intersect1d(x, y, assume_unique=True)
            shares.append(np.isin(union, both, assume_unique=True).sum() / len(union))
    return float(np.mean(shares)) if shares else 1.0


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``fingerprint`` of every row."""
    source = documents.select(F.col(key).alias("key"), F.col(text).cast("string"))

    def run(batches):
        for batch in batches:
            made = [as_text(s) for s in sketches([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["key", "fingerprint"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, fingerprint string").withColumnRenamed("key", key)


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _cuts(quantiles: list[float], nulls: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (id turned round, hash of the text) at which buckets begin, in order.

    An id that is several quantiles is cut that often, evenly by hash; so are null ids, which come last, once
    for every ``share`` rows.
    """
    ids, times = np.unique(-np.array(quantiles, dtype=np.int64), return_counts=True)
    found = [*zip(ids.tolist(), times.tolist()), (NULL_PLACE, math.floor(nulls / share))]
    return (
        np.array([place for place, count in found for _ in range(count)], dtype=np.int64),
        np.array([(k + 1) * (1 << 64) // (count + 1) - (1 << 63) for _, count in found for k in range(count)], dtype=np.int64),
    )


def _bucket_of(cuts: tuple[np.ndarray, np.ndarray], place: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bucket = np.searchsorted(cuts[0], place, side="left")
    for value in np.intersect1d(cuts[0], place):
        rows, low, high = place == value, *np.searchsorted(cuts[0], [value, value + (value < NULL_PLACE)], side="left")
        high = high if value < NULL_PLACE else len(cuts[0])
        bucket[rows] += np.searchsorted(cuts[1][low:high], hashes[rows], side="right")
    return bucket


def with_next(documents: DataFrame, key: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows dealt to buckets that follow one another in descending order of the id, then of a hash of the text.

    Columns bucket, key, text, tail.  Every bucket also gets, as its tail, the first row of the next one
    (the last bucket that of the first), so each is complete alone.  The driver holds two places for each of at
    most ``MOST_BUCKETS`` buckets; the texts are moved once.
    """
    source = documents.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("hash", F.xxhash64("text"))
    sizes = source.agg(F.count("*").alias("rows"), F.count("key").alias("known")).first()
    wanted = max(1, min(MOST_BUCKETS, -(-sizes.rows // bucket_rows)))
    share = sizes.rows / wanted
    known = min(wanted, math.ceil(sizes.known / share)) if sizes.rows else 1
    quantiles = source.where("key is not null").approxQuantile("key", [k / known for k in range(1, known)], 0.1 / known) if known > 1 else []
    cuts = _cuts(quantiles, sizes.rows - sizes.known, max(1.0, share))

    def places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        ids = batch.column(0)
        place = np.where(ids.is_null().to_numpy(zero_copy_only=False), NULL_PLACE, -ids.fill_null(0).to_numpy(zero_copy_only=False))
        return place, batch.column(1).to_numpy(zero_copy_only=False)

    def number(batches):
        for batch in batches:
            place, hashes = places(batch)
            columns = [pa.array(c) for c in (_bucket_of(cuts, place, hashes), place, hashes)]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "place", "hash"])

    heads = source.select("key", "hash").mapInArrow(number, "bucket long, place long, hash long")
    heads = {r.bucket: tuple(r.head) for r in heads.groupBy("bucket").agg(F.min(F.struct("place", "hash")).alias("head")).collect()}
    order = sorted(heads)
    tail_of = {heads[after]: before for before, after in zip(order, order[1:] + order[:1])}
    head_places = np.array(sorted({place for place, _ in tail_of}), dtype=np.int64)

    def deal(batches):
        names = ["bucket", "key", "text", "tail"]
        sent = set()  # of equal rows a task sends one
        for batch in batches:
            place, hashes = places(batch)
            columns = [pa.array(_bucket_of(cuts, place, hashes)), batch.column(0), batch.column(2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.zeros(len(place), dtype=bool))], names)
            again = []
            for k in np.flatnonzero(np.isin(place, head_places)).tolist():
                own = int(place[k]), int(hashes[k])
                if own in tail_of and own not in sent:
                    sent.add(own)
                    again.append((tail_of[own], k))
            if again:
                at = pa.array([k for _, k in again])
                bucket = pa.array([b for b, _ in again], pa.int64())
                yield pa.RecordBatch.from_arrays([bucket, batch.column(0).take(at), batch.column(2).take(at), pa.array([True] * len(at))], names)

    return source.select("key", "hash", "text").mapInArrow(deal, "bucket long, key long, text string, tail boolean")


def compare_edited(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike neighbours are.

    Ids are ordered descending, null ids last; rows of one id by a hash of their text.
    """
    dealt = (
        with_next(documents, key, text)
        .repartition("bucket")
        .sortWithinPartitions("bucket", "tail", F.col("key").desc_nulls_last(), F.xxhash64("text"), "text")
    )
    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compare(rows: list[tuple], following: tuple) -> pa.RecordBatch:
        """``rows``: key, text and sketch, neighbours in order; ``following`` comes after the last."""
        edited = [edited_text(a[1], b[1]) for a, b in zip(rows, [*rows[1:], following])]
        new = sketches(edited)
        columns = [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in edited]),
            pa.array([as_text(r[2]) for r in rows]),
            pa.array([as_text(s) for s in new]),
            pa.array([likeness(r[2], s) for r, s in zip(rows, new)], pa.float64()),
            pa.array([likeness(a[2], b[2]) for a, b in zip(rows, [*rows[1:], following])], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        held: list[tuple] = []  # of one bucket, in order
        current, closed = None, False
        for batch in batches:
            rows = list(zip(*(column.to_pylist() for column in batch.columns)))
            place = 0
            for part in portions(r[2] for r in rows):
                for (bucket, number, text, tail), sketch in zip(rows[place : place + len(part)], _sketches(part)):
                    if bucket != current:
                        held, current, closed = [], bucket, False
                    if not tail:
                        held.append((number, text, sketch))
                    elif not closed:
                        closed = True
                        if held:
                            yield compare(held, (number, text, sketch))
                        held = []
                place += len(part)
                if len(held) > 1:
                    yield compare(held[:-1], held[-1])
                    held = held[-1:]

    schema = (
        "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return dealt.mapInArrow(run, schema).withColumnRenamed("key", key)
