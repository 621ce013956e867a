"""Mixing sources to target weights by fixed-length blocks.

The words of a source, document after document, are packed into blocks of ``block_words`` words.  The
mix is a row of shards of ``shard_slots`` block slots.  Each shard draws how many slots every source
gets: multinomial counts, conditioned on the totals that the targets set, which is the multivariate
hypergeometric law.  A shard finds its draws alone: the shards form a binary tree, and each node
splits its parent's counts by a generator seeded with the node, so nothing is passed between tasks.
Slot j of a source maps to pass j // n and, by a pseudorandom permutation of the n blocks keyed by
source and pass, to a block.  Blocks and slots are joined by (source, block).

Targets: sources weigh 3, 1, 2, repeating in code-point order, null last, and share 150% of all words;
none gets more than twice its size, the excess is shared again by weight.  A source has at most two
passes of each block, so no document is taken more than twice.

The driver holds one row for each source (as many as there are weights), nothing that grows with the
documents.  Positions of documents in their source are prefix sums in three levels over hashed buckets of
about ``BUCKET_ROWS`` different rows, so neither a source nor an id with a third of all rows is one task;
equal rows are counted before they are dealt and placed one behind the other.

Null texts have no words; rows without words are taken 0 times.  Null keys and repeated rows are rows
like others.  Key, text and source are read by name, so further columns and their names don't matter.  An empty
table gives an empty mix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MOST_PASSES = 2
BLOCK_WORDS = 64
SHARD_SLOTS = 16384
BUCKET_ROWS = 512
RUN_BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Share:
    """A source's part of the mix: blocks it has, target in words, slots it gets."""

    source: str | None
    size: int
    blocks: int
    target: float
    slots: int


def share_out(sizes: dict[str | None, int], weights=WEIGHTS, total_share=TOTAL_SHARE) -> dict[str | None, float]:
    """Target words of every source: by weight, at most ``MOST_PASSES`` times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    limit = {s: float(MOST_PASSES * sizes[s]) for s in order}
    target, open_ones, rest = {}, list(order), total_share * sum(sizes.values())
    while open_ones:
        unit = rest / sum(weight[s] for s in open_ones)
        full = [s for s in open_ones if unit * weight[s] > limit[s]]
        if not full:
            target |= {s: unit * weight[s] for s in open_ones}
            break
        for s in full:
            target[s] = limit[s]
            rest -= limit[s]
        open_ones = [s for s in open_ones if s not in target]
    return target


def _shares(sized: DataFrame, block_words: int) -> list[Share]:
    sizes = {r.source: r.size for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    target = share_out(sizes)
    out = []
    for source in sorted(sizes, key=lambda s: (s is None, s or "")):
        size, blocks = sizes[source], -(-sizes[source] // block_words)
        slots = min(MOST_PASSES * blocks, round(target[source] * blocks / size)) if size else 0
        out.append(Share(source, size, blocks, target[source], slots))
    return out


def _log_growth(z: int, d: int) -> float:
    """Logarithm of (z + d)! / z!, free of the cancellation that two logarithms of factorials have."""
    if min(z, z + d) < 64:
        return math.lgamma(z + d + 1) - math.lgamma(z + 1)
    a, b = z + 1.0, z + d + 1.0
    tail = (1 / b - 1 / a) / 12 - (1 / b**3 - 1 / a**3) / 360
    return (a - 0.5) * math.log1p(d / a) + d * math.log(b) - d + tail


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` items taken without replacement are good; exact for counts of any size.

    Ratio of uniforms with Stadlober's hat; probabilities are taken relative to the mode's.
    """
    low, high, total = max(0, draws - bad), min(good, draws), good + bad
    if low == high:
        return low
    mean = draws * (good / total)
    spread = math.sqrt(mean * (bad / total) * ((total - draws) / (total - 1)) + 0.5)
    mode = (draws + 1) * (good + 1) // (total + 2)
    # 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e).
    width = 1.7155277699214135 * spread + 0.8989161620588988
    while True:
        u, v = rng.random(), rng.random()
        if not u:
            continue
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if not low <= k <= high:
            continue
        d = k - mode
        share = -(_log_growth(mode, d) + _log_growth(good - mode, -d) + _log_growth(draws - mode, -d) + _log_growth(bad - draws + mode, d))
        if 2 * math.log(u) <= share:
            return k


def split_counts(counts: np.ndarray, draws: int, seed: list[int]) -> np.ndarray:
    """How ``draws`` slots, drawn without replacement, divide over sources that have ``counts`` slots."""
    rng, rest = np.random.default_rng(seed), int(counts.sum())
    taken = np.zeros_like(counts)
    for k, count in enumerate(counts.tolist()):
        rest -= count
        taken[k] = hypergeometric(rng, count, rest, draws)
        draws -= int(taken[k])
    return taken


def draw_shard(totals: np.ndarray, shard: int, shard_slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First slot and number of slots of every source in a shard."""
    first, last = 0, -(-int(totals.sum()) // shard_slots)
    start, counts = np.zeros_like(totals), totals
    while last - first > 1:
        middle = (first + last) // 2
        left = split_counts(counts, (middle - first) * shard_slots, [seed, first, last])
        if shard < middle:
            last, counts = middle, left
        else:
            first, start, counts = middle, start + left, counts - left
    return start, counts


def permute(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Images under a pseudorandom permutation of 0 .. size - 1: a keyed Feistel network, walked into range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    rounds = np.random.default_rng(key).integers(1, 1 << 63, size=(4, 2), dtype=np.uint64) | np.uint64(1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for a, b in rounds:
            mixed = (right + b) * a
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        return left << np.uint64(half) | right

    out = once(index.astype(np.uint64))
    outside = np.flatnonzero(out >= size)
    while len(outside):
        out[outside] = once(out[outside])
        outside = outside[out[outside] >= size]
    return out.astype(np.int64)


def slots(df_range: DataFrame, shares: list[Share], shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """Every slot of the shards in ``df_range`` (column id): shard, source number, pass and block."""
    totals = np.array([s.slots for s in shares], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                start, counts = draw_shard(totals, shard, shard_slots, seed)
                for k in np.flatnonzero(counts):
                    slot = np.arange(start[k], start[k] + counts[k])
                    turn, index = slot // shares[k].blocks, slot % shares[k].blocks
                    block = np.empty_like(slot)
                    for t in np.unique(turn):
                        own = turn == t
                        block[own] = permute(index[own], shares[k].blocks, [seed, int(k), int(t)])
                    columns = [np.full_like(slot, shard), np.full(len(slot), k, dtype=np.int32), turn.astype(np.int32), block]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shard", "part", "turn", "block"])

    return df_range.mapInArrow(run, "shard long, part int, turn int, block long")


@dataclass
class Mix:
    """``rows`` (key, source, size, part, start: place of the row's first word in its source), the shares,
    and ``slots``."""

    rows: DataFrame
    shares: list[Share]
    slots: DataFrame
    block_words: int

    def pieces(self) -> DataFrame:
        """The words of every row that fall in one block: key, part, block, skip (words before), words."""
        b = self.block_words
        blocks = F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))
        first = F.greatest(F.col("start"), F.col("block") * b)
        last = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
        return (
            self.rows.where("size > 0")
            .withColumn("block", F.explode(blocks))
            .select("key", "part", "start", "block", (first - F.col("start")).alias("skip"), (last - first).alias("words"))
        )

    def taken_pieces(self) -> DataFrame:
        """One row for each piece and slot that takes it."""
        return self.pieces().join(self.slots, ["part", "block"])

    def taken(self) -> DataFrame:
        """key, source, size, source_size, target, taken of every row."""
        times = self.slots.groupBy("part", "block").agg(F.count("*").alias("times"))
        # part and start name a row with words
        sums = (
            self.pieces()
            .join(times, ["part", "block"])
            .groupBy("part", "start")
            .agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        )
        known = self.rows.sparkSession.createDataFrame(
            [(k, s.size, s.target) for k, s in enumerate(self.shares)], "part int, source_size long, target double"
        )
        with_words = self.rows.where("size > 0").join(sums, ["part", "start"], "left")
        without = self.rows.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
        return (
            with_words.unionByName(without)
            .join(known, "part")
            .select("key", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
        )


def bucket_offsets(rows: DataFrame) -> DataFrame:
    """Words of a part in the buckets before each: prefix sums over runs of ``RUN_BUCKETS`` buckets, and inside them."""
    totals = rows.groupBy("part", "bucket").agg(F.sum("words").alias("total")).withColumn("run", F.floor(F.col("bucket") / RUN_BUCKETS))
    before = lambda *keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    runs = totals.groupBy("part", "run").agg(F.sum("total").alias("sum"))
    runs = runs.select("part", "run", F.coalesce(F.sum("sum").over(before("part", by="run")), none).alias("run_offset"))
    inside = F.coalesce(F.sum("total").over(before("part", "run", by="bucket")), none)
    return totals.withColumn("inside", inside).join(runs, ["part", "run"]).select("part", "bucket", (F.col("run_offset") + F.col("inside")).alias("offset"))


def mix(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = 0,
) -> Mix:
    """Plans the mix of all rows; the texts are read once and only counted."""
    spark = documents.sparkSession
    # Rows equal in key, source, size and text are counted once, so that no bucket below holds many.
    sized = documents.select(
        F.col(key).alias("key"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"),
        F.xxhash64(F.col(text)).alias("hash"),
    )
    sized = materialize(sized.groupBy("key", "source", "size", "hash").agg(F.count("*").alias("copies")), "mix-sizes")
    shares = _shares(sized.select("source", (F.col("size") * F.col("copies")).alias("size")), block_words)
    numbers = spark.createDataFrame([(s.source, k) for k, s in enumerate(shares)], "name string, part int")
    count = sized.count()
    bucket = F.pmod(F.xxhash64(F.lit(seed), "key", "size", "hash"), F.lit(-(-count // BUCKET_ROWS) or 1))
    rows = sized.join(numbers, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    rows = rows.withColumns({"bucket": bucket, "words": F.col("size") * F.col("copies")})
    offsets = bucket_offsets(rows)
    inside = Window.partitionBy("part", "bucket").orderBy("key", "size", "hash").rowsBetween(Window.unboundedPreceding, -1)
    some = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / BUCKET_ROWS)))
    each = F.explode(
        F.sequence(F.col("some") * BUCKET_ROWS, F.least(F.col("copies"), (F.col("some") + 1) * BUCKET_ROWS) - 1)
    )
    placed = (
        rows.withColumn("before", F.coalesce(F.sum("words").over(inside), F.lit(0)))
        .join(offsets, ["part", "bucket"])
        .withColumn("some", some)
        .repartition("part", "bucket", "some")
        .withColumn("copy", each)
        .select("key", "source", "size", "part", (F.col("offset") + F.col("before") + F.col("copy") * F.col("size")).alias("start"))
    )
    shards = math.ceil(sum(s.slots for s in shares) / shard_slots)
    parts = max(1, min(shards, spark.sparkContext.defaultParallelism * 4, shards))
    drawn = slots(spark.range(0, shards, 1, parts), shares, shard_slots, seed)
    return Mix(materialize(placed, "mix-rows"), shares, materialize(drawn, "mix-slots"), block_words)


def mixed_texts(documents: DataFrame, text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The mix as rows: for each document and pass the words taken, in their order, with the white space
    that stands around them; other columns are those of the document.  Nothing taken, no row."""
    # Written once with a number for each row; the document's own columns travel in one struct.
    rows = materialize(
        documents.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_row")), "mix-documents"
    ).withColumns({"_text": F.col("_doc")[text], "_source": F.col("_doc")[source]})
    plan = mix(rows, "_row", "_text", "_source", **settings)
    # For each row and pass a flag for every block from the row's first to its last one that is taken, so
    # that each word looks up its own block.
    taken = (
        plan.taken_pieces()
        .groupBy(F.col("key").alias("_row"), "turn")
        .agg(F.first("start").alias("_start"), F.sort_array(F.collect_list("block")).alias("_blocks"))
        .withColumn("_first", F.floor(F.col("_start") / plan.block_words))
        .select(
            "_row",
            (F.col("_start") - F.col("_first") * plan.block_words).alias("_skip"),
            # From one taken block to the next: those between are not, it is.
            F.flatten(
                F.zip_with(
                    "_blocks",
                    F.concat(F.array(F.col("_first") - 1), "_blocks"),
                    lambda block, last: F.when(
                        block.isNotNull(), F.concat(F.array_repeat(F.lit(False), (block - last - 1).cast("int")), F.array(F.lit(True)))
                    ).otherwise(F.array().cast("array<boolean>")),
                )
            ).alias("_flags"),
        )
    )
    space = r"[\x20\x09-\x0D]"
    words = F.regexp_extract_all("_text", F.lit(rf"(?:\A{space}*)?{WORD}{space}*"), F.lit(0))
    kept = F.filter(
        words, lambda word, k: F.get("_flags", F.floor((F.col("_skip") + k) / plan.block_words).cast("int"))
    )
    joined = F.concat_ws("", kept)
    return (
        rows.select("_doc", "_row", "_text")
        .join(taken, "_row")
        .select(*(joined.alias(c) if c == text else F.col("_doc")[c].alias(c) for c in documents.columns))
    )
