"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside cells.

Centroids are fitted on a sample of ``sample_rows`` vectors.  A vector's home is the cell of its most
similar centroid.  No pair is lost at a border: two vectors at the threshold are a chord t apart, so a
partner of x at home in d needs x.c - x.d <= t |c - d| for x's own centroid c.  x visits every cell that
this bound allows (``reach`` 1; less looks less far and may lose pairs), but only cells numbered below
its home, so each pair meets once.  Cells are split into blocks of about ``block_rows`` rows, and each
pair of blocks is a task of its own: no cell, however hot, is one task.  Inside a task two blocks are
compared by matrix products in double precision; two balls that lie wholly inside the threshold are
linked, and two wholly outside are passed, without products.

A task returns counts of links and a spanning star of each local component, not the pairs.  The
representative of a group is the smallest id of its component.

Only vectors of one label, not null, and of one length are compared; each length has centroids of its
own.  Vectors that are null, zero or hold null or non-finite components link with nothing.
Repeated ids are rows of their own.  A component's id is the smallest id in it, null only if all are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import components

THRESHOLD = 0.93
CELL_ROWS = 4096
BLOCK_ROWS = 2048
SAMPLE_ROWS = 8192
MOST_CELLS = 1024


def fit_centroids(sample: np.ndarray, cells: int, passes: int = 8, seed: int = 0) -> np.ndarray:
    """Spherical k-means of unit vectors; centroids are unit vectors."""
    rng = np.random.default_rng(seed)
    cells = min(cells, len(sample))
    centroids = sample[rng.choice(len(sample), cells, replace=False)].copy()
    for _ in range(passes):
        home = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, sample)
        norm = np.linalg.norm(sums, axis=1)
        full = norm > 0
        centroids[full] = sums[full] / norm[full, None]
    return centroids


def _unit_rows(column: pa.Array) -> list[np.ndarray | None]:
    out = []
    for values in column.to_pylist():
        vector = None
        if values and None not in values:
            raw = np.asarray(values, dtype=np.float64)
            with np.errstate(over="ignore"):
                norm = math.sqrt(float(raw @ raw)) if np.isfinite(raw).all() else 0.0
            if not 1e-150 < norm < 1e150 and np.isfinite(raw).all() and raw.any():
                raw = raw / np.abs(raw).max()  # squares of the components leave the range
                norm = math.sqrt(float(raw @ raw))
            if norm > 0:
                vector = raw / norm
        out.append(vector)
    return out


def unit_vectors(table: DataFrame, key: str, embedding: str, label: str) -> DataFrame:
    """row (a number of its own), key, label and unit (binary, null where nothing can be compared)."""
    source = table.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(label).alias("label"), F.col(embedding)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [None if v is None else v.tobytes() for v in _unit_rows(batch.column(3))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(units, pa.binary())], ["row", "key", "label", "unit"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    return source.mapInArrow(run, f"row long, key {kinds['key']}, label {kinds['label']}, unit binary")


def assign(units: DataFrame, centroids: dict[int, np.ndarray], threshold: float, reach: float) -> DataFrame:
    """Each vector at home (visit false) and as a visitor of every other cell it must be compared in.

    ``centroids``: those of every length in bytes of a unit vector.
    """
    chord = math.sqrt(2 * (1 - threshold)) * reach
    # Chords between unit vectors from their products, a little too long rather than too short.
    apart = {size: np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0) + 1e-12) * chord + 1e-9 for size, c in centroids.items()}
    lower = {size: np.tril(np.ones(a.shape, dtype=bool), -1) for size, a in apart.items()}
    kind = units.schema["label"].dataType.simpleString()

    def of_length(size: int, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vectors = np.stack([np.frombuffer(u, dtype=np.float64) for u in units])
        dots = vectors @ centroids[size].T
        home = np.argmax(dots, axis=1)
        own = dots[np.arange(len(home)), home]
        row, cell = np.nonzero(lower[size][home] & (own[:, None] - dots <= apart[size][home]))
        return home, row, cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = batch.column(2).to_pylist()
            sizes = np.array([len(u) for u in units], dtype=np.int32)
            takes, cells, visits = [], [], []
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                home, row, cell = of_length(size, [units[k] for k in at])
                takes += [at, at[row]]
                cells += [home, cell]
                visits += [np.zeros(len(home), dtype=bool), np.ones(len(row), dtype=bool)]
            take, lengths = np.concatenate(takes), pa.array(sizes[np.concatenate(takes)])
            take, cells, visit = pa.array(take), pa.array(np.concatenate(cells).astype(np.int32)), pa.array(np.concatenate(visits))
            for start in range(0, len(take), 10_000):
                part = take.slice(start, 10_000)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(part) for i in range(3)), *(c.slice(start, 10_000) for c in (lengths, cells, visit))],
                    ["row", "label", "unit", "size", "cell", "visit"],
                )

    return units.select("row", "label", "unit").mapInArrow(
        run, f"row long, label {kind}, unit binary, size int, cell int, visit boolean"
    )


def deal_blocks(assigned: DataFrame, block_rows: int) -> DataFrame:
    """Every vector once for each task, a pair of blocks (a, b), it takes part in; b holds vectors at home."""
    counts = (
        assigned.groupBy("label", "size", "cell")
        .agg(F.sum((~F.col("visit")).cast("long")).alias("homes"), F.sum(F.col("visit").cast("long")).alias("visits"))
        .select(
            "label", "size", "cell",
            F.greatest(F.lit(1), F.ceil(F.col("homes") / block_rows)).cast("int").alias("home_blocks"),
            F.ceil(F.col("visits") / block_rows).cast("int").alias("visit_blocks"),
        )
    )
    dealt = assigned.join(counts, ["label", "size", "cell"]).withColumn(
        "block", F.pmod(F.xxhash64("row"), F.when(F.col("visit"), F.col("visit_blocks")).otherwise(F.col("home_blocks")))
    )
    block, homes, visits = F.col("block").cast("int"), F.col("home_blocks"), F.col("visit_blocks")

    def pairs(count, make):
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), make)).otherwise(F.array().cast("array<struct<a:int,b:int,v:boolean>>"))

    def task(a, b, visit):
        return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(visit).alias("v"))

    as_visitor = pairs(homes, lambda i: task(block, i, True))
    at_home = F.concat(
        pairs(homes, lambda i: task(F.least(block, i), F.greatest(block, i), False)),
        pairs(visits, lambda i: task(i, block, True)),
    )
    return dealt.select(
        "row", "label", "size", "cell", "unit", "visit", "block", F.explode(F.when(F.col("visit"), as_visitor).otherwise(at_home)).alias("t")
    ).select("row", "label", "size", "cell", "unit", "visit", "block", "t.a", "t.b", "t.v")


def _ball(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre and angular radius."""
    centre = vectors.sum(axis=0)
    norm = np.linalg.norm(centre)
    if norm < 1e-9:
        return vectors[0], math.pi
    centre = centre / norm
    return centre, float(np.arccos(np.clip((vectors @ centre).min(), -1, 1)))


def linked(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each left and right vector, and for each left vector's links the first and all (i, j) that
    span them: pairs of positions whose graph has the same components as all links."""
    angle = math.acos(threshold)
    (c, r), (d, s) = _ball(left), _ball(right)
    between = math.acos(float(np.clip(c @ d, -1, 1)))
    counts_left, counts_right = np.zeros(len(left), dtype=np.int64), np.zeros(len(right), dtype=np.int64)
    if between - r - s > angle + 1e-6:
        return counts_left, counts_right, np.zeros((0, 2), dtype=np.int64)
    if between + r + s < angle - 1e-6:
        counts_left += len(right)
        counts_right += len(left)
        edges = np.concatenate(
            [np.stack([np.arange(len(left)), np.zeros(len(left), dtype=np.int64)], 1), np.stack([np.zeros(len(right), dtype=np.int64), np.arange(len(right))], 1)]
        )
        return counts_left, counts_right, edges
    found = []
    for start in range(0, len(left), 512):
        hit = left[start : start + 512] @ right.T >= threshold
        counts_left[start : start + 512] = hit.sum(axis=1)
        counts_right += hit.sum(axis=0)
        i, j = np.nonzero(hit)
        if len(i):
            found.append(_forest(i + start, j, len(left), len(right)))
    return counts_left, counts_right, np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)


def _forest(i: np.ndarray, j: np.ndarray, lefts: int, rights: int) -> np.ndarray:
    """Some of the pairs (i, j) that connect what all of them connect."""
    parent = list(range(lefts + rights))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = root(a), root(lefts + b)
        if x != y:
            parent[y] = x
            kept.append((a, b))
    return np.array(kept, dtype=np.int64).reshape(-1, 2)


def _compare(threshold: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        between = bool(frame["v"].iloc[0])
        b = frame["b"].iloc[0]
        second = ((~frame["visit"]) & (frame["block"] == b)).to_numpy()
        same = not between and frame["a"].iloc[0] == b
        rows = frame["row"].to_numpy()
        vectors = np.stack([np.frombuffer(u, dtype=np.float64) for u in frame["unit"]])
        if same:
            order = np.argsort(rows, kind="stable")
            rows, vectors = rows[order], vectors[order]
            left, right, pairs = linked(vectors, vectors, threshold)
            counts = left - 1  # each vector meets itself
            ends = rows[pairs]
        else:
            first = ~second
            if not first.any() or not second.any():
                return pd.DataFrame({"row": [], "links": [], "other": []}).astype("int64")
            left, right, pairs = linked(vectors[first], vectors[second], threshold)
            rows = np.concatenate([rows[first], rows[second]])
            counts = np.concatenate([left, right])
            pairs = pairs + np.array([0, first.sum()])
            ends = rows[pairs]
        some = counts > 0
        ends = ends[ends[:, 0] != ends[:, 1]]
        return pd.DataFrame(
            {
                "row": np.concatenate([rows[some], ends[:, 0]]),
                "links": np.concatenate([counts[some], np.zeros(len(ends), dtype=np.int64)]),
                "other": np.concatenate([rows[some], ends[:, 1]]),
            }
        )

    return run


def length_centroids(usable: DataFrame, cell_rows: int, sample_rows: int) -> dict[int, np.ndarray]:
    """Centroids of every length, fitted on ``sample_rows`` vectors expected of it."""
    counts = usable.groupBy(F.length("unit").alias("size"), "label").count().groupBy("size")
    lengths = counts.agg(F.sum("count").alias("rows"), F.max("count").alias("largest")).collect()
    cells = {r.size: min(MOST_CELLS, max(1, -(-r.largest // cell_rows))) for r in lengths}
    million = 1_000_000
    shares = {r.size: min(million, -(-sample_rows * million // r.rows)) for r in lengths if cells[r.size] > 1}
    samples: dict[int, list] = {size: [] for size in shares}
    if shares:
        share = F.element_at(F.create_map(*(F.lit(x) for pair in shares.items() for x in pair)), F.length("unit"))
        drawn = usable.where(F.pmod(F.xxhash64(F.lit("cells"), "row"), F.lit(million)) < share).select("row", "unit")
        for r in drawn.collect():
            samples[len(r.unit)].append((r.row, bytes(r.unit)))
    found = {}
    for size, count in cells.items():
        if samples.get(size):
            found[size] = fit_centroids(np.stack([np.frombuffer(u, dtype=np.float64) for _, u in sorted(samples[size])]), count)
        else:
            found[size] = np.full((1, size // 8), 1 / math.sqrt(size // 8))
    return found


def near_duplicates(
    table: DataFrame,
    key: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    reach: float = 1.0,
    cell_rows: int = CELL_ROWS,
    block_rows: int = BLOCK_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Key, ``n_links``, ``component_id`` and ``kept`` of every row."""
    units = materialize(unit_vectors(table, key, embedding, label), "vectors")
    usable = units.where("unit is not null and label is not null")
    centroids = length_centroids(usable, cell_rows, sample_rows)
    tasks = deal_blocks(assign(usable, centroids, threshold, reach), block_rows)
    found = materialize(
        tasks.groupBy("label", "size", "cell", "v", "a", "b").applyInPandas(_compare(threshold), "row long, links long, other long"),
        "vector-links",
    )
    links = found.groupBy("row").agg(F.sum("links").alias("n_links"))
    roots = components(found.where("row <> other").select(F.col("row").alias("u"), F.col("other").alias("v")), "vector-components")
    labelled = (
        units.select("row", "key")
        .join(links, "row", "left")
        .join(roots.withColumnRenamed("u", "row"), "row", "left")
        .withColumn("root", F.coalesce("root", "row"))
    )
    smallest = labelled.groupBy("root").agg(F.min("key").alias("component_id"))
    return labelled.join(smallest, "root").select(
        F.col("key").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "component_id",
        F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
