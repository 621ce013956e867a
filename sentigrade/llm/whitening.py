"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

A component c of a vector becomes the whole number x = floor(1024 c) + 100000.  The matrix X of all rows, centred,
is never formed: a row is (n x - S) / n with exact sums S.

1. One pass yields n, S and the largest entry.
2. Every step of the bidiagonalisation is one pass.  A task multiplies its rows by v, giving its part of u = X v, takes
   off the last step's u, and sends back X' u, u's length and its products with all earlier u.  The earlier u are not stored:
   each is X g for a short vector g that the driver keeps, so a task makes its part again from its rows, and a lost
   executor costs its tasks only.  The driver orthogonalises u against all earlier u and the new v against all earlier v, twice.
3. The small bidiagonal matrix has the singular values of X.  Steps end when the residuals of the wanted
   ones vanish, or when there is no direction left.  A start vector may miss copies of an equal singular value, so
   the process is started again in the complement of what it has found until nothing there is larger.
4. Two more passes: the covariance of the whitened rows, and the result.

Tasks send a few vectors as long as a row; they are added in a few tasks before the driver reads them, in a fixed order.

Rows whose vector is null or holds null or non-finite entries are dropped, and so are those with an entry c for which
1024 c is no long.  Vectors of each length are fitted on their own, as lengths can't be compared; empty ones have no
components.  A component without deviation (also all of a single row or of equal rows) can't be whitened and is left
out.  ``deviation`` is null where it is no long.  Repeated rows and ids are rows of their own.  Only key and vector
are read, so further columns and their names don't matter.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

COMPONENTS = 8
SLOTS = 16
_EXACT = float(1 << 53)
_LONG = 2.0**63
_TINY = 1e-10  # a singular value below this share of the largest is rounding


def whole_numbers(table: DataFrame, key: str, embedding: str) -> DataFrame:
    """key, width and x (binary, longs) of every row that remains."""
    source = table.select(F.col(key).alias("key"), F.col(embedding).cast("array<double>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, widths, found = [], [], []
            for k, vector in enumerate(batch.column(1)):
                values = vector.values
                if values is None or values.null_count:
                    continue
                c = values.to_numpy(zero_copy_only=False).astype(np.float64)
                with np.errstate(over="ignore"):
                    if not (np.abs(c) * 1024 < _LONG - 1e6).all():  # also false where not finite
                        continue
                keep.append(k)
                widths.append(len(c))
                found.append((np.floor(c * 1024).astype(np.int64) + 100_000).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(widths, pa.int32()), pa.array(found, pa.binary())],
                ["key", "width", "x"],
            )

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, width int, x binary")


@dataclass(frozen=True)
class Sums:
    """Rows and exact sums of the vectors of one length."""

    n: int
    total: tuple[int, ...]
    largest: int

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: longs, or Python's integers where longs are too short."""
        if 4 * self.n * self.largest < 1 << 63:
            return self.n * x - np.array(self.total, dtype=np.int64)
        return self.n * x.astype(object) - np.array(self.total, dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.numerators(x) / self.n).astype(np.float64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int64).reshape(len(column), width)


def exact_sums(rows: DataFrame) -> dict[int, Sums]:
    """Of every length, one row of the result each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            widths = batch.column(0).to_numpy()
            for width in np.unique(widths).tolist():
                x = _matrix(batch.column(1).filter(pa.array(widths == width)), width)
                own = found.setdefault(width, [0, np.zeros(width, dtype=object), 0])
                own[0] += len(x)
                own[1] = own[1] + (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
                own[2] = max([own[2], *(abs(int(v)) for v in (x.min(initial=0), x.max(initial=0)))])
        for width, (n, total, largest) in found.items():
            made = [[width], [n], [[str(v) for v in total]], [str(largest)]]
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(made, kinds)], ["width", "n", "total", "largest"])

    parts = rows.select("width", "x").mapInArrow(run, "width int, n long, total array<string>, largest string")
    one = parts.withColumn("total", F.transform("total", lambda v: v.cast("decimal(38,0)")))
    places = one.select("width", "n", F.col("largest").cast("decimal(38,0)").alias("largest"), F.posexplode_outer("total"))
    sums = places.groupBy("width", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("col"), F.max("largest").alias("largest"))
    listed = sums.groupBy("width").agg(F.max("n").alias("n"), F.max("largest").alias("largest"), F.array_sort(F.collect_list(F.struct("pos", "col"))).alias("total"))
    return {r.width: Sums(r.n, tuple(int(p.col) for p in r.total if p.pos is not None), int(r.largest)) for r in listed.collect()}


def _added(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], size: int, width: int) -> np.ndarray:
    """Sum of ``part`` over blocks of the rows' matrices, added in tasks, then in ``SLOTS`` tasks, then here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                total += part(_matrix(batch.column(0).slice(start, 4096), width))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for sums in batch.column(0).to_pylist():
                total += np.frombuffer(sums)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = rows.select("x").mapInArrow(run, "sums binary").withColumn("task", F.spark_partition_id())
    few = parts.repartition(SLOTS, F.pmod("task", F.lit(SLOTS))).sortWithinPartitions("task").select("sums")
    found = sorted(bytes(r.sums) for r in few.mapInArrow(add, "sums binary").collect())
    return np.sum([np.frombuffer(s) for s in found], axis=0) if found else np.zeros(size)


def step_product(sums: Sums, v: np.ndarray, last: tuple[float, np.ndarray] | None, earlier: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """For rows x: parts of X'w, of w'w and of U'w, with w = X v - beta X g for the last step's (beta, g) and U = X ``earlier``."""

    def part(x: np.ndarray) -> np.ndarray:
        rows = sums.centred(x)
        w = rows @ v
        if last:
            w -= last[0] * (rows @ last[1])
        before = rows @ earlier
        return np.concatenate([rows.T @ w, [w @ w], before.T @ w])

    return part


def _cleared(vector: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``vector`` made orthogonal to the orthonormal ``basis``, twice against rounding."""
    if basis:
        columns = np.stack(basis, 1)
        for _ in range(2):
            vector = vector - columns @ (columns.T @ vector)
    return vector


def bidiagonalise(
    product: Callable[[np.ndarray, tuple[float, np.ndarray] | None, np.ndarray], np.ndarray],
    width: int, known: list[np.ndarray], wanted: int, least: float, seed: int,
) -> tuple[list[tuple[float, np.ndarray]], bool]:
    """The largest singular values, with their right vectors, in the complement of the vectors ``known``.

    ``product(v, last, earlier)`` is the pass over the rows.  Ends early where no value can exceed ``least``.
    Also returned is whether no direction is left.
    """
    rng = np.random.default_rng(seed)
    v = _cleared(rng.standard_normal(width), known)
    v /= np.linalg.norm(v)
    vs: list[np.ndarray] = []  # right vectors
    gs: list[np.ndarray] = []  # left vector k is X gs[k]
    images: list[np.ndarray] = []  # X' of the left vectors
    alphas: list[float] = []
    betas: list[float] = []
    while True:
        vs.append(v)
        last = (betas[-1], gs[-1]) if gs else None
        earlier = np.stack(gs, 1) if gs else np.zeros((width, 0))
        sent = product(v, last, earlier)
        image, square, along = sent[:width], sent[width], sent[width + 1 :]
        g = v - betas[-1] * gs[-1] if gs else v.copy()
        # u = (w - U U'w) / alpha, and the same for its image and its g.
        if gs:
            g = g - earlier @ along
            image = image - np.stack(images, 1) @ along
        alpha = float(np.sqrt(max(square - along @ along, 0.0)))
        largest = max([alpha, *alphas, *betas])
        if alpha <= 1e-14 * largest or largest == 0:
            alphas.append(0.0)
            beta, image = 0.0, np.zeros(width)
        else:
            alphas.append(alpha)
            gs.append(g / alpha)
            images.append(image / alpha)
            rest = _cleared(images[-1] - alpha * v, [*known, *vs])
            beta = float(np.linalg.norm(rest))
        k = len(vs)
        small = np.diag(alphas) + np.diag(betas, 1)
        left, values, right = np.linalg.svd(small)
        residuals = beta * np.abs(left[-1])
        top = min(wanted, k)
        closed = k + len(known) >= width or beta <= 1e-14 * max(alphas) or alphas[-1] == 0
        settled = k >= min(wanted, width - len(known)) and (residuals[:top] <= 1e-15 * values[0]).all()
        below = values[0] + residuals[0] < least and residuals[0] <= 1e-3 * values[0]
        if closed or settled or below:
            found = right[:top] @ np.stack(vs)
            return [(float(s), f) for s, f in zip(values[:top], found)], k + len(known) >= width
        betas.append(beta)
        v = rest / beta


def leading(
    product: Callable[[np.ndarray, tuple[float, np.ndarray] | None, np.ndarray], np.ndarray], width: int, components: int
) -> list[tuple[float, np.ndarray]]:
    """The largest singular values in falling order, equal ones as often as they occur, with their right vectors."""
    found: list[tuple[float, np.ndarray]] = []
    for seed in range(width):
        least = found[components - 1][0] if len(found) >= components else 0.0
        more, whole = bidiagonalise(product, width, [v for _, v in found], components, least, seed)
        new = [m for m in more if m[0] > _TINY * max([m[0], *(s for s, _ in found)])]
        if not new or new[0][0] <= least:
            break
        found = sorted(found + new, key=lambda p: -p[0])
        if whole or len(found) >= width:
            break
    return found[:components]


def fit(rows: DataFrame, width: int, sums: Sums, components: int) -> list[tuple[float, np.ndarray]]:
    """Eigenvalues and unit eigenvectors of the covariance of the rows (key, width, x) of one length."""

    def product(v, last, earlier):
        return _added(rows, step_product(sums, v, last, earlier), width + 1 + earlier.shape[1], width)

    return [(s * s / sums.n, v) for s, v in leading(product, width, min(components, width))]


def whiten(table: DataFrame, key: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Key, component, n, deviation, whitened, explained and identity_error, a row for each vector and component."""
    rows = materialize(whole_numbers(table, key, embedding), "whitening-rows")
    models = {}
    for width, sums in sorted(exact_sums(rows).items()):
        own = rows.where(F.col("width") == width)
        pairs = fit(own, width, sums, components) if width else []
        if not pairs:
            continue
        scaled = np.stack([v / np.sqrt(e) for e, v in pairs], 1)

        def spread(x: np.ndarray, sums=sums, scaled=scaled) -> np.ndarray:
            white = sums.centred(x) @ scaled
            return np.concatenate([(white.T @ white).ravel(), white.sum(axis=0), [np.square(sums.centred(x)).sum()]])

        size = len(pairs)
        sent = _added(own, spread, size * size + size + 1, width) / sums.n
        mean = sent[size * size : -1]
        error = np.abs(sent[: size * size].reshape(size, size) - np.outer(mean, mean) - np.eye(size)).max()
        models[width] = (sums, scaled, np.array([e for e, _ in pairs]) / sent[-1], float(error))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(1).to_numpy()
            for width in np.unique(widths).tolist():
                if width not in models:
                    continue
                sums, scaled, explained, error = models[width]
                part = batch.filter(pa.array(widths == width))
                for start in range(0, part.num_rows, 1024):
                    x = _matrix(part.column(2).slice(start, 1024), width)
                    numerators = sums.numerators(x)
                    squares = [sum(int(v) ** 2 for v in row) for row in numerators]
                    white = (numerators / sums.n).astype(np.float64) @ scaled
                    count, size = white.shape
                    each = np.repeat(np.arange(count), size)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).slice(start, 1024).take(pa.array(each)),
                            pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), count)),
                            pa.array(np.full(count * size, sums.n, dtype=np.int64)),
                            pa.array([s if s < 1 << 63 else None for s in squares], pa.int64()).take(pa.array(each)),
                            pa.array(white.ravel()),
                            pa.array(np.tile(explained, count)),
                            pa.array(np.full(count * size, error)),
                        ],
                        names,
                    )

    names = ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(
        run, f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    return found.withColumnRenamed("key", key)
