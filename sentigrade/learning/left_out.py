"""Leave-one-out predictions of a logistic model where refitting for every row would cost the square of the rows.

The model of all rows is fitted by Newton steps whose sums are made on the executors.  A row's own model lies close
to it: a step from there, by the curvature of the whole, gives its logits, and the change of curvature along the step
bounds how far they are from those of the refitted model.  A first bound knows the farthest row only; rows it leaves open
get a second one from sums in which each row counts by its own reach.  Where that leaves the class open, the row's model
is refitted over all rows, many rows to a pass.  So all classes are those of the refits, at a bounded number of passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store
from .held_out import CLOSE, MOST_STEPS, Fit

#: Models that are refitted in one pass, and tasks of a pass; each sends one array of sums to the driver.
REFITS = 256
TASKS = 64
#: Lengths of a step for which the second bound is made.
LENGTHS = (0.02, 0.05, 0.1, 0.2, 0.4)
#: Rounding that a logit may have.
ROUNDING = 1e-7


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 2000):
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            yield x, part.column(1).to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False), part


def _summed(rows: DataFrame, make: Callable, combine: Callable = np.add) -> np.ndarray | None:
    """``make`` of (x, y, number) added up inside tasks, then over tasks."""

    def run(batches):
        total = None
        for x, y, number, _ in _parts(batches):
            found = make(x, y, number)
            total = found if total is None else combine(total, found)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    found = [np.frombuffer(r.sums) for r in rows.select("_x", "_y", "_number").coalesce(TASKS).mapInArrow(run, "sums binary").collect()]
    return combine.reduce(found) if found else None


def _probabilities(z: np.ndarray) -> np.ndarray:
    """Of logits in the last axis; a single one is that of the second class."""
    full = np.concatenate([np.zeros((*z.shape[:-1], 1)), z], axis=-1) if z.shape[-1] == 1 else z
    powers = np.exp(full - full.max(axis=-1, keepdims=True))
    p = powers / powers.sum(axis=-1, keepdims=True)
    return p[..., 1:] if z.shape[-1] == 1 else p


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.hstack([(x - mean) / scale, np.ones((len(x), 1))])


def _hot(y: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return (y[:, None] == (classes[1:] if len(classes) == 2 else classes)).astype(float)


def _curvature(v: np.ndarray, p: np.ndarray, each: np.ndarray | None = None) -> np.ndarray:
    """Summed curvature of the losses of scaled rows, ``each`` times; by logit and column, twice."""
    L, w = p.shape[1], v.shape[1]
    bend = np.zeros((L, w, L, w))
    for a in range(L):
        for b in range(a, L):
            own = p[:, a] * ((a == b) - p[:, b])
            bend[a, :, b] = bend[b, :, a] = v.T @ (v * (own if each is None else own * each)[:, None])
    return bend


class Whole:
    """The fit of all rows, with the sums that single rows are taken from."""

    def __init__(self, rows: DataFrame, d: int, penalty: float = 1.0):
        self.rows, self.penalty = rows, penalty
        counts = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
        self.counts, self.classes = counts, np.array(sorted(counts))
        self.n = sum(counts.values())
        self.mean = _summed(rows, lambda x, y, number: x.sum(axis=0)) / self.n
        mean = self.mean
        self.square = _summed(rows, lambda x, y, number: np.square(x - mean).sum(axis=0))
        spread = np.sqrt(self.square / self.n)
        self.steady = spread <= 1e-12 * (np.abs(mean) + 1e-300)
        self.scale = np.where(self.steady, 1.0, spread)
        self.logits = 1 if len(self.classes) == 2 else len(self.classes)
        self.width = d + 1
        self.free = np.arange(self.logits * self.width - (self.logits > 1))
        self.weighs = np.append(np.full(d, penalty), 0.0)
        self.theta = np.zeros((self.logits, self.width))
        if len(self.classes) > 1:
            self._fit()

    def _sums(self, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, slope and curvature at ``theta``."""
        classes, mean, scale, L, w = self.classes, self.mean, self.scale, self.logits, self.width

        def make(x, y, number):
            v, hot = _scaled(x, mean, scale), _hot(y, classes)
            z = v @ theta.T
            p = _probabilities(z)
            full = np.hstack([np.zeros((len(z), 1)), z]) if L == 1 else z
            top = full.max(axis=1)
            loss = (np.log(np.exp(full - top[:, None]).sum(axis=1)) + top - (z * hot).sum(axis=1)).sum()
            return np.concatenate([[loss], ((p - hot).T @ v).ravel(), _curvature(v, p).ravel()])

        total, size = _summed(self.rows, make), L * w
        loss = total[0] + 0.5 * (theta**2 * self.weighs).sum()
        slope = (total[1 : 1 + size].reshape(L, w) + theta * self.weighs).ravel()[self.free]
        bend = total[1 + size :].reshape(size, size) + np.diag(np.tile(self.weighs, L))
        return loss, slope, bend[np.ix_(self.free, self.free)]

    def _fit(self) -> None:
        loss, slope, bend = self._sums(self.theta)
        for _ in range(MOST_STEPS):
            if np.linalg.norm(slope) <= CLOSE * np.sqrt(self.n):
                break
            step, length = np.zeros(self.theta.size), 1.0
            step[self.free] = np.linalg.solve(bend, slope)
            while True:
                moved = self.theta - length * step.reshape(self.theta.shape)
                new = self._sums(moved)
                if new[0] <= loss + 1e-10 * abs(loss) or length < 1e-8:
                    break
                length /= 2
            small = length * np.abs(step).max() < 1e-11
            self.theta, (loss, slope, bend) = moved, new
            if small:
                break
        self.bend, self.inverse = bend, np.linalg.inv(bend)

    def reach(self, v: np.ndarray) -> np.ndarray:
        """How far each logit of scaled rows moves at most, for a step of length 1 in the curvature.

        More than two classes are told by differences of their logits only, so their mean is taken off.
        """
        L, w = self.logits, self.width
        blocks = np.zeros((L * w, L * w))
        blocks[np.ix_(self.free, self.free)] = self.inverse
        blocks = blocks.reshape(L, w, L, w)
        off = np.eye(L) - (1.0 / L if L > 1 else 0.0)
        blocks = np.einsum("ca,aubw,cb->cuw", off, blocks, off)
        return np.stack([np.sqrt(np.maximum(((v @ blocks[c]) * v).sum(axis=1), 0)) for c in range(L)], axis=1)

    def ratio(self, x: np.ndarray) -> np.ndarray:
        """Squared scale without each row over that of all; 0 where a row alone gives a column its spread."""
        rest = self.square - np.square(x - self.mean) * self.n / (self.n - 1)
        found = rest / (self.n - 1) / np.square(self.scale)
        found = np.where(found < 1e-9, 0.0, found)
        return np.where(self.steady, 1.0, found)


@dataclass(frozen=True)
class Bounds:
    """For each of ``LENGTHS``: sums for the change of the slope along a step no longer, and the share of the curvature that may go.

    The third derivative of a row's loss along a step is at most the range of its logits' moves times the curvature, and
    no logit moves by more than the row's reach r times the length d.  So the slope leaves its linear course by at most
    d sqrt(s'Ks), K being the sum of r^2 exp(4rd) times the row's curvature, and a row keeps exp(-2rd) of its curvature.
    """

    slopes: list[np.ndarray]
    shares: list[float]

    @classmethod
    def of(cls, rows: DataFrame, whole: Whole) -> Bounds:
        """``whole`` without the session's objects."""

        def make(x, y, number):
            v = _scaled(x, whole.mean, whole.scale)
            p, r = _probabilities(v @ whole.theta.T), whole.reach(v).max(axis=1)
            parts = [(r**2 * np.exp(np.minimum(4 * r * d, 500)), -np.expm1(-2 * r * d)) for d in LENGTHS]
            return np.concatenate([_curvature(v, p, each).ravel() for pair in parts for each in pair])

        size = whole.logits * whole.width
        sums = _summed(rows, make).reshape(len(LENGTHS), 2, size, size)[..., whole.free[:, None], whole.free]
        root = np.linalg.inv(np.linalg.cholesky(whole.bend))
        return cls([k for k, _ in sums], [float(np.linalg.eigvalsh(root @ d @ root.T)[-1]) for _, d in sums])


def _own_models(whole: Whole, x: np.ndarray, y: np.ndarray, farthest: float, softest: float, bounds: Bounds | None = None):
    """Class of each row by its own model, and whether the bound proves it."""
    L, w, free, lam = whole.logits, whole.width, whole.free, whole.penalty
    v, hot, ratio = _scaled(x, whole.mean, whole.scale), _hot(y, whole.classes), whole.ratio(x)
    p = _probabilities(v @ whole.theta.T)
    more = np.tile(np.hstack([lam * (ratio - 1.0), np.zeros((len(x), 1))]), (1, L))[:, free]
    slope = ((hot - p)[:, :, None] * v[:, None, :]).reshape(len(x), -1)[:, free] + more * whole.theta.ravel()[free]

    def padded(step):
        return np.hstack([step, np.zeros((len(step), L * w - len(free)))]).reshape(len(step), L, w)

    def bent(step):
        """Curvature of a row's own loss times ``step``."""
        moved = np.einsum("nlw,nw->nl", padded(step), v)
        own = p * (moved - (p * moved).sum(axis=1, keepdims=True))
        return step @ whole.bend - (own[:, :, None] * v[:, None, :]).reshape(len(x), -1)[:, free] + more * step

    step = -slope @ whole.inverse
    for _ in range(2 if bounds is None else 10):
        step = step - (slope + bent(step)) @ whole.inverse
    left = slope + bent(step)
    length_h = np.sqrt(np.maximum(((step @ whole.bend) * step).sum(axis=1), 0))
    left_h = np.sqrt(np.maximum(((left @ whole.inverse) * left).sum(axis=1), 0))
    reach = whole.reach(v)
    share = ((p * (1 - p) if L == 1 else p) * reach**2).sum(axis=1)
    if L > 1:
        # The spread of the logits' moves is at most that around the move of the likeliest class.
        top = p.argmax(axis=1)[:, None]
        beside = p * (reach + np.take_along_axis(reach, top, axis=1)) ** 2
        share = np.minimum(share, beside.sum(axis=1) - np.take_along_axis(beside, top, axis=1)[:, 0])
    share = share + np.abs(more).max(axis=1) / softest
    if bounds is None:
        # No logit of any row moves by more than this; a curvature changes by at most the power of twice as much.
        tau = farthest * length_h + 1e-12
        off = left_h + length_h * (np.expm1(2 * tau) / (2 * tau) - 1)
        held = (1 - share) * np.exp(-2 * (tau + 2 * farthest * off))
    else:
        off, held = np.full(len(x), np.inf), np.zeros(len(x))
        for d, k in zip(LENGTHS, bounds.slopes):
            fits = (length_h <= d) & np.isinf(off)
            off[fits] = left_h[fits] + d * np.sqrt(np.maximum(((step[fits] @ k) * step[fits]).sum(axis=1), 0))
        # Of all models as far as the row's own, which is twice ``off`` from the step at most.
        for d, gone in reversed([*zip(LENGTHS, bounds.shares)]):
            fits = length_h + 2 * off <= d
            held[fits] = 1 - share[fits] - gone
    proven = held >= 0.5
    z = np.einsum("nlw,nw->nl", whole.theta + padded(step), v)
    if L == 1:
        z, reach = np.hstack([np.zeros((len(z), 1)), z]), np.hstack([np.zeros((len(z), 1)), reach])
    best = np.argmax(z, axis=1)
    at = np.arange(len(z))
    off[~proven] = 0.0
    gap, doubt = z[at, best][:, None] - z, (off / np.maximum(held, 0.5))[:, None] * (reach[at, best][:, None] + reach) + ROUNDING
    gap[at, best] = np.inf
    return whole.classes[best], proven & (gap > doubt).all(axis=1)


def _special(whole: Whole, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows without which a class or the spread of a column is gone."""
    single = np.array([whole.counts[c] == 1 for c in whole.classes])[np.searchsorted(whole.classes, y)]
    return single | (whole.ratio(x) == 0.0).any(axis=1)


def _refitted(whole: Whole, number: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Classes of a few rows by their own models, refitted side by side by steps of the whole's curvature."""
    L, w, free = whole.logits, whole.width, whole.free
    theta = np.repeat(whole.theta[None], len(number), axis=0)
    weighs = np.concatenate([whole.penalty * whole.ratio(x), np.zeros((len(x), 1))], axis=1)
    classes, mean, scale = whole.classes, whole.mean, whole.scale
    own_v, own_hot = _scaled(x, mean, scale), _hot(y, classes)
    last = np.inf
    for _ in range(MOST_STEPS):
        sent = theta.reshape(-1, w)

        def make(x, y, number):
            total = np.zeros((len(sent) // L, L, w))
            for start in range(0, len(x), 250):
                v = _scaled(x[start : start + 250], mean, scale)
                p = _probabilities((v @ sent.T).reshape(len(v), -1, L))
                total += (p.reshape(len(v), -1).T @ v).reshape(total.shape) - _hot(y[start : start + 250], classes).T @ v
            return total.ravel()

        slope = _summed(whole.rows, make).reshape(theta.shape) + theta * weighs[:, None, :]
        p = _probabilities(np.einsum("nlw,nw->nl", theta, own_v))
        slope -= (p - own_hot)[:, :, None] * own_v[:, None, :]
        flat = slope.reshape(len(theta), -1)[:, free]
        size = np.linalg.norm(flat, axis=1).max()
        if size <= CLOSE * np.sqrt(whole.n) or size > 0.9 * last:
            break
        last = size
        moved = theta.reshape(len(theta), -1)
        moved[:, free] -= flat @ whole.inverse
        theta = moved.reshape(theta.shape)
    if size > 1e-5 * np.sqrt(whole.n):
        return np.array([_alone(whole, k, own) for k, own in zip(number, x)])
    z = np.einsum("nlw,nw->nl", theta, own_v)
    z = np.hstack([np.zeros((len(z), 1)), z]) if L == 1 else z
    return classes[np.argmax(z, axis=1)]


def _alone(whole: Whole, number: int, x: np.ndarray) -> int:
    """Class of one row by a fit of all others from the start."""
    rest = Whole(whole.rows.where(F.col("_number") != int(number)), whole.width - 1, whole.penalty)
    return int(Fit(rest.classes, rest.mean, rest.scale, rest.theta).predict(x[None])[0])


def predictions(rows: DataFrame, d: int) -> DataFrame:
    """_number and class of every row of ``rows`` (_x, _y, _number) by the model of all others."""
    spark, whole = rows.sparkSession, Whole(rows, d)
    schema = "_number bigint, _class int"
    if len(whole.classes) == 1:
        return rows.select("_number", F.lit(int(whole.classes[0])).alias("_class"))
    mean, scale = whole.mean, whole.scale
    softest = float(np.linalg.eigvalsh(whole.bend)[0])
    # Without the session's objects, to be sent to tasks.
    sent = Whole.__new__(Whole)
    sent.__dict__ = {c: v for c, v in whole.__dict__.items() if c != "rows"}
    farthest = float(_summed(rows, lambda x, y, number: np.array([sent.reach(_scaled(x, mean, scale)).max()]), np.maximum)[0])

    columns = ["_number", "_class", "_x", "_y", "_special"]

    def told(source: DataFrame, bounds: Bounds | None = None) -> DataFrame:
        def run(batches):
            for x, y, number, part in _parts(batches, 500):
                found, proven = _own_models(sent, x, y, farthest, softest, bounds)
                special = _special(sent, x, y)
                classes = pa.array(found.astype(np.int32), mask=~proven | special)
                yield pa.RecordBatch.from_arrays([pa.array(number), classes, part.column(0), pa.array(y), pa.array(special)], names=columns)

        made = source.select("_x", "_y", "_number").mapInArrow(run, f"{schema}, _x array<double>, _y int, _special boolean")
        return made.select("_number", "_class", "_special", *(F.when(F.col("_class").isNull(), F.col(c)).alias(c) for c in ("_x", "_y")))

    opened = store(told(rows), "left-out")
    closed = opened().where("_class IS NOT NULL").select("_number", "_class")
    if opened().where("_class IS NULL AND NOT _special").limit(REFITS + 1).count() > REFITS:
        again = opened().where("_class IS NULL")
        opened = store(told(again.repartition(spark.sparkContext.defaultParallelism), Bounds.of(rows, sent)), "left-open")
        closed = closed.unionByName(opened().where("_class IS NOT NULL").select("_number", "_class"))
    # Rows left open are few where there are many rows; they come in portions, so that models of one pass are bounded.
    solved, portion = [], []

    def solve():
        number, x, y = (np.array(v) for v in zip(*portion))
        solved.extend(zip(number.tolist(), _refitted(whole, number, x, y).tolist()))
        portion.clear()

    for r in opened().where("_class IS NULL").toLocalIterator():
        if r["_special"]:
            solved.append((r["_number"], _alone(whole, r["_number"], np.array(r["_x"]))))
            continue
        portion.append((r["_number"], r["_x"], r["_y"]))
        if len(portion) == REFITS:
            solve()
    if portion:
        solve()
    return closed.unionByName(spark.createDataFrame(solved, schema))
