"""Held-out predictions of a logistic model, one refit for each row or fold left out, on the executors.

The training matrix is sent once to every task, under a bound that the caller checks.  A task fits the
model on all rows, then refits it for each of its folds by Newton steps that start from that fit; one row
less moves the optimum little, so a few steps reach it to rounding.  Scaling and the classes that occur
are those of the rows that remain, as if each model had been trained alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

MOST_STEPS = 200
CLOSE = 1e-9  # length of the gradient, of a loss summed over the rows


@dataclass(frozen=True)
class Fit:
    """Classes, scaling, and a row of weights with the level last for each logit.

    Two classes have one logit, that of the second; more have one each.  ``inverse`` is that of the
    curvature at the optimum.
    """

    classes: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    theta: np.ndarray
    inverse: np.ndarray | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        found = _with_level((x - self.mean) / self.scale) @ self.theta.T
        return np.hstack([np.zeros((len(x), 1)), found]) if found.shape[1] == 1 else found

    def predict(self, x: np.ndarray) -> np.ndarray:
        if len(self.classes) == 1:
            return np.full(len(x), self.classes[0])
        return self.classes[np.argmax(self.logits(x), axis=1)]

    def moved_to(self, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """``theta`` for another scaling, with the same predictions."""
        raw = self.theta[:, :-1] / self.scale
        level = self.theta[:, -1] + raw @ (mean - self.mean)
        return np.hstack([raw * scale, level[:, None]])


def _with_level(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def _loss(theta: np.ndarray, x: np.ndarray, hot: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Summed loss with half ``penalty`` times the squared weights, and the probabilities of the logits."""
    z = x @ theta.T
    top = np.maximum(z.max(axis=1), 0.0) if theta.shape[0] == 1 else z.max(axis=1)
    powers = np.exp(z - top[:, None])
    total = powers.sum(axis=1) + (np.exp(-top) if theta.shape[0] == 1 else 0.0)
    loss = (np.log(total) + top - (z * hot).sum(axis=1)).sum() + 0.5 * penalty * np.square(theta[:, :-1]).sum()
    return float(loss), powers / total[:, None]


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, start: Fit | None = None) -> Fit:
    """The penalised optimum on scaled features; the level is not penalised.

    ``y`` holds whole numbers.  ``start`` shortens the way where it knows the same classes: a row less changes
    the curvature little, so steps by that of ``start`` need gradients only, and few of them.
    """
    classes = np.unique(y)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    logits = 1 if len(classes) == 2 else len(classes)
    if start is not None and np.array_equal(start.classes, classes):
        theta = start.moved_to(mean, scale)
    else:
        theta = np.zeros((logits, x.shape[1] + 1))
    if len(classes) == 1:
        return Fit(classes, mean, scale, theta)
    rows = _with_level((x - mean) / scale)
    hot = (y[:, None] == (classes[1:] if logits == 1 else classes)).astype(float)
    width = rows.shape[1]
    weighs = np.append(np.full(width - 1, penalty), 0.0)
    # Levels of more than two classes may all move by one amount; the last one stays where it is.
    free = np.arange(logits * width - (logits > 1))
    loss, p = _loss(theta, rows, hot, penalty)

    def slope_of(p: np.ndarray, theta: np.ndarray) -> np.ndarray:
        return ((p - hot).T @ rows + theta * weighs).ravel()[free]

    def bend_of(p: np.ndarray) -> np.ndarray:
        bend = np.zeros((logits, width, logits, width))
        for a in range(logits):
            for b in range(a, logits):
                part = rows.T @ (rows * (p[:, a] * ((a == b) - p[:, b]))[:, None])
                bend[a, :, b] = bend[b, :, a] = part
            bend[a, np.arange(width), a, np.arange(width)] += weighs
        bend = bend.reshape(logits * width, -1)[np.ix_(free, free)]
        # A level whose class is separated may have no curvature left.
        bend[np.arange(len(free)), np.arange(len(free))] += 1e-12 * max(1.0, bend.diagonal().max())
        return bend

    if start is not None and start.inverse is not None and np.array_equal(start.classes, classes):
        slope = slope_of(p, theta)
        for _ in range(MOST_STEPS):
            size = np.linalg.norm(slope)
            if size <= CLOSE:
                return Fit(classes, mean, scale, theta)
            moved = theta.copy()
            moved.ravel()[free] -= start.inverse @ slope
            new, q = _loss(moved, rows, hot, penalty)
            ahead = slope_of(q, moved)
            if not np.linalg.norm(ahead) < 0.5 * size:
                break
            theta, loss, p, slope = moved, new, q, ahead
    for _ in range(MOST_STEPS):
        slope = slope_of(p, theta)
        if np.linalg.norm(slope) <= CLOSE:
            break
        bend = bend_of(p)
        step = np.zeros(logits * width)
        step[free] = np.linalg.solve(bend, slope)
        step, length = step.reshape(logits, width), 1.0
        while length > 1e-8:
            moved = theta - length * step
            new, q = _loss(moved, rows, hot, penalty)
            if new <= loss - 1e-4 * length * (slope @ step.ravel()[free]) or length * np.abs(step).max() < 1e-9:
                break
            length /= 2
        if new > loss + 1e-9 * abs(loss):
            break
        theta, loss, p = moved, new, q
        if length * np.abs(step).max() < 1e-13:
            break
    return Fit(classes, mean, scale, theta, np.linalg.inv(bend_of(p)))


def refits(x: np.ndarray, y: np.ndarray, fold: np.ndarray, wanted: np.ndarray, penalty: float = 1.0) -> Iterator[tuple[int, Fit]]:
    """For each of the ``wanted`` folds the fit on the rows of all others."""
    start = fit(x, y, penalty)
    for number in wanted.tolist():
        rest = fold != number
        yield number, fit(x[rest], y[rest], penalty, start)
