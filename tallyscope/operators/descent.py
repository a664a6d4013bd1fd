"""Fitting linear heads by gradient passes over stored features.

The loss is the class-weighted cross-entropy with label smoothing: a record of class y asks
for class c with weight w_y (1 - s) if c = y, plus w_c s / K. No record is copied for that: its
gradient is (mass * p - weights) x, summed on the executors. One pass over the features serves
all heads of a grid at once and brings back K x (D + 1) numbers a head, whatever the rows; steps
are chosen on the driver from these sums alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MEMORY = 10


class Descent:
    """Quasi-Newton descent of one convex loss: evaluate at ``ask``, then ``tell`` what was found."""

    def __init__(self, size: int, tolerance: float):
        self.ask = np.zeros(size)
        self.tolerance = tolerance
        self.at: np.ndarray | None = None
        self.loss, self.grad = np.inf, np.zeros(size)
        self.step, self.direction = 0.0, np.zeros(size)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.done = False

    def _scaled(self, grad: np.ndarray) -> np.ndarray:
        """The gradient times the inverse curvature that the remembered pairs tell of."""
        out, taken = grad.copy(), []
        for s, y in reversed(self.pairs):
            a = s @ out / (s @ y)
            out -= a * y
            taken.append(a)
        if self.pairs:
            s, y = self.pairs[-1]
            out *= (s @ y) / (y @ y)
        for (s, y), a in zip(self.pairs, reversed(taken), strict=True):
            out += (a - y @ out / (s @ y)) * s
        return out

    def tell(self, loss: float, grad: np.ndarray) -> None:
        if self.done:
            return
        if self.at is None or loss <= self.loss + 1e-4 * self.step * (self.direction @ self.grad):
            if self.at is not None:
                s, y = self.ask - self.at, grad - self.grad
                if s @ y > 1e-12:
                    self.pairs = [*self.pairs[1 - MEMORY :], (s, y)]
            self.at, self.loss, self.grad = self.ask, loss, grad
            norm = float(np.linalg.norm(grad))
            self.direction = -self._scaled(grad)
            self.step = 1.0 if self.pairs else 1.0 / max(norm, 1.0)
            self.done = norm < self.tolerance
        else:
            self.step /= 2
            # Steps that no longer change the head: rounding has been reached.
            self.done = self.step < 1e-12
        self.ask = self.at if self.done else self.at + self.step * self.direction


def _partial_sums(heads: np.ndarray, weights: np.ndarray, smoothing: float):
    """One row per task and head: mass, loss and gradient summed over the task's records."""
    grid, classes, width = heads.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((grid, 2 + classes * width))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            target = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.ones((n, width))
            x[:, :-1] = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            asked = np.tile(weights * (smoothing / classes), (n, 1))
            asked[np.arange(n), target] += weights[target] * (1.0 - smoothing)
            mass = asked.sum(axis=1)
            for h in range(grid):
                z = x @ heads[h].T
                top = z.max(axis=1, keepdims=True)
                e = np.exp(z - top)
                total = e.sum(axis=1, keepdims=True)
                sums[h, 0] += mass.sum()
                sums[h, 1] += mass @ (np.log(total) + top)[:, 0] - (asked * z).sum()
                sums[h, 2:] += ((mass[:, None] * (e / total) - asked).T @ x).ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(grid), pa.int32()), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["head", "sums"]
        )

    return run


def smoothed_loss(
    features: DataFrame, heads: np.ndarray, weights: Sequence[float], smoothing: float
) -> tuple[np.ndarray, np.ndarray, float]:
    """(loss per head, gradient per head, mass): means over the records' mass, in one pass.

    features: v array<double>, target. heads: grid x classes x (dimensions + 1), the bias last.
    Rows without a vector or a target don't count; without rows all is zero.
    """
    grid, classes, width = heads.shape
    rows = features.filter("v IS NOT NULL AND target IS NOT NULL").select(F.col("target").cast("long").alias("target"), "v")
    partial = rows.mapInArrow(_partial_sums(heads, np.asarray(weights, dtype=float), smoothing), "head int, sums array<double>")
    found = partial.select("head", F.posexplode("sums").alias("at", "x")).groupBy("head", "at").agg(F.sum("x").alias("x")).collect()
    sums = np.zeros((grid, 2 + classes * width))
    for head, at, x in found:
        sums[head, at] = x
    mass = float(sums[0, 0])
    sums[:, 1:] /= mass or 1.0
    return sums[:, 1], sums[:, 2:].reshape(heads.shape), mass


def fit_heads(
    features: DataFrame, weights: Sequence[float], penalties: Sequence[float], smoothing: float = 0.05,
    tolerance: float = 1e-4, passes: int = 100,
) -> tuple[np.ndarray, np.ndarray]:
    """(heads, gradient norms): for each penalty the head that minimises the smoothed loss plus
    penalty / 2 times its squared weights (biases are free), found in lockstep.

    Stops when every norm is below ``tolerance`` or after ``passes`` passes. Features without a
    row give heads of zeros.
    """
    first = features.filter("v IS NOT NULL").select(F.size("v")).first()
    classes, width = len(weights), (first[0] if first else 0) + 1
    free = np.ones((classes, width))
    free[:, -1] = 0.0
    descents = [Descent(classes * width, tolerance) for _ in penalties]
    for _ in range(passes):
        heads = np.stack([d.ask.reshape(classes, width) for d in descents])
        losses, grads, _mass = smoothed_loss(features, heads, weights, smoothing)
        for d, head, loss, grad, penalty in zip(descents, heads, losses, grads, penalties, strict=True):
            kept = head * free
            d.tell(float(loss + penalty / 2 * (kept * kept).sum()), (grad + penalty * kept).ravel())
        if all(d.done for d in descents):
            break
    return np.stack([d.at.reshape(classes, width) for d in descents]), np.array([np.linalg.norm(d.grad) for d in descents])
