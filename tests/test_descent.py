from __future__ import annotations

import numpy as np
import pytest

from tallyscope.operators import heads as H
from tallyscope.operators.descent import fit_heads, smoothed_loss


def plain(x, y, head, weights, smoothing):
    """Loss of all records, one by one."""
    k, loss, mass = len(weights), 0.0, 0.0
    for v, t in zip(x, y, strict=True):
        z = head[:, :-1] @ v + head[:, -1]
        log_p = z - np.log(np.exp(z).sum())
        for c in range(k):
            asked = weights[c] * smoothing / k + (weights[c] * (1 - smoothing) if c == t else 0.0)
            loss -= asked * log_p[c]
            mass += asked
    return loss / mass


@pytest.fixture(scope="module")
def data(spark):
    draw = np.random.default_rng(4)
    y = draw.integers(0, 3, 150)
    x = draw.normal(size=(150, 4)) + np.eye(3, 4)[y]
    rows = [(int(t), v.tolist()) for v, t in zip(x, y, strict=True)] + [(None, [0.0] * 4), (1, None)]
    return x, y, spark.createDataFrame(rows, "target int, v array<double>").repartition(5)


def test_one_pass_gives_loss_and_gradient(data):
    x, y, frame = data
    weights, heads = [0.5, 1.0, 2.0], np.random.default_rng(1).normal(size=(2, 3, 5))
    losses, grads, _mass = smoothed_loss(frame, heads, weights, 0.1)
    for h, head in enumerate(heads):
        assert losses[h] == pytest.approx(plain(x, y, head, weights, 0.1), rel=1e-9)
        for at in ((0, 0), (1, 4), (2, 2)):
            up, down = head.copy(), head.copy()
            up[at] += 1e-5
            down[at] -= 1e-5
            assert grads[h][at] == pytest.approx((plain(x, y, up, weights, 0.1) - plain(x, y, down, weights, 0.1)) / 2e-5, abs=1e-7)


def test_fit_reaches_the_minimum(data):
    x, y, frame = data
    weights, penalties = [0.5, 1.0, 2.0], (0.0001, 0.01)
    heads, norms = fit_heads(frame, weights, penalties, 0.1)
    assert (norms < 1e-4).all()
    draw = np.random.default_rng(2)
    for head, penalty in zip(heads, penalties, strict=True):
        def objective(h):
            return plain(x, y, h, weights, 0.1) + penalty / 2 * (h[:, :-1] ** 2).sum()  # noqa: B023
        assert all(objective(head) <= objective(head + draw.normal(size=head.shape) * 0.05) for _ in range(5))


def test_without_rows_heads_are_zero(data):
    heads, norms = fit_heads(data[2].limit(0), [1.0, 1.0], (0.1,))
    assert not heads.any() and not norms.any()


def test_margin_fits_run_side_by_side_with_the_same_heads(spark, monkeypatch):
    """The one-vs-rest fits overlap and give what they give one after the other."""
    rng = np.random.default_rng(3)
    rows = [(rng.normal(size=4).tolist(), int(rng.integers(0, 3))) for _ in range(90)]
    train = spark.createDataFrame(rows, "v ARRAY<DOUBLE>, target INT").coalesce(1)
    seen = []

    class Watched(H.OneVsRest):
        def fit(self, data):
            seen.append(self.getParallelism())
            return super().fit(data)

    monkeypatch.setattr(H, "OneVsRest", Watched)
    heads = [H.fit_margin_baseline(train, [1.0, 2.0, 1.0]).collect()]
    monkeypatch.setattr(H, "FITS", 1)
    heads.append(H.fit_margin_baseline(train, [1.0, 2.0, 1.0]).collect())
    assert seen[0] > 1 and seen[1] == 1 and heads[0] == heads[1] and len(heads[0]) == 3
