"""Metrics against published counts, hand-made cases and brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyscope.functions import scores as X
from tallyscope.operators import heads as H
from tallyscope.operators import metrics as M
from tallyscope.operators import passes as P
from tallyscope.sources.taxonomy import CLASS_CODES

# ---- fixed values: a published 7x7 confusion matrix and the figures given with it ----
PUBLISHED = [
    [19, 9, 7, 5, 3, 1, 0],
    [11, 40, 7, 6, 4, 0, 1],
    [19, 20, 93, 6, 28, 7, 6],
    [2, 4, 1, 10, 1, 0, 0],
    [11, 10, 19, 9, 91, 14, 10],
    [32, 36, 75, 119, 122, 570, 70],
    [0, 7, 2, 0, 1, 1, 14],
]
PUBLISHED_RECALL = [0.4318, 0.5797, 0.5196, 0.5556, 0.5549, 0.5566, 0.56]
PUBLISHED_PRECISION = [0.2021, 0.3175, 0.4559, 0.0645, 0.364, 0.9612, 0.1386]
PUBLISHED_F1 = [0.2754, 0.4103, 0.4856, 0.1156, 0.4396, 0.705, 0.2222]
PUBLISHED_SPECIFICITY = [0.9493, 0.9409, 0.9174, 0.9037, 0.883, 0.9539, 0.9419]
# ---- end of fixed values ----


@pytest.fixture(scope="module")
def counts(spark):
    cells = [(t, p, n) for t, row in enumerate(PUBLISHED) for p, n in enumerate(row) if n]
    return spark.createDataFrame(cells, "target INT, pred INT, n BIGINT")


def test_published_class_rates(counts):
    rows = sorted(M.per_class(counts).collect(), key=lambda r: r["class_idx"])
    assert [r["recall"] for r in rows] == PUBLISHED_RECALL
    assert [r["precision"] for r in rows] == PUBLISHED_PRECISION
    assert [r["f1"] for r in rows] == PUBLISHED_F1
    assert [r["specificity"] for r in rows] == PUBLISHED_SPECIFICITY
    assert [r["support"] for r in rows] == [44, 69, 179, 18, 164, 1024, 25]


def test_published_summary(counts):
    s = M.summary_from_counts(counts).first()
    assert (s["items"], s["accuracy"], s["balanced_accuracy"], s["macro_f1"], s["weighted_f1"]) == (
        1523, 0.5496, 0.5369, 0.3791, 0.61,
    )


def scored(spark, pairs):
    return spark.createDataFrame(pairs, "item_id INT, target INT, probs ARRAY<DOUBLE>")


def one_hot(i, p=1.0):
    rest = (1.0 - p) / 6
    return [p if k == i else rest for k in range(7)]


def test_entropy_margin_verdict(spark):
    df = scored(spark, [(1, 0, one_hot(0)), (2, 0, [1 / 7] * 7), (3, 0, [0.4, 0.4, 0.2, 0.0, 0.0, 0.0, 0.0])])
    rows = {
        r["item_id"]: r
        for r in df.select("item_id", X.entropy("probs").alias("e"), X.margin("probs").alias("m"),
                           X.top_index("probs").alias("t")).collect()
    }
    assert rows[1]["e"] == pytest.approx(0.0, abs=1e-9) and rows[2]["e"] == pytest.approx(1.0)
    assert rows[3]["m"] == 0.0 and rows[3]["t"] == 0  # lowest index wins the tie
    labels = spark.createDataFrame(
        [(0.95, 0.05, 1.0), (0.65, 0.30, 0.9), (0.30, 0.80, 0.4)], "c DOUBLE, e DOUBLE, a DOUBLE"
    ).select(X.verdict(F.col("c"), F.col("e"), F.col("a")).alias("v"))
    assert [r["v"] for r in labels.collect()] == ["confident", "borderline", "uncertain"]


def test_bins_are_open_below_and_empty_ones_stay(spark):
    edge = M.bin_edges(15)[3]
    confs = spark.createDataFrame([(0.0,), (edge,), (edge + 1e-12,), (1.0,)], "c DOUBLE")
    got = [r["b"] for r in confs.select(M.confidence_bin(F.col("c")).alias("b")).collect()]
    assert got == [None, 2, 3, 14]
    rows = M.calibration(scored(spark, [(1, 0, one_hot(0))])).collect()
    assert len(rows) == 15
    empty = [r for r in rows if r["n"] == 0]
    assert len(empty) == 14 and all(r["accuracy"] is None for r in empty)


def test_thresholds_are_compared_unrounded(spark):
    grid = M.threshold_grid()
    assert len(grid) == 19 and grid[2] == 0.15000000000000002
    probs = one_hot(0)
    probs[4] = 0.15
    row = {r["threshold"]: r for r in M.operating_curve(scored(spark, [(1, 4, probs)])).collect()}
    assert row[0.1]["flagged"] == 1 and row[0.15]["flagged"] == 0


def test_auc_with_ties_and_hot_scores(spark):
    rng = random.Random(5)
    data = []
    for i in range(600):
        t = rng.randrange(7)
        p = [0.0] * 7
        # A third of all rows share one score.
        p[t if rng.random() < 0.5 else rng.randrange(7)] = 0.5 if i % 3 == 0 else rng.choice([1e-9, 0.2, 0.9, rng.random()])
        data.append((i, t, p))
    got = {r["code"]: r["auc"] for r in M.roc_auc(scored(spark, data)).collect()}
    values = []
    for k, code in enumerate(CLASS_CODES):
        pos = [p[k] for _, t, p in data if t == k]
        neg = [p[k] for _, t, p in data if t != k]
        wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
        want = wins / (len(pos) * len(neg))
        assert got[code] == pytest.approx(want, abs=5.1e-5)
        values.append(got[code])
    assert got["macro"] == pytest.approx(sum(values) / 7, abs=5.1e-5)


def test_tiny_scores_spread_over_slices(spark):
    rows = [(10.0 ** -k,) for k in range(1, 320)] + [(0.0,), (1.0,), (1.0 - 1e-16,)]
    cut = spark.createDataFrame(rows, "p DOUBLE").select("p", M._score_slice(F.col("p")).alias("s")).orderBy("p").collect()
    assert [r["s"] for r in cut] == sorted(r["s"] for r in cut)
    assert len({r["s"] for r in cut}) > 315


def test_auc_skips_single_valued_classes(spark):
    got = {r["code"] for r in M.roc_auc(scored(spark, [(1, 0, one_hot(0)), (2, 1, one_hot(1))])).collect()}
    assert got == {"akiec", "bcc", "macro"}


def test_gates_skip_absent_classes(spark):
    df = scored(spark, [(i, i % 2, one_hot(i % 2, 0.9)) for i in range(10)])
    gates = {r["check"]: r for r in M.sanity_gates(df, df, item="item_id").collect()}
    assert gates["balanced recall"]["value"] == 1.0 and gates["deterministic"]["status"] == "PASS"
    bad = {r["check"]: r["status"] for r in M.sanity_gates(scored(spark, [(1, 1, [1 / 7] * 7)])).collect()}
    assert bad["head is discriminative"] == "FAIL" and bad["accuracy above chance"] == "FAIL"
    assert M.class_order_gate(CLASS_CODES)[0] == "PASS"
    assert M.class_order_gate(["x"])[0] == "FAIL" and M.class_order_gate(None)[0] == "WARN"


def test_best_epoch_and_early_stop(spark):
    values = [0.1, 0.3, 0.3, 0.2, 0.25, 0.5, 0.1, 0.1, 0.1]
    history = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "run STRING, epoch INT, m DOUBLE")
    rows = sorted(M.best_epoch(history, "run", "epoch", "m").collect(), key=lambda r: r["epoch"])
    assert [r["improved"] for r in rows] == [True, True, False, False, False, True, False, False, False]
    assert rows[0]["best_epoch"] == 5
    assert M.early_stop(history, "run", "epoch", "m", 3).first()["stop_epoch"] == 4
    assert M.early_stop(history, "run", "epoch", "m", 9).first()["stop_epoch"] is None


def test_temperature_recovers_a_known_scale(spark):
    rng = random.Random(3)
    data = []
    for i in range(3000):
        z = [rng.gauss(0, 1.5) for _ in range(7)]
        e = [math.exp(v) for v in z]
        t = rng.choices(range(7), weights=e)[0]
        data.append((t, [v * 2.0 for v in z]))
    frame = spark.createDataFrame(data, "target INT, logits ARRAY<DOUBLE>")
    assert H.fit_temperature(frame) == pytest.approx(2.0, abs=0.2)
    assert H.fit_temperature(frame.limit(0)) == 1.0
    rows = [(r["target"], r["logits"]) for r in frame.select("target", "logits").collect()]

    def loss(t):
        return sum(math.log(sum(math.exp((x - max(z)) / t) for x in z)) - (z[y] - max(z)) / t for y, z in rows) / len(rows)

    found = H.calibrate(frame).first()
    t = found["temperature"]
    assert found["nll"] == pytest.approx(loss(t)) and abs(loss(t + 1e-4) - loss(t - 1e-4)) / 2e-4 < 1e-6
    # A minimum outside the limits is the nearer limit.
    assert H.calibrate(frame, lo=t * 2, hi=t * 3).first()["temperature"] == pytest.approx(t * 2)
    assert H.calibrate(frame, lo=t / 3, hi=t / 2).first()["temperature"] == pytest.approx(t / 2)


def test_loss_without_weights_is_plain_cross_entropy(spark):
    logits = [[2.0] + [0.0] * 6, [0.0, 1.0] + [0.0] * 5]
    frame = spark.createDataFrame([(0, logits[0]), (3, logits[1])], "target INT, logits ARRAY<DOUBLE>")
    want = sum(
        math.log(sum(math.exp(v) for v in z)) - z[t] for t, z in ((0, logits[0]), (3, logits[1]))
    ) / 2
    assert M.weighted_nll(frame).first()["loss"] == pytest.approx(want)


def test_pass_summaries(spark):
    rows = [(1, 0, one_hot(0, 0.9)), (1, 1, one_hot(0, 0.7)), (1, 2, one_hot(1, 0.8)), (2, 0, one_hot(3))]
    passes = spark.createDataFrame(rows, "item INT, pass INT, probs ARRAY<DOUBLE>")
    views = {r["item"]: r for r in P.summarise_views(passes, "item").collect()}
    assert views[1]["consensus"] == 0 and views[1]["agreement"] == pytest.approx(2 / 3)
    assert views[1]["per_pass"] == [0, 0, 1]
    p = [0.9, 0.7, 0.2 / 6]
    mean = sum(p) / 3
    assert views[1]["top_std"] == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in p) / 3))
    noise = {r["item"]: r for r in P.summarise_stochastic(passes, "item").collect()}
    assert noise[2]["passes"] == 0 and noise[2]["mutual_information"] == 0.0
    assert noise[1]["passes"] == 3 and noise[1]["mutual_information"] > 0


def test_folded_head_scores_raw_vectors_alike(spark):
    rng = random.Random(1)
    data = spark.createDataFrame(
        [(i, i % 7, [rng.gauss(1, 2) for _ in range(5)]) for i in range(60)], "item INT, target INT, v ARRAY<DOUBLE>"
    )
    moments = H.feature_moments(data, "v")
    head = H.head_frame(spark, [[rng.gauss(0, 1) for _ in range(5)] for _ in range(7)], [0.1 * k for k in range(7)])
    a = H.score_linear(H.standardise(data, moments, "v", "z"), head, "z").select("item", "logits").collect()
    b = H.score_linear(data, H.fold_scaler(head, moments), "v").select("item", "logits").collect()
    for x, y in zip(sorted(a), sorted(b)):
        assert x["logits"] == pytest.approx(y["logits"])
