"""Linear heads on feature vectors: fitting, selection, calibration, folding.

Gradient sums run on the executors (``descent``, and ``pyspark.ml`` for the margin baseline) and
only coefficients (classes x dimensions) reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.basic import let, literal_array, total
from ..session import stored
from ..sources.taxonomy import CLASS_CODES
from .descent import fit_heads
from .metrics import confusion_counts, macro_f1

STD_FLOOR = 1e-6
# One-vs-rest fits at a time; each holds its own copy of the rows (memory and disk).
FITS = 4


def feature_moments(df: DataFrame, vector: str) -> DataFrame:
    """One row: per dimension the mean and both standard deviations (floored)."""
    stats = df.agg(
        Summarizer.metrics("mean", "std", "count").summary(array_to_vector(vector)).alias("s")
    ).select(
        vector_to_array("s.mean").alias("mean"), vector_to_array("s.std").alias("std"),
        F.col("s.count").cast("double").alias("n"),
    )
    shrink = F.sqrt((F.col("n") - 1.0) / F.col("n"))
    return stats.select(
        F.transform(
            F.arrays_zip("mean", "std"),
            lambda z: F.struct(
                z["mean"].alias("mean"),
                F.greatest(z["std"], F.lit(STD_FLOOR)).alias("std_sample"),
                F.greatest(z["std"] * shrink, F.lit(STD_FLOOR)).alias("std_population"),
            ),
        ).alias("moments")
    )


def standardise(df: DataFrame, moments: DataFrame, vector: str, out: str, std: str = "std_sample") -> DataFrame:
    """Scale vectors by given moments (a one-row table, read as a scalar)."""
    return (
        df.withColumn("_m", moments.scalar())
        .withColumn(out, F.zip_with(vector, "_m", lambda x, m: (x - m["mean"]) / m[std]))
        .drop("_m")
    )


def fit_head(
    train: DataFrame, val: DataFrame, weights: Sequence[float],
    reg_grid: Sequence[float] = (0.0001, 0.01), smoothing: float = 0.05, max_iter: int = 100,
) -> tuple[DataFrame, DataFrame]:
    """Smoothed, class-weighted fit per penalty; (selection table, best head).

    Both inputs carry ``v`` (standardised) and ``target``; train is read once per pass, so
    store it. The head with the best validation macro-F1 wins; the first one wins a tie.
    """
    spark = train.sparkSession
    fitted, norms = fit_heads(train, weights, reg_grid, smoothing, passes=max_iter)
    tried = []
    for reg, head, norm in zip(reg_grid, fitted, norms, strict=True):
        scored = score_linear(val, head_frame(spark, head[:, :-1].tolist(), head[:, -1].tolist()), "v")
        f1 = macro_f1(confusion_counts(scored.withColumnRenamed("logits", "probs"))).first()[0]
        tried.append((float(reg), float(f1), float(norm), head))
    best = max(tried, key=lambda t: t[1])
    table = spark.createDataFrame(
        [(reg, f1, reg == best[0], norm < 1e-3) for reg, f1, norm, _head in tried],
        "reg DOUBLE, val_macro_f1 DOUBLE, chosen BOOLEAN, converged BOOLEAN",
    )
    return table, head_frame(spark, best[3][:, :-1].tolist(), best[3][:, -1].tolist())


def head_frame(spark, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> DataFrame:
    """A head as a table: one row per class."""
    return spark.createDataFrame(
        [(i, list(w), float(b)) for i, (w, b) in enumerate(zip(weights, bias))],
        "class_idx INT, w ARRAY<DOUBLE>, b DOUBLE",
    )


def score_linear(df: DataFrame, head: DataFrame, vector: str) -> DataFrame:
    """Add ``logits`` = W v + b; the head is read once as a scalar value."""
    ordered = F.array_sort(F.collect_list(F.struct("class_idx", "w", "b")))
    dot = lambda w, v: F.aggregate(
        F.zip_with(w, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x
    )
    return (
        df.withColumn("_h", head.agg(ordered).scalar())
        .withColumn("logits", F.transform("_h", lambda h: dot(h["w"], F.col(vector)) + h["b"]))
        .drop("_h")
    )


def fold_scaler(head: DataFrame, moments: DataFrame, std: str = "std_sample") -> DataFrame:
    """Weights that take raw vectors: W/sigma and b - (W/sigma) mu."""
    folded = head.withColumn("_m", moments.scalar()).withColumn(
        "_w", F.zip_with("w", "_m", lambda w, m: w / m[std])
    )
    shift = F.aggregate(
        F.zip_with("_w", "_m", lambda w, m: w * m["mean"]), F.lit(0.0), lambda s, x: s + x
    )
    return folded.select("class_idx", F.col("_w").alias("w"), (F.col("b") - shift).alias("b"))


def fit_margin_baseline(
    train: DataFrame, weights: Sequence[float], max_iter: int = 20
) -> DataFrame:
    """One-vs-rest linear SVM with class weights, as a head (largest margin wins).

    Scoring with the coefficients stays inside SQL expressions; the fitted models
    themselves would drag their training summaries into every task.
    """
    w = literal_array([float(x) for x in weights])
    rows = train.select(
        array_to_vector("v").alias("features"),
        F.col("target").cast("double").alias("label"),
        F.element_at(w, F.col("target") + 1).alias("weight"),
    )
    svc = LinearSVC(maxIter=max_iter, regParam=0.1, weightCol="weight")
    # The fits don't depend on each other: run side by side they fill the cores that short passes leave idle.
    models = OneVsRest(classifier=svc, weightCol="weight", parallelism=FITS).fit(rows).models
    return head_frame(
        train.sparkSession,
        [[float(x) for x in m.coefficients.toArray()] for m in models],
        [float(m.intercept) for m in models],
    )


# ---------------------------------------------------------------- temperature


def _nll(logits: Column, target: Column, t: Column) -> Column:
    return let(
        F.transform(logits, lambda x: x / t),
        lambda z: let(
            F.array_max(z),
            lambda top: F.log(total(F.transform(z, lambda x: F.exp(x - top))))
            - (F.element_at(z, target + 1) - top),
        ),
    )


def _slope(logits: Column, target: Column, by: Column) -> tuple[Column, Column]:
    """First and second derivative of the loss in the inverse temperature ``by``: how far the mean
    logit under the scores lies above the target's, and the logits' variance under the scores."""
    weights = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp((x - top) * by)))

    def moments(e: Column) -> Column:
        mass = total(e)
        mean = total(F.zip_with(e, logits, lambda w, x: w * x)) / mass
        square = total(F.zip_with(e, logits, lambda w, x: w * x * x)) / mass
        return F.struct((mean - F.element_at(logits, target + 1)).alias("first"), F.greatest(square - mean * mean, F.lit(0.0)).alias("second"))

    found = let(weights, moments)
    return found["first"], found["second"]


# Inverse temperatures that the first pass looks at, and passes in all.
BRACKETS, PASSES = 16, 8


def calibrate(df: DataFrame, lo: float = 0.25, hi: float = 10.0, tolerance: float = 1e-9) -> DataFrame:
    """One row (temperature, nll), nulls where there is nothing to fit on.

    The loss is convex in the inverse temperature. A first pass takes its slope at a few
    values between the limits and so brackets the minimum; Newton steps on the averaged
    derivatives follow, halving the bracket where a step would leave it, until the slope in
    T is below ``tolerance``: at most PASSES passes over stored scores, a few numbers each.
    """
    spark = df.sparkSession
    schema = "temperature DOUBLE, nll DOUBLE"
    rows = stored(df.select("target", "logits"), "scores")
    target, logits = F.col("target"), F.col("logits")
    ratio = (hi / lo) ** (1 / (BRACKETS - 1))
    tried = [ratio**i / hi for i in range(BRACKETS)]
    slopes = list(rows.agg(*[F.avg(_slope(logits, target, F.lit(by))[0]) for by in tried]).first())
    if slopes[0] is None:
        return spark.createDataFrame([(None, None)], schema)
    rising = [s > 0 for s in slopes]
    at = rising.index(True) if any(rising) else BRACKETS
    low, high = tried[max(0, at - 1)], tried[min(at, BRACKETS - 1)]
    by = low if low == high else (low + high) / 2
    for _ in range(PASSES - 1):
        first, second = _slope(logits, target, F.lit(by))
        row = rows.agg(F.avg(first).alias("first"), F.avg(second).alias("second"), F.avg(_nll(logits, target, F.lit(1.0 / by))).alias("nll")).first()
        if abs(row["first"]) * by * by < tolerance or low == high:
            break
        low, high = (low, by) if row["first"] > 0 else (by, high)
        step = by - row["first"] / row["second"] if row["second"] > 0 else low
        by = step if low < step < high else (low + high) / 2
    return spark.createDataFrame([(1.0 / by, row["nll"])], schema)


def fit_temperature(df: DataFrame, lo: float = 0.25, hi: float = 10.0) -> float:
    """Fitted temperature as a number; 1.0 when there is nothing to fit on."""
    row = calibrate(df, lo, hi).first()
    return 1.0 if row is None or row["temperature"] is None else float(row["temperature"])
