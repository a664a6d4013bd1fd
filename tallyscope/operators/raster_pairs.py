"""Comparing two pictures: paired pixels are one grouping by (pair, y, x)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.basic import clip, ratio
from ..functions.color import with_gray, with_hsv, with_lab

# ---- fixed values -----------------------------------------------------------
HIST_BINS = 32
K1, K2, DATA_RANGE = 0.01, 0.03, 255.0
# ---- end of fixed values ----------------------------------------------------


def _paired(px: DataFrame, columns: list[str]) -> DataFrame:
    """``<column>_a`` / ``<column>_b`` per pixel present in both pictures.

    ``px`` carries ``pair_id`` and ``side`` (0 baseline, 1 follow-up) and is
    colocated by pair.
    """
    sides = {"a": 0, "b": 1}
    return (
        px.groupBy("pair_id", "y", "x")
        .agg(
            F.first("w").alias("w"), F.first("h").alias("h"),
            *[
                F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{n}")
                for c in columns
                for n, s in sides.items()
            ],
        )
        .filter(f"{columns[0]}_a IS NOT NULL AND {columns[0]}_b IS NOT NULL")
    )


def histogram_distance(px: DataFrame) -> DataFrame:
    """Bhattacharyya distance of the hue-saturation histograms.

    Each histogram is scaled by its own minimum and maximum first; bins nobody
    fills make the minimum 0.
    """
    hsv = with_hsv(px)
    bins = hsv.select(
        "pair_id", "side",
        (
            F.least(F.lit(HIST_BINS - 1), F.floor(F.col("hue") / 2.0 * HIST_BINS / 180.0)) * HIST_BINS
            + F.least(F.lit(HIST_BINS - 1), F.floor(F.col("sat") * HIST_BINS / 256.0))
        ).alias("bin"),
    )
    counts = bins.groupBy("pair_id", "bin").agg(
        F.count_if(F.col("side") == 0).alias("na"), F.count_if(F.col("side") == 1).alias("nb")
    )
    every = HIST_BINS * HIST_BINS
    whole = W.partitionBy("pair_id")  # at most 1024 bins

    def scaled(c: str) -> Column:
        filled = F.count_if(F.col(c) > 0).over(whole)
        low = F.when(filled < every, 0).otherwise(F.min(c).over(whole))
        return F.coalesce(F.try_divide(F.col(c) - low, (F.max(c).over(whole) - low).cast("double")), F.lit(0.0))

    both = counts.select(
        "pair_id", scaled("na").alias("a"), scaled("nb").alias("b"),
        F.sum("na").over(whole).alias("ta"), F.sum("nb").over(whole).alias("tb"),
    ).filter("ta > 0 AND tb > 0")
    overlap = ratio(F.sum(F.sqrt(F.col("a") * F.col("b"))), F.sqrt(F.sum("a") * F.sum("b")))
    return both.groupBy("pair_id").agg(
        clip(F.sqrt(F.greatest(F.lit(0.0), 1.0 - overlap)), 0.0, 1.0).alias("color_distance")
    )


def structural_similarity(px: DataFrame, size: int = 7) -> DataFrame:
    """Mean local similarity of the grey images; correlation where they are too small."""
    radius = size // 2
    pairs = _paired(with_gray(px), ["gray"])
    a, b = F.col("gray_a"), F.col("gray_b")
    fields = pairs.withColumns({"_a": a, "_b": b, "_aa": a * a, "_bb": b * b, "_ab": a * b})
    names = ("_a", "_b", "_aa", "_bb", "_ab")
    for axis in (
        W.partitionBy("pair_id", "y").orderBy("x"), W.partitionBy("pair_id", "x").orderBy("y")
    ):
        frame = axis.rowsBetween(-radius, radius)
        fields = fields.withColumns({n: F.avg(n).over(frame) for n in names})
    sample = size * size / (size * size - 1.0)
    c1, c2 = (K1 * DATA_RANGE) ** 2, (K2 * DATA_RANGE) ** 2
    ma, mb = F.col("_a"), F.col("_b")
    va, vb = sample * (F.col("_aa") - ma * ma), sample * (F.col("_bb") - mb * mb)
    vab = sample * (F.col("_ab") - ma * mb)
    local = ((2.0 * ma * mb + c1) * (2.0 * vab + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    inner = (
        (F.col("y") >= radius) & (F.col("y") < F.col("h") - radius)
        & (F.col("x") >= radius) & (F.col("x") < F.col("w") - radius)
    )
    flat = (F.stddev_pop("gray_a") < 1e-6) | (F.stddev_pop("gray_b") < 1e-6)
    fallback = F.when(flat, 0.0).otherwise(clip(F.corr("gray_a", "gray_b"), 0.0, 1.0))
    return fields.withColumn("_s", F.when(inner, local)).groupBy("pair_id").agg(
        F.coalesce(F.avg("_s"), fallback).alias("_mean")
    ).select("pair_id", clip(F.col("_mean"), 0.0, 1.0).alias("similarity"))


def gray_correlation(px: DataFrame) -> DataFrame:
    """The fallback similarity on its own."""
    pairs = _paired(with_gray(px), ["gray"])
    flat = (F.stddev_pop("gray_a") < 1e-6) | (F.stddev_pop("gray_b") < 1e-6)
    return pairs.groupBy("pair_id").agg(
        F.when(flat, 0.0).otherwise(clip(F.corr("gray_a", "gray_b"), 0.0, 1.0)).alias("correlation")
    )


def difference_map(px: DataFrame) -> DataFrame:
    """Per-pixel Lab difference, scaled to 0..1 within each pair."""
    pairs = _paired(with_lab(px), ["lightness", "a_star", "b_star"])

    def apart(c: str, unit: float) -> Column:
        return F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) * unit

    raw = pairs.select(
        "pair_id", "y", "x",
        (apart("lightness", 2.55) + apart("a_star", 1.0) + apart("b_star", 1.0)).alias("m"),
    )
    whole = W.partitionBy("pair_id")
    low, high = F.min("m").over(whole), F.max("m").over(whole)
    return raw.withColumn(
        "difference", F.when(high - low > 1e-6, F.try_divide(F.col("m") - low, high - low)).otherwise(0.0)
    ).drop("m")
