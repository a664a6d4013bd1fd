"""Colour conversions of 0..255 channels as Column expressions (no 8-bit rounding)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# ---- fixed values -----------------------------------------------------------
GRAY = (0.299, 0.587, 0.114)
LUMA = (0.2125, 0.7154, 0.0721)  # the weights gradients are taken with
XYZ = (
    (0.412453, 0.357580, 0.180423),
    (0.212671, 0.715160, 0.072169),
    (0.019334, 0.119193, 0.950227),
)
WHITE = (0.950456, 1.0, 1.088754)
CR_SCALE, CB_SCALE = 0.713, 0.564
# ---- end of fixed values ----------------------------------------------------


def gray(r: Column, g: Column, b: Column) -> Column:
    return GRAY[0] * r + GRAY[1] * g + GRAY[2] * b


def luma(r: Column, g: Column, b: Column) -> Column:
    return (LUMA[0] * r + LUMA[1] * g + LUMA[2] * b) / 255.0


def with_gray(px: DataFrame) -> DataFrame:
    return px.withColumn("gray", gray(F.col("r"), F.col("g"), F.col("b")))


def with_hsv(px: DataFrame) -> DataFrame:
    """Add ``hue`` (degrees), ``sat`` and ``val`` (0..255)."""
    r, g, b = (F.col(c) for c in "rgb")
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    px = px.withColumns({"val": top, "_span": top - low})
    v, d = F.col("val"), F.col("_span")
    sixth = (
        F.when(d == 0, 0.0)
        .when(v == r, 60.0 * F.try_divide(g - b, d))
        .when(v == g, 120.0 + 60.0 * F.try_divide(b - r, d))
        .otherwise(240.0 + 60.0 * F.try_divide(r - g, d))
    )
    px = px.withColumns(
        {"_hue": sixth, "sat": F.when(v == 0, 0.0).otherwise(F.try_divide(d, v) * 255.0)}
    )
    hue = F.when(F.col("_hue") < 0, F.col("_hue") + 360.0).otherwise(F.col("_hue"))
    return px.withColumn("hue", hue).drop("_span", "_hue")


def with_lab(px: DataFrame) -> DataFrame:
    """Add ``lightness`` (0..100), ``a_star`` and ``b_star``."""

    def linear(c: str) -> Column:
        x = F.col(c) / 255.0
        return F.when(x > 0.04045, F.pow((x + 0.055) / 1.055, F.lit(2.4))).otherwise(x / 12.92)

    px = px.withColumns({f"_l{c}": linear(c) for c in "rgb"})
    lin = [F.col(f"_l{c}") for c in "rgb"]
    px = px.withColumns(
        {
            f"_{n}": (row[0] * lin[0] + row[1] * lin[1] + row[2] * lin[2]) / white
            for n, row, white in zip("xyz", XYZ, WHITE)
        }
    )

    def curve(n: str) -> Column:
        t = F.col(f"_{n}")
        return F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0)

    px = px.withColumns({f"_f{n}": curve(n) for n in "xyz"})
    y = F.col("_y")
    light = F.when(y > 0.008856, 116.0 * F.col("_fy") - 16.0).otherwise(903.3 * y)
    scratch = [f"_l{c}" for c in "rgb"] + [f"_{n}" for n in "xyz"] + [f"_f{n}" for n in "xyz"]
    return px.withColumns(
        {
            "lightness": light,
            "a_star": 500.0 * (F.col("_fx") - F.col("_fy")),
            "b_star": 200.0 * (F.col("_fy") - F.col("_fz")),
        }
    ).drop(*scratch)


def with_ycrcb(px: DataFrame) -> DataFrame:
    y = gray(F.col("r"), F.col("g"), F.col("b"))
    return px.withColumns(
        {
            "luma": y,
            "cr": (F.col("r") - y) * CR_SCALE + 128.0,
            "cb": (F.col("b") - y) * CB_SCALE + 128.0,
        }
    )
