"""Masks and what is measured inside them: geometry, asymmetry, border, colours.

All functions take colocated pixels carrying ``is_mask``; one row per image comes back.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.basic import by_sort, clip, ratio
from ..functions.color import with_gray, with_hsv, with_lab
from .raster import along_columns, along_rows, dilate, gaussian_weights, local_std, smooth, with_ranks

# ---- fixed values -----------------------------------------------------------
LIGHT_SHARE, BLUE_SHARE = 0.65, 0.35
ASYMMETRY_CUT = 0.12
SECTOR_CUT = 0.12
IRREGULARITY_SCALE = 0.30
MIN_COLOR_SHARE = 0.05
VEIL_SHARE = 0.08
FLAT_STD, FLAT_SHARE = 6.0, 0.30
COLOR_NAMES = ("white", "red", "light_brown", "dark_brown", "blue_gray", "black")
# ---- end of fixed values ----------------------------------------------------

# Whole numbers wider than 64 bits.
WIDE = "decimal(38,0)"


def _color_rules() -> dict[str, Column]:
    light, a, b = F.col("lightness"), F.col("a_star"), F.col("b_star")
    sat, hue = F.col("sat") / 255.0, F.col("hue")
    return {
        "white": (light > 70) & (sat < 0.18),
        "red": (a > 18) & (sat > 0.30) & ((hue < 25) | (hue > 335)),
        "light_brown": (light >= 45) & (light <= 75) & (b > 8) & (a > 3),
        "dark_brown": (light >= 20) & (light < 45) & (b > 5),
        "blue_gray": (b < -3) & (light > 20) & (light < 70),
        "black": light < 20,
    }


# ----------------------------------------------------------------------- mask


def lesion_channel(px: DataFrame, blur: int = 7) -> DataFrame:
    """Add ``channel`` (0..255): dark and blue-poor pixels are bright.

    Lightness and blue are stretched between their 1st and 99th percentile. ``blur``
    is the size of the Gaussian applied at the end (0 for none).
    """
    lab = with_lab(px)
    joined = with_ranks(with_ranks(lab, "lightness", {"_l0": 0.01, "_l1": 0.99}), "b", {"_b0": 0.01, "_b1": 0.99})

    def stretched(value: str, limit: str) -> Column:
        low, high = F.col(f"{limit}0"), F.col(f"{limit}1")
        return F.when(high - low < 1e-3, 0.0).otherwise(
            clip(F.try_divide(F.col(value) - low, high - low), 0.0, 1.0)
        )

    mixed = LIGHT_SHARE * (1.0 - stretched("lightness", "_l")) + BLUE_SHARE * (
        1.0 - stretched("b", "_b")
    )
    out = joined.withColumn("channel", F.floor(mixed * 255.0).cast("double")).drop("_l0", "_l1", "_b0", "_b1")
    return smooth(out, {"channel": F.col("channel")}, gaussian_weights(blur)) if blur > 1 else out


def otsu(df: DataFrame, key: str, value: str) -> DataFrame:
    """Between-class variance maximum over a 0..255 column, per key.

    A key contributes at most 256 histogram rows. All sums are whole numbers, so
    the comparison of candidate thresholds is free of rounding noise.
    """
    hist = df.groupBy(key, F.floor(value).cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    upto = W.partitionBy(key).orderBy("bin")
    whole = W.partitionBy(key)
    mass = F.col("n") * F.col("bin")
    sums = hist.select(
        key, "bin",
        F.sum("n").over(upto).alias("_n1"), F.sum(mass).over(upto).alias("_s1"),
        F.sum("n").over(whole).alias("_n"), F.sum(mass).over(whole).alias("_s"),
    )
    best = F.max(F.struct(_between().alias("v"), (-F.col("bin")).alias("neg")))
    return sums.groupBy(key).agg(best.alias("_b")).select(
        key, (-F.col("_b.neg")).alias("threshold"), F.col("_b.v").alias("spread")
    )


def _between() -> Column:
    """Between-class variance (up to a constant) from whole-number sums.

    Products of counts and sums leave 64 bits from about 2 * 10^8 rows of a key on, so they are
    taken in decimals.
    """
    n, s1, n1, s = (F.col(c).cast(WIDE) for c in ("_n", "_s1", "_n1", "_s"))
    apart = (n * s1 - n1 * s).cast("double")
    weight = F.col("_n1").cast("double") * (F.col("_n") - F.col("_n1"))
    return F.coalesce(F.try_divide(apart * apart, weight), F.lit(0.0))


def with_mask(px: DataFrame, blur: int = 7) -> DataFrame:
    """Add ``channel`` and ``is_mask``: every pixel above its image's Otsu threshold."""
    binned = lesion_channel(px, blur).withColumn("_bin", F.floor("channel").cast("long"))
    # The same sums as in ``otsu``, as window values: the pixels are read once and no
    # join repeats the colour conversion.
    whole = W.partitionBy("image_id")
    upto = whole.orderBy("_bin").rangeBetween(W.unboundedPreceding, W.currentRow)
    sums = binned.withColumns(
        {
            "_n1": F.count(F.lit(1)).over(upto), "_s1": F.sum("_bin").over(upto),
            "_n": F.count(F.lit(1)).over(whole), "_s": F.sum("_bin").over(whole),
        }
    )
    best = F.max(F.struct(_between().alias("v"), (-F.col("_bin")).alias("neg"))).over(whole)
    return (
        sums.withColumn("_best", best)
        .withColumn("is_mask", F.col("_bin") > -F.col("_best.neg"))
        .drop("_bin", "_n1", "_s1", "_n", "_s", "_best")
    )


def mask_geometry(px: DataFrame) -> DataFrame:
    """Area, centroid, bounding box, frame contact and how far to trust the mask."""
    inside = F.col("is_mask")

    def where(c: str) -> Column:
        return F.when(inside, F.col(c))

    on_edge = sum(
        (c.cast("int") for c in (
            F.col("y") == F.col("h") - 1, F.col("x") == 0, F.col("x") == F.col("w") - 1
        )),
        start=(F.col("y") == 0).cast("int"),
    )
    sums = px.withColumn("_e", on_edge).groupBy("image_id").agg(
        F.first("w").alias("w"), F.first("h").alias("h"), F.count(F.lit(1)).alias("total"),
        F.count_if(inside).alias("area"),
        F.avg(where("x")).alias("_cx"), F.avg(where("y")).alias("_cy"),
        F.min(where("x")).alias("_x0"), F.max(where("x")).alias("_x1"),
        F.min(where("y")).alias("_y0"), F.max(where("y")).alias("_y1"),
        ratio(F.sum(F.when(inside, F.col("_e")).otherwise(0)), F.sum("_e")).alias("edge_share"),
    )
    area_ratio = F.col("area") / F.col("total")
    base = (
        F.when((area_ratio < 0.005) | (area_ratio > 0.95), 0.15)
        .when((area_ratio < 0.01) | (area_ratio > 0.92), 0.55)
        .otherwise(0.85)
    )
    zero = F.lit(0)
    out = sums.select(
        "image_id", "w", "area", area_ratio.alias("area_ratio"),
        F.coalesce("_cx", F.col("w") / 2.0).alias("cx"), F.coalesce("_cy", F.col("h") / 2.0).alias("cy"),
        F.sqrt(4.0 * F.col("area") / math.pi).alias("diameter_px"),
        F.coalesce("_x0", zero).alias("bbox_x"), F.coalesce("_y0", zero).alias("bbox_y"),
        F.coalesce(F.col("_x1") - F.col("_x0") + 1, zero).alias("bbox_w"),
        F.coalesce(F.col("_y1") - F.col("_y0") + 1, zero).alias("bbox_h"),
        "edge_share",
        (base * F.when((F.col("edge_share") > 0.4) & (base > 0.15), 0.6).otherwise(1.0)).alias("confidence"),
    )
    return out.withColumns(
        {
            "diameter_fraction": F.col("diameter_px") / F.greatest(F.lit(1), F.col("w")),
            "reliable": F.col("confidence") >= 0.5,
        }
    ).drop("w")


def _central(n: Column, pair: Column, first: Column, second: Column) -> Column:
    """n times a sum of products less the product of sums, in decimals: on large masks the
    products leave 64 bits."""
    return n.cast(WIDE) * pair.cast(WIDE) - first.cast(WIDE) * second.cast(WIDE)


def mask_moments(px: DataFrame) -> DataFrame:
    """Whole-number coordinate sums of the mask, the base of axes and eccentricity."""
    y, x = F.col("y").cast("long"), F.col("x").cast("long")
    sums = px.filter("is_mask").groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"),
    )
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    return sums.select(
        "image_id", "n", "sx", "sy", _central(n, sxx, sx, sx).alias("vxx"),
        _central(n, syy, sy, sy).alias("vyy"), _central(n, sxy, sx, sy).alias("vxy"),
    )


def with_moments(px: DataFrame) -> DataFrame:
    """Mask pixels with their image's moments alongside (window values)."""
    y, x = F.col("y").cast("long"), F.col("x").cast("long")
    whole = W.partitionBy("image_id")
    sums = {
        "n": F.count(F.lit(1)), "sx": F.sum(x), "sy": F.sum(y), "_sxx": F.sum(x * x),
        "_syy": F.sum(y * y), "_sxy": F.sum(x * y),
    }
    inside = px.filter("is_mask").withColumns({c: v.over(whole) for c, v in sums.items()})
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in sums)
    return inside.withColumns(
        {"vxx": _central(n, sxx, sx, sx), "vyy": _central(n, syy, sy, sy), "vxy": _central(n, sxy, sx, sy)}
    ).drop("_sxx", "_syy", "_sxy")


def every_image(px: DataFrame, found: DataFrame, **empty: Column) -> DataFrame:
    """``found`` with a row for images whose mask is empty too: there the values in ``empty``."""
    ids = px.select("image_id").distinct()
    columns = [F.coalesce(F.col(name), value).alias(name) for name, value in empty.items()]
    return ids.join(by_sort(found), "image_id", "left").select("image_id", *columns)


def eccentricity(px: DataFrame) -> DataFrame:
    """From the second moments (the ellipse of equal moments)."""
    m = mask_moments(px)
    xx, yy, xy = (F.col(c).cast("double") for c in ("vxx", "vyy", "vxy"))
    root = F.sqrt((xx - yy) * (xx - yy) + 4.0 * xy * xy)
    major, minor = xx + yy + root, xx + yy - root
    found = m.select(
        "image_id",
        F.when(major <= 0, 0.0).otherwise(
            F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.try_divide(minor, major)))
        ).alias("eccentricity"),
    )
    return every_image(px, found, eccentricity=F.lit(0.0))


# ------------------------------------------------------------------ asymmetry


def moment_axes(px: DataFrame) -> DataFrame:
    """Mask pixels with the mask's centre and cosine and sine of twice its major axis' angle."""
    double = F.atan2(
        2.0 * F.col("vxy").cast("double"), (F.col("vxx") - F.col("vyy")).cast("double")
    )
    return with_moments(px).select(
        "image_id", "y", "x", "gray",
        (F.col("sx") / F.col("n")).alias("_cx"), (F.col("sy") / F.col("n")).alias("_cy"),
        F.cos(double).alias("_c"), F.sin(double).alias("_s"),
    )


def rectangle_axes(px: DataFrame, rectangles: DataFrame) -> DataFrame:
    """As ``moment_axes``, about the centre and the longer side of the smallest rectangle around the mask.

    rectangles: from ``raster_hull.smallest_rectangles``, one small row per image.
    """
    ux, uy = F.col("ux"), F.col("uy")
    sides = rectangles.select(
        "image_id", F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), (ux * ux - uy * uy).alias("_c"), (2.0 * ux * uy).alias("_s"),
    )
    return px.filter("is_mask").join(by_sort(sides), "image_id").select("image_id", "y", "x", "gray", "_cx", "_cy", "_c", "_s")


def asymmetry(px: DataFrame, rectangles: DataFrame | None = None) -> DataFrame:
    """Shape and pigment mismatch under mirroring about the mask's own axes.

    The axes come from the second moments, or from ``rectangles``. Each mask pixel is met by
    the pixels whose mirror images fall on it: pixel and images are keyed by the same
    (image, y, x), so one window inside the image finds all partners and the mask is computed once.
    """
    gray = with_gray(px)
    inside = moment_axes(gray) if rectangles is None else rectangle_axes(gray, rectangles)
    dx, dy = F.col("x") - F.col("_cx"), F.col("y") - F.col("_cy")
    # Reflection about the major axis, and (negated) about the minor one.
    rx = F.col("_c") * dx + F.col("_s") * dy
    ry = F.col("_s") * dx - F.col("_c") * dy

    def nearest(v: Column) -> Column:
        # Moments are whole numbers, so a half is off by the last digits at most, less than what is
        # added. A rectangle's sides are sums: rounded first, a half is one whatever their order.
        return F.floor((v if rectangles is None else F.round(v, 6)) + 0.500001).cast("int")

    def image(axis: Column, y: Column, x: Column) -> Column:
        return F.struct(axis.alias("axis"), y.alias("y"), x.alias("x"))

    met = inside.select(
        "image_id", "gray",
        F.explode(
            F.array(
                image(F.lit(None).cast("string"), F.col("y"), F.col("x")),
                image(F.lit("v"), nearest(F.col("_cy") + ry), nearest(F.col("_cx") + rx)),
                image(F.lit("h"), nearest(F.col("_cy") - ry), nearest(F.col("_cx") - rx)),
            )
        ).alias("m"),
    ).select("image_id", "gray", "m.*")
    there = F.max(F.when(F.col("axis").isNull(), F.col("gray"))).over(W.partitionBy("image_id", "y", "x"))
    joined = met.withColumn("gray2", there).filter("axis IS NOT NULL")
    miss = F.col("gray2").isNull()
    per_axis = joined.groupBy("image_id", "axis").agg(
        F.avg(F.when(miss, 1.0).otherwise(0.0)).alias("shape"),
        ratio(
            F.sum(F.when(miss, 2.0 * F.col("gray")).otherwise(F.abs(F.col("gray") - F.col("gray2")))),
            2.0 * F.sum("gray"),
        ).alias("color"),
    )
    found = per_axis.groupBy("image_id").agg(
        F.count_if(F.greatest("shape", "color") > ASYMMETRY_CUT).alias("a"),
        clip(F.avg("shape"), 0.0, 1.0).alias("shape_index"),
        clip(F.avg("color"), 0.0, 1.0).alias("color_index"),
    )
    none = F.lit(0.0)
    return every_image(px, found, a=F.lit(0).cast("long"), shape_index=none, color_index=none)


# --------------------------------------------------------------------- border


def border(px: DataFrame) -> DataFrame:
    """Border irregularity in eight sectors around the centroid."""
    rows, cols = along_rows(), along_columns()
    neighbour = lambda c: F.coalesce(c, F.lit(False))
    edged = px.select("image_id", "y", "x", "is_mask").withColumn(
        "_inner",
        neighbour(F.lag("is_mask").over(rows)) & neighbour(F.lead("is_mask").over(rows))
        & neighbour(F.lag("is_mask").over(cols)) & neighbour(F.lead("is_mask").over(cols)),
    )
    rim = with_moments(edged).filter("NOT _inner")
    # Offsets scaled by the pixel count stay whole numbers: sectors are decided exactly.
    rim = rim.select(
        "image_id", "n", (F.col("n") * F.col("x") - F.col("sx")).alias("dx"),
        (F.col("n") * F.col("y") - F.col("sy")).alias("dy"),
    )
    dx, dy = F.col("dx"), F.col("dy")
    sector = (
        F.when((dy >= 0) & (dx > 0) & (dy < dx), 0)
        .when((dy > 0) & (dx > 0), 1)
        .when((dy > 0) & (dy > -dx), 2)
        .when(dy > 0, 3)
        .when((dx < 0) & (-dy < -dx), 4)
        .when((dx < 0) & (dy < 0), 5)
        .when((dy < 0) & (-dy > dx), 6)
        .when(dy < 0, 7)
        .otherwise(0)
    )
    radius = F.sqrt(F.pow(dx.cast("double"), 2) + F.pow(dy.cast("double"), 2)) / F.col("n")
    per_sector = rim.select("image_id", sector.alias("sector"), radius.alias("rad")).groupBy(
        "image_id", "sector"
    ).agg(F.count(F.lit(1)).alias("k"), F.sum("rad").alias("sum"), F.stddev_pop("rad").alias("sd"))
    image = per_sector.groupBy("image_id").agg(
        F.sum("k").alias("points"), F.sum("sum").alias("sum"),
        F.collect_list(F.when(F.col("k") >= 3, F.col("sd"))).alias("sds"),  # at most eight
    )
    mean_radius = F.col("sum") / F.col("points")
    usable = (F.col("points") >= 8) & (mean_radius > 1e-6)
    image = image.withColumn(
        "_v",
        F.when(usable, F.transform("sds", lambda s: F.try_divide(s, mean_radius))).otherwise(
            F.array().cast("array<double>")
        ),
    )
    mean_variation = ratio(
        F.aggregate("_v", F.lit(0.0), lambda acc, v: acc + v), F.size("_v").cast("double")
    )
    found = image.select(
        "image_id",
        F.size(F.filter("_v", lambda v: v > SECTOR_CUT)).alias("b"),
        clip(mean_variation / IRREGULARITY_SCALE, 0.0, 1.0).alias("irregularity"),
    )
    return every_image(px, found, b=F.lit(0), irregularity=F.lit(0.0))


# -------------------------------------------------------------------- colours


def colors_present(px: DataFrame, min_share: float = MIN_COLOR_SHARE) -> DataFrame:
    """Diagnostic colours covering enough of the mask, in their fixed order."""
    inside = with_hsv(with_lab(px.filter("is_mask")))
    rules = _color_rules()
    shares = inside.groupBy("image_id").agg(
        *[F.avg(F.when(rules[n], 1.0).otherwise(0.0)).alias(f"_{n}") for n in COLOR_NAMES]
    )
    present = F.array_compact(
        F.array(*[F.when(F.col(f"_{n}") >= min_share, F.lit(n)) for n in COLOR_NAMES])
    )
    found = every_image(px, shares.select("image_id", present.alias("colors")), colors=F.array().cast("array<string>"))
    return found.withColumn("c", F.size("colors"))


def veil_fraction(px: DataFrame) -> DataFrame:
    light = F.col("lightness")
    veil = (F.col("b_star") < -4) & (light > 35) & (light < 75)
    found = with_lab(px.filter("is_mask")).groupBy("image_id").agg(
        F.avg(F.when(veil, 1.0).otherwise(0.0)).alias("veil")
    )
    return every_image(px, found, veil=F.lit(0.0))


def color_variance(px: DataFrame) -> DataFrame:
    """Mean over the channels of their deviation inside the mask."""
    spread = (F.stddev_pop("r") + F.stddev_pop("g") + F.stddev_pop("b")) / 3.0
    found = px.filter("is_mask").groupBy("image_id").agg(spread.alias("color_variance"))
    return every_image(px, found, color_variance=F.lit(0.0))


def structureless(px: DataFrame, size: int = 15) -> DataFrame:
    """Share of the mask whose Gaussian-weighted neighbourhood hardly varies."""
    flat = local_std(with_gray(px), gaussian_weights(size)).filter("is_mask")
    found = flat.groupBy("image_id").agg(
        F.avg(F.when(F.col("local_std") < FLAT_STD, 1.0).otherwise(0.0)).alias("flat_share")
    )
    shares = every_image(px, found, flat_share=F.lit(0.0))
    return shares.withColumn("structureless", F.col("flat_share") > FLAT_SHARE)


def surround_contrast(px: DataFrame, size: int = 31) -> DataFrame:
    """Lightness step between the mask and the ring around it."""
    ringed = dilate(with_lab(px), "is_mask", size)
    light = F.col("lightness") * 2.55
    inside = F.avg(F.when(F.col("is_mask"), light))
    ring = F.avg(F.when(F.col("dilated") & ~F.col("is_mask"), light))
    return ringed.groupBy("image_id").agg(
        F.coalesce(clip(F.abs(ring - inside) / 255.0 * 4.0, 0.0, 1.0), F.lit(0.0)).alias("contrast")
    )


# ---------------------------------------------------------------- weight maps


def concentration(px: DataFrame, weight: str, top: float = 0.10) -> DataFrame:
    """Share of the total weight held by the heaviest ``top`` part of the pixels."""
    order = W.partitionBy("image_id").orderBy(F.col(weight).desc(), "y", "x")
    ranked = px.select("image_id", "y", "x", "w", "h", weight).withColumn(
        "_rn", F.row_number().over(order)
    )
    keep = F.greatest(F.lit(1), F.floor(F.col("w") * F.col("h") * top))
    total = F.sum(weight)
    return ranked.groupBy("image_id").agg(
        F.when(total <= 1e-8, 0.0).otherwise(
            ratio(F.sum(F.when(F.col("_rn") <= keep, F.col(weight)).otherwise(0.0)), total)
        ).alias("concentration")
    )


def alignment(px: DataFrame, weight: str) -> DataFrame:
    """How much of a weight map falls inside the mask."""
    inside = F.col("is_mask")
    sums = px.groupBy("image_id").agg(
        F.sum(weight).alias("total"),
        F.sum(F.when(inside, F.col(weight)).otherwise(0.0)).alias("in_sum"),
        F.avg(F.when(inside, F.col(weight))).alias("in_mean"),
        F.avg(F.when(~inside, F.col(weight))).alias("out_mean"),
    )
    usable = (F.col("total") > 1e-8) & F.col("in_mean").isNotNull()
    lift = F.when(
        F.coalesce("out_mean", F.lit(0.0)) > 1e-8,
        F.least(F.lit(10.0), F.try_divide("in_mean", "out_mean")),
    ).otherwise(10.0)
    out = sums.select(
        "image_id",
        F.when(usable, ratio(F.col("in_sum"), F.col("total"))).otherwise(0.0).alias("inside_ratio"),
        F.when(usable, lift).otherwise(0.0).alias("lift"),
    )
    return out.withColumn(
        "verdict",
        clip(0.6 * F.col("inside_ratio") + 0.4 * F.least(F.col("lift") / 3.0, F.lit(1.0)), 0.0, 1.0),
    )


# ----------------------------------------------------------------------- crop


def mask_crop(px: DataFrame, pad_share: float = 0.12) -> DataFrame:
    """Crop to the padded bounding box (boxes under four pixels keep the frame)."""
    whole = W.partitionBy("image_id")

    def bound(fn, c: str) -> Column:
        return fn(F.when(F.col("is_mask"), F.col(c))).over(whole)

    corners = px.withColumns(
        {
            "bbox_x": F.coalesce(bound(F.min, "x"), F.lit(0)),
            "bbox_y": F.coalesce(bound(F.min, "y"), F.lit(0)),
            "bbox_w": F.coalesce(bound(F.max, "x") - bound(F.min, "x") + 1, F.lit(0)),
            "bbox_h": F.coalesce(bound(F.max, "y") - bound(F.min, "y") + 1, F.lit(0)),
        }
    )
    p = F.floor(pad_share * F.greatest("bbox_w", "bbox_h")).cast("int")
    tiny = (F.col("bbox_w") < 4) | (F.col("bbox_h") < 4)
    joined = corners.withColumns(
        {
            "_x0": F.when(tiny, 0).otherwise(F.greatest(F.lit(0), F.col("bbox_x") - p)),
            "_y0": F.when(tiny, 0).otherwise(F.greatest(F.lit(0), F.col("bbox_y") - p)),
            "_x1": F.when(tiny, F.col("w")).otherwise(F.least("w", F.col("bbox_x") + F.col("bbox_w") + p)),
            "_y1": F.when(tiny, F.col("h")).otherwise(F.least("h", F.col("bbox_y") + F.col("bbox_h") + p)),
        }
    )
    inside = joined.filter("x >= _x0 AND x < _x1 AND y >= _y0 AND y < _y1")
    return inside.withColumns(
        {
            "x": F.col("x") - F.col("_x0"), "y": F.col("y") - F.col("_y0"),
            "w": F.col("_x1") - F.col("_x0"), "h": F.col("_y1") - F.col("_y0"),
        }
    ).drop("_x0", "_y0", "_x1", "_y1", "bbox_x", "bbox_y", "bbox_w", "bbox_h")
