"""Grey morphology and what is built on it: cleaned masks and detectors of structures inside them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.basic import by_sort, ratio
from ..functions.color import with_gray
from ..session import stored
from .raster import along_columns, along_rows, pad, unpad, with_ranks
from .raster_components import parts
from .raster_shape import FLAT_SHARE, VEIL_SHARE, every_image, structureless, veil_fraction

# ---- fixed values -----------------------------------------------------------
SECOND, SMOOTHING = (1, 0, -2, 0, 1), (1, 4, 6, 4, 1)  # a second derivative and its cross weights
SLOPE, SLOPE_SMOOTHING = (-1, 0, 1), (1, 2, 1)
BLUR = 1.6
MIN_AREA = 100
DOT_RANK, DOT_AREA, DOT_AREA_MAX, DOT_AREA_SHARE, MIN_DOTS = 0.97, 6, 40, 0.01, 6
RIDGE_RANK, RIDGE_MIN, RIDGE_SIZE, RIDGE_SHARE, MESH_SHARE = 0.92, 6.0, 9, 0.04, 0.25
CLEAN_SIZE, CLOSINGS = 7, 2
NEAR = 3  # up to this half width neighbours are compared one by one
RIM_SIZE, MIN_RIM, RIM_FACTOR = 15, 50, 1.35
STRUCTURES = ("structureless_area", "dots_globules", "pigment_network", "streaks", "blue_white_veil")
# ---- end of fixed values ----------------------------------------------------


def blur_weights(sigma: float) -> list[float]:
    """Normalised Gaussian over three deviations to each side."""
    radius = round(3 * sigma)
    raw = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [v / sum(raw) for v in raw]


def filtered(px: DataFrame, out: dict[str, tuple[str, Sequence[float], Sequence[float]]]) -> DataFrame:
    """Separable filters: name -> (column, weights along rows, weights along columns), mirrored at the frame."""
    radius = max(max(len(a), len(d)) // 2 for _, a, d in out.values())
    wide = pad(px, radius)
    for part, axis in ((1, along_rows()), (2, along_columns())):
        shifted = {}
        for name, spec in out.items():
            source, weights = (spec[0] if part == 1 else f"_{name}"), spec[part]
            acc = F.lit(0.0)
            for k, weight in enumerate(weights):
                if weight:
                    acc = acc + float(weight) * F.lead(source, k - len(weights) // 2).over(axis)
            shifted[f"_{name}" if part == 1 else name] = acc
        wide = wide.withColumns(shifted)
    return unpad(wide).drop(*[f"_{n}" for n in out])


def half_widths(size: int) -> dict[int, int]:
    """Half width of an ellipse of this size at each height from its middle row."""
    r = size // 2
    return {dy: round(r * math.sqrt(1 - (dy * dy) / (r * r))) if r else 0 for dy in range(r + 1)}


def extremes(px: DataFrame, value: str, size: int, largest: bool, out: str) -> DataFrame:
    """Greatest (or least) value under an ellipse of odd ``size`` around each pixel; what lies
    outside the picture does not count.

    Under a small ellipse neighbours are compared one by one, along the row and then along the column:
    two sorts. Else a window of length L = 2k + 1 along a row is the end of one block of L pixels and
    the start of the next. Extremes from each block's start and to its end are running values: pairs
    (block, value) rise with the block, so each pixel costs the same whatever the size.
    """
    rows, back = along_rows(), along_rows().orderBy(F.desc("x"))
    pick, best = (F.max, F.greatest) if largest else (F.min, F.least)
    half = half_widths(size)
    widths = sorted(set(half.values()))
    x = F.col("x")

    def at(name: str, by: int, axis) -> Column:
        return F.lead(name, by).over(axis) if by else F.col(name)

    def over_columns(frame: DataFrame) -> DataFrame:
        over = [at(f"_e{half[abs(dy)]}", dy, along_columns()) for dy in range(-(size // 2), size // 2 + 1)]
        return frame.withColumn(out, best(*over) if len(over) > 1 else over[0])

    if widths[-1] <= NEAR:
        near = {f"_e{k}": best(*[at(value, dx, rows) for dx in range(-k, k + 1)]) if k else F.col(value) for k in widths}
        return over_columns(px.withColumns(near)).drop(*near)

    def block(k: int, where: Column) -> Column:
        return F.floor(where / (2 * k + 1))

    def rising(k: int, falling_x: bool) -> Column:
        number = block(k, x)
        return F.struct((number if largest != falling_x else -number).alias("b"), F.col(value).alias("v"))

    px = px.withColumns({f"_p{k}": pick(rising(k, False)).over(rows)["v"] for k in widths if k})
    px = px.withColumns({f"_s{k}": pick(rising(k, True)).over(back)["v"] for k in widths if k} | {f"_l{k}": F.first(f"_p{k}").over(back) for k in widths if k})
    spans = {f"_e{k}": F.col(value) for k in widths if not k}
    for k in widths:
        if k:
            start = F.greatest(x - k, F.lit(0))
            # A window cut short by the right frame ends in the row's last block.
            cut = F.when(block(k, start) != block(k, F.col("w") - 1), F.col(f"_l{k}"))
            head = F.when(x + k < F.col("w"), F.lead(f"_p{k}", k).over(rows)).otherwise(cut)
            tail = F.when(x >= k, F.lag(f"_s{k}", k).over(rows)).otherwise(F.first(f"_s{k}").over(rows))
            # Cut short on the left, it starts with the row's first block, of which the head may be a part.
            spans[f"_e{k}"] = F.when((x < k) & (x + k < F.col("w")), F.when(block(k, x + k) == 0, F.lead(f"_p{k}", k).over(rows)).otherwise(best(head, tail))).when(
                (x < k) & (block(k, F.col("w") - 1) == 0), F.col(f"_l{k}")
            ).otherwise(best(head, tail))
    px = over_columns(px.withColumns(spans))
    return px.drop(*[f"_{n}{k}" for n in "psle" for k in widths])


def opened(px: DataFrame, value: str, size: int, out: str) -> DataFrame:
    return extremes(extremes(px, value, size, False, "_o"), "_o", size, True, out).drop("_o")


def closed(px: DataFrame, value: str, size: int, out: str) -> DataFrame:
    return extremes(extremes(px, value, size, True, "_o"), "_o", size, False, out).drop("_o")


def cleaned_mask(px: DataFrame, size: int = CLEAN_SIZE, closings: int = CLOSINGS) -> DataFrame:
    """px with ``is_mask`` opened (specks go) and then closed (gaps shut): ``closings`` dilations
    before as many erosions, all under an ellipse of this size."""
    out = opened(px.withColumn("_on", F.col("is_mask").cast("int")), "_on", size, "_on0")
    for i in range(2 * closings):
        out = extremes(out, f"_on{i}", size, i < closings, f"_on{i + 1}").drop(f"_on{i}")
    return out.withColumn("is_mask", F.col(f"_on{2 * closings}") > 0).select(*px.columns)


def _inside(column: str) -> Column:
    return F.when(F.col("is_mask"), F.col(column))


def dots(px: DataFrame, weights: Sequence[float] | None = None, rank: float = DOT_RANK, least: int = DOT_AREA, most: int = DOT_AREA_MAX, size: int = 3) -> DataFrame:
    """Number of small blobs: image_id, dots. ``weights``: the blur before the Laplacian.

    Blobs are where the Laplacian of the blurred grey picture exceeds its rank inside the
    mask, opened with a small ellipse.
    """
    weights = weights or blur_weights(BLUR)
    soft = filtered(with_gray(px), {"_soft": ("gray", weights, weights)})
    curved = filtered(soft, {"_xx": ("_soft", SECOND, SMOOTHING), "_yy": ("_soft", SMOOTHING, SECOND)})
    # At six decimals the result does not depend on the order of sums.
    curved = curved.withColumn("_curve", F.round(F.col("_xx") + F.col("_yy"), 6))
    ranked = with_ranks(curved.withColumn("_held", _inside("_curve")), "_held", {"_cut": rank})
    raw = ranked.withColumn("_blob", (F.coalesce(F.col("_curve") > F.col("_cut"), F.lit(False)) & F.col("is_mask")).cast("int"))
    blobs = stored(opened(raw, "_blob", size, "_open").select("image_id", "w", "h", "y", "x", "is_mask", (F.col("_open") > 0).alias("on")), "blobs")
    total = blobs.groupBy("image_id").agg(F.count_if("is_mask").alias("total"))
    fits = F.col("area").between(least, F.greatest(F.lit(float(most)), F.col("total") * DOT_AREA_SHARE))
    found = parts(blobs, "on").join(by_sort(total), "image_id").groupBy("image_id").agg(F.count_if(fits).alias("dots"))
    return every_image(px, found, dots=F.lit(0).cast("long"))


def network(px: DataFrame, size: int = RIDGE_SIZE, rank: float = RIDGE_RANK, least: float = RIDGE_MIN, close: int = 3) -> DataFrame:
    """Ridges of the black-hat picture: image_id, ridge_share (of the mask), mesh_share (of the ridges in their largest part)."""
    gray = with_gray(px).withColumn("gray", F.round("gray", 6))
    hat = closed(gray, "gray", size, "_closed").withColumn("_hat", F.round(F.col("_closed") - F.col("gray"), 6))
    ranked = with_ranks(hat.withColumn("_held", _inside("_hat")), "_held", {"_cut": rank})
    raw = ranked.withColumn("_ridge", (F.coalesce(F.col("_hat") >= F.greatest(F.round("_cut", 6), F.lit(least)), F.lit(False)) & F.col("is_mask")).cast("int"))
    ridges = stored(closed(raw, "_ridge", close, "_full").select("image_id", "w", "h", "y", "x", "is_mask", (F.col("_full") > 0).alias("on")), "ridges")
    total = ridges.groupBy("image_id").agg(F.count_if("is_mask").alias("total"))
    sizes = parts(ridges, "on").groupBy("image_id").agg(F.sum("area").alias("all"), F.max("area").alias("most"))
    found = sizes.join(by_sort(total), "image_id").select("image_id", ratio(F.col("all"), F.col("total")).alias("ridge_share"), ratio(F.col("most"), F.col("all")).alias("mesh_share"))
    return every_image(px, found, ridge_share=F.lit(0.0), mesh_share=F.lit(0.0))


def streaks(px: DataFrame, size: int = RIM_SIZE) -> DataFrame:
    """Mean grey slope on the mask's rim and in its core: image_id, rim (pixels), rim_slope, core_slope
    (the rim's where there is no core)."""
    slopes = filtered(with_gray(px), {"_gx": ("gray", SLOPE, SLOPE_SMOOTHING), "_gy": ("gray", SLOPE_SMOOTHING, SLOPE)})
    marked = slopes.withColumns({"_slope": F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy")), "_on": F.col("is_mask").cast("int")})
    core = extremes(marked, "_on", size, False, "_core")
    rim = F.col("is_mask") & (F.col("_core") == 0)
    return core.groupBy("image_id").agg(
        F.count_if(rim).alias("rim"), F.coalesce(F.avg(F.when(rim, F.col("_slope"))), F.lit(0.0)).alias("rim_slope"),
        F.coalesce(F.avg(F.when(F.col("_core") > 0, F.col("_slope"))), F.avg(F.when(rim, F.col("_slope"))), F.lit(0.0)).alias("core_slope"),
    )


def structures(
    px: DataFrame,
    min_area: int = MIN_AREA,
    dot_options: dict | None = None,
    min_dots: int = MIN_DOTS,
    network_options: dict | None = None,
    rim_size: int = RIM_SIZE,
    min_rim: int = MIN_RIM,
    flat_size: int = 15,
) -> DataFrame:
    """The five structures of each image: measures, a flag each, ``structures`` (names in fixed order)
    and ``d`` (their number). Masks under ``min_area`` pixels have none; images with an empty mask stay.

    px: colocated pixels with ``is_mask``; several detectors read them, so hand over stored ones.
    """
    area = px.groupBy("image_id").agg(F.count_if("is_mask").alias("mask_area"))
    joined = area
    for found in (
        structureless(px, flat_size).select("image_id", "flat_share"), dots(px, **(dot_options or {})), network(px, **(network_options or {})), streaks(px, rim_size), veil_fraction(px),
    ):
        joined = joined.join(by_sort(found), "image_id")
    tests = {
        "structureless_area": F.col("flat_share") > FLAT_SHARE,
        "dots_globules": F.col("dots") >= min_dots,
        "pigment_network": (F.col("ridge_share") > RIDGE_SHARE) & (F.col("mesh_share") > MESH_SHARE),
        "streaks": (F.col("rim") > min_rim) & (F.col("rim_slope") > RIM_FACTOR * F.greatest(F.col("core_slope"), F.lit(1e-6))),
        "blue_white_veil": F.col("veil") > VEIL_SHARE,
    }
    flagged = joined.withColumns({n: t & (F.col("mask_area") >= min_area) for n, t in tests.items()})
    names = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in STRUCTURES]))
    return flagged.withColumn("structures", names).withColumn("d", F.size("structures"))
