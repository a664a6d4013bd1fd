"""Pixel tables: layout, stencils, quality measures, transforms.

A raster row is ``(image_id, w, h, y, x, r, g, b)``. Sources hold one row per image
with its pixels in one array. Plain aggregates explode it and merge map-side, so only
one small row per image is shuffled. Neighbourhood work first moves the still compact
image rows to their partition (``colocate=True``); exploding keeps that partitioning,
so all later windows and groupings by image run without another exchange. One image
is bounded by its dimensions and never larger than a task can sort.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.basic import let, ratio
from ..functions.color import luma, with_gray, with_hsv, with_ycrcb

# ---- fixed values -----------------------------------------------------------
MAX_INPUT_DIM = 1600
PIXELS_A_TASK = 250_000
SKIN_HSV = ((0, 28), (160, 180))  # hue on the half-degree scale
SKIN_SAT_MIN, SKIN_VAL_MIN = 15, 30
SKIN_CR, SKIN_CB = (130, 183), (74, 130)
# ---- end of fixed values ----------------------------------------------------


def moved(arrays: DataFrame, key: str) -> DataFrame:
    """Image rows moved to the partition of their ``key``, in as many partitions as their pixels need.

    The rows are compact, so their bytes would merge far too many into one task: exploded, a task's
    pixels are what its sorts have to hold.
    """
    held = arrays.agg(F.sum(F.col("w").cast("long") * F.col("h"))).first()[0] or 0
    return arrays.repartition(_tasks(arrays, held), key)


def dealt(px: DataFrame) -> DataFrame:
    """Stored pixel rows moved to the partition of their image, in as many partitions as they need."""
    return px.repartition(_tasks(px, px.count()), "image_id")


def _tasks(frame: DataFrame, held: int) -> int:
    return max(frame.sparkSession.sparkContext.defaultParallelism, -(-held // PIXELS_A_TASK))


def pixels(arrays: DataFrame, colocate: bool = False) -> DataFrame:
    """One row per pixel from one row per image (``px`` ARRAY<STRUCT<r,g,b>>)."""
    if colocate:
        arrays = moved(arrays, "image_id")
    # The outer form spares an extra evaluation of the array to see whether it is empty.
    long = arrays.select("image_id", "w", "h", F.posexplode_outer("px").alias("_pos", "_p")).filter(
        "_pos IS NOT NULL"
    )
    return long.select(
        "image_id", "w", "h",
        F.floor(F.col("_pos") / F.col("w")).cast("int").alias("y"),
        (F.col("_pos") % F.col("w")).cast("int").alias("x"),
        "_p.r", "_p.g", "_p.b",
    )


def image_arrays(images: DataFrame) -> DataFrame:
    """Rows of the ``image`` source to pixel arrays; its bytes are in BGR order."""

    n = F.col("nChannels")

    def pixel(codes: Column) -> Column:
        def byte(at: Column) -> Column:
            return F.element_at(codes, at).cast("double")

        return F.transform(
            F.sequence(F.lit(0), F.col("width") * F.col("height") - 1),
            lambda i: F.struct(
                byte(i * n + F.when(n >= 3, 3).otherwise(1)).alias("r"),
                byte(i * n + F.when(n >= 3, 2).otherwise(1)).alias("g"),
                byte(i * n + 1).alias("b"),
            ),
        )

    # Every byte is one Latin-1 character: one pass over the picture gives all their numbers.
    codes = F.transform(F.split(F.decode(F.col("data"), "ISO-8859-1"), ""), F.ascii)
    return images.select("image.*").select(
        F.regexp_extract("origin", r"([^/]+)\.[^./]+$", 1).alias("image_id"),
        F.col("width").alias("w"), F.col("height").alias("h"), let(codes, pixel).alias("px"),
    )


# ------------------------------------------------------------------- stencils


def pad(px: DataFrame, radius: int) -> DataFrame:
    """Add the mirrored border (edge pixel not repeated) around each image."""

    def copies(at: str, size: str) -> Column:
        v, n = F.col(at), F.col(size)
        return F.explode_outer(
            F.array_compact(
                F.array(
                    v,
                    F.when((v >= 1) & (v <= radius), -v),
                    F.when((v >= n - 1 - radius) & (v <= n - 2), 2 * (n - 1) - v),
                )
            )
        )

    wide = px.withColumn("_x", copies("x", "w")).drop("x").withColumnRenamed("_x", "x")
    return wide.withColumn("_y", copies("y", "h")).drop("y").withColumnRenamed("_y", "y")


def unpad(px: DataFrame) -> DataFrame:
    return px.filter("y >= 0 AND y < h AND x >= 0 AND x < w")


def along_rows() -> W:
    return W.partitionBy("image_id", "y").orderBy("x")


def along_columns() -> W:
    return W.partitionBy("image_id", "x").orderBy("y")


def gaussian_weights(size: int) -> list[float]:
    """Normalised 1-d kernel with the size-derived deviation."""
    radius = size // 2
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [v / sum(raw) for v in raw]


def smooth(px: DataFrame, columns: dict[str, Column], weights: Sequence[float] | int) -> DataFrame:
    """Separable filter of the given expressions; an integer means a box of that size.

    Runs along rows, then along columns: two sorts within each image's partition.
    """
    size = weights if isinstance(weights, int) else len(weights)
    radius = size // 2
    out = pad(px.withColumns(columns), radius)
    for axis in (along_rows(), along_columns()):
        if isinstance(weights, int):
            frame = axis.rowsBetween(-radius, radius)
            out = out.withColumns({c: F.avg(c).over(frame) for c in columns})
        else:
            shifted = {}
            for c in columns:
                acc = F.lit(0.0)
                for k, weight in enumerate(weights):
                    acc = acc + weight * F.lead(c, k - radius).over(axis)
                shifted[c] = acc
            out = out.withColumns(shifted)
    return unpad(out)


def local_std(px: DataFrame, weights: Sequence[float] | int, out: str = "local_std") -> DataFrame:
    """Deviation of ``gray`` in each pixel's neighbourhood."""
    g = F.col("gray")
    both = smooth(px, {"_m": g, "_m2": g * g}, weights)
    spread = F.greatest(F.lit(0.0), F.col("_m2") - F.col("_m") * F.col("_m"))
    return both.withColumn(out, F.sqrt(spread)).drop("_m", "_m2")


def dilate(px: DataFrame, mask: str, size: int, out: str = "dilated") -> DataFrame:
    """Elliptic dilation of a boolean column.

    A row of the ellipse at height dy spans a known half width, so the dilation is a
    running maximum per half width along rows, combined down the columns.
    """
    r = size // 2
    half = {dy: round(r * math.sqrt(1 - (dy * dy) / (r * r))) if r else 0 for dy in range(r + 1)}
    hit = F.col(mask).cast("int")
    px = px.withColumns(
        {
            f"_d{k}": F.max(hit).over(along_rows().rowsBetween(-k, k))
            for k in sorted(set(half.values()))
        }
    )
    parts = [
        F.coalesce(F.lead(f"_d{half[abs(dy)]}", dy).over(along_columns()), F.lit(0))
        for dy in range(-r, r + 1)
    ]
    best = F.greatest(*parts) if len(parts) > 1 else parts[0]
    return px.withColumn(out, best > 0).drop(*[f"_d{k}" for k in set(half.values())])


def with_ranks(px: DataFrame, value: str, wanted: dict[str, float]) -> DataFrame:
    """Add exact quantiles of a column per image (nulls do not count), by interpolation between ranks.

    Ranks come from the column's order inside the image's partition: a sort that can spill and two
    values kept, where the percentile aggregate holds every different value of an image.
    """
    whole = W.partitionBy("image_id")
    ranked = px.withColumns({"_rank": F.row_number().over(whole.orderBy(F.asc_nulls_last(value))), "_count": F.count(value).over(whole)})
    at = {name: share * (F.col("_count") - 1) for name, share in wanted.items()}

    def value_at(rank: Column) -> Column:
        return F.max(F.when(F.col("_rank") == rank + 1, F.col(value))).over(whole)

    ends = {f"_{k}_{n}": value_at(fn(a)) for n, a in at.items() for k, fn in (("lo", F.floor), ("hi", F.ceil))}
    between = {
        n: F.when(F.floor(a) == F.ceil(a), F.col(f"_lo_{n}")).otherwise((F.ceil(a) - a) * F.col(f"_lo_{n}") + (a - F.floor(a)) * F.col(f"_hi_{n}"))
        for n, a in at.items()
    }
    return ranked.withColumns(ends).withColumns(between).drop("_rank", "_count", *ends)


# -------------------------------------------------------------------- quality


def exposure(px: DataFrame) -> DataFrame:
    """Brightness and contrast of the grey image."""
    return with_gray(px).groupBy("image_id").agg(*_exposure())


def _exposure() -> list[Column]:
    return [F.avg("gray").alias("brightness"), F.stddev_pop("gray").alias("contrast")]


def _laplacian() -> Column:
    """Four-neighbour Laplacian of a padded grey image."""
    rows, cols = along_rows(), along_columns()
    return (
        F.lag("gray").over(rows) + F.lead("gray").over(rows)
        + F.lag("gray").over(cols) + F.lead("gray").over(cols) - 4.0 * F.col("gray")
    )


def sharpness(px: DataFrame) -> DataFrame:
    """Variance of the four-neighbour Laplacian (needs colocated pixels)."""
    out = unpad(pad(with_gray(px), 1).withColumn("_lap", _laplacian()))
    return out.groupBy("image_id").agg(F.var_pop("_lap").alias("sharpness"))


def _opponents(channel_order: str) -> dict[str, Column]:
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    if channel_order == "reference":
        r, b = b, r
    return {"_rg": F.abs(r - g), "_yb": F.abs(0.5 * (r + g) - b)}


def _colorfulness() -> Column:
    spread = F.sqrt(F.pow(F.stddev_pop("_rg"), F.lit(2)) + F.pow(F.stddev_pop("_yb"), F.lit(2)))
    level = F.sqrt(F.pow(F.avg("_rg"), F.lit(2)) + F.pow(F.avg("_yb"), F.lit(2)))
    return (spread + 0.3 * level).alias("colorfulness")


def colorfulness(px: DataFrame, channel_order: str = "reference") -> DataFrame:
    """Opponent-channel colourfulness.

    ``channel_order='reference'`` reads red and blue under swapped names, which is
    how the published figures were produced; ``'rgb'`` is the textbook formula.
    """
    return px.withColumns(_opponents(channel_order)).groupBy("image_id").agg(_colorfulness())


def _share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def _skin() -> Column:
    half = F.col("hue") / 2.0
    hue_ok = F.lit(False)
    for low, high in SKIN_HSV:
        hue_ok = hue_ok | half.between(low, high)
    hsv = hue_ok & (F.col("sat") >= SKIN_SAT_MIN) & (F.col("val") >= SKIN_VAL_MIN)
    chroma = F.col("cr").between(*SKIN_CR) & F.col("cb").between(*SKIN_CB)
    return _share(hsv | chroma).alias("skin")


def skin_fraction(px: DataFrame) -> DataFrame:
    """Share of pixels inside the union of the HSV and the chroma envelopes."""
    return with_ycrcb(with_hsv(px)).groupBy("image_id").agg(_skin())


def _glare(val_min: float, sat_max: float) -> Column:
    return _share((F.col("val") > val_min) & (F.col("sat") < sat_max)).alias("glare")


def glare_fraction(px: DataFrame, val_min: float = 245, sat_max: float = 30) -> DataFrame:
    return with_hsv(px).groupBy("image_id").agg(_glare(val_min, sat_max))


def texture(px: DataFrame, size: int = 9) -> DataFrame:
    """Spread of the local deviation (needs colocated pixels)."""
    return local_std(with_gray(px), size).groupBy("image_id").agg(
        F.stddev_pop("local_std").alias("texture")
    )


def quality_measures(px: DataFrame, stencil: int = 9) -> DataFrame:
    """All quality measures in one pass over colocated pixels, one row per image."""
    g = F.col("gray")
    out = with_ycrcb(with_hsv(with_gray(px))).withColumns(
        {**_opponents("reference"), "_m": g, "_m2": g * g}
    )
    out = pad(out, stencil // 2).withColumn("_lap", _laplacian())
    for axis in (along_rows(), along_columns()):
        frame = axis.rowsBetween(-(stencil // 2), stencil // 2)
        out = out.withColumns({c: F.avg(c).over(frame) for c in ("_m", "_m2")})
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("_m2") - F.col("_m") * F.col("_m")))
    return unpad(out).groupBy("image_id").agg(
        F.first("w").alias("w"), F.first("h").alias("h"),
        F.least(F.first("w"), F.first("h")).alias("min_dim"),
        *_exposure(), F.var_pop("_lap").alias("sharpness"), _colorfulness(), _skin(),
        _glare(245, 30), F.stddev_pop(spread).alias("texture"),
    )


def dark_border(px: DataFrame, dark: float = 28, band: int | None = None) -> DataFrame:
    """Share of near-black pixels in the four border bands; corners count twice."""
    width = (
        F.greatest(F.lit(2), F.floor(F.least("h", "w") / 12).cast("int"))
        if band is None
        else F.lit(band)
    )
    times = sum(
        (c.cast("int") for c in (
            F.col("y") >= F.col("h") - width, F.col("x") < width, F.col("x") >= F.col("w") - width
        )),
        start=(F.col("y") < width).cast("int"),
    )
    edge = with_gray(px).withColumn("_t", times).filter("_t > 0")
    return edge.groupBy("image_id").agg(
        ratio(F.sum(F.when(F.col("gray") < dark, F.col("_t")).otherwise(0)), F.sum("_t")).alias(
            "dark_border"
        )
    )


# ------------------------------------------------------------ colour constancy


def gray_world_gains(px: DataFrame, power: int = 6) -> DataFrame:
    """Shades-of-Gray gains per image."""
    norms = px.groupBy("image_id").agg(*[_power_mean(c, power).alias(f"_n{c}") for c in "rgb"])
    return _with_gains(norms).select("image_id", *[f"gain_{c}" for c in "rgb"])


def _power_mean(channel: str, power: int, over=None) -> Column:
    mean = F.avg(F.pow(F.col(channel), F.lit(float(power))))
    return F.pow(mean if over is None else mean.over(over), F.lit(1.0 / power))


def _with_gains(norms: DataFrame) -> DataFrame:
    squares = [F.col(f"_n{c}") * F.col(f"_n{c}") for c in "rgb"]
    norms = norms.withColumn("_all", F.sqrt(squares[0] + squares[1] + squares[2]))

    def gain(c: str) -> Column:
        return F.when(F.col("_all") <= 1e-6, 1.0).otherwise(
            (F.col("_all") / math.sqrt(3.0)) / F.greatest(F.col(f"_n{c}"), F.lit(1e-6))
        )

    return norms.withColumns({f"gain_{c}": gain(c) for c in "rgb"}).drop(
        "_all", *[f"_n{c}" for c in "rgb"]
    )


def correct_colors(px: DataFrame, power: int = 6) -> DataFrame:
    """Scale every channel by its image's gain and cut back to whole 0..255.

    The gains are window values over the image, so the pixels are read once.
    """
    whole = W.partitionBy("image_id")
    joined = _with_gains(px.withColumns({f"_n{c}": _power_mean(c, power, whole) for c in "rgb"}))
    fixed = {
        # The small offset keeps products that are whole but for rounding noise whole.
        c: F.floor(F.least(F.lit(255.0), F.col(c) * F.col(f"gain_{c}")) + 1e-6).cast("double")
        for c in "rgb"
    }
    return joined.withColumns(fixed).drop(*[f"gain_{c}" for c in "rgb"])


# ------------------------------------------------------------------- features


def channel_histograms(px: DataFrame, bins: int = 32) -> DataFrame:
    """Counts per channel and bin, as one array of 3 * bins numbers per image."""
    long = px.select(
        "image_id", F.posexplode(F.array("r", "g", "b")).alias("channel", "value")
    ).select(
        "image_id",
        (F.col("channel") * bins + F.least(F.lit(bins - 1), F.floor(F.col("value") * bins / 256.0))).alias("slot"),
    )
    counts = long.groupBy("image_id", "slot").agg(F.count(F.lit(1)).alias("n"))
    # At most 3 * bins entries per image.
    table = counts.groupBy("image_id").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("m")
    )
    return table.select(
        "image_id",
        F.transform(
            F.sequence(F.lit(0), F.lit(3 * bins - 1)),
            lambda s: F.coalesce(F.element_at("m", s.cast("long")), F.lit(0).cast("long")),
        ).alias("histogram"),
    )


def oriented_gradients(px: DataFrame, cell: int = 8, orientations: int = 8, block: int = 2) -> DataFrame:
    """Block-normalised gradient histograms: (image_id, by, bx, features).

    Needs colocated pixels. Every cell enters the few blocks it belongs to, so the
    block step is a grouping of cells, not a join.
    """
    step = 180.0 / orientations
    out = px.withColumn("_l", luma(F.col("r"), F.col("g"), F.col("b")))

    def slope(axis, at: str, size: str) -> Column:
        inner = (F.col(at) > 0) & (F.col(at) < F.col(size) - 1)
        return F.when(inner, F.lead("_l").over(axis) - F.lag("_l").over(axis)).otherwise(0.0)

    out = out.withColumns(
        {"_gx": slope(along_rows(), "x", "w"), "_gy": slope(along_columns(), "y", "h")}
    )
    degrees = (F.degrees(F.atan2("_gy", "_gx")) + 360.0) % 180.0
    cells = out.select(
        "image_id",
        F.floor(F.col("y") / cell).alias("cy"), F.floor(F.col("x") / cell).alias("cx"),
        (F.floor((degrees + 1e-9) / step) % orientations).alias("bin"),
        F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy")).alias("mag"),
        F.floor(F.col("h") / cell).alias("rows"), F.floor(F.col("w") / cell).alias("cols"),
    ).filter("cy < rows AND cx < cols")
    hist = cells.groupBy("image_id", "cy", "cx", "rows", "cols").agg(
        *[
            (F.sum(F.when(F.col("bin") == k, F.col("mag")).otherwise(0.0)) / float(cell * cell)).alias(f"_h{k}")
            for k in range(orientations)
        ]
    ).withColumn("hist", F.array(*[f"_h{k}" for k in range(orientations)]))
    spots = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(block) for dx in range(block)])
    member = hist.select("image_id", "cy", "cx", "rows", "cols", "hist", F.explode(spots).alias("s")).select(
        "image_id", (F.col("cy") - F.col("s.dy")).alias("by"), (F.col("cx") - F.col("s.dx")).alias("bx"),
        F.struct("cy", "cx", "hist").alias("c"), "rows", "cols",
    ).filter(f"by >= 0 AND bx >= 0 AND by <= rows - {block} AND bx <= cols - {block}")
    blocks = member.groupBy("image_id", "by", "bx").agg(F.array_sort(F.collect_list("c")).alias("cells"))
    raw = blocks.withColumn("v", F.flatten(F.transform("cells", lambda c: c["hist"])))

    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    scaled = F.transform("v", lambda x: x / F.col("_norm"))
    clipped = F.transform("v", lambda x: F.least(x, F.lit(0.2)))
    raw = raw.withColumn("_norm", F.sqrt(squares + 1e-10)).withColumn("v", scaled)
    raw = raw.withColumn("v", clipped)
    raw = raw.withColumn("_norm", F.sqrt(squares + 1e-10)).withColumn("v", scaled)
    return raw.select("image_id", "by", "bx", F.col("v").alias("features"))


# ----------------------------------------------------------------- transforms


def center_crop(px: DataFrame) -> DataFrame:
    """Largest centred square."""
    side = F.least("w", "h")
    top = F.floor((F.col("h") - side) / 2).cast("int")
    left = F.floor((F.col("w") - side) / 2).cast("int")
    inside = (F.col("y") >= top) & (F.col("y") < top + side) & (F.col("x") >= left) & (F.col("x") < left + side)
    return px.filter(inside).withColumns(
        {"y": F.col("y") - top, "x": F.col("x") - left, "w": side, "h": side}
    )


def limit_dimension(px: DataFrame, max_dim: int = MAX_INPUT_DIM) -> DataFrame:
    """Shrink by whole-number block means until the longest side fits."""
    step = F.ceil(F.greatest("w", "h") / max_dim).cast("int")
    return (
        px.withColumn("_s", step)
        .groupBy(
            "image_id",
            F.ceil(F.col("w") / F.col("_s")).cast("int").alias("w"),
            F.ceil(F.col("h") / F.col("_s")).cast("int").alias("h"),
            F.floor(F.col("y") / F.col("_s")).cast("int").alias("y"),
            F.floor(F.col("x") / F.col("_s")).cast("int").alias("x"),
        )
        .agg(*[F.avg(c).alias(c) for c in "rgb"])
    )


def dihedral_views(px: DataFrame, n: int = 8) -> DataFrame:
    """The first ``n`` symmetries of the square; adds ``view``.

    Views 4..7 mirror left-right first; view mod 4 counts quarter turns.
    """
    views = []
    for view in range(max(1, min(int(n), 8))):
        y, x, h, w = F.col("y"), F.col("x"), F.col("h"), F.col("w")
        if view >= 4:
            x = w - 1 - x
        for _ in range(view % 4):
            y, x, h, w = w - 1 - x, y, w, h
        views.append(
            F.struct(F.lit(view).alias("view"), y.alias("y"), x.alias("x"), h.alias("h"), w.alias("w"))
        )
    long = px.withColumn("_v", F.explode(F.array(*views))).drop("y", "x", "h", "w")
    return long.select("*", "_v.*").drop("_v")
