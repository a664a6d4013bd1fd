"""Outline measures of a mask: convex hull, smallest rectangle, perimeter and what follows.

A hull needs only the two outermost pixels of each row, so a picture is reduced to at most
two points a row before its points meet in one array. Perimeter and outlined area are sums
over 2x2 windows: each window holds a known piece of the line through the border pixels'
centres, so no border is walked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.basic import by_sort, clip, ratio
from .raster import along_columns, along_rows
from .raster_shape import every_image


def _cross(a: Column, b: Column, c: Column) -> Column:
    """Twice the area of the triangle, positive for a turn to the left."""
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def _chain(points: Column) -> Column:
    """One half of the hull by the monotone chain.

    What is left of the chain for a new point is a beginning of it: turns towards the point
    are to the left up to some corner and not beyond it.
    """
    def grown(chain: Column, p: Column) -> Column:
        corners = F.sequence(F.lit(2), F.size(chain))
        kept = F.when(F.size(chain) < 2, F.size(chain)).otherwise(
            1 + F.size(F.filter(corners, lambda m: _cross(F.get(chain, m - 2), F.get(chain, m - 1), p) > 0))
        )
        return F.concat(F.slice(chain, F.lit(1), kept), F.array(p))

    return F.aggregate(points, F.slice(points, 1, 0), grown)


def hulls(px: DataFrame) -> DataFrame:
    """Corners of the mask's hull in order: image_id, hull array<struct<x, y>> (whole numbers).

    Images with an empty mask have no row.
    """
    ends = px.filter("is_mask").groupBy("image_id", "y").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    point = lambda c: F.struct(F.col(c).cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    # At most two points a row of the picture.
    gathered = ends.groupBy("image_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(point("x0"), point("x1")))))).alias("_p"))
    halves = gathered.select("image_id", "_p", _chain(F.col("_p")).alias("_lower"), _chain(F.reverse("_p")).alias("_upper"))
    # Each half ends where the other begins.
    ring = F.concat(F.slice("_lower", F.lit(1), F.size("_lower") - 1), F.slice("_upper", F.lit(1), F.size("_upper") - 1))
    return halves.select("image_id", F.when(F.size("_p") < 2, F.col("_p")).otherwise(ring).alias("hull"))


def hull_area(hull: Column) -> Column:
    """Area of the polygon through the corners."""
    n = F.size(hull)
    doubled = F.aggregate(
        F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"),
        lambda acc, i: acc + F.get(hull, i)["x"] * F.get(hull, (i + 1) % n)["y"] - F.get(hull, (i + 1) % n)["x"] * F.get(hull, i)["y"],
    )
    return F.when(n < 3, 0.0).otherwise(F.abs(doubled) / 2.0)


def smallest_rectangles(px: DataFrame) -> DataFrame:
    """The rectangle of least area around the mask: image_id, cx, cy (its centre), ux, uy (direction
    of its longer side), long_side, short_side.

    One side of it lies on a hull edge, so each edge's direction is tried with the hull's extents
    along it and across. Of equal areas the direction of the smaller angle to the rows is taken.
    """
    edged = hulls(px).select("image_id", "hull", F.posexplode("hull").alias("_i", "_a"))
    after = F.get("hull", (F.col("_i") + 1) % F.size("hull"))
    ex, ey = after["x"] - F.col("_a.x"), after["y"] - F.col("_a.y")
    # A single pixel has no edge; its rectangle lies along the rows. Directions point to the right.
    none = (ex == 0) & (ey == 0)
    turn = F.when((ex < 0) | ((ex == 0) & (ey < 0)), -1).otherwise(1)
    edged = edged.select("image_id", "hull", F.when(none, 1).otherwise(ex * turn).cast("long").alias("ex"), (ey * turn).cast("long").alias("ey"))

    def extent(pick, along: Column, across: Column) -> Column:
        return pick(F.transform("hull", lambda p: p["x"] * along + p["y"] * across))

    ex, ey = F.col("ex"), F.col("ey")
    spans = edged.select(
        "image_id", "ex", "ey",
        extent(F.array_min, ex, ey).alias("p0"), extent(F.array_max, ex, ey).alias("p1"), extent(F.array_min, -ey, ex).alias("q0"), extent(F.array_max, -ey, ex).alias("q1"),
    )
    size = ex * ex + ey * ey
    # Extents are whole numbers times the edge's length: areas are compared without rounding of them.
    area = ((F.col("p1") - F.col("p0")) * (F.col("q1") - F.col("q0"))) / size
    best = spans.groupBy("image_id").agg(
        F.min(F.struct(F.round(area, 9).alias("area"), F.round(F.abs(F.atan2(ey.cast("double"), ex.cast("double"))), 9).alias("angle"), (-ey).alias("ney"), "ex", "ey", "p0", "p1", "q0", "q1")).alias("m")
    ).select("image_id", "m.*")
    p, q = (F.col("p0") + F.col("p1")) / 2.0, (F.col("q0") + F.col("q1")) / 2.0
    length = F.sqrt(size.cast("double"))
    first, second = (F.col("p1") - F.col("p0")) / length, (F.col("q1") - F.col("q0")) / length
    along = first >= second
    return best.select(
        "image_id", ((p * ex - q * ey) / size).alias("cx"), ((p * ey + q * ex) / size).alias("cy"),
        F.when(along, ex / length).otherwise(-ey / length).alias("ux"), F.when(along, ey / length).otherwise(ex / length).alias("uy"),
        F.greatest(first, second).alias("long_side"), F.least(first, second).alias("short_side"),
    )


def outline(px: DataFrame) -> DataFrame:
    """Perimeter and area of the lines through the border pixels' centres, from 2x2 windows.

    Three pixels of a window are a diagonal piece and half a square, two beside each other a
    straight piece, two across a diagonal piece on both sides, four a square. Holes count with
    their own line; fill them first for the outer one.
    """
    rows, cols = along_rows(), along_columns()
    off = lambda c: F.coalesce(c, F.lit(0))
    own = px.select("image_id", "w", "h", "y", "x", F.col("is_mask").cast("int").alias("_d"))
    own = own.withColumn("_b", off(F.lag("_d").over(cols)))
    own = own.withColumns({"_c": off(F.lag("_d").over(rows)), "_a": off(F.lag("_b").over(rows))})
    a, b, c, d = (F.col(n) for n in ("_a", "_b", "_c", "_d"))
    held = a + b + c + d
    # Windows over the right and the lower margin hold at most two pixels.
    margins = F.when((F.col("x") == F.col("w") - 1) & (b + d == 2), 1).otherwise(0) + F.when((F.col("y") == F.col("h") - 1) & (c + d == 2), 1).otherwise(0)
    across = (held == 2) & (a == d)
    sums = own.groupBy("image_id").agg(
        F.sum(F.when((held == 2) & ~across, 1).otherwise(0) + margins).alias("straight"),
        F.sum(F.when(held == 3, 1).when(across, 2).otherwise(0)).alias("diagonal"),
        F.sum(F.when(held == 4, 2).when(held == 3, 1).otherwise(0)).alias("halves"),
        F.sum("_d").alias("area"),
    )
    return sums.select(
        "image_id", "area", (F.col("straight") + F.col("diagonal") * math.sqrt(2.0)).alias("perimeter"), (F.col("halves") / 2.0).alias("outlined"),
    )


def shape_descriptors(px: DataFrame) -> DataFrame:
    """Circularity, compactness and solidity of the mask (zeros where it is empty)."""
    area, around = F.greatest("outlined", F.lit(1.0)), F.col("perimeter")
    lines = outline(px).filter("area > 0")
    found = lines.join(by_sort(hulls(px)), "image_id").select(
        "image_id", "perimeter", "outlined", hull_area(F.col("hull")).alias("hull_area"),
        F.when(around > 0, clip(ratio(4.0 * math.pi * area, around * around), 0.0, 1.0)).otherwise(0.0).alias("circularity"),
        (around * around / (4.0 * math.pi * area)).alias("compactness"),
        clip(ratio(area, F.greatest(hull_area(F.col("hull")), F.lit(1.0))), 0.0, 1.0).alias("solidity"),
    )
    none = F.lit(0.0)
    return every_image(px, found, **{c: none for c in ("perimeter", "outlined", "hull_area", "circularity", "compactness", "solidity")})
