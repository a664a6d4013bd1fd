"""Connected parts of a mask: row runs as nodes, contraction with pointer jumping over their links.

Stretches of equal pixels in a row are the nodes, touching runs the links, so a graph is as
large as the picture's outline, not its area. All pictures are solved together: in each round
every node takes the smallest neighbour below it, chains of such steps are shortened by
joining them with themselves, and links are rewritten in the new names until none is left.
A node is never compared with more than its own neighbours, and the number of rounds grows
with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.basic import by_sort
from ..session import stored
from .raster import along_rows

# ---- fixed values -----------------------------------------------------------
MIN_PART_SHARE = 0.002
SIZE_WEIGHT, CENTRE_WEIGHT = 0.35, 0.65
# ---- end of fixed values ----------------------------------------------------


def _fresh(flag: str) -> Column:
    """Whether a pixel begins a stretch of equal ``flag`` in its row."""
    return F.coalesce(F.lag(flag).over(along_rows()) != F.col(flag), F.lit(True))


def with_runs(px: DataFrame, flag: str = "is_mask") -> DataFrame:
    """Add ``run``: the number (y * w + x) of the first pixel of the row's stretch of equal ``flag``."""
    first = F.when(F.col("_fresh"), F.col("y").cast("long") * F.col("w") + F.col("x"))
    return px.withColumn("_fresh", _fresh(flag)).withColumn("run", F.max(first).over(along_rows())).drop("_fresh")


def runs_of(px: DataFrame, flag: str = "is_mask") -> DataFrame:
    """One row per stretch of equal ``flag`` in a row: image_id, node (number of its first pixel), on
    (the flag), w, h, y, x0, x1 (first and last pixel)."""
    first = px.select("image_id", "w", "h", "y", "x", F.col(flag).alias("on"), _fresh(flag).alias("_fresh")).filter("_fresh")
    return first.select(
        "image_id", (F.col("y").cast("long") * F.col("w") + F.col("x")).alias("node"), "on", "w", "h", "y", F.col("x").alias("x0"),
        (F.coalesce(F.lead("x").over(along_rows()), F.col("w")) - 1).alias("x1"),
    )


def run_links(runs: DataFrame) -> DataFrame:
    """Touching runs: image_id, a, b, their flags, and whether they touch along an edge (``straight``).

    Of two runs that touch in neighbouring rows one begins in, or right after, the other. So it is
    enough that each run finds, in the row above and in the row below, the run that holds its first
    pixel's column and the one that holds the column before: the last ones that begin up to there.
    """
    me = F.struct("node", "on", "x1").alias("me")
    sides = F.explode(F.array(F.struct(F.col("y").alias("row"), F.lit(True).alias("lower")), F.struct((F.col("y") + 1).alias("row"), F.lit(False).alias("lower"))))
    both = runs.select("image_id", F.col("x0").cast("long").alias("x0"), me, sides.alias("side")).select("image_id", "x0", "me", "side.row", "side.lower")
    line = W.partitionBy("image_id", "row").orderBy("x0")

    def last(lower: bool, upto: int) -> Column:
        return F.last(F.when(F.col("lower") == lower, F.col("me")), ignorenulls=True).over(line.rangeBetween(W.unboundedPreceding, upto))

    def other(upto: int) -> Column:
        return F.when(F.col("lower"), last(False, upto)).otherwise(last(True, upto))

    found = both.withColumns({"here": other(0), "before": other(-1)})
    near = F.array(F.struct(F.col("here").alias("to"), F.lit(True).alias("straight")), F.struct(F.col("before").alias("to"), (F.col("before.x1") >= F.col("x0")).alias("straight")))
    upright = found.select("image_id", "me", F.explode(near).alias("side")).select(
        "image_id", F.col("me.node").alias("a"), F.col("side.to.node").alias("b"), F.col("me.on").alias("on_a"), F.col("side.to.on").alias("on_b"), "side.straight"
    ).filter("b IS NOT NULL")
    beside = runs.select("image_id", F.col("node").alias("a"), F.lag("node").over(W.partitionBy("image_id", "y").orderBy("x0")).alias("b"), F.col("on").alias("on_a"), (~F.col("on")).alias("on_b"), F.lit(True).alias("straight"))
    return upright.unionByName(beside.filter("b IS NOT NULL"))


def connected(nodes: DataFrame, links: DataFrame, name: str = "part") -> DataFrame:
    """nodes (image_id, node, ...) with ``part``, the smallest node that each is connected with.

    links: image_id, a, b between nodes, in any order and number.
    """
    def joined(frame: DataFrame, steps: DataFrame, column: str) -> DataFrame:
        """The column's nodes replaced by where their steps lead."""
        to = steps.select("image_id", F.col("a").alias(column), F.col("b").alias("_to"))
        out = frame.join(by_sort(to), ["image_id", column], "left")
        return out.withColumn(column, F.coalesce("_to", column)).drop("_to")

    def down(frame: DataFrame) -> DataFrame:
        return frame.filter("a <> b").select("image_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    marked = nodes.withColumn(name, F.col("node"))
    left = stored(down(links), "links")
    while not left.isEmpty():
        steps = stored(left.groupBy("image_id", "a").agg(F.min("b").alias("b")), "steps")
        # Chains are followed to their ends: each join with itself doubles the steps taken.
        while not steps.join(by_sort(steps.select("image_id", F.col("a").alias("b"))), ["image_id", "b"], "left_semi").isEmpty():
            for _ in range(3):
                steps = joined(steps, steps, "b")
            steps = stored(steps.select("image_id", "a", "b"), "steps")
        marked = stored(joined(marked, steps, name).select(*nodes.columns, name), "marked")
        left = stored(down(joined(joined(left, steps, "a"), steps, "b")), "links")
    return marked


def _area() -> Column:
    return (F.col("x1") - F.col("x0") + 1).cast("long")


def parts(px: DataFrame, flag: str = "is_mask") -> DataFrame:
    """Parts of the true pixels of ``flag`` (touching at corners too): image_id, part, area."""
    runs = stored(runs_of(px, flag), "runs")
    marked = connected(runs.filter("on"), run_links(runs).filter("on_a AND on_b"))
    return marked.groupBy("image_id", "part").agg(F.sum(_area()).alias("area"))


def filled_parts(px: DataFrame) -> DataFrame:
    """Runs of the mask with its holes filled, as in ``runs_of``, with their ``part``.

    A hole is background (touching along edges) that does not reach the picture's frame; parts
    touch at corners too.
    """
    nodes = stored(runs_of(px), "runs")
    links = stored(run_links(nodes), "links")
    around = connected(nodes.filter("NOT on"), links.filter("straight AND NOT on_a AND NOT on_b"), "ground")
    on_frame = (F.col("x0") == 0) | (F.col("y") == 0) | (F.col("x1") == F.col("w") - 1) | (F.col("y") == F.col("h") - 1)
    reach = F.max(on_frame).over(W.partitionBy("image_id", "ground"))
    holes = around.withColumn("_open", reach).filter("NOT _open").select(*nodes.columns)
    filled = stored(nodes.filter("on").unionByName(holes), "filled")
    known = filled.select("image_id", F.col("node").alias("a"))
    inside = links.join(by_sort(known), ["image_id", "a"], "left_semi").join(by_sort(known.withColumnRenamed("a", "b")), ["image_id", "b"], "left_semi")
    return connected(filled, inside)


def scored_parts(filled: DataFrame) -> DataFrame:
    """One row per part: area, filled (pixels of holes), centre, score, and whether it is the one ``picked``.

    The score weighs size by nearness to the picture's centre; parts under a share of the picture
    are not picked, and of equal scores the part that begins first is.
    """
    n = _area()
    sums = filled.groupBy("image_id", "part").agg(
        F.first("w").alias("w"), F.first("h").alias("h"), F.sum(n).alias("area"),
        F.coalesce(F.sum(F.when(~F.col("on"), n)), F.lit(0).cast("long")).alias("filled"),
        F.sum(n * (F.col("x0") + F.col("x1"))).alias("sx2"), F.sum(n * F.col("y")).alias("sy"),
    )
    total = F.col("w").cast("long") * F.col("h")
    cx, cy = F.col("sx2") / F.col("area") / 2, F.col("sy") / F.col("area")
    off = F.sqrt(F.pow(cx - F.col("w") / 2, F.lit(2)) + F.pow(cy - F.col("h") / 2, F.lit(2)))
    far = F.sqrt(F.pow(F.col("w") / 2, F.lit(2)) + F.pow(F.col("h") / 2, F.lit(2)))
    nearness = 1.0 - F.least(F.lit(1.0), F.try_divide(off, far))
    scored = sums.select(
        "image_id", "part", "area", "filled", cx.alias("cx"), cy.alias("cy"),
        F.when(F.col("area") >= MIN_PART_SHARE * total, F.col("area") / total * (SIZE_WEIGHT + CENTRE_WEIGHT * nearness)).alias("score"),
    )
    # Scores are compared at twelve decimals: equal ones do not depend on the order of sums.
    best = F.max(F.when(F.col("score").isNotNull(), F.struct(F.round("score", 12).alias("s"), (-F.col("part")).alias("p")))).over(W.partitionBy("image_id"))
    return scored.withColumn("picked", F.coalesce(best["p"] == -F.col("part"), F.lit(False)))


def picked_mask(px: DataFrame) -> tuple[DataFrame, DataFrame]:
    """px with ``is_mask`` limited to the picked part with its holes filled, and the scored parts.

    Where no part is large enough, the filled mask stays whole; an empty mask stays empty.
    """
    runs = stored(with_runs(px), "pixels")
    filled = filled_parts(runs)
    scored = scored_parts(filled)
    chosen = filled.join(by_sort(scored.select("image_id", "part", "picked")), ["image_id", "part"])
    any_picked = F.max("picked").over(W.partitionBy("image_id"))
    chosen = chosen.withColumn("_any", any_picked).filter("picked OR NOT _any").select("image_id", F.col("node").alias("run"), F.lit(True).alias("_in"))
    out = runs.join(by_sort(chosen), ["image_id", "run"], "left")
    return out.withColumn("is_mask", F.coalesce("_in", F.lit(False))).select(*px.columns), scored


def mask_components(px: DataFrame) -> DataFrame:
    """One row per image: parts of the filled mask, pixels filled, and the picked part's area,
    first pixel and score (null without one); images with an empty mask stay."""
    px = px.select("image_id", "w", "h", "y", "x", "is_mask")
    scored = scored_parts(filled_parts(px))

    def best(c: str):
        return F.max(F.when(F.col("picked"), F.col(c)))

    found = scored.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("filled").alias("filled"), best("part").alias("part"), best("area").alias("area"), best("score").alias("score"),
    )
    ids = px.select("image_id").distinct()
    zero = F.lit(0).cast("long")
    return ids.join(by_sort(found), "image_id", "left").select("image_id", F.coalesce("parts", zero).alias("parts"), F.coalesce("filled", zero).alias("filled"), "part", "area", "score")
