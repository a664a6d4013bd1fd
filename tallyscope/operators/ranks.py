"""Exact per-class ranks without sorting a whole class in one task.

A class may hold most of the rows, so ``row_number() over (partition by class)``
would put them all into one task. Keys here are md5 based and hence spread evenly
over their leading hex digits: counting per (class, leading digits) tells which
slice holds a wanted rank, and only within a slice are rows ever sorted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

def join_class(df: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null (a missing class is a class of its own).

    Which side is sent to all executors is left to adaptive execution, which knows sizes.
    """
    names = {c: f"_on_{c}" for c in on}
    other = lookup.withColumnsRenamed(names)
    same = F.lit(True)
    for c, renamed in names.items():
        same = same & df[c].eqNullSafe(other[renamed])
    return df.join(other, same, how).drop(*names.values())


def key_cuts(
    keys: DataFrame,
    cls: str,
    key: str,
    wanted: Callable[[Column], dict[str, Column]],
    digits: int = 4,
) -> DataFrame:
    """The key standing at given 1-based positions of each class.

    ``wanted`` maps the class size to ``{cut name: position}``; positions below 1
    give a null cut. Result: one row per class, one column per cut.
    """
    bucketed = keys.select(cls, key, F.substring(key, 1, digits).alias("_slice"))
    in_class = W.partitionBy(cls)
    counts = (
        bucketed.groupBy(cls, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(in_class.orderBy("_slice")))
        .withColumn("_total", F.sum("_n").over(in_class))
    )
    positions = wanted(F.col("_total"))
    edges = (
        counts.withColumn(
            "_w",
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(n).alias("cut"), p.cast("long").alias("pos"))
                        for n, p in positions.items()
                    ]
                )
            ),
        )
        .filter("_w.pos >= 1 AND _w.pos <= _upto AND _w.pos > _upto - _n")
        .select(
            cls,
            "_slice",
            F.col("_w.cut").alias("_cut"),
            (F.col("_w.pos") - (F.col("_upto") - F.col("_n"))).alias("_k"),
        )
    )
    in_slice = W.partitionBy(cls, "_slice", "_cut").orderBy(key)
    hits = (
        join_class(bucketed, edges, [cls, "_slice"])
        .withColumn("_rn", F.row_number().over(in_slice))
        .filter("_rn = _k")
    )
    return hits.groupBy(cls).agg(
        *[F.max(F.when(F.col("_cut") == n, F.col(key))).alias(n) for n in positions]
    )


def class_ranks(keys: DataFrame, cls: str, key: str, rank: str, digits: int = 3) -> DataFrame:
    """1-based rank of every key within its class, sorted slice by slice."""
    bucketed = keys.withColumn("_slice", F.substring(key, 1, digits))
    before = W.partitionBy(cls).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(cls, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    in_slice = W.partitionBy(cls, "_slice").orderBy(key)
    return (
        join_class(bucketed.withColumn("_rn", F.row_number().over(in_slice)), offsets, [cls, "_slice"])
        .withColumn(rank, F.col("_rn") + F.col("_off"))
        .drop("_slice", "_rn", "_off")
    )
