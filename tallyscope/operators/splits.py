"""Leak-free splitting, leakage audit, class balance and sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.basic import order_key, ratio, uniform
from ..functions.texts import LEAK_VERDICT
from .ranks import class_ranks, join_class, key_cuts

SPLITS = ("train", "val", "test")
# Into how many parts [0, 1) is cut to meet draws with class intervals.
SLICES = 4096


def _quota(n: Column, fraction: float) -> Column:
    """max(1, half-even share) of n; nothing from classes of one or two."""
    if fraction <= 0:
        return F.lit(0).cast("long")
    share = F.rint(n * F.lit(float(fraction))).cast("long")
    return F.when(n > 2, F.greatest(F.lit(1).cast("long"), share)).otherwise(F.lit(0).cast("long"))


def _split_positions(val: float, test: float):
    def positions(n: Column) -> dict[str, Column]:
        n_test, n_val = _quota(n, test), _quota(n, val)
        crowded = n_test + n_val >= n
        # Tiny class: at least one member stays in train.
        small_test = F.least(n_test, F.greatest(F.lit(0), n - 2))
        small_val = F.least(n_val, F.greatest(F.lit(0), n - 1 - small_test))
        final_test = F.when(crowded, small_test).otherwise(n_test)
        final_val = F.when(crowded, small_val).otherwise(n_val)
        return {
            "_test_cut": final_test,
            "_val_cut": F.when(final_val > 0, final_test + final_val).otherwise(F.lit(0)),
        }

    return positions


def _split(df, unit, cls, val, test, seed, unique) -> DataFrame:
    key = order_key(seed, F.col(cls), F.col(unit))
    keys = df.select(cls, key.alias("_key"))
    if not unique:
        keys = keys.distinct()
    cuts = key_cuts(keys, cls, "_key", _split_positions(val, test))
    split = (
        F.when(F.col("_key") <= F.col("_test_cut"), "test")
        .when(F.col("_key") <= F.col("_val_cut"), "val")
        .otherwise("train")
    )
    return (
        join_class(df.withColumn("_key", key), cuts, [cls], "left")
        .withColumn("split", split)
        .drop("_key", "_test_cut", "_val_cut")
    )


def grouped_split(
    df: DataFrame,
    group: str,
    cls: str,
    val: float = 0.15,
    test: float = 0.15,
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: whole groups of each class go to train, val or test.

    Only the two cut-off keys of each class are computed; every row then decides for
    itself by comparing its group's key. Every row gets a split; a null class is a class.
    """
    return _split(df, group, cls, val, test, seed, unique=False)


def itemwise_split(
    df: DataFrame,
    item: str,
    cls: str,
    val: float = 0.15,
    test: float = 0.15,
    seed: int = 42,
) -> DataFrame:
    """Stratified split over items, blind to groups (kept to measure its leak).

    An item is one row, so nothing needs to be made distinct: only counts per class
    and the few rows next to the cuts are shuffled.
    """
    return _split(df, item, cls, val, test, seed, unique=True)


def sample_per_class(df: DataFrame, item: str, cls: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows of each class, the null class too (all where there are fewer).

    Repeated items have one key: at the cut as many of them stay as are wanted.
    """
    key = order_key(seed, F.col(cls), F.col(item))
    keys = df.select(cls, key.alias("_key"))
    cuts = key_cuts(keys, cls, "_key", lambda size: {"_cut_at": F.least(size, F.lit(n))})
    upto = join_class(df.withColumn("_key", key), cuts, [cls]).filter(F.col("_key") <= F.col("_cut_at"))
    # n rows a class, and what equals the last of them.
    return class_ranks(upto, cls, "_key", "_rank").filter(F.col("_rank") <= n).drop("_key", "_cut_at", "_rank")


# ------------------------------------------------------------------ leakage


def _group_counts(df_split: DataFrame, group: str, cls: str) -> DataFrame:
    """Rows per (group, class) and split, with the group's train rows alongside.

    Counting first means a group that holds a third of all rows travels as a
    handful of counts.
    """
    counted = df_split.groupBy(group, cls).agg(
        *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in SPLITS]
    )
    return counted.withColumn("_train", F.sum("n_train").over(W.partitionBy(group)))


def leakage(df_split: DataFrame, group: str, cls: str, by_class: bool = True) -> DataFrame:
    """Val/test rows whose group also sits in train, overall and by class."""
    per_side = _group_counts(df_split, group, cls).select(
        group,
        F.col(cls).alias("cls"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(s).alias("split"), F.col(f"n_{s}").alias("n"))
                    for s in ("val", "test")
                ]
            )
        ).alias("_e"),
        (F.col("_train") > 0).alias("_leaky"),
    ).select(group, "cls", "_e.split", "_e.n", "_leaky").filter("n > 0")
    measures = [
        F.sum("n").alias("items"),
        F.sum(F.when(F.col("_leaky"), F.col("n")).otherwise(0)).alias("leaked"),
    ]
    # Groups are counted per class first, so no distinct over all rows is needed.
    if by_class:
        out = per_side.groupBy("split", "cls").agg(*measures)
    else:
        out = per_side.groupBy("split").agg(*measures)
    return out.withColumn("leaked_pct", F.round(ratio(F.col("leaked"), F.col("items")) * 100, 2))


def leakage_report(
    item_split: DataFrame, group_split: DataFrame, group: str, cls: str, severe: float = 50.0
) -> DataFrame:
    """Both splits side by side, by class, with the verdict text."""
    sides = [
        leakage(frame, group, cls).withColumn("method", F.lit(name))
        for name, frame in (("itemwise", item_split), ("grouped", group_split))
    ]
    rows = sides[0].unionByName(sides[1])
    # Few rows per (method, split): one per class.
    whole = W.partitionBy("method", "split")
    per_method = W.partitionBy("split")
    overall = F.round(
        ratio(F.sum("leaked").over(whole), F.sum("items").over(whole)) * 100, 2
    )
    rows = rows.withColumn("overall_pct", overall).withColumn(
        "severe", F.col("leaked_pct") >= severe
    )
    pct = {
        m: F.max(F.when(F.col("method") == m, F.col("overall_pct"))).over(per_method)
        for m in ("itemwise", "grouped")
    }
    return rows.withColumn(
        "verdict",
        F.format_string(
            LEAK_VERDICT, pct["itemwise"], F.col("split"), pct["grouped"],
        ),
    )


def allocation(df_split: DataFrame, item: str, group: str) -> DataFrame:
    """Items allocated, items allocated twice, groups in more than one split."""
    items = df_split.groupBy(item).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("n") > 1).alias("items_twice"),
    )
    groups = (
        df_split.groupBy(group, "split").count()
        .groupBy(group).agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.count(F.lit(1)).alias("groups"),
            F.count_if(F.col("n") > 1).alias("groups_in_two_splits"),
        )
    )
    # Two one-row results.
    both = items.withColumn("_g", groups.select(F.struct(*groups.columns)).scalar())
    return both.select("items", "items_twice", "_g.*")


def unallocated(df: DataFrame, df_split: DataFrame, item: str) -> DataFrame:
    """Input items missing from the split."""
    return df.select(item).join(df_split.select(item), item, "left_anti")


def split_overlap(df_split: DataFrame, group: str) -> DataFrame:
    """Groups shared by each pair of splits.

    The intersections of all pairs come from one grouping: a group is in a split when
    it has a row there.
    """
    per_group = df_split.groupBy(group).agg(
        *[F.bool_or(F.col("split") == s).alias(s) for s in SPLITS]
    )
    pairs = (("train", "val"), ("train", "test"), ("val", "test"))
    counts = per_group.agg(*[F.count_if(F.col(a) & F.col(b)).alias(f"{a}-{b}") for a, b in pairs])
    names = [f"{a}-{b}" for a, b in pairs]
    return counts.unpivot([], names, "pair", "shared_groups")


def split_union(df: DataFrame, df_split: DataFrame, item: str) -> DataFrame:
    """Does the union of the three splits give back the input?"""
    union = df_split.filter(F.col("split").isin(*SPLITS)).select(item)
    tagged = union.select(item, F.lit(1).alias("_s")).unionByName(
        df.select(item, F.lit(0).alias("_s"))
    )
    return (
        tagged.groupBy(item)
        .agg(F.count_if(F.col("_s") == 0).alias("_in"), F.count_if(F.col("_s") == 1).alias("_out"))
        .agg(
            F.sum("_in").alias("input_items"),
            F.sum("_out").alias("union_items"),
            F.count_if(F.col("_in") != F.col("_out")).alias("mismatched"),
        )
    )


def classes_per_group(df: DataFrame, group: str, cls: str) -> DataFrame:
    """Largest number of classes carried by one group (1 when labels are sound)."""
    return (
        df.groupBy(group, cls).count()
        .groupBy(group).agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.count(F.lit(1)).alias("groups"),
            F.max("n").alias("max_classes"),
            F.count_if(F.col("n") > 1).alias("mixed_groups"),
        )
    )


# ------------------------------------------------------- profile and balance


def profile(df: DataFrame, group: str) -> DataFrame:
    """Rows, groups, repeats and the largest group."""
    out = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("items"),
        F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col("n") > 1).alias("groups_with_repeats"),
        F.max("n").alias("max_per_group"),
    )
    repeats = F.col("items") - F.col("groups")
    return out.withColumn("repeat_items", repeats).withColumn(
        "repeat_pct", F.round(ratio(repeats, F.col("items")) * 100, 2)
    )


def class_share(df: DataFrame, cls: str) -> DataFrame:
    """Count and percentage per class."""
    counts = df.groupBy(cls).agg(F.count(F.lit(1)).alias("items"))
    share = ratio(F.col("items"), F.sum("items").over(W.partitionBy(F.lit(0)))) * 100
    return counts.withColumn("pct", F.round(share, 2))


def describe_splits(df_split: DataFrame, group: str, cls: str, classes: Sequence[str]) -> DataFrame:
    """Items, groups and class counts of each split; ``n_other`` counts rows of any other or no class."""
    counted = df_split.groupBy("split", group, cls).agg(F.count(F.lit(1)).alias("n"))
    per_group = counted.groupBy("split", group).agg(
        F.sum("n").alias("n"),
        *[F.sum(F.when(F.col(cls) == c, F.col("n")).otherwise(0)).alias(f"n_{c}") for c in classes],
        F.sum(F.when(F.coalesce(F.col(cls).isin(*classes), F.lit(False)), 0).otherwise(F.col("n"))).alias("n_other"),
    )
    return per_group.groupBy("split").agg(
        F.sum("n").alias("items"),
        F.count(F.lit(1)).alias("groups"),
        *[F.sum(f"n_{c}").alias(f"n_{c}") for c in (*classes, "other")],
    )


def class_balance(df_split: DataFrame, cls: str) -> DataFrame:
    """Class percentages overall, in train and in test, with the drift."""
    counts = df_split.groupBy(cls).agg(
        F.count(F.lit(1)).alias("_all"),
        *[F.count_if(F.col("split") == s).alias(f"_{s}") for s in ("train", "test")],
    )
    everything = W.partitionBy(F.lit(0))

    def pct(c: str) -> Column:
        return ratio(F.col(c), F.sum(c).over(everything)) * 100

    out = counts.select(
        cls,
        pct("_all").alias("overall_pct"),
        pct("_train").alias("train_pct"),
        pct("_test").alias("test_pct"),
    )
    drift = F.greatest(
        F.abs(F.col("train_pct") - F.col("overall_pct")),
        F.abs(F.col("test_pct") - F.col("overall_pct")),
    )
    return out.select(
        cls,
        *[F.round(c, 2).alias(c) for c in ("overall_pct", "train_pct", "test_pct")],
        F.round(drift, 6).alias("drift"),
        F.round(F.max(drift).over(everything), 6).alias("max_drift"),
    )


def class_weights(df: DataFrame, cls: str, classes: DataFrame) -> DataFrame:
    """Inverse-frequency weights; ``classes`` is the (small) class dimension.

    Classes without rows count as one.
    """
    counts = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_n"))
    floored = classes.select(cls).join(counts, cls, "left").withColumn(
        "n", F.greatest(F.lit(1).cast("long"), F.coalesce("_n", F.lit(0).cast("long")))
    )
    everything = W.partitionBy(F.lit(0))
    weight = F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n"))
    return floored.select(cls, "n", weight.alias("weight"))


def weighted_sample(
    df: DataFrame, item: str, cls: str, weights: DataFrame, draws: DataFrame, draw: str, seed: int = 42
) -> DataFrame:
    """Sampling with replacement, item weight = its class weight.

    ``draws`` has one row per draw. All items of a class weigh the same, so the
    cumulative-weight interval a draw falls into is found in two exact steps: the
    class interval, then the rank inside the class, which is an equi-join. Intervals
    are met by slices of [0, 1): each is there once per slice that it touches (classes
    plus slices at most), so draws are joined by slice, however many classes there are.
    Each interval begins where the one before ends: no draw falls between two.
    """
    sizes = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_n"))
    mass = join_class(sizes, weights.select(cls, "weight"), [cls]).withColumn("_mass", F.col("_n") * F.col("weight")).filter("_mass > 0")
    everything = W.partitionBy(F.lit(0))
    upto = everything.orderBy(cls)
    ends = mass.select(cls, "_n", (F.sum("_mass").over(upto) / F.sum("_mass").over(everything)).alias("_end"))
    intervals = ends.select(
        cls, "_n",
        F.coalesce(F.lag("_end").over(upto), F.lit(0.0)).alias("_lo"),
        F.when(F.lead("_end").over(upto).isNull(), 1.0).otherwise(F.col("_end")).alias("_hi"),
    )
    last = F.least(F.floor(F.col("_hi") * SLICES), F.lit(SLICES - 1))
    sliced = intervals.withColumn("_slice", F.explode(F.sequence(F.least(F.floor(F.col("_lo") * SLICES), last), last)))
    u = uniform(seed, F.col(draw))
    thrown = draws.select(draw, u.alias("_u")).withColumn("_slice", F.floor(F.col("_u") * SLICES))
    located = thrown.join(sliced, "_slice").filter("_u >= _lo AND _u < _hi").select(
        draw, cls,
        F.least(F.col("_n"), F.floor((F.col("_u") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_n")) + 1).alias("_rank"),
    )
    key = order_key(seed, F.col(cls), F.col(item))
    ranked = class_ranks(df.select(item, cls, key.alias("_key")), cls, "_key", "_rank").drop("_key")
    return join_class(located, ranked.withColumnRenamed(item, "_item"), [cls, "_rank"]).select(draw, F.col("_item").alias(item), cls)
