"""Evaluation of (target, probs) tables.

Everything that depends on the argmax alone is derived from the class-by-class
counts, so the scored table is aggregated once and the rest works on a few rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.basic import let, literal_array, ratio
from ..functions.scores import confidence, entropy, softmax, top_index
from ..sources.taxonomy import CLASS_CODES, CRITICAL_INDEX, MALIGNANT_FLAGS, classes


def all_rows():
    """Whole-table window; only ever used on tables with a few rows per class."""
    return W.partitionBy(F.lit(0))


def predictions(df: DataFrame) -> DataFrame:
    return df.withColumn("pred", top_index("probs")).withColumn("conf", confidence("probs"))


def confusion_counts(df: DataFrame) -> DataFrame:
    """(target, pred, n), at most K*K rows."""
    return (
        df.select("target", top_index("probs").alias("pred"))
        .groupBy("target", "pred")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _class_dim(spark) -> DataFrame:
    return F.broadcast(classes(spark).select("class_idx", "code", "name"))


def confusion(df: DataFrame, normalized: bool = False) -> DataFrame:
    """True classes as rows, predicted classes as columns (absent ones are 0)."""
    counts = confusion_counts(df)
    wide = counts.groupBy("target").agg(
        F.sum("n").alias("_row"),
        *[
            F.coalesce(F.sum(F.when(F.col("pred") == i, F.col("n"))), F.lit(0)).alias(c)
            for i, c in enumerate(CLASS_CODES)
        ],
    )
    dim = classes(df.sparkSession).select("class_idx", F.col("code").alias("true_code"))
    filled = dim.join(wide, dim.class_idx == wide.target, "left")
    cells = []
    for c in CLASS_CODES:
        n = F.coalesce(F.col(c), F.lit(0))
        if normalized:
            n = F.bround(n / F.greatest(F.lit(1), F.coalesce("_row", F.lit(0))), 4)
        cells.append(n.alias(c))
    return filled.select("true_code", *cells)


def per_class(counts: DataFrame, digits: int | None = 4) -> DataFrame:
    """Precision, recall, specificity, F1 and support from confusion counts."""
    votes = counts.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("target").alias("class_idx"), F.col("n").alias("support"),
                    F.lit(0).cast("long").alias("predicted"),
                    F.when(F.col("target") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"),
                ),
                F.struct(
                    F.col("pred").alias("class_idx"), F.lit(0).cast("long").alias("support"),
                    F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp"),
                ),
            )
        ).alias("v")
    ).select("v.*")
    sums = votes.groupBy("class_idx").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "tp")]
    )
    zero = F.lit(0).cast("long")
    full = _class_dim(counts.sparkSession).join(sums, "class_idx", "left").select(
        "class_idx", "code", "name",
        *[F.coalesce(c, zero).alias(c) for c in ("support", "predicted", "tp")],
    )
    full = full.withColumn("_total", F.sum("support").over(all_rows()))
    fp = F.col("predicted") - F.col("tp")
    negatives = F.col("_total") - F.col("support")
    precision = ratio(F.col("tp"), F.col("predicted"))
    recall = ratio(F.col("tp"), F.col("support"))
    f1 = ratio(2 * precision * recall, precision + recall)
    specificity = ratio(negatives - fp, negatives)

    def shown(c: Column) -> Column:
        return c if digits is None else F.bround(c, digits)

    return full.select(
        "class_idx", "code", "name",
        shown(precision).alias("precision"), shown(recall).alias("recall"),
        shown(specificity).alias("specificity"), shown(f1).alias("f1"),
        "support", "tp", "predicted",
    )


def summary(df: DataFrame) -> DataFrame:
    """Accuracy and averaged scores; averages are taken over rounded class values."""
    return summary_from_counts(confusion_counts(df))


def summary_from_counts(counts: DataFrame) -> DataFrame:
    rows = per_class(counts)
    return rows.agg(
        F.sum("support").alias("items"),
        F.bround(ratio(F.sum("tp"), F.sum("support")), 4).alias("accuracy"),
        F.bround(F.avg("recall"), 4).alias("balanced_accuracy"),
        F.bround(F.avg("f1"), 4).alias("macro_f1"),
        F.bround(ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")), 4).alias(
            "weighted_f1"
        ),
    )


def macro_f1(counts: DataFrame) -> DataFrame:
    """Unrounded macro-F1, the model-selection metric."""
    return per_class(counts, digits=None).agg(F.avg("f1").alias("macro_f1"))


# --------------------------------------------------------------- calibration


def bin_edges(bins: int) -> list[float]:
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def confidence_bin(conf: Column, bins: int = 15) -> Column:
    """0-based index of the bin (lo, hi] holding ``conf``; null at exactly 0.

    The index is computed, not searched, and then corrected against the true
    edges, so large tables need no range join.
    """
    edges = literal_array(bin_edges(bins))
    guess = F.least(
        F.lit(bins - 1), F.greatest(F.lit(0), (F.ceil(conf * bins) - 1).cast("int"))
    )
    fixed = let(
        guess,
        lambda g: F.when(conf <= F.element_at(edges, g + 1), g - 1)
        .when(conf > F.element_at(edges, g + 2), g + 1)
        .otherwise(g),
    )
    return F.when((conf > 0) & (conf <= 1), fixed)


def reliability(df: DataFrame, bins: int = 15) -> DataFrame:
    """One row per bin, empty ones included with null accuracy and confidence."""
    edges = bin_edges(bins)
    scored = predictions(df).select(
        confidence_bin(F.col("conf"), bins).alias("bin"),
        "conf",
        (F.col("pred") == F.col("target")).cast("double").alias("hit"),
    )
    filled = scored.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("hit").alias("acc"), F.avg("conf").alias("mean_conf")
    )
    dim = df.sparkSession.createDataFrame(
        [(i, edges[i], edges[i + 1]) for i in range(bins)], "bin INT, lo DOUBLE, hi DOUBLE"
    )
    joined = dim.join(filled, "bin", "full")
    everything = F.sum(F.coalesce("n", F.lit(0))).over(all_rows())
    gap = ratio(F.coalesce("n", F.lit(0)), everything) * F.abs(F.col("acc") - F.col("mean_conf"))
    return (
        joined.withColumn("_gap", F.coalesce(gap, F.lit(0.0)))
        .filter("bin IS NOT NULL")
        .select(
            "bin", "lo", "hi",
            F.coalesce("n", F.lit(0).cast("long")).alias("n"),
            F.bround("acc", 4).alias("accuracy"),
            F.bround("mean_conf", 4).alias("confidence"),
            F.col("_gap").alias("gap"),
        )
    )


def calibration(df: DataFrame, bins: int = 15) -> DataFrame:
    """Reliability rows with the expected calibration error on each of them."""
    return reliability(df, bins).withColumn("ece", F.sum("gap").over(all_rows()))


def weighted_nll(
    df: DataFrame, weights: Sequence[float] | None = None, label_smoothing: float = 0.0
) -> DataFrame:
    """Class-weighted cross-entropy from logits, averaged by weight."""
    w = literal_array([float(x) for x in (weights or [1.0] * len(CLASS_CODES))])
    logp = F.transform(softmax(F.col("logits")), lambda p: F.log(p))
    k = float(len(CLASS_CODES))
    eps = float(label_smoothing)
    rows = df.select("target", logp.alias("logp")).select(
        F.element_at(w, F.col("target") + 1).alias("wt"),
        (-F.element_at("logp", F.col("target") + 1)).alias("nll"),
        F.aggregate(
            F.zip_with("logp", w, lambda lp, c: -lp * c), F.lit(0.0), lambda s, x: s + x
        ).alias("spread"),
    )
    loss = (1.0 - eps) * F.sum(F.col("wt") * F.col("nll")) + (eps / k) * F.sum("spread")
    return rows.agg(
        F.try_divide(loss, F.sum("wt")).alias("loss"), F.count(F.lit(1)).alias("items")
    )


def focal(df: DataFrame, weights: Sequence[float] | None = None, gamma: float = 2.0) -> DataFrame:
    """Mean focal loss on the weighted cross-entropy."""
    w = literal_array([float(x) for x in (weights or [1.0] * len(CLASS_CODES))])
    at = F.col("target") + 1
    ce = df.select(
        (F.element_at(w, at) * -F.log(F.element_at(softmax(F.col("logits")), at))).alias("ce")
    )
    return ce.agg(F.avg(F.pow(1.0 - F.exp(-F.col("ce")), F.lit(gamma)) * F.col("ce")).alias("loss"))


# ------------------------------------------------------------ operating curve


def threshold_grid(step: float = 0.05) -> list[float]:
    """step, 2*step, ... below 1, accumulated the way a floating range does."""
    count = math.ceil((1.0 - step) / step)
    return [step + i * step for i in range(count)]


def operating_curve(df: DataFrame, class_idx: int = CRITICAL_INDEX, step: float = 0.05) -> DataFrame:
    """Sensitivity, specificity and precision of one class at each threshold.

    A row passes the first k thresholds and none after, so counting rows by k
    replaces pairing every row with every threshold.
    """
    grid = threshold_grid(step)
    score = F.element_at("probs", class_idx + 1)
    counted = (
        df.select(
            score.alias("s"), (F.col("target") == class_idx).alias("pos")
        )
        .select(
            F.size(F.filter(literal_array(grid), lambda t: F.col("s") >= t)).alias("passed"), "pos"
        )
        .groupBy("passed")
        .agg(F.count_if("pos").alias("pos"), F.count_if(~F.col("pos")).alias("neg"))
    )
    dim = df.sparkSession.createDataFrame(
        [(i, (grid[i - 1] if i else None)) for i in range(len(grid) + 1)],
        "passed INT, threshold DOUBLE",
    )
    above = all_rows().orderBy(F.col("passed").desc())
    rows = dim.join(counted, "passed", "left").fillna(0, ["pos", "neg"]).select(
        "passed", "threshold",
        F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(all_rows()).alias("p"), F.sum("neg").over(all_rows()).alias("n"),
    )
    tp, fp = F.col("tp"), F.col("fp")
    return rows.filter("passed > 0").select(
        F.round("threshold", 2).alias("threshold"),
        F.bround(ratio(tp, F.col("p")), 4).alias("sensitivity"),
        F.bround(ratio(F.col("n") - fp, F.col("n")), 4).alias("specificity"),
        F.bround(ratio(tp, tp + fp), 4).alias("precision"),
        (tp + fp).alias("flagged"),
    )


# -------------------------------------------------------------------- ROC-AUC


def _score_slice(score: Column) -> Column:
    """Non-decreasing slice number: log-odds cut into narrow steps.

    A confident classifier gives most classes scores far below 1e-17; log-odds go on down
    to the smallest double, so these spread over slices too.
    """
    inner = F.greatest(F.lit(5e-324), F.least(F.lit(1.0 - 1e-16), score))
    odds = F.log(inner) - F.log1p(-inner)
    return F.floor((odds + 750.0) * 512.0)


def _rank_mass(df: DataFrame) -> DataFrame:
    """Per class and slice: positives, negatives and wins inside the slice.

    Equal scores are merged first (a score shared by a third of the rows is one
    row), sorting happens inside slices only, and slices are then chained through
    their totals. The slicing affects balance, never the result.
    """
    exploded = df.select("target", F.posexplode_outer("probs").alias("class_idx", "score")).select(
        "class_idx", "score", (F.col("target") == F.col("class_idx")).alias("pos")
    )
    merged = (
        exploded.groupBy("class_idx", _score_slice(F.col("score")).alias("slice"), "score")
        .agg(F.count_if("pos").alias("pos"), F.count_if(~F.col("pos")).alias("neg"))
    )
    before = (
        W.partitionBy("class_idx", "slice").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    )
    zero = F.lit(0).cast("long")
    ranked = merged.withColumn("neg_before", F.coalesce(F.sum("neg").over(before), zero)).withColumn(
        "all_before", F.coalesce(F.sum(F.col("pos") + F.col("neg")).over(before), zero)
    )
    per_slice = ranked.groupBy("class_idx", "slice").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)).alias("wins"),
        F.sum(
            F.col("pos") * (F.col("all_before") + (F.col("pos") + F.col("neg") + 1) / 2.0)
        ).alias("ranks"),
    )
    earlier = W.partitionBy("class_idx").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    return (
        per_slice.withColumn("neg_off", F.coalesce(F.sum("neg").over(earlier), zero))
        .withColumn("all_off", F.coalesce(F.sum(F.col("pos") + F.col("neg")).over(earlier), zero))
        .groupBy("class_idx")
        .agg(
            F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
            F.sum(F.col("wins") + F.col("pos") * F.col("neg_off")).alias("wins"),
            F.sum(F.col("ranks") + F.col("pos") * F.col("all_off")).alias("rank_sum"),
        )
    )


def mid_ranks(df: DataFrame) -> DataFrame:
    """Sum of the positives' mid-ranks per class (the Mann-Whitney ingredient)."""
    return _rank_mass(df).select("class_idx", "positives", "negatives", "rank_sum")


def roc_auc(df: DataFrame) -> DataFrame:
    """One-vs-rest ROC-AUC per class and the macro average of the rounded values.

    Classes that are never, or always, the truth are left out.
    """
    usable = _rank_mass(df).filter("positives > 0 AND negatives > 0")
    auc = F.col("wins") / (F.col("positives").cast("double") * F.col("negatives"))
    rows = _class_dim(df.sparkSession).join(usable, "class_idx").select(
        "code", F.bround(auc, 4).alias("auc")
    )
    # The grand total of the rollup is the macro average.
    return (
        rows.rollup("code")
        .agg(F.bround(F.avg("auc"), 4).alias("auc"))
        .select(F.coalesce("code", F.lit("macro")).alias("code"), "auc")
        .filter("auc IS NOT NULL")
    )


# ----------------------------------------------------------------- comparison


def compare_models(results: DataFrame, new: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Upsert ``new`` into ``results`` and pivot to metric x model.

    Both are (model, metric, value, verified); keys starting with an underscore
    are provenance, not models. One model name is replaced as a whole.
    """
    both = results.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    newest = F.max("_new").over(W.partitionBy("model"))  # a few metrics per model
    merged = (
        both.filter(~F.col("model").startswith("_"))
        .withColumn("_newest", newest)
        .filter("_new = _newest")
        .drop("_new", "_newest")
    )
    known = F.broadcast(
        results.sparkSession.createDataFrame([(m,) for m in metrics], "metric STRING")
    )
    return merged.join(known, "metric").withColumn(
        "self_reported", F.col("verified") == "self_reported"
    )


def pivot_models(long: DataFrame, models: Sequence[str]) -> DataFrame:
    return long.groupBy("metric").pivot("model", list(models)).agg(F.max("value"))


# -------------------------------------------------------------- sanity gates


def sanity_gates(df: DataFrame, again: DataFrame | None = None, item: str = "item_id") -> DataFrame:
    """(check, status, value) rows over a scored table.

    ``again`` is a second scoring of the same items, compared for repeatability.
    """
    k = len(CLASS_CODES)
    row_sum = F.aggregate("probs", F.lit(0.0), lambda s, x: s + x)
    scored = predictions(df).select(
        "target", "pred",
        (F.size("probs") == k).alias("shaped"),
        (F.abs(row_sum - 1.0) <= 1e-4).alias("normalised"),
        entropy("probs").alias("ent"),
    )
    per_target = scored.groupBy("target").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("pred") == F.col("target")).alias("hits"),
        F.count_if(~F.col("shaped")).alias("bad_shape"),
        F.count_if(~F.col("normalised")).alias("bad_sum"),
        F.sum("ent").alias("ent"),
    )
    facts = per_target.agg(
        F.sum("bad_shape").cast("double").alias("bad_shape"),
        F.sum("bad_sum").cast("double").alias("bad_sum"),
        ratio(F.sum("ent"), F.sum("n")).alias("ent"),
        ratio(F.sum("hits"), F.sum("n")).alias("acc"),
        # Absent classes do not enter: only targets that occur have a row here.
        F.avg(F.col("hits") / F.col("n")).alias("bal"),
    )
    if again is not None:
        drift = (
            df.select(item, F.col("probs").alias("a"))
            .join(again.select(item, F.col("probs").alias("b")), item)
            .agg(
                F.max(
                    F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y)))
                ).alias("drift")
            )
        )
        facts = facts.withColumn("drift", drift.scalar())
    else:
        facts = facts.withColumn("drift", F.lit(0.0))

    def grade(value: Column, fail: Column, warn: Column) -> Column:
        return F.when(fail, "FAIL").when(warn, "WARN").otherwise("PASS")

    never = F.lit(False)
    rules = [
        ("head shape", F.col("bad_shape"), F.col("bad_shape") > 0, never),
        ("probabilities normalised", F.col("bad_sum"), F.col("bad_sum") > 0, never),
        ("deterministic", F.col("drift"), F.col("drift") > 1e-6, never),
        ("head is discriminative", F.col("ent"), F.col("ent") > 0.985, F.col("ent") > 0.93),
        ("accuracy above chance", F.col("acc"), F.col("acc") < 0.2, F.col("acc") < 0.5),
        ("balanced recall", F.col("bal"), F.col("bal") < 0.25, F.col("bal") < 0.45),
    ]
    return facts.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("check"), grade(v, fail, warn).alias("status"),
                        v.cast("double").alias("value"),
                    )
                    for name, v, fail, warn in rules
                ]
            )
        ).alias("g")
    ).select("g.*")


def class_order_gate(declared: Sequence[str] | None) -> tuple[str, str]:
    """Does a recorded class list equal the one scoring assumes?"""
    if not declared:
        return "WARN", "class order not recorded"
    return ("PASS" if tuple(declared) == CLASS_CODES else "FAIL"), ",".join(declared)


# ---------------------------------------------------------- history of a metric


def best_epoch(history: DataFrame, run: str, epoch: str, metric: str) -> DataFrame:
    """Flag strictly-better epochs and name the best one, per training run.

    A run has one row per epoch, so its window partition stays small.
    """
    earlier = W.partitionBy(run).orderBy(epoch).rowsBetween(W.unboundedPreceding, -1)
    so_far = F.max(metric).over(earlier)
    flagged = history.withColumn(
        "improved", so_far.isNull() | (F.col(metric) > so_far)
    )
    return flagged.withColumn(
        "best_epoch", F.max(F.when(F.col("improved"), F.col(epoch))).over(W.partitionBy(run))
    )


def early_stop(history: DataFrame, run: str, epoch: str, metric: str, patience: int = 5) -> DataFrame:
    """First epoch at which ``patience`` epochs in a row brought nothing better."""
    flagged = best_epoch(history, run, epoch, metric)
    order = W.partitionBy(run).orderBy(epoch)
    islands = flagged.withColumn("_island", F.sum(F.col("improved").cast("int")).over(order))
    misses = islands.withColumn(
        "_misses",
        F.sum((~F.col("improved")).cast("int")).over(
            W.partitionBy(run, "_island").orderBy(epoch)
        ),
    )
    return misses.groupBy(run).agg(
        F.min(F.when(F.col("_misses") >= patience, F.col(epoch))).alias("stop_epoch"),
        F.count(F.lit(1)).alias("epochs"),
    )


# ---------------------------------------------------------------- safety net


def safety_net(graded: DataFrame) -> DataFrame:
    """Catch and over-referral rates of a graded table (target, tier)."""
    counts = graded.groupBy("target", "tier").agg(F.count(F.lit(1)).alias("n"))
    benign = ~F.element_at(literal_array(MALIGNANT_FLAGS), F.col("target") + 1)
    critical = F.col("target") == CRITICAL_INDEX
    urgent = F.col("tier").isin("HIGH", "CRITICAL")

    def n_if(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    out = counts.agg(
        n_if(critical).alias("true_critical"),
        n_if(critical & urgent).alias("critical_escalated"),
        n_if(benign).alias("benign_total"),
        n_if(benign & urgent).alias("benign_escalated"),
        *[
            n_if(F.col("tier") == t).alias(f"n_{t.lower()}")
            for t in ("LOW", "MODERATE", "HIGH", "CRITICAL", "INDETERMINATE")
        ],
    )
    return out.withColumn(
        "catch_rate", F.bround(ratio(F.col("critical_escalated"), F.col("true_critical")), 4)
    ).withColumn(
        "benign_escalation_rate",
        F.bround(ratio(F.col("benign_escalated"), F.col("benign_total")), 4),
    )
