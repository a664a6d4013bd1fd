"""Repeated scoring passes and what they say about uncertainty.

All passes of an item come from its own row, so they are made, scored and summarised in
that row (``passes`` ARRAY<ARRAY<DOUBLE>>, scores by pass): nothing is shuffled. Passes
that arrive as rows, ``(item, pass, probs)``, are summarised by one aggregation per item
whose buffers hold a number per class.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.basic import clip, let, pin, total
from ..functions.scores import entropy, linear_logits, softmax, top_index
from ..sources.taxonomy import CLASS_CODES

K = len(CLASS_CODES)
SERVING_FLOOR = 1e-3  # smallest temperature used when serving


def _score(df: DataFrame, item: str, vector: Column, head: DataFrame, scale: float, temperature: float):
    """``head`` is one row with ``w`` ARRAY<ARRAY<DOUBLE>>, read as a scalar."""
    return (
        df.withColumn("_w", head.scalar())
        .withColumn("logits", linear_logits(vector, F.col("_w"), scale=scale))
        .select(item, "pass", softmax(F.col("logits"), temperature, SERVING_FLOOR).alias("probs"))
    )


def _scored_in_row(df: DataFrame, item: str, views: Column, head: DataFrame, scale: float, temperature: float) -> DataFrame:
    """(item, passes): scores of each of the vectors in ``views``."""
    scored = F.transform("_vv", lambda v: softmax(linear_logits(v, F.col("_w"), scale=scale), temperature, SERVING_FLOOR))
    return pin(df.withColumn("_w", head.scalar()), {"_vv": views}).select(item, scored.alias("passes"))


def _views(vector: str, side: int, n: int) -> list[str]:
    """The first ``n`` symmetries of a vector laid out as a side x side grid, as expressions."""
    last = side - 1
    views = []
    for view in range(max(1, min(int(n), 8))):
        y, x = f"(o div {side})", f"(o % {side})"
        for _ in range(view % 4):
            y, x = x, f"({last} - {y})"
        if view >= 4:
            x = f"({last} - {x})"
        views.append(f"transform(sequence(0, {side * side - 1}), o -> element_at({vector}, cast({y} * {side} + {x} + 1 AS int)))")
    return views


def dihedral_in_row(
    df: DataFrame, item: str, vector: str, head: DataFrame, side: int, n: int = 5,
    scale: float = 1.0, temperature: float = 1.0,
) -> DataFrame:
    """(item, passes): scores of the first ``n`` symmetries of a vector."""
    return _scored_in_row(df, item, F.expr(f"array({', '.join(_views(vector, side, n))})"), head, scale, temperature)


def dihedral_passes(
    df: DataFrame, item: str, vector: str, head: DataFrame, side: int, n: int = 5,
    scale: float = 1.0, temperature: float = 1.0,
) -> DataFrame:
    """Score the first ``n`` symmetries of a vector laid out as a side x side grid."""
    views = [f"struct({i} AS pass, {view} AS vv)" for i, view in enumerate(_views(vector, side, n))]
    long = df.select(item, F.expr(f"inline(array({', '.join(views)}))"))
    return _score(long, item, F.col("vv"), head, scale, temperature)


def masked_passes(
    df: DataFrame, item: str, vector: str, head: DataFrame, passes: int = 10, p: float = 0.3,
    seed: int = 42, scale: float = 1.0, temperature: float = 1.0,
) -> DataFrame:
    """Scores under random feature dropout, reproducible from (seed, item, pass)."""
    long = df.select(item, vector, F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
    masked = pin(long, {"_d": F.expr(_digests(vector, item, "pass", seed))}).withColumn("vv", F.expr(_kept(vector, "_d", p)))
    return _score(masked, item, F.col("vv"), head, scale, temperature)


def _digests(vector: str, item: str, number: str, seed: int) -> str:
    """One md5 for eight dimensions, four hex digits each."""
    return f"transform(sequence(0, cast((size({vector}) - 1) div 8 AS int)), b -> md5(concat_ws(':', '{seed}', {item}, {number}, b)))"


def _kept(vector: str, digests: str, p: float) -> str:
    """The vector with its dropped dimensions 0: digits of equal length compare as text the way
    they compare as numbers."""
    cut = format(math.ceil(p * 65536), "04x")
    keep = f"substring(element_at({digests}, cast(i div 8 AS int) + 1), 1 + 4 * (i % 8), 4) >= '{cut}'"
    return f"transform({vector}, (x, i) -> CASE WHEN {keep} THEN x / {1.0 - p}D ELSE 0.0D END)"


def masked_in_row(
    df: DataFrame, item: str, vector: str, head: DataFrame, passes: int = 10, p: float = 0.3,
    seed: int = 42, scale: float = 1.0, temperature: float = 1.0,
) -> DataFrame:
    """(item, passes): scores under random feature dropout, the same as ``masked_passes``."""
    drawn = pin(df.select(item, vector), {"_d": F.expr(f"transform(sequence(0, {passes - 1}), n -> {_digests(vector, item, 'n', seed)})")})
    return _scored_in_row(drawn, item, F.expr(f"transform(_d, d -> {_kept(vector, 'd', p)})"), head, scale, temperature)


def _means(passes: Column) -> Column:
    """Mean score of each class over the passes in a row."""
    n = F.size(passes).cast("double")
    zero = F.array_repeat(F.lit(0.0), K)
    return F.transform(F.aggregate(passes, zero, lambda acc, p: F.zip_with(acc, p, lambda a, x: a + x)), lambda s: s / n)


def _deviations(passes: Column, means: Column) -> Column:
    n = F.size(passes).cast("double")
    zero = F.array_repeat(F.lit(0.0), K)
    apart = F.aggregate(passes, zero, lambda acc, p: F.zip_with(acc, F.zip_with(p, means, lambda x, m: (x - m) * (x - m)), lambda a, d: a + d))
    return F.transform(apart, lambda s: F.sqrt(s / n))


def _summed(df: DataFrame, item: str, extra: dict[str, Column]) -> DataFrame:
    held = pin(df, {"_mean": _means(F.col("passes")), **extra})
    held = held.withColumn("_std", _deviations(F.col("passes"), F.col("_mean")))
    return pin(held, {"probs": let(F.col("_mean"), lambda m: F.transform(m, lambda x: x / F.greatest(total(m), F.lit(1e-12))))})


def summarise_views_in_row(df: DataFrame, item: str) -> DataFrame:
    """As ``summarise_views``, from ``passes`` in a row."""
    held = _summed(df, item, {"per_pass": F.transform("passes", top_index)}).withColumn("consensus", top_index("probs"))
    same = F.size(F.filter("per_pass", lambda t: t == F.col("consensus")))
    return held.select(
        item, "probs", "consensus", (same / F.size("per_pass")).alias("agreement"), F.element_at("_std", F.col("consensus") + 1).alias("top_std"), "per_pass",
    )


def summarise_stochastic_in_row(df: DataFrame, item: str) -> DataFrame:
    """As ``summarise_stochastic``, from ``passes`` in a row."""
    n = F.size("passes")
    held = _summed(df, item, {"_eh": total(F.transform("passes", entropy)) / n.cast("double")})
    enough = n >= 2
    return held.select(
        item, "probs",
        F.when(enough, total(F.col("_std")) / float(K)).otherwise(0.0).alias("mean_std"),
        F.when(enough, clip(entropy("probs") - F.col("_eh"), 0.0, 1.0)).otherwise(0.0).alias("mutual_information"),
        F.when(enough, n).otherwise(0).cast("long").alias("passes"),
    )


def _moments() -> list[Column]:
    return [F.avg(F.col("probs")[i]).alias(f"_m{i}") for i in range(K)] + [
        F.stddev_pop(F.col("probs")[i]).alias(f"_s{i}") for i in range(K)
    ]


def _mean_vector() -> Column:
    raw = F.array(*[F.col(f"_m{i}") for i in range(K)])
    return F.transform(raw, lambda x: x / F.greatest(total(raw), F.lit(1e-12)))


def summarise_views(passes: DataFrame, item: str) -> DataFrame:
    """Mean scores, agreement with the consensus, spread of its score, per-pass picks."""
    agg = passes.withColumn("_top", top_index("probs")).groupBy(item).agg(
        *_moments(),
        # One small number per pass; the number of passes is a parameter (at most 8).
        F.array_sort(F.collect_list(F.struct("pass", "_top"))).alias("_picks"),
    )
    out = agg.withColumn("probs", _mean_vector()).withColumn("consensus", top_index("probs"))
    picks = F.transform("_picks", lambda s: s["_top"])
    stds = F.array(*[F.col(f"_s{i}") for i in range(K)])
    same = F.size(F.filter("_picks", lambda s: s["_top"] == F.col("consensus")))
    return out.select(
        item, "probs", "consensus",
        (same / F.size("_picks")).alias("agreement"),
        F.element_at(stds, F.col("consensus") + 1).alias("top_std"),
        picks.alias("per_pass"),
    )


def summarise_stochastic(passes: DataFrame, item: str) -> DataFrame:
    """Mean scores, mean per-class spread, normalised information gain.

    Fewer than two passes say nothing about spread and report zeros.
    """
    agg = passes.withColumn("_h", entropy("probs")).groupBy(item).agg(
        *_moments(), F.avg("_h").alias("_eh"), F.count(F.lit(1)).alias("_n")
    )
    spread = total(F.array(*[F.col(f"_s{i}") for i in range(K)])) / float(K)
    enough = F.col("_n") >= 2
    out = agg.withColumn("probs", _mean_vector())
    gain = clip(entropy("probs") - F.col("_eh"), 0.0, 1.0)
    return out.select(
        item, "probs",
        F.when(enough, spread).otherwise(0.0).alias("mean_std"),
        F.when(enough, gain).otherwise(0.0).alias("mutual_information"),
        F.when(enough, F.col("_n")).otherwise(0).alias("passes"),
    )
