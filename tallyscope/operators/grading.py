"""Composite grading, narratives, triage queues and batch summaries.

``grade`` is one projection: no shuffle, no UDF. Evidence a table does not carry
(no ``tds`` column, no ``entropy`` column, ...) is simply a disabled stage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import texts as T
from ..functions.basic import literal_array, pin, ratio, texts
from ..functions.grading import (
    PART_WEIGHTS,
    PART_WEIGHTS_NO_SCORES,
    TDS_HIGHLY_SUSPICIOUS,
    TDS_SUSPICIOUS,
    by_rank,
    composite,
    legacy_tier,
    morphology_risk,
    quality_risk,
    tds_band,
    tier_name,
    tier_rank,
    uncertainty_risk,
)
from ..functions.scores import confidence, malignant_sum, risk_dot, top_index
from ..sources.taxonomy import (
    CLASS_CODES,
    CLASS_NAMES,
    CRITICAL_INDEX,
    DESCRIPTIONS,
    MALIGNANT_FLAGS,
    MANAGEMENT,
    RISK_WEIGHTS,
    SHORT_NAMES,
    TIERS,
    classes,
)

# Optional evidence columns of a scored record and the type of a missing one.
EVIDENCE = {
    "tds": "double", "a": "int", "b": "int", "c": "int", "d": "int", "reliable": "boolean",
    "entropy": "double", "margin": "double", "agreement": "double", "stability": "string",
    "quality_score": "double", "quality_verdict": "string", "in_domain": "boolean",
    "blocking": "boolean", "critical_messages": "array<string>", "attention": "double",
}

# Stage switches: option name -> evidence columns it supplies.
STAGES = {
    "morphometry": ("tds", "a", "b", "c", "d", "reliable"),
    "tta": ("entropy", "margin", "agreement", "stability"),
    "gradcam": ("attention",),
}


def resolve_options(options: Mapping | None, defaults: Mapping) -> dict:
    """Defaults overlaid with the known, non-null options."""
    chosen = {k: v for k, v in (options or {}).items() if k in defaults and v is not None}
    return {**defaults, **chosen}


def disable_stages(df: DataFrame, options: Mapping | None) -> DataFrame:
    """Drop the evidence of every stage that is switched off."""
    active = resolve_options(options, {name: True for name in STAGES})
    unwanted = [c for name, cols in STAGES.items() if not active[name] for c in cols]
    return df.drop(*unwanted)


def _with_evidence(df: DataFrame) -> DataFrame:
    missing = {n: F.lit(None).cast(t) for n, t in EVIDENCE.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


def _pick(values: Sequence, index: Column) -> Column:
    return F.element_at(literal_array(values), index + 1)


def score_parts(df: DataFrame, trained: bool = True) -> DataFrame:
    """Top class, usability, the four risk parts, composite score and its tier."""
    base = _with_evidence(df).withColumns(
        {
            "top_idx": top_index("probs"),
            "confidence": confidence("probs"),
            "non_domain": ~F.coalesce("in_domain", F.lit(True)),
        }
    )
    base = base.withColumn("neural_usable", F.lit(trained) & ~F.col("non_domain"))
    usable = F.col("neural_usable")
    base = base.withColumns(
        {
            "code": _pick(CLASS_CODES, F.col("top_idx")),
            "malignant_probability": F.when(
                usable, malignant_sum("probs", MALIGNANT_FLAGS)
            ).otherwise(0.0),
            "neural": F.when(
                usable, risk_dot("probs", [RISK_WEIGHTS[c] for c in CLASS_CODES])
            ).otherwise(0.0),
            "morphology": morphology_risk(F.col("tds"), F.col("reliable")),
            "uncertainty": uncertainty_risk(
                F.col("entropy"), F.col("agreement"), F.col("margin")
            ),
            "quality": quality_risk(F.col("quality_score")),
        }
    )
    parts = {n: F.col(n) for n in PART_WEIGHTS}
    base = base.withColumn("raw_score", composite(parts, usable))
    return base.withColumns(
        {
            "score": F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("raw_score"))),
            "base_rank": tier_rank(F.col("raw_score")),
        }
    )


def _escalated_rank() -> Column:
    """Base rank raised by every override that applies; never lowered."""
    p_crit = F.element_at("probs", CRITICAL_INDEX + 1)
    is_crit = F.col("top_idx") == CRITICAL_INDEX
    none, moderate, high, critical = (F.lit(r) for r in (1, 2, 3, 4))
    by_class = (
        F.when(is_crit, F.when(F.col("confidence") >= 0.70, critical).otherwise(high))
        .when(p_crit >= 0.25, high)
        .when(p_crit >= 0.10, moderate)
        .otherwise(none)
    )
    return F.greatest(
        F.col("base_rank"),
        by_class,
        F.when(_pick(MALIGNANT_FLAGS, F.col("top_idx")), moderate).otherwise(none),
        F.when(F.col("confidence") < 0.50, moderate).otherwise(none),
        F.when(F.col("stability") == "uncertain", moderate).otherwise(none),
        F.when(F.col("tds") > TDS_HIGHLY_SUSPICIOUS, high).otherwise(none),
    )


def _overrides(trained: bool) -> Column:
    p_crit = F.element_at("probs", CRITICAL_INDEX + 1)
    is_crit = F.col("top_idx") == CRITICAL_INDEX
    pct = F.col("confidence") * 100.0
    applied = texts(
        F.when(is_crit, F.format_string(T.OVERRIDE_CRITICAL_TOP, pct))
        .when(p_crit >= 0.25, F.format_string(T.OVERRIDE_CRITICAL_25, p_crit * 100.0))
        .when(p_crit >= 0.10, F.format_string(T.OVERRIDE_CRITICAL_10, p_crit * 100.0)),
        F.when(
            _pick(MALIGNANT_FLAGS, F.col("top_idx")) & ~is_crit,
            F.format_string(
                T.OVERRIDE_MALIGNANT_TOP, _pick([SHORT_NAMES[c] for c in CLASS_CODES], F.col("top_idx"))
            ),
        ),
        F.when(F.col("confidence") < 0.50, F.format_string(T.OVERRIDE_LOW_CONFIDENCE, pct)),
        F.when(F.col("tds") > TDS_HIGHLY_SUSPICIOUS, F.format_string(T.OVERRIDE_TDS, F.col("tds"))),
    )
    forced = F.array(F.lit(T.OVERRIDE_OUT_OF_DOMAIN if trained else T.OVERRIDE_UNTRAINED))
    return F.when(F.col("neural_usable"), applied).otherwise(forced)


def _review_reasons(trained: bool) -> Column:
    usable = F.col("neural_usable")
    blocked = F.when(
        F.coalesce("blocking", F.lit(False)),
        F.coalesce("critical_messages", F.array().cast("array<string>")),
    ).otherwise(F.array().cast("array<string>"))
    reasons = F.concat(
        texts(
            F.when(~usable, T.REVIEW_OUT_OF_DOMAIN if trained else T.REVIEW_UNTRAINED),
            F.when(F.lit(trained) & (F.col("attention") < 0.5), T.REVIEW_ATTENTION),
            F.when(usable & (F.col("confidence") < 0.50), T.REVIEW_LOW_CONFIDENCE),
            F.when(usable & (F.col("stability") == "uncertain"), T.REVIEW_UNSTABLE),
        ),
        blocked,
        texts(F.when(~F.col("reliable"), T.REVIEW_UNRELIABLE)),
    )
    return F.array_distinct(reasons)


def _drivers(trained: bool) -> Column:
    usable = F.col("neural_usable")

    def points(part: str) -> Column:
        return F.col(part) * F.when(usable, PART_WEIGHTS[part]).otherwise(
            PART_WEIGHTS_NO_SCORES[part]
        )

    def entry(present: Column, label: str, detail: Column, up: Column, contribution: Column):
        return F.when(
            present,
            F.struct(
                F.lit(label).alias("label"),
                detail.alias("detail"),
                F.when(up, "increases").otherwise("decreases").alias("direction"),
                F.round(contribution, 1).alias("contribution"),
            ),
        )

    tds, aligned = F.col("tds"), F.col("attention") >= 0.5
    return F.array_compact(
        F.array(
            entry(
                usable, "Neural classification",
                F.format_string(
                    T.DRIVER_NEURAL, _pick([SHORT_NAMES[c] for c in CLASS_CODES], F.col("top_idx")),
                    F.col("confidence") * 100.0, F.col("malignant_probability") * 100.0,
                ),
                F.col("neural") >= 30, points("neural"),
            ),
            entry(
                tds.isNotNull(), "ABCD morphometry",
                F.format_string(
                    T.DRIVER_MORPHOLOGY, tds, F.replace(tds_band(tds), F.lit("_"), F.lit(" ")),
                    F.col("a"), F.col("b"), F.col("c"), F.col("d"),
                ),
                tds >= TDS_SUSPICIOUS, points("morphology"),
            ),
            entry(
                F.col("entropy").isNotNull() & F.lit(trained), "Prediction stability",
                F.format_string(
                    T.DRIVER_STABILITY, F.col("stability"), F.col("entropy"),
                    F.rint(F.col("agreement") * 100.0),
                ),
                F.col("stability") != "confident", points("uncertainty"),
            ),
            entry(
                F.col("quality_score").isNotNull(), "Image quality",
                F.format_string(
                    T.DRIVER_QUALITY, F.col("quality_verdict"), F.rint("quality_score")
                ),
                F.col("quality_score") < 70, points("quality"),
            ),
            entry(
                F.col("attention").isNotNull() & F.lit(trained), "Explanation alignment",
                F.when(aligned, T.DRIVER_ATTENTION_OK).otherwise(T.DRIVER_ATTENTION_OFF),
                ~aligned, F.lit(0.0),
            ),
        )
    )


def _headline(trained: bool) -> Column:
    name = _pick([SHORT_NAMES[c] for c in CLASS_CODES], F.col("top_idx"))
    expr = F.when(
        F.col("tier") == "INDETERMINATE",
        F.when(F.col("non_domain"), T.HEADLINE_OUT_OF_DOMAIN)
        .when(F.lit(not trained), T.HEADLINE_UNTRAINED)
        .otherwise(T.HEADLINE_UNSUITABLE),
    )
    for tier, template in T.HEADLINES.items():
        expr = expr.when(
            F.col("tier") == tier,
            F.format_string(template, name, F.rint(F.col("confidence") * 100.0)),
        )
    return expr


def grade(df: DataFrame, trained: bool = True) -> DataFrame:
    """Full grading of scored records, one output row per input row.

    INDETERMINATE ranks lowest but is assigned last and wins, so it stays outside
    the escalate-only maximum.
    """
    parts = score_parts(df, trained)
    rank = F.when(F.col("neural_usable"), _escalated_rank()).otherwise(F.lit(0))
    graded = pin(parts, {"tier_rank": rank}).withColumn("tier", tier_name(F.col("tier_rank")))
    graded = graded.withColumns(
        {
            "overrides": _overrides(trained),
            "review_reasons": _review_reasons(trained),
            "drivers": _drivers(trained),
            "headline": _headline(trained),
        }
    )
    review = (F.size("review_reasons") > 0) | F.col("tier").isin(
        "HIGH", "CRITICAL", "INDETERMINATE"
    )
    # Five tiers: looked up in place, without a join.
    return graded.withColumns(
        {
            "requires_human_review": review,
            "timeframe": by_rank(F.col("tier_rank"), 1),
            "recommendation": by_rank(F.col("tier_rank"), 2),
        }
    )


# ------------------------------------------------------------ ranked classes


def ranked(df: DataFrame, item: str, k: int | None = None) -> DataFrame:
    """Classes of each record by descending score (stable), with their attributes."""
    order = F.array_sort(
        F.transform(
            "probs",
            lambda p, i: F.struct((-p).alias("neg"), i.alias("class_idx"), p.alias("probability")),
        )
    )
    if k is not None:
        order = F.slice(order, 1, k)
    # Never empty; the outer form evaluates the sorted array once.
    long = df.select(item, F.posexplode_outer(order).alias("pos", "e")).select(
        item, (F.col("pos") + 1).alias("rank"), "e.class_idx", "e.probability"
    )
    dim = F.broadcast(
        classes(df.sparkSession).select(
            "class_idx", "code", "name", "short_name", "malignancy", "color"
        )
    )
    return long.join(dim, "class_idx").withColumn(
        "percentage", F.round(F.col("probability") * 100, 2)
    )


def truth_vs_prediction(truth: DataFrame, graded: DataFrame, on: str) -> DataFrame:
    """Join of true codes with graded predictions: hit flag and escalation note."""
    joined = truth.select(on, F.col("code").alias("true_code")).join(
        graded.select(on, F.col("code").alias("pred_code"), "confidence", "tier"), on
    )
    hit = F.col("true_code") == F.col("pred_code")
    escalated = (F.col("true_code") == "mel") & F.col("tier").isin("HIGH", "CRITICAL")
    note = F.concat_ws(
        " · ", F.when(hit, F.lit("correct")), F.when(escalated, F.lit("melanoma escalated"))
    )
    return joined.withColumn("hit", hit).withColumn("note", note)


# ------------------------------------------------------------------ narrative


def _labels(names: Mapping[str, str], present: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.concat_ws(", ", F.transform(present, lambda n: F.coalesce(table[n], n)))


def narrative(graded: DataFrame, limitations: Sequence[str] = ()) -> DataFrame:
    """Report sections as text columns, from an already graded table.

    Whether the scores may be spoken of is each record's own ``neural_usable``; without it
    no class is named. ``attention`` is the share of evidence inside the outline (from 0.5
    on it speaks for the prediction). ``limitations`` are extra statements put first.
    """
    df = graded
    usable = F.col("neural_usable")
    for name in ("colors", "structures"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("array<string>"))
    idx = F.col("top_idx")
    name = _pick([CLASS_NAMES[c] for c in CLASS_CODES], idx)
    pct = F.col("confidence") * 100.0
    say = F.format_string
    impression = (
        F.when(
            usable,
            say(T.IMPRESSION, name, pct, F.col("tier"), F.rint("score"), F.col("recommendation"), F.col("timeframe")),
        )
        .when(F.col("non_domain"), T.IMPRESSION_OUT_OF_DOMAIN)
        .otherwise(say(T.IMPRESSION_UNTRAINED, F.lower(F.replace("tier", F.lit("_"), F.lit(" ")))))
    )
    lead = (
        F.when(usable, say(T.SUMMARY_SCORES, name, pct, F.col("malignant_probability") * 100.0))
        .when(F.col("non_domain"), T.SUMMARY_OUT_OF_DOMAIN)
        .otherwise(T.SUMMARY_UNTRAINED)
    )
    tds = F.col("tds")
    summary = F.concat_ws(
        " ",
        lead,
        F.when(
            tds.isNotNull(),
            say(T.SUMMARY_MORPHOLOGY, tds, F.replace(tds_band(tds), F.lit("_"), F.lit(" "))),
        ),
        F.when(
            F.col("entropy").isNotNull() & usable,
            say(
                T.SUMMARY_STABILITY, F.col("stability"), F.rint(F.col("agreement") * 100.0),
                F.col("entropy"),
            ),
        ),
    )
    symmetry = F.lit(None).cast("string")
    for k, words in T.SYMMETRY_WORDS.items():
        symmetry = F.when(F.col("a") == k, words).otherwise(symmetry)
    border = F.lit(T.BORDER_WORDS[0])
    for k in (1, 3, 6):
        border = F.when(F.col("b") >= k, T.BORDER_WORDS[k]).otherwise(border)
    n_colors, n_structs = F.size("colors"), F.size("structures")
    findings = texts(
        F.when(F.col("a").isNotNull(), say(T.FINDING_ASYMMETRY, symmetry, F.col("a"))),
        F.when(F.col("b").isNotNull(), say(T.FINDING_BORDER, border, F.col("b"))),
        F.when(
            n_colors > 0,
            F.concat(
                say(T.FINDING_COLORS, n_colors, n_colors,
                    _labels(T.COLOR_LABELS, F.col("colors"))),
                F.when(n_colors >= 5, T.FINDING_MANY_COLORS).otherwise(""),
            ),
        ).when(n_colors == 0, T.FINDING_NO_COLOR),
        F.when(
            n_structs > 0,
            say(T.FINDING_STRUCTURES, n_structs,
                _labels(T.STRUCTURE_LABELS, F.col("structures"))),
        ).when(n_structs == 0, T.FINDING_NO_STRUCTURE),
        F.when(
            F.col("quality_score").isNotNull(),
            say(T.FINDING_QUALITY, F.col("quality_verdict"), F.rint("quality_score")),
        ),
    )
    best = F.slice(
        F.array_sort(
            F.transform("probs", lambda p, i: F.struct((-p).alias("neg"), i.alias("i"), p.alias("p")))
        ),
        1, 3,
    )
    names, about = (
        literal_array([d[c] for c in CLASS_CODES]) for d in (CLASS_NAMES, DESCRIPTIONS)
    )
    ranked = F.transform(
        best,
        lambda e: F.format_string(
            T.DIFFERENTIAL, F.element_at(names, e["i"] + 1), e["p"] * 100.0, F.element_at(about, e["i"] + 1)
        ),
    )
    differential = F.when(usable, ranked).otherwise(F.array().cast("array<string>"))
    inside = F.col("attention") if "attention" in df.columns else F.lit(None).cast("double")
    explanation = F.concat(
        texts(
            F.when(inside >= 0.5, say(T.ATTENTION_INSIDE, F.rint(inside * 100.0))).when(
                inside < 0.5, say(T.ATTENTION_OUTSIDE, F.rint(inside * 100.0))
            )
        ),
        F.transform("drivers", lambda d: F.concat_ws(": ", d["label"], d["detail"])),
        F.transform("overrides", lambda o: F.concat(F.lit(T.OVERRIDE_PREFIX), o)),
    )
    limits = texts(
        *[F.lit(t) for t in limitations],
        F.lit(T.LIMIT_CLASSES),
        F.lit(T.LIMIT_STRUCTURES),
        F.when(F.col("blocking"), T.LIMIT_QUALITY),
        F.when(~F.col("reliable"), T.LIMIT_GEOMETRY),
        F.when(~usable & F.col("non_domain"), T.LIMIT_WITHHELD).when(~usable, T.LIMIT_UNTRAINED),
    )
    advice = texts(
        say(T.ADVICE_ACTION, F.col("recommendation"), F.col("timeframe")),
        F.when(usable, say(T.ADVICE_CLASS, _pick([MANAGEMENT[c] for c in CLASS_CODES], idx))),
        F.when(
            F.col("requires_human_review"),
            F.when(
                F.size("review_reasons") > 0,
                say(T.ADVICE_REVIEW, F.concat_ws("; ", "review_reasons")),
            ).otherwise(T.ADVICE_TIER),
        ),
        F.lit(T.ADVICE_SELF_CHECK),
    )
    return df.withColumns(
        {
            "impression": impression,
            "summary": summary,
            "findings": findings,
            "differential": differential,
            "explanation": explanation,
            "limitations": limits,
            "advice": advice,
        }
    )


# ----------------------------------------------------------- batch and triage


def triage_queue(graded: DataFrame, item: str, by_tier: bool = False) -> DataFrame:
    """Urgent records, most confident first; ``by_tier`` puts tier before that."""
    urgent = graded.filter(F.col("tier").isin("HIGH", "CRITICAL"))
    order = [F.col("confidence").desc(), F.col(item)]
    if by_tier:
        rank = F.when(F.col("tier") == "CRITICAL", 4).otherwise(3)
        order = [rank.desc(), *order]
    return urgent.orderBy(*order)


def batch_summary(results: DataFrame) -> DataFrame:
    """Counts of a batch: (ok, tier) in, totals and tier distribution out."""
    counts = results.groupBy("ok", "tier").agg(F.count(F.lit(1)).alias("n"))

    def n_if(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    ok = F.col("ok")
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("count"),
        n_if(ok).alias("succeeded"),
        n_if(~ok).alias("failed"),
        *[n_if(ok & (F.col("tier") == t)).alias(f"n_{t.lower()}") for t in TIERS],
        n_if(ok & F.col("tier").isin("HIGH", "CRITICAL")).alias("urgent"),
    )


def legacy_safety_net(df: DataFrame) -> DataFrame:
    """Tier distribution and catch rate of the single-rule tiers."""
    tier = legacy_tier(_pick(CLASS_CODES, top_index("probs")), confidence("probs"))
    counts = df.select("target", tier.alias("tier")).groupBy("tier").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("target") == CRITICAL_INDEX).alias("critical"),
    )
    everything = W.partitionBy(F.lit(0))  # three rows
    caught = F.sum(F.when(F.col("tier") == "HIGH RISK", F.col("critical")).otherwise(0))
    return counts.select(
        "tier", "n",
        F.round(ratio(F.col("n"), F.sum("n").over(everything)) * 100, 1).alias("pct"),
        F.round(
            ratio(caught.over(everything), F.sum("critical").over(everything)) * 100, 1
        ).alias("catch_rate_pct"),
    )
