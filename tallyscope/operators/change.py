"""Longitudinal change between successive captures of one subject."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import texts as T
from ..functions.basic import as_col, clip, texts

# ---- fixed values -----------------------------------------------------------
# (column, label, threshold, must differ, note)
CHANGE_METRICS = (
    ("diameter", "Diameter (fraction of frame width)", 0.20, False,
     "Relative to frame; not comparable unless both photos used the same magnification."),
    ("area", "Area (fraction of frame)", 0.30, False, ""),
    ("tds", "ABCD total dermoscopy score", 0.15, True, ""),
    ("a", "Asymmetry (A)", 0.01, True, ""),
    ("b", "Border irregularity (B)", 0.25, True, ""),
    ("c", "Colour count (C)", 0.01, True, ""),
    ("color_variance", "Colour variance", 0.25, True, ""),
)
COLOR_DISTANCE = (
    "Colour distribution distance", 0.35,
    "Bhattacharyya distance between hue-saturation histograms (0 = identical).",
)
FIELD_METRIC = (
    "Diameter (mm, from supplied field of view)",
    "Assumes a %.1f mm field of view in both captures.",
)
DAYS_PER_MONTH = 30.44
MARKER_STRUCTURE = "blue_white_veil"
# ---- end of fixed values ----------------------------------------------------


# ---------------------------------------------------------------- expressions


def relative_change(baseline: Column | str, followup: Column | str) -> Column:
    """Signed relative change; from a zero baseline it is 0 or 1."""
    b, f = as_col(baseline).cast("double"), as_col(followup).cast("double")
    return F.when(
        F.abs(b) < 1e-9, F.when(F.abs(f) < 1e-9, 0.0).otherwise(1.0)
    ).otherwise(F.try_divide(f - b, F.abs(b)))


def days_between(start: Column | str, end: Column | str) -> Column:
    """Whole days between ISO dates; missing, malformed or reversed gives null."""
    first, last = (
        F.try_to_date(F.substring(as_col(c).cast("string"), 1, 10), "yyyy-MM-dd")
        for c in (start, end)
    )
    days = F.datediff(last, first)
    return F.when(days >= 0, days)


def growth_per_month(relative: Column, days: Column, baseline: Column) -> Column:
    return F.when(
        (days > 0) & (baseline > 1e-6), F.try_divide(relative, days / DAYS_PER_MONTH)
    )


def attribute_diff(baseline: Column | str, followup: Column | str) -> tuple[Column, Column]:
    """(new, lost) values, each sorted."""
    b, f = as_col(baseline), as_col(followup)
    return F.array_sort(F.array_except(f, b)), F.array_sort(F.array_except(b, f))


# --------------------------------------------------------------------- pairs


def previous_capture(
    df: DataFrame, subject: str, ts: str, columns: Sequence[str], span: str | Sequence[str] = ()
) -> DataFrame:
    """Add ``prev`` (struct of ``columns`` and ``ts``): the latest earlier capture.

    Without ``span`` the history of a subject must be short (say, one row a day).
    With ``span`` (``date_trunc`` units, fine ones first) histories of any length are cut
    into spans: rows are ordered inside the finest span only, and the first row of each
    span takes the last row of the nearest earlier span, which is the same question about
    one summary row per span, cut by the next unit.
    """
    spans = (span,) if isinstance(span, str) else tuple(span)
    packed = F.struct(ts, *[c for c in columns if c != ts])
    if not spans:
        return df.withColumn(
            "prev", F.lag(packed).over(W.partitionBy(subject).orderBy(ts))
        )
    cell = f"_span{len(spans)}"
    cut = df.withColumn(cell, F.date_trunc(spans[0], F.col(ts)))
    inside = W.partitionBy(subject, cell).orderBy(ts)
    ranked = cut.withColumn("_in", F.lag(packed).over(inside))
    last = cut.groupBy(subject, cell).agg(F.max_by(packed, F.col(ts)).alias("_last"))
    carried = previous_capture(last, subject, cell, ["_last"], spans[1:]).select(
        subject, cell, F.col("prev._last").alias("_before")
    )
    return (
        ranked.join(carried, [subject, cell], "left")
        .withColumn("prev", F.coalesce("_in", "_before"))
        .drop(cell, "_in", "_before")
    )


def last_known(df: DataFrame, subject: str, order: Sequence[str], value: str, spans: Sequence[str] = ()) -> DataFrame:
    """Add ``known``: the last non-null ``value`` of the subject's earlier rows, by ``order`` (time first).

    With ``spans`` (``date_trunc`` units, fine ones first) rows are ordered inside the finest span
    only; what a span ends with is one summary row, and the same question one unit up carries it on,
    so a subject that holds a third of all rows is never one group.
    """
    ts = order[0]
    before = lambda *keys: W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    if not spans:
        return df.withColumn("known", F.last(value, ignorenulls=True).over(before(subject)))
    cell, own, at = (f"_{n}{len(spans)}" for n in ("span", "own", "at"))
    cut = df.withColumn(cell, F.date_trunc(spans[0], F.col(ts)))
    inside = cut.withColumn("_in", F.last(value, ignorenulls=True).over(before(subject, cell)))
    ends = cut.groupBy(subject, cell).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
    carried = last_known(ends, subject, [cell], "_end", spans[1:]).select(
        F.col(subject).alias(own), F.col(cell).alias(at), F.col("known").alias("_carried")
    )
    same = F.col(subject).eqNullSafe(F.col(own)) & F.col(cell).eqNullSafe(F.col(at))
    return inside.join(carried, same, "left").withColumn("known", F.coalesce("_in", "_carried")).drop(cell, own, at, "_in", "_carried")


def as_of(
    followups: DataFrame, baselines: DataFrame, subject: str, ts: str, columns: Sequence[str],
    span: str | Sequence[str] = (), strict: bool = False,
) -> DataFrame:
    """followups with ``base``: ``ts`` and ``columns`` of the subject's latest baseline not later than the
    row (``strict``: earlier); null where there is none.

    Both tables become one, tagged and ordered inside nested spans (see ``last_known``), so nothing
    is joined by ranges and neither side has to be small. Of baselines at one time the greatest by
    ``columns`` counts; rows without a time or subject are kept, with what is known for them.
    """
    carried = F.struct(F.col(ts).alias("_ts"), F.struct(*[F.col(c).alias(c) for c in (ts, *[c for c in columns if c != ts])]).alias("_v"))
    own = F.struct(*[F.col(c) for c in followups.columns]).alias("_row")
    tags = (1, 0) if strict else (0, 1)
    first = baselines.filter(F.col(ts).isNotNull()).select(F.col(subject).alias("_subject"), F.col(ts).alias("_at"), F.lit(tags[0]).alias("_tag"), carried.alias("_base"))
    second = followups.select(F.col(subject).alias("_subject"), F.col(ts).alias("_at"), F.lit(tags[1]).alias("_tag"), own)
    both = first.unionByName(second, allowMissingColumns=True)
    spans = (span,) if isinstance(span, str) else tuple(span)
    found = last_known(both, "_subject", ["_at", "_tag", "_base"], "_base", spans).filter(F.col("_tag") == tags[1])
    return found.select("_row.*", F.col("known._v").alias("base"))


def capture_pairs(df: DataFrame, subject: str, ts: str, measures: Sequence[str]) -> DataFrame:
    """Follow-ups with ``base_*`` columns of the capture before."""
    paired = previous_capture(df, subject, ts, measures).filter("prev IS NOT NULL")
    return paired.select(
        "*", F.col("prev")[ts].alias(f"base_{ts}"),
        *[F.col("prev")[m].alias(f"base_{m}") for m in measures],
    ).drop("prev")


# -------------------------------------------------------------------- metrics


def _metric(name, base, follow, relative, significant, note) -> Column:
    b, f = base.cast("double"), follow.cast("double")
    return F.struct(
        F.lit(name).alias("name"), b.alias("baseline"), f.alias("followup"),
        (f - b).alias("delta"), relative.alias("relative_change"),
        significant.alias("significant"), F.lit(note).alias("note"),
    )


def change_metrics(pairs: DataFrame, field_mm: float | None = None) -> DataFrame:
    """Add ``metrics``, an array with one entry per compared measure."""
    entries = []
    if field_mm:
        b, f = F.col("base_diameter") * field_mm, F.col("diameter") * field_mm
        entries.append(
            _metric(
                FIELD_METRIC[0], b, f, relative_change("base_diameter", "diameter"),
                F.abs(f - b) >= 1.0, FIELD_METRIC[1] % field_mm,
            )
        )
    for column, label, threshold, must_differ, note in CHANGE_METRICS:
        rel = relative_change(f"base_{column}", column)
        flag = F.abs(rel) >= threshold
        if must_differ:
            flag = flag & (F.col(column) != F.col(f"base_{column}"))
        entries.append(_metric(label, F.col(f"base_{column}"), F.col(column), rel, flag, note))
    if "color_distance" in pairs.columns:
        d = F.col("color_distance")
        entries.append(
            _metric(COLOR_DISTANCE[0], F.lit(0.0), d, d, d >= COLOR_DISTANCE[1], COLOR_DISTANCE[2])
        )
    return pairs.withColumn("metrics", F.array(*entries))


def change_report(pairs: DataFrame, ts: str, field_mm: float | None = None) -> DataFrame:
    """Change score, verdict, headline, caveats and growth per pair.

    Optional columns: ``similarity`` and ``color_distance`` of the two pictures,
    ``structures``/``base_structures``, ``reliable``.
    """
    have = set(pairs.columns)
    similarity = F.col("similarity") if "similarity" in have else F.lit(1.0)
    distance = F.col("color_distance") if "color_distance" in have else F.lit(0.0)
    empty = F.array().cast("array<string>")
    df = change_metrics(pairs, field_mm)
    new_colors, lost_colors = attribute_diff("base_colors", "colors")
    new_structures = (
        attribute_diff("base_structures", "structures")[0] if "structures" in have else empty
    )
    df = df.withColumns(
        {
            "diameter_change": relative_change("base_diameter", "diameter"),
            "area_change": relative_change("base_area", "area"),
            "new_colors": new_colors,
            "lost_colors": lost_colors,
            "new_structures": new_structures,
            "days": days_between(f"base_{ts}", ts),
        }
    )

    def part(value: Column, full: float, points: float) -> Column:
        return F.least(value / full, F.lit(1.0)) * points

    score = (
        part(F.abs("diameter_change"), 0.5, 28)
        + part(F.abs("area_change"), 0.8, 18)
        + part(F.abs(F.col("tds") - F.col("base_tds")), 2.0, 22)
        + (1.0 - similarity) * 14
        + part(distance, 0.6, 10)
        + part(F.size("new_colors").cast("double"), 2.0, 8)
        + F.when(F.array_contains("new_structures", MARKER_STRUCTURE), 10.0).otherwise(0.0)
    )
    df = df.withColumn("change_score", clip(score, 0.0, 100.0))
    s = F.col("change_score")
    df = df.withColumn(
        "verdict",
        F.when(s >= 55, "significant_change").when(s >= 28, "minor_change").otherwise("stable"),
    )
    advice = None
    for verdict, text in T.CHANGE_RECOMMENDATIONS.items():
        hit = F.col("verdict") == verdict
        advice = F.when(hit, text) if advice is None else advice.when(hit, text)
    change = F.col("diameter_change")
    words = F.replace("verdict", F.lit("_"), F.lit(" "))
    headline = F.concat_ws(
        "; ",
        F.format_string(
            "%s (%.0f/100)", F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 99)), F.rint(s)
        ),
        F.when(
            F.abs(change) >= 0.05,
            F.format_string(
                "%.0f%% %s in frame", F.rint(F.abs(change) * 100.0),
                F.when(change > 0, "larger").otherwise("smaller"),
            ),
        ),
        F.when(
            F.size("new_colors") > 0, F.format_string("%d new colour(s)", F.size("new_colors"))
        ),
    )
    caveats = texts(
        F.lit(T.CHANGE_CAVEATS["scale"]),
        F.lit(T.CHANGE_CAVEATS["light"]),
        F.lit(None).cast("string") if field_mm else F.lit(T.CHANGE_CAVEATS["no_field"]),
        F.when(~F.col("reliable"), T.CHANGE_CAVEATS["unreliable"]) if "reliable" in have
        else F.lit(None).cast("string"),
        F.when(F.col("days").isNull(), T.CHANGE_CAVEATS["no_dates"]),
    )
    return df.withColumns(
        {
            "recommendation": advice,
            "growth_per_month": growth_per_month(change, F.col("days"), F.col("base_diameter")),
            "headline": headline,
            "caveats": caveats,
        }
    )
