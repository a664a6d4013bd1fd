"""Grading expressions: risk parts, composite, tiers, ABCD composite."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..sources.taxonomy import TIERS
from .basic import clip, literal_array

# ---- fixed values -----------------------------------------------------------
PART_WEIGHTS = {"neural": 0.52, "morphology": 0.24, "uncertainty": 0.16, "quality": 0.08}
PART_WEIGHTS_NO_SCORES = {"neural": 0.0, "morphology": 0.70, "uncertainty": 0.0, "quality": 0.30}
TIER_CUTS = ((72.0, "CRITICAL"), (48.0, "HIGH"), (24.0, "MODERATE"))
TDS_SCALE = 6.8
TDS_SUSPICIOUS = 4.76
TDS_HIGHLY_SUSPICIOUS = 5.45
UNRELIABLE_RISK = 20.0
# ---- end of fixed values ----------------------------------------------------


def morphology_risk(tds: Column, reliable: Column) -> Column:
    """0 when not measured, a neutral value when the geometry is unreliable."""
    return (
        F.when(tds.isNull(), 0.0)
        .when(~F.coalesce(reliable, F.lit(True)), UNRELIABLE_RISK)
        .otherwise(clip(tds / TDS_SCALE * 100.0, 0.0, 100.0))
    )


def uncertainty_risk(entropy: Column, agreement: Column, margin: Column) -> Column:
    combined = (
        0.45 * entropy + 0.30 * (1.0 - agreement) + 0.25 * (1.0 - clip(margin, 0.0, 1.0))
    )
    return clip(combined * 100.0, 0.0, 100.0)


def quality_risk(score: Column) -> Column:
    return clip(100.0 - score, 0.0, 100.0)


def composite(parts: dict[str, Column], usable: Column) -> Column:
    """Weighted sum of the parts; absent parts add 0 and weights stay as they are."""
    with_scores = without = F.lit(0.0)
    for name, value in parts.items():
        with_scores = with_scores + value * PART_WEIGHTS[name]
        without = without + value * PART_WEIGHTS_NO_SCORES[name]
    return F.when(usable, with_scores).otherwise(without)


def tier_rank(score: Column) -> Column:
    """LOW's rank plus one for every cut reached (the score appears once)."""
    cuts = literal_array([cut for cut, _tier in TIER_CUTS])
    return F.size(F.filter(cuts, lambda c: score >= c)) + TIERS["LOW"][0]


def by_rank(rank: Column, field: int | None = None) -> Column:
    """Tier name (or another field of the tier table) for a rank."""
    rows = sorted(TIERS.items(), key=lambda kv: kv[1][0])
    values = [name if field is None else row[field] for name, row in rows]
    return F.element_at(literal_array(values), rank + 1)


def tier_name(rank: Column) -> Column:
    return by_rank(rank)


def tier_from_score(score: Column) -> Column:
    return tier_name(tier_rank(score))


def composite_abcd(a: Column, b: Column, c: Column, d: Column) -> Column:
    """struct(tds, band) from the four ABCD scores."""
    tds = 1.3 * a + 0.1 * b + 0.5 * c + 0.5 * d
    return F.struct(tds.alias("tds"), tds_band(tds).alias("band"))


def tds_band(tds: Column) -> Column:
    return (
        F.when(tds < TDS_SUSPICIOUS, "benign")
        .when(tds <= TDS_HIGHLY_SUSPICIOUS, "suspicious")
        .when(tds.isNotNull(), "highly_suspicious")
    )


def legacy_tier(code: Column, conf: Column) -> Column:
    """The single-rule tiers; low confidence overrides everything."""
    return (
        F.when(conf < 0.5, "HIGH RISK")
        .when(code == "mel", "HIGH RISK")
        .when(code.isin("bcc", "akiec"), "MODERATE RISK")
        .when(code.isin("nv", "bkl", "df", "vasc"), "LOW RISK")
        .otherwise("UNKNOWN")
    )


def legacy_message(code: Column, conf: Column) -> Column:
    pct, upper = conf * 100.0, F.upper(code)
    say = F.format_string
    sure = conf >= 0.7
    return (
        F.when(conf < 0.5, "Low model confidence - requires specialist review")
        .when(
            code == "mel",
            F.when(
                sure,
                say("Melanoma detected with %.1f%% confidence - urgent referral recommended", pct),
            ).otherwise(
                say("Possible melanoma (%.1f%% confidence) - specialist review needed", pct)
            ),
        )
        .when(
            code.isin("bcc", "akiec"),
            say("%s detected with %.1f%% confidence - dermatologist consultation advised", upper, pct),
        )
        .when(
            code.isin("nv", "bkl", "df", "vasc"),
            F.when(
                sure,
                say("%s detected with %.1f%% confidence - routine monitoring sufficient", upper, pct),
            ).otherwise(say("Likely %s (%.1f%% confidence) - monitor for changes", upper, pct)),
        )
        .otherwise("Unable to determine risk level")
    )
