"""Grading, rules, triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grading as GF
from ..functions import texts as T
from ..operators import grading as G
from ..operators import metrics as M
from ..operators.rules import Rule, apply_rules
from ..sources import bindings as B
from ..sources.taxonomy import CRITICAL_INDEX  # noqa: F401
from .registry import query
from .score_queries import MARGIN_SQL, RISK_SQL, VERDICT_SQL, r6
from .sql import CLASSES, PREDS, TIERS_CTE, entropy_sql, lit

EVIDENCE = f"""{PREDS},
ev0 AS (SELECT vec_id, target, code, probs, conf, pred, probs[5] AS pc,
  CAST(vec_id % 3 AS INTEGER) AS a, CAST(vec_id % 9 AS INTEGER) AS b, CAST(vec_id % 7 AS INTEGER) AS c,
  CAST(vec_id % 6 AS INTEGER) AS d, vec_id % 13 <> 0 AS reliable,
  CAST(1 AS DOUBLE) - (vec_id % 5) * CAST(0.125 AS DOUBLE) AS agreement, {entropy_sql('probs')} AS ent,
  {MARGIN_SQL} AS margin, CAST(100 - vec_id % 60 AS DOUBLE) AS quality_score, vec_id % 11 <> 0 AS in_domain,
  (vec_id % 11 = 0 OR vec_id % 17 = 0) AS blocking, (vec_id % 10) / CAST(10 AS DOUBLE) AS attention FROM preds),
ev AS (SELECT *, CAST(1.3 AS DOUBLE) * a + CAST(0.1 AS DOUBLE) * b + CAST(0.5 AS DOUBLE) * c + CAST(0.5 AS DOUBLE) * d AS tds,
  {VERDICT_SQL} AS stability,
  CASE WHEN quality_score >= 80 THEN 'good' WHEN quality_score >= 55 THEN 'acceptable' ELSE 'poor' END AS qv FROM ev0)"""


def parts_sql(trained: bool, source: str = "ev") -> str:
    usable = "in_domain" if trained else "FALSE"
    return f"""
pt AS (SELECT *, {usable} AS usable,
  CASE WHEN {usable} THEN probs[1] + probs[2] + probs[5] ELSE 0 END AS mp,
  CASE WHEN {usable} THEN {RISK_SQL} ELSE 0 END AS neural,
  CASE WHEN tds IS NULL THEN 0 WHEN NOT coalesce(reliable, TRUE) THEN 20 ELSE least(100, greatest(0, tds / CAST(6.8 AS DOUBLE) * 100)) END AS morphology,
  coalesce(least(100, greatest(0, 100 * (CAST(0.45 AS DOUBLE) * ent + CAST(0.30 AS DOUBLE) * (1 - agreement) + CAST(0.25 AS DOUBLE) * (1 - margin)))), 0) AS uncertainty,
  coalesce(least(100, greatest(0, 100 - quality_score)), 0) AS quality FROM {source}),
ps AS (SELECT *, CASE WHEN usable THEN CAST(0.52 AS DOUBLE) * neural + CAST(0.24 AS DOUBLE) * morphology + CAST(0.16 AS DOUBLE) * uncertainty + CAST(0.08 AS DOUBLE) * quality
  ELSE CAST(0.70 AS DOUBLE) * morphology + CAST(0.30 AS DOUBLE) * quality END AS score FROM pt),
pr AS (SELECT *, CASE WHEN score >= 72 THEN 4 WHEN score >= 48 THEN 3 WHEN score >= 24 THEN 2 ELSE 1 END AS base_rank FROM ps),
gr AS (SELECT r.*, short_name, name, is_malignant, CASE WHEN NOT usable THEN 0 ELSE greatest(base_rank,
   CASE WHEN pred = 4 AND conf >= 0.7 THEN 4 WHEN pred = 4 THEN 3 WHEN pc >= 0.25 THEN 3 WHEN pc >= 0.10 THEN 2 ELSE 1 END,
   CASE WHEN is_malignant THEN 2 ELSE 1 END, CASE WHEN conf < 0.5 THEN 2 ELSE 1 END,
   CASE WHEN stability = 'uncertain' THEN 2 ELSE 1 END, CASE WHEN tds > 5.45 THEN 3 ELSE 1 END) END AS rank
  FROM pr r JOIN classes ON class_idx = pred),
gt AS (SELECT gr.*, t.tier, t.timeframe, t.action FROM gr JOIN tiers t ON tier_rank = rank)"""


HEAD = f"WITH {CLASSES}, {TIERS_CTE}, {EVIDENCE}, "
GRADED = HEAD + parts_sql(True)
GRADED_UNTRAINED = HEAD + parts_sql(False)


def graded(spark, sf_dir, trained=True):
    return G.grade(B.evidence(spark, sf_dir), trained=trained)


@query(
    "p9_morphology_risk",
    GRADED + " SELECT vec_id, round(morphology, 6) AS morphology FROM gt",
)
def p9(spark, sf_dir):
    return B.evidence(spark, sf_dir).select(
        "vec_id", r6(GF.morphology_risk(F.col("tds"), F.col("reliable")), "morphology")
    )


@query("p10_uncertainty_risk", GRADED + " SELECT vec_id, round(uncertainty, 6) AS uncertainty FROM gt")
def p10(spark, sf_dir):
    return B.evidence(spark, sf_dir).select(
        "vec_id",
        r6(GF.uncertainty_risk(F.col("entropy"), F.col("agreement"), F.col("margin")), "uncertainty"),
    )


PARTS = """ SELECT vec_id, round(neural, 6) AS neural, round(morphology, 6) AS morphology,
 round(uncertainty, 6) AS uncertainty, round(quality, 6) AS quality, round(score, 6) AS score FROM gt"""
PART_COLS = ("neural", "morphology", "uncertainty", "quality", "score")


@query("p12_composite_score", GRADED + PARTS)
def p12(spark, sf_dir):
    parts = G.score_parts(B.evidence(spark, sf_dir))
    return parts.select("vec_id", *[r6(c, c) for c in PART_COLS])


@query("p12_composite_untrained", GRADED_UNTRAINED + PARTS)
def p12u(spark, sf_dir):
    parts = G.score_parts(B.evidence(spark, sf_dir), trained=False)
    return parts.select("vec_id", *[r6(c, c) for c in PART_COLS])


@query(
    "p13_score_tier",
    GRADED + """ SELECT vec_id, CASE base_rank WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MODERATE'
 ELSE 'LOW' END AS score_tier FROM gt""",
)
def p13(spark, sf_dir):
    parts = G.score_parts(B.evidence(spark, sf_dir))
    return parts.select("vec_id", GF.tier_from_score(F.col("score")).alias("score_tier"))


@query("p14_final_tier", GRADED + " SELECT vec_id, tier, rank AS tier_rank FROM gt")
def p14(spark, sf_dir):
    return graded(spark, sf_dir).select("vec_id", "tier", "tier_rank")


@query("p14_final_tier_untrained", GRADED_UNTRAINED + " SELECT vec_id, tier, rank AS tier_rank FROM gt")
def p14u(spark, sf_dir):
    return graded(spark, sf_dir, trained=False).select("vec_id", "tier", "tier_rank")


def when(cond: str, text: str, *args: str) -> str:
    value = f"printf({lit(text)}, {', '.join(args)})" if args else lit(text)
    return f"CASE WHEN {cond} THEN {value} END"


OVERRIDES = f"""CASE WHEN NOT usable THEN {lit(T.OVERRIDE_OUT_OF_DOMAIN)} ELSE concat_ws(' | ',
 CASE WHEN pred = 4 THEN printf({lit(T.OVERRIDE_CRITICAL_TOP)}, conf * 100)
  WHEN pc >= 0.25 THEN printf({lit(T.OVERRIDE_CRITICAL_25)}, pc * 100)
  WHEN pc >= 0.10 THEN printf({lit(T.OVERRIDE_CRITICAL_10)}, pc * 100) END,
 {when('is_malignant AND pred <> 4', T.OVERRIDE_MALIGNANT_TOP, 'short_name')},
 {when('conf < 0.5', T.OVERRIDE_LOW_CONFIDENCE, 'conf * 100')},
 {when('tds > 5.45', T.OVERRIDE_TDS, 'tds')}) END"""
REASONS = f"""concat_ws(' | ', {when('NOT usable', T.REVIEW_OUT_OF_DOMAIN)}, {when('attention < 0.5', T.REVIEW_ATTENTION)},
 {when('usable AND conf < 0.5', T.REVIEW_LOW_CONFIDENCE)},
 {when("usable AND stability = 'uncertain'", T.REVIEW_UNSTABLE)},
 {when('blocking', 'Input failed a critical quality check.')}, {when('NOT reliable', T.REVIEW_UNRELIABLE)})"""


@query(
    "p15_overrides_and_reasons",
    GRADED + f" SELECT vec_id, {OVERRIDES} AS overrides, {REASONS} AS reasons FROM gt",
)
def p15(spark, sf_dir):
    return graded(spark, sf_dir).select(
        "vec_id",
        F.concat_ws(" | ", "overrides").alias("overrides"),
        F.concat_ws(" | ", "review_reasons").alias("reasons"),
    )


@query(
    "p16_human_review",
    GRADED + f" SELECT vec_id, ({REASONS} <> '' OR tier IN ('HIGH', 'CRITICAL', 'INDETERMINATE')) AS requires_human_review FROM gt",
)
def p16(spark, sf_dir):
    return graded(spark, sf_dir).select("vec_id", "requires_human_review")


def driver_sql(cond, label, detail, up, points):
    return f"""SELECT vec_id, '{label}' AS label, {detail} AS detail,
 CASE WHEN {up} THEN 'increases' ELSE 'decreases' END AS direction, round({points}, 1) AS contribution FROM gt WHERE {cond}"""


BAND = "CASE WHEN tds < 4.76 THEN 'benign' WHEN tds <= 5.45 THEN 'suspicious' ELSE 'highly suspicious' END"
DRIVERS = " UNION ALL ".join(
    [
        driver_sql("usable", "Neural classification",
                   f"printf({lit(T.DRIVER_NEURAL)}, short_name, conf * 100, mp * 100)", "neural >= 30",
                   "neural * CAST(0.52 AS DOUBLE)"),
        driver_sql("tds IS NOT NULL", "ABCD morphometry",
                   f"printf({lit(T.DRIVER_MORPHOLOGY)}, tds, {BAND}, a, b, c, d)", "tds >= 4.76",
                   "morphology * CASE WHEN usable THEN CAST(0.24 AS DOUBLE) ELSE CAST(0.70 AS DOUBLE) END"),
        driver_sql("TRUE", "Prediction stability",
                   f"printf({lit(T.DRIVER_STABILITY)}, stability, ent, agreement * 100)",
                   "stability <> 'confident'",
                   "uncertainty * CASE WHEN usable THEN CAST(0.16 AS DOUBLE) ELSE 0 END"),
        driver_sql("TRUE", "Image quality", f"printf({lit(T.DRIVER_QUALITY)}, qv, quality_score)",
                   "quality_score < 70",
                   "quality * CASE WHEN usable THEN CAST(0.08 AS DOUBLE) ELSE CAST(0.30 AS DOUBLE) END"),
        driver_sql("TRUE", "Explanation alignment",
                   f"CASE WHEN attention >= 0.5 THEN {lit(T.DRIVER_ATTENTION_OK)} ELSE {lit(T.DRIVER_ATTENTION_OFF)} END",
                   "attention < 0.5", "CAST(0 AS DOUBLE)"),
    ]
)


@query("p17_risk_drivers", GRADED + f" SELECT * FROM ({DRIVERS})")
def p17(spark, sf_dir):
    return graded(spark, sf_dir).select("vec_id", F.explode("drivers").alias("d")).select(
        "vec_id", "d.label", "d.detail", "d.direction", "d.contribution"
    )


HEADLINE = f"""CASE WHEN NOT usable AND NOT in_domain THEN {lit(T.HEADLINE_OUT_OF_DOMAIN)}
 WHEN tier = 'INDETERMINATE' THEN {lit(T.HEADLINE_UNSUITABLE)} ELSE printf('%s concern - %s at %.0f%% confidence',
 CASE tier WHEN 'LOW' THEN 'Low' WHEN 'MODERATE' THEN 'Moderate' WHEN 'HIGH' THEN 'High' ELSE 'Critical' END, short_name, conf * 100) END"""


@query(
    "p18_guidance_and_headline",
    GRADED + f" SELECT vec_id, tier, timeframe, action AS recommendation, {HEADLINE} AS headline FROM gt",
)
def p18(spark, sf_dir):
    return graded(spark, sf_dir).select("vec_id", "tier", "timeframe", "recommendation", "headline")


@query(
    "p22_narrative",
    GRADED + f""" SELECT vec_id, CASE WHEN usable THEN printf({lit(T.IMPRESSION)}, name, conf * 100, tier, score, action, timeframe)
  WHEN NOT in_domain THEN {lit(T.IMPRESSION_OUT_OF_DOMAIN)} ELSE printf({lit(T.IMPRESSION_UNTRAINED)}, lower(replace(tier, '_', ' '))) END AS impression,
 concat_ws(' ', CASE WHEN usable THEN printf({lit(T.SUMMARY_SCORES)}, name, conf * 100, mp * 100)
  WHEN NOT in_domain THEN {lit(T.SUMMARY_OUT_OF_DOMAIN)} ELSE {lit(T.SUMMARY_UNTRAINED)} END, printf({lit(T.SUMMARY_MORPHOLOGY)}, tds, {BAND}),
  CASE WHEN usable THEN printf({lit(T.SUMMARY_STABILITY)}, stability, agreement * 100, ent) END) AS summary FROM gt""",
)
def p22(spark, sf_dir):
    return G.narrative(graded(spark, sf_dir)).select("vec_id", "impression", "summary")


@query("p22_narrative_sections")
def p22s(spark, sf_dir):
    sections = ("findings", "differential", "explanation", "limitations", "advice")
    text = G.narrative(graded(spark, sf_dir))
    return text.select("vec_id", *[F.concat_ws("\n", s).alias(s) for s in sections])


@query(
    "p29_stage_switches",
    f"WITH {CLASSES}, {TIERS_CTE}, {EVIDENCE}, ev_off AS (SELECT * REPLACE (CAST(NULL AS DOUBLE) AS tds, "
    "CAST(NULL AS BOOLEAN) AS reliable) FROM ev), " + parts_sql(True, "ev_off")
    + " SELECT vec_id, tier, round(score, 6) AS score FROM gt",
)
def p29(spark, sf_dir):
    options = {"morphometry": False, "tta": None, "unknown_option": 1}
    record = G.disable_stages(B.evidence(spark, sf_dir), options)
    return G.grade(record).select("vec_id", "tier", r6("score", "score"))


@query(
    "k3_triage_queue",
    GRADED + " SELECT vec_id, tier, short_name, round(conf * 100, 2) AS confidence FROM gt WHERE tier IN ('HIGH', 'CRITICAL')",
)
def k3(spark, sf_dir):
    queue = G.triage_queue(graded(spark, sf_dir), "vec_id")
    name = G._pick([G.SHORT_NAMES[c] for c in G.CLASS_CODES], F.col("top_idx"))
    return queue.select(
        "vec_id", "tier", name.alias("short_name"),
        F.round(F.col("confidence") * 100, 2).alias("confidence"),
    )


NET = f"""WITH {CLASSES}, {TIERS_CTE}, {PREDS},
ev AS (SELECT *, probs[5] AS pc, CAST(NULL AS DOUBLE) AS tds, TRUE AS reliable, CAST(NULL AS DOUBLE) AS ent,
  CAST(NULL AS DOUBLE) AS agreement, CAST(NULL AS DOUBLE) AS margin, CAST(NULL AS DOUBLE) AS quality_score,
  TRUE AS in_domain, CAST(NULL AS VARCHAR) AS stability FROM preds), {parts_sql(True)}
SELECT count(*) FILTER (WHERE target = 4) AS true_critical,
 count(*) FILTER (WHERE target = 4 AND tier IN ('HIGH', 'CRITICAL')) AS critical_escalated,
 count(*) FILTER (WHERE target NOT IN (0, 1, 4)) AS benign_total,
 count(*) FILTER (WHERE target NOT IN (0, 1, 4) AND tier IN ('HIGH', 'CRITICAL')) AS benign_escalated,
 count(*) FILTER (WHERE tier = 'LOW') AS n_low, count(*) FILTER (WHERE tier = 'MODERATE') AS n_moderate,
 count(*) FILTER (WHERE tier = 'HIGH') AS n_high, count(*) FILTER (WHERE tier = 'CRITICAL') AS n_critical,
 count(*) FILTER (WHERE tier = 'INDETERMINATE') AS n_indeterminate,
 round_even(count(*) FILTER (WHERE target = 4 AND tier IN ('HIGH', 'CRITICAL')) / CAST(count(*) FILTER (WHERE target = 4) AS DOUBLE), 4) AS catch_rate,
 round_even(count(*) FILTER (WHERE target NOT IN (0, 1, 4) AND tier IN ('HIGH', 'CRITICAL')) / CAST(count(*) FILTER (WHERE target NOT IN (0, 1, 4)) AS DOUBLE), 4) AS benign_escalation_rate
FROM gt"""


@query("g17_safety_net", NET)
def g17(spark, sf_dir):
    scored = B.probs(spark, sf_dir).select("vec_id", "target", "probs")
    return M.safety_net(G.grade(scored))


@query(
    "j9_truth_vs_prediction",
    f"""{GRADED} SELECT vec_id, code AS true_code, list_extract(['akiec','bcc','bkl','df','mel','nv','vasc'], pred + 1) AS pred_code,
 pred = target AS hit, tier, concat_ws(' · ', CASE WHEN pred = target THEN 'correct' END,
  CASE WHEN code = 'mel' AND tier IN ('HIGH', 'CRITICAL') THEN 'melanoma escalated' END) AS note FROM gt""",
)
def j9(spark, sf_dir):
    truth = B.vecs(spark, sf_dir).select("vec_id", "code")
    return G.truth_vs_prediction(truth, graded(spark, sf_dir), "vec_id").select(
        "vec_id", "true_code", "pred_code", "hit", "tier", "note"
    )


# ------------------------------------------------------------ documents, rules

DOC_RULES = (
    Rule("too_short", "critical", "chars", "<", 200.0, 40.0, "length", "Text has only %.0f characters.", ("chars",)),
    Rule("short", "warning", "chars", "<", 1000.0, 12.0, "length", "Text is short."),
    Rule("long_words", "warning", "mean_word", ">", 7.0, 10.0, "words", "Words are unusually long."),
    Rule("low_variety", "critical", "distinct_share", "<", 0.30, 35.0, "variety", "Few distinct words."),
    Rule("repetitive", "warning", "distinct_share", "<", 0.60, 10.0, "variety", "Some repetition."),
    Rule("repeated_lines", "warning", "repeat_share", ">", 0.10, 10.0, "lines", "Lines repeat."),
)
DOCQ = r"""docq AS (SELECT doc_id, CAST(length(text) AS DOUBLE) AS chars,
  CAST(list_sum(list_transform(ws, lambda x: length(x))) AS DOUBLE) / nullif(len(ws), 0) AS mean_word,
  CAST(len(list_distinct(ws)) AS DOUBLE) / nullif(len(ws), 0) AS distinct_share,
  1 - CAST(len(list_distinct(ls)) AS DOUBLE) / nullif(len(ls), 0) AS repeat_share
 FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: length(x) > 0) AS ws,
   list_filter(string_split(text, chr(10)), lambda x: length(x) > 0) AS ls FROM documents)),
ru AS (SELECT *, CASE WHEN chars < 200 THEN 'too_short' WHEN chars < 1000 THEN 'short' END AS i1,
  CASE WHEN mean_word > 7 THEN 'long_words' END AS i2,
  CASE WHEN distinct_share < 0.30 THEN 'low_variety' WHEN distinct_share < 0.60 THEN 'repetitive' END AS i3,
  CASE WHEN repeat_share > 0.10 THEN 'repeated_lines' END AS i4 FROM docq),
sc AS (SELECT *, CAST(greatest(0, 100 - CASE i1 WHEN 'too_short' THEN 40 WHEN 'short' THEN 12 ELSE 0 END
  - CASE WHEN i2 IS NULL THEN 0 ELSE 10 END - CASE i3 WHEN 'low_variety' THEN 35 WHEN 'repetitive' THEN 10 ELSE 0 END
  - CASE WHEN i4 IS NULL THEN 0 ELSE 10 END) AS DOUBLE) AS score FROM ru)"""


@query(
    "p19_rule_engine_documents",
    f"""WITH {DOCQ} SELECT doc_id, concat_ws(',', i1, i2, i3, i4) AS codes, score,
 CASE WHEN score >= 80 THEN 'good' WHEN score >= 55 THEN 'acceptable' ELSE 'poor' END AS verdict,
 (coalesce(i1, '') = 'too_short' OR coalesce(i3, '') = 'low_variety') AS blocking FROM sc""",
)
def p19(spark, sf_dir):
    return apply_rules(B.document_metrics(spark, sf_dir), DOC_RULES).select(
        "doc_id", F.concat_ws(",", F.transform("issues", lambda i: i["code"])).alias("codes"),
        "score", "verdict", "blocking",
    )


@query("p11_quality_risk", f"WITH {DOCQ} SELECT doc_id, least(100, greatest(0, 100 - score)) AS risk FROM sc")
def p11(spark, sf_dir):
    scored = apply_rules(B.document_metrics(spark, sf_dir), DOC_RULES)
    return scored.select("doc_id", GF.quality_risk(F.col("score")).alias("risk"))


@query(
    "p21_abcd_composite",
    f"WITH {EVIDENCE} SELECT vec_id, round(tds, 6) AS tds, replace({BAND}, ' ', '_') AS band FROM ev",
)
def p21(spark, sf_dir):
    return B.evidence(spark, sf_dir).select(
        "vec_id", GF.composite_abcd(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("s")
    ).select("vec_id", r6("s.tds", "tds"), F.col("s.band").alias("band"))
