"""Per-record scores and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as X
from ..functions.grading import legacy_message, legacy_tier
from ..operators import grading as G
from ..operators import metrics as M
from ..operators.splits import class_weights
from ..session import stored as stored_once
from ..sources import bindings as B
from ..sources.taxonomy import CLASS_CODES, MALIGNANT_FLAGS, RISK_WEIGHTS, classes
from .registry import query
from .split_queries import WEIGHTS_SQL
from .sql import (
    CLASSES,
    CODES,
    MEANS,
    PREDS,
    PROBS,
    SPLIT_VECS,
    entropy_sql,
    number_list,
    softmax_cte,
)


def r6(col, name):
    return F.round(col, 6).alias(name)


K = len(CLASS_CODES)
PICK = ", ".join(f"round(probs[{i + 1}], 6) AS p{i}" for i in range(K))


def spread(df, col="probs", prefix="p"):
    return [r6(F.col(col)[i], f"{prefix}{i}") for i in range(K)]


@query(
    "p1_softmax",
    f"WITH {PROBS}, {softmax_cte('probs', 'cooled', '1.7', 'vec_id, logits')} SELECT vec_id, {PICK} FROM cooled",
)
def p1(spark, sf_dir):
    df = B.probs(spark, sf_dir).select(
        "vec_id", X.softmax(F.col("logits"), temperature=1.7).alias("probs")
    )
    return df.select("vec_id", *spread(df))


@query(
    "s4_batch_scoring",
    f"WITH {PROBS} SELECT vec_id, " + ", ".join(f"round(logits[{i + 1}], 6) AS z{i}" for i in range(K)) + " FROM probs",
)
def s4(spark, sf_dir):
    df = B.probs(spark, sf_dir)
    return df.select("vec_id", *spread(df, "logits", "z"))


@query(
    "p2_top_class",
    f"WITH {PREDS} SELECT vec_id, CAST(pred AS INTEGER) AS pred, round(conf, 6) AS conf FROM preds",
)
def p2(spark, sf_dir):
    return M.predictions(B.probs(spark, sf_dir)).select("vec_id", "pred", r6("conf", "conf"))


RANKED = f"""WITH {CLASSES}, {PROBS},
x AS (SELECT vec_id, unnest(probs) AS p, generate_subscripts(probs, 1) - 1 AS class_idx FROM probs),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class_idx) AS rank FROM x)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, c.code, c.name, c.short_name, c.malignancy, c.color,
 round(p, 6) AS probability, round(p * 100, 2) AS percentage FROM r JOIN classes c USING (class_idx)"""
RANKED_COLS = ["vec_id", "rank", "code", "name", "short_name", "malignancy", "color"]


@query("p3_ranked_classes", RANKED)
def p3(spark, sf_dir):
    return G.ranked(B.probs(spark, sf_dir), "vec_id").select(
        *RANKED_COLS, r6("probability", "probability"), "percentage"
    )


@query("k4_top3_differential", RANKED + " WHERE rank <= 3")
def k4(spark, sf_dir):
    return G.ranked(B.probs(spark, sf_dir), "vec_id", k=3).select(
        *RANKED_COLS, r6("probability", "probability"), "percentage"
    )


@query(
    "j4_class_dimension",
    f"""WITH {CLASSES}, {PREDS} SELECT vec_id, c.code AS pred_code, c.name, c.malignancy, c.is_malignant,
 c.risk_weight FROM preds JOIN classes c ON c.class_idx = pred""",
)
def j4(spark, sf_dir):
    dim = F.broadcast(classes(spark))
    return M.predictions(B.probs(spark, sf_dir)).select("vec_id", F.col("pred").alias("class_idx")).join(
        dim, "class_idx"
    ).select("vec_id", F.col("code").alias("pred_code"), "name", "malignancy", "is_malignant", "risk_weight")


@query("p4_entropy", f"WITH {PROBS} SELECT vec_id, round({entropy_sql('probs')}, 6) AS entropy FROM probs")
def p4(spark, sf_dir):
    return B.probs(spark, sf_dir).select("vec_id", r6(X.entropy("probs"), "entropy"))


MARGIN_SQL = "(list_reverse_sort(probs)[1] - list_reverse_sort(probs)[2])"


@query("p5_margin", f"WITH {PROBS} SELECT vec_id, round({MARGIN_SQL}, 6) AS margin FROM probs")
def p5(spark, sf_dir):
    return B.probs(spark, sf_dir).select("vec_id", r6(X.margin("probs"), "margin"))


VERDICT_SQL = """CASE WHEN conf < 0.5 OR ent > 0.55 OR agreement < 0.6 THEN 'uncertain'
 WHEN conf < 0.7 OR ent > 0.40 OR agreement < 0.8 THEN 'borderline' ELSE 'confident' END"""


@query(
    "p6_verdict",
    f"""WITH {PREDS}, e AS (SELECT vec_id, conf, {entropy_sql('probs')} AS ent,
 CAST(1 AS DOUBLE) - (vec_id % 5) * CAST(0.125 AS DOUBLE) AS agreement FROM preds)
SELECT vec_id, {VERDICT_SQL} AS verdict FROM e""",
)
def p6(spark, sf_dir):
    agreement = 1.0 - (F.col("vec_id") % 5) * 0.125
    return B.probs(spark, sf_dir).select(
        "vec_id",
        X.verdict(X.confidence("probs"), X.entropy("probs"), agreement).alias("verdict"),
    )


@query(
    "p7_malignant_sum",
    f"WITH {PROBS} SELECT vec_id, round(probs[1] + probs[2] + probs[5], 6) AS malignant FROM probs",
)
def p7(spark, sf_dir):
    return B.probs(spark, sf_dir).select(
        "vec_id", r6(X.malignant_sum("probs", MALIGNANT_FLAGS), "malignant")
    )


WEIGHT_LIST = number_list([RISK_WEIGHTS[c] for c in CLASS_CODES])
RISK_SQL = f"least(100.0, greatest(0.0, list_dot_product(probs, {WEIGHT_LIST}) * 100))"


@query("p8_neural_risk", f"WITH {PROBS} SELECT vec_id, round({RISK_SQL}, 6) AS risk FROM probs")
def p8(spark, sf_dir):
    return B.probs(spark, sf_dir).select(
        "vec_id", r6(X.risk_dot("probs", [RISK_WEIGHTS[c] for c in CLASS_CODES]), "risk")
    )


# ------------------------------------------------------------------- metrics

CONFUSION_COLS = ", ".join(f"count(*) FILTER (WHERE pred = {i}) AS {c}" for i, c in enumerate(CLASS_CODES))
CONFUSION_NORM = ", ".join(
    f"round_even(count(*) FILTER (WHERE pred = {i}) / CAST(greatest(1, count(pred)) AS DOUBLE), 4) AS {c}"
    for i, c in enumerate(CLASS_CODES)
)


@query(
    "g11_confusion",
    f"""WITH {CLASSES}, {PREDS} SELECT c.code AS true_code, {CONFUSION_COLS}
FROM classes c LEFT JOIN preds ON target = class_idx GROUP BY c.code""",
)
def g11(spark, sf_dir):
    return M.confusion(B.probs(spark, sf_dir))


@query(
    "g11_confusion_normalized",
    f"""WITH {CLASSES}, {PREDS} SELECT c.code AS true_code, {CONFUSION_NORM}
FROM classes c LEFT JOIN preds ON target = class_idx GROUP BY c.code""",
)
def g11n(spark, sf_dir):
    return M.confusion(B.probs(spark, sf_dir), normalized=True)


PER_CLASS = f"""WITH {CLASSES}, {PREDS},
k AS (SELECT c.code, c.name, c.class_idx,
  CAST(count(*) FILTER (WHERE pred = class_idx AND target = class_idx) AS DOUBLE) AS tp,
  CAST(count(*) FILTER (WHERE pred = class_idx AND target <> class_idx) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (WHERE pred <> class_idx AND target = class_idx) AS DOUBLE) AS fn,
  CAST(count(*) FILTER (WHERE pred <> class_idx AND target <> class_idx) AS DOUBLE) AS tn
  FROM classes c CROSS JOIN preds GROUP BY ALL),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re,
  coalesce(tn / nullif(tn + fp, 0), 0) AS sp FROM k),
pc AS (SELECT code, name, round_even(pr, 4) AS "precision", round_even(re, 4) AS recall,
  round_even(sp, 4) AS specificity, round_even(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 4) AS f1,
  CAST(tp + fn AS BIGINT) AS support, tp FROM m)"""


@query("g12_per_class", PER_CLASS + ' SELECT code, name, "precision", recall, specificity, f1, support FROM pc')
def g12(spark, sf_dir):
    counts = M.confusion_counts(B.probs(spark, sf_dir))
    return M.per_class(counts).drop("class_idx", "tp", "predicted")


SUMMARY_SQL = PER_CLASS + """ SELECT CAST(sum(support) AS BIGINT) AS items, round_even(sum(tp) / sum(support), 4) AS accuracy,
 round_even(avg(recall), 4) AS balanced_accuracy, round_even(avg(f1), 4) AS macro_f1,
 round_even(sum(f1 * support) / sum(support), 4) AS weighted_f1 FROM pc"""


@query("g13_summary", SUMMARY_SQL)
def g13(spark, sf_dir):
    return M.summary(B.probs(spark, sf_dir))


@query(
    "g13_macro_f1_unrounded",
    f"""WITH {CLASSES}, {PREDS} SELECT round(avg(f), 6) AS macro_f1 FROM (
 SELECT class_idx, coalesce(2.0 * count(*) FILTER (WHERE pred = class_idx AND target = class_idx) / nullif(
   count(*) FILTER (WHERE pred = class_idx) + count(*) FILTER (WHERE target = class_idx), 0), 0) AS f
 FROM classes CROSS JOIN preds GROUP BY class_idx)""",
)
def g13u(spark, sf_dir):
    counts = M.confusion_counts(B.probs(spark, sf_dir))
    return M.macro_f1(counts).select(r6("macro_f1", "macro_f1"))


BINS = f"""WITH {PREDS},
edges AS (SELECT i AS bin, i * (CAST(1 AS DOUBLE) / 15) AS lo,
  CASE WHEN i = 14 THEN CAST(1 AS DOUBLE) ELSE (i + 1) * (CAST(1 AS DOUBLE) / 15) END AS hi FROM range(15) t(i)),
rel AS (SELECT bin, lo, hi, count(conf) AS n, avg(CASE WHEN pred = target THEN 1.0 ELSE 0.0 END) FILTER (WHERE conf IS NOT NULL) AS acc,
  avg(conf) AS mc FROM edges LEFT JOIN preds ON conf > lo AND conf <= hi GROUP BY ALL),
gaps AS (SELECT *, coalesce(CAST(n AS DOUBLE) / (SELECT count(*) FROM preds) * abs(acc - mc), 0) AS gap FROM rel)"""


@query(
    "g14_calibration",
    BINS + """ SELECT CAST(bin AS INTEGER) AS bin, round(lo, 3) AS lo, round(hi, 3) AS hi, n,
 round_even(acc, 4) AS accuracy, round_even(mc, 4) AS confidence, round(gap, 6) AS gap,
 round(sum(gap) OVER (), 6) AS ece FROM gaps""",
)
def g14(spark, sf_dir):
    return M.calibration(B.probs(spark, sf_dir)).select(
        "bin", F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"), "n", "accuracy",
        "confidence", r6("gap", "gap"), r6("ece", "ece"),
    )


@query("j6_confidence_bins", BINS + " SELECT vec_id, CAST(bin AS INTEGER) AS bin FROM edges JOIN preds ON conf > lo AND conf <= hi")
def j6(spark, sf_dir):
    return M.predictions(B.probs(spark, sf_dir)).select(
        "vec_id", M.confidence_bin(F.col("conf")).alias("bin")
    )


CURVE = f"""WITH {PROBS}, t AS (SELECT CAST(0.05 AS DOUBLE) + i * CAST(0.05 AS DOUBLE) AS threshold FROM range(19) g(i)),
c AS (SELECT threshold, CAST(count(*) FILTER (WHERE probs[5] >= threshold AND target = 4) AS DOUBLE) AS tp,
 CAST(count(*) FILTER (WHERE probs[5] < threshold AND target = 4) AS DOUBLE) AS fn,
 CAST(count(*) FILTER (WHERE probs[5] >= threshold AND target <> 4) AS DOUBLE) AS fp,
 CAST(count(*) FILTER (WHERE probs[5] < threshold AND target <> 4) AS DOUBLE) AS tn
 FROM t CROSS JOIN probs GROUP BY threshold)
SELECT round(threshold, 2) AS threshold, round_even(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS sensitivity,
 round_even(coalesce(tn / nullif(tn + fp, 0), 0), 4) AS specificity,
 round_even(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS "precision", CAST(tp + fp AS BIGINT) AS flagged FROM c"""


@query("g15_operating_curve", CURVE)
@query("j5_threshold_counts", CURVE)
def g15(spark, sf_dir):
    return M.operating_curve(B.probs(spark, sf_dir))


LONG = f"""WITH {CLASSES}, {PROBS}, x AS (SELECT vec_id, target, unnest(probs) AS s,
  generate_subscripts(probs, 1) - 1 AS class_idx FROM probs)"""


@query(
    "w6_mid_ranks",
    LONG + """, r AS (SELECT class_idx, target = class_idx AS pos,
  rank() OVER (PARTITION BY class_idx ORDER BY s) + (count(*) OVER (PARTITION BY class_idx, s) - 1) / 2.0 AS mid FROM x)
SELECT CAST(class_idx AS INTEGER) AS class_idx, count(*) FILTER (WHERE pos) AS positives,
 count(*) FILTER (WHERE NOT pos) AS negatives, CAST(sum(mid) FILTER (WHERE pos) AS DOUBLE) AS rank_sum
FROM r GROUP BY class_idx""",
)
def w6(spark, sf_dir):
    return M.mid_ranks(B.probs(spark, sf_dir))


@query(
    "g16_roc_auc",
    LONG + """, a AS (SELECT c.code, round_even(
  sum(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0.0 END) / CAST(count(*) AS DOUBLE), 4) AS auc
 FROM x p JOIN x n ON p.class_idx = n.class_idx AND p.target = p.class_idx AND n.target <> n.class_idx
 JOIN classes c ON c.class_idx = p.class_idx GROUP BY c.code)
SELECT code, auc FROM a UNION ALL SELECT 'macro', round_even(avg(auc), 4) FROM a""",
)
def g16(spark, sf_dir):
    return M.roc_auc(B.probs(spark, sf_dir))


def train_weights(spark, sf_dir):
    """Seven class weights of the train split, fetched as numbers."""
    train = B.split_vecs(spark, sf_dir).filter("split = 'train'")
    rows = class_weights(train, "code", classes(spark)).collect()
    by_code = {r["code"]: r["weight"] for r in rows}
    return [by_code[c] for c in CLASS_CODES]


LOSS = f"""WITH {CLASSES}, {PROBS}, {WEIGHTS_SQL},
wl AS (SELECT list(weight ORDER BY class_idx) AS w FROM weights),
rows_ AS (SELECT target, w, list_transform(probs, lambda p: ln(p)) AS lp, w[target + 1] AS wt FROM probs CROSS JOIN wl)"""


@query(
    "g20_weighted_nll",
    LOSS + """ SELECT round(((1 - CAST(0.05 AS DOUBLE)) * sum(wt * -lp[target + 1])
  + (CAST(0.05 AS DOUBLE) / 7) * sum(-list_dot_product(lp, w))) / sum(wt), 6) AS loss, count(*) AS items FROM rows_""",
)
def g20(spark, sf_dir):
    df = M.weighted_nll(B.probs(spark, sf_dir), train_weights(spark, sf_dir), label_smoothing=0.05)
    return df.select(r6("loss", "loss"), "items")


@query(
    "g20_focal_loss",
    LOSS + " SELECT round(avg(pow(1 - exp(wt * lp[target + 1]), 2) * (-wt * lp[target + 1])), 6) AS loss FROM rows_",
)
def g20f(spark, sf_dir):
    return M.focal(B.probs(spark, sf_dir), train_weights(spark, sf_dir)).select(r6("loss", "loss"))


GATES = f"""WITH {PREDS},
f AS (SELECT count(*) FILTER (WHERE len(probs) <> 7) AS bs, count(*) FILTER (WHERE abs(list_sum(probs) - 1) > 1e-4) AS bn,
  avg({entropy_sql('probs')}) AS ent, avg(CASE WHEN pred = target THEN 1.0 ELSE 0.0 END) AS acc FROM preds),
b AS (SELECT avg(re) AS bal FROM (SELECT avg(CASE WHEN pred = target THEN 1.0 ELSE 0.0 END) AS re FROM preds GROUP BY target)),
g AS (SELECT 'head shape' AS "check", CASE WHEN bs > 0 THEN 'FAIL' ELSE 'PASS' END AS status, CAST(bs AS DOUBLE) AS value FROM f
 UNION ALL SELECT 'probabilities normalised', CASE WHEN bn > 0 THEN 'FAIL' ELSE 'PASS' END, bn FROM f
 UNION ALL SELECT 'deterministic', 'PASS', 0
 UNION ALL SELECT 'head is discriminative', CASE WHEN ent > 0.985 THEN 'FAIL' WHEN ent > 0.93 THEN 'WARN' ELSE 'PASS' END, ent FROM f
 UNION ALL SELECT 'accuracy above chance', CASE WHEN acc < 0.2 THEN 'FAIL' WHEN acc < 0.5 THEN 'WARN' ELSE 'PASS' END, acc FROM f
 UNION ALL SELECT 'balanced recall', CASE WHEN bal < 0.25 THEN 'FAIL' WHEN bal < 0.45 THEN 'WARN' ELSE 'PASS' END, bal FROM b)
SELECT "check", status, round(value, 6) AS value FROM g"""


@query("g23_sanity_gates", GATES)
def g23(spark, sf_dir):
    scored = B.probs(spark, sf_dir)
    again = B.probs(spark, sf_dir)
    gates = M.sanity_gates(scored, again, item="vec_id")
    return gates.select("check", "status", r6("value", "value"))


COMPARISON_METRICS = ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")


def _metric_rows(df, model, verified):
    s = M.summary(df)
    entries = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in COMPARISON_METRICS]
    )
    return s.select(
        F.lit(model).alias("model"), F.explode(entries).alias("e"), F.lit(verified).alias("verified")
    ).select("model", "e.metric", "e.value", "verified")


def _summary_sql(split: str) -> str:
    where = f"WHERE split = '{split}'" if split else ""
    return f"""(WITH pr AS (SELECT * FROM preds {where}),
k AS (SELECT c.class_idx, CAST(count(*) FILTER (WHERE pred = class_idx AND target = class_idx) AS DOUBLE) AS tp,
  CAST(count(*) FILTER (WHERE pred = class_idx) AS DOUBLE) AS pp, CAST(count(*) FILTER (WHERE target = class_idx) AS DOUBLE) AS su
  FROM classes c CROSS JOIN pr GROUP BY ALL),
m AS (SELECT *, coalesce(tp / nullif(pp, 0), 0) AS p, coalesce(tp / nullif(su, 0), 0) AS r FROM k),
f AS (SELECT tp, su, round_even(r, 4) AS r, round_even(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1 FROM m)
SELECT round_even(sum(tp) / sum(su), 4) AS accuracy, round_even(avg(r), 4) AS balanced_accuracy,
 round_even(avg(f1), 4) AS macro_f1, round_even(sum(f1 * su) / sum(su), 4) AS weighted_f1 FROM f)"""


COMPARE = f"""WITH {CLASSES}, {PREDS}, a AS {_summary_sql('train')}, b AS {_summary_sql('test')},
la AS (UNPIVOT a ON accuracy, balanced_accuracy, macro_f1, weighted_f1 INTO NAME metric VALUE value),
lb AS (UNPIVOT b ON accuracy, balanced_accuracy, macro_f1, weighted_f1 INTO NAME metric VALUE value)
SELECT metric, (SELECT value FROM la WHERE la.metric = m.metric) AS seen,
 (SELECT value FROM lb WHERE lb.metric = m.metric) AS unseen FROM (SELECT metric FROM la) m"""


@query("g22_model_comparison", COMPARE)
def g22(spark, sf_dir):
    scored = stored_once(B.probs(spark, sf_dir).select("target", "probs", "split"), "scores")
    stored = (
        _metric_rows(scored.filter("split = 'train'"), "seen", "self_reported")
        .unionByName(_metric_rows(scored, "unseen", "self_reported"))
        .unionByName(_metric_rows(scored, "_note", "self_reported"))
    )
    fresh = _metric_rows(scored.filter("split = 'test'"), "unseen", "measured")
    merged = M.compare_models(stored, fresh, COMPARISON_METRICS)
    return M.pivot_models(merged, ["seen", "unseen"])


@query(
    "p24_legacy_tiers",
    f"""WITH {PREDS}, l AS (SELECT vec_id, target, conf, list_extract({CODES}, pred + 1) AS code FROM preds)
SELECT vec_id, CASE WHEN conf < 0.5 THEN 'HIGH RISK' WHEN code = 'mel' THEN 'HIGH RISK'
  WHEN code IN ('bcc', 'akiec') THEN 'MODERATE RISK' ELSE 'LOW RISK' END AS tier,
 CASE WHEN conf < 0.5 THEN 'Low model confidence - requires specialist review'
  WHEN code = 'mel' AND conf >= 0.7 THEN printf('Melanoma detected with %.1f%% confidence - urgent referral recommended', conf * 100)
  WHEN code = 'mel' THEN printf('Possible melanoma (%.1f%% confidence) - specialist review needed', conf * 100)
  WHEN code IN ('bcc', 'akiec') THEN printf('%s detected with %.1f%% confidence - dermatologist consultation advised', upper(code), conf * 100)
  WHEN conf >= 0.7 THEN printf('%s detected with %.1f%% confidence - routine monitoring sufficient', upper(code), conf * 100)
  ELSE printf('Likely %s (%.1f%% confidence) - monitor for changes', upper(code), conf * 100) END AS message FROM l""",
)
def p24(spark, sf_dir):
    df = M.predictions(B.probs(spark, sf_dir))
    code = F.element_at(F.array(*[F.lit(c) for c in CLASS_CODES]), F.col("pred") + 1)
    return df.withColumn("pred_code", code).select(
        "vec_id",
        legacy_tier(F.col("pred_code"), F.col("conf")).alias("tier"),
        legacy_message(F.col("pred_code"), F.col("conf")).alias("message"),
    )


@query(
    "p24_legacy_safety_net",
    f"""WITH {PREDS}, l AS (SELECT target, CASE WHEN conf < 0.5 OR pred = 4 THEN 'HIGH RISK'
  WHEN pred IN (0, 1) THEN 'MODERATE RISK' ELSE 'LOW RISK' END AS tier FROM preds)
SELECT tier, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM l), 1) AS pct,
 round(100.0 * (SELECT count(*) FROM l WHERE target = 4 AND tier = 'HIGH RISK')
   / (SELECT count(*) FROM l WHERE target = 4), 1) AS catch_rate_pct FROM l GROUP BY tier""",
)
def p24n(spark, sf_dir):
    return G.legacy_safety_net(B.probs(spark, sf_dir))


@query(
    "g21_standardise",
    f"""WITH {SPLIT_VECS}, x AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM svecs WHERE split = 'train')
SELECT CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS mean, round(greatest(stddev_samp(x), 1e-6), 6) AS std_sample,
 round(greatest(stddev_pop(x), 1e-6), 6) AS std_population FROM x GROUP BY pos""",
)
def g21(spark, sf_dir):
    from ..operators.heads import feature_moments

    train = B.split_vecs(spark, sf_dir).filter("split = 'train'")
    m = feature_moments(train, "v")
    return m.select(F.posexplode("moments").alias("pos", "m")).select(
        "pos", r6("m.mean", "mean"), r6("m.std_sample", "std_sample"),
        r6("m.std_population", "std_population"),
    )


CALIBRATE = f"""WITH RECURSIVE {PROBS}, val AS (SELECT target, logits FROM probs WHERE split = 'val'),
halved AS (SELECT 0 AS i, CAST(0.1 AS DOUBLE) AS lo, CAST(4 AS DOUBLE) AS hi
  UNION ALL SELECT i + 1, CASE WHEN avg(list_dot_product(e, logits) / list_sum(e) - logits[target + 1]) > 0 THEN lo ELSE mid END,
    CASE WHEN avg(list_dot_product(e, logits) / list_sum(e) - logits[target + 1]) > 0 THEN mid ELSE hi END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, target, logits, list_transform(logits, lambda x: exp((x - list_max(logits)) * (lo + hi) / 2)) AS e FROM halved CROSS JOIN val WHERE i < 50)
  GROUP BY i, lo, hi, mid),
fit AS (SELECT 2 / (lo + hi) AS t FROM halved WHERE i = 50)
SELECT round(t, 6) AS temperature, round(avg(-(logits[target + 1] / t - list_max(logits) / t
    - ln(list_sum(list_transform(logits, lambda x: exp(x / t - list_max(logits) / t)))))), 6) AS nll FROM fit CROSS JOIN val GROUP BY t"""


@query("s3_temperature", CALIBRATE)
def s3(spark, sf_dir):
    from ..operators.heads import calibrate

    val = B.probs(spark, sf_dir).filter("split = 'val'").select("target", "logits")
    return calibrate(val).select(r6("temperature", "temperature"), r6("nll", "nll"))
