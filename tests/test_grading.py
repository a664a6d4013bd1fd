"""One case per grading rule; rule engine; triage order; narrative."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyscope.functions import grading as GF
from tallyscope.operators import grading as G
from tallyscope.operators import metrics as M
from tallyscope.operators.rules import IMAGE_RULES, apply_rules, in_domain
from tallyscope.sources.taxonomy import CLASS_CODES


def vector(**named):
    rest = 1.0 - sum(named.values())
    others = [c for c in CLASS_CODES if c not in named]
    return [named.get(c, rest / len(others)) for c in CLASS_CODES]


def graded(spark, probs, trained=True, **evidence):
    df = spark.createDataFrame([(1, probs)], "item INT, probs ARRAY<DOUBLE>")
    for name, value in evidence.items():
        kind = G.EVIDENCE[name]
        df = df.withColumn(
            name, F.array(*[F.lit(v) for v in value]) if kind.startswith("array") else F.lit(value).cast(kind)
        )
    return G.grade(df, trained).first()


def test_confident_benign_is_low(spark):
    r = graded(spark, vector(nv=0.96))
    assert r["tier"] == "LOW" and r["overrides"] == [] and not r["requires_human_review"]


def test_critical_class_on_top(spark):
    assert graded(spark, vector(mel=0.93))["tier"] == "CRITICAL"
    r = graded(spark, vector(mel=0.55))
    assert r["tier"] == "HIGH" and r["overrides"][0] == "Melanoma is the top prediction (55.0%)."


def test_critical_probability_without_being_top(spark):
    assert graded(spark, vector(nv=0.55, mel=0.30, bkl=0.15))["tier"] == "HIGH"
    assert graded(spark, vector(nv=0.80, mel=0.12))["tier"] == "MODERATE"


def test_low_confidence_escalates_and_is_reviewed(spark):
    r = graded(spark, vector(nv=0.45, bkl=0.40, df=0.10))
    assert r["tier"] == "MODERATE" and "Model confidence is below 50%." in r["review_reasons"]


def test_malignant_top_and_tds(spark):
    assert graded(spark, vector(bcc=0.9))["tier"] in ("MODERATE", "HIGH")
    r = graded(spark, vector(nv=0.96), tds=5.6, a=2, b=5, c=3, d=2, reliable=True)
    assert r["tier"] == "HIGH" and any("5.45" in o for o in r["overrides"])


def test_unusable_scores_are_indeterminate(spark):
    # Lowest rank, assigned last, wins over every escalation.
    r = graded(spark, vector(mel=0.95), in_domain=False, quality_score=30.0, quality_verdict="poor")
    assert r["tier"] == "INDETERMINATE" and r["malignant_probability"] == 0.0 and r["neural"] == 0.0
    assert r["requires_human_review"] and r["score"] == pytest.approx(70 * 0.30)
    u = graded(spark, vector(mel=0.95), trained=False, tds=3.4, a=1, b=1, c=1, d=1, reliable=True)
    assert u["tier"] == "INDETERMINATE" and u["score"] == pytest.approx(3.4 / 6.8 * 100 * 0.70)


def test_absent_parts_add_nothing(spark):
    r = graded(spark, vector(nv=0.96))
    assert r["morphology"] == r["uncertainty"] == r["quality"] == 0.0
    assert r["score"] == pytest.approx(0.52 * r["neural"])


def test_unreliable_geometry_is_neutral(spark):
    r = graded(spark, vector(nv=0.96), tds=6.0, reliable=False)
    assert r["morphology"] == 20.0 and any("unreliable" in t for t in r["review_reasons"])


def test_critical_quality_messages_become_reasons_once(spark):
    r = graded(spark, vector(nv=0.96), blocking=True, critical_messages=["blurred", "blurred"])
    assert r["review_reasons"] == ["blurred"]


def test_drivers_and_narrative(spark):
    df = spark.createDataFrame([(1, vector(mel=0.8))], "item INT, probs ARRAY<DOUBLE>").withColumns(
        {
            "tds": F.lit(5.0), "a": F.lit(1), "b": F.lit(3), "c": F.lit(4), "d": F.lit(2),
            "reliable": F.lit(True), "attention": F.lit(0.2),
            "colors": F.array(F.lit("red"), F.lit("black")), "structures": F.array().cast("array<string>"),
        }
    )
    r = G.narrative(G.grade(df)).first()
    assert [d["label"] for d in r["drivers"]] == [
        "Neural classification", "ABCD morphometry", "Explanation alignment",
    ]
    assert r["differential"][0].startswith("Melanoma - 80.0%.") and len(r["differential"]) == 3
    assert any("red or vascular areas, black pigment" in f for f in r["findings"])
    assert "D=0/5" in " ".join(r["findings"]) and r["impression"].startswith("Melanoma favoured at 80.0%")


def test_narrative_names_no_class_without_usable_scores(spark):
    rows = [(1, vector(mel=0.8), True, 0.7), (2, vector(mel=0.8), False, 0.2)]
    df = spark.createDataFrame(rows, "item INT, probs ARRAY<DOUBLE>, in_domain BOOLEAN, attention DOUBLE")
    usable, foreign = G.narrative(G.grade(df)).orderBy("item").collect()
    assert usable["impression"].startswith("Melanoma favoured at 80.0%")
    assert usable["explanation"][0].startswith("Grad-CAM places 70%")
    assert foreign["impression"].startswith("Automated classification unavailable: this image")
    assert foreign["summary"].startswith("This image does not appear") and foreign["differential"] == []
    assert not any("Class-specific" in t for t in foreign["advice"])
    assert foreign["limitations"][-1].endswith("withheld rather than reported as a random guess.")
    assert foreign["explanation"][0].startswith("Only 20%")
    (untrained,) = G.narrative(G.grade(df.filter("item = 1"), trained=False)).collect()
    assert "no trained weights" in untrained["impression"] and untrained["limitations"][-1].startswith("No trained model")


def test_malignancy_sum(spark):
    from tallyscope.functions.scores import malignant_sum
    from tallyscope.sources.taxonomy import MALIGNANT_FLAGS

    df = spark.createDataFrame([(vector(mel=0.4, bcc=0.2, akiec=0.1, nv=0.3),)], "p ARRAY<DOUBLE>")
    assert df.select(malignant_sum("p", MALIGNANT_FLAGS).alias("s")).first()["s"] == pytest.approx(0.7)


def test_queue_orders_by_confidence_not_tier(spark):
    df = spark.createDataFrame(
        [(1, "CRITICAL", 0.6), (2, "HIGH", 0.9), (3, "LOW", 0.99), (4, "HIGH", 0.6)],
        "item INT, tier STRING, confidence DOUBLE",
    )
    assert [r["item"] for r in G.triage_queue(df, "item").collect()] == [2, 1, 4]
    assert [r["item"] for r in G.triage_queue(df, "item", by_tier=True).collect()] == [1, 2, 4]


def test_audit_reaches_critical_only_by_override(spark):
    df = spark.createDataFrame(
        [(4, vector(mel=0.99)), (4, vector(bcc=0.99)), (5, vector(nv=0.99))], "target INT, probs ARRAY<DOUBLE>"
    )
    g = G.grade(df)
    assert g.agg(F.max("base_rank")).first()[0] < 4
    net = M.safety_net(g).first()
    assert net["catch_rate"] == 0.5 and net["n_critical"] == 1


def test_stage_switches():
    assert G.resolve_options({"tta": None, "bogus": 1, "gradcam": False}, {"tta": True, "gradcam": True}) == {
        "tta": True, "gradcam": False,
    }


def test_legacy_low_confidence_overrides_everything(spark):
    df = spark.createDataFrame([("nv", 0.4), ("mel", 0.9), ("bcc", 0.9), ("nv", 0.9)], "c STRING, p DOUBLE")
    got = [r[0] for r in df.select(GF.legacy_tier(F.col("c"), F.col("p"))).collect()]
    assert got == ["HIGH RISK", "HIGH RISK", "MODERATE RISK", "LOW RISK"]


def test_image_rules(spark):
    flat = spark.createDataFrame(
        [(256, 256, 256, 1.0, 128.0, 0.0, 0.0, 0.0, 0.0, 0.0)],
        "w INT, h INT, min_dim INT, sharpness DOUBLE, brightness DOUBLE, contrast DOUBLE, glare DOUBLE, "
        "colorfulness DOUBLE, skin DOUBLE, texture DOUBLE",
    )
    r = apply_rules(flat, IMAGE_RULES).withColumn("ok", in_domain()).first()
    # A flat grey frame reports both its flatness and its greyness.
    assert [i["code"] for i in r["issues"]] == [
        "out_of_focus", "low_contrast", "no_dermoscopic_structure", "not_color_image",
    ]
    assert r["score"] == 0.0 and r["verdict"] == "poor" and r["blocking"] and not r["ok"]
