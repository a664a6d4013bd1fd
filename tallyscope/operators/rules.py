"""Threshold rules over metric columns: issues, penalty, score, verdict.

Rules of one ``chain`` are alternatives (the first that holds is reported), rules of
different chains are independent. A rule set is plan text, so applying it is one
projection whatever the number of rules.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.texts import QUALITY_MESSAGES

OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


@dataclass(frozen=True)
class Rule:
    code: str
    severity: str  # warning | critical
    metric: str
    op: str
    threshold: float
    penalty: float
    chain: str
    message: str = ""
    shown: tuple[str, ...] = ()  # SQL expressions filled into the message


# ---- fixed values -----------------------------------------------------------
def _image_rule(code, severity, metric, op, threshold, penalty, chain, shown=()):
    return Rule(code, severity, metric, op, threshold, penalty, chain, QUALITY_MESSAGES[code], shown)


IMAGE_RULES = (
    _image_rule("resolution_too_low", "critical", "min_dim", "<", 64.0, 40.0, "resolution", ("w", "h")),
    _image_rule("resolution_low", "warning", "min_dim", "<", 224.0, 12.0, "resolution", ("w", "h")),
    _image_rule("out_of_focus", "critical", "sharpness", "<", 25.0, 30.0, "focus"),
    _image_rule("soft_focus", "warning", "sharpness", "<", 80.0, 10.0, "focus"),
    _image_rule("underexposed", "warning", "brightness", "<", 45.0, 12.0, "exposure"),
    _image_rule("overexposed", "warning", "brightness", ">", 215.0, 12.0, "exposure"),
    _image_rule("low_contrast", "warning", "contrast", "<", 18.0, 10.0, "contrast"),
    _image_rule("specular_glare", "warning", "glare", ">", 0.12, 10.0, "glare", ("rint(glare * 100)",)),
    _image_rule("no_dermoscopic_structure", "critical", "texture", "<", 0.50, 35.0, "texture"),
    _image_rule("not_color_image", "critical", "colorfulness", "<", 4.0, 30.0, "colour"),
    _image_rule(
        "out_of_distribution", "critical", "skin", "<", 0.30, 35.0, "colour", ("rint(skin * 100)",)
    ),
)
BANDS = ((80.0, "good"), (55.0, "acceptable"))
LOWEST_BAND = "poor"
# ---- end of fixed values ----------------------------------------------------


def _chained(rules: Sequence[Rule]) -> Column:
    expr = None
    for rule in rules:
        holds = OPS[rule.op](F.col(rule.metric), F.lit(rule.threshold))
        message = (
            F.format_string(rule.message, *[F.expr(e) for e in rule.shown])
            if rule.shown
            else F.lit(rule.message)
        )
        issue = F.struct(
            F.lit(rule.code).alias("code"), F.lit(rule.severity).alias("severity"),
            message.alias("message"), F.col(rule.metric).cast("double").alias("value"),
            F.lit(rule.penalty).alias("penalty"),
        )
        expr = F.when(holds, issue) if expr is None else expr.when(holds, issue)
    return expr


def apply_rules(
    df: DataFrame, rules: Sequence[Rule], base: float = 100.0, bands=BANDS, lowest: str = LOWEST_BAND
) -> DataFrame:
    """Add ``issues``, ``score``, ``verdict`` and ``blocking``."""
    chains: dict[str, list[Rule]] = {}
    for rule in rules:
        chains.setdefault(rule.chain, []).append(rule)
    issues = F.array_compact(F.array(*[_chained(c) for c in chains.values()]))
    df = df.withColumn("issues", issues)
    penalty = F.aggregate("issues", F.lit(0.0), lambda s, i: s + i["penalty"])
    df = df.withColumn("score", F.greatest(F.lit(0.0), F.lit(float(base)) - penalty))
    verdict = None
    for cut, name in bands:
        hit = F.col("score") >= cut
        verdict = F.when(hit, name) if verdict is None else verdict.when(hit, name)
    return df.withColumn("verdict", verdict.otherwise(lowest)).withColumn(
        "blocking", F.exists("issues", lambda i: i["severity"] == "critical")
    )


def in_domain(skin: float = 0.30, colour: float = 4.0, texture: float = 0.50) -> Column:
    """All three plausibility checks hold."""
    return (
        (F.col("skin") >= skin) & (F.col("colorfulness") >= colour) & (F.col("texture") >= texture)
    )
