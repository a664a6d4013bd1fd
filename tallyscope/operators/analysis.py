"""The whole analysis of pictures, composed: quality, mask, ABCD measures, views, grade, narrative.

Pixels are moved to their image's partition once and stored with the picked mask; every measure
of the mask reads that and gives one small row per image. The rest is per record.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.basic import by_sort
from ..functions.grading import composite_abcd
from ..functions.scores import confidence, entropy, margin, verdict
from ..session import stored
from . import change as CH
from . import grading as G
from . import raster as R
from . import raster_components as RC
from . import raster_hull as RH
from . import raster_pairs as RP
from . import raster_shape as RS
from . import raster_structures as RT
from .rules import IMAGE_RULES, Rule, apply_rules, in_domain


def picture_quality(px: DataFrame, rules: Sequence[Rule] = IMAGE_RULES, stencil: int = 9) -> DataFrame:
    """One row per image: quality_score, quality_verdict, blocking, critical_messages, in_domain."""
    judged = apply_rules(R.quality_measures(px, stencil), rules)
    critical = F.transform(F.filter("issues", lambda i: i["severity"] == "critical"), lambda i: i["message"])
    return judged.select(
        "image_id", F.col("score").alias("quality_score"), F.col("verdict").alias("quality_verdict"), "blocking",
        critical.alias("critical_messages"), in_domain().alias("in_domain"),
    )


def mask_evidence(px: DataFrame, structure_options: Mapping | None = None) -> DataFrame:
    """One row per image: a, b, c, d, tds, colors, structures, reliable and shape, from ``is_mask``.

    px: stored pixels, colocated by image; all measures share that one exchange.
    """
    geometry = RS.mask_geometry(px).select("image_id", "area_ratio", "diameter_fraction", "reliable")
    joined = geometry
    for found in (
        RS.asymmetry(px).select("image_id", F.col("a").cast("int").alias("a"), "shape_index", "color_index"),
        RS.border(px).select("image_id", "b", "irregularity"),
        RS.colors_present(px).select("image_id", "colors", "c"),
        RT.structures(px, **(structure_options or {})).select("image_id", "structures", "d"),
        RS.color_variance(px),
        RH.shape_descriptors(px).select("image_id", "circularity", "compactness", "solidity"),
    ):
        joined = joined.join(by_sort(found), "image_id")
    abcd = composite_abcd(*(F.col(n) for n in "abcd"))
    return joined.withColumn("tds", abcd["tds"]).withColumn("band", abcd["band"])


def analyse(
    px: DataFrame, views: DataFrame, blur: int = 7, clean: int = RT.CLEAN_SIZE, stencil: int = 9, rules: Sequence[Rule] = IMAGE_RULES,
    structure_options: Mapping | None = None, options: Mapping | None = None, trained: bool = True,
) -> DataFrame:
    """One graded row per image with its evidence and narrative.

    px: pixels colocated by image. views: image_id, probs and agreement over repeated views of
    the picture; images without a score are not graded. clean: size of the mask's opening and
    closing, 0 for none. options switch stages off (see
    ``grading.STAGES``).
    """
    mask = RS.with_mask(px, blur)
    mask, _ = RC.picked_mask(RT.cleaned_mask(mask, clean) if clean else mask)
    # One exchange of the stored pixels, reused by every measure.
    held = R.dealt(stored(mask, "picked"))
    evidence = stored(mask_evidence(held, structure_options), "evidence")
    scored = views.withColumns({"entropy": entropy("probs"), "margin": margin("probs")}).withColumn(
        "stability", verdict(confidence("probs"), F.col("entropy"), F.col("agreement"))
    )
    joined = scored.join(by_sort(evidence), "image_id").join(by_sort(picture_quality(px, rules, stencil)), "image_id")
    return G.narrative(G.grade(G.disable_stages(joined, options), trained=trained))


# What a comparison takes of each capture, and what it calls it.
_COMPARED = {
    "diameter": "diameter_fraction", "area": "area_ratio", "tds": "tds", "a": "a", "b": "b", "c": "c", "color_variance": "color_variance",
    "colors": "colors", "structures": "structures", "reliable": "reliable",
}


def compare(evidence: DataFrame, pairs: DataFrame, pair_px: DataFrame, ts: str, field_mm: float | None = None) -> DataFrame:
    """Change report of pairs of pictures from what was measured on them.

    evidence: rows of ``mask_evidence``. pairs: pair_id, base_id, follow_id and the captures' times
    ``base_<ts>`` and ``<ts>``. pair_px: pixels of both sides, colocated by pair (see ``raster_pairs``);
    their colour distance and similarity are part of the score. Pairs that lack a side are left out.
    """
    def side(key: str, prefix: str) -> DataFrame:
        return by_sort(evidence.select(F.col("image_id").alias(key), *[F.col(c).alias(prefix + n) for n, c in _COMPARED.items()]))

    distance, likeness = by_sort(RP.histogram_distance(pair_px)), by_sort(RP.structural_similarity(pair_px))
    joined = pairs.join(side("base_id", "base_"), "base_id").join(side("follow_id", ""), "follow_id").join(distance, "pair_id").join(likeness, "pair_id")
    both = F.col("reliable") & F.col("base_reliable")
    return CH.change_report(joined.withColumn("reliable", both), ts, field_mm)


def batch_items(items: DataFrame, graded: DataFrame, batch: str, item: str) -> DataFrame:
    """The document of each batch, a row per item: ok, error, tier, short_name, confidence (per cent),
    queue_place (of urgent items, most confident first) and the batch's count, succeeded, failed, urgent.

    items: batch, item and error (null where the item was admitted). An admitted item without a
    graded row has failed too. Places are windows over one batch, which an upload limit bounds.
    """
    name = G._pick([G.SHORT_NAMES[c] for c in G.CLASS_CODES], F.col("top_idx"))
    found = graded.select(item, "tier", name.alias("short_name"), "confidence", F.lit(True).alias("_graded"))
    joined = items.select(batch, item, "error").join(found, item, "left")
    ok = F.col("error").isNull() & F.col("_graded").isNotNull()
    told = joined.select(
        batch, item, ok.alias("ok"), F.when(~ok, F.coalesce("error", F.lit("not_analysed"))).alias("error"),
        *[F.when(ok, F.col(c)).alias(c) for c in ("tier", "short_name")], F.when(ok, F.round(F.col("confidence") * 100, 2)).alias("confidence"),
        F.when(ok & F.col("tier").isin("HIGH", "CRITICAL"), F.col("confidence")).alias("_urgency"),
    )
    whole = W.partitionBy(batch)
    place = F.row_number().over(whole.orderBy(F.desc_nulls_last("_urgency"), item))
    return told.withColumns(
        {
            "queue_place": F.when(F.col("_urgency").isNotNull(), place), "count": F.count(F.lit(1)).over(whole), "succeeded": F.count_if("ok").over(whole),
            "failed": F.count_if(~F.col("ok")).over(whole), "urgent": F.count("_urgency").over(whole),
        }
    ).drop("_urgency")
