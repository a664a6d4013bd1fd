"""Mask parts, outlines and structures on the 8x8 pictures derived from the vectors.

Kernels are 3x3 and cut-offs looser than the functions' defaults, as the pictures are small.
The SQL twins take other ways: parts by reachability, hull edges by trying all pairs.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.basic import by_sort
from ..operators import analysis as AN
from ..operators import passes as P
from ..operators import raster_components as RC
from ..operators import raster_hull as RH
from ..operators import raster_shape as RS
from ..operators import raster_structures as RT
from ..session import stored
from ..sources import bindings as B
from ..streaming.triage import graded_cases
from ..sources import io as IO
from .case_queries import rel_sql
from .grading_queries import GRADED, REASONS, graded, parts_sql as graded_sql
from .head_queries import VIEW_SUMMARY, head
from .raster_queries import ASYM, BORDER, COLOR_PARTS, FLAT, GEOMETRY, MASK, QUALITY, W3, masked, mirror, paired, px, stencil
from .registry import ORACLES, query
from .score_queries import MARGIN_SQL, VERDICT_SQL, r6
from .sql import CLASSES, TIERS_CTE, entropy_sql


def parts_sql(source: str, flag: str, out: str) -> str:
    """Parts of the flagged pixels, touching at corners too: (image_id, y, x, part)."""
    return f"""
{out}_r AS (SELECT image_id, y * 8 + x AS s, y, x FROM {source} WHERE {flag}
  UNION SELECT r.image_id, r.s, q.y, q.x FROM {out}_r r JOIN {source} q ON q.image_id = r.image_id AND q.{flag} AND greatest(abs(q.y - r.y), abs(q.x - r.x)) = 1),
{out} AS (SELECT image_id, y, x, min(s) AS part FROM {out}_r GROUP BY 1, 2, 3)"""


PARTS = f"""WITH RECURSIVE {MASK},
gr AS (SELECT image_id, y, x FROM mk WHERE NOT is_mask AND (y IN (0, 7) OR x IN (0, 7))
  UNION SELECT q.image_id, q.y, q.x FROM gr g JOIN mk q ON q.image_id = g.image_id AND NOT q.is_mask AND abs(q.y - g.y) + abs(q.x - g.x) = 1),
fl AS (SELECT mk.*, gr.y IS NULL AS inside FROM mk LEFT JOIN gr USING (image_id, y, x)),{parts_sql('fl', 'inside', 'pt')},
ps AS (SELECT image_id, part, count(*) AS area, count(*) FILTER (WHERE NOT is_mask) AS filled, avg(x) AS cx, avg(y) AS cy FROM pt JOIN fl USING (image_id, y, x) GROUP BY 1, 2),
sc AS (SELECT *, area / CAST(64 AS DOUBLE) * (CAST(0.35 AS DOUBLE) + CAST(0.65 AS DOUBLE) * (1 - least(1, sqrt(pow(cx - 4, 2) + pow(cy - 4, 2)) / sqrt(CAST(32 AS DOUBLE))))) AS score FROM ps),
bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(score, 12) DESC, part) AS rn FROM sc) WHERE rn = 1),
pk AS (SELECT fl.* REPLACE (bs.part IS NOT NULL AND pt.part IS NOT DISTINCT FROM bs.part AS is_mask) FROM fl LEFT JOIN pt USING (image_id, y, x) LEFT JOIN bs USING (image_id))"""


def picked(spark, sf_dir):
    """Pixels with the picked part of the filled mask; read from storage by all measures."""
    return stored(RC.picked_mask(masked(spark, sf_dir))[0], "picked")


@query(
    "m12_components",
    PARTS + """ SELECT s.image_id, count(*) AS parts, CAST(sum(s.filled) AS BIGINT) AS filled, any_value(b.part) AS part, any_value(b.area) AS area, round(any_value(b.score), 6) AS score
 FROM sc s JOIN bs b USING (image_id) GROUP BY 1""",
)
def m12_components(spark, sf_dir):
    found = RC.mask_components(masked(spark, sf_dir))
    return found.filter("parts > 0").select("image_id", "parts", "filled", "part", "area", r6("score", "score"))


@query("m12_picked_mask", PARTS + " SELECT image_id, y, x, is_mask FROM pk")
def m12_picked(spark, sf_dir):
    return RC.picked_mask(masked(spark, sf_dir))[0].select("image_id", "y", "x", "is_mask")


HULL = f"""{PARTS},
en AS (SELECT image_id, y, min(x) AS x FROM pk WHERE is_mask GROUP BY 1, 2 UNION SELECT image_id, y, max(x) FROM pk WHERE is_mask GROUP BY 1, 2),
ed AS (SELECT a.image_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM en a JOIN en b ON a.image_id = b.image_id AND (a.x <> b.x OR a.y <> b.y)
  WHERE NOT EXISTS (SELECT 1 FROM en c WHERE c.image_id = a.image_id AND ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
    OR (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) > 0)))"""


@query(
    "m20_shape_descriptors",
    HULL + """,
ha AS (SELECT image_id, abs(sum(ax * by_ - bx * ay)) / CAST(2 AS DOUBLE) AS hull_area FROM ed GROUP BY 1),
wn AS (SELECT i.image_id, wy, wx, count(p.y) AS n, count(*) FILTER (WHERE (p.y = wy) = (p.x = wx)) AS same
  FROM (SELECT DISTINCT image_id FROM pk) i CROSS JOIN range(-1, 8) a(wy) CROSS JOIN range(-1, 8) b(wx)
  JOIN pk p ON p.image_id = i.image_id AND p.is_mask AND p.y BETWEEN wy AND wy + 1 AND p.x BETWEEN wx AND wx + 1 GROUP BY 1, 2, 3),
ln AS (SELECT image_id, CAST(count(*) FILTER (WHERE n = 2 AND same = 1) + sqrt(CAST(2 AS DOUBLE)) * (count(*) FILTER (WHERE n = 3) + 2 * count(*) FILTER (WHERE n = 2 AND same <> 1)) AS DOUBLE) AS perimeter,
  count(*) FILTER (WHERE n = 4) + count(*) FILTER (WHERE n = 3) / CAST(2 AS DOUBLE) AS outlined FROM wn GROUP BY 1),
al AS (SELECT l.*, coalesce(hull_area, 0) AS hull_area, greatest(outlined, 1) AS ar FROM ln l LEFT JOIN ha USING (image_id))
SELECT image_id, round(perimeter, 6) AS perimeter, outlined, hull_area, round(CASE WHEN perimeter > 0 THEN least(1, 4 * pi() * ar / (perimeter * perimeter)) ELSE 0 END, 6) AS circularity,
 round(perimeter * perimeter / (4 * pi() * ar), 6) AS compactness, round(least(1, ar / greatest(hull_area, 1)), 6) AS solidity FROM al""",
)
def m20_shape(spark, sf_dir):
    px = picked(spark, sf_dir)
    filled = px.groupBy("image_id").agg(F.max("is_mask").alias("any")).filter("any")
    found = RH.shape_descriptors(px).join(by_sort(filled), "image_id", "left_semi")
    return found.select("image_id", r6("perimeter", "perimeter"), "outlined", "hull_area", *[r6(c, c) for c in ("circularity", "compactness", "solidity")])


RECTANGLE = HULL + """,
di AS (SELECT DISTINCT image_id, CASE WHEN bx < ax OR bx = ax AND by_ < ay THEN ax - bx ELSE bx - ax END AS ex, CASE WHEN bx < ax OR bx = ax AND by_ < ay THEN ay - by_ ELSE by_ - ay END AS ey FROM ed
  UNION SELECT image_id, 1, 0 FROM en GROUP BY 1 HAVING count(*) = 1),
pr AS (SELECT image_id, ex, ey, sqrt(CAST(ex * ex + ey * ey AS DOUBLE)) AS len, min(x * ex + y * ey) AS p0, max(x * ex + y * ey) AS p1, min(y * ex - x * ey) AS q0, max(y * ex - x * ey) AS q1
  FROM di JOIN en USING (image_id) GROUP BY 1, 2, 3),
re AS (SELECT *, (p1 - p0) / len AS s1, (q1 - q0) / len AS s2, (p0 + p1) / CAST(2 AS DOUBLE) AS p, (q0 + q1) / CAST(2 AS DOUBLE) AS q,
  row_number() OVER (PARTITION BY image_id ORDER BY round((p1 - p0) * (q1 - q0) / (len * len), 9), round(abs(atan2(ey, ex)), 9), ey < 0) AS rn FROM pr),
rc AS (SELECT image_id, (p * ex - q * ey) / (len * len) AS cx, (p * ey + q * ex) / (len * len) AS cy, CASE WHEN s1 >= s2 THEN ex ELSE -ey END / len AS ux, CASE WHEN s1 >= s2 THEN ey ELSE ex END / len AS uy,
  greatest(s1, s2) AS long_side, least(s1, s2) AS short_side FROM re WHERE rn = 1)"""


@query("m14_smallest_rectangle", RECTANGLE + " SELECT image_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(long_side, 6) AS long_side, round(short_side, 6) AS short_side FROM rc")
def m14_rectangle(spark, sf_dir):
    return RH.smallest_rectangles(picked(spark, sf_dir)).select("image_id", *[r6(c, c) for c in ("cx", "cy", "long_side", "short_side")])


@query(
    "m14_asymmetry_rectangle_axes",
    RECTANGLE + """,
mi AS (SELECT m.image_id, m.gray, sg AS axis,
  CAST(floor(round(cy + sg * (2 * ux * uy * (x - cx) - (ux * ux - uy * uy) * (y - cy)), 6) + CAST(0.500001 AS DOUBLE)) AS INTEGER) AS y2,
  CAST(floor(round(cx + sg * ((ux * ux - uy * uy) * (x - cx) + 2 * ux * uy * (y - cy)), 6) + CAST(0.500001 AS DOUBLE)) AS INTEGER) AS x2
  FROM pk m JOIN rc USING (image_id) CROSS JOIN (VALUES (1), (-1)) g(sg) WHERE is_mask),
mj AS (SELECT mi.image_id, axis, mi.gray, q.gray AS g2 FROM mi LEFT JOIN pk q ON q.image_id = mi.image_id AND q.is_mask AND q.y = y2 AND q.x = x2),
mp AS (SELECT image_id, axis, avg(CASE WHEN g2 IS NULL THEN 1.0 ELSE 0.0 END) AS shape,
  coalesce(sum(CASE WHEN g2 IS NULL THEN 2 * gray ELSE abs(gray - g2) END) / nullif(2 * sum(gray), 0), 0) AS color FROM mj GROUP BY 1, 2)
SELECT image_id, count(*) FILTER (WHERE greatest(shape, color) > 0.12) AS a, round(avg(shape), 6) AS shape_index, round(least(1, avg(color)), 6) AS color_index FROM mp GROUP BY 1""",
)
def m14_rectangle_axes(spark, sf_dir):
    px = picked(spark, sf_dir)
    rectangles = RH.smallest_rectangles(px)
    found = RS.asymmetry(px, rectangles).join(by_sort(rectangles), "image_id", "left_semi")
    return found.select("image_id", "a", r6("shape_index", "shape_index"), r6("color_index", "color_index"))


def extreme_sql(source: str, value: str, out: str, fn: str) -> str:
    """Greatest or least value under the cross of five pixels."""
    return f"{out} AS (SELECT p.image_id, p.y, p.x, any_value(p.gray) AS gray, any_value(p.is_mask) AS is_mask, {fn}(q.{value}) AS {value} FROM {source} p JOIN {source} q ON q.image_id = p.image_id AND abs(q.y - p.y) + abs(q.x - p.x) <= 1 GROUP BY 1, 2, 3)"


def kernel_sql(across: tuple, down: tuple) -> str:
    return f"CAST({list(map(float, across))}[dx.o + {len(across) // 2 + 1}] * {list(map(float, down))}[dy.o + {len(down) // 2 + 1}] AS DOUBLE)"


def filters_sql(source: str, value: str, radius: int, outs: str) -> str:
    """Filters over a square of this radius, mirrored at the frame."""
    at = f"JOIN {source} q ON q.image_id = p.image_id AND q.y = {mirror('p.y + dy.o', '8')} AND q.x = {mirror('p.x + dx.o', '8')}"
    return f"SELECT p.image_id, p.y, p.x, any_value(p.gray) AS gray, any_value(p.is_mask) AS is_mask, {outs} FROM {source} p CROSS JOIN range({-radius}, {radius + 1}) dy(o) CROSS JOIN range({-radius}, {radius + 1}) dx(o) {at} GROUP BY 1, 2, 3"


CLEANED = ("min", "max", "max", "max", "min", "min")  # opened, then twice dilated and twice eroded
STEPS = ",\n".join(extreme_sql(f"c{i}", "v", f"c{i + 1}", fn) for i, fn in enumerate(CLEANED))


@query("m12_cleaned_mask", f"WITH {MASK}, c0 AS (SELECT *, CAST(is_mask AS INTEGER) AS v FROM mk), {STEPS} SELECT image_id, y, x, v > 0 AS is_mask FROM c{len(CLEANED)}")
def m12_cleaned(spark, sf_dir):
    return RT.cleaned_mask(masked(spark, sf_dir), 3).select("image_id", "y", "x", "is_mask")


CURVE = f"round(sum(q.soft * ({kernel_sql(RT.SMOOTHING, RT.SECOND)} + {kernel_sql(RT.SECOND, RT.SMOOTHING)})), 6) AS curve"
SLOPES = f"sum(q.gray * {kernel_sql(RT.SLOPE, RT.SLOPE_SMOOTHING)}) AS gx, sum(q.gray * {kernel_sql(RT.SLOPE_SMOOTHING, RT.SLOPE)}) AS gy"
DETECTORS = f"""{PARTS},
d0 AS ({stencil('sum(q.gray * dy.k * dx.k) AS soft, any_value(p.gray) AS gray, any_value(p.is_mask) AS is_mask', W3, 'pk')}),
d1 AS ({filters_sql('d0', 'soft', 2, CURVE)}),
d2 AS (SELECT d1.*, CASE WHEN is_mask AND curve > quantile_cont(curve, 0.8) FILTER (WHERE is_mask) OVER (PARTITION BY image_id) THEN 1 ELSE 0 END AS v FROM d1),
{extreme_sql('d2', 'v', 'd3', 'min')}, {extreme_sql('d3', 'v', 'd4', 'max')},
d5 AS (SELECT *, v > 0 AS hit FROM d4),{parts_sql('d5', 'hit', 'd6')},
tot AS (SELECT image_id, count(*) FILTER (WHERE is_mask) AS total FROM pk GROUP BY 1),
dots AS (SELECT image_id, count(*) AS dots FROM (SELECT image_id, part, count(*) AS area FROM d6 GROUP BY 1, 2) JOIN tot USING (image_id) WHERE area BETWEEN 1 AND greatest(40, total * CAST(0.01 AS DOUBLE)) GROUP BY 1),
n0 AS (SELECT image_id, y, x, gray, is_mask, round(gray, 6) AS v FROM pk),
{extreme_sql('n0', 'v', 'n1', 'max')}, {extreme_sql('n1', 'v', 'n2', 'min')},
n3 AS (SELECT *, round(v - round(gray, 6), 6) AS hat FROM n2),
n4 AS (SELECT n3.* REPLACE (CASE WHEN is_mask AND hat >= greatest(round(quantile_cont(hat, 0.6) FILTER (WHERE is_mask) OVER (PARTITION BY image_id), 6), 6) THEN 1 ELSE 0 END AS v) FROM n3),
{extreme_sql('n4', 'v', 'n5', 'max')}, {extreme_sql('n5', 'v', 'n6', 'min')},
n7 AS (SELECT *, v > 0 AS hit FROM n6),{parts_sql('n7', 'hit', 'n8')},
net AS (SELECT image_id, sum(area) AS ridges, max(area) AS most FROM (SELECT image_id, part, count(*) AS area FROM n8 GROUP BY 1, 2) GROUP BY 1),
s0 AS ({filters_sql('pk', 'gray', 1, SLOPES)}),
s1 AS (SELECT *, sqrt(gx * gx + gy * gy) AS slope, CAST(is_mask AS INTEGER) AS v FROM s0),
{extreme_sql('s1', 'v', 's2', 'min')},
st AS (SELECT image_id, count(*) FILTER (WHERE s1.is_mask AND s2.v = 0) AS rim, avg(slope) FILTER (WHERE s1.is_mask AND s2.v = 0) AS rim_slope, avg(slope) FILTER (WHERE s2.v > 0) AS core_slope
  FROM s1 JOIN s2 USING (image_id, y, x) GROUP BY 1),
fs AS (SELECT image_id, avg(CASE WHEN sqrt(greatest(0, m2 - m * m)) < 6 THEN 1.0 ELSE 0.0 END) FILTER (WHERE is_mask) AS flat FROM ({FLAT.replace("mk", "pk")}) GROUP BY 1),
ve AS (SELECT image_id, avg(CASE WHEN sb < -4 AND light > 35 AND light < 75 THEN 1.0 ELSE 0.0 END) FILTER (WHERE is_mask) AS veil FROM pk GROUP BY 1),
al AS (SELECT image_id, total, coalesce(dots, 0) AS dots, coalesce(ridges / CAST(total AS DOUBLE), 0) AS ridge_share, coalesce(most / CAST(ridges AS DOUBLE), 0) AS mesh_share, rim,
  coalesce(rim_slope, 0) AS rim_slope, coalesce(core_slope, rim_slope, 0) AS core_slope, coalesce(flat, 0) AS flat, coalesce(veil, 0) AS veil
  FROM tot LEFT JOIN dots USING (image_id) LEFT JOIN net USING (image_id) LEFT JOIN st USING (image_id) LEFT JOIN fs USING (image_id) LEFT JOIN ve USING (image_id)),
fg AS (SELECT *, total >= 8 AND flat > 0.30 AS f1, total >= 8 AND dots >= 1 AS f2, total >= 8 AND ridge_share > 0.04 AND mesh_share > 0.25 AS f3,
  total >= 8 AND rim > 4 AND rim_slope > CAST(1.35 AS DOUBLE) * greatest(core_slope, 1e-6) AS f4, total >= 8 AND veil > 0.08 AS f5 FROM al)
SELECT image_id, dots, round(ridge_share, 6) AS ridge_share, round(mesh_share, 6) AS mesh_share, rim, round(rim_slope, 6) AS rim_slope, round(core_slope, 6) AS core_slope,
 f2 AS dots_globules, f3 AS pigment_network, f4 AS streaks,
 concat_ws(',', CASE WHEN f1 THEN 'structureless_area' END, CASE WHEN f2 THEN 'dots_globules' END, CASE WHEN f3 THEN 'pigment_network' END, CASE WHEN f4 THEN 'streaks' END, CASE WHEN f5 THEN 'blue_white_veil' END) AS structures,
 CAST(f1 AS INTEGER) + CAST(f2 AS INTEGER) + CAST(f3 AS INTEGER) + CAST(f4 AS INTEGER) + CAST(f5 AS INTEGER) AS d FROM fg"""

SMALL = {
    "min_area": 8, "dot_options": {"weights": W3, "rank": 0.8, "least": 1}, "min_dots": 1, "network_options": {"size": 3, "rank": 0.6}, "rim_size": 3, "min_rim": 4, "flat_size": 3,
}


@query("m17_structures", DETECTORS)
def m17_structures(spark, sf_dir):
    found = RT.structures(picked(spark, sf_dir), **SMALL)
    return found.select(
        "image_id", "dots", *[r6(c, c) for c in ("ridge_share", "mesh_share")], "rim", *[r6(c, c) for c in ("rim_slope", "core_slope")],
        "dots_globules", "pigment_network", "streaks", F.concat_ws(",", "structures").alias("structures"), "d",
    )


# ------------------------------------------------------------- whole analysis


def on_picked(sql: str) -> str:
    """A twin over the plain mask, over the picked one."""
    return PARTS + re.sub(r"\bmk\b", "pk", sql.removeprefix("WITH ").removeprefix(MASK))


VIEWS = VIEW_SUMMARY[: VIEW_SUMMARY.rindex("\nSELECT vec_id")]
ANALYSIS = f"""WITH {CLASSES}, {TIERS_CTE},
x_views AS ({VIEWS} SELECT vec_id, probs, len(list_filter(picks, lambda t: t = consensus)) / CAST(5 AS DOUBLE) AS agreement FROM c),
x_geo AS ({on_picked(GEOMETRY)} SELECT image_id, conf >= 0.5 AS reliable FROM gc),
x_a AS ({on_picked(ASYM)}), x_b AS ({on_picked(BORDER)}), x_d AS ({DETECTORS}),
x_c AS ({PARTS}, c AS (SELECT image_id, concat_ws(',', {COLOR_PARTS}) AS colors FROM pk WHERE is_mask GROUP BY 1)
  SELECT image_id, colors, CAST(CASE WHEN colors = '' THEN 0 ELSE len(string_split(colors, ',')) END AS INTEGER) AS c FROM c),
x_q AS (WITH {QUALITY} SELECT image_id, CAST(greatest(0, 100 - 40 - CASE WHEN brightness < 45 OR brightness > 215 THEN 12 ELSE 0 END
  - CASE WHEN contrast < 18 THEN 10 ELSE 0 END - CASE WHEN glare > 0.12 THEN 10 ELSE 0 END - CASE WHEN texture < 0.5 THEN 35 ELSE 0 END
  - CASE WHEN colorfulness < 4 THEN 30 WHEN skin < 0.30 THEN 35 ELSE 0 END) AS DOUBLE) AS quality_score,
  (skin >= 0.30 AND colorfulness >= 4 AND texture >= 0.50) AS in_domain FROM q1 JOIN q2 USING (image_id)),
ev1 AS (SELECT vec_id, probs, list_max(probs) AS conf, list_position(probs, list_max(probs)) - 1 AS pred, probs[5] AS pc, agreement, {entropy_sql('probs')} AS ent, {MARGIN_SQL} AS margin,
  CAST(coalesce(a, 0) AS INTEGER) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c, colors, d, structures, reliable, quality_score, in_domain, TRUE AS blocking, CAST(NULL AS DOUBLE) AS attention
  FROM x_views v JOIN x_geo g ON g.image_id = v.vec_id JOIN x_d USING (image_id) JOIN x_q USING (image_id) LEFT JOIN x_a USING (image_id) LEFT JOIN x_b USING (image_id) LEFT JOIN x_c USING (image_id)),
ev AS (SELECT *, CAST(1.3 AS DOUBLE) * a + CAST(0.1 AS DOUBLE) * b + CAST(0.5 AS DOUBLE) * c + CAST(0.5 AS DOUBLE) * d AS tds, {VERDICT_SQL} AS stability FROM ev1), {graded_sql(True)}"""


def analysed(spark, sf_dir):
    """Every picture, scored over its views, measured, graded and told."""
    vectors = B.vecs(spark, sf_dir).select("vec_id", "v")
    passes = P.dihedral_in_row(vectors, "vec_id", "v", head(spark, sf_dir), side=8, n=5, scale=40.0)
    views = P.summarise_views_in_row(passes, "vec_id").select(F.col("vec_id").alias("image_id"), "probs", "agreement")
    return AN.analyse(px(spark, sf_dir, True), views, blur=0, clean=0, stencil=3, structure_options=SMALL)


@query(
    "analysis_document",
    ANALYSIS + """ SELECT vec_id AS image_id, a, b, c, d, round(tds, 6) AS tds, coalesce(colors, '') AS colors, structures, reliable, quality_score, in_domain, round(agreement, 6) AS agreement,
 stability, round(morphology, 6) AS morphology, round(score, 6) AS score, tier FROM gt""",
)
def analysis_document(spark, sf_dir):
    out = analysed(spark, sf_dir)
    return out.select(
        "image_id", "a", "b", "c", "d", r6("tds", "tds"), F.concat_ws(",", "colors").alias("colors"), F.concat_ws(",", "structures").alias("structures"), "reliable", "quality_score",
        "in_domain", r6("agreement", "agreement"), "stability", *[r6(c, c) for c in ("morphology", "score")], "tier",
    )


@query(
    "analysis_case_rows",
    ANALYSIS + f""" SELECT CAST(vec_id AS VARCHAR) AS id, tier, round(score, 1) AS severity_score, round(tds, 6) AS tds, quality_score,
 ({REASONS.replace("'Input failed a critical quality check.'", "'x'")} <> '' OR tier IN ('HIGH', 'CRITICAL', 'INDETERMINATE')) AS requires_review FROM gt""",
)
def analysis_case_rows(spark, sf_dir):
    """The analysis as rows of the case log."""
    graded = analysed(spark, sf_dir).withColumn("at", F.timestamp_seconds(F.lit(1704067200) + F.col("image_id") * 60))
    rows = graded_cases(graded, "image_id", "image_id", "at")
    return rows.select("id", "tier", "severity_score", r6("tds", "tds"), "quality_score", "requires_review")


def raw(name: str, column: str) -> str:
    """A registered twin whose result is not rounded."""
    return re.sub(rf"round\(((?:sqrt|least)\(.*), 6\) AS {column}", rf"\1 AS {column}", ORACLES[name], flags=re.S)


COMPARED = f"""WITH x_geo AS ({on_picked(GEOMETRY)} SELECT image_id, ratio, sqrt(4 * area / pi()) / 8 AS diameter, conf >= 0.5 AS reliable FROM gc),
x_a AS ({on_picked(ASYM)}), x_b AS ({on_picked(BORDER)}), x_d AS ({DETECTORS}), x_dist AS ({raw('m24_histogram_distance', 'color_distance')}), x_sim AS ({raw('m25_similarity', 'similarity')}),
x_c AS ({PARTS} SELECT image_id, concat_ws(',', {COLOR_PARTS}) AS colors, (stddev_pop(r) + stddev_pop(g) + stddev_pop(b)) / 3 AS cv FROM pk WHERE is_mask GROUP BY 1),
im AS (SELECT image_id, diameter, ratio AS area, list_filter(string_split(coalesce(colors, ''), ','), lambda v: v <> '') AS colors, string_split(structures, ',') AS structures, reliable, d,
  CAST(coalesce(a, 0) AS INTEGER) AS a, coalesce(b, 0) AS b, coalesce(cv, 0) AS color_variance
  FROM x_geo JOIN x_d USING (image_id) LEFT JOIN x_a USING (image_id) LEFT JOIN x_b USING (image_id) LEFT JOIN x_c USING (image_id)),
it AS (SELECT *, CAST(1.3 AS DOUBLE) * a + CAST(0.1 AS DOUBLE) * b + CAST(0.5 AS DOUBLE) * len(colors) + CAST(0.5 AS DOUBLE) * d AS tds FROM im),
pairs AS (SELECT pair_id, f.*, p.diameter AS base_diameter, p.area AS base_area, p.tds AS base_tds, p.colors AS base_colors, p.structures AS base_structures, color_distance, similarity
  FROM it p JOIN it f ON f.image_id = p.image_id + 1 AND p.image_id % 2 = 0 JOIN x_dist ON pair_id = p.image_id // 2 JOIN x_sim USING (pair_id)),
s0 AS (SELECT *, {rel_sql('diameter')} AS dc, {rel_sql('area')} AS ac, len(list_filter(colors, lambda v: NOT list_contains(base_colors, v))) AS nn,
  list_contains(structures, 'blue_white_veil') AND NOT list_contains(base_structures, 'blue_white_veil') AS veiled FROM pairs),
s1 AS (SELECT *, least(100, greatest(0, least(abs(dc) / CAST(0.5 AS DOUBLE), 1) * 28 + least(abs(ac) / CAST(0.8 AS DOUBLE), 1) * 18 + least(abs(tds - base_tds) / 2, 1) * 22
  + (1 - similarity) * 14 + least(color_distance / CAST(0.6 AS DOUBLE), 1) * 10 + least(nn / CAST(2 AS DOUBLE), 1) * 8 + CASE WHEN veiled THEN 10 ELSE 0 END)) AS score FROM s0)"""


@query(
    "comparison_document",
    COMPARED + """ SELECT pair_id, round(base_diameter, 6) AS base_diameter, round(diameter, 6) AS diameter, round(tds - base_tds, 6) AS tds_change, round(color_distance, 6) AS color_distance,
 round(similarity, 6) AS similarity, 1 AS days, round(score, 6) AS change_score, CASE WHEN score >= 55 THEN 'significant_change' WHEN score >= 28 THEN 'minor_change' ELSE 'stable' END AS verdict FROM s1""",
)
def comparison_document(spark, sf_dir):
    """Pictures 2k and 2k+1 as captures of one subject on following days."""
    # Both sides of a pair read what was measured once.
    evidence = stored(AN.mask_evidence(picked(spark, sf_dir).repartition("image_id"), SMALL), "evidence")
    n = F.col("vec_id")
    day = lambda i: F.date_add(F.lit("2024-01-01").cast("date"), i.cast("int"))
    pairs = B.table(spark, sf_dir, "embeddings").filter(n % 2 == 0).select(
        F.floor(n / 2).alias("pair_id"), n.alias("base_id"), (n + 1).alias("follow_id"), day(n).alias("base_day"), day(n + 1).alias("day")
    )
    out = AN.compare(evidence, pairs, paired(spark, sf_dir), "day")
    return out.select(
        "pair_id", r6("base_diameter", "base_diameter"), r6("diameter", "diameter"), (F.round(F.col("tds") - F.col("base_tds"), 6) + 0.0).alias("tds_change"), r6("color_distance", "color_distance"),
        (F.round("similarity", 6) + 0.0).alias("similarity"), "days", r6("change_score", "change_score"), "verdict",
    )


@query(
    "batch_document",
    GRADED + """,
it AS (SELECT vec_id, vec_id // 16 AS batch, CASE WHEN vec_id % 17 = 0 THEN 'unsupported_type' WHEN vec_id % 19 = 0 THEN 'empty' END AS error FROM embeddings),
bi AS (SELECT batch, it.vec_id, error IS NULL AND tier IS NOT NULL AS ok, CASE WHEN error IS NOT NULL OR tier IS NULL THEN coalesce(error, 'not_analysed') END AS error, tier, short_name, conf FROM it LEFT JOIN gt USING (vec_id)),
bu AS (SELECT *, CASE WHEN ok AND tier IN ('HIGH', 'CRITICAL') THEN conf END AS urgency FROM bi)
SELECT batch, vec_id, ok, error, CASE WHEN ok THEN tier END AS tier, CASE WHEN ok THEN short_name END AS short_name, CASE WHEN ok THEN round(conf * 100, 2) END AS confidence,
 CASE WHEN urgency IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY batch ORDER BY urgency DESC NULLS LAST, vec_id) AS INTEGER) END AS queue_place, count(*) OVER w AS count,
 count(*) FILTER (WHERE ok) OVER w AS succeeded, count(*) FILTER (WHERE NOT ok) OVER w AS failed, count(urgency) OVER w AS urgent FROM bu WINDOW w AS (PARTITION BY batch)""",
)
def batch_document(spark, sf_dir):
    """Pictures in batches of 16; some come under another type, some without content."""
    n = F.col("vec_id")
    files = B.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.floor(n / 16).alias("batch"), F.concat(F.lit("picture-"), n, F.when(n % 17 == 0, ".txt").otherwise(".png")).alias("filename"), F.when(n % 19 == 0, 0).otherwise(192).alias("size")
    )
    admitted = IO.admit(files, "filename", F.lit(None).cast("string"), F.col("size")).withColumnRenamed("reject_reason", "error")
    return AN.batch_items(admitted, graded(spark, sf_dir), "batch", "vec_id")
