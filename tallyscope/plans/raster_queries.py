"""Raster measurements on the 8x8 pictures derived from the vectors.

Windows are 3x3 and cells 4x4 to fit pictures of that size; cut-offs that would
hardly fire on them are passed looser. The functions' defaults are the full-size ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts as T
from ..functions.color import with_gray, with_hsv, with_lab, with_ycrcb
from ..operators import raster as R
from ..operators import raster_pairs as RP
from ..operators import raster_shape as RS
from ..operators.rules import IMAGE_RULES, apply_rules, in_domain
from ..sources import bindings as B
from .registry import query
from .score_queries import r6
from .sql import lit


def px(spark, sf_dir, colocate=False):
    return R.pixels(B.raster_arrays(spark, sf_dir), colocate)


def masked(spark, sf_dir):
    return RS.with_mask(px(spark, sf_dir, colocate=True), blur=0)


def paired(spark, sf_dir):
    """Pictures 2k and 2k+1 as baseline and follow-up, colocated by pair."""
    arrays = B.raster_arrays(spark, sf_dir).withColumns(
        {"pair_id": F.floor(F.col("image_id") / 2), "side": (F.col("image_id") % 2).cast("int")}
    )
    long = R.moved(arrays, "pair_id").select(
        "pair_id", "side", "w", "h", F.posexplode_outer("px").alias("_pos", "_p")
    ).filter("_pos IS NOT NULL")
    return long.select(
        "pair_id", "side", "w", "h", F.floor(F.col("_pos") / F.col("w")).cast("int").alias("y"),
        (F.col("_pos") % F.col("w")).cast("int").alias("x"), "_p.r", "_p.g", "_p.b",
    )


D = "CAST({} AS DOUBLE)".format
PX = """
rs AS (SELECT vec_id AS image_id, list_transform(e, lambda v: floor((v - list_min(e)) / (list_max(e) - list_min(e)) * 255)) AS s
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),
px0 AS (SELECT image_id, CAST(pos // 8 AS INTEGER) AS y, CAST(pos % 8 AS INTEGER) AS x, 8 AS w, 8 AS h,
  s[pos + 1] AS r, s[(pos + 21) % 64 + 1] AS g, s[(pos + 42) % 64 + 1] AS b FROM rs CROSS JOIN range(64) t(pos)),
px1 AS (SELECT *, CAST(0.299 AS DOUBLE) * r + CAST(0.587 AS DOUBLE) * g + CAST(0.114 AS DOUBLE) * b AS gray,
  greatest(r, g, b) AS val, least(r, g, b) AS lo,
  CASE WHEN r / 255 > CAST(0.04045 AS DOUBLE) THEN pow((r / 255 + CAST(0.055 AS DOUBLE)) / CAST(1.055 AS DOUBLE), CAST(2.4 AS DOUBLE)) ELSE r / 255 / CAST(12.92 AS DOUBLE) END AS lr,
  CASE WHEN g / 255 > CAST(0.04045 AS DOUBLE) THEN pow((g / 255 + CAST(0.055 AS DOUBLE)) / CAST(1.055 AS DOUBLE), CAST(2.4 AS DOUBLE)) ELSE g / 255 / CAST(12.92 AS DOUBLE) END AS lg,
  CASE WHEN b / 255 > CAST(0.04045 AS DOUBLE) THEN pow((b / 255 + CAST(0.055 AS DOUBLE)) / CAST(1.055 AS DOUBLE), CAST(2.4 AS DOUBLE)) ELSE b / 255 / CAST(12.92 AS DOUBLE) END AS lb FROM px0),
px2 AS (SELECT *, CASE WHEN val = 0 THEN 0 ELSE (val - lo) / val * 255 END AS sat,
  CASE WHEN val = lo THEN 0 WHEN val = r THEN 60 * (g - b) / (val - lo) WHEN val = g THEN 120 + 60 * (b - r) / (val - lo)
    ELSE 240 + 60 * (r - g) / (val - lo) END AS hue0,
  (CAST(0.412453 AS DOUBLE) * lr + CAST(0.357580 AS DOUBLE) * lg + CAST(0.180423 AS DOUBLE) * lb) / CAST(0.950456 AS DOUBLE) AS xx,
  CAST(0.212671 AS DOUBLE) * lr + CAST(0.715160 AS DOUBLE) * lg + CAST(0.072169 AS DOUBLE) * lb AS yy,
  (CAST(0.019334 AS DOUBLE) * lr + CAST(0.119193 AS DOUBLE) * lg + CAST(0.950227 AS DOUBLE) * lb) / CAST(1.088754 AS DOUBLE) AS zz FROM px1),
px3 AS (SELECT *, CASE WHEN hue0 < 0 THEN hue0 + 360 ELSE hue0 END AS hue,
  CASE WHEN xx > 0.008856 THEN cbrt(xx) ELSE CAST(7.787 AS DOUBLE) * xx + CAST(16 AS DOUBLE) / 116 END AS fx,
  CASE WHEN yy > 0.008856 THEN cbrt(yy) ELSE CAST(7.787 AS DOUBLE) * yy + CAST(16 AS DOUBLE) / 116 END AS fy,
  CASE WHEN zz > 0.008856 THEN cbrt(zz) ELSE CAST(7.787 AS DOUBLE) * zz + CAST(16 AS DOUBLE) / 116 END AS fz FROM px2),
px AS (SELECT image_id, y, x, w, h, r, g, b, gray, val, sat, hue, CASE WHEN yy > 0.008856 THEN 116 * fy - 16 ELSE CAST(903.3 AS DOUBLE) * yy END AS light,
  500 * (fx - fy) AS sa, 200 * (fy - fz) AS sb, (r - gray) * CAST(0.713 AS DOUBLE) + 128 AS cr, (b - gray) * CAST(0.564 AS DOUBLE) + 128 AS cb FROM px3)"""


def mirror(expr: str, size: str) -> str:
    return f"(CASE WHEN {expr} < 0 THEN -({expr}) WHEN {expr} >= {size} THEN 2 * ({size} - 1) - ({expr}) ELSE {expr} END)"


def stencil(select: str, weights: list[float] | None = None, source: str = "px") -> str:
    """3x3 neighbourhood aggregate; ``select`` speaks of centre p, neighbour q, weight k."""
    weights = weights or [1 / 3] * 3
    table = ", ".join(f"({i - 1}, CAST({w!r} AS DOUBLE))" for i, w in enumerate(weights))
    return f"""SELECT p.image_id, p.y, p.x, {select} FROM {source} p
 CROSS JOIN (VALUES {table}) dy(o, k) CROSS JOIN (VALUES {table}) dx(o, k)
 JOIN {source} q ON q.image_id = p.image_id AND q.y = {mirror('p.y + dy.o', 'p.h')} AND q.x = {mirror('p.x + dx.o', 'p.w')}
 GROUP BY p.image_id, p.y, p.x"""


W3 = R.gaussian_weights(3)
CHANNEL = f"""{PX},
lim AS (SELECT image_id, quantile_cont(light, 0.01) AS l0, quantile_cont(light, 0.99) AS l1,
  quantile_cont(b, 0.01) AS b0, quantile_cont(b, 0.99) AS b1 FROM px GROUP BY image_id),
ch AS (SELECT px.*, floor((CAST(0.65 AS DOUBLE) * (1 - CASE WHEN l1 - l0 < 1e-3 THEN 0 ELSE least(1, greatest(0, (light - l0) / (l1 - l0))) END)
  + CAST(0.35 AS DOUBLE) * (1 - CASE WHEN b1 - b0 < 1e-3 THEN 0 ELSE least(1, greatest(0, (b - b0) / (b1 - b0))) END)) * 255) AS channel
  FROM px JOIN lim USING (image_id))"""


def otsu_sql(source: str, value: str, out: str) -> str:
    """Thresholds by trying every present value as a cut."""
    return f"""
{out}_h AS (SELECT image_id, CAST(floor({value}) AS BIGINT) AS bin, count(*) AS n FROM {source} GROUP BY 1, 2),
{out}_c AS (SELECT t.image_id, t.bin, sum(v.n) FILTER (WHERE v.bin <= t.bin) AS n1, sum(v.n * v.bin) FILTER (WHERE v.bin <= t.bin) AS s1,
  sum(v.n) AS n, sum(v.n * v.bin) AS s FROM {out}_h t JOIN {out}_h v USING (image_id) GROUP BY 1, 2),
{out}_v AS (SELECT *, coalesce(CAST(n * s1 - n1 * s AS DOUBLE) * CAST(n * s1 - n1 * s AS DOUBLE) / nullif(CAST(n1 AS DOUBLE) * CAST(n - n1 AS DOUBLE), 0), 0) AS v FROM {out}_c),
{out} AS (SELECT image_id, bin AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v DESC, bin) AS rn FROM {out}_v) WHERE rn = 1)"""


MASK = f"""{CHANNEL},{otsu_sql('ch', 'channel', 'ot')},
mk AS (SELECT ch.*, floor(channel) > threshold AS is_mask FROM ch JOIN ot USING (image_id))"""



@query(
    "m1_color_spaces",
    f"""WITH {PX} SELECT image_id, y, x, round(gray, 6) AS gray, round(hue, 6) AS hue, round(sat, 6) AS sat, round(val, 6) AS val,
 round(light, 6) AS lightness, round(sa, 6) AS a_star, round(sb, 6) AS b_star, round(cr, 6) AS cr, round(cb, 6) AS cb FROM px""",
)
def m1(spark, sf_dir):
    p = with_ycrcb(with_lab(with_hsv(with_gray(px(spark, sf_dir)))))
    names = ("gray", "hue", "sat", "val", "lightness", "a_star", "b_star", "cr", "cb")
    return p.select("image_id", "y", "x", *[(F.round(n, 6) + 0.0).alias(n) for n in names])


@query(
    "m2_exposure",
    f"WITH {PX} SELECT image_id, round(avg(gray), 6) AS brightness, round(stddev_pop(gray), 6) AS contrast FROM px GROUP BY 1",
)
def m2(spark, sf_dir):
    e = R.exposure(px(spark, sf_dir))
    return e.select("image_id", r6("brightness", "brightness"), r6("contrast", "contrast"))


LAP = f"""WITH {PX}, l AS (SELECT p.image_id, p.y, p.x, sum(q.gray) - 4 * any_value(p.gray) AS lap FROM px p
 CROSS JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dy, dx)
 JOIN px q ON q.image_id = p.image_id AND q.y = {mirror('p.y + o.dy', 'p.h')} AND q.x = {mirror('p.x + o.dx', 'p.w')}
 GROUP BY 1, 2, 3)"""


@query("m3_sharpness", LAP + " SELECT image_id, round(var_pop(lap), 4) AS sharpness FROM l GROUP BY 1")
def m3(spark, sf_dir):
    return R.sharpness(px(spark, sf_dir, True)).select("image_id", F.round("sharpness", 4).alias("sharpness"))


COLORFUL = f"""WITH {PX}, o AS (SELECT image_id, abs({{0}} - g) AS rg, abs(CAST(0.5 AS DOUBLE) * ({{0}} + g) - {{1}}) AS yb FROM px)
SELECT image_id, round(sqrt(var_pop(rg) + var_pop(yb)) + CAST(0.3 AS DOUBLE) * sqrt(pow(avg(rg), 2) + pow(avg(yb), 2)), 6) AS colorfulness FROM o GROUP BY 1"""


@query("m4_colorfulness", COLORFUL.format("b", "r"))
def m4(spark, sf_dir):
    return R.colorfulness(px(spark, sf_dir)).select("image_id", r6("colorfulness", "colorfulness"))


@query("m4_colorfulness_rgb", COLORFUL.format("r", "b"))
def m4_rgb(spark, sf_dir):
    return R.colorfulness(px(spark, sf_dir), "rgb").select("image_id", r6("colorfulness", "colorfulness"))


SKIN = """((((hue / 2 >= 0 AND hue / 2 <= 28) OR (hue / 2 >= 160 AND hue / 2 <= 180)) AND sat >= 15 AND val >= 30)
 OR (cr >= 130 AND cr <= 183 AND cb >= 74 AND cb <= 130))"""


@query(
    "m5_skin_fraction",
    f"WITH {PX} SELECT image_id, round(avg(CASE WHEN {SKIN} THEN 1.0 ELSE 0.0 END), 6) AS skin FROM px GROUP BY 1",
)
def m5(spark, sf_dir):
    return R.skin_fraction(px(spark, sf_dir)).select("image_id", r6("skin", "skin"))


@query(
    "m6_glare_fraction",
    f"WITH {PX} SELECT image_id, round(avg(CASE WHEN val > 180 AND sat < 90 THEN 1.0 ELSE 0.0 END), 6) AS glare FROM px GROUP BY 1",
)
def m6(spark, sf_dir):
    return R.glare_fraction(px(spark, sf_dir), 180, 90).select("image_id", r6("glare", "glare"))


@query(
    "m6_glare_fraction_default",
    f"WITH {PX} SELECT image_id, round(avg(CASE WHEN val > 245 AND sat < 30 THEN 1.0 ELSE 0.0 END), 6) AS glare FROM px GROUP BY 1",
)
def m6d(spark, sf_dir):
    return R.glare_fraction(px(spark, sf_dir)).select("image_id", r6("glare", "glare"))


LOCAL = stencil("avg(q.gray) AS m, avg(q.gray * q.gray) AS m2")


@query(
    "m7_texture",
    f"WITH {PX}, l AS ({LOCAL}) SELECT image_id, round(stddev_pop(sqrt(greatest(0, m2 - m * m))), 4) AS texture FROM l GROUP BY 1",
)
def m7(spark, sf_dir):
    return R.texture(px(spark, sf_dir, True), 3).select("image_id", F.round("texture", 4).alias("texture"))


@query(
    "m8_dark_border",
    f"""WITH {PX}, b AS (SELECT image_id, gray FROM px WHERE y < 2 UNION ALL SELECT image_id, gray FROM px WHERE y >= h - 2
 UNION ALL SELECT image_id, gray FROM px WHERE x < 2 UNION ALL SELECT image_id, gray FROM px WHERE x >= w - 2)
SELECT image_id, round(avg(CASE WHEN gray < 80 THEN 1.0 ELSE 0.0 END), 6) AS dark_border FROM b GROUP BY 1""",
)
def m8(spark, sf_dir):
    return R.dark_border(px(spark, sf_dir), dark=80).select("image_id", r6("dark_border", "dark_border"))


GAINS = f"""WITH {PX}, tint AS (SELECT image_id, r, g * CAST(0.75 AS DOUBLE) AS g, b * CAST(0.5 AS DOUBLE) AS b FROM px),
n AS (SELECT image_id, pow(avg(pow(r, 6)), CAST(1 AS DOUBLE) / 6) AS nr, pow(avg(pow(g, 6)), CAST(1 AS DOUBLE) / 6) AS ng,
 pow(avg(pow(b, 6)), CAST(1 AS DOUBLE) / 6) AS nb FROM tint GROUP BY 1),
gn AS (SELECT image_id, sqrt(nr * nr + ng * ng + nb * nb) / sqrt(3) / greatest(nr, 1e-6) AS gr, sqrt(nr * nr + ng * ng + nb * nb) / sqrt(3) / greatest(ng, 1e-6) AS gg,
 sqrt(nr * nr + ng * ng + nb * nb) / sqrt(3) / greatest(nb, 1e-6) AS gb FROM n)"""


def tinted(frame):
    """The three channels hold the same values; dimming two gives a colour cast."""
    return frame.withColumns({"g": F.col("g") * 0.75, "b": F.col("b") * 0.5})


@query(
    "m9_gains",
    GAINS + " SELECT image_id, round(gr, 6) AS gain_r, round(gg, 6) AS gain_g, round(gb, 6) AS gain_b FROM gn",
)
def m9(spark, sf_dir):
    g = R.gray_world_gains(tinted(px(spark, sf_dir)))
    return g.select("image_id", *[r6(f"gain_{c}", f"gain_{c}") for c in "rgb"])


@query(
    "m9_color_constancy",
    GAINS + """ SELECT image_id, round(avg(floor(least(255, r * gr) + 1e-6)), 6) AS r, round(avg(floor(least(255, g * gg) + 1e-6)), 6) AS g,
 round(avg(floor(least(255, b * gb) + 1e-6)), 6) AS b FROM tint JOIN gn USING (image_id) GROUP BY 1""",
)
def m9c(spark, sf_dir):
    fixed = R.correct_colors(tinted(px(spark, sf_dir, True)))
    return fixed.groupBy("image_id").agg(*[r6(F.avg(c), c) for c in "rgb"])


@query("m10_otsu_gray", f"WITH {PX},{otsu_sql('px', 'gray', 'ot')} SELECT image_id, threshold FROM ot")
def m10(spark, sf_dir):
    return RS.otsu(with_gray(px(spark, sf_dir)), "image_id", "gray").select("image_id", "threshold")


@query(
    "m10_otsu_any_column",
    f"""WITH v AS (SELECT event_type AS image_id, least(255, floor(value)) AS value FROM events),{otsu_sql('v', 'value', 'ot')}
SELECT image_id AS event_type, threshold FROM ot""",
)
def m10_events(spark, sf_dir):
    events = B.table(spark, sf_dir, "events").select("event_type", F.least(F.lit(255.0), "value").alias("value"))
    return RS.otsu(events, "event_type", "value").select("event_type", "threshold")


@query("m11_lesion_channel", f"WITH {CHANNEL} SELECT image_id, y, x, channel FROM ch")
def m11(spark, sf_dir):
    return RS.lesion_channel(px(spark, sf_dir, True), blur=0).select("image_id", "y", "x", "channel")


SMOOTH = stencil("sum(q.channel * dy.k * dx.k) AS channel", W3, "ch")


@query("m11_lesion_channel_blurred", f"WITH {CHANNEL}, bl AS ({SMOOTH}) SELECT image_id, y, x, round(channel, 6) AS channel FROM bl")
def m11b(spark, sf_dir):
    c = RS.lesion_channel(px(spark, sf_dir, True), blur=3)
    return c.select("image_id", "y", "x", r6("channel", "channel"))


GEOMETRY = f"""WITH {MASK}, e AS (SELECT *, CAST(y = 0 AS INTEGER) + CAST(y = h - 1 AS INTEGER) + CAST(x = 0 AS INTEGER) + CAST(x = w - 1 AS INTEGER) AS t FROM mk),
ge AS (SELECT image_id, count(*) AS total, count(*) FILTER (WHERE is_mask) AS area, avg(x) FILTER (WHERE is_mask) AS cx, avg(y) FILTER (WHERE is_mask) AS cy,
 min(x) FILTER (WHERE is_mask) AS x0, max(x) FILTER (WHERE is_mask) AS x1, min(y) FILTER (WHERE is_mask) AS y0, max(y) FILTER (WHERE is_mask) AS y1,
 CAST(sum(t) FILTER (WHERE is_mask) AS DOUBLE) / sum(t) AS touch FROM e GROUP BY 1),
gf AS (SELECT *, area / CAST(total AS DOUBLE) AS ratio FROM ge),
gc AS (SELECT *, CASE WHEN ratio < 0.005 OR ratio > 0.95 THEN CAST(0.15 AS DOUBLE) ELSE (CASE WHEN ratio < 0.01 OR ratio > 0.92 THEN CAST(0.55 AS DOUBLE) ELSE CAST(0.85 AS DOUBLE) END)
  * CASE WHEN coalesce(touch, 0) > 0.4 THEN CAST(0.6 AS DOUBLE) ELSE 1 END END AS conf FROM gf)"""


@query(
    "m12_mask_geometry",
    GEOMETRY + """ SELECT image_id, area, round(ratio, 6) AS area_ratio, round(coalesce(cx, 4), 6) AS cx, round(coalesce(cy, 4), 6) AS cy,
 round(sqrt(4 * area / pi()), 6) AS diameter_px, round(sqrt(4 * area / pi()) / 8, 6) AS diameter_fraction, coalesce(x0, 0) AS bbox_x, coalesce(y0, 0) AS bbox_y,
 coalesce(x1 - x0 + 1, 0) AS bbox_w, coalesce(y1 - y0 + 1, 0) AS bbox_h, round(coalesce(touch, 0), 6) AS edge_share, round(conf, 6) AS confidence, conf >= 0.5 AS reliable FROM gc""",
)
def m12(spark, sf_dir):
    g = RS.mask_geometry(masked(spark, sf_dir))
    floats = ("area_ratio", "cx", "cy", "diameter_px", "diameter_fraction", "edge_share", "confidence")
    return g.select(
        "image_id", "area", *[r6(c, c) for c in floats], "bbox_x", "bbox_y", "bbox_w", "bbox_h", "reliable"
    )


BORDER = f"""WITH {MASK},
rim AS (SELECT p.* FROM mk p WHERE p.is_mask AND (SELECT count(*) FROM mk q WHERE q.image_id = p.image_id AND q.is_mask AND abs(q.y - p.y) + abs(q.x - p.x) = 1) < 4),
cen AS (SELECT image_id, avg(x) AS cx, avg(y) AS cy FROM mk WHERE is_mask GROUP BY 1),
rr AS (SELECT image_id, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) AS rad, CAST(floor(((degrees(atan2(y - cy, x - cx)) + 360) + 1e-9) / 45) AS BIGINT) % 8 AS sector
  FROM rim JOIN cen USING (image_id)),
rs2 AS (SELECT image_id, sector, count(*) AS k, stddev_pop(rad) AS sd FROM rr GROUP BY 1, 2),
rt AS (SELECT image_id, count(*) AS points, avg(rad) AS mr FROM rr GROUP BY 1)
SELECT image_id, CAST(count(*) FILTER (WHERE k >= 3 AND points >= 8 AND sd / mr > 0.12) AS INTEGER) AS b,
 round(least(1, coalesce(avg(sd / mr) FILTER (WHERE k >= 3 AND points >= 8), 0) / CAST(0.30 AS DOUBLE)), 6) AS irregularity
FROM rs2 JOIN rt USING (image_id) GROUP BY 1"""


@query("m13_border", BORDER)
def m13(spark, sf_dir):
    return RS.border(masked(spark, sf_dir)).select("image_id", "b", r6("irregularity", "irregularity"))


MOMENTS = f"""{MASK},
mo AS (SELECT image_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, CAST(count(*) * sum(x * x) - sum(x) * sum(x) AS DOUBLE) AS vxx,
 CAST(count(*) * sum(y * y) - sum(y) * sum(y) AS DOUBLE) AS vyy, CAST(count(*) * sum(x * y) - sum(x) * sum(y) AS DOUBLE) AS vxy FROM mk WHERE is_mask GROUP BY 1)"""
ASYM = f"""WITH {MOMENTS},
ax AS (SELECT image_id, sx / CAST(n AS DOUBLE) AS cx, sy / CAST(n AS DOUBLE) AS cy, cos(atan2(2 * vxy, vxx - vyy)) AS c, sin(atan2(2 * vxy, vxx - vyy)) AS s FROM mo),
mi AS (SELECT m.image_id, m.gray, sg AS axis, CAST(floor(cy + sg * (s * (x - cx) - c * (y - cy)) + CAST(0.500001 AS DOUBLE)) AS INTEGER) AS y2,
  CAST(floor(cx + sg * (c * (x - cx) + s * (y - cy)) + CAST(0.500001 AS DOUBLE)) AS INTEGER) AS x2
  FROM mk m JOIN ax USING (image_id) CROSS JOIN (VALUES (1), (-1)) g(sg) WHERE is_mask),
mj AS (SELECT mi.image_id, axis, mi.gray, q.gray AS g2 FROM mi LEFT JOIN mk q ON q.image_id = mi.image_id AND q.is_mask AND q.y = y2 AND q.x = x2),
mp AS (SELECT image_id, axis, avg(CASE WHEN g2 IS NULL THEN 1.0 ELSE 0.0 END) AS shape,
  coalesce(sum(CASE WHEN g2 IS NULL THEN 2 * gray ELSE abs(gray - g2) END) / nullif(2 * sum(gray), 0), 0) AS color FROM mj GROUP BY 1, 2)
SELECT image_id, count(*) FILTER (WHERE greatest(shape, color) > 0.12) AS a, round(avg(shape), 6) AS shape_index, round(least(1, avg(color)), 6) AS color_index FROM mp GROUP BY 1"""


@query("m14_asymmetry", ASYM)
@query("j10_mirror_join", ASYM)
def m14(spark, sf_dir):
    a = RS.asymmetry(masked(spark, sf_dir))
    return a.select("image_id", "a", r6("shape_index", "shape_index"), r6("color_index", "color_index"))


COLORS = {
    "white": "light > 70 AND sat / 255 < 0.18",
    "red": "sa > 18 AND sat / 255 > 0.30 AND (hue < 25 OR hue > 335)",
    "light_brown": "light >= 45 AND light <= 75 AND sb > 8 AND sa > 3",
    "dark_brown": "light >= 20 AND light < 45 AND sb > 5",
    "blue_gray": "sb < -3 AND light > 20 AND light < 70",
    "black": "light < 20",
}
COLOR_PARTS = ", ".join(
    f"CASE WHEN avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END) >= 0.05 THEN {lit(n)} END" for n, c in COLORS.items()
)


@query(
    "m15_colors",
    f"""WITH {MASK}, c AS (SELECT image_id, concat_ws(',', {COLOR_PARTS}) AS colors FROM mk WHERE is_mask GROUP BY 1)
SELECT image_id, colors, CAST(CASE WHEN colors = '' THEN 0 ELSE len(string_split(colors, ',')) END AS INTEGER) AS c FROM c""",
)
def m15(spark, sf_dir):
    c = RS.colors_present(masked(spark, sf_dir))
    return c.select("image_id", F.concat_ws(",", "colors").alias("colors"), "c")


@query(
    "m16_veil",
    f"WITH {MASK} SELECT image_id, round(avg(CASE WHEN sb < -4 AND light > 35 AND light < 75 THEN 1.0 ELSE 0.0 END), 6) AS veil FROM mk WHERE is_mask GROUP BY 1",
)
def m16(spark, sf_dir):
    return RS.veil_fraction(masked(spark, sf_dir)).select("image_id", r6("veil", "veil"))


FLAT = stencil("sum(q.gray * dy.k * dx.k) AS m, sum(q.gray * q.gray * dy.k * dx.k) AS m2, any_value(p.is_mask) AS is_mask", W3, "mk")


@query(
    "m17_structureless",
    f"""WITH {MASK}, l AS ({FLAT}), f AS (SELECT image_id, avg(CASE WHEN sqrt(greatest(0, m2 - m * m)) < 6 THEN 1.0 ELSE 0.0 END) AS share FROM l WHERE is_mask GROUP BY 1)
SELECT image_id, round(share, 6) AS flat_share, share > 0.30 AS structureless FROM f""",
)
def m17(spark, sf_dir):
    f = RS.structureless(masked(spark, sf_dir), 3)
    return f.select("image_id", r6("flat_share", "flat_share"), "structureless")


@query(
    "m18_surround_contrast",
    f"""WITH {MASK}, d AS (SELECT p.*, EXISTS (SELECT 1 FROM mk q WHERE q.image_id = p.image_id AND q.is_mask AND abs(q.y - p.y) + abs(q.x - p.x) <= 1) AS dil FROM mk p)
SELECT image_id, round(coalesce(least(1, greatest(0, abs(avg(light * CAST(2.55 AS DOUBLE)) FILTER (WHERE dil AND NOT is_mask) - avg(light * CAST(2.55 AS DOUBLE)) FILTER (WHERE is_mask)) / 255 * 4)), 0), 6) AS contrast FROM d GROUP BY 1""",
)
def m18(spark, sf_dir):
    return RS.surround_contrast(masked(spark, sf_dir), 3).select("image_id", r6("contrast", "contrast"))


@query(
    "m19_color_variance",
    f"WITH {MASK} SELECT image_id, round((stddev_pop(r) + stddev_pop(g) + stddev_pop(b)) / 3, 6) AS color_variance FROM mk WHERE is_mask GROUP BY 1",
)
def m19(spark, sf_dir):
    return RS.color_variance(masked(spark, sf_dir)).select("image_id", r6("color_variance", "color_variance"))


@query(
    "m20_eccentricity",
    f"""WITH {MOMENTS}, q AS (SELECT image_id, vxx + vyy AS t, sqrt(pow(vxx - vyy, 2) + 4 * vxy * vxy) AS d FROM mo)
SELECT image_id, round(CASE WHEN t + d <= 0 THEN 0 ELSE sqrt(greatest(0, 1 - (t - d) / (t + d))) END, 6) AS eccentricity FROM q""",
)
def m20(spark, sf_dir):
    return RS.eccentricity(masked(spark, sf_dir)).select("image_id", r6("eccentricity", "eccentricity"))


@query(
    "m21_channel_histograms",
    f"""WITH {PX}, c AS (SELECT image_id, ch, CAST(floor(v / 8) AS BIGINT) AS bin, count(*) AS n FROM (
 SELECT image_id, 0 AS ch, r AS v FROM px UNION ALL SELECT image_id, 1, g FROM px UNION ALL SELECT image_id, 2, b FROM px) GROUP BY ALL),
f AS (SELECT i.image_id, slot, coalesce(n, 0) AS n FROM (SELECT DISTINCT image_id FROM px) i CROSS JOIN range(96) s(slot)
 LEFT JOIN c ON c.image_id = i.image_id AND c.ch * 32 + c.bin = slot)
SELECT image_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY slot) AS histogram FROM f GROUP BY 1""",
)
def m21(spark, sf_dir):
    h = R.channel_histograms(px(spark, sf_dir))
    return h.select("image_id", F.concat_ws(",", F.col("histogram").cast("array<string>")).alias("histogram"))


HOG = f"""WITH {PX}, lu AS (SELECT *, (CAST(0.2125 AS DOUBLE) * r + CAST(0.7154 AS DOUBLE) * g + CAST(0.0721 AS DOUBLE) * b) / 255 AS l FROM px),
gd AS (SELECT image_id, y, x, CASE WHEN x BETWEEN 1 AND 6 THEN lead(l) OVER rw - lag(l) OVER rw ELSE 0 END AS gx,
  CASE WHEN y BETWEEN 1 AND 6 THEN lead(l) OVER cl - lag(l) OVER cl ELSE 0 END AS gy FROM lu
  WINDOW rw AS (PARTITION BY image_id, y ORDER BY x), cl AS (PARTITION BY image_id, x ORDER BY y)),
cl AS (SELECT image_id, y // 4 AS cy, x // 4 AS cx, CAST(floor((fmod(degrees(atan2(gy, gx)) + 360, 180) + 1e-9) / CAST(22.5 AS DOUBLE)) AS BIGINT) % 8 AS bin,
  sqrt(gx * gx + gy * gy) AS mag FROM gd),
hs AS (SELECT image_id, (cy * 2 + cx) * 8 + bin AS slot, sum(mag) / 16 AS v FROM cl GROUP BY 1, 2),
fl AS (SELECT i.image_id, slot, coalesce(v, 0) AS v FROM (SELECT DISTINCT image_id FROM px) i CROSS JOIN range(32) s(slot) LEFT JOIN hs USING (image_id, slot)),
n1 AS (SELECT *, least(CAST(0.2 AS DOUBLE), v / sqrt(sum(v * v) OVER (PARTITION BY image_id) + 1e-10)) AS u FROM fl)
SELECT image_id, CAST(slot AS INTEGER) AS slot, round(u / sqrt(sum(u * u) OVER (PARTITION BY image_id) + 1e-10), 6) AS feature FROM n1"""


@query("m22_oriented_gradients", HOG)
def m22(spark, sf_dir):
    h = R.oriented_gradients(px(spark, sf_dir, True), cell=4)
    return h.select("image_id", F.posexplode("features").alias("slot", "feature")).select(
        "image_id", "slot", r6("feature", "feature")
    )


CONC = f"""WITH {PX}, k AS (SELECT *, gray / 255 AS cam, row_number() OVER (PARTITION BY image_id ORDER BY gray / 255 DESC, y, x) AS rn FROM px)
SELECT image_id, round(sum(cam) FILTER (WHERE rn <= 6) / sum(cam), 6) AS concentration FROM k GROUP BY 1"""


@query("m23_concentration", CONC)
@query("w9_top_share", CONC)
def m23(spark, sf_dir):
    cam = with_gray(px(spark, sf_dir, True)).withColumn("cam", F.col("gray") / 255)
    return RS.concentration(cam, "cam").select("image_id", r6("concentration", "concentration"))


@query(
    "m23_alignment",
    f"""WITH {MASK}, s AS (SELECT image_id, sum(gray / 255) AS t, sum(gray / 255) FILTER (WHERE is_mask) AS i, avg(gray / 255) FILTER (WHERE is_mask) AS mi,
  avg(gray / 255) FILTER (WHERE NOT is_mask) AS mo FROM mk GROUP BY 1),
l AS (SELECT image_id, i / t AS inside, CASE WHEN coalesce(mo, 0) > 1e-8 THEN least(10, mi / mo) ELSE 10 END AS lift FROM s)
SELECT image_id, round(inside, 6) AS inside_ratio, round(lift, 6) AS lift, round(least(1, CAST(0.6 AS DOUBLE) * inside + CAST(0.4 AS DOUBLE) * least(lift / 3, 1)), 6) AS verdict FROM l""",
)
def m23a(spark, sf_dir):
    m = with_gray(masked(spark, sf_dir)).withColumn("cam", F.col("gray") / 255)
    a = RS.alignment(m, "cam")
    return a.select("image_id", r6("inside_ratio", "inside_ratio"), r6("lift", "lift"), r6("verdict", "verdict"))


PAIR = f"""{PX}, pa AS (SELECT *, image_id // 2 AS pair_id, image_id % 2 AS side FROM px)"""


@query(
    "m24_histogram_distance",
    f"""WITH {PAIR}, bn AS (SELECT pair_id, side, CAST(floor(hue / 2 * 32 / 180) * 32 + floor(sat * 32 / 256 - CASE WHEN sat = 256 THEN 1 ELSE 0 END) AS BIGINT) AS bin, count(*) AS n FROM pa GROUP BY ALL),
mx AS (SELECT pair_id, max(n) FILTER (WHERE side = 0) AS ma, max(n) FILTER (WHERE side = 1) AS mb FROM bn GROUP BY 1),
pb AS (SELECT pair_id, bin, coalesce(max(n) FILTER (WHERE side = 0), 0) AS a, coalesce(max(n) FILTER (WHERE side = 1), 0) AS b FROM bn GROUP BY 1, 2)
SELECT pair_id, round(sqrt(greatest(0, 1 - sum(sqrt(a / CAST(ma AS DOUBLE) * b / CAST(mb AS DOUBLE))) / sqrt(sum(a / CAST(ma AS DOUBLE)) * sum(b / CAST(mb AS DOUBLE))))), 6) AS color_distance
FROM pb JOIN mx USING (pair_id) WHERE ma > 0 AND mb > 0 GROUP BY 1""",
)
def m24(spark, sf_dir):
    return RP.histogram_distance(paired(spark, sf_dir)).select("pair_id", r6("color_distance", "color_distance"))


SSIM = f"""WITH {PAIR}, j AS (SELECT a.pair_id, a.y, a.x, a.gray AS u, b.gray AS v FROM pa a JOIN pa b ON a.pair_id = b.pair_id AND a.y = b.y AND a.x = b.x AND a.side = 0 AND b.side = 1),
lo AS (SELECT p.pair_id, p.y, p.x, avg(q.u) AS ma, avg(q.v) AS mb, covar_samp(q.u, q.u) AS va, covar_samp(q.v, q.v) AS vb, covar_samp(q.u, q.v) AS vab
 FROM j p JOIN j q ON p.pair_id = q.pair_id AND abs(p.y - q.y) <= 3 AND abs(p.x - q.x) <= 3 WHERE p.y BETWEEN 3 AND 4 AND p.x BETWEEN 3 AND 4 GROUP BY 1, 2, 3)
SELECT pair_id, round(least(1, greatest(0, avg((2 * ma * mb + CAST(6.5025 AS DOUBLE)) * (2 * vab + CAST(58.5225 AS DOUBLE)) / ((ma * ma + mb * mb + CAST(6.5025 AS DOUBLE)) * (va + vb + CAST(58.5225 AS DOUBLE)))))), 6) AS similarity FROM lo GROUP BY 1"""


@query("m25_similarity", SSIM)
def m25(spark, sf_dir):
    return RP.structural_similarity(paired(spark, sf_dir)).select(
        "pair_id", (F.round("similarity", 6) + 0.0).alias("similarity")
    )


@query(
    "m25_correlation",
    f"""WITH {PAIR} SELECT a.pair_id, round(least(1, greatest(0, corr(a.gray, b.gray))), 6) AS correlation
 FROM pa a JOIN pa b ON a.pair_id = b.pair_id AND a.y = b.y AND a.x = b.x AND a.side = 0 AND b.side = 1 GROUP BY 1""",
)
def m25c(spark, sf_dir):
    return RP.gray_correlation(paired(spark, sf_dir)).select(
        "pair_id", (F.round("correlation", 6) + 0.0).alias("correlation")
    )


@query(
    "m26_difference_map",
    f"""WITH {PAIR}, d AS (SELECT a.pair_id, a.y, a.x, abs(a.light - b.light) * CAST(2.55 AS DOUBLE) + abs(a.sa - b.sa) + abs(a.sb - b.sb) AS m
 FROM pa a JOIN pa b ON a.pair_id = b.pair_id AND a.y = b.y AND a.x = b.x AND a.side = 0 AND b.side = 1)
SELECT pair_id, y, x, round((m - min(m) OVER (PARTITION BY pair_id)) / (max(m) OVER (PARTITION BY pair_id) - min(m) OVER (PARTITION BY pair_id)), 6) AS difference FROM d""",
)
def m26(spark, sf_dir):
    return RP.difference_map(paired(spark, sf_dir)).select("pair_id", "y", "x", r6("difference", "difference"))


@query(
    "m27_mask_crop",
    GEOMETRY + """, bx AS (SELECT image_id, coalesce(x0, 0) AS bx, coalesce(y0, 0) AS by_, coalesce(x1 - x0 + 1, 0) AS bw, coalesce(y1 - y0 + 1, 0) AS bh FROM ge),
bp AS (SELECT *, CAST(floor(CAST(0.12 AS DOUBLE) * greatest(bw, bh)) AS INTEGER) AS p FROM bx),
bq AS (SELECT image_id, CASE WHEN bw < 4 OR bh < 4 THEN 0 ELSE greatest(0, bx - p) END AS xa, CASE WHEN bw < 4 OR bh < 4 THEN 0 ELSE greatest(0, by_ - p) END AS ya,
  CASE WHEN bw < 4 OR bh < 4 THEN 8 ELSE least(8, bx + bw + p) END AS xb, CASE WHEN bw < 4 OR bh < 4 THEN 8 ELSE least(8, by_ + bh + p) END AS yb FROM bp)
SELECT image_id, CAST(y - ya AS INTEGER) AS y, CAST(x - xa AS INTEGER) AS x, CAST(xb - xa AS INTEGER) AS w, CAST(yb - ya AS INTEGER) AS h, r FROM mk JOIN bq USING (image_id) WHERE x >= xa AND x < xb AND y >= ya AND y < yb""",
)
def m27(spark, sf_dir):
    return RS.mask_crop(masked(spark, sf_dir)).select(
        "image_id", *[F.col(c).cast("int").alias(c) for c in ("y", "x", "w", "h")], "r"
    )


@query(
    "m27_limit_dimension",
    f"WITH {PX} SELECT image_id, y // 3 AS y, x // 3 AS x, 3 AS w, 3 AS h, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b FROM px GROUP BY 1, 2, 3",
)
def m27l(spark, sf_dir):
    return R.limit_dimension(px(spark, sf_dir), max_dim=3).select(
        "image_id", "y", "x", "w", "h", *[r6(c, c) for c in "rgb"]
    )


@query(
    "m27_center_crop",
    f"""WITH {PX}, wide AS (SELECT image_id, (y * 8 + x) // 16 AS y, (y * 8 + x) % 16 AS x, r FROM px)
SELECT image_id, CAST(y AS INTEGER) AS y, CAST(x - 6 AS INTEGER) AS x, 4 AS w, 4 AS h, r FROM wide WHERE x BETWEEN 6 AND 9""",
)
def m27c(spark, sf_dir):
    # All 64 values of a picture, laid out as 4 rows of 16.
    place = F.col("y") * 8 + F.col("x")
    wide = px(spark, sf_dir).withColumns(
        {"y": F.floor(place / 16).cast("int"), "x": (place % 16).cast("int"), "w": F.lit(16), "h": F.lit(4)}
    )
    return R.center_crop(wide).select("image_id", "y", "x", "w", "h", "r")


@query(
    "m28_dihedral_views",
    f"""WITH {PX}, v0 AS (SELECT image_id, m, y, CASE WHEN m = 1 THEN 7 - x ELSE x END AS x, r FROM px CROSS JOIN (VALUES (0), (1)) t(m)),
v AS (SELECT image_id, m * 4 AS view, y, x, r FROM v0 UNION ALL SELECT image_id, m * 4 + 1, 7 - x, y, r FROM v0
 UNION ALL SELECT image_id, m * 4 + 2, 7 - y, 7 - x, r FROM v0 UNION ALL SELECT image_id, m * 4 + 3, x, 7 - y, r FROM v0)
SELECT image_id, CAST(view AS INTEGER) AS view, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, r FROM v""",
)
def m28(spark, sf_dir):
    return R.dihedral_views(px(spark, sf_dir)).select("image_id", "view", "y", "x", "r")


QUALITY = f"""{PX}, q1 AS (SELECT image_id, avg(gray) AS brightness, stddev_pop(gray) AS contrast, avg(CASE WHEN {SKIN} THEN 1.0 ELSE 0.0 END) AS skin,
  avg(CASE WHEN val > 245 AND sat < 30 THEN 1.0 ELSE 0.0 END) AS glare,
  sqrt(var_pop(abs(b - g)) + var_pop(abs(CAST(0.5 AS DOUBLE) * (b + g) - r))) + CAST(0.3 AS DOUBLE) * sqrt(pow(avg(abs(b - g)), 2) + pow(avg(abs(CAST(0.5 AS DOUBLE) * (b + g) - r)), 2)) AS colorfulness FROM px GROUP BY 1),
ls AS ({LOCAL}), q2 AS (SELECT image_id, stddev_pop(sqrt(greatest(0, m2 - m * m))) AS texture FROM ls GROUP BY 1)"""


@query("p20_in_domain", f"WITH {QUALITY} SELECT image_id, (skin >= 0.30 AND colorfulness >= 70 AND texture >= 14) AS in_domain FROM q1 JOIN q2 USING (image_id)")
def p20(spark, sf_dir):
    q = R.quality_measures(px(spark, sf_dir, True), 3)
    return q.select("image_id", in_domain(colour=70.0, texture=14.0).alias("in_domain"))


MSG = T.QUALITY_MESSAGES
ISSUES = f"""concat_ws(' | ', printf({lit(MSG['resolution_too_low'])}, 8, 8),
 CASE WHEN brightness < 45 THEN {lit(MSG['underexposed'])} WHEN brightness > 215 THEN {lit(MSG['overexposed'])} END,
 CASE WHEN contrast < 18 THEN {lit(MSG['low_contrast'])} END, CASE WHEN glare > 0.12 THEN printf({lit(MSG['specular_glare'])}, glare * 100) END,
 CASE WHEN texture < 0.5 THEN {lit(MSG['no_dermoscopic_structure'])} END,
 CASE WHEN colorfulness < 4 THEN {lit(MSG['not_color_image'])} WHEN skin < 0.30 THEN printf({lit(MSG['out_of_distribution'])}, skin * 100) END)"""


@query(
    "p19_rule_engine_images",
    f"""WITH {QUALITY}, z AS (SELECT image_id, {ISSUES} AS messages, CAST(greatest(0, 100 - 40 - CASE WHEN brightness < 45 OR brightness > 215 THEN 12 ELSE 0 END
  - CASE WHEN contrast < 18 THEN 10 ELSE 0 END - CASE WHEN glare > 0.12 THEN 10 ELSE 0 END - CASE WHEN texture < 0.5 THEN 35 ELSE 0 END
  - CASE WHEN colorfulness < 4 THEN 30 WHEN skin < 0.30 THEN 35 ELSE 0 END) AS DOUBLE) AS score FROM q1 JOIN q2 USING (image_id))
SELECT image_id, messages, score, CASE WHEN score >= 80 THEN 'good' WHEN score >= 55 THEN 'acceptable' ELSE 'poor' END AS verdict, TRUE AS blocking FROM z""",
)
def p19_images(spark, sf_dir):
    q = apply_rules(R.quality_measures(px(spark, sf_dir, True), 3), IMAGE_RULES)
    messages = F.concat_ws(" | ", F.transform("issues", lambda i: i["message"]))
    return q.select("image_id", messages.alias("messages"), "score", "verdict", "blocking")
