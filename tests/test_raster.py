"""Raster measures against straightforward numpy on uneven picture sizes."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscope.operators import raster as R
from tallyscope.operators import raster_pairs as RP
from tallyscope.operators import raster_shape as RS

H, WIDTH = 12, 15


@pytest.fixture(scope="module")
def pictures():
    rng = np.random.default_rng(4)
    noise = rng.integers(0, 256, (H, WIDTH, 3)).astype(float)
    blob = np.full((H, WIDTH, 3), (214.0, 168.0, 142.0))
    yy, xx = np.mgrid[0:H, 0:WIDTH]
    blob[((yy - 6) / 3.2) ** 2 + ((xx - 7) / 4.7) ** 2 < 1] = (92.0, 64.0, 52.0)
    return {"noise": noise, "blob": blob + rng.integers(0, 3, blob.shape)}


@pytest.fixture(scope="module")
def px(spark, pictures):
    rows = [
        (name, WIDTH, H, [tuple(float(v) for v in p) for p in img.reshape(-1, 3)])
        for name, img in pictures.items()
    ]
    arrays = spark.createDataFrame(
        rows, "image_id STRING, w INT, h INT, px ARRAY<STRUCT<r: DOUBLE, g: DOUBLE, b: DOUBLE>>"
    )
    return R.pixels(arrays, colocate=True)


def gray(img):
    return img @ np.array([0.299, 0.587, 0.114])


def by_image(frame, column):
    return {r["image_id"]: r[column] for r in frame.collect()}


def box(img, size):
    pad = np.pad(img, size // 2, mode="reflect")
    return np.array([[pad[y:y + size, x:x + size].mean() for x in range(img.shape[1])] for y in range(img.shape[0])])


def test_sharpness(px, pictures):
    got = by_image(R.sharpness(px), "sharpness")
    for name, img in pictures.items():
        g = np.pad(gray(img), 1, mode="reflect")
        lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
        assert got[name] == pytest.approx(lap.var())


@pytest.mark.parametrize("size", [3, 9])
def test_texture_and_one_pass_measures(px, pictures, size):
    got = by_image(R.texture(px, size), "texture")
    once = by_image(R.quality_measures(px, size), "texture")
    for name, img in pictures.items():
        g = gray(img)
        local = np.sqrt(np.maximum(0, box(g * g, size) - box(g, size) ** 2))
        assert got[name] == pytest.approx(local.std(), rel=1e-6)
        assert once[name] == pytest.approx(local.std(), rel=1e-6)


def test_gaussian_filter(px, pictures):
    w = np.array(R.gaussian_weights(7))
    out = {(r["image_id"], r["y"], r["x"]): r["s"] for r in R.smooth(px, {"s": F.col("r")}, list(w)).collect()}
    for name, img in pictures.items():
        pad = np.pad(img[..., 0], 3, mode="reflect")
        for y, x in ((0, 0), (5, 7), (H - 1, WIDTH - 1)):
            assert out[name, y, x] == pytest.approx(w @ pad[y:y + 7, x:x + 7] @ w)


def test_dilation_is_an_ellipse(px):
    dot = px.filter("image_id = 'blob'").withColumn("m", (F.col("y") == 6) & (F.col("x") == 7))
    hit = {(r["y"] - 6, r["x"] - 7) for r in R.dilate(dot, "m", 7).filter("dilated").collect()}
    half = {dy: round(3 * math.sqrt(1 - dy * dy / 9)) for dy in range(-3, 4)}
    assert hit == {(dy, dx) for dy, k in half.items() for dx in range(-k, k + 1)}


def test_otsu_window_and_grouped_forms_agree(px):
    masked = RS.with_mask(px)
    cut = by_image(RS.otsu(RS.lesion_channel(px), "image_id", "channel"), "threshold")
    for r in masked.select("image_id", "channel", "is_mask").collect():
        assert r["is_mask"] == (math.floor(r["channel"]) > cut[r["image_id"]])


def test_blob_is_found_and_measured(px, pictures):
    masked = RS.with_mask(px, blur=0).filter("image_id = 'blob'")
    truth = gray(pictures["blob"]) < 110
    g = RS.mask_geometry(masked).first()
    ys, xs = np.nonzero(truth)
    assert g["area"] == truth.sum() and g["reliable"]
    assert (g["cx"], g["cy"]) == (pytest.approx(xs.mean()), pytest.approx(ys.mean()))
    assert (g["bbox_x"], g["bbox_y"], g["bbox_w"], g["bbox_h"]) == (
        xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1,
    )
    assert RS.asymmetry(masked).first()["a"] == 0  # a plain ellipse is symmetric
    assert RS.border(masked).first()["b"] <= 2
    cov = np.cov(np.stack([xs, ys]), bias=True)
    low, high = np.linalg.eigvalsh(cov)
    assert RS.eccentricity(masked).first()["eccentricity"] == pytest.approx(math.sqrt(1 - low / high))
    crop = RS.mask_crop(masked).agg(F.max("w"), F.max("h"), F.count("*")).first()
    assert crop[2] == crop[0] * crop[1]


def test_corner_pixels_count_twice(px, pictures):
    got = by_image(R.dark_border(px, dark=100, band=2), "dark_border")
    g = gray(pictures["noise"])
    bands = np.concatenate([g[:2].ravel(), g[-2:].ravel(), g[:, :2].ravel(), g[:, -2:].ravel()])
    assert got["noise"] == pytest.approx((bands < 100).mean())


def test_colorfulness_orders_differ(px, pictures):
    swapped, plain = by_image(R.colorfulness(px), "colorfulness"), by_image(R.colorfulness(px, "rgb"), "colorfulness")
    img = pictures["noise"]
    for got, (r, g, b) in ((plain, (0, 1, 2)), (swapped, (2, 1, 0))):
        rg, yb = abs(img[..., r] - img[..., g]), abs(0.5 * (img[..., r] + img[..., g]) - img[..., b])
        want = math.hypot(rg.std(), yb.std()) + 0.3 * math.hypot(rg.mean(), yb.mean())
        assert got["noise"] == pytest.approx(want)


def test_views_are_rotations(px, pictures):
    views = R.dihedral_views(px.filter("image_id = 'noise'")).collect()
    img = pictures["noise"][..., 0]
    for view in range(8):
        base = np.fliplr(img) if view >= 4 else img
        want = np.rot90(base, view % 4)
        got = np.zeros(want.shape)
        for r in (v for v in views if v["view"] == view):
            got[r["y"], r["x"]] = r["r"]
        assert (got == want).all()


def test_identical_pictures_match(px):
    twin = px.filter("image_id = 'noise'").withColumn("pair_id", F.lit(1)).withColumn(
        "side", F.explode(F.array(F.lit(0), F.lit(1)))
    )
    assert RP.structural_similarity(twin).first()["similarity"] == pytest.approx(1.0)
    assert RP.histogram_distance(twin).first()["color_distance"] == pytest.approx(0.0, abs=1e-7)
    assert RP.difference_map(twin).agg(F.max("difference")).first()[0] == 0.0


def test_gradient_blocks_have_unit_length(px):
    rows = R.oriented_gradients(px, cell=4).collect()
    assert len(rows) == 2 * 2 * 2 and all(len(r["features"]) == 32 for r in rows)
    for r in rows:
        assert math.sqrt(sum(v * v for v in r["features"])) == pytest.approx(1.0, abs=1e-3)


def test_empty_masks_keep_their_image(px):
    masked = px.withColumn("is_mask", (F.col("image_id") == "blob") & (F.col("x") > 3))
    both = {"noise", "blob"}
    none = {
        RS.asymmetry: {"a": 0, "shape_index": 0.0, "color_index": 0.0}, RS.border: {"b": 0, "irregularity": 0.0},
        RS.colors_present: {"colors": [], "c": 0}, RS.veil_fraction: {"veil": 0.0}, RS.color_variance: {"color_variance": 0.0},
        RS.structureless: {"flat_share": 0.0, "structureless": False}, RS.eccentricity: {"eccentricity": 0.0},
    }
    for measure, want in none.items():
        got = {r["image_id"]: r.asDict() for r in measure(masked).collect()}
        assert set(got) == both and got["noise"] == {"image_id": "noise", **want}


def test_large_full_mask_and_wide_sums(spark):
    side = 2000
    full = spark.range(side * side).select(
        F.lit("all").alias("image_id"), (F.col("id") / side).cast("int").alias("y"), (F.col("id") % side).cast("int").alias("x"),
        F.lit(True).alias("is_mask"),
    )
    assert RS.eccentricity(full).first()["eccentricity"] == pytest.approx(0.0, abs=1e-6)
    sums = spark.createDataFrame([(5 * 10**8, 10**10, 10**9, 2 * 10**11)], "_n1 LONG, _s1 LONG, _n LONG, _s LONG")
    apart = 10**9 * 10**10 - 5 * 10**8 * 2 * 10**11
    assert sums.select(RS._between()).first()[0] == pytest.approx(apart**2 / (5 * 10**8) ** 2)


def test_pixels_of_a_task_are_bounded(spark, monkeypatch):
    from tallyscope.operators import raster as R

    # At least a task a core: the bound is set low enough to ask for more.
    monkeypatch.setattr(R, "PIXELS_A_TASK", 16)
    arrays = spark.range(40).selectExpr("id AS image_id", "4 AS w", "4 AS h", "transform(sequence(1, 16), i -> struct(i AS r, i AS g, i AS b)) AS px")
    px = R.pixels(arrays, colocate=True)
    assert px.count() == 40 * 16
    assert px.rdd.getNumPartitions() == 40
    assert R.pixels(arrays.limit(0), colocate=True).count() == 0
