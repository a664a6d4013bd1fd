"""Components, hulls, rectangles, outlines and structures against brute force."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscope.operators import raster as R
from tallyscope.operators import raster_components as RC
from tallyscope.operators import raster_hull as RH
from tallyscope.operators import raster_shape as RS
from tallyscope.operators import raster_structures as RT

H, WIDTH = 13, 17


def masks() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(8)
    out = {f"noise{i}": rng.random((H, WIDTH)) < p for i, p in enumerate((0.15, 0.4, 0.55, 0.7, 0.9))}
    ring = np.zeros((H, WIDTH), bool)
    ring[2:11, 3:14] = True
    ring[4:9, 5:12] = False
    ring[6, 7:9] = True  # a part in the hole
    bar = np.zeros((H, WIDTH), bool)
    bar[5, 2:15] = True
    tilted = np.zeros((H, WIDTH), bool)
    for i in range(9):
        tilted[2 + i, 2 + i : 6 + i] = True
    dot = np.zeros((H, WIDTH), bool)
    dot[3, 4] = True
    snake = np.zeros((H, WIDTH), bool)
    snake[::2] = True
    snake[1::4, -1] = True
    snake[3::4, 0] = True
    return out | {"ring": ring, "bar": bar, "tilted": tilted, "dot": dot, "snake": snake, "empty": np.zeros((H, WIDTH), bool), "full": np.ones((H, WIDTH), bool)}


@pytest.fixture(scope="module")
def shapes():
    return masks()


def frame_of(spark, pictures: dict[str, np.ndarray], gray: dict[str, np.ndarray] | None = None):
    rows = [
        (name, m.shape[1], m.shape[0], y, x, bool(m[y, x]), *[float(gray[name][y, x]) if gray else 0.0] * 3)
        for name, m in pictures.items() for y in range(m.shape[0]) for x in range(m.shape[1])
    ]
    return spark.createDataFrame(rows, "image_id string, w int, h int, y int, x int, is_mask boolean, r double, g double, b double").repartition("image_id").cache()


@pytest.fixture(scope="module")
def px(spark, shapes):
    return frame_of(spark, shapes)


def flood(mask: np.ndarray, corners: bool) -> list[list[tuple[int, int]]]:
    steps = [s for s in itertools.product((-1, 0, 1), repeat=2) if s != (0, 0) and (corners or 0 in s)]
    seen, out = np.zeros_like(mask), []
    for y, x in zip(*np.nonzero(mask)):
        if not seen[y, x]:
            todo, part = [(y, x)], []
            seen[y, x] = True
            while todo:
                a, b = todo.pop()
                part.append((int(a), int(b)))
                for dy, dx in steps:
                    p, q = a + dy, b + dx
                    if 0 <= p < mask.shape[0] and 0 <= q < mask.shape[1] and mask[p, q] and not seen[p, q]:
                        seen[p, q] = True
                        todo.append((p, q))
            out.append(part)
    return out


def filled(mask: np.ndarray) -> np.ndarray:
    out = mask.copy()
    h, w = mask.shape
    for part in flood(~mask, False):
        if not any(y in (0, h - 1) or x in (0, w - 1) for y, x in part):
            for p in part:
                out[p] = True
    return out


def picked(mask: np.ndarray) -> tuple[np.ndarray, float | None]:
    full, best, choice = filled(mask), -1.0, None
    h, w = mask.shape
    for part in flood(full, True):
        area = len(part)
        cy, cx = (sum(p[i] for p in part) / area for i in (0, 1))
        near = 1 - min(1.0, math.hypot(cx - w / 2, cy - h / 2) / math.hypot(w / 2, h / 2))
        score = area / (h * w) * (0.35 + 0.65 * near)
        if area >= 0.002 * h * w and score > best + 1e-12:
            best, choice = score, part
    if choice is None:
        return full, None
    out = np.zeros_like(mask)
    for p in choice:
        out[p] = True
    return out, best


def test_components_and_holes(px, shapes):
    rows = {r["image_id"]: r for r in RC.mask_components(px).collect()}
    for name, mask in shapes.items():
        full = filled(mask)
        out, score = picked(mask)
        r = rows[name]
        assert (r["parts"], r["filled"]) == (len(flood(full, True)), int(full.sum() - mask.sum())), name
        assert r["score"] == (None if score is None else pytest.approx(score))
        assert r["area"] == (None if score is None else int(out.sum()))


def test_picked_mask(px, shapes):
    out, _ = RC.picked_mask(px)
    got = {name: np.zeros((H, WIDTH), bool) for name in shapes}
    for r in out.filter("is_mask").collect():
        got[r["image_id"]][r["y"], r["x"]] = True
    for name, mask in shapes.items():
        assert (got[name] == picked(mask)[0]).all(), name
    assert out.count() == len(shapes) * H * WIDTH and out.columns == px.columns


def test_large_picture(spark):
    """One part that winds through 4 million pixels."""
    side = 2000
    y, x = F.floor(F.col("id") / side).cast("int"), (F.col("id") % side).cast("int")
    level = F.least("x", "y", side - 1 - F.col("x"), side - 1 - F.col("y"))
    px = spark.range(side * side).select(F.lit(1).alias("image_id"), F.lit(side).alias("w"), F.lit(side).alias("h"), y.alias("y"), x.alias("x"))
    # Rings every 8th level, joined by a bridge: one part of 125 nested rings.
    bridge = (F.col("y") == F.floor(F.lit(side / 2))) & (F.col("x") < side / 2)
    px = px.withColumn("is_mask", (level % 8 == 0) | bridge)
    row = RC.parts(px).agg(F.count(F.lit(1)).alias("n"), F.max("area").alias("most")).first()
    assert row["n"] == 1 and row["most"] == px.filter("is_mask").count()


def hull_of(points: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """Corners: points that are no convex combination of two others around them."""
    if len(points) < 3:
        return set(points)
    cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    out = set()
    for a in points:
        for b in points:
            if a != b and all(cross(a, b, c) > 0 or cross(a, b, c) == 0 and min(a, b) <= c <= max(a, b) for c in points):
                out |= {a, b}
    return out


def border_points(mask: np.ndarray) -> list[tuple[int, int]]:
    return [(int(xs[i]), int(y)) for y in range(mask.shape[0]) if (xs := np.flatnonzero(mask[y])).size for i in ((0,) if xs.size == 1 else (0, -1))]


def test_hulls(px, shapes):
    found = {r["image_id"]: r for r in RH.hulls(px).withColumn("area", RH.hull_area(F.col("hull"))).collect()}
    assert set(found) == {n for n, m in shapes.items() if m.any()}
    for name, r in found.items():
        corners = [(p["x"], p["y"]) for p in r["hull"]]
        assert set(corners) == hull_of(border_points(shapes[name])) and len(set(corners)) == len(corners), name
        area = 0.5 * abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(corners, corners[1:] + corners[:1])))
        assert r["area"] == area


def test_smallest_rectangles(px, shapes):
    found = {r["image_id"]: r for r in RH.smallest_rectangles(px).collect()}
    for name, r in found.items():
        points = np.array(border_points(shapes[name]), float)
        u = np.array([r["ux"], r["uy"]])
        v = np.array([-r["uy"], r["ux"]])
        assert np.hypot(*u) == pytest.approx(1)
        along, across = points @ u, points @ v
        assert (np.ptp(along), np.ptp(across)) == (pytest.approx(r["long_side"], abs=1e-9), pytest.approx(r["short_side"], abs=1e-9)), name
        centre = u * (along.max() + along.min()) / 2 + v * (across.max() + across.min()) / 2
        assert centre == pytest.approx([r["cx"], r["cy"]])
        turns = np.linspace(0, np.pi, 721)
        every = [np.ptp(points @ [math.cos(t), math.sin(t)]) * np.ptp(points @ [-math.sin(t), math.cos(t)]) for t in turns]
        assert r["long_side"] * r["short_side"] <= min(every) + 1e-6


def test_outline(px, shapes):
    rows = {r["image_id"]: r for r in RH.shape_descriptors(px).collect()}
    assert (rows["full"]["perimeter"], rows["full"]["outlined"]) == (2 * (H - 1 + WIDTH - 1), (H - 1) * (WIDTH - 1))
    assert rows["full"]["solidity"] == 1.0 and rows["bar"]["perimeter"] == 24.0 and rows["empty"]["perimeter"] == 0.0
    assert rows["tilted"]["perimeter"] == pytest.approx(2 * 3 + 2 * 8 * math.sqrt(2)) and rows["tilted"]["outlined"] == 8 * 3
    assert rows["dot"]["circularity"] == 0.0
    for name, mask in shapes.items():
        wide = np.pad(mask.astype(int), 1)
        straight = diagonal = area = 0
        for y, x in itertools.product(range(H + 1), range(WIDTH + 1)):
            q = wide[y : y + 2, x : x + 2]
            n = int(q.sum())
            straight += n == 2 and q[0, 0] != q[1, 1]
            diagonal += (n == 3) + 2 * (n == 2 and q[0, 0] == q[1, 1])
            area += {4: 1.0, 3: 0.5}.get(n, 0)
        assert (rows[name]["perimeter"], rows[name]["outlined"]) == (pytest.approx(straight + diagonal * math.sqrt(2)), area), name


def ellipse(size: int) -> list[tuple[int, int]]:
    r = size // 2
    return [(dy, dx) for dy in range(-r, r + 1) for k in [round(r * math.sqrt(1 - dy * dy / (r * r)))] for dx in range(-k, k + 1)]


def extreme(img: np.ndarray, size: int, fn) -> np.ndarray:
    h, w = img.shape
    return np.array([[fn([img[y + dy, x + dx] for dy, dx in ellipse(size) if 0 <= y + dy < h and 0 <= x + dx < w]) for x in range(w)] for y in range(h)])


@pytest.mark.parametrize("size", [3, 5, 9, 15])
def test_extremes(spark, size):
    rng = np.random.default_rng(size)
    pictures = {f"p{w}": rng.integers(0, 50, (7, w)).astype(float) for w in (1, 3, 8, 16, 31)}
    px = frame_of(spark, {n: p > 25 for n, p in pictures.items()}, pictures)
    for largest, fn in ((True, max), (False, min)):
        rows = RT.extremes(px, "r", size, largest, "out").collect()
        for r in rows:
            pictures.setdefault(r["image_id"], None)
        want = {n: extreme(p, size, fn) for n, p in pictures.items()}
        assert all(r["out"] == want[r["image_id"]][r["y"], r["x"]] for r in rows)


def test_stored_pixels_are_dealt_by_their_number(px, monkeypatch):
    """Merged by their bytes, far too many pixels would meet in one task."""
    n = px.count()
    monkeypatch.setattr(R, "PIXELS_A_TASK", 10)
    held = R.dealt(px)
    assert held.rdd.getNumPartitions() == max(px.sparkSession.sparkContext.defaultParallelism, -(-n // 10)) and held.count() == n
    where = held.select("image_id", F.spark_partition_id().alias("at")).distinct()
    assert where.count() == px.select("image_id").distinct().count()


@pytest.mark.parametrize("size", [1, 3, 5, 7])
def test_small_extremes_take_two_windows(px, monkeypatch, size):
    """Near neighbours are compared directly; the running extremes of blocks say the same."""
    kept = ("image_id", "y", "x", "out")
    for largest in (True, False):
        near = RT.extremes(px, "r", size, largest, "out").select(*kept)
        plan = near._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Window [") <= 2
        with monkeypatch.context() as m:
            m.setattr(RT, "NEAR", -1)
            blocks = RT.extremes(px, "r", size, largest, "out").select(*kept)
        assert near.exceptAll(blocks).isEmpty() and near.count() == blocks.count()


def test_cleaned_mask(px, shapes):
    got = {name: np.zeros((H, WIDTH), bool) for name in shapes}
    for r in RT.cleaned_mask(px, 5).filter("is_mask").collect():
        got[r["image_id"]][r["y"], r["x"]] = True
    for name, mask in shapes.items():
        want = mask.astype(int)
        for fn in (min, max, max, max, min, min):
            want = extreme(want, 5, fn)
        assert (got[name] == (want > 0)).all(), name


def correlate(img: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    ry, rx = kernel.shape[0] // 2, kernel.shape[1] // 2
    wide = np.pad(img, ((ry, ry), (rx, rx)), mode="reflect")
    return np.array([[(wide[y : y + kernel.shape[0], x : x + kernel.shape[1]] * kernel).sum() for x in range(img.shape[1])] for y in range(img.shape[0])])


def test_structures(spark):
    rng = np.random.default_rng(21)
    h, w = 40, 44
    yy, xx = np.mgrid[0:h, 0:w]
    inside = ((yy - 20) / 17) ** 2 + ((xx - 22) / 19) ** 2 < 1
    flat = np.where(inside, 90.0, 200.0)
    dotted, meshed = np.full((h, w), 90.0), flat + rng.integers(0, 3, (h, w))
    for y, x in itertools.product(range(8, 34, 8), range(8, 38, 8)):
        dotted[y : y + 4, x : x + 4] = 30
    meshed[((yy % 8 == 0) | (xx % 8 == 0)) & inside] = 40
    noisy = np.clip(rng.normal(120, 40, (h, w)), 0, 255)
    pictures = {"flat": flat, "dotted": dotted, "meshed": meshed, "noisy": noisy, "small": flat}
    marks = dict.fromkeys(pictures, inside) | {"small": (yy - 20) ** 2 + (xx - 22) ** 2 < 10}
    px = frame_of(spark, marks, pictures)
    rows = {r["image_id"]: r for r in RT.structures(px, dot_options={"rank": 0.85}).collect()}
    blur = np.array(RT.blur_weights(1.6))
    second, smoothing = np.array([1, 0, -2, 0, 1.0]), np.array([1, 4, 6, 4, 1.0])
    for name, img in pictures.items():
        mask, r = marks[name], rows[name]
        soft = correlate(img, np.outer(blur, blur))
        curve = np.round(correlate(soft, np.outer(smoothing, second)) + correlate(soft, np.outer(second, smoothing)), 6)
        blobs = (curve > np.percentile(curve[mask], 85)) & mask
        blobs = extreme(extreme(blobs.astype(int), 3, min), 3, max) > 0
        total = int(mask.sum())
        assert r["dots"] == sum(6 <= len(p) <= max(40, total * 0.01) for p in flood(blobs, True)), name
        hat = np.round(extreme(extreme(np.round(img, 6), 9, max), 9, min) - np.round(img, 6), 6)
        ridges = (hat >= max(round(np.percentile(hat[mask], 92), 6), 6)) & mask
        ridges = extreme(extreme(ridges.astype(int), 3, max), 3, min) > 0
        sizes = [len(p) for p in flood(ridges, True)]
        assert r["ridge_share"] == pytest.approx(sum(sizes) / total) and r["mesh_share"] == pytest.approx(max(sizes, default=0) / max(1, sum(sizes))), name
        core = extreme(mask.astype(int), 15, min) > 0
        slope = np.hypot(correlate(img, np.outer([1, 2, 1], [-1, 0, 1])), correlate(img, np.outer([-1, 0, 1], [1, 2, 1])))
        rim = mask & ~core
        assert r["rim"] == rim.sum() and r["rim_slope"] == pytest.approx(slope[rim].mean())
        assert r["core_slope"] == pytest.approx(slope[core].mean() if core.any() else slope[rim].mean())
        assert (r["d"] == 0) if name == "small" else True
    assert "streaks" in rows["flat"]["structures"] and "structureless_area" in rows["flat"]["structures"]
    assert "dots_globules" in rows["dotted"]["structures"] and "pigment_network" in rows["meshed"]["structures"]
    assert rows["meshed"]["d"] == len(rows["meshed"]["structures"])


def test_ranks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(k), float(v)) for i in range(4) for k, v in enumerate(rng.integers(0, 9, 3 + 40 * i))] + [(9, k, None) for k in range(3)] + [(1, 99, None)]
    frame = spark.createDataFrame(rows, "image_id int, k int, v double")
    got = {r["image_id"]: r for r in R.with_ranks(frame, "v", {"a": 0.03, "b": 0.5, "c": 1.0}).dropDuplicates(["image_id"]).collect()}
    for i in range(4):
        own = [r[2] for r in rows if r[0] == i and r[2] is not None]
        assert [got[i][c] for c in "abc"] == pytest.approx(list(np.percentile(own, [3, 50, 100])))
    assert got[9]["a"] is None


def test_asymmetry_about_the_rectangle(spark, shapes):
    names = ("tilted", "bar", "full")
    px = frame_of(spark, {n: shapes[n] for n in names}, {n: np.full((H, WIDTH), 80.0) for n in names})
    rows = {r["image_id"]: r for r in RS.asymmetry(px, RH.smallest_rectangles(px)).collect()}
    for name in ("bar", "full"):
        assert rows[name]["a"] == 0 and rows[name]["shape_index"] == 0.0
    assert {r["image_id"]: r["a"] for r in RS.asymmetry(px).collect()}["full"] == 0


# A picture of which a mirrored pixel falls between 0.4999985 and 0.499999 beyond a whole number.
NEAR_HALF = [
    193, 147, 162, 178, 133, 210, 81, 166, 142, 181, 195, 158, 224, 75, 167, 138, 106, 130, 44, 75, 0, 232, 194, 99,
    115, 145, 167, 94, 172, 145, 215, 146, 121, 255, 188, 210, 184, 170, 192, 184, 94, 245, 201, 143, 85, 136, 113, 124,
    115, 114, 159, 212, 154, 140, 233, 172, 146, 138, 219, 108, 152, 215, 68, 139,
]


def test_mirrored_pixels_near_a_half_fall_as_in_the_twin(spark, tmp_path):
    from compare import compare, connect

    from __spark_entry__ import oracle_sql, queries

    # Stretching numbers from 0 to 255 leaves them as they are.
    assert min(NEAR_HALF) == 0 and max(NEAR_HALF) == 255
    spark.createDataFrame([(528, [float(v) for v in NEAR_HALF], 0)], "vec_id LONG, embedding ARRAY<FLOAT>, label INT").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    part = next((tmp_path / "embeddings.parquet").glob("*.parquet"))
    (tmp_path / "tables").mkdir()
    part.rename(tmp_path / "tables" / "embeddings.parquet")
    for name in ("m14_asymmetry", "j10_mirror_join"):
        rows, problems = compare(queries()[name](spark, str(tmp_path / "tables")), connect(str(tmp_path / "tables")), oracle_sql()[name])
        assert rows == 1 and not problems, problems


def test_tables_of_a_row_per_picture_are_not_broadcast(spark):
    """Small here, they pass for broadcasting; a job of many joins would send all of them through the driver."""
    arrays = spark.range(6).selectExpr("CAST(id AS STRING) AS image_id", "8 AS w", "8 AS h", "transform(sequence(0, 63), i -> struct(pmod(i * 7 + id * 31, 256) AS r, pmod(i * 13, 256) AS g, pmod(i * 5, 256) AS b)) AS px")
    mask = RS.with_mask(R.pixels(arrays, colocate=True), blur=0)
    picked, _ = RC.picked_mask(mask)
    for frame in (RC.mask_components(mask), picked, RH.shape_descriptors(picked), RS.asymmetry(picked, RH.smallest_rectangles(picked))):
        assert frame.count() > 0
        frame.collect()
        assert "BroadcastExchange" not in frame._jdf.queryExecution().executedPlan().toString()


def test_measures_read_the_picked_mask_from_storage(spark, sf_dir):
    from tallyscope.plans.shape_queries import picked

    # Every measure would else find the mask and its parts' join anew.
    plan = picked(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
