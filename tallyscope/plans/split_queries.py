"""Splits, leakage audit, class balance, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits as S
from ..sources import bindings as B
from ..sources.taxonomy import classes
from .registry import query
from .sql import CLASSES, ITEMS, ITEMS_BIG, SPLIT_VECS, split_cte

GROUPED = split_cte("items", "group_id", "cls", "gsplit")
ITEMWISE = split_cte("items", "item_id", "cls", "isplit")


def _grouped(spark, sf_dir, big=False):
    frame = B.split_items(spark, sf_dir, big)
    return S.grouped_split(frame, "group_id", "cls")


def _itemwise(spark, sf_dir, big=False):
    frame = B.split_items(spark, sf_dir, big)
    return S.itemwise_split(frame, "item_id", "cls")


@query("w1_grouped_split", f"WITH {ITEMS}, {GROUPED} SELECT item_id, group_id, cls, split FROM gsplit")
def w1(spark, sf_dir):
    return _grouped(spark, sf_dir).select("item_id", "group_id", "cls", "split")


@query(
    "w1_grouped_split_orders",
    f"WITH {ITEMS_BIG}, {GROUPED} SELECT item_id, group_id, cls, split FROM gsplit",
)
def w1_big(spark, sf_dir):
    # No closed class list given: the cut tables are size-checked before broadcasting.
    return S.grouped_split(B.split_items(spark, sf_dir, big=True), "group_id", "cls").select(
        "item_id", "group_id", "cls", "split"
    )


@query("w2_itemwise_split", f"WITH {ITEMS}, {ITEMWISE} SELECT item_id, cls, split FROM isplit")
def w2(spark, sf_dir):
    return _itemwise(spark, sf_dir).select("item_id", "cls", "split")


TWO_WAY = split_cte("items", "item_id", "cls", "isplit", val=0, test=0.2)


@query("w2_two_way_split", f"WITH {ITEMS_BIG}, {TWO_WAY} SELECT item_id, cls, split FROM isplit")
def w2_two_way(spark, sf_dir):
    frame = B.split_items(spark, sf_dir, big=True)
    return S.itemwise_split(frame, "item_id", "cls", val=0, test=0.2).select(
        "item_id", "cls", "split"
    )


@query(
    "w3_sample_per_class",
    f"""WITH {ITEMS} SELECT item_id, cls FROM (
  SELECT *, row_number() OVER (PARTITION BY cls ORDER BY md5('7:' || cls || ':' || item_id), item_id) AS rn
  FROM items) WHERE rn <= 20""",
)
def w3(spark, sf_dir):
    return S.sample_per_class(B.items(spark, sf_dir), "item_id", "cls", 20, seed=7).select(
        "item_id", "cls"
    )


def leak_sql(split: str, keys: str = "split, cls") -> str:
    return f"""SELECT {keys}, CAST(count(*) AS BIGINT) AS items,
  CAST(count(*) FILTER (WHERE leaky) AS BIGINT) AS leaked,
  round(100.0 * count(*) FILTER (WHERE leaky) / count(*), 2) AS leaked_pct
FROM (SELECT split, cls, group_id IN (SELECT group_id FROM {split} WHERE split = 'train') AS leaky
      FROM {split} WHERE split <> 'train') GROUP BY {keys}"""


@query("j1_leakage_by_class", f"WITH {ITEMS}, {ITEMWISE} {leak_sql('isplit')}")
def j1(spark, sf_dir):
    return S.leakage(_itemwise(spark, sf_dir), "group_id", "cls")


@query("j1_leakage_overall", f"WITH {ITEMS_BIG}, {ITEMWISE} {leak_sql('isplit', 'split')}")
def j1_big(spark, sf_dir):
    return S.leakage(_itemwise(spark, sf_dir, big=True), "group_id", "cls", by_class=False)


@query(
    "j1_leakage_grouped_orders", f"WITH {ITEMS_BIG}, {GROUPED} {leak_sql('gsplit', 'split')}"
)
def j1_grouped(spark, sf_dir):
    return S.leakage(_grouped(spark, sf_dir, big=True), "group_id", "cls", by_class=False)


REPORT_SQL = f"""WITH {ITEMS}, {GROUPED}, {ITEMWISE},
l AS (SELECT 'itemwise' AS method, * FROM ({leak_sql('isplit')})
      UNION ALL SELECT 'grouped' AS method, * FROM ({leak_sql('gsplit')})),
o AS (SELECT *, round(100.0 * sum(leaked) OVER (PARTITION BY method, split)
                      / sum(items) OVER (PARTITION BY method, split), 2) AS overall_pct FROM l)
SELECT method, split, cls, items, leaked, leaked_pct, overall_pct, leaked_pct >= 50 AS severe,
  printf('The image-wise split leaks %.2f%% of %s images, so any accuracy measured on it is optimistically biased. The lesion-grouped split leaks %.2f%%.',
    max(overall_pct) FILTER (WHERE method = 'itemwise') OVER (PARTITION BY split), split,
    max(overall_pct) FILTER (WHERE method = 'grouped') OVER (PARTITION BY split)) AS verdict
FROM o"""


@query("g24_leakage_report", REPORT_SQL)
def g24(spark, sf_dir):
    frame = B.split_items(spark, sf_dir)
    by_item = S.itemwise_split(frame, "item_id", "cls")
    by_group = S.grouped_split(frame, "group_id", "cls")
    return S.leakage_report(by_item, by_group, "group_id", "cls").select(
        "method", "split", "cls", "items", "leaked", "leaked_pct", "overall_pct", "severe", "verdict"
    )


@query(
    "j2_allocation",
    f"""WITH {ITEMS}, {ITEMWISE} SELECT
 (SELECT count(DISTINCT item_id) FROM isplit) AS items,
 (SELECT count(*) FROM (SELECT item_id FROM isplit GROUP BY 1 HAVING count(*) > 1)) AS items_twice,
 (SELECT count(DISTINCT group_id) FROM isplit) AS groups,
 (SELECT count(*) FROM (SELECT group_id FROM isplit GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS groups_in_two_splits""",
)
def j2(spark, sf_dir):
    return S.allocation(_itemwise(spark, sf_dir), "item_id", "group_id")


@query(
    "j2_unallocated",
    f"""WITH {ITEMS_BIG}, {GROUPED}
SELECT count(*) AS unallocated FROM items WHERE item_id NOT IN (SELECT item_id FROM gsplit)""",
)
def j2_anti(spark, sf_dir):
    frame = B.split_items(spark, sf_dir, big=True)
    split = S.grouped_split(frame, "group_id", "cls")
    return S.unallocated(frame, split, "item_id").agg(
        F.count(F.lit(1)).alias("unallocated")
    )


OVERLAP = " UNION ALL ".join(
    f"SELECT '{a}-{b}' AS pair, count(*) AS shared_groups FROM (SELECT group_id FROM {{0}} WHERE "
    f"split = '{a}' INTERSECT SELECT group_id FROM {{0}} WHERE split = '{b}')"
    for a, b in (("train", "val"), ("train", "test"), ("val", "test"))
)


@query("x2_group_overlap_itemwise", f"WITH {ITEMS}, {ITEMWISE} " + OVERLAP.format("isplit"))
def x2_item(spark, sf_dir):
    return S.split_overlap(_itemwise(spark, sf_dir), "group_id")


@query("x2_group_overlap_grouped", f"WITH {ITEMS}, {GROUPED} " + OVERLAP.format("gsplit"))
def x2(spark, sf_dir):
    return S.split_overlap(_grouped(spark, sf_dir), "group_id")


@query(
    "x4_union_of_splits",
    f"""WITH {ITEMS}, {GROUPED} SELECT (SELECT count(*) FROM items) AS input_items,
 (SELECT count(*) FROM gsplit) AS union_items,
 (SELECT count(*) FROM (SELECT item_id FROM items EXCEPT SELECT item_id FROM gsplit)) AS mismatched""",
)
def x4(spark, sf_dir):
    frame = B.split_items(spark, sf_dir)
    split = S.grouped_split(frame, "group_id", "cls")
    return S.split_union(frame, split, "item_id")


@query(
    "g5_classes_per_group",
    f"""WITH {ITEMS} SELECT count(*) AS groups, max(n) AS max_classes,
 count(*) FILTER (WHERE n > 1) AS mixed_groups
FROM (SELECT group_id, count(DISTINCT cls) AS n FROM items GROUP BY 1)""",
)
def g5(spark, sf_dir):
    return S.classes_per_group(B.items(spark, sf_dir), "group_id", "cls")


PROFILE_SQL = """SELECT CAST(sum(n) AS BIGINT) AS items, count(*) AS groups,
 count(*) FILTER (WHERE n > 1) AS groups_with_repeats, max(n) AS max_per_group,
 CAST(sum(n) - count(*) AS BIGINT) AS repeat_items,
 round(100.0 * (sum(n) - count(*)) / sum(n), 2) AS repeat_pct
FROM (SELECT group_id, count(*) AS n FROM items GROUP BY 1)"""


@query("g1_profile", f"WITH {ITEMS} {PROFILE_SQL}")
def g1(spark, sf_dir):
    return S.profile(B.items(spark, sf_dir), "group_id")


@query("g1_profile_orders", f"WITH {ITEMS_BIG} {PROFILE_SQL}")
def g1_big(spark, sf_dir):
    return S.profile(B.items_big(spark, sf_dir), "group_id")


@query(
    "g2_class_share",
    f"""WITH {ITEMS} SELECT cls, count(*) AS items,
 round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM items GROUP BY cls""",
)
def g2(spark, sf_dir):
    return S.class_share(B.items(spark, sf_dir), "cls")


SEGMENT_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE cls = '{c}') AS \"n_{c}\"" for c in B.SEGMENTS
)


@query(
    "g3_describe_splits",
    f"""WITH {ITEMS_BIG}, {GROUPED} SELECT split, count(*) AS items,
 count(DISTINCT group_id) AS groups, {SEGMENT_COUNTS},
 count(*) FILTER (WHERE cls IS NULL OR cls NOT IN ({", ".join(repr(c) for c in B.SEGMENTS)})) AS n_other FROM gsplit GROUP BY split""",
)
def g3(spark, sf_dir):
    return S.describe_splits(_grouped(spark, sf_dir, big=True), "group_id", "cls", B.SEGMENTS)


@query(
    "g4_class_balance",
    f"""WITH {ITEMS}, {GROUPED}, p AS (
 SELECT cls, 100.0 * count(*) / sum(count(*)) OVER () AS o,
  100.0 * count(*) FILTER (WHERE split = 'train') / sum(count(*) FILTER (WHERE split = 'train')) OVER () AS tr,
  100.0 * count(*) FILTER (WHERE split = 'test') / sum(count(*) FILTER (WHERE split = 'test')) OVER () AS te
 FROM gsplit GROUP BY cls)
SELECT cls, round(o, 2) AS overall_pct, round(tr, 2) AS train_pct, round(te, 2) AS test_pct,
 round(greatest(abs(tr - o), abs(te - o)), 6) AS drift,
 round(max(greatest(abs(tr - o), abs(te - o))) OVER (), 6) AS max_drift FROM p""",
)
def g4(spark, sf_dir):
    return S.class_balance(_grouped(spark, sf_dir), "cls")


WEIGHTS_SQL = """
cw AS (SELECT c.code, c.class_idx, greatest(1, coalesce(n, 0)) AS n FROM classes c
  LEFT JOIN (SELECT code, count(*) AS n FROM svecs WHERE split = 'train' GROUP BY 1) t USING (code)),
weights AS (SELECT code, class_idx, n, CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n) AS weight FROM cw)"""


@query(
    "g6_class_weights",
    f"""WITH {CLASSES}, {SPLIT_VECS}, {WEIGHTS_SQL}
SELECT code, CAST(n AS BIGINT) AS n, round(weight, 6) AS weight FROM weights""",
)
def g6(spark, sf_dir):
    train = B.split_vecs(spark, sf_dir).filter("split = 'train'")
    return S.class_weights(train, "code", classes(spark)).select(
        "code", "n", F.round("weight", 6).alias("weight")
    )


@query(
    "j7_weighted_sample",
    f"""WITH {ITEMS},
w AS (SELECT cls, n, CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n) AS weight
  FROM (SELECT cls, count(*) AS n FROM items GROUP BY cls)),
m0 AS (SELECT *, sum(n * weight) OVER (ORDER BY cls) / sum(n * weight) OVER () AS hi,
  row_number() OVER (ORDER BY cls DESC) AS back FROM w),
m AS (SELECT * REPLACE (CASE WHEN back = 1 THEN 1 ELSE hi END AS hi), coalesce(lag(hi) OVER (ORDER BY cls), 0) AS lo FROM m0),
d AS (SELECT item_id AS draw, CAST('0x' || substr(md5('42:' || item_id), 1, 13) AS BIGINT)
  / CAST(4503599627370496 AS DOUBLE) AS u FROM items),
h AS (SELECT draw, cls, least(n, CAST(floor((u - lo) / (hi - lo) * n) AS BIGINT) + 1) AS rk
  FROM d JOIN m ON u >= lo AND (u < hi OR back = 1)),
r AS (SELECT item_id, cls, row_number() OVER (PARTITION BY cls
  ORDER BY md5('42:' || cls || ':' || item_id), item_id) AS rk FROM items)
SELECT draw, item_id, cls FROM h JOIN r USING (cls, rk)""",
)
def j7(spark, sf_dir):
    frame = B.split_items(spark, sf_dir)
    dim = spark.createDataFrame([(c,) for c in B.LANGS], "cls STRING")
    weights = S.class_weights(frame, "cls", dim)
    draws = frame.select(F.col("item_id").alias("draw"))
    return S.weighted_sample(frame, "item_id", "cls", weights, draws, "draw")
