"""SQL building blocks of the twins: the same frames as in ``sources.bindings``."""

from __future__ import annotations

from ..sources.taxonomy import (
    CLASS_CODES,
    CLASS_COLORS,
    CLASS_NAMES,
    MALIGNANCY,
    MALIGNANT_FLAGS,
    RISK_WEIGHTS,
    SHORT_NAMES,
    TIERS,
)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def text_list(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def number_list(values) -> str:
    return "[" + ", ".join(f"CAST({v!r} AS DOUBLE)" for v in values) + "]"


CODES = text_list(CLASS_CODES)
CLASS_VALUES = ", ".join(
    f"({i}, {lit(c)}, {lit(CLASS_NAMES[c])}, {lit(SHORT_NAMES[c])}, {lit(MALIGNANCY[c])}, "
    f"{str(MALIGNANT_FLAGS[i]).upper()}, CAST({RISK_WEIGHTS[c]!r} AS DOUBLE), {lit(CLASS_COLORS[c])})"
    for i, c in enumerate(CLASS_CODES)
)
CLASSES = (
    f"classes(class_idx, code, name, short_name, malignancy, is_malignant, risk_weight, color) "
    f"AS (VALUES {CLASS_VALUES})"
)
TIERS_CTE = "tiers(tier, tier_rank, timeframe, action) AS (VALUES " + ", ".join(
    f"({lit(t)}, {r}, {lit(when)}, {lit(act)})" for t, (r, when, act, _c) in TIERS.items()
) + ")"

ITEMS = (
    "items AS (SELECT CAST(doc_id AS VARCHAR) AS item_id, sha256(text) AS group_id, "
    "lang AS cls FROM documents)"
)
ITEMS_BIG = (
    "items AS (SELECT CAST(o_orderkey AS VARCHAR) AS item_id, CAST(o_custkey AS VARCHAR) AS "
    "group_id, c_mktsegment AS cls FROM orders JOIN customer ON o_custkey = c_custkey)"
)


def split_cte(
    source: str, unit: str, cls: str, out: str, val: float = 0.15, test: float = 0.15, seed: int = 42
) -> str:
    """CTEs ending in ``out``: ``source`` with a ``split`` column, units shuffled per class."""
    n_val = f"greatest(1, CAST(round_even(n * CAST({val} AS DOUBLE), 0) AS BIGINT))" if val else "0"
    return f"""
{out}_u AS (SELECT DISTINCT {cls} AS c, CAST({unit} AS VARCHAR) AS u FROM {source}),
{out}_r AS (
  SELECT c, u,
    row_number() OVER (PARTITION BY c ORDER BY md5('{seed}:' || c || ':' || u), u) AS rn,
    count(*) OVER (PARTITION BY c) AS n FROM {out}_u),
{out}_q AS (
  SELECT *,
    CASE WHEN n > 2 THEN greatest(1, CAST(round_even(n * CAST({test} AS DOUBLE), 0) AS BIGINT)) ELSE 0 END AS t0,
    CASE WHEN n > 2 THEN {n_val} ELSE 0 END AS v0 FROM {out}_r),
{out}_q2 AS (
  SELECT *, CASE WHEN t0 + v0 >= n THEN least(t0, greatest(0, n - 2)) ELSE t0 END AS t1 FROM {out}_q),
{out}_q3 AS (
  SELECT *, CASE WHEN t0 + v0 >= n THEN least(v0, greatest(0, n - 1 - t1)) ELSE v0 END AS v1 FROM {out}_q2),
{out} AS (
  SELECT s.*, CASE WHEN rn <= t1 THEN 'test' WHEN rn <= t1 + v1 THEN 'val' ELSE 'train' END AS split
  FROM {source} s JOIN {out}_q3 q ON s.{cls} = q.c AND CAST(s.{unit} AS VARCHAR) = q.u)"""


VECS = (
    f"vecs AS (SELECT vec_id, label % 7 AS target, list_extract({CODES}, label % 7 + 1) AS code, "
    "CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
)
SPLIT_VECS = VECS + "," + split_cte("vecs", "vec_id", "code", "svecs")
MEANS = """
means AS (
  SELECT target, list(m ORDER BY pos) AS w FROM (
    SELECT target, pos, avg(x) AS m FROM (
      SELECT target, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM svecs WHERE split = 'train')
    GROUP BY target, pos) GROUP BY target)"""


def softmax_cte(source: str, out: str, temperature: str = "1.0", keep: str = "*") -> str:
    t = f"CAST({temperature} AS DOUBLE)"
    return f"""
{out}_z AS (SELECT {keep}, list_transform(logits, lambda x: x / {t}) AS z FROM {source}),
{out}_e AS (SELECT * EXCLUDE (z), list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM {out}_z),
{out} AS (SELECT * EXCLUDE (e), list_transform(e, lambda x: x / list_sum(e)) AS probs FROM {out}_e)"""


PROBS = (
    SPLIT_VECS
    + ","
    + MEANS
    + """,
logit_rows AS (
  SELECT s.vec_id, any_value(s.target) AS target, any_value(s.code) AS code,
    any_value(s.split) AS split, any_value(s.v) AS v,
    list(CAST(40.0 AS DOUBLE) * list_dot_product(s.v, m.w) ORDER BY m.target) AS logits
  FROM svecs s CROSS JOIN means m GROUP BY s.vec_id),"""
    + softmax_cte("logit_rows", "probs")
)
PREDS = (
    PROBS
    + """,
preds AS (SELECT *, list_max(probs) AS conf, list_position(probs, list_max(probs)) - 1 AS pred FROM probs)"""
)
ENTROPY = (
    "list_transform(probs, lambda p: least(1.0, greatest(1e-12, p)))"
)


def entropy_sql(p: str) -> str:
    clipped = f"list_transform({p}, lambda q: least(CAST(1 AS DOUBLE), greatest(CAST(1e-12 AS DOUBLE), q)))"
    return (
        f"least(1.0, greatest(0.0, -list_sum(list_transform({clipped}, lambda q: "
        f"(q / list_sum({clipped})) * ln(q / list_sum({clipped})))) / ln(len({p}))))"
    )


CASES = """
cases AS (
  SELECT CAST(event_id AS VARCHAR) AS id, event_id AS seq, ts AS created_at, event_type AS top_code,
    upper(event_type[1]) || event_type[2:] AS top_name, value / (value + 50) AS confidence,
    CASE WHEN value >= 150 THEN 'CRITICAL' WHEN value >= 75 THEN 'HIGH'
         WHEN value >= 25 THEN 'MODERATE' ELSE 'LOW' END AS tier,
    least(CAST(100 AS DOUBLE), value) AS severity_score,
    CAST(100 - event_id % 40 AS DOUBLE) AS quality_score, value >= 75 AS requires_review,
    user_id AS subject, props AS payload FROM events)"""

CAPTURES = """
captures AS (
  SELECT user_id AS subject, CAST(ts AS DATE) AS day, avg(value) AS diameter, sum(value) AS area,
    ln(1 + max(value)) AS tds,
    least(2, count(*) FILTER (WHERE event_type = 'error')) AS a, least(8, count(*)) AS b,
    count(DISTINCT event_type) AS c, coalesce(stddev_pop(value), 0) AS color_variance,
    list_sort(list(DISTINCT event_type)) AS colors
  FROM events GROUP BY 1, 2)"""
