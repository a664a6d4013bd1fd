"""Repeated passes, head fitting, folding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import top_index
from ..operators import heads as H
from ..operators import metrics as M
from ..operators import passes as P
from ..session import stored
from ..sources import bindings as B
from ..sources.taxonomy import CLASS_CODES
from .registry import query
from .score_queries import r6, spread, train_weights
from .sql import MEANS, SPLIT_VECS, entropy_sql, softmax_cte

K = len(CLASS_CODES)


def head(spark, sf_dir):
    return B.class_means(B.split_vecs(spark, sf_dir).filter("split = 'train'"))


def view_passes(spark, sf_dir, n=8):
    vectors = B.vecs(spark, sf_dir).select("vec_id", "v")
    return P.dihedral_passes(vectors, "vec_id", "v", head(spark, sf_dir), side=8, n=n, scale=40.0)


def drop_passes(spark, sf_dir, n=10):
    vectors = B.vecs(spark, sf_dir).select("vec_id", "v")
    return P.masked_passes(vectors, "vec_id", "v", head(spark, sf_dir), passes=n, scale=40.0)


LOGITS = """
pl AS (SELECT s.vec_id, s.pass, list(CAST(40.0 AS DOUBLE) * list_dot_product(s.v, m.w) ORDER BY m.target) AS logits
  FROM pv s CROSS JOIN means m GROUP BY s.vec_id, s.pass),""" + softmax_cte("pl", "ps", "1.0", "vec_id, pass, logits")
VIEW_PASSES = f"""WITH {SPLIT_VECS}, {MEANS},
c0 AS (SELECT vec_id, m, (pos - 1) // 8 AS y, CASE WHEN m = 1 THEN 7 - (pos - 1) % 8 ELSE (pos - 1) % 8 END AS x, val
  FROM (SELECT vec_id, unnest(v) AS val, generate_subscripts(v, 1) AS pos FROM vecs) CROSS JOIN (VALUES (0), (1)) t(m)),
c1 AS (SELECT vec_id, m * 4 AS pass, y, x, val FROM c0 UNION ALL SELECT vec_id, m * 4 + 1, 7 - x, y, val FROM c0
  UNION ALL SELECT vec_id, m * 4 + 2, 7 - y, 7 - x, val FROM c0 UNION ALL SELECT vec_id, m * 4 + 3, x, 7 - y, val FROM c0),
pv AS (SELECT vec_id, pass, list(val ORDER BY y, x) AS v FROM c1 GROUP BY 1, 2), {LOGITS}"""
DROP_PASSES = f"""WITH {SPLIT_VECS}, {MEANS},
d0 AS (SELECT vec_id, pass, val, pos - 1 AS i FROM (SELECT vec_id, unnest(v) AS val, generate_subscripts(v, 1) AS pos FROM vecs) CROSS JOIN range(10) p(pass)),
pv AS (SELECT vec_id, pass, list(CASE WHEN CAST('0x' || substr(md5('42:' || vec_id || ':' || pass || ':' || (i // 8)), CAST(1 + 4 * (i % 8) AS BIGINT), 4) AS BIGINT) / CAST(65536 AS DOUBLE) >= 0.3
  THEN val / CAST(0.7 AS DOUBLE) ELSE 0 END ORDER BY i) AS v FROM d0 GROUP BY 1, 2), {LOGITS}"""
PASS_COLS = ", ".join(f"round(probs[{i + 1}], 6) AS p{i}" for i in range(K))
MEAN_COLS = ", ".join(f"avg(probs[{i + 1}]) AS m{i}" for i in range(K))
STD_COLS = ", ".join(f"stddev_pop(probs[{i + 1}]) AS s{i}" for i in range(K))
SUM_M = " + ".join(f"m{i}" for i in range(K))
MEAN_LIST = "[" + ", ".join(f"m{i} / greatest({SUM_M}, 1e-12)" for i in range(K)) + "]"
STD_LIST = "[" + ", ".join(f"s{i}" for i in range(K)) + "]"


@query("s4_view_passes", VIEW_PASSES + f" SELECT vec_id, CAST(pass AS INTEGER) AS pass, {PASS_COLS} FROM ps")
def s4_views(spark, sf_dir):
    df = view_passes(spark, sf_dir)
    return df.select("vec_id", "pass", *spread(df))


@query("s5_masked_passes", DROP_PASSES + f" SELECT vec_id, CAST(pass AS INTEGER) AS pass, {PASS_COLS} FROM ps")
def s5(spark, sf_dir):
    df = drop_passes(spark, sf_dir)
    return df.select("vec_id", "pass", *spread(df))


VIEW_SUMMARY = VIEW_PASSES + f""", pt AS (SELECT *, list_position(probs, list_max(probs)) - 1 AS top FROM ps WHERE pass < 5),
a AS (SELECT vec_id, {MEAN_COLS}, {STD_COLS}, list(top ORDER BY pass) AS picks FROM pt GROUP BY 1),
b AS (SELECT *, {MEAN_LIST} AS probs, {STD_LIST} AS stds FROM a),
c AS (SELECT *, list_position(probs, list_max(probs)) - 1 AS consensus FROM b)
SELECT vec_id, {PASS_COLS}, CAST(consensus AS INTEGER) AS consensus, round(len(list_filter(picks, lambda t: t = consensus)) / CAST(5 AS DOUBLE), 6) AS agreement,
 round(stds[consensus + 1], 6) AS top_std, array_to_string(picks, ',') AS per_pass FROM c"""
DROP_SUMMARY = DROP_PASSES + f""", pt AS (SELECT *, {entropy_sql('probs')} AS ent FROM ps),
a AS (SELECT vec_id, {MEAN_COLS}, {STD_COLS}, avg(ent) AS eh, count(*) AS n FROM pt GROUP BY 1),
b AS (SELECT *, {MEAN_LIST} AS probs, {STD_LIST} AS stds FROM a)
SELECT vec_id, {PASS_COLS}, round(list_sum(stds) / 7, 6) AS mean_std, round(least(1, greatest(0, {entropy_sql('probs')} - eh)), 6) AS mutual_information, n AS passes FROM b"""


def view_columns(s):
    return s.select(
        "vec_id", *spread(s), "consensus", r6("agreement", "agreement"), r6("top_std", "top_std"),
        F.concat_ws(",", F.col("per_pass").cast("array<string>")).alias("per_pass"),
    )


def drop_columns(s):
    return s.select(
        "vec_id", *spread(s), r6("mean_std", "mean_std"), r6("mutual_information", "mutual_information"),
        "passes",
    )


@query("g18_view_summary", VIEW_SUMMARY)
def g18(spark, sf_dir):
    vectors = B.vecs(spark, sf_dir).select("vec_id", "v")
    passes = P.dihedral_in_row(vectors, "vec_id", "v", head(spark, sf_dir), side=8, n=5, scale=40.0)
    return view_columns(P.summarise_views_in_row(passes, "vec_id"))


@query("g19_stochastic_summary", DROP_SUMMARY)
def g19(spark, sf_dir):
    vectors = B.vecs(spark, sf_dir).select("vec_id", "v")
    passes = P.masked_in_row(vectors, "vec_id", "v", head(spark, sf_dir), passes=10, scale=40.0)
    return drop_columns(P.summarise_stochastic_in_row(passes, "vec_id"))


@query(
    "s6_fold_scaler",
    f"""WITH {SPLIT_VECS}, {MEANS}, st AS (SELECT list(mu ORDER BY pos) AS mu, list(sd ORDER BY pos) AS sd FROM (
  SELECT pos, avg(x) AS mu, greatest(stddev_samp(x), 1e-6) AS sd FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM svecs WHERE split = 'train') GROUP BY pos)),
z AS (SELECT vec_id, list_transform(list_zip(v, mu, sd), lambda t: (t[1] - t[2]) / t[3]) AS z FROM vecs CROSS JOIN st),
lg AS (SELECT vec_id, list(list_dot_product(z, w) + target ORDER BY target) AS probs FROM z CROSS JOIN means GROUP BY vec_id)
SELECT vec_id, {PASS_COLS.replace(' AS p', ' AS z')} FROM lg""",
)
def s6(spark, sf_dir):
    split = B.split_vecs(spark, sf_dir)
    train = split.filter("split = 'train'")
    moments = H.feature_moments(train, "v")
    rows = head(spark, sf_dir).select(F.posexplode("w").alias("class_idx", "w"))
    standard = rows.withColumn("b", F.col("class_idx").cast("double"))
    folded = H.fold_scaler(standard, moments)
    scored = H.score_linear(split.select("vec_id", "v"), folded, "v")
    return scored.select("vec_id", *spread(scored, "logits", "z"))


def standardised(spark, sf_dir):
    split = B.split_vecs(spark, sf_dir)
    moments = H.feature_moments(split.filter("split = 'train'"), "v")
    scaled = H.standardise(split.select("vec_id", "target", "split", "v"), moments, "v", "v")
    # An optimiser reads its input once per step: fit on stored features.
    return stored(scaled, "features")


@query("g18_long_passes", VIEW_SUMMARY)
def g18_long(spark, sf_dir):
    """The same from passes that arrive as rows."""
    return view_columns(P.summarise_views(view_passes(spark, sf_dir, 5), "vec_id"))


@query("g19_long_passes", DROP_SUMMARY)
def g19_long(spark, sf_dir):
    return drop_columns(P.summarise_stochastic(drop_passes(spark, sf_dir), "vec_id"))


@query("s1_fitted_head")
def s1(spark, sf_dir):
    """Summary per split of a head fitted on train and selected on val."""
    data = standardised(spark, sf_dir)
    train, val = (data.filter(F.col("split") == s) for s in ("train", "val"))
    _table, fitted = H.fit_head(train, val, train_weights(spark, sf_dir))
    scored = H.score_linear(data, fitted, "v").withColumn("probs", F.col("logits"))
    parts = [
        M.summary(scored.filter(F.col("split") == s)).withColumn("split", F.lit(s))
        for s in ("train", "val", "test")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s2_head_selection")
def s2(spark, sf_dir):
    data = standardised(spark, sf_dir)
    train, val = (data.filter(F.col("split") == s) for s in ("train", "val"))
    return H.fit_head(train, val, train_weights(spark, sf_dir))[0]


@query("s7_margin_baseline")
def s7(spark, sf_dir):
    """Summary per split of the one-vs-rest linear margin classifier."""
    data = standardised(spark, sf_dir)
    fitted = H.fit_margin_baseline(data.filter("split = 'train'"), train_weights(spark, sf_dir))
    labelled = H.score_linear(data, fitted, "v").withColumn("pred", top_index("logits"))
    counts = labelled.groupBy("split", "target", "pred").agg(
        F.count(F.lit(1)).alias("n")
    )
    parts = [
        M.summary_from_counts(counts.filter(F.col("split") == s).drop("split")).withColumn("split", F.lit(s))
        for s in ("train", "val", "test")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
