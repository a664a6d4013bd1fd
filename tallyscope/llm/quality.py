"""Quality classifier: document evidence combined with site posteriors by empirical Bayes.

A logistic model over binned text statistics, fitted on labelled documents, gives each
document its own probability. Sites form a hierarchy (host, then path): a site's evidence
is the sum of its documents' probabilities, and its posterior mean shrinks towards its
parent's, the more the fewer documents it has. How strongly is read from the data: the
variance between sites beyond what their sizes explain gives a prior's weight (method of
moments). A document's score is its own log odds plus what its site's posterior, formed
without the document itself, adds to the global log odds.

Sites are grouped sums, merged map-side, so a site with a third of all rows is one row a
task; documents meet their site's row in a join whose large side AQE can split.

Results by case: null and empty texts have no words and are scored on that; a null host or
path is a site of its own; null labels, and labels of no document, are not used; without
labels of both kinds all documents get the same evidence and are kept; repeated rows are
scored each; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.session import stored

from .common import documents, query, row_key, without
from .features import counted, shares

STEPS = (0.01, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.99)
# Probabilities stay this far from 0 and 1, so that no single document decides for a site.
EDGE = 0.01


def measured(docs: DataFrame, id_col: str, text_col: str, sites: list[str]) -> DataFrame:
    """doc_id, row_key, one column per site level (_site0 ...), and the shares."""
    passed = [F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row_key")]
    passed += [F.coalesce(F.col(s).cast("string"), F.lit("\0")).alias(f"_site{i}") for i, s in enumerate(sites)]
    counts = counted(docs, text_col, *passed)
    return counts.select("doc_id", "row_key", *[f"_site{i}" for i in range(len(sites))], *[c.alias(n) for n, c in shares().items()])


def _indicators(cuts: dict[str, list[float]]) -> list[Column]:
    """1.0 for each threshold that a share exceeds: a step function per share after the fit."""
    return [F.when(F.col(name) > cut, 1.0).otherwise(0.0) for name, levels in cuts.items() for cut in levels]


def document_model(labelled: DataFrame, good: str, most_rows: int = 20_000) -> Column:
    """Probability of a good document as an expression over the shares.

    Fitted on a sample of about `most_rows` labelled rows at most (those of least hash).
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    tally = {r[good]: r["count"] for r in labelled.groupBy(good).count().collect()}
    if len(tally) < 2:
        return F.lit(0.5)
    portion = min(1.0, most_rows / sum(tally.values()))
    draw = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 20))
    rows = stored(labelled.filter(draw < int((1 << 20) * portion)), "fit")
    names = list(shares())
    found = rows.agg(*[F.percentile_approx(n, list(STEPS), 10_000).alias(n) for n in names]).first()
    cuts = {n: [(a + b) / 2 for a, b in pairwise(sorted(set(found[n] or [])))] for n in names}
    marks = _indicators(cuts)
    if not marks:
        return F.lit(0.5)
    points = rows.select(F.col(good).cast("double").alias("label"), array_to_vector(F.array(*marks)).alias("features"))
    fitted = LogisticRegression(regParam=0.002, standardization=False, maxIter=40).fit(points)
    score = F.lit(float(fitted.intercept))
    for mark, weight in zip(marks, fitted.coefficients.toArray().tolist(), strict=True):
        score = score + mark * weight
    return 1.0 / (1.0 + F.exp(-score))


def _clipped(p: Column) -> Column:
    return F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), p))


def _log_odds(p: Column) -> Column:
    return F.ln(p / (1 - p))


def prior_weight(groups: DataFrame, mean: Column) -> float:
    """Weight of the parent's rate, in documents, for groups (n, good) with parent rate `mean`.

    Rates of groups scatter by chance with mean (1 - mean) / n; what is left is variance
    between groups, and a beta prior of that variance has weight mean (1 - mean) / variance - 1.
    """
    rate = F.col("good") / F.col("n")
    row = groups.agg(
        F.sum(F.col("n") * (rate - mean) * (rate - mean)).alias("spread"),
        F.sum(mean * (1 - mean)).alias("chance"),
        F.sum(F.col("n") * mean * (1 - mean)).alias("total"),
        F.sum("n").alias("n"),
    ).first()
    if not row["n"] or not row["total"]:
        return 1.0
    between = max(row["spread"] - row["chance"], 0.0) / row["n"]
    return max(1.0, min(1e6, row["total"] / row["n"] / between - 1 if between > 0 else 1e6))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    sites: tuple[str, ...] = ("source", "lang"),
    label_col: str = "quality",
    most_rows: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, row_key, p_document, p_host, p_path (posterior means of
    the document's sites, without it), score (probability of good quality), kept.

    labels: id_col and label_col (0 or 1). sites: the columns that make up host and path;
    level i of the hierarchy is the first i + 1 of them.
    """
    keys = [f"_site{i}" for i in range(len(sites))]
    shared = stored(measured(docs, id_col, text_col, list(sites)), "shares")
    known = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_doc"), (F.col(label_col) == 1).alias("_good"))
    labelled = shared.join(known, F.col("doc_id") == F.col("_doc")).select("doc_id", "_good", *shares())
    model = document_model(labelled, "_good", most_rows)
    scored = stored(shared.select("doc_id", "row_key", *keys, _clipped(model).alias("p")), "evidence")

    # Sums per path; coarser levels are sums of these few rows.
    levels = [stored(scored.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("p").alias("good")), "sites")]
    for depth in range(len(keys) - 1, 0, -1):
        levels.insert(0, levels[0].groupBy(*keys[:depth]).agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    whole = levels[0].agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = min(1 - EDGE, max(EDGE, whole["good"] / whole["n"])) if whole["n"] else 0.5

    # From coarse to fine: each site carries its ancestors' counts, for leaving documents out.
    table = levels[-1].select(*keys)
    weights: list[float] = []
    mean: Column = F.lit(overall)
    parents: DataFrame | None = None
    for depth, level in enumerate(levels):
        own = keys[: depth + 1]
        groups = level if parents is None else level.join(parents, own[:-1])
        weight = prior_weight(groups, mean)
        weights.append(weight)
        shrunk = (F.col("good") + weight * mean) / (F.col("n") + weight)
        parents = groups.select(*own, shrunk.alias(f"_rate{depth}"))
        mean = F.col(f"_rate{depth}")
        table = table.join(level.select(*own, F.col("n").alias(f"_n{depth}"), F.col("good").alias(f"_good{depth}")), own)

    placed = scored.join(table, keys)
    rate: Column = F.lit(overall)
    rates = []
    for depth, weight in enumerate(weights):
        rate = (F.col(f"_good{depth}") - F.col("p") + weight * rate) / (F.col(f"_n{depth}") - 1 + weight)
        rates.append(rate)
    odds = _log_odds(F.col("p")) + _log_odds(_clipped(rates[-1])) - _log_odds(F.lit(overall))
    score = 1.0 / (1.0 + F.exp(-odds))
    return placed.select(
        "doc_id",
        "row_key",
        F.col("p").alias("p_document"),
        rates[0].alias("p_host"),
        rates[-1].alias("p_path"),
        score.alias("score"),
        (score >= 0.5).alias("kept"),
    )


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that the classifier keeps."""
    found = classify(docs, labels, id_col=id_col, text_col=text_col, **options)
    return without(docs, found.filter("NOT kept"), id_col, text_col)


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(documents(spark, sf_dir), labels).drop("row_key")
