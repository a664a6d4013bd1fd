"""Frames the registered queries run on, derived from the driver's tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.basic import literal_array, moments, pin
from ..functions.scores import linear_logits, softmax
from ..operators.splits import itemwise_split
from .taxonomy import CLASS_CODES

LANGS = ("de", "en", "es", "fr")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items, exact copies of one text as a group, language as class."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("item_id"),
        F.sha2("text", 256).alias("group_id"),
        F.col("lang").alias("cls"),
    )


def items_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items, customers as groups, market segment as class."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("item_id"),
        F.col("o_custkey").cast("string").alias("group_id"),
        F.col("c_mktsegment").alias("cls"),
    )


def split_items(spark: SparkSession, sf_dir: str, big: bool = False) -> DataFrame:
    """Items for splitting and auditing: three narrow columns of one scan (and one join)."""
    return items_big(spark, sf_dir) if big else items(spark, sf_dir)


def vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labelled vectors; the tables' labels are folded onto the seven classes."""
    target = F.pmod(F.col("label"), F.lit(len(CLASS_CODES)))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        target.alias("target"),
        F.element_at(literal_array(CLASS_CODES), target + 1).alias("code"),
        F.col("embedding").cast("array<double>").alias("v"),
    )


def split_vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every vector is its own group.
    return itemwise_split(vecs(spark, sf_dir), "vec_id", "code")


def class_means(train: DataFrame) -> DataFrame:
    """One row: the class mean vectors, ordered by class (K x D numbers)."""
    means = train.groupBy("target").agg(
        vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("m")
    )
    ordered = F.array_sort(F.collect_list(F.struct("target", "m")))
    return means.agg(F.transform(ordered, lambda s: s["m"]).alias("w"))


def probs(spark: SparkSession, sf_dir: str, scale: float = 40.0) -> DataFrame:
    """Vectors scored against the class means of the train split."""
    split = split_vecs(spark, sf_dir)
    weights = class_means(split.filter("split = 'train'"))
    logits = linear_logits(F.col("v"), F.col("_w"), scale=scale)
    scored = pin(split.withColumn("_w", weights.scalar()), {"logits": logits}).drop("_w")
    return pin(scored, {"probs": softmax(F.col("logits"))})


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores plus the other evidence streams a grading can use.

    The streams are cheap functions of the record's id, chosen so that every rule
    fires for some record: geometry, view agreement, input quality, attention.
    """
    from ..functions.scores import entropy, margin, verdict

    i = F.col("vec_id")
    df = probs(spark, sf_dir).select("vec_id", "target", "code", "probs").withColumns(
        {
            "a": (i % 3).cast("int"),
            "b": (i % 9).cast("int"),
            "c": (i % 7).cast("int"),
            "d": (i % 6).cast("int"),
            "reliable": i % 13 != 0,
            "agreement": 1.0 - (i % 5) * 0.125,
            "entropy": entropy("probs"),
            "margin": margin("probs"),
            "quality_score": (100 - i % 60).cast("double"),
            "in_domain": i % 11 != 0,
            "blocking": (i % 11 == 0) | (i % 17 == 0),
            "attention": (i % 10) / 10.0,
        }
    )
    return df.withColumns(
        {
            "tds": 1.3 * F.col("a") + 0.1 * F.col("b") + 0.5 * F.col("c") + 0.5 * F.col("d"),
            "stability": verdict(
                F.array_max("probs"), F.col("entropy"), F.col("agreement")
            ),
            "quality_verdict": F.when(F.col("quality_score") >= 80, "good")
            .when(F.col("quality_score") >= 55, "acceptable")
            .otherwise("poor"),
            "critical_messages": F.array(F.lit("Input failed a critical quality check.")),
        }
    )


def raster_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per image: three 8x8 channels of whole numbers 0..255.

    The vector is stretched to 0..255 by its own minimum and maximum; green and
    blue are the same values shifted by 21 and 42 places.
    """
    raw = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.col("embedding").cast("array<double>").alias("e")
    )
    spread = raw.withColumn("lo", F.array_min("e")).withColumn("hi", F.array_max("e"))
    scaled = spread.withColumn(
        "s",
        F.transform(
            # A vector of one value has no spread; its picture is black.
            "e", lambda x: F.floor(F.coalesce(F.try_divide(x - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * 255.0).cast("double")
        ),
    )

    def shifted(by: int):
        return F.concat(F.slice("s", by + 1, 64 - by), F.slice("s", 1, by))

    return scaled.select(
        "image_id", F.lit(8).alias("w"), F.lit(8).alias("h"),
        F.arrays_zip(
            F.col("s").alias("r"), shifted(21).alias("g"), shifted(42).alias("b")
        ).alias("px"),
    )


def case_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stored cases."""
    v = F.col("value")
    tier = (
        F.when(v >= 150, "CRITICAL").when(v >= 75, "HIGH").when(v >= 25, "MODERATE").otherwise("LOW")
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("created_at"),
        F.col("event_type").alias("top_code"),
        F.initcap("event_type").alias("top_name"),
        (v / (v + 50)).alias("confidence"),
        tier.alias("tier"),
        F.least(F.lit(100.0), v).alias("severity_score"),
        (100 - F.col("event_id") % 40).cast("double").alias("quality_score"),
        tier.isin("HIGH", "CRITICAL").alias("requires_review"),
        F.col("user_id").alias("subject"),
        F.col("props").alias("payload"),
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capture per user and day.

    Aggregating to the day first keeps a subject's history short (one row a day)
    however many events one user has. Values are added up in the order of event_id, so that
    sums don't hang on which task was done first; for that a day of one user is held as
    (event_id, value) pairs.
    """
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    known = F.when(F.col("value").isNotNull(), F.struct("event_id", "value"))
    in_order = F.transform(F.array_sort(F.collect_list(known)), lambda e: e["value"])
    days = events.groupBy(F.col("user_id").alias("subject"), F.to_date("ts").alias("day")).agg(
        moments(in_order).alias("_m"),
        F.log(1.0 + F.max("value")).alias("tds"),
        F.least(F.lit(2).cast("long"), F.count_if(F.col("event_type") == "error")).alias("a"),
        F.least(F.lit(8).cast("long"), F.count(F.lit(1))).alias("b"),
        F.size(F.collect_set("event_type")).cast("long").alias("c"),
        F.array_sort(F.collect_set("event_type")).alias("colors"),
    )
    return pin(
        days, {"diameter": F.try_divide("_m.total", "_m.n"), "area": F.when(F.col("_m.n") > 0, F.col("_m.total")),
               "color_variance": F.coalesce(F.sqrt(F.try_divide("_m.square", "_m.n")), F.lit(0.0))},
    ).select("subject", "day", "diameter", "area", "tds", "a", "b", "c", "color_variance", "colors")


def document_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape measures of each document's whole text, for the rule engine."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.array_remove(F.split("text", r"\s+"), "")
    lines = F.array_remove(F.split("text", "\n"), "")
    return docs.select(
        "doc_id", F.length("text").alias("chars"), words.alias("words"), lines.alias("lines")
    ).select(
        "doc_id",
        F.col("chars").cast("double").alias("chars"),
        F.try_divide(
            F.length(F.array_join("words", "")).cast("double"), F.size("words").cast("double")
        ).alias("mean_word"),
        F.try_divide(
            F.size(F.array_distinct("words")).cast("double"), F.size("words").cast("double")
        ).alias("distinct_share"),
        (
            1.0
            - F.try_divide(
                F.size(F.array_distinct("lines")).cast("double"), F.size("lines").cast("double")
            )
        ).alias("repeat_share"),
    )
