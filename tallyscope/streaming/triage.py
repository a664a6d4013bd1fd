"""Continuous triage and live statistics.

Both read a file stream. Triage is stateless: each micro-batch is graded and written to
the case log as upserts whose ``seq`` comes from the source, under the batch's own name. A
replayed batch replaces itself, and a late row is upserted again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cases as C
from ..operators import grading as G
from ..sources.taxonomy import CLASS_CODES, CLASS_NAMES


# Versions of the live statistics that stay.
KEPT_VERSIONS = 2


def table_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A table of the folder as a stream, be it stored as one file or as a folder of files."""
    # A path with a pattern may stand for either.
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{name}.parquet}}")


def file_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def graded_cases(graded: DataFrame, item: str, seq: str, created_at: str) -> DataFrame:
    """Graded records as case rows."""
    return graded.select(
        F.col(item).cast("string").alias("id"),
        F.col(seq).cast("long").alias("seq"),
        F.col(created_at).cast("timestamp").alias("created_at"),
        F.col("code").alias("top_code"),
        G._pick([CLASS_NAMES[c] for c in CLASS_CODES], F.col("top_idx")).alias("top_name"),
        "confidence", "tier",
        F.round("score", 1).alias("severity_score"),
        F.round("malignant_probability", 4).alias("malignancy_probability"),
        "tds", "quality_score",
        F.col("requires_human_review").alias("requires_review"),
        F.to_json(F.struct(item, "tier", "headline", "overrides")).alias("payload"),
    )


def triage_stream(
    source: DataFrame, log_dir: str, checkpoint: str, item: str, seq: str, created_at: str,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df, name: str = "triage",
) -> StreamingQuery:
    """Grade a stream of scored records into the case log; handles what is available.

    ``prepare`` turns a micro-batch into scored records (``probs`` plus evidence). ``name`` tells
    the streams of one log apart.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        rows = graded_cases(G.grade(prepare(batch)), item, seq, created_at)
        C.write_log(C.append_upserts(None, rows), log_dir, batch=f"{name}-{batch_id}")

    return (
        source.writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def tier_counts(cases: DataFrame) -> DataFrame:
    return cases.groupBy("tier").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("requires_review").alias("flagged"),
        F.avg("confidence").alias("mean_confidence"),
    )


def live_stats(source: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Running case statistics by tier, written as one version of a table per micro-batch.

    Counts live in the stream's state store and results in shared storage, so neither is
    lost with the driver; a batch that is run again replaces its own version.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        # A reader may still be at the version before; older ones go.
        old = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/version={batch_id - KEPT_VERSIONS}")
        old.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).delete(old, True)

    return (
        tier_counts(source)
        .writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_stats(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the statistics: one row per tier."""
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max("version").alias("version"))
    return versions.filter(F.col("version") == newest.scalar()).drop("version")
