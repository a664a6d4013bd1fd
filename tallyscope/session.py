"""Session helpers shared by the bench, the tests and jobs that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job here assumes. AQE sizes shuffles at run time, so the
# static partition number only has to be an upper bound.
JOB_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Plans here have many column expressions; do not record a call site for each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(app: str, cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in JOB_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder lineage may be cut into.

    The cluster names it in ``spark.checkpoint.dir``. A local master may fall
    back to a fresh folder; any other master must configure one, because a
    machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    configured = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        configured = tempfile.mkdtemp(prefix="tallyscope-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    # Spark puts a folder of this application's own below the configured one.
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/tallyscope/{uuid.uuid4().hex}/{name}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has stored; call it when no result is read any more."""
    jvm, context = spark._jvm, spark.sparkContext
    if context.getCheckpointDir() is not None:
        folder = jvm.org.apache.hadoop.fs.Path(f"{context.getCheckpointDir()}/tallyscope")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a narrow intermediate table once and read it back.

    For results that several branches of a plan read and that are dear to derive: the
    lineage is cut in shared storage, so a lost executor costs a re-read, and the copy
    is columnar, so each branch still reads only its own columns.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
