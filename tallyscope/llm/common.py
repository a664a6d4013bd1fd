"""What the operators of this folder share."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# White space of all contracts: space and 0x09 to 0x0D.
SPACE = b" \t\n\x0b\x0c\r"
SPACE_CLASS = r"[ \t-\r]"
WORD_CLASS = r"[^ \t-\r]+"


_ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Make this package importable for Python workers.

    Workers find it where the package is installed, on PYTHONPATH or in the folder that the
    driver was started in; else it is sent to them as an archive, once for each context.
    """
    context = spark.sparkContext
    near = [Path.cwd(), *map(Path, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep)))]
    if _ROOT in [p.resolve() for p in near] or getattr(context, "_tallyscope_sent", False):
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/tallyscope", "zip", _ROOT, "tallyscope")
    context.addPyFile(archive)
    context._tallyscope_sent = True


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = shipped
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text as bytes): the two columns most operators need; null text is empty."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"),
    )


def clean_rows(batches: Iterator[pa.RecordBatch], per: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in runs of at most `per` rows, so that what a task makes of one run stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, per):
            yield batch.slice(at, per)


def hex_digest(col: Column) -> Column:
    return F.sha2(col, 256)


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows with one doc_id and different texts apart."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))


def unused(name: str, docs: DataFrame) -> str:
    """The name, with underscores before it until no column of docs has it in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(docs: DataFrame, dropped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that are not in `dropped` (doc_id, row_key)."""
    key, other_id, other_key = (unused(n, docs) for n in ("_key", "_doc", "_other"))
    gone = dropped.select(F.col("doc_id").alias(other_id), F.col("row_key").alias(other_key))
    same = (F.col(key) == F.col(other_key)) & F.col(id_col).eqNullSafe(F.col(other_id))
    return docs.withColumn(key, row_key(id_col, text_col)).join(gone, same, "left_anti").drop(key)
