"""Stages of a training corpus: each works on all that the one before has kept.

1. quality classifier: documents that it rejects go
2. exact dedup: of equal texts one row stays
3. MinHash near-dedup: of each component (five-word shingles, similarity 0.8) one document stays
4. secret scans: secrets are masked in the texts, n_chars follows
5. packing: pieces of the documents in sequences of at most 2048 ids

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents, in order. Nulls, empty and very long texts, ties, repeated rows,
further columns and empty tables are handled as each operator says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyscope.llm import exact, minhash, packing, quality, secrets
from tallyscope.llm.common import ship
from tallyscope.session import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_copies(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_copies(docs, k=5, similarity=(80, 100), bands=48, rows=4)


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, length_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    return packing.pack(docs, vocabularies.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("exact dedup", one_of_copies),
    ("minhash near-dedup", one_of_near_copies),
    ("secret scans", masked_secrets),
    ("packing", packed),
]

# The classifier's fit and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
