"""Readers, writers, admission checks and record isolation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T


# ---- fixed values -----------------------------------------------------------
REQUIRED_COLUMNS = ("lesion_id", "image_id", "dx")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png")  # the first one wins when a stem occurs twice
ALLOWED_TYPES = ("image/jpeg", "image/jpg", "image/png", "image/webp", "image/bmp", "image/tiff")
ALLOWED_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff")
MAX_BYTES = 12 * 1024 * 1024
# ---- end of fixed values ----------------------------------------------------

ITEM_SCHEMA = (
    "lesion_id STRING, image_id STRING, dx STRING, age DOUBLE, sex STRING, localization STRING"
)


# ------------------------------------------------------------------ metadata


def require_columns(df: DataFrame, required: Sequence[str], source: str = "input") -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"columns {missing} are not in {source}")
    return df


def read_items(
    spark: SparkSession, path: str, schema: str = ITEM_SCHEMA,
    required: Sequence[str] = REQUIRED_COLUMNS, sep: str = ",",
) -> DataFrame:
    """Delimited metadata with a header.

    Columns are matched by name and cast to the schema (unreadable values become
    null); schema columns the file lacks are null unless required.
    """
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    require_columns(raw, required, path)
    fields = T._parse_datatype_string(schema).fields
    return raw.select(
        *[
            (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType))
            .alias(f.name)
            for f in fields
        ]
    )


def convert_delimited(
    spark: SparkSession, src: str, dst: str, sep_in: str = "\t", sep_out: str = ","
) -> int:
    """Rewrite a delimited file set with another separator; returns the row count."""
    rows = spark.read.option("header", True).option("sep", sep_in).csv(src)
    if rows.isEmpty():
        raise ValueError(f"{src} holds no record")
    seen = Observation("converted")
    counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").option("header", True).option("sep", sep_out).csv(dst)
    return int(seen.get["rows"])


# ---------------------------------------------------------------- file index


def index_paths(files: DataFrame, path: str, exts: Sequence[str] = IMAGE_EXTENSIONS) -> DataFrame:
    """(stem, path): one path per stem, extensions in order of preference.

    The winner is a minimum, so a stem shared by very many files merges map-side.
    """
    bare = F.regexp_replace(F.col(path), r"[?#].*$", "")
    name = F.regexp_extract(bare, r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    rank = F.array_position(F.array(*[F.lit(e) for e in exts]), ext)
    named = files.select(
        F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), F.col(path).alias("path"),
        rank.alias("_rank"),
    ).filter("_rank > 0")
    return named.groupBy("stem").agg(F.min_by("path", F.struct("_rank", "path")).alias("path"))


def index_files(spark: SparkSession, root: str, exts: Sequence[str] = IMAGE_EXTENSIONS) -> DataFrame:
    """Index of the files under a folder; contents are not read."""
    pattern = "*.{" + ",".join(sorted({e for x in exts for e in (x.lower(), x.upper())})) + "}"
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    return index_paths(files.select("path"), "path", exts)


def located(items: DataFrame, index: DataFrame, on: str) -> DataFrame:
    """Items with their index entry and ``found``: whether there is one (its values may be null)."""
    marked = index.withColumn("found", F.lit(True))
    return items.join(marked, on, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def resolve(items: DataFrame, index: DataFrame, on: str) -> tuple[DataFrame, Observation]:
    """Items with their index entry; rows without one go.

    How many went is observed (``dropped``) in the pass that reads the result.
    """
    seen = Observation()
    joined = located(items, index, on).observe(seen, F.count_if(~F.col("found")).alias("dropped"))
    return joined.filter("found").drop("found"), seen


# --------------------------------------------------------------------- labels


def unknown_codes(items: DataFrame, classes: DataFrame, code: str) -> DataFrame:
    """Observed codes that the class dimension does not have, null among them."""
    known = classes.select(F.col(code).alias("_known"))
    return items.select(code).distinct().join(known, F.col(code).eqNullSafe(F.col("_known")), "left_anti")


def encode_class(items: DataFrame, classes: DataFrame, code: str, strict: bool = True) -> DataFrame:
    """Add ``label`` from the class dimension; a code it lacks, or none, is an error."""
    if strict:
        bad = unknown_codes(items, classes, code).agg(
            F.count(F.lit(1)).alias("n"),
            F.array_join(F.sort_array(F.collect_list(F.coalesce(F.col(code).cast("string"), F.lit("NULL")))), ", ").alias("codes"),
        ).first()
        if bad["n"]:
            raise ValueError(f"{bad['n']} codes without a class: {bad['codes']}")
    dim = classes.select(code, F.col("class_idx").alias("label"))
    return items.join(dim, code, "left")


# ---------------------------------------------------------------------- images


def read_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) rows of the image source.

    The JVM decodes; a file it cannot read has height -1 and goes to quarantine
    instead of turning into a blank picture.
    """
    images = spark.read.format("image").option("dropInvalid", False).load(path)
    bad = F.col("image.height") < 0
    return images.filter(~bad), images.filter(bad).select(F.col("image.origin").alias("path"))


def fingerprint(df: DataFrame, content: str) -> DataFrame:
    """Identity of the bytes: sha256 and length."""
    return df.withColumns(
        {"sha256": F.sha2(F.col(content), 256), "bytes": F.octet_length(content).cast("long")}
    )


def admit(
    df: DataFrame, filename: str, content_type: Column, size: Column,
    types: Sequence[str] = ALLOWED_TYPES, suffixes: Sequence[str] = ALLOWED_SUFFIXES,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Add ``reject_reason``: null for records that may be processed.

    A record passes on an allowed type or an allowed suffix.
    """
    suffix = F.lower(F.regexp_extract(F.col(filename), r"(\.[^./]+)$", 1))
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    reason = (
        F.when(~kind.isin(list(types)) & ~suffix.isin(list(suffixes)), "unsupported_type")
        .when(F.coalesce(size, F.lit(0)) == 0, "empty")
        .when(size > max_bytes, "too_large")
    )
    return df.withColumn("reject_reason", reason)


# ------------------------------------------------------------ record isolation


def parse_records(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Parse JSON text; a bad record gets ``ok=false`` and an error, nothing fails.

    Add ``parsed``, ``ok`` and ``error``.
    """
    # Bounded by the schema text: one extra field catches what could not be parsed.
    parsed = F.from_json(
        column, f"{schema}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    )
    out = df.withColumn("_p", parsed)
    ok = F.col("_p").isNotNull() & F.col("_p._bad").isNull()
    return out.withColumns(
        {
            "ok": ok,
            "error": F.when(F.col(column).isNull(), "missing").when(~ok, "malformed"),
            "parsed": F.when(ok, F.col("_p").dropFields("_bad")),
        }
    ).drop("_p")


def split_ok(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good, quarantined)."""
    return df.filter(F.col(error).isNull()), df.filter(F.col(error).isNotNull())


# --------------------------------------------------------------------- payload


def strip_payload(df: DataFrame, payload: str, drop: Sequence[str] = ("images",)) -> DataFrame:
    """Remove top-level keys from a JSON payload column, keeping other values as text."""
    fields = F.from_json(payload, "map<string,variant>")
    kept = F.map_filter(fields, lambda k, _v: ~k.isin(list(drop)))
    return df.withColumn(payload, F.to_json(kept))


def parse_payload(df: DataFrame, payload: str, schema: str) -> DataFrame:
    return df.withColumn("parsed", F.from_json(payload, schema))


# ------------------------------------------------------------------- artefacts


def read_artifacts(spark: SparkSession, root: str, names: Sequence[str]) -> DataFrame:
    """(name, document): JSON text per artefact, null when missing or broken."""
    wanted = spark.createDataFrame([(n,) for n in names], "name STRING")
    try:
        found = (
            spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(root)
            .select(
                F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("name"),
                F.when(F.try_parse_json("value").isNotNull(), F.col("value")).alias("document"),
            )
        )
    except AnalysisException:
        return wanted.withColumn("document", F.lit(None).cast("string"))
    return wanted.join(found, "name", "left")


def comparison_rows(artifacts: DataFrame) -> DataFrame:
    """A stored model comparison as (model, metric, value, verified) rows."""
    models = artifacts.select(F.explode(F.from_json("document", "map<string,string>")).alias("model", "entry"))
    metrics = models.filter(~F.col("model").startswith("_")).select(
        "model", F.from_json("entry", "map<string,string>").alias("m")
    )
    return metrics.select(
        "model", F.explode("m").alias("metric", "text"), F.col("m")["verified"].alias("verified")
    ).select("model", "metric", F.col("text").try_cast("double").alias("value"), "verified").filter(
        "value IS NOT NULL"
    )


def write_artifact(df: DataFrame, path: str) -> None:
    """Store a (small) result as JSON documents."""
    df.write.mode("overwrite").json(path)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Stored result when complete, else build, store and read it back.

    The success marker tells a finished write from one cut short.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    marker = hadoop(path, "_SUCCESS")
    exists = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)
    if not exists:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
