"""Case history as an append-only change log.

The log holds ``(id, seq, op, ...case columns, notes)`` with op in upsert, note,
delete and ``seq`` given by the source. The current state of every case is one
aggregation by id: later records win inside the partial aggregates already, so an
id with very many versions never travels as a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.basic import ratio
from ..session import stored
from ..sources.taxonomy import CLASS_CODES, TIERS

CASE_SCHEMA = (
    "id STRING, created_at TIMESTAMP, filename STRING, top_code STRING, top_name STRING, "
    "confidence DOUBLE, tier STRING, severity_score DOUBLE, malignancy_probability DOUBLE, "
    "tds DOUBLE, quality_score DOUBLE, requires_review BOOLEAN, weights_status STRING, "
    "thumbnail STRING, payload STRING"
)
LOG_SCHEMA = f"seq BIGINT, op STRING, notes STRING, {CASE_SCHEMA}"
PAGE_LIMIT = 200


def _as_log(rows: DataFrame, op: str) -> DataFrame:
    """Shape rows like the log; absent columns become null."""
    schema = rows.sparkSession.createDataFrame([], LOG_SCHEMA).schema
    given = set(rows.columns)
    return rows.withColumn("op", F.lit(op)).select(
        *[
            (F.col(f.name) if f.name in given | {"op"} else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def append_upserts(log: DataFrame | None, rows: DataFrame) -> DataFrame:
    """Insert or replace by id. A replaced case loses its earlier note."""
    new = _as_log(rows, "upsert").withColumn("notes", F.lit(None).cast("string"))
    return new if log is None else log.unionByName(new)


def append_notes(log: DataFrame, notes: DataFrame) -> DataFrame:
    """Set (or clear, with a null) notes: rows of (id, seq, notes)."""
    return log.unionByName(_as_log(notes, "note"))


def append_note(log: DataFrame, case_id: str, seq: int, note: str | None) -> DataFrame:
    spark = log.sparkSession
    return append_notes(
        log, spark.createDataFrame([(case_id, seq, note)], "id STRING, seq BIGINT, notes STRING")
    )


def append_delete(log: DataFrame, ids: DataFrame) -> DataFrame:
    """Tombstones: rows of (id, seq)."""
    return log.unionByName(_as_log(ids, "delete"))


def clear(log: DataFrame, seq: int) -> DataFrame:
    """Delete every current case."""
    return append_delete(log, current(log).select("id").withColumn("seq", F.lit(seq).cast("long")))


def matched(log: DataFrame, ids: DataFrame) -> DataFrame:
    """Which of ``ids`` a note or a delete would reach: (id, found)."""
    live = current(log).select("id", F.lit(True).alias("_live"))
    return ids.select("id").join(live, "id", "left").select(
        "id", F.coalesce("_live", F.lit(False)).alias("found")
    )


def current(log: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Latest version per id. Only notes written after the last upsert count.

    ``columns`` limits what the aggregation carries (leave the payload out of lists).
    """
    return _versions(log, columns).drop("note_seq")


def _versions(log: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Current cases with ``note_seq``, the record their note came with.

    Only numbers are aggregated: the last record and the last note of each id. The rows
    themselves are found by (id, seq), which spreads an id with very many versions; a
    record that was delivered twice counts once.
    """
    wanted = list(columns or [c for c in log.columns if c not in ("seq", "op", "notes")])
    carried = [c for c in dict.fromkeys([*wanted]) if c not in ("id", "notes")]
    is_note = F.col("op") == "note"
    last = log.groupBy("id").agg(
        F.max(F.when(~is_note, F.col("seq"))).alias("_seq"), F.max(F.when(is_note, F.col("seq"))).alias("_note_seq")
    )
    # By the keys of the join, so that copies of a record are told apart without another exchange.
    once = W.partitionBy("id", "seq").orderBy("seq")

    def at(rows: DataFrame, which: str) -> DataFrame:
        keys = last.select(F.col("id").alias("_id"), which, "_note_seq" if which == "_seq" else "_seq")
        found = rows.join(keys, (F.col("id") == F.col("_id")) & (F.col("seq") == F.col(which)))
        return found.withColumn("_copy", F.row_number().over(once)).filter("_copy = 1")

    state = at(log.filter(~is_note).select("id", "seq", "op", *carried), "_seq").filter("op = 'upsert'")
    notes = at(log.filter(is_note).select("id", "seq", "notes"), "_note_seq").filter("seq > _seq")
    notes = notes.select(F.col("id").alias("_of"), "notes", F.col("seq").alias("note_seq"))
    return state.join(notes, F.col("id") == F.col("_of"), "left").select("id", "seq", *carried, "notes", "note_seq")


def get(log: DataFrame, case_id: str) -> DataFrame:
    """Point read: the id filter reaches the scan before anything is aggregated."""
    return current(log.filter(F.col("id") == case_id))


def filter_cases(
    cases: DataFrame, tier: str | None = None, code: str | None = None, review_only: bool = False,
    known_codes: Sequence[str] = CLASS_CODES,
) -> DataFrame:
    """Optional AND-ed filters; unknown values are an error, not an empty page."""
    if tier and tier not in TIERS:
        raise ValueError(f"no such tier: {tier}")
    if code and code not in known_codes:
        raise ValueError(f"no such class: {code}")
    if tier:
        cases = cases.filter(F.col("tier") == tier)
    if code:
        cases = cases.filter(F.col("top_code") == code)
    return cases.filter("requires_review") if review_only else cases


# What a page's place is narrowed down by: time in ever smaller units, then the beginning of the id.
_PLACES = (
    lambda: F.struct(F.date_trunc("day", "created_at").alias("t")),
    lambda: F.struct(F.date_trunc("minute", "created_at").alias("t")),
    lambda: F.struct(F.col("created_at").alias("t"), F.substring("id", 1, 2).alias("i")),
)


def list_cases(cases: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first, with the total on every row; limit 1..200, offset >= 0.

    Counts by time and id tell between which keys the page lies: first by day, then by minute
    inside those days, then by time and beginning of the id. Only the rows between the last keys
    are sorted, however deep the page. The cases are evaluated once, stored.
    """
    limit, offset = max(1, min(int(limit), PAGE_LIMIT)), max(0, int(offset))
    cases = stored(cases, "state")
    inside, skipped, total = cases, 0, None
    for place in _PLACES:
        counts = inside.groupBy(place().alias("_k")).agg(F.count(F.lit(1)).alias("n"))
        upto = W.partitionBy(F.lit(0)).orderBy(F.desc("_k"))
        # As many rows as there are units in the range that is left.
        sums = counts.withColumn("_upto", F.sum("n").over(upto))
        first, last = offset - skipped, offset - skipped + limit
        at = (F.col("_upto") > first) & (F.col("_upto") - F.col("n") < last)
        row = sums.agg(
            F.min(F.when(at, F.col("_k"))).alias("low"), F.max(F.when(at, F.col("_k"))).alias("high"),
            F.min(F.when(at, F.col("_upto") - F.col("n"))).alias("before"), F.max("_upto").alias("all"),
        ).first()
        if total is None:
            total = row["all"] or 0
        if row["low"] is None:
            return cases.limit(0).withColumn("total", F.lit(total).cast("long"))
        low, high = (F.struct(*[F.lit(v).alias(n) for n, v in row[c].asDict().items()]) for c in ("low", "high"))
        inside = inside.filter((place() >= low) & (place() <= high))
        skipped += row["before"]
    page = inside.orderBy(F.col("created_at").desc(), F.col("id").desc()).offset(offset - skipped).limit(limit)
    return page.withColumn("total", F.lit(total).cast("long"))


def page_after(cases: DataFrame, last_key: tuple | None, limit: int = 50) -> DataFrame:
    """Keyset page: rows strictly after ``last_key`` = (created_at, id).

    The key is a filter, so page 10,000 costs as much as page 2.
    """
    if last_key is not None:
        ts, last_id = F.lit(last_key[0]).cast("timestamp"), F.lit(last_key[1])
        cases = cases.filter(
            (F.col("created_at") < ts) | ((F.col("created_at") == ts) & (F.col("id") < last_id))
        )
    limit = max(1, min(int(limit), PAGE_LIMIT))
    return cases.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def case_stats(cases: DataFrame) -> DataFrame:
    """Totals and means; 0 when there are no cases."""

    def mean(c: str, digits: int) -> Column:
        return F.round(F.coalesce(F.avg(c), F.lit(0.0)), digits)

    return cases.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("requires_review").alias("flagged_for_review"),
        mean("confidence", 4).alias("mean_confidence"),
        mean("severity_score", 1).alias("mean_severity_score"),
        mean("quality_score", 1).alias("mean_quality_score"),
        F.min("created_at").alias("first_case"),
        F.max("created_at").alias("last_case"),
    )


def case_breakdown(cases: DataFrame) -> DataFrame:
    """Counts by tier, by class and overall in one pass (grouping sets)."""
    counts = cases.groupBy("tier", "top_code", "top_name").agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.groupingSets(
            [["tier"], ["top_code", "top_name"], []], "tier", "top_code", "top_name"
        )
        .agg(F.sum("n").alias("n"), F.grouping_id().alias("_g"))
        .select(
            F.when(F.col("_g") == 3, "tier").when(F.col("_g") == 4, "class").otherwise("all").alias("kind"),
            F.coalesce("tier", "top_code", F.lit("")).alias("key"), "n",
        )
    )


def urgent_total(cases: DataFrame) -> DataFrame:
    urgent = F.col("tier").isin("HIGH", "CRITICAL")
    return cases.agg(
        F.count_if(urgent).alias("urgent"),
        F.round(ratio(F.count_if(urgent), F.count(F.lit(1))) * 100, 2).alias("urgent_pct"),
    )


# ---------------------------------------------------------- nested result rows

RESULT_SCHEMA = (
    "case_id STRING, created_at STRING, filename STRING, "
    "prediction STRUCT<code: STRING, name: STRING, confidence: DOUBLE>, "
    "severity STRUCT<tier: STRING, score: DOUBLE, malignancy_probability: DOUBLE, "
    "requires_human_review: BOOLEAN>, "
    "morphology STRUCT<abcd: STRUCT<tds: DOUBLE>>, quality STRUCT<score: DOUBLE>, "
    "model STRUCT<weights_status: STRING>, images MAP<STRING, STRING>"
)


def flatten_result(results: DataFrame) -> DataFrame:
    """Nested result to case row, with the defaults of absent parts.

    The images are stripped from the stored payload; the original becomes the
    thumbnail column.
    """

    def or_else(path: str, default) -> Column:
        return F.coalesce(F.col(path), F.lit(default))

    stored = [c for c in results.columns if c != "images"]
    return results.select(
        F.col("case_id").alias("id"),
        F.try_to_timestamp("created_at").alias("created_at"),
        "filename",
        or_else("prediction.code", "unknown").alias("top_code"),
        or_else("prediction.name", "unknown").alias("top_name"),
        or_else("prediction.confidence", 0.0).alias("confidence"),
        or_else("severity.tier", "INDETERMINATE").alias("tier"),
        or_else("severity.score", 0.0).alias("severity_score"),
        or_else("severity.malignancy_probability", 0.0).alias("malignancy_probability"),
        F.col("morphology.abcd.tds").alias("tds"),
        or_else("quality.score", 0.0).alias("quality_score"),
        or_else("severity.requires_human_review", False).alias("requires_review"),
        F.col("model.weights_status").alias("weights_status"),
        F.col("images")["original"].alias("thumbnail"),
        F.to_json(F.struct(*stored)).alias("payload"),
    )


def attach_thumbnail(cases: DataFrame) -> DataFrame:
    """Give a stored payload its image map back (empty when there is none)."""
    images = F.when(
        F.col("thumbnail").isNotNull(), F.create_map(F.lit("original"), F.col("thumbnail"))
    ).otherwise(F.from_json(F.lit("{}"), "map<string,string>"))
    return cases.withColumn("images", images)


# ------------------------------------------------------------------- storage


def write_log(rows: DataFrame, path: str, mode: str = "append", batch: str | None = None) -> None:
    """Append to a log stored as Parquet, by batch and day; rows of one day are sorted by id.

    A named ``batch`` has a folder of its own that a repeated write replaces as a whole, so a
    micro-batch that is run again leaves one copy. Rows without a name share one folder.
    """
    dated = rows.withColumn("day", F.to_date(F.coalesce("created_at", F.current_timestamp()))).sortWithinPartitions("day", "id")
    folder = f"{path}/batch={batch or 'direct'}"
    # Bloom filters on the id let a point read skip the row groups of long days.
    writer = dated.write.mode("overwrite" if batch else mode).option("parquet.bloom.filter.enabled#id", "true")
    writer.partitionBy("day").parquet(folder)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{LOG_SCHEMA}, batch STRING, day DATE").parquet(path).drop("batch", "day")


def compact(log: DataFrame, path: str) -> None:
    """Write the current state as a fresh log of plain upserts and notes; path must be new.

    Files are dealt out by range of (day, id), so an id lies in one narrow range of each day.
    """
    cases = _versions(log)
    notes = cases.filter("note_seq IS NOT NULL").select("id", F.col("note_seq").alias("seq"), "notes")
    rows = append_notes(append_upserts(None, cases.drop("note_seq")), notes)
    write_log(rows.repartitionByRange(F.to_date("created_at"), "id"), path, mode="error")
