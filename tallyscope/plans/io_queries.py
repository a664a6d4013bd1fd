"""Sources, sinks, admission, record isolation, streams.

Queries that need files write the given table into a fresh folder under the shared
checkpoint folder first.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cases as C
from ..operators import grading as G
from ..operators import metrics as M
from ..operators import raster as R
from ..sources import bindings as B
from ..sources import io as IO
from ..session import scratch_path as scratch
from ..streaming import triage as ST
from ..functions.scores import linear_logits, softmax
from .grading_queries import parts_sql
from .raster_queries import PX
from .registry import query
from .score_queries import COMPARISON_METRICS, SUMMARY_SQL, r6
from .sql import CASES, CLASSES, PREDS, TIERS_CTE, VECS


@query(
    "a1_read_items",
    "SELECT c_custkey AS image_id, c_mktsegment AS dx, round(c_acctbal, 6) AS age FROM customer",
)
def a1(spark, sf_dir):
    folder = scratch(spark, "customer")
    customer = B.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    customer.toDF("image_id", "dx", "lesion_id", "age").write.option("header", True).csv(folder)
    items = IO.read_items(
        spark, folder, "image_id BIGINT, dx STRING, age DOUBLE, sex STRING", ("lesion_id", "image_id", "dx")
    )
    return items.select("image_id", "dx", r6("age", "age"))


@query("a2_convert_delimited", "SELECT n_nationkey, n_name, n_regionkey, (SELECT count(*) FROM nation) AS converted FROM nation")
def a2(spark, sf_dir):
    src, dst = scratch(spark, "nation.tab"), scratch(spark, "nation.csv")
    B.table(spark, sf_dir, "nation").write.option("header", True).option("sep", "\t").csv(src)
    n = IO.convert_delimited(spark, src, dst)
    schema = "n_nationkey INT, n_name STRING, n_regionkey INT"
    return IO.read_items(spark, dst, schema, ("n_nationkey",)).withColumn("converted", F.lit(n).cast("long"))


@query(
    "a3_path_index",
    r"""WITH p AS (SELECT url AS path, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS nm FROM pages),
e AS (SELECT path, regexp_replace(nm, '\.[^.]+$', '') AS stem, lower(regexp_extract(nm, '\.([^.]+)$', 1)) AS ext FROM p)
SELECT stem, path FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY list_position(['html', 'htm'], ext), path) AS rn FROM e WHERE ext IN ('html', 'htm')) WHERE rn = 1""",
)
def a3(spark, sf_dir):
    return IO.index_paths(B.table(spark, sf_dir, "pages").select("url"), "url", ("html", "htm")).select("stem", "path")


@query("a3_file_index")
def a3_files(spark, sf_dir):
    return IO.index_files(spark, sf_dir, ("parquet",)).select("stem")


@query(
    "a4_resolve",
    f"""SELECT d.lang, count(*) AS kept, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS dropped
FROM documents d JOIN labels USING (doc_id) GROUP BY d.lang""",
)
def a4(spark, sf_dir):
    items = B.table(spark, sf_dir, "documents").select("doc_id", "lang")
    index = B.table(spark, sf_dir, "labels").select("doc_id", "quality")
    counts = IO.located(items, index, "doc_id").groupBy("lang").agg(
        F.count_if("found").alias("kept"), F.count_if(~F.col("found")).alias("_lost")
    )
    dropped = counts.agg(F.sum("_lost").alias("dropped"))
    return counts.filter("kept > 0").withColumn("dropped", dropped.scalar()).drop("_lost")


@query(
    "j3_left_join_paths",
    "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels USING (doc_id)",
)
def j3(spark, sf_dir):
    items = B.table(spark, sf_dir, "documents").select("doc_id")
    return items.join(B.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


def lang_dim(spark, langs=B.LANGS):
    return spark.createDataFrame(list(enumerate(langs)), "class_idx INT, lang STRING")


@query(
    "a5_encode_class",
    "SELECT doc_id, CAST(list_position(['de', 'en', 'es', 'fr'], lang) - 1 AS INTEGER) AS label FROM documents",
)
def a5(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return IO.encode_class(docs, lang_dim(spark), "lang").select("doc_id", "label")


@query("x3_unknown_codes", "SELECT DISTINCT lang FROM documents WHERE lang NOT IN ('de', 'en')")
def x3(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("lang")
    return IO.unknown_codes(docs, lang_dim(spark, ("de", "en")), "lang")


@query("a7_fingerprint", "SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def a7(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    return IO.fingerprint(docs, "text").select("doc_id", "sha256", "bytes")


@query(
    "a8_admission",
    r"""SELECT page_id, CASE WHEN page_id % 3 <> 0 AND lower(regexp_extract(url, '(\.[^./]+)$', 1)) NOT IN ('.html') THEN 'unsupported_type'
 WHEN strlen(html) = 0 THEN 'empty' WHEN strlen(html) > 5000 THEN 'too_large' END AS reject_reason FROM pages""",
)
def a8(spark, sf_dir):
    pages = B.table(spark, sf_dir, "pages")
    kind = F.when(F.col("page_id") % 3 == 0, "text/html")
    return IO.admit(
        pages, "url", kind, F.octet_length("html"), ("text/html",), (".html",), 5000
    ).select("page_id", "reject_reason")


@query("a6_image_rows", f"WITH {PX} SELECT image_id, y, x, r, g, b FROM px0")
def a6(spark, sf_dir):
    """Pictures as the image source has them (bytes in BGR order), taken apart into pixels."""
    arrays = B.raster_arrays(spark, sf_dir)
    two = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")
    coded = F.array_join(F.transform("px", lambda p: F.concat(two(p["b"]), two(p["g"]), two(p["r"]))), "")
    images = arrays.select(
        F.struct(
            F.concat(F.lit("file:/pictures/"), F.col("image_id").cast("string"), F.lit(".png")).alias("origin"), F.col("h").alias("height"), F.col("w").alias("width"),
            F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), F.unhex(coded).alias("data"),
        ).alias("image")
    )
    return R.pixels(R.image_arrays(images)).select(F.col("image_id").cast("long").alias("image_id"), "y", "x", "r", "g", "b")


DIRTY = "CASE WHEN event_id % 17 = 0 THEN substr(props, 1, 4) WHEN event_id % 19 = 0 THEN NULL ELSE props END"


@query(
    "a9_record_isolation",
    f"""WITH d AS (SELECT event_id, {DIRTY} AS props FROM events)
SELECT event_id, props IS NOT NULL AND event_id % 17 <> 0 AS ok, CASE WHEN props IS NULL THEN 'missing' WHEN event_id % 17 = 0 THEN 'malformed' END AS error,
 CASE WHEN event_id % 17 <> 0 THEN CAST(props ->> '$.k' AS BIGINT) END AS k FROM d""",
)
def a9(spark, sf_dir):
    n = F.col("event_id")
    events = B.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(n % 17 == 0, F.substring("props", 1, 4)).when(n % 19 == 0, F.lit(None)).otherwise(F.col("props")).alias("props"),
    )
    good, bad = IO.split_ok(IO.parse_records(events, "props", "k BIGINT"))
    return good.unionByName(bad).select("event_id", "ok", "error", F.col("parsed.k").alias("k"))


@query(
    "a10_case_table",
    f"WITH {CASES} SELECT tier, count(*) AS n, round(avg(severity_score), 4) AS mean_score, sum(length(payload)) AS payload_chars FROM cases GROUP BY tier",
)
def a10(spark, sf_dir):
    folder = scratch(spark, "case_log")
    C.write_log(C.append_upserts(None, B.case_rows(spark, sf_dir)), folder)
    state = C.current(C.read_log(spark, folder), ("tier", "severity_score", "payload"))
    return state.groupBy("tier").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("severity_score"), 4).alias("mean_score"),
        F.sum(F.length("payload")).alias("payload_chars"),
    )


@query(
    "a11_payload",
    """SELECT event_id, '{"k":' || CAST(props ->> '$.k' AS VARCHAR) || '}' AS payload, CAST(props ->> '$.k' AS BIGINT) AS k FROM events""",
)
def a11(spark, sf_dir):
    events = B.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    images = F.create_map(F.lit("original"), F.concat(F.lit("thumb-"), "event_id"))
    full = events.select("event_id", F.to_json(F.struct(k.alias("k"), images.alias("images"))).alias("payload"))
    stripped = IO.strip_payload(full, "payload")
    return IO.parse_payload(stripped, "payload", "k BIGINT").select("event_id", "payload", F.col("parsed.k").alias("k"))


@query(
    "a12_artifacts",
    f"""SELECT TRUE AS found, {", ".join(COMPARISON_METRICS)} FROM ({SUMMARY_SQL})
UNION ALL SELECT FALSE, {", ".join("NULL" for _ in COMPARISON_METRICS)}""",
)
def a12(spark, sf_dir):
    """Metric documents written for the scored table, read back; one is missing."""
    folder = scratch(spark, "artifacts")
    summary = M.summary(B.probs(spark, sf_dir))
    IO.write_artifact(summary.select(F.struct(*COMPARISON_METRICS).alias("measured")), folder)
    name = IO.index_files(spark, folder, ("json",)).select(F.concat("stem", F.lit(".json"))).first()[0]
    rows = IO.read_artifacts(spark, folder, [name, "absent.json"])
    parsed = F.from_json("document", f"measured STRUCT<{', '.join(f'{m}: DOUBLE' for m in COMPARISON_METRICS)}>")
    return rows.select(F.col("document").isNotNull().alias("found"), parsed.alias("p")).select("found", "p.measured.*")


@query("a13_result_documents", SUMMARY_SQL)
def a13(spark, sf_dir):
    folder = scratch(spark, "evaluation")
    IO.write_artifact(M.summary(B.probs(spark, sf_dir)), folder)
    return spark.read.json(folder)


@query(
    "a14_feature_cache",
    f"WITH {VECS} SELECT code, count(*) AS n, count(*) AS again FROM vecs GROUP BY code",
)
def a14(spark, sf_dir):
    folder = scratch(spark, "features")
    first = IO.cached(spark, folder, lambda: B.vecs(spark, sf_dir))

    def never():
        raise AssertionError("the stored result must be used")

    again = IO.cached(spark, folder, never)
    return first.groupBy("code").agg(F.count(F.lit(1)).alias("n")).join(
        again.groupBy("code").agg(F.count(F.lit(1)).alias("again")), "code"
    )


@query(
    "p23_flatten_result",
    """SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE event_type END AS top_code,
 CASE WHEN event_id % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE round(value, 6) END AS confidence, CASE WHEN event_id % 7 = 0 THEN 'INDETERMINATE' ELSE 'LOW' END AS tier,
 CASE WHEN event_id % 3 = 0 THEN NULL ELSE round(value / 2, 6) END AS tds, event_id % 7 <> 0 AS requires_review,
 CASE WHEN event_id % 2 = 0 THEN 'thumb' END AS thumbnail FROM events""",
)
def p23(spark, sf_dir):
    n, v = F.col("event_id"), F.col("value")
    doc = F.struct(
        n.cast("string").alias("case_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        F.when(n % 5 != 0, F.struct(F.col("event_type").alias("code"), v.alias("confidence"))).alias("prediction"),
        F.when(n % 7 != 0, F.struct(F.lit("LOW").alias("tier"), F.lit(True).alias("requires_human_review"))).alias("severity"),
        F.when(n % 3 != 0, F.struct(F.struct((v / 2).alias("tds")).alias("abcd"))).alias("morphology"),
        F.when(n % 2 == 0, F.create_map(F.lit("original"), F.lit("thumb"))).alias("images"),
    )
    results = B.table(spark, sf_dir, "events").select(F.from_json(F.to_json(doc), C.RESULT_SCHEMA).alias("r"))
    flat = C.flatten_result(results.select("r.*"))
    return flat.select(
        "id", "top_code", r6("confidence", "confidence"), "tier", r6("tds", "tds"), "requires_review", "thumbnail"
    )


# --------------------------------------------------------------------- streams

STREAM_SQL = f"""WITH {CLASSES}, {TIERS_CTE}, {PREDS},
ev AS (SELECT *, probs[5] AS pc, CAST(NULL AS DOUBLE) AS tds, TRUE AS reliable, CAST(NULL AS DOUBLE) AS ent,
  CAST(NULL AS DOUBLE) AS agreement, CAST(NULL AS DOUBLE) AS margin, CAST(NULL AS DOUBLE) AS quality_score,
  TRUE AS in_domain, CAST(NULL AS VARCHAR) AS stability FROM preds), {parts_sql(True)}
SELECT CAST(vec_id AS VARCHAR) AS id, tier, round(score, 1) AS severity_score FROM gt"""


@query("t1_triage_stream", STREAM_SQL)
def t1(spark, sf_dir):
    """Vectors arrive as a stream, are scored against a fixed head, graded, upserted."""
    log_dir, checkpoint = scratch(spark, "log"), scratch(spark, "offsets")
    # The head is stored once; every micro-batch reads it, none derives it again.
    train = B.split_vecs(spark, sf_dir).filter("split = 'train'")
    head = IO.cached(spark, scratch(spark, "head"), lambda: B.class_means(train))
    schema = B.table(spark, sf_dir, "embeddings").schema
    source = ST.table_stream(spark, sf_dir, "embeddings", schema)

    def prepare(batch):
        kept = batch.withColumn("label", F.col("label") % 7).withColumn("_w", head.scalar())
        logits = linear_logits(F.col("embedding").cast("array<double>"), F.col("_w"), scale=40.0)
        return kept.withColumn("logits", logits).select(
            "vec_id", softmax(F.col("logits")).alias("probs"),
            # One capture a minute: the log is laid out by the record's own day.
            F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id") * 60).alias("created_at"),
        )

    ST.triage_stream(source, log_dir, checkpoint, "vec_id", "vec_id", "created_at", prepare).awaitTermination()
    state = C.current(C.read_log(spark, log_dir), ("tier", "severity_score"))
    return state.select("id", "tier", "severity_score")


@query(
    "t2_live_stats",
    f"WITH {CASES} SELECT tier, count(*) AS n, count(*) FILTER (WHERE requires_review) AS flagged, round(avg(confidence), 6) AS mean_confidence FROM cases GROUP BY tier",
)
def t2(spark, sf_dir):
    schema = B.table(spark, sf_dir, "events").schema
    events = ST.table_stream(spark, sf_dir, "events", schema)
    v = F.col("value")
    tier = F.when(v >= 150, "CRITICAL").when(v >= 75, "HIGH").when(v >= 25, "MODERATE").otherwise("LOW")
    cases = events.select(tier.alias("tier"), (v / (v + 50)).alias("confidence"), (v >= 75).alias("requires_review"))
    table = scratch(spark, "live")
    ST.live_stats(cases, table, scratch(spark, "offsets")).awaitTermination()
    return ST.latest_stats(spark, table).select("tier", "n", "flagged", r6("mean_confidence", "mean_confidence"))
