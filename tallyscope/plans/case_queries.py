"""Case history and longitudinal change."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cases as C
from ..operators import change as CH
from ..operators import grading as G
from ..operators import metrics as M
from ..sources import bindings as B
from .registry import query
from .score_queries import r6
from .sql import CAPTURES, CASES, lit
from ..functions import texts as T

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
LIGHT = ("created_at", "top_code", "top_name", "confidence", "tier", "severity_score",
         "quality_score", "requires_review")


def base_log(spark, sf_dir):
    return C.append_upserts(None, B.case_rows(spark, sf_dir))


def edited_log(spark, sf_dir):
    """Every case stored; then some re-stored with a new score, noted, deleted.

    The edits are themselves functions of the table: each seventh case is stored
    again, each fifth gets a note before that, each eleventh one after it, each
    thirteenth is deleted.
    """
    rows = B.case_rows(spark, sf_dir)
    n = F.col("seq")
    step = 10_000_000_000
    again = rows.filter(n % 7 == 0).withColumn("severity_score", F.col("severity_score") / 2).withColumn(
        "seq", n + 2 * step
    )
    early = rows.filter(n % 5 == 0).select("id", (n + step).alias("seq"), F.concat(F.lit("early "), "id").alias("notes"))
    late = rows.filter(n % 11 == 0).select(
        "id", (n + 3 * step).alias("seq"),
        F.when(n % 2 == 0, F.concat(F.lit("late "), "id")).alias("notes"),
    )
    gone = rows.filter(n % 13 == 0).select("id", (n + 4 * step).alias("seq"))
    log = C.append_upserts(base_log(spark, sf_dir), again)
    return C.append_delete(C.append_notes(C.append_notes(log, early), late), gone)


STATE = f"""WITH {CASES}, st AS (SELECT *, CASE WHEN seq % 7 = 0 THEN severity_score / 2 ELSE severity_score END AS score,
 CASE WHEN seq % 11 = 0 THEN CASE WHEN seq % 2 = 0 THEN 'late ' || id END
      WHEN seq % 5 = 0 AND seq % 7 <> 0 THEN 'early ' || id END AS notes FROM cases WHERE seq % 13 <> 0)"""


@query("w8_latest_version", STATE + " SELECT id, top_code, tier, round(score, 6) AS severity_score, notes FROM st")
def w8(spark, sf_dir):
    state = C.current(edited_log(spark, sf_dir), ("top_code", "tier", "severity_score"))
    return state.select("id", "top_code", "tier", r6("severity_score", "severity_score"), "notes")


@query(
    "u1_idempotent_upsert",
    f"WITH {CASES} SELECT id, tier, round(severity_score, 6) AS severity_score, CAST(NULL AS VARCHAR) AS notes FROM cases",
)
def u1(spark, sf_dir):
    log = base_log(spark, sf_dir)
    twice = C.append_upserts(log, B.case_rows(spark, sf_dir).withColumn("seq", F.col("seq") + 10_000_000_000))
    return C.current(twice, ("tier", "severity_score")).select(
        "id", "tier", r6("severity_score", "severity_score"), "notes"
    )


@query("u2_notes", STATE + " SELECT id, notes FROM st WHERE notes IS NOT NULL")
def u2(spark, sf_dir):
    return C.current(edited_log(spark, sf_dir), ("tier",)).filter("notes IS NOT NULL").select("id", "notes")


@query(
    "u3_delete",
    STATE + """, ids AS (SELECT id FROM cases WHERE seq % 13 IN (0, 1)) SELECT ids.id, st.id IS NOT NULL AS found
 FROM ids LEFT JOIN st USING (id)""",
)
def u3(spark, sf_dir):
    ids = B.case_rows(spark, sf_dir).filter((F.col("seq") % 13).isin(0, 1)).select("id")
    return C.matched(edited_log(spark, sf_dir), ids)


@query("u3_clear", "SELECT CAST(0 AS BIGINT) AS remaining, count(*) AS logged FROM events")
def u3c(spark, sf_dir):
    log = base_log(spark, sf_dir)
    emptied = C.clear(log, 20_000_000_000)
    left = C.current(emptied, ("tier",)).agg(F.count(F.lit(1)).alias("remaining"))
    return left.withColumn("logged", log.agg(F.count(F.lit(1)).alias("n")).scalar())


@query("u4_point_read", STATE + " SELECT id, tier, payload, notes FROM st WHERE id = '77'")
def u4(spark, sf_dir):
    return C.get(edited_log(spark, sf_dir), "77").select("id", "tier", "payload", "notes")


@query(
    "p25_case_filter",
    STATE + f" SELECT id, tier, top_code FROM st WHERE tier = 'HIGH' AND top_code = {lit('purchase')} AND requires_review",
)
def p25(spark, sf_dir):
    state = C.current(edited_log(spark, sf_dir), LIGHT)
    return C.filter_cases(state, "HIGH", "purchase", True, known_codes=EVENT_TYPES).select("id", "tier", "top_code")


TS = "strftime(created_at, '%Y-%m-%d %H:%M:%S')"


def _ts():
    return F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at")


@query(
    "k1_case_page",
    STATE + f""" SELECT id, {TS} AS created_at, tier, notes, (SELECT count(*) FROM st) AS total FROM st
 ORDER BY st.created_at DESC, id DESC LIMIT 50 OFFSET 100""",
)
def k1(spark, sf_dir):
    state = C.current(edited_log(spark, sf_dir), LIGHT)
    return C.list_cases(state, limit=50, offset=100).select("id", _ts(), "tier", "notes", "total")


@query(
    "k2_keyset_page",
    f"""WITH {CASES} SELECT id, {TS} AS created_at, tier FROM cases
 WHERE (cases.created_at, id) < (SELECT (c.created_at, c.id) FROM cases c WHERE c.id = '500') ORDER BY cases.created_at DESC, id DESC LIMIT 50""",
)
def k2(spark, sf_dir):
    state = C.current(base_log(spark, sf_dir), LIGHT)
    key = C.get(base_log(spark, sf_dir), "500").select("created_at", "id").first()
    page = C.page_after(state, tuple(key) if key else None, 50)
    return page.select("id", _ts(), "tier")


@query(
    "g7_case_stats",
    STATE + """ SELECT count(*) AS total, count(*) FILTER (WHERE requires_review) AS flagged_for_review,
 round(avg(confidence), 4) AS mean_confidence, round(avg(score), 1) AS mean_severity_score,
 round(avg(quality_score), 1) AS mean_quality_score, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS first_case,
 strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_case FROM st""",
)
def g7(spark, sf_dir):
    stats = C.case_stats(C.current(edited_log(spark, sf_dir), LIGHT))
    for c in ("first_case", "last_case"):
        stats = stats.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return stats


@query(
    "g8_case_breakdown",
    STATE + """ SELECT 'tier' AS kind, tier AS key, count(*) AS n FROM st GROUP BY tier
 UNION ALL SELECT 'class', top_code, count(*) FROM st GROUP BY top_code UNION ALL SELECT 'all', '', count(*) FROM st""",
)
def g8(spark, sf_dir):
    return C.case_breakdown(C.current(edited_log(spark, sf_dir), LIGHT))


@query(
    "g9_batch_summary",
    f"""WITH {CASES}, r AS (SELECT tier, seq % 19 <> 0 AS ok FROM cases)
SELECT count(*) AS count, count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE NOT ok) AS failed,
 count(*) FILTER (WHERE ok AND tier = 'INDETERMINATE') AS n_indeterminate, count(*) FILTER (WHERE ok AND tier = 'LOW') AS n_low,
 count(*) FILTER (WHERE ok AND tier = 'MODERATE') AS n_moderate, count(*) FILTER (WHERE ok AND tier = 'HIGH') AS n_high,
 count(*) FILTER (WHERE ok AND tier = 'CRITICAL') AS n_critical,
 count(*) FILTER (WHERE ok AND tier IN ('HIGH', 'CRITICAL')) AS urgent FROM r""",
)
def g9(spark, sf_dir):
    return G.batch_summary(B.case_rows(spark, sf_dir).select("tier", (F.col("seq") % 19 != 0).alias("ok")))


@query(
    "g10_urgent_total",
    f"""WITH {CASES} SELECT count(*) FILTER (WHERE tier IN ('HIGH', 'CRITICAL')) AS urgent,
 round(100.0 * count(*) FILTER (WHERE tier IN ('HIGH', 'CRITICAL')) / count(*), 2) AS urgent_pct FROM cases""",
)
def g10(spark, sf_dir):
    return C.urgent_total(B.case_rows(spark, sf_dir))


# --------------------------------------------------------------- metric history

DAILY = """daily AS (SELECT event_type AS run, CAST(date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS INTEGER) AS epoch,
  avg(value) AS metric FROM events GROUP BY 1, 2)"""


def daily(spark, sf_dir):
    """Each event type as a run, each day as an epoch, the day's mean as its metric."""
    epoch = F.datediff(F.to_date("ts"), F.lit("2020-01-01").cast("date"))
    return (
        B.table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("run"), epoch.alias("epoch"))
        .agg(F.avg("value").alias("metric"))
    )


@query(
    "w4_best_epoch",
    f"""WITH {DAILY}, f AS (SELECT *, max(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sofar FROM daily),
i AS (SELECT *, (sofar IS NULL OR metric > sofar) AS improved FROM f)
SELECT run, epoch, round(metric, 6) AS metric, improved, max(epoch) FILTER (WHERE improved) OVER (PARTITION BY run) AS best_epoch FROM i""",
)
def w4(spark, sf_dir):
    return M.best_epoch(daily(spark, sf_dir), "run", "epoch", "metric").select(
        "run", "epoch", r6("metric", "metric"), "improved", "best_epoch"
    )


@query(
    "w5_early_stop",
    f"""WITH {DAILY}, f AS (SELECT *, coalesce(metric > max(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS improved,
  row_number() OVER (PARTITION BY run ORDER BY epoch) AS n FROM daily),
l AS (SELECT *, n - max(n) FILTER (WHERE improved) OVER (PARTITION BY run ORDER BY epoch) AS misses FROM f)
SELECT run, min(epoch) FILTER (WHERE misses >= 5) AS stop_epoch, count(*) AS epochs FROM l GROUP BY run""",
)
def w5(spark, sf_dir):
    return M.early_stop(daily(spark, sf_dir), "run", "epoch", "metric", patience=5)


# ----------------------------------------------------------------------- change

MEASURES = ("diameter", "area", "tds", "a", "b", "c", "color_variance", "colors")


def pairs(spark, sf_dir):
    """Pairs with a colour distance (1 - Jaccard of the types) and a similarity."""
    p = CH.capture_pairs(B.captures(spark, sf_dir), "subject", "day", MEASURES)
    shared = F.size(F.array_intersect("colors", "base_colors"))
    return p.withColumns(
        {
            "color_distance": 1.0 - shared / F.size(F.array_union("colors", "base_colors")).cast("double"),
            "similarity": F.exp(-F.abs(F.col("tds") - F.col("base_tds"))),
            "reliable": F.col("b") > 1,
        }
    )


PAIRS = CAPTURES + """,
lagged AS (SELECT *, lag(day) OVER w AS base_day, lag(diameter) OVER w AS base_diameter, lag(area) OVER w AS base_area,
  lag(tds) OVER w AS base_tds, lag(a) OVER w AS base_a, lag(b) OVER w AS base_b, lag(c) OVER w AS base_c,
  lag(color_variance) OVER w AS base_color_variance, lag(colors) OVER w AS base_colors
  FROM captures WINDOW w AS (PARTITION BY subject ORDER BY day)),
pairs AS (SELECT *, CAST(day AS VARCHAR) AS d, 1 - len(list_intersect(colors, base_colors)) / CAST(len(list_distinct(list_concat(colors, base_colors))) AS DOUBLE) AS color_distance,
  exp(-abs(tds - base_tds)) AS similarity, b > 1 AS reliable FROM lagged WHERE base_day IS NOT NULL)"""


def rel_sql(c: str, base: str | None = None) -> str:
    b = base or f"base_{c}"
    return f"CASE WHEN abs({b}) < 1e-9 THEN CASE WHEN abs({c}) < 1e-9 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END ELSE ({c} - {b}) / abs(CAST({b} AS DOUBLE)) END"


@query(
    "j8_prior_capture",
    f"WITH {PAIRS} SELECT subject, d, CAST(base_day AS VARCHAR) AS base_d, round(base_diameter, 6) AS base_diameter FROM pairs",
)
@query(
    "w7_previous_row",
    f"WITH {PAIRS} SELECT subject, d, CAST(base_day AS VARCHAR) AS base_d, round(base_diameter, 6) AS base_diameter FROM pairs",
)
def j8(spark, sf_dir):
    p = CH.capture_pairs(B.captures(spark, sf_dir), "subject", "day", MEASURES)
    return p.select(
        "subject", F.col("day").cast("string").alias("d"), F.col("base_day").cast("string").alias("base_d"),
        r6("base_diameter", "base_diameter"),
    )


@query(
    "j8_prior_event_spans",
    """SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts) AS prev_event,
 round(lag(value) OVER (PARTITION BY user_id ORDER BY ts), 6) AS prev_value FROM events""",
)
def j8_spans(spark, sf_dir):
    # Raw events: one user may own a third of them, so histories are cut into days.
    events = B.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    out = CH.previous_capture(events, "user_id", "ts", ("event_id", "value"), span=("minute", "hour", "day"))
    return out.select("event_id", F.col("prev.event_id").alias("prev_event"), r6("prev.value", "prev_value"))


@query(
    "j8_two_tables",
    """SELECT f.event_id, b.event_id AS base_event, round(b.value, 6) AS base_value FROM (SELECT * FROM events WHERE event_type <> 'signup') f
 ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') b ON f.user_id = b.user_id AND f.ts >= b.ts""",
)
def j8_two(spark, sf_dir):
    # One user may own a third of both tables.
    events = B.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")
    first, later = events.filter("event_type = 'signup'"), events.filter("event_type <> 'signup'").select("event_id", "user_id", "ts")
    out = CH.as_of(later, first, "user_id", "ts", ("event_id", "value"), span=("minute", "hour", "day"))
    return out.select("event_id", F.col("base.event_id").alias("base_event"), r6("base.value", "base_value"))


@query(
    "p26_relative_change",
    f"WITH {PAIRS} SELECT subject, d, round({rel_sql('diameter')}, 6) AS diameter_change, round({rel_sql('a')}, 6) AS a_change FROM pairs",
)
def p26(spark, sf_dir):
    return pairs(spark, sf_dir).select(
        "subject", F.col("day").cast("string").alias("d"),
        r6(CH.relative_change("base_diameter", "diameter"), "diameter_change"),
        r6(CH.relative_change("base_a", "a"), "a_change"),
    )


@query(
    "p27_days_between",
    """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN NULL ELSE
 CASE WHEN date_diff('day', DATE '1995-06-17', CAST(o_orderdate AS DATE)) >= 0 THEN date_diff('day', DATE '1995-06-17', CAST(o_orderdate AS DATE)) END END AS INTEGER) AS days FROM orders""",
)
def p27(spark, sf_dir):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("o_orderkey")
    end = F.when(k % 7 == 0, F.lit("not a date")).when(k % 11 == 0, F.lit(None).cast("string")).otherwise(iso)
    orders = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return orders.select("o_orderkey", CH.days_between(F.lit("1995-06-17"), end).alias("days"))


@query(
    "p28_growth_per_month",
    f"""WITH {PAIRS} SELECT subject, d, round(CASE WHEN date_diff('day', base_day, day) > 0 AND base_diameter > 1e-6 THEN
 {rel_sql('diameter')} / (date_diff('day', base_day, day) / CAST(30.44 AS DOUBLE)) END, 6) AS growth FROM pairs""",
)
def p28(spark, sf_dir):
    return pairs(spark, sf_dir).select(
        "subject", F.col("day").cast("string").alias("d"),
        r6(
            CH.growth_per_month(
                CH.relative_change("base_diameter", "diameter"), CH.days_between("base_day", "day"),
                F.col("base_diameter"),
            ),
            "growth",
        ),
    )


@query(
    "x1_attribute_diff",
    f"""WITH {PAIRS} SELECT subject, d, array_to_string(list_sort(list_filter(colors, lambda x: NOT list_contains(base_colors, x))), ',') AS new,
 array_to_string(list_sort(list_filter(base_colors, lambda x: NOT list_contains(colors, x))), ',') AS lost FROM pairs""",
)
def x1(spark, sf_dir):
    new, lost = CH.attribute_diff("base_colors", "colors")
    return pairs(spark, sf_dir).select(
        "subject", F.col("day").cast("string").alias("d"), F.concat_ws(",", new).alias("new"),
        F.concat_ws(",", lost).alias("lost"),
    )


def metric_sql(column, label, threshold, differ):
    extra = f" AND {column} <> base_{column}" if differ else ""
    return f"""SELECT subject, d, {lit(label)} AS name, round(CAST(base_{column} AS DOUBLE), 6) AS baseline, round(CAST({column} AS DOUBLE), 6) AS followup,
 round({rel_sql(column)}, 6) AS relative_change, (abs({rel_sql(column)}) >= {threshold}{extra}) AS significant FROM pairs"""


METRIC_UNION = " UNION ALL ".join(metric_sql(c, n, t, x) for c, n, t, x, _ in CH.CHANGE_METRICS)
FIELD_SQL = f"""SELECT subject, d, {lit(CH.FIELD_METRIC[0])} AS name, round(base_diameter * 0.5, 6) AS baseline, round(diameter * 0.5, 6) AS followup,
 round({rel_sql('diameter')}, 6) AS relative_change, abs(diameter * 0.5 - base_diameter * 0.5) >= 1 AS significant FROM pairs"""
COLOR_SQL = f"""SELECT subject, d, {lit(CH.COLOR_DISTANCE[0])} AS name, CAST(0 AS DOUBLE) AS baseline, round(color_distance, 6) AS followup,
 round(color_distance, 6) AS relative_change, color_distance >= 0.35 AS significant FROM pairs"""


def _metrics(frame):
    return frame.select("subject", F.col("day").cast("string").alias("d"), F.explode("metrics").alias("m")).select(
        "subject", "d", "m.name", r6("m.baseline", "baseline"), r6("m.followup", "followup"),
        r6("m.relative_change", "relative_change"), "m.significant",
    )


@query("l1_change_metrics", f"WITH {PAIRS} {METRIC_UNION} UNION ALL {COLOR_SQL}")
def l1(spark, sf_dir):
    return _metrics(CH.change_metrics(pairs(spark, sf_dir)))


@query("l3_field_width", f"WITH {PAIRS} {METRIC_UNION} UNION ALL {COLOR_SQL} UNION ALL {FIELD_SQL}")
def l3(spark, sf_dir):
    return _metrics(CH.change_metrics(pairs(spark, sf_dir), field_mm=0.5))


SCORE = f"""{PAIRS}, sc0 AS (SELECT *, {rel_sql('diameter')} AS dc, {rel_sql('area')} AS ac,
  len(list_filter(colors, lambda x: NOT list_contains(base_colors, x))) AS nn FROM pairs),
sc AS (SELECT *, least(100, greatest(0, least(abs(dc) / CAST(0.5 AS DOUBLE), 1) * 28 + least(abs(ac) / CAST(0.8 AS DOUBLE), 1) * 18
  + least(abs(tds - base_tds) / 2, 1) * 22 + (1 - similarity) * 14 + least(color_distance / CAST(0.6 AS DOUBLE), 1) * 10
  + least(nn / CAST(2 AS DOUBLE), 1) * 8)) AS score FROM sc0),
sv AS (SELECT *, CASE WHEN score >= 55 THEN 'significant_change' WHEN score >= 28 THEN 'minor_change' ELSE 'stable' END AS verdict FROM sc)"""
ADVICE = "CASE verdict " + " ".join(f"WHEN {lit(v)} THEN {lit(t)}" for v, t in T.CHANGE_RECOMMENDATIONS.items()) + " END"


@query(
    "l2_change_score",
    f"WITH {SCORE} SELECT subject, d, round(score, 6) AS change_score, verdict, {ADVICE} AS recommendation FROM sv",
)
def l2(spark, sf_dir):
    return CH.change_report(pairs(spark, sf_dir), "day").select(
        "subject", F.col("day").cast("string").alias("d"), r6("change_score", "change_score"), "verdict",
        "recommendation",
    )


CAV = T.CHANGE_CAVEATS


@query(
    "l4_change_texts",
    f"""WITH {SCORE} SELECT subject, d, concat_ws('; ', printf('%s (%.0f/100)',
  CASE verdict WHEN 'significant_change' THEN 'Significant change' WHEN 'minor_change' THEN 'Minor change' ELSE 'Stable' END, score),
 CASE WHEN abs(dc) >= 0.05 THEN printf('%.0f%% %s in frame', abs(dc) * 100, CASE WHEN dc > 0 THEN 'larger' ELSE 'smaller' END) END,
 CASE WHEN nn > 0 THEN printf('%d new colour(s)', nn) END) AS headline,
 concat_ws(' | ', {lit(CAV['scale'])}, {lit(CAV['light'])}, {lit(CAV['no_field'])}, CASE WHEN NOT reliable THEN {lit(CAV['unreliable'])} END) AS caveats FROM sv""",
)
def l4(spark, sf_dir):
    return CH.change_report(pairs(spark, sf_dir), "day").select(
        "subject", F.col("day").cast("string").alias("d"), "headline", F.concat_ws(" | ", "caveats").alias("caveats")
    )
