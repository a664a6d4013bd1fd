"""Case log semantics, paging, statistics; change between captures; streams."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tallyscope.operators import cases as C
from tallyscope.operators import change as CH
from tallyscope.sources import bindings as B


def case(spark, *rows):
    return spark.createDataFrame(
        [(i, s, datetime(2025, 1, 1) + timedelta(hours=s), "nv", "Nevus", 0.5, t, 10.0, t in ("HIGH", "CRITICAL"))
         for i, s, t in rows],
        "id STRING, seq BIGINT, created_at TIMESTAMP, top_code STRING, top_name STRING, confidence DOUBLE, "
        "tier STRING, severity_score DOUBLE, requires_review BOOLEAN",
    )


def test_upsert_is_idempotent_and_loses_earlier_notes(spark):
    log = C.append_upserts(None, case(spark, ("a", 1, "LOW"), ("b", 2, "HIGH")))
    log = C.append_note(log, "a", 3, "seen")
    assert {r["id"]: r["notes"] for r in C.current(log).collect()} == {"a": "seen", "b": None}
    log = C.append_upserts(log, case(spark, ("a", 4, "HIGH")))
    a = C.get(log, "a").collect()
    assert len(a) == 1 and a[0]["tier"] == "HIGH" and a[0]["notes"] is None
    assert C.current(log.unionByName(log)).count() == 2  # a replayed log changes nothing


def test_notes_clear_and_deletes(spark):
    log = C.append_upserts(None, case(spark, ("a", 1, "LOW"), ("b", 2, "HIGH")))
    log = C.append_note(C.append_note(log, "a", 3, "x"), "a", 4, None)
    assert C.get(log, "a").first()["notes"] is None
    ids = spark.createDataFrame([("a",), ("zz",)], "id STRING")
    assert {r["id"]: r["found"] for r in C.matched(log, ids).collect()} == {"a": True, "zz": False}
    gone = C.append_delete(log, ids.withColumn("seq", F.lit(9).cast("long")))
    assert [r["id"] for r in C.current(gone).collect()] == ["b"]
    assert not C.matched(gone, ids).filter("found").count()  # a second delete finds nothing
    back = C.append_upserts(gone, case(spark, ("a", 10, "LOW")))
    assert C.current(back).count() == 2
    assert C.current(C.clear(back, 99)).count() == 0


def test_filters_and_pages(spark):
    log = C.append_upserts(None, case(spark, *[(f"c{i:02d}", i, "HIGH" if i % 2 else "LOW") for i in range(20)]))
    now = C.current(log)
    page = C.list_cases(C.filter_cases(now, tier="HIGH", review_only=True), limit=3, offset=2).collect()
    assert [r["id"] for r in page] == ["c15", "c13", "c11"] and page[0]["total"] == 10
    assert C.list_cases(now, limit=0).count() == 1 and C.list_cases(now, limit=999, offset=-5).count() == 20
    first = C.page_after(now, None, 5).collect()
    second = C.page_after(now, (first[-1]["created_at"], first[-1]["id"]), 5).collect()
    assert [r["id"] for r in second] == [f"c{i:02d}" for i in (14, 13, 12, 11, 10)]
    with pytest.raises(ValueError):
        C.filter_cases(now, tier="NOPE")
    with pytest.raises(ValueError):
        C.filter_cases(now, code="nope")


def test_stats_of_nothing_are_zero(spark):
    s = C.case_stats(C.current(C.append_upserts(None, case(spark).limit(0)))).first()
    assert (s["total"], s["flagged_for_review"], s["mean_confidence"], s["first_case"]) == (0, 0, 0.0, None)


def test_stored_log_and_compaction(spark, tmp_path):
    path, small = str(tmp_path / "log"), str(tmp_path / "small")
    log = C.append_upserts(None, case(spark, ("a", 1, "LOW"), ("b", 2, "HIGH")))
    C.write_log(log, path)
    C.write_log(C.append_note(log.limit(0), "b", 5, "kept"), path)
    C.compact(C.read_log(spark, path), small)
    got = {r["id"]: r["notes"] for r in C.current(C.read_log(spark, small)).collect()}
    assert got == {"a": None, "b": "kept"}


def test_flatten_defaults(spark):
    empty = spark.createDataFrame([("x", "2025-01-01T00:00:00", None)] , "case_id STRING, created_at STRING, filename STRING")
    nested = empty.select(F.from_json(F.to_json(F.struct("*")), C.RESULT_SCHEMA).alias("r")).select("r.*")
    r = C.attach_thumbnail(C.flatten_result(nested)).first()
    assert (r["top_code"], r["confidence"], r["tier"], r["tds"], r["requires_review"], r["images"]) == (
        "unknown", 0.0, "INDETERMINATE", None, False, {},
    )


# ---------------------------------------------------------------------- change


def captures(spark, rows):
    return spark.createDataFrame(
        rows,
        "subject STRING, day DATE, diameter DOUBLE, area DOUBLE, tds DOUBLE, a INT, b INT, c INT, "
        "color_variance DOUBLE, colors ARRAY<STRING>",
    )


MEASURES = ("diameter", "area", "tds", "a", "b", "c", "color_variance", "colors")


def report(spark, rows, **kw):
    return CH.change_report(CH.capture_pairs(captures(spark, rows), "subject", "day", MEASURES), "day", **kw)


def test_identical_captures_are_stable(spark):
    from datetime import date

    one = (0.2, 0.05, 4.0, 1, 2, 3, 10.0, ["red"])
    r = report(spark, [("s", date(2025, 1, 1), *one), ("s", date(2025, 4, 1), *one)]).first()
    assert r["verdict"] == "stable" and r["change_score"] < 20 and r["days"] == 90
    assert not any(m["significant"] for m in r["metrics"]) and r["growth_per_month"] == 0.0


def test_growth_is_detected_and_converted(spark):
    from datetime import date

    r = report(
        spark,
        [("s", date(2025, 1, 1), 0.15, 0.02, 3.0, 0, 1, 2, 5.0, ["red"]),
         ("s", date(2025, 4, 1), 0.34, 0.09, 5.5, 1, 3, 4, 9.0, ["red", "black", "white"])],
        field_mm=20.0,
    ).first()
    assert r["verdict"] == "significant_change" and r["new_colors"] == ["black", "white"]
    assert r["metrics"][0]["name"].startswith("Diameter (mm") and r["metrics"][0]["significant"]
    assert r["growth_per_month"] == pytest.approx((0.34 - 0.15) / 0.15 / (90 / 30.44))
    assert "127% larger in frame" in r["headline"] and "2 new colour(s)" in r["headline"]


def test_relative_change_and_days(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 2.0), (2.0, 1.0), (-2.0, -1.0)], "b DOUBLE, f DOUBLE")
    assert [r[0] for r in df.select(CH.relative_change("b", "f")).collect()] == [0.0, 1.0, -0.5, 0.5]
    dates = spark.createDataFrame(
        [("2025-01-01", "2025-04-01T10:00:00"), ("2025-04-01", "2025-01-01"), ("x", "2025-01-01"), (None, "2025-01-01"), ("", "2025-01-01")],
        "a STRING, b STRING",
    )
    assert [r[0] for r in dates.select(CH.days_between("a", "b")).collect()] == [90, None, None, None, None]


def test_spans_do_not_change_the_previous_capture(spark):
    """One subject owns most captures, with long gaps between some of its spans."""
    rows = [("hot", datetime(2025, 1, 1) + timedelta(hours=7 * i + (i // 20) * 400), i) for i in range(120)]
    rows += [("cold", datetime(2025, 3, 1), 1000), ("cold", datetime(2025, 9, 1), 1001)]
    df = spark.createDataFrame(rows, "subject STRING, ts TIMESTAMP, v INT")
    plain = CH.previous_capture(df, "subject", "ts", ["v"]).select("v", "prev.v").collect()
    nested = CH.previous_capture(df, "subject", "ts", ["v"], span=("minute", "hour", "day")).select("v", "prev.v").collect()
    assert sorted(map(str, nested)) == sorted(map(str, CH.previous_capture(df, "subject", "ts", ["v"]).select("v", "prev.v").collect()))
    spans = CH.previous_capture(df, "subject", "ts", ["v"], span="day").select("v", "prev.v").collect()
    assert sorted(map(tuple, plain), key=str) == sorted(map(tuple, spans), key=str)


def test_records_delivered_twice_and_notes_after_compaction(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "id STRING, seq BIGINT")
    log = C.append_upserts(C.append_upserts(None, rows), rows)
    log = C.append_note(C.append_note(log, "a", 3, "first"), "a", 5, "second")
    C.compact(log, str(tmp_path / "log"))
    fresh = C.read_log(spark, str(tmp_path / "log"))
    later = C.append_note(fresh, "a", 4, "between")
    for state in (log, fresh, later):
        assert {r["id"]: (r["seq"], r["notes"]) for r in C.current(state).collect()} == {"a": (1, "second"), "b": (1, None)}
    plan = C.current(fresh)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    with pytest.raises(AnalysisException):
        C.compact(log, str(tmp_path / "log"))


def test_as_of_over_a_subject_that_holds_a_third(spark):
    import random
    from datetime import datetime, timedelta

    draw = random.Random(5)
    start = datetime(2024, 3, 1)

    def rows(n, salt):
        out = []
        for i in range(n):
            subject = draw.choice([None, "s1", "s2", "hot", "hot", "hot"])
            out.append((salt + i, subject, None if draw.random() < 0.03 else start + timedelta(seconds=draw.randrange(0, 400_000, 7)), draw.choice([None, draw.random()])))
        return out

    left, right = rows(400, 0), rows(300, 1000)
    right += [(5000, "hot", left[0][2] or start, 1.0), (5001, "hot", left[0][2] or start, 2.0)]
    schema = "k long, who string, at timestamp, v double"
    later, first = spark.createDataFrame(left, schema).withColumn("base_k", F.lit(1)), spark.createDataFrame(right, schema)
    for strict in (False, True):
        want = {}
        for k, who, at, _ in left:
            known = [r for r in right if at is not None and r[2] is not None and r[1] == who and (r[2] < at or not strict and r[2] == at)]
            best = max(known, key=lambda r: (r[2], r[0])) if known else None
            want[k] = best and best[0]
        for span in ((), ("minute", "hour", "day")):
            got = {r["k"]: r["base"] and r["base"]["k"] for r in CH.as_of(later, first, "who", "at", ("k", "v"), span, strict).collect()}
            assert got == want, (strict, span)


def test_pages_at_any_depth(spark):
    rows = spark.range(3000).selectExpr(
        "CAST(id * 7919 % 3001 AS STRING) AS id", "CASE WHEN id % 3 = 0 THEN timestamp'2025-01-01 10:00:00' WHEN id % 97 = 0 THEN NULL ELSE timestamp'2025-01-01' + make_dt_interval(0, 0, id * 13) END AS created_at",
    ).repartition(5).cache()
    whole = [tuple(r) for r in rows.orderBy(F.desc("created_at"), F.desc("id")).collect()]
    for offset, limit in ((0, 1), (49, 50), (1900, 200), (2950, 200), (2999, 1), (3000, 5)):
        page = C.list_cases(rows, limit, offset).collect()
        assert [tuple(r)[:2] for r in page] == whole[offset : offset + limit] and {r["total"] for r in page} <= {3000}
    assert C.list_cases(rows.limit(0)).collect() == []


def test_captures_add_up_in_event_order(spark, tmp_path):
    """Bitwise the sums of a plain loop by event_id, in whatever order rows are stored or tasks end."""
    values = [0.1, 0.2, 0.3, 1e16, 1.0, None, 1.0, 0.7]
    rows = [(i, datetime(2024, 1, 1, 12), 5, "view", v) for i, v in enumerate(values)] + [(90, datetime(2024, 1, 2), 5, "view", None)]
    kinds = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE"
    for row in reversed(rows):
        spark.createDataFrame([row], kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    first, empty = B.captures(spark, str(tmp_path)).orderBy("day").collect()
    n, total, mean, square = 0, 0.0, 0.0, 0.0
    for v in (v for v in values if v is not None):
        n, total, before, mean = n + 1, total + v, mean, mean + (v - mean) / (n + 1)
        square += (v - mean) * (v - before)
    assert (first["area"], first["diameter"], first["color_variance"]) == (total, total / n, (square / n) ** 0.5)
    assert first["b"] == 8 and (empty["area"], empty["diameter"], empty["color_variance"], empty["b"]) == (None, None, 0.0, 1)
