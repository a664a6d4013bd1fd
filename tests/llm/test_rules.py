from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyscope.llm import rules
from tallyscope.llm.features import SHARE_NAMES, shares

NAMES = [*SHARE_NAMES, "repeat_share"]


def brute(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    repeated = {p + i for p, w in enumerate(windows) if counts[w] > 1 for i in range(3)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated),
        len(words) < 50 or 100 * len(repeated) > 50 * len(words),
    )


def check(counts, docs):
    got = sorted(map(str, ((r["doc_id"], *[r[c] for c in rules.COUNTS], r["base_failed"]) for r in counts)))
    assert got == sorted(map(str, ((r["doc_id"], *brute(r["text"])) for r in docs)))


def test_query_counts(spark, sf_dir, documents):
    rows = rules.op5(spark, sf_dir).collect()
    check(rows, documents.collect())
    assert all(not (r["base_failed"] and r["kept"]) for r in rows)


def test_odd_rows(nasty, empty, labels):
    counts = rules.statistics(nasty)
    check(counts.collect(), nasty.collect())
    assert rules.statistics(empty).collect() == []
    learned = rules.learn(rules.statistics(empty).withColumn("bad", F.lit(True)), NAMES)
    assert learned.rules == []
    assert [r["kept"] for r in rules.judged(counts, learned).collect()] == [not r["base_failed"] for r in counts.collect()]


def test_share_names(spark):
    assert tuple(shares()) == SHARE_NAMES


def test_no_python_on_the_way(spark, sf_dir):
    plan = rules.op5(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.fixture(scope="module")
def planted(spark):
    """Bad rows: symbol_share above 0.3, or few distinct words in many words; others are good."""
    base = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        *[(F.pmod(F.xxhash64(F.lit(n), "id"), F.lit(1000)) / 1000.0).alias(n) for n in NAMES],
    )
    bad = (F.col("symbol_share") > 0.9) | ((F.col("distinct_share") <= 0.2) & (F.col("words") > 0.7))
    return base.withColumn("bad", bad).cache()


def test_planted_rules_are_found(planted):
    learned = rules.learn(planted, NAMES)
    judged = planted.withColumn("rejected", learned.rejects())
    wrong = judged.filter("rejected <> bad").count()
    assert wrong < 0.05 * planted.count()
    used = {c.statistic for rule in learned.rules for c in rule}
    assert used <= {"symbol_share", "distinct_share", "words"}
    assert str(learned).endswith("else keep")


def test_learning_reads_a_bounded_sample(planted):
    learned = rules.learn(planted, NAMES, most_rows=1000)
    assert 0 < len(learned.rules) <= 8 and all(len(rule) <= 3 for rule in learned.rules)
