from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyscope.llm import urls


def parts(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def want(url: str | None, rules: list[tuple]) -> tuple:
    host, path = parts(url)
    fits = [(h, p or "", a) for h, p, a in rules if h is not None and a is not None and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
    if not fits:
        return host, path, None, "allow"
    h, p, _ = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])))
    return host, path, h + p, "block" if any(r == (h, p, "block") for r in fits) else "allow"


def drawn(seed: int, n: int) -> tuple[list, list]:
    draw = random.Random(seed)
    labels = ["a", "b", "a-b", "c", "é", ""]
    host = lambda: ".".join(draw.choice(labels) for _ in range(draw.randrange(1, 5)))
    path = lambda: "".join(draw.choice(["/", "x", "y", "/x"]) for _ in range(draw.randrange(0, 5)))
    rules = [(host(), path(), draw.choice(["allow", "block"])) for _ in range(60)]
    pages = [(i, f"http{draw.choice(['', 's'])}://{host().upper() if draw.random() < 0.3 else host()}{path()}{draw.choice(['', '?q=a/b', '#t'])}") for i in range(n)]
    return rules + rules[:5] + [(rules[0][0], rules[0][1], "block"), (None, "/", "block"), ("a", None, "block"), ("b", "/", None)], pages


@pytest.mark.parametrize("tasks", ["1", "40"])
def test_against_every_rule(spark, tasks):
    rules, pages = drawn(3, 1500)
    pages += [(None, None), (7, "no scheme"), (7, "no scheme"), (8, "://"), (9, "x://a.b"), (10, "a://b://c/x"), (11, "x://" + "a." * 60 + "b/" + "x" * 20_000), (12, "")]
    pages += [(2000 + i, "http://b.a/x/x") for i in range(700)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        frame = spark.createDataFrame(pages, "page_id long, url string").withColumn("key", F.lit("x")).withColumn("part", F.lit(1))
        found = urls.judged(frame, spark.createDataFrame(rules, "host string, path string, action string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, found), key=key) == sorted(((i, *want(u, rules)) for i, u in pages), key=key)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame(urls.RULES, "host string, path string, action string")
    assert urls.judged(none, rules).collect() == []
    some = spark.createDataFrame([(1, "http://x.net/")], none.schema)
    assert [tuple(r) for r in urls.judged(some, rules.limit(0), default="block").collect()] == [(1, "x.net", "/", None, "block")]


def test_longest_of_nested_paths():
    own = urls.Paths("net.")
    for path in ("", "/a", "/a/b", "/ab", "/b"):
        own.add(path, "allow")
    assert [own.paths[own.longest(p)] for p in ("", "/", "/a/bc", "/ac", "/abc", "/c")] == ["", "", "/a/b", "/a", "/ab", ""]
