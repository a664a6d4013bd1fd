"""URL filters: host and path rules joined to URLs by a sorted sweep.

A rule names a host and the start of a path; it fits the host itself and all its
subdomains. Written with its labels in reverse, each closed by a dot, a host is a key whose
subdomains are exactly the keys that start with it: a rule's host is an interval of keys,
and such intervals nest or are apart.

1. Rules and URLs share one order by range (key, path, id), so a host, or a single URL, that
   a third of all rows have is spread over tasks. No text but the URL's host and path moves.
2. The rules that began before a task's range and still cover its first key have one of that
   key's label prefixes as key: they are found by an equi-join on those few prefixes of one
   key per task, and given to that task.
3. Each task sweeps its rows in order with a stack of open hosts. A host is popped when a key
   does not start with it; a URL asks each host on the stack (at most one per label) for its
   longest fitting path, by bisection and the chain of prefixes among that host's paths.

The longest fitting rule (characters of host and path) wins; of two of one length the one with
the longer host. A task holds the rules of the hosts on its stack only.

Results by case: a null URL, or one without "://", has an empty host and path, which only a
rule of the empty host can fit; without a fitting rule the default verdict holds, so without
rules all URLs get it; a host's case is that of A-Z lowered, ports and user names are part of
it; rules with null host or action are no rules, a null path is the empty one; of rules with
one host and path and different verdicts `block` holds; null ids and repeated rows are judged
each; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.session import stored

from .common import clean_rows, query

ALLOW, BLOCK = "allow", "block"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(host: Column) -> Column:
    return F.translate(host, _UPPER, _UPPER.lower())


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased."""
    return F.coalesce(lowered(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, each closed by a dot: a host's subdomains start with its key."""
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), "."), F.lit("."))


def prefixes(key: Column) -> Column:
    """The keys of a key's host and of all hosts above it."""
    labels = F.slice(F.split(key, "[.]"), 1, F.size(F.split(key, "[.]")) - 1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))


class Paths:
    """The paths of one host's rules, each with the longest other one that it starts with."""

    __slots__ = ("actions", "above", "key", "paths")

    def __init__(self, key: str):
        self.key, self.paths, self.above, self.actions = key, [], [], []

    def add(self, path: str, action: str) -> None:
        """Paths come in order; a repeated one is blocked if either rule blocks."""
        if self.paths and self.paths[-1] == path:
            if action == BLOCK:
                self.actions[-1] = BLOCK
            return
        at = len(self.paths) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.above[at]
        self.paths.append(path)
        self.above.append(at)
        self.actions.append(action)

    def longest(self, path: str) -> int:
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.above[at]
        return at


class Sweep:
    """Reads rules and URLs in the order of (key, rules first, path)."""

    def __init__(self):
        self.open: list[Paths] = []

    def _close(self, key: str) -> None:
        while self.open and not key.startswith(self.open[-1].key):
            self.open.pop()

    def rule(self, key: str, path: str, action: str) -> None:
        self._close(key)
        if not self.open or self.open[-1].key != key:
            self.open.append(Paths(key))
        self.open[-1].add(path, action)

    def judge(self, key: str, path: str) -> tuple[str, str, str] | None:
        """Key, path and action of the longest rule that fits."""
        self._close(key)
        best = None
        for host in self.open:
            at = host.longest(path)
            # Hosts on the stack grow longer, so an equal length is won by the longer host.
            if at >= 0 and (best is None or len(host.key) + len(host.paths[at]) >= len(best[0]) + len(best[1])):
                best = (host.key, host.paths[at], host.actions[at])
        return best


def _host(key: str) -> str:
    return ".".join(reversed(key[:-1].split(".")))


def judged(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """One row per page: its id as `page_id`, host, path, rule (host and path; null without one), verdict.

    rules: host, path, action (allow or block).
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    urls = pages.select(host_key(host).alias("key"), F.lit(1).alias("kind"), path.alias("path"), F.col(id_col).alias("page_id"), F.lit(None).cast("string").alias("action"))
    kind = urls.schema["page_id"].dataType.simpleString()
    known = rules.filter("host IS NOT NULL AND action IS NOT NULL").select(
        host_key(lowered(F.col("host"))).alias("key"),
        F.lit(0).alias("kind"),
        F.coalesce(F.col("path"), F.lit("")).alias("path"),
        F.lit(None).cast(kind).alias("page_id"),
        F.col("action").cast("string").alias("action"),
    )
    ranged = urls.unionByName(known).repartitionByRange("key", "kind", "path", "page_id")
    dealt = stored(ranged.withColumn("part", F.spark_partition_id()), "urls")
    # One key per task, and its few prefixes.
    firsts = dealt.groupBy("part").agg(F.min("key").alias("first")).select("part", F.explode(prefixes(F.col("first"))).alias("key"))
    covering = firsts.join(known, "key").select(*dealt.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, current, asked = Sweep(), None, None
        for batch in clean_rows(batches, 8192):
            parts, keys, kinds, paths, actions = (batch.column(n).to_pylist() for n in ("part", "key", "kind", "path", "action"))
            rows, out = [], []
            for row, (part, key, is_url, path, action) in enumerate(zip(parts, keys, kinds, paths, actions, strict=True)):
                if part != current:
                    sweep, current, asked = Sweep(), part, None
                if not is_url:
                    sweep.rule(key, path, action)
                    asked = None
                    continue
                if asked != (key, path):
                    best, asked = sweep.judge(key, path), (key, path)
                    found = (_host(key), path, None if best is None else _host(best[0]) + best[1], default if best is None else best[2])
                rows.append(row)
                out.append(found)
            if rows:
                columns = [pa.array(c, pa.string()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("page_id").take(pa.array(rows)), *columns], names=["page_id", "host", "path", "rule", "verdict"])

    order = ["part", "key", "kind", "path"]
    swept = dealt.unionByName(covering).repartition("part").sortWithinPartitions(*order)
    return swept.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


# Fixed values of the contract: host, path, action.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

SQL = """
WITH parts AS (
    SELECT page_id,
           coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), rules(rule_host, rule_path, action) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), urls AS (
    SELECT DISTINCT host, path FROM parts
), found AS (
    SELECT host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
           max_by(action, length(rule_host || rule_path)) AS verdict
    FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY host, path
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN found USING (host, path)
"""


@query("op13_url_filters", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)
