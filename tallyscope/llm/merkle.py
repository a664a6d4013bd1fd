"""Merkle manifest: a hash tree per series, a tree over the series, and a witness for every leaf.

Leaves of a series are ordered; every `arity` neighbours become one node until one is left,
and the roots of the series become the leaves of a last tree. A leaf's witness has one step
per level, the digests before and after its own in its run, so it can be checked against the
root alone.

1. Leaves are dealt out by range of (series, order); a leaf's number in its series is its place
   in its task's range plus the count of that series in the ranges before, so a series that
   holds a third of all rows is spread over tasks.
2. `arity` ** `levels` aligned leaves make a block, solved by one task that reads it as a stream
   of appends. Completed subtrees of one height wait for their siblings; when a run is complete
   (or the series ends) each member's leaves get the others' digests as their next step.
3. Block roots are appends to the next round: the same job over far fewer rows, until every
   series has one node. Steps of the upper rounds are attached to block roots and come down
   to the leaves by block number, so no key is hot.

The driver learns one number per round, the greatest count of a series.

Results by case: nulls are hashed as `-`, and null series and orders come first; an empty text
differs from a null one; texts of any length are hashed in the JVM; rows of one order are
ordered by their leaf, and equal leaves are interchangeable; repeated rows are leaves of their
own; a lone leaf or series is its root, with no step; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscope.session import stored

from .common import documents, query

# Fixed value of the contract: how many neighbours make a node.
ARITY = 3
# Levels that one block has: 3^7 leaves.
LEVELS = 7

_STEPS = "array<struct<before:binary,after:binary>>"


def leaf_digest(*columns: Column) -> Column:
    """Lowercase hex SHA-256 of the values, each as `-` or its UTF-8 length, ":" and itself."""

    def told(column: Column) -> Column:
        value = column.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(told, columns)).cast("binary"), 256)


def _hexed(column: Column) -> Column:
    return F.lower(F.hex(column))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf (hex) and its witness lead to."""
    return F.aggregate(steps, leaf, lambda at, s: F.sha2(F.concat(_hexed(s["before"]), at, _hexed(s["after"])).cast("binary"), 256))


def siblings(steps: Column) -> Column:
    """All digests of a witness (hex), level by level, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(_hexed(s["before"]), _hexed(s["after"]))), "")


def parent(digests: list[bytes]) -> bytes:
    """Digest over the hex forms of its children."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


class Block:
    """Appends to one aligned block, with a witness per leaf that grows as siblings complete."""

    def __init__(self, arity: int, height: int):
        self.arity, self.height = arity, height
        self.waiting: list[list[tuple[bytes, int, int]]] = [[] for _ in range(height + 1)]  # (digest, first leaf, end)
        self.witness: list[list[tuple[bytes, bytes]]] = []

    def append(self, digest: bytes) -> None:
        self.witness.append([])
        self.waiting[0].append((digest, len(self.witness) - 1, len(self.witness)))
        level = 0
        while level < self.height and len(self.waiting[level]) == self.arity:
            self._join(level)
            level += 1

    def _join(self, level: int) -> None:
        """The waiting subtrees of a level become one of the next."""
        run = self.waiting[level]
        digests = [d for d, _, _ in run]
        for place, (_, first, end) in enumerate(run):
            step = (b"".join(digests[:place]), b"".join(digests[place + 1 :]))
            for leaf in range(first, end):
                self.witness[leaf].append(step)
        self.waiting[level + 1].append((parent(digests), run[0][1], run[-1][2]))
        self.waiting[level] = []

    def close(self) -> bytes:
        """The root at the block's height; open runs end with fewer members."""
        for level in range(self.height):
            if self.waiting[level]:
                self._join(level)
        return self.waiting[self.height][0][0]


def height_of(count: int, arity: int, most: int) -> int:
    """Levels above a series of `count` leaves inside one block, `most` if it has several blocks."""
    levels = 0
    while count > 1 and levels < most:
        count = -(-count // arity)
        levels += 1
    return levels


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes (series, ..., order columns) with `number` within the series and its `total`."""
    ranged = nodes.repartitionByRange("series", *order).sortWithinPartitions("series", *order)
    dealt = stored(ranged.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "nodes")
    counts = dealt.groupBy("series", "part").agg(F.count("*").alias("held"), F.min("place").alias("first"))
    before = Window.partitionBy("series").orderBy("part")
    starts = counts.select(
        F.col("series").alias("_series"),
        F.col("part").alias("_part"),
        (F.sum("held").over(before) - F.col("held") - F.col("first")).alias("shift"),
        F.sum("held").over(Window.partitionBy("series")).alias("total"),
    )
    same = (F.col("part") == F.col("_part")) & F.col("series").eqNullSafe(F.col("_series"))
    return dealt.join(starts, same).select(*nodes.columns, (F.col("place") + F.col("shift")).alias("number"), "total")


def _blocks(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """nodes (series, number, total, digest, ...): each with its block, the block's root and its steps up to it."""
    size = arity**levels
    keyed = nodes.withColumn("block", F.expr(f"number div {size}"))
    kind = {f.name: f.dataType.simpleString() for f in keyed.schema}
    step = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))

    def solved(table: pa.Table) -> pa.Table:
        total = table.column("total")[0].as_py()
        block = Block(arity, height_of(total, arity, levels))
        for digest in table.column("digest").to_pylist():
            block.append(digest)
        root = block.close()
        steps = [[{"before": b, "after": a} for b, a in w] for w in block.witness]
        return table.append_column("root", pa.array([root] * table.num_rows, pa.binary())).append_column("steps", pa.array(steps, step))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                yield from solved(pa.Table.from_batches(held)).combine_chunks().to_batches(max_chunksize=4096)

        for batch in batches:
            keys = list(zip(batch.column("series").to_pylist(), batch.column("block").to_pylist(), strict=True))
            begin = 0
            for at in range(1, len(keys) + 1):
                if at == len(keys) or keys[at] != keys[begin]:
                    if keys[begin] != current:
                        yield from close()
                        held, current = [], keys[begin]
                    held.append(batch.slice(begin, at - begin))
                    begin = at
        yield from close()

    dealt = keyed.repartition("series", "block").sortWithinPartitions("series", "block", "number")
    columns = ", ".join(f"`{n}` {k}" for n, k in kind.items())
    return dealt.mapInArrow(run, f"{columns}, root binary, steps {_STEPS}")


def tree(nodes: DataFrame, order: list[str], arity: int = ARITY, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """nodes (series, digest, order columns, ...) with `steps` up to the root of their series, and (series, root)."""
    rounds = [stored(_blocks(numbered(nodes, order), arity, levels), "blocks")]
    while (most := rounds[-1].agg(F.max("total")).first()[0]) is not None and most > arity**levels:
        # One row stands for its block: the roots are appends to the next round.
        roots = rounds[-1].filter(F.col("number") % F.lit(arity**levels) == 0)
        above = roots.select("series", F.col("root").alias("digest"), F.col("block").alias("number"), F.expr(f"(total + {arity**levels - 1}) div {arity**levels}").alias("total"))
        rounds.append(stored(_blocks(above, arity, levels), "blocks"))
    tops = rounds[-1].filter("number = 0").select("series", "root")

    def under(upper: DataFrame, lower: DataFrame) -> DataFrame:
        """The steps of a block root follow those of its members."""
        given = upper.select(F.col("series").alias("_series"), F.col("number").alias("_number"), F.col("steps").alias("_steps"))
        same = (F.col("block") == F.col("_number")) & F.col("series").eqNullSafe(F.col("_series"))
        return lower.join(given, same).withColumn("steps", F.concat("steps", "_steps")).drop("_series", "_number", "_steps")

    return reduce(under, reversed(rounds[:-1]), rounds[-1]), tops


def manifest(docs: DataFrame, series_col: str, order_col: str, leaf: Column, extra: dict[str, Column] | None = None, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """One row per row of docs: doc_id (order_col), series, leaf, subroot, root (hex), steps (the
    witness up to root), and the columns of `extra`.

    leaf: hex digest of a row, see `leaf_digest`.
    """
    own = {f"x_{n}": c for n, c in (extra or {}).items()}
    leaves = docs.select(
        F.col(series_col).cast("string").alias("series"), F.col(order_col).alias("doc_id"), F.unhex(leaf).alias("digest"), *(c.alias(n) for n, c in own.items())
    )
    rows, subroots = tree(leaves, ["doc_id", "digest"], arity, levels)
    subroots = stored(subroots, "subroots")
    # The subroots are the leaves of one more series, ordered by their own.
    named = subroots.select(F.lit("").alias("series"), F.col("series").alias("name"), F.col("root").alias("digest"))
    above, top = tree(named, ["name"], arity, levels)
    given = above.select(F.col("name").alias("_name"), F.col("digest").alias("_subroot"), F.col("steps").alias("_steps"))
    root = top.select(F.col("root").alias("_root"))
    # Both are small unless series are many; a series of many rows is split by the join itself.
    joined = rows.join(given, F.col("series").eqNullSafe(F.col("_name")))
    return joined.select(
        "doc_id",
        "series",
        _hexed(F.col("digest")).alias("leaf"),
        _hexed(F.col("_subroot")).alias("subroot"),
        _hexed(root.scalar()).alias("root"),
        F.concat("steps", "_steps").alias("steps"),
        *(F.col(n).alias(n[2:]) for n in own),
    )


SQL = """
WITH RECURSIVE sealed AS (
    SELECT doc_id, source,
           -- CRC-32 of the decimal doc_id, bit by bit: a byte is taken in, then eight shifts follow.
           xor(4294967295, list_reduce(
               [4294967295::BIGINT] || flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1),
                   lambda i: [ord(substr(doc_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
               lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc,
           coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
               || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
           text, replace(text, chr(10), '') AS cut
    FROM documents
), leaves AS (
    SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           CASE WHEN crc % 2 = 0 THEN sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS shown
    FROM sealed
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves
), nodes AS (
    SELECT source, 0 AS lvl, i, leaf AS h, n FROM placed
    UNION ALL
    SELECT source, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY source, lvl, i // 3
), subroots AS (
    SELECT source, h AS subroot, lvl AS depth FROM nodes WHERE n = 1
), named AS (
    SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM subroots
), tops AS (
    SELECT 0 AS lvl, i, subroot AS h, n FROM named
    UNION ALL
    SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM tops WHERE n > 1 GROUP BY lvl, i // 3
), steps AS (
    SELECT a.source, a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
    FROM nodes a JOIN nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.source, a.lvl, a.i
), top_steps AS (
    SELECT a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
    FROM tops a JOIN tops b ON a.lvl = b.lvl AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.lvl, a.i
), walk AS (
    SELECT row_number() OVER () AS k, doc_id, source, leaf, 0 AS lvl, i, shown AS h, '' AS seen FROM placed
    UNION ALL
    SELECT k, doc_id, w.source, leaf, w.lvl + 1, w.i // 3, sha256(before || h || after), seen || before || after
    FROM walk w JOIN steps s ON w.source IS NOT DISTINCT FROM s.source AND w.lvl = s.lvl AND w.i = s.i
), landed AS (
    SELECT k, doc_id, leaf, subroot, n.i, h, seen FROM walk w JOIN named n ON w.source IS NOT DISTINCT FROM n.source AND w.lvl = n.depth
), climb AS (
    SELECT k, doc_id, leaf, subroot, 0 AS lvl, i, h, seen FROM landed
    UNION ALL
    SELECT k, doc_id, leaf, subroot, c.lvl + 1, c.i // 3, sha256(before || h || after), seen || before || after FROM climb c JOIN top_steps s ON c.lvl = s.lvl AND c.i = s.i
)
SELECT doc_id, leaf, subroot, t.h AS root, sha256(seen) AS proof_sha256, c.h AS folded_root, c.h = t.h AS verified
FROM climb c JOIN (SELECT h, lvl FROM tops WHERE n = 1) t ON c.lvl = t.lvl
"""


@query("op11_merkle_manifest", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    told = leaf_digest(*head, F.col("text"))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    shown = F.when(tampered, leaf_digest(*head, F.replace(F.col("text"), F.lit("\n"), F.lit("")))).otherwise(told)
    made = manifest(documents(spark, sf_dir), "source", "doc_id", told, {"shown": F.unhex(shown)})
    return made.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(siblings(F.col("steps")).cast("binary"), 256).alias("proof_sha256"),
        folded(_hexed(F.col("shown")), F.col("steps")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
