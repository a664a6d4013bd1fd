from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyscope.llm import merkle


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def told(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(leaves: list[str]) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        own = levels[-1]
        levels.append([sha("".join(own[i : i + 3])) for i in range(0, len(own), 3)])
    return levels


def walk(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    steps = []
    for own in levels[:-1]:
        first = at // 3 * 3
        steps.append(("".join(own[first:at]), "".join(own[at + 1 : first + 3])))
        at //= 3
    return steps


def want(rows) -> list[tuple]:
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(("".join(told(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")), r))
    trees = {}
    for source, own in groups.items():
        own.sort(key=lambda x: (x[1]["doc_id"] is not None, x[1]["doc_id"] or 0, sha(x[0])))
        trees[source] = levels_of([sha(x[0]) for x in own])
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    top = levels_of([trees[s][-1][0] for s in names])
    out = []
    for place, source in enumerate(names):
        for at, (full, r) in enumerate(groups[source]):
            steps = walk(trees[source], at) + walk(top, place)
            shown = full
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                shown = "".join(told(r[c]) for c in ("doc_id", "source", "lang", "n_chars")) + told(None if r["text"] is None else r["text"].replace("\n", ""))
            at_root = sha(shown)
            for before, after in steps:
                at_root = sha(before + at_root + after)
            out.append((r["doc_id"], sha(full), trees[source][-1][0], top[-1][0], sha("".join(b + a for b, a in steps)), at_root, at_root == top[-1][0]))
    return sorted(out, key=repr)


def found(monkeypatch, frame, levels: int) -> list[tuple]:
    monkeypatch.setattr(merkle, "documents", lambda *_: frame)
    plain = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda *a: plain(*a, levels=levels))
    return sorted((tuple(r) for r in merkle.op11(frame.sparkSession, "").collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 7])
def test_odd_rows_against_plain_trees(nasty, monkeypatch, levels):
    assert found(monkeypatch, nasty, levels) == want(nasty.collect())


def test_one_series_over_many_blocks(spark, monkeypatch):
    frame = spark.range(700).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("s"), (F.col("id") % 11).cast("string"))).otherwise(F.lit("big")).alias("source"),
        F.lit("en").alias("lang"), F.lit(3).cast("long").alias("n_chars"), F.concat(F.lit("a\n"), F.col("id").cast("string")).alias("text"),
    )
    got = found(monkeypatch, frame.repartition(13), 2)
    assert got == want(frame.collect()) and sum(r[-1] for r in got) not in (0, 700)


def test_empty(empty):
    assert merkle.manifest(empty, "source", "doc_id", merkle.leaf_digest(F.col("text"))).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27])
def test_witnesses_grow_with_later_siblings(n):
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    block = merkle.Block(3, merkle.height_of(n, 3, 9))
    for leaf in leaves:
        block.append(leaf)
    root = block.close()
    levels = levels_of([x.hex() for x in leaves])
    assert root.hex() == levels[-1][0]
    assert [[(b.hex(), a.hex()) for b, a in w] for w in block.witness] == [walk(levels, i) for i in range(n)]
