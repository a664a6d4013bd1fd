from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tallyscope.llm import periods


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    """Every maximal stretch on every lag; those whose smallest period is the lag stay."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        at = 0
        while at < n - q:
            end = at
            while end < n - q and words[end] == words[end + q]:
                end += 1
            length = end - at + q
            if end > at and length >= max(6, 4 * q):
                part = words[at : at + length]
                if not any(all(part[i] == part[i + p] for i in range(length - p)) for p in range(1, q)):
                    found.append((at, length, q))
            at = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plant(doc_id, words: list) -> list:
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def want(doc_id, text) -> tuple:
    words = plant(doc_id, words_of(text))
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    told = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
    kept = hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, told, kept)


def string(draw: random.Random) -> list[int]:
    """Nested repeats of random pieces."""
    piece = [draw.randrange(3) for _ in range(draw.randrange(1, 5))]
    for _ in range(draw.randrange(1, 4)):
        piece = piece * draw.randrange(1, 6) + [draw.randrange(4) for _ in range(draw.randrange(0, 4))]
    return piece[:400]


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_every_lag(seed):
    draw = random.Random(seed)
    for _ in range(120):
        some = [string(draw) for _ in range(draw.randrange(1, 4))]
        marked = [x for k, s in enumerate(some) for x in [*s, -1 - k]]
        offset, expected = 0, []
        for s in some:
            expected += [(a + offset, n, q) for a, n, q in plain_runs(s)]
            offset += len(s) + 1
        assert periods.runs(np.array(marked, dtype=np.int64)) == sorted(expected, key=lambda r: (r[0], r[2]))


def test_two_letters_and_long_periods():
    draw = random.Random(9)
    for n in (37, 150, 301):
        base = [draw.randrange(2) for _ in range(n)]
        marked = np.array([*(base * 4), *base[: n // 2], -1], dtype=np.int64)
        assert periods.runs(marked) == plain_runs(marked[:-1].tolist())


def test_a_word_repeated_is_one_extension():
    marked = np.array([0] * 200_000 + [-1], dtype=np.int64)
    assert periods.runs(marked) == [(0, 200_000, 1)]


@pytest.mark.parametrize("held", [periods.BATCH_WORDS, 50])
def test_odd_rows_through_the_query(nasty, monkeypatch, held):
    monkeypatch.setattr(periods, "BATCH_WORDS", held)
    spark = nasty.sparkSession
    more = [(100 + i, "one two three " * (i % 9) + "end") for i in range(60)]
    # The two long rows are solved in their own test: brute force takes every lag.
    rows = nasty.filter("doc_id IS NULL OR doc_id NOT IN (5, 6)").select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    monkeypatch.setattr(periods, "documents", lambda *_: rows)
    got = sorted((tuple(r) for r in periods.op12(spark, "").collect()), key=repr)
    expected = sorted((want(r["doc_id"], r["text"]) for r in rows.collect()), key=repr)
    assert got == expected and any(r[1] for r in got if r[0] and r[0] >= 100)


def test_empty(empty):
    assert periods.periodic_runs(empty).collect() == []


def test_documents_at_small_scale(spark):
    """Every lag of every document of up to 600 words."""
    docs = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(words_of(r["text"])) <= 600]
    got = {r["doc_id"]: tuple(r) for r in periods.op12(spark, "/root/testdata/sf0.001").collect()}
    assert docs and all(got[r["doc_id"]] == want(r["doc_id"], r["text"]) for r in docs)
