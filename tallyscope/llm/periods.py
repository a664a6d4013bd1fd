"""Periodic runs of words: seeds on diagonals, extended once.

A run is a stretch of words with smallest period q and length of at least `shortest` and
`times` * q words that no neighbouring word extends. Its words agree with those q further on
over length - q places: a streak on the diagonal of lag q.

1. Lags are taken in classes [2^j, 2^(j+1)). A run of such a lag agrees over 3 * 2^j places
   at least (5 for lag 1), so grams of that many words are indexed. Names of grams come from
   pairs of shorter ones; places whose gram occurs once leave the index for good.
2. Occurrences of one gram in one document make pairs. A gram of the index is longer than its
   lag, so within a run its next occurrence is one period on: only neighbouring occurrences
   are paired, and a word repeated n times makes n pairs, not n^2.
3. A pair is extended to both sides as far as words agree. A table of the furthest place
   covered on each lag suppresses pairs that lie in a streak already known.

A document is a row and is solved where it is read: nothing is shuffled.

Results by case: a null text has no words, a text without words no runs; texts of any length
are taken whole; ties of the greatest exponent go to the smallest start, then period; repeated
rows and null ids are solved each; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, clean_rows, documents, hex_digest, query, texts

# Fixed values of the contract: least length in words, and in periods.
SHORTEST, TIMES = 6, 4
# Words that share one index; a longer document has its own.
BATCH_WORDS = 1 << 17


def repeated(first: np.ndarray, second: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where both names are known and the pair occurs twice or more, with names of the pairs."""
    n = len(second)
    at = np.flatnonzero((first[:n] >= 0) & (second >= 0))
    _, name, count = np.unique(first[at] * np.int64(size) + second[at], return_inverse=True, return_counts=True)
    twice = count[name] > 1
    return at[twice], name[twice]


def seeds(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, lag) of neighbouring occurrences of one gram, for each class of lags.

    words: a number per word; each negative number stands for a boundary.
    """
    n = len(words)
    names, width, j = words, 1, 0
    while True:
        need = 4 if j == 0 else 2 << j
        while width < need:
            if len(names) <= width:
                return
            at, name = repeated(names, names[width:], n)
            names = np.full(n, -1, dtype=np.int64)
            names[at] = name
            width *= 2
        # Grams of 5 or 3 * 2^j words: two that overlap.
        shift = 1 << j
        at, name = repeated(names, names[shift:], n)
        if not len(at):
            # Longer grams start with a shorter one that is repeated: none is left.
            if not (names >= 0).any():
                return
        else:
            order = np.argsort(name, kind="stable")
            at, name = at[order], name[order]
            lag = at[1:] - at[:-1]
            near = (name[1:] == name[:-1]) & (lag >= 1 << j) & (lag < 2 << j)
            yield at[:-1][near], lag[near]
        j += 1


def agreement(words: np.ndarray, a: int, b: int, step: int, room: int) -> int:
    """Over how many places from a and b on, in steps of +1 or -1, words agree; at most `room`."""
    done, size = 0, 32
    while done < room:
        size = min(size, room - done)
        reach = step * np.arange(done, done + size)
        apart = np.flatnonzero(words[a + reach] != words[b + reach])
        if len(apart):
            return done + int(apart[0])
        done += size
        size *= 2
    return done


def runs(words: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, ordered by start, then period.

    times is 4 at least: the grams are cut for it. Boundaries are different negative numbers.
    """
    if times < 4 or shortest < 6:
        raise ValueError("grams are cut for runs of at least four periods and six words")
    bounds = np.flatnonzero(words < 0)
    part = np.searchsorted(bounds, np.arange(len(words)))
    covered: dict[int, int] = {}
    found = []
    for places, lags in seeds(words):
        same = part[places] == part[places + lags]
        places, lags = places[same], lags[same]
        order = np.lexsort((places, lags))
        places, lags = places[order], lags[order]
        # Of pairs that follow each other on one diagonal the first is enough.
        new = np.ones(len(places), dtype=bool)
        new[1:] = (lags[1:] != lags[:-1]) | (places[1:] != places[:-1] + 1)
        for at, lag in zip(places[new].tolist(), lags[new].tolist(), strict=True):
            if at < covered.get(lag, 0):
                continue
            back = agreement(words, at - 1, at - 1 + lag, -1, at)
            ahead = agreement(words, at, at + lag, 1, len(words) - at - lag)
            covered[lag] = at + ahead
            length = back + ahead + lag
            if length >= max(shortest, times * lag):
                found.append((at - back, length, lag))
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period; found is ordered, so the first of equal ones."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of n words stays: in no run, or among a run's first period only."""
    edges = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges)[:-1] == 0


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_NAMES = ("start", "length", "period")


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, runs array<struct<start, length, period>> by start, then
    period, best (the run of greatest length / period, or null), collapsed binary (kept words
    joined by one space)."""
    source = texts(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()

    def solved(parts: list[list[bytes]]) -> list[tuple]:
        """Runs of some documents by one index; boundaries keep them apart."""
        flat = [w for words in parts for w in words]
        if not flat:
            return [([], None, b"")] * len(parts)
        number = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        ends = np.cumsum(sizes + 1)
        marked = np.empty(len(flat) + len(parts), dtype=np.int64)
        marked[ends - 1] = -1 - np.arange(len(parts))
        inside = np.ones(len(marked), dtype=bool)
        inside[ends - 1] = False
        marked[inside] = number
        own: list[list[tuple[int, int, int]]] = [[] for _ in parts]
        begins = ends - sizes - 1
        for start, length, period in runs(marked, shortest, times):
            row = int(np.searchsorted(ends, start, side="right"))
            own[row].append((start - int(begins[row]), length, period))
        out = []
        for words, found in zip(parts, own, strict=True):
            stays = words if not found else [w for w, k in zip(words, kept_words(len(words), found).tolist(), strict=True) if k]
            out.append((found, strongest(found), b" ".join(stays)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in clean_rows(batches, 512):
            out, some, held = [], [], 0
            for text in batch.column(1).to_pylist():
                some.append(text.split())  # bytes are split at exactly the contract's white space
                held += len(some[-1])
                if held >= BATCH_WORDS:
                    out += solved(some)
                    some, held = [], 0
            out += solved(some)
            found, best, collapsed = zip(*out, strict=True)
            columns = [
                pa.array([[dict(zip(_NAMES, r, strict=True)) for r in rs] for rs in found], pa.list_(_RUN)),
                pa.array([None if b is None else dict(zip(_NAMES, b, strict=True)) for b in best], _RUN),
                pa.array(collapsed, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "runs", "best", "collapsed"])

    one = "struct<start:long,length:long,period:long>"
    return source.mapInArrow(run, f"doc_id {kind}, runs array<{one}>, best {one}, collapsed binary")


def planted(doc_id: Column, text: Column) -> Column:
    """The contract's texts: one document of ten gets its words repeated from some word on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, f"{SPACE_CLASS}+", -1), lambda w: w != "")
    n = F.size(words).cast("long")
    a = g % F.greatest(n, F.lit(1))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    # One-element arrays hold a and p, so that each is worked out once per text and not per word.
    held = F.array(F.struct(words.alias("w"), a.alias("a"), p.alias("p")))
    spun = F.flatten(
        F.transform(held, lambda s: F.transform(s["w"], lambda w, i: F.when(i < s["a"], w).otherwise(F.get(s["w"], (s["a"] + (i - s["a"]) % s["p"]).cast("int")))))
    )
    return F.when((h % 10 == 0) & (n > 0), F.array_join(spun, " ")).otherwise(text)


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.col("best")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        hex_digest(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")).alias("runs_sha256"),
        hex_digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
