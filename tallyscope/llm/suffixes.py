"""Repeated byte strings by suffix arrays.

Every byte covered by a string of `length` bytes that also starts anywhere else is found.
All texts can't share one suffix array, so strings are first brought together by anchors:

1. The anchor of a string of `length` bytes is its leftmost `gram` of least hash. Equal
   strings have equal anchors at equal places, so only strings with one anchor gram need
   to be compared; the strings of one anchor start in a run of positions, and that run
   with the bytes it spans is a context. Contexts are dealt out by their anchor's hash.
2. A context that occurs twice as a whole repeats in all its strings; nothing is left to
   compare. Each task marks such contexts among its own rows first and sends one of them,
   so a passage that a third of all documents share is a few rows per task.
3. Different contexts of one anchor are compared by a suffix array of their bytes: two-stage
   sorting (only suffixes smaller than their successors are sorted directly, the others
   follow from scans of the buckets of first bytes), then common prefixes of neighbours.
4. An anchor with more than `most_contexts` different contexts is taken string by string:
   each start becomes a context of one string and goes through step 2 again, which is exact.

Results by case: null is the empty text and nothing is removed from texts shorter than
`length`; very long texts are read in pieces that overlap; repeated rows repeat each other
as wholes; a null doc_id is carried; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.session import stored

from .common import clean_rows, documents, hex_digest, query, row_key

# Fixed values of the contract.
LENGTH = 400
# Bytes of text that are hashed at a time, and bytes of contexts in one suffix array.
CHUNK_BYTES = 1 << 18
BLOCK_BYTES = 1 << 18
SALTS = 64

_BASE = 0x9E3779B97F4A7C15
_OTHER_BASE = 0xD6E8FEB86659FD93
_ODD = 0x1E3779B97F4A7C15
_PLACE_BITS = 22


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _inverse(odd: int) -> int:
    x = odd
    for _ in range(6):
        x = x * (2 - odd * x) % (1 << 64)
    return x


_TABLES: dict[int, list[np.ndarray]] = {}


def _tables(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, for n positions at least."""
    if base not in _TABLES or len(_TABLES[base][0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        _TABLES[base] = [_powers(base, size), _powers(_inverse(base), size)]
    return _TABLES[base][0][:n], _TABLES[base][1][:n]


def _mixed(h: np.ndarray, factor: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(factor)
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Hashes of any substring of a buffer: differences of a sum of byte times power."""

    def __init__(self, raw: np.ndarray, base: int = _BASE):
        powers, self.back = _tables(len(raw) + 1, base)
        self.sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def every(self, width: int) -> np.ndarray:
        return (self.sums[width:] - self.sums[:-width]) * self.back[: len(self.sums) - width]


def contexts(raw: bytes, begins: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Contexts of a buffer of pieces: anchor hash, content hash, first start, number of starts."""
    buffer = np.frombuffer(raw, dtype=np.uint8)
    none = np.zeros(0, dtype=np.int64)
    if len(buffer) < length:
        return none, none, none, none
    hashes = Rolling(buffer)
    gram_hash = _mixed(hashes.every(gram), 0xBF58476D1CE4E5B9)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    marked = (gram_hash & ~low) | np.arange(len(gram_hash), dtype=np.uint64)
    # Least value of each window of grams: suffix minima of one block with prefix minima of the next.
    window = length - gram + 1
    count = len(marked) - window + 1
    blocks = np.full(-(-len(marked) // window) * window, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[: len(marked)] = marked
    blocks = blocks.reshape(-1, window).T.copy()
    ahead = np.minimum.accumulate(blocks, axis=0).T.ravel()
    behind = np.minimum.accumulate(blocks[::-1], axis=0)[::-1].T.ravel()
    least = np.minimum(behind[:count], ahead[window - 1 : window - 1 + count])
    piece = np.repeat(np.arange(len(begins)), ends - begins)
    starts = np.flatnonzero(np.arange(count) + length <= ends[piece[:count]])
    if not len(starts):
        return none, none, none, none
    anchor = (least[starts] & low).astype(np.int64)
    own = piece[starts]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])]))
    first = starts[new]
    number = np.diff(np.concatenate([new, [len(starts)]]))
    anchor = anchor[new]
    content = hashes.of(first, first + number - 1 + length)
    content = _mixed(content + (anchor - first).astype(np.uint64) * np.uint64(0x94D049BB133111EB) + number.astype(np.uint64), 0x94D049BB133111EB)
    return gram_hash[anchor].view(np.int64), content.view(np.int64), first, number


def chunks(parts: list[bytes], length: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Pieces of about CHUNK_BYTES together, with each piece's row and offset in its text.

    A long text is cut into pieces that overlap by length - 1 bytes: each start is in one.
    """
    pieces: list[bytes] = []
    rows: list[int] = []
    offsets: list[int] = []
    size = 0
    for row, part in enumerate(parts):
        for at in range(0, max(0, len(part) - length + 1), CHUNK_BYTES):
            piece = part[at : at + CHUNK_BYTES + length - 1]
            pieces.append(piece)
            rows.append(row)
            offsets.append(at)
            size += len(piece)
            if size >= CHUNK_BYTES:
                yield pieces, np.array(rows), np.array(offsets)
                pieces, rows, offsets, size = [], [], [], 0
    if pieces:
        yield pieces, np.array(rows), np.array(offsets)


def suffix_array(raw: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first `depth` bytes, by two-stage sorting.

    A suffix is of type B if smaller than its successor, else of type A; the end of the
    buffer is smaller than all. Suffixes of type B are sorted directly. In a bucket of
    suffixes with one first byte those of type A come first. When the buckets are scanned
    by rising byte, the predecessor of each suffix that is of type A goes to the next free
    place of its own bucket, so no suffix of type A is ever compared.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, dtype=np.int64)
    values = raw.astype(np.int16)
    change = np.flatnonzero(values[1:] != values[:-1])
    # Each run of one byte has the type that the next byte decides.
    run_end = np.concatenate([change, [n - 1]])
    rises = np.concatenate([values[change + 1] > values[change], [False]])
    is_b = np.repeat(rises, np.diff(np.concatenate([[-1], run_end])))
    data = raw.tobytes()
    direct = sorted(np.flatnonzero(is_b).tolist(), key=lambda i: data[i : i + depth])
    direct = np.array(direct, dtype=np.int64)
    sizes = np.bincount(raw, minlength=256)
    sizes_b = np.bincount(raw[is_b], minlength=256)
    starts_b = np.cumsum(sizes_b) - sizes_b
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[raw[n - 1]].append(np.array([n - 1], dtype=np.int64))
    order = []
    for byte in np.flatnonzero(sizes).tolist():
        # Type A: found while smaller buckets were scanned, then runs of this byte itself.
        induced = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, dtype=np.int64)
        waiting[byte] = []
        first = [induced]
        while len(induced):
            before = induced[induced > 0] - 1
            induced = before[raw[before] == byte]
            first.append(induced)
        bucket = np.concatenate([*first, direct[starts_b[byte] : starts_b[byte] + sizes_b[byte]]])
        order.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[raw[before] > byte]
        if len(before):
            by = raw[before]
            sort = np.argsort(by, kind="stable")
            before, by = before[sort], by[sort]
            cut = np.flatnonzero(by[1:] != by[:-1]) + 1
            for part, value in zip(np.split(before, cut), by[np.concatenate([[0], cut])].tolist(), strict=True):
                waiting[value].append(part)
    return np.concatenate(order)


def common_prefixes(raw: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, counted up to `most`."""
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(most + 8, dtype=np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = np.zeros(n, dtype=np.int64)
    live = np.arange(1, n)
    a, b = order[live - 1], order[live]
    for at in range(0, most, 8):
        same = words[a + at] == words[b + at]
        whole = same.all(axis=1)
        ended = ~whole
        out[live[ended]] = at + np.argmin(same[ended], axis=1)
        live, a, b = live[whole], a[whole], b[whole]
        if not len(live):
            break
    out[live] = most
    return np.minimum(np.minimum(out, most), np.concatenate([[0], n - np.maximum(order[:-1], order[1:])]))


def repeated_starts(raw: np.ndarray, room: np.ndarray, length: int) -> np.ndarray:
    """Whether the string of `length` bytes at each position starts elsewhere too.

    room: bytes from each position to the end of its context; shorter ones are no strings.
    """
    order = suffix_array(raw, length)
    shared = common_prefixes(raw, order, length)
    group = np.cumsum(shared < length)
    whole = room[order] >= length
    counts = np.bincount(group[whole], minlength=group[-1] + 1) if len(group) else group
    out = np.zeros(len(raw), dtype=bool)
    out[order[whole & (counts[group] >= 2)]] = True
    return out


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of true values."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


# A row is a mark (starts lo .. lo + n - 1 of a text repeat) or a context.
_ROW = "fp long, ctx long, is_mark boolean, settled boolean, doc_id {kind}, row_key long, lo long, n long"
_NAMES = ["fp", "ctx", "is_mark", "settled", "doc_id", "row_key", "lo", "n"]


def _collapsed(fp, ctx, row, lo, n, ids: pa.Array, keys: pa.Array) -> pa.RecordBatch:
    """Contexts of some rows; those that occur twice here are marked, and one of them stays."""
    _, first, back, count = np.unique(fp * np.int64(_ODD) + ctx, return_index=True, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[back] > 1)
    at = np.concatenate([twice, first])
    is_mark = np.arange(len(at)) < len(twice)
    settled = np.concatenate([np.ones(len(twice), dtype=bool), count > 1])
    # Marks need no meeting, so they are spread by their content.
    columns = [np.where(is_mark, ctx[at] ^ lo[at], fp[at]), np.where(is_mark, 0, ctx[at]), is_mark, settled]
    rows = pa.array(row[at], pa.int64())
    return pa.RecordBatch.from_arrays(
        [*map(pa.array, columns), ids.take(rows), keys.take(rows), pa.array(lo[at], pa.int64()), pa.array(n[at], pa.int64())],
        names=_NAMES,
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row_key, text bytes. The key tells rows with one doc_id and different texts apart."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row_key"), text.alias("text"))


def _contexts(source: DataFrame, length: int, gram: int) -> DataFrame:
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in clean_rows(batches, 4096):
            found: list[list[np.ndarray]] = []
            for pieces, rows, offsets in chunks(batch.column(2).to_pylist(), length):
                sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
                ends = np.cumsum(sizes)
                begins = ends - sizes
                fp, ctx, first, n = contexts(b"".join(pieces), begins, ends, length, gram)
                piece = np.searchsorted(ends, first, side="right")
                found.append([fp, ctx, rows[piece], first - begins[piece] + offsets[piece], n])
            if found:
                yield _collapsed(*map(np.concatenate, zip(*found, strict=True)), batch.column(0), batch.column(1))

    return source.mapInArrow(run, _ROW.format(kind=kind))


def _met(rows: DataFrame) -> DataFrame:
    """Marks, and of each anchor with different contexts one row per context.

    Rows arrive by anchor and content, so a task holds one row of its anchor at a time.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        waiting: tuple | None = None  # the first row of the current content, not yet sent
        settled = several = False

        def send(row: tuple, is_mark: bool, settled: bool) -> None:
            out.append((*row[:2], is_mark, settled, *row[4:]))

        def leave(next_fp) -> None:
            """The current content ends; next_fp is the anchor of the row that follows."""
            nonlocal several
            if waiting is not None:
                several = several or next_fp == waiting[0]
                if several:
                    send(waiting, False, settled)
                several = several and next_fp == waiting[0]

        kinds: list = []
        for batch in clean_rows(batches, 8192):
            kinds = batch.schema.types
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[2]:
                    out.append(row)
                elif waiting is not None and row[:2] == waiting[:2]:
                    if not settled:
                        send(waiting, True, True)
                    if not row[3]:
                        send(row, True, True)
                    settled = True
                else:
                    leave(row[0])
                    waiting, settled = row, row[3]
            if len(out) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=_NAMES)
                out = []
        leave(None)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=_NAMES)

    dealt = rows.repartition("fp").sortWithinPartitions("fp", "ctx")
    return dealt.mapInArrow(run, _ROW.format(kind=kind))


def _marks(rows: DataFrame) -> DataFrame:
    return rows.filter("is_mark").select("doc_id", "row_key", "lo", "n")


def _same_row(a: DataFrame, b: DataFrame):
    return (a["row_key"] == b["_key"]) & a["doc_id"].eqNullSafe(b["_doc"])


def _with_bytes(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """source joined with `wanted` (fp, settled, lo, n, hot) gathered per row."""
    grouped = wanted.groupBy(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_key")).agg(
        # A set: a row that is there r times sends its contexts r times.
        F.collect_set(F.struct("fp", "settled", "lo", "n", "hot")).alias("wanted")
    )
    return source.join(grouped, _same_row(source, grouped)).select("doc_id", "row_key", "text", "wanted")


def _context_bytes(joined: DataFrame, length: int) -> DataFrame:
    """Bytes of the contexts of anchors that are not hot."""
    kind = joined.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in clean_rows(batches, 64):
            out = [
                (w["fp"], w["settled"], doc, key, w["lo"], w["n"], text[w["lo"] : w["lo"] + w["n"] - 1 + length])
                for doc, key, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                for w in wanted
                if not w["hot"]
            ]
            if out:
                kinds = [pa.int64(), pa.bool_(), batch.schema.types[0], pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["fp", "settled", "doc_id", "row_key", "lo", "n", "bytes"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return joined.mapInArrow(run, f"fp long, settled boolean, doc_id {kind}, row_key long, lo long, n long, bytes binary")


def _single_strings(joined: DataFrame, length: int) -> DataFrame:
    """Each start of a hot anchor's contexts as a context of one string."""
    kind = joined.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in clean_rows(batches, 256):
            found: list[list[np.ndarray]] = []
            for row, (text, wanted) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                for w in wanted:
                    if w["hot"]:
                        lo, n = w["lo"], w["n"]
                        raw = np.frombuffer(text[lo : lo + n - 1 + length], dtype=np.uint8)
                        # Two hashes of their own: 128 bits decide which strings are equal.
                        found.append([
                            _mixed(Rolling(raw).every(length), 0xBF58476D1CE4E5B9).view(np.int64),
                            _mixed(Rolling(raw, _OTHER_BASE).every(length), 0x94D049BB133111EB).view(np.int64),
                            np.full(n, row), np.arange(lo, lo + n), np.ones(n, dtype=np.int64),
                        ])
            if found:
                yield _collapsed(*map(np.concatenate, zip(*found, strict=True)), batch.column(0), batch.column(1))

    return joined.mapInArrow(run, _ROW.format(kind=kind))


def _compared(rows: DataFrame, length: int) -> DataFrame:
    """Marks from suffix arrays over the contexts of one anchor, several anchors to a block."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "row_key", "lo", "n"]

    def block(some: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        raw = np.frombuffer(b"".join(r[6] for r in some), dtype=np.uint8)
        sizes = np.fromiter((len(r[6]) for r in some), dtype=np.int64, count=len(some))
        ends = np.cumsum(sizes)
        found = repeated_starts(raw, np.repeat(ends, sizes) - np.arange(len(raw)), length)
        out: list[tuple] = []
        for row, begin, end in zip(some, (ends - sizes).tolist(), ends.tolist(), strict=True):
            if not row[1]:
                out += [(row[2], row[3], row[4] + a, b - a) for a, b in zip(*(x.tolist() for x in runs(found[begin:end])), strict=True)]
        columns = zip(*out, strict=True) if out else [[], [], [], []]
        kinds = [id_type, pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[tuple] = []
        size, id_type = 0, None
        for batch in clean_rows(batches, 1024):
            id_type = batch.schema.types[2]
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BLOCK_BYTES and row[0] != some[-1][0]:
                    yield block(some, id_type)
                    some, size = [], 0
                some.append(row)
                size += len(row[6])
        if some:
            yield block(some, id_type)

    # Sorting costs time, not bytes: a number of its own keeps small partitions from being joined.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks, "fp").sortWithinPartitions("fp")
    return dealt.mapInArrow(run, f"doc_id {kind}, row_key long, lo long, n long")


def repeats(source: DataFrame, length: int, gram: int, most_contexts: int) -> DataFrame:
    """(doc_id, row_key, lo, n): strings that start at lo .. lo + n - 1 also start elsewhere."""
    met = stored(_met(_contexts(source, length, gram)), "contexts")
    open_rows = met.filter("NOT is_mark").select("fp", "settled", "doc_id", "row_key", "lo", "n")
    # A crowded anchor's contexts are dealt out over SALTS tasks for this join.
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    crowded = open_rows.groupBy("fp").count().filter(F.col("count") > most_contexts).select(F.col("fp").alias("_fp"), salts.alias("_salt"))
    salted = open_rows.withColumn("salt", F.pmod("row_key", F.lit(SALTS).cast("long")))
    same = (F.col("fp") == F.col("_fp")) & (F.col("salt") == F.col("_salt"))
    # Crowded anchors grow with the data: they are never sent to all executors.
    wanted = salted.join(crowded.hint("merge"), same, "left").withColumn("hot", F.col("_fp").isNotNull())
    joined = _with_bytes(source, wanted)
    by_array = _compared(_context_bytes(joined.filter(F.exists("wanted", lambda w: ~w["hot"])), length), length)
    by_string = _marks(_met(_single_strings(joined.filter(F.exists("wanted", lambda w: w["hot"])), length)))
    return _marks(met).unionByName(by_array).unionByName(by_string)


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int = 128,
    most_contexts: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans array<struct<start, end>> (maximal runs of
    bytes that are removed), kept binary (the other bytes), kept_text (these as text, without
    the rest of characters that a cut went through)."""
    source = _keyed(docs, id_col, text_col)
    marks = repeats(source, length, gram, most_contexts)
    grouped = marks.groupBy(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_key")).agg(F.collect_set(F.struct("lo", "n")).alias("marks"))
    joined = source.join(grouped, _same_row(source, grouped), "left").select("doc_id", "text", "marks")
    kind = joined.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in clean_rows(batches, 256):
            sizes, spans, kept, texts = [], [], [], []
            marks = batch.column(2)
            flat, counts = marks.flatten(), marks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            lows, ns = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at = 0
            for text, count in zip(batch.column(1).to_pylist(), counts.tolist(), strict=True):
                edges = np.zeros(len(text) + 1, dtype=np.int64)
                np.add.at(edges, lows[at : at + count], 1)
                np.subtract.at(edges, lows[at : at + count] + ns[at : at + count] - 1 + length, 1)
                at += count
                gone = np.cumsum(edges)[:-1] > 0
                sizes.append(len(text))
                spans.append([{"start": a, "end": b} for a, b in zip(*(x.tolist() for x in runs(gone)), strict=True)])
                kept.append(np.frombuffer(text, dtype=np.uint8)[~gone].tobytes() if count else text)
                texts.append(kept[-1].decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()), pa.array(texts, pa.string())],
                names=["doc_id", "n_bytes", "spans", "kept", "kept_text"],
            )

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, kept_text string")


# Every string of 400 bytes by its checksum, from hexadecimal text.
SQL = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM bytes)),
repeated AS (SELECT doc_id, i FROM starts QUALIFY count(*) OVER (PARTITION BY k) > 1),
marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM repeated),
numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, min(i) AS lo, max(i) + 400 AS hi FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(hi) OVER w, 0) AS a, lo AS b FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY lo)
  UNION ALL SELECT doc_id, coalesce(max(hi), 0), any_value(length(h) // 2) FROM bytes LEFT JOIN spans USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id),
whole AS (SELECT doc_id, array_to_string(regexp_extract_all(regexp_replace(lower(h), '(..)', ' \\1', 'g'),
  ' [0-7].| (?:c[2-9a-f]|d.) [89ab].| (?:e0 [ab].|e[1-9a-cef] [89ab].|ed [89].) [89ab].| (?:f0 [9ab].|f[1-3] [89ab].|f4 8.) [89ab]. [89ab].'), '') AS h FROM kept),
counted AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo)::BIGINT AS n_removed FROM spans GROUP BY doc_id)
SELECT b.doc_id, length(b.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k.h)) AS kept_sha256,
  decode(unhex(replace(w.h, ' ', ''))) AS text
FROM bytes b JOIN kept k USING (doc_id) JOIN whole w USING (doc_id) LEFT JOIN counted USING (doc_id)
"""


@query("op2_suffix_dedup", SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        hex_digest(F.col("kept")).alias("kept_sha256"),
        F.col("kept_text").alias("text"),
    )
