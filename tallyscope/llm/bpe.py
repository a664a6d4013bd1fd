"""Byte-level BPE: encoding to ids and decoding back.

A text is cut by the vocabulary's pattern; each match is merged on its own. A segment
tree over the byte positions of a match keeps, for each live position, the rank of the
pair that starts there; a node holds the smallest (rank, position) below it, so the root
names the leftmost pair of lowest rank. A merge changes three leaves (the merged position,
its left neighbour, the position that died), each by a climb of log2(length) nodes.

Short matches are merged many at a time: one numpy lane per match, all trees of a lane
group in one array. Long matches go through the same tree one by one, so a text without
any cut costs n log n.

Results by case: a null or empty text has no ids (empty array) and decodes to empty bytes;
repeated rows are encoded each on its own; invalid UTF-8 is read with replacement marks;
an empty table gives an empty table; null ids decode to null.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import clean_rows, documents, hex_digest, query, texts

# A match longer than this many bytes gets a tree of its own.
LANE_BYTES = 256
# Runs, and matches, whose ids a worker remembers; beyond it the memory starts anew.
MEMO_ENTRIES = 600_000

_NONE = np.int64(1) << 60
# The characters with Unicode's White_Space property.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def parse_ranks(raw: bytes) -> list[bytes]:
    """Token bytes by rank, from lines of base64 token and rank."""
    pairs = (line.split() for line in raw.splitlines() if line.strip())
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks.get(i, b"") for i in range(max(ranks, default=-1) + 1)]


class Merger:
    """Merges byte strings by rank with a segment tree of pair ranks."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pairs: dict[int, int] = {}
        for merged, token in enumerate(tokens):
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = merged
        keys = np.fromiter(self.pairs.keys(), dtype=np.int64, count=len(self.pairs))
        merged_ids = np.fromiter(self.pairs.values(), dtype=np.int64, count=len(self.pairs))
        # Open addressing: a power of two of slots, a quarter full at most.
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.slot_key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.slot_id = np.full(1 << self.bits, -1, dtype=np.int64)
        rest = np.arange(len(keys))
        slot = self._slot(keys)
        while len(rest):
            free = rest[self.slot_key[slot[rest]] == -1]
            self.slot_key[slot[free]] = keys[free]  # of several for a slot the last stays
            won = self.slot_key[slot[rest]] == keys[rest]
            self.slot_id[slot[rest[won]]] = merged_ids[rest[won]]
            rest = rest[~won]
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the two don't merge."""
        keys = left << 32 | right
        slot = self._slot(keys)
        out = np.full(len(keys), -1, dtype=np.int64)
        rest = np.arange(len(keys))
        while len(rest):
            found = self.slot_key[slot]
            hit = found == keys[rest]
            out[rest[hit]] = self.slot_id[slot[hit]]
            go = ~hit & (found != -1)
            rest, slot = rest[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def encode_many(self, words: list[bytes]) -> list[bytes]:
        """For each word its ids as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = [b""] * len(words)
        lanes: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            whole = self.rank.get(word)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(word) > LANE_BYTES:
                out[i] = self._encode_long(word)
            elif word:
                lanes.setdefault(max(2, 1 << (len(word) - 1).bit_length()), []).append(i)
        for width, members in lanes.items():
            step = max(1, (1 << 21) // width)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for i, ids in zip(part, self._encode_lanes([words[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _encode_lanes(self, words: list[bytes], width: int) -> list[bytes]:
        n, shift = len(words), width.bit_length() - 1
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
        spot = np.arange(width)
        live = spot[None, :] < lengths[:, None]
        tok = np.where(live, self.byte_id[raw], -1)
        after = np.where(live, spot[None, :] + 1, width)
        after[np.arange(n), lengths - 1] = width
        before = np.broadcast_to(spot - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), _NONE, dtype=np.int64)
        lane, at = np.nonzero(live[:, 1:])
        ranks = self.pair_ranks(tok[lane, at], tok[lane, at + 1])
        tree[lane, width + at] = np.where(ranks < 0, _NONE, ranks << shift | at)
        level = width >> 1
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level >>= 1
        tok, after, before, tree = tok.ravel(), after.ravel(), before.ravel(), tree.ravel()

        def put(lanes: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            base, node = lanes * (2 * width), leaf + width
            tree[base + node] = value
            for _ in range(shift):
                node = node >> 1
                child = base + 2 * node
                tree[base + node] = np.minimum(tree[child], tree[child + 1])

        def pair_value(lanes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
            found = self.pair_ranks(tok[lanes * width + left], tok[lanes * width + right])
            return np.where(found < 0, _NONE, found << shift | left)

        busy = np.arange(n)
        while len(busy):
            root = tree[busy * (2 * width) + 1]
            busy, root = busy[root < _NONE], root[root < _NONE]
            if not len(busy):
                break
            row, pos = busy * width, root & (width - 1)
            dead = after[row + pos]
            then = after[row + dead]
            tok[row + pos] = root >> shift
            tok[row + dead] = -1
            after[row + pos] = then
            put(busy, dead, np.full(len(busy), _NONE))
            value = np.full(len(busy), _NONE)
            right = then < width
            before[row[right] + then[right]] = pos[right]
            value[right] = pair_value(busy[right], pos[right], then[right])
            put(busy, pos, value)
            left = before[row + pos] >= 0
            lanes, at = busy[left], before[row[left] + pos[left]]
            put(lanes, at, pair_value(lanes, at, pos[left]))

        kept = tok >= 0
        counts = kept.reshape(n, width).sum(axis=1)
        flat = tok[kept].astype("<u4").tobytes()
        ends = (np.cumsum(counts) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _encode_long(self, word: bytes) -> bytes:
        n = len(word)
        width = 1 << (n - 1).bit_length()
        shift, none = width.bit_length() - 1, int(_NONE)
        pairs = self.pairs.get
        tok = self.byte_id[np.frombuffer(word, dtype=np.uint8)].tolist()
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        leaves = [none] * width
        for i in range(n - 1):
            found = pairs(tok[i] << 32 | tok[i + 1])
            if found is not None:
                leaves[i] = found << shift | i
        tree = [none] * width + leaves
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(leaf: int, value: int) -> None:
            node = leaf + width
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if a < b else b
                if tree[node] == low:
                    return
                tree[node] = low

        while tree[1] < none:
            pos = tree[1] & (width - 1)
            dead = after[pos]
            then = after[dead]
            tok[pos], tok[dead], after[pos] = tree[1] >> shift, -1, then
            put(dead, none)
            found = pairs(tok[pos] << 32 | tok[then]) if then < n else None
            if then < n:
                before[then] = pos
            put(pos, none if found is None else found << shift | pos)
            prior = before[pos]
            if prior >= 0:
                found = pairs(tok[prior] << 32 | tok[pos])
                put(prior, none if found is None else found << shift | prior)
        return np.array([t for t in tok if t >= 0], dtype="<u4").tobytes()


class Encoder:
    """Texts to ids; remembers the ids of runs it has seen.

    A run is white space and what follows it up to the next white space. No match of a
    byte-level BPE pattern goes on from another character into white space, so runs can
    be cut by the pattern one by one, and most of a text is runs seen before.
    """

    def __init__(self, raw: bytes, pattern: str):
        self.merger = Merger(parse_ranks(raw))
        self.runs = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+").findall
        self.cut = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def encode(self, parts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit numbers."""
        runs = [self.runs(text) for text in parts]
        needed = set().union(*runs)
        unseen = list(needed.difference(self.memo))
        if len(self.memo) + len(unseen) > MEMO_ENTRIES:
            self.memo, unseen = {}, list(needed)
        cut = [self.cut(run) for run in unseen]
        needed = set().union(*cut)
        words = list(needed.difference(self.words))
        if len(self.words) + len(words) > MEMO_ENTRIES:
            self.words, words = {}, list(needed)
        self.words.update(zip(words, self.merger.encode_many([w.encode() for w in words]), strict=True))
        of = self.words.__getitem__
        self.memo.update(zip(unseen, (b"".join(map(of, ws)) for ws in cut), strict=True))
        of = self.memo.__getitem__
        return [b"".join(map(of, own)) for own in runs]


# One encoder per worker process and vocabulary; tasks of a worker share its memo.
_ENCODERS: dict[tuple[int, str], Encoder] = {}


def _encoder(raw: bytes, pattern: str) -> Encoder:
    key = (hash(raw), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(raw, pattern)
    return _ENCODERS[key]


def id_lists(parts: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))


def small_parts(parts: list[bytes], most: int = 1 << 21) -> Iterator[slice]:
    """Runs of texts of about `most` bytes together; one long text is a run of its own."""
    start = size = 0
    for i, part in enumerate(parts):
        if size and size + len(part) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(part)
    if start < len(parts):
        yield slice(start, len(parts))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text.

    The rank file (fixed size, below 1 MB here) is read once on the driver and broadcast,
    so executors need no local copy.
    """
    with open(ranks_path, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(raw.value, pattern)
        for batch in clean_rows(batches, 1024):
            parts = batch.column(1).to_pylist()
            for piece in small_parts(parts):
                ids = encoder.encode([p.decode("utf-8", "replace") for p in parts[piece]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.start, piece.stop - piece.start), id_lists(ids)], names=["doc_id", "ids"])

    source = texts(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """The input with a column of the bytes that its ids stand for."""
    with open(ranks_path, "rb") as f:
        raw = encoded.sparkSession.sparkContext.broadcast(f.read())
    names = [*encoded.columns, out]
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = parse_ranks(raw.value)
        flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        starts = np.cumsum(lengths) - lengths
        for batch in clean_rows(batches, 512):
            lists = batch.column(at)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            size = lengths[ids]
            ends = np.cumsum(size)
            # Byte j of the output is byte (j - where its token begins) of that token.
            made = flat[np.repeat(starts[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            byte_ends = np.concatenate([[0], ends])[np.cumsum(np.concatenate([[0], counts]))]
            mask = None if not lists.null_count else pa.py_buffer(np.packbits(lists.is_valid().to_numpy(zero_copy_only=False), bitorder="little"))
            bytes_out = pa.Array.from_buffers(pa.binary(), len(lists), [mask, pa.py_buffer(byte_ends.astype(np.int32)), pa.py_buffer(made)])
            yield pa.RecordBatch.from_arrays([*batch.columns, bytes_out], names=names)

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(out, BinaryType())]))


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    ranks = vocabularies.path("byte_bpe_50k.tiktoken")
    encoded = encode(documents(spark, sf_dir), ranks, vocabularies.PATTERN)
    return decode(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        hex_digest(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")).alias("ids_sha256"),
        hex_digest(F.col("decoded")).alias("decoded_sha256"),
    )
