"""Packing of tokenised texts into sequences of a fixed length.

Bounded-space online packing: a task keeps at most `windows` open sequences. A text is
tokenised and put, piece by piece, into the open window that it fits best (the least room
that is enough). A text longer than a sequence gives full sequences and a rest. When no
window is wide enough, a new one opens; when all are taken, the fullest is emitted first.
If that one still has more room than `gap`, the piece is cut to fill it: every id stays in
exactly one piece.

What a task holds open at its end are leftovers. They are merged in rounds: leftovers of
`fan_in` tasks meet in one task, best fit by falling size, until one group is left. A
round moves piece numbers only, no ids; the last group holds few windows per earlier task.

Results by case: an empty or null text is its end mark alone; texts of any length are cut;
repeated rows are packed each; null doc_ids are carried; an empty table gives no pieces.
Which task reads which rows follows from the files' splits alone, so a task that is run
again makes the same pieces; the pieces are written to the shared folder before leftovers
are read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.session import stored

from .common import clean_rows, documents, query, texts

# White-space separated words, and matches inside of them, whose ids a worker remembers; beyond it
# the memory starts anew.
MEMO_ENTRIES = 250_000
MATCH_ENTRIES = 650_000

# Words that are cut here: of visible ASCII and Latin-1 letters, without what may begin a special token.
PLAIN = re.compile(r"(?!.*<\|)[!-~À-ÖØ-öø-ÿ]+")
# The tokenizer's matches in such a word, in lower case.
MATCH = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

PIECES = (
    "start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_length long, open boolean"
)


class Ids(dict):
    """Ids of pieces of text, as little-endian unsigned 32-bit numbers."""

    entries = MATCH_ENTRIES

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model

    def found(self, piece: str) -> bytes:
        """Of one match in lower case: the model alone knows those of ASCII, whose bytes stand for themselves."""
        ids = [t.id for t in self.model.tokenize(piece)] if piece.isascii() else self.tokenizer.encode(piece, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, piece):
        if len(self) >= self.entries:
            self.clear()
        ids = self[piece] = self.found(piece)
        return ids


class WordIds(Ids):
    """Ids of a white-space separated word.

    White space ends every match of the tokenizer and is never part of one, so a text's
    ids are its words' ids in a row. A plain word's ids are its matches' ids in a row: most
    words that are new (in other case, with signs, codes) are made of matches that are known.
    """

    entries = MEMO_ENTRIES

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(Tokenizer.from_file(path))
        self.cuts = cuts_plain_words(path)
        self.matches = Ids(self.tokenizer)

    def found(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if self.cuts and PLAIN.fullmatch(text):
            return b"".join(map(self.matches.__getitem__, MATCH.findall(text.lower())))
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


def cuts_plain_words(path: str) -> bool:
    """Whether the tokenizer takes a plain word by the matches of MATCH, each for itself."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    norms = [n.get("type") for n in (made.get("normalizer") or {}).get("normalizers") or []]
    return (
        norms == ["NFC", "Replace", "Lowercase"]
        and made["normalizer"]["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
        and steps[0].get("pattern") == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
        and (steps[0].get("behavior"), steps[0].get("invert")) == ("Removed", True)
        and [(p.get("type"), p.get("add_prefix_space"), p.get("use_regex")) for p in steps[1:]] == [("ByteLevel", False, False)]
        and made.get("post_processor") is None
        and all(t["content"].startswith("<|") for t in made["added_tokens"])
    )


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORDS:
        _WORDS.clear()
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


class Window:
    __slots__ = ("number", "pieces", "used")

    def __init__(self, number: int):
        self.number, self.pieces, self.used = number, [], 0


class Packer:
    """Open windows of one task, ordered by the room that is left."""

    def __init__(self, size: int, windows: int, gap: int, first: int):
        self.size, self.windows, self.gap, self.next = size, windows, gap, first
        self.rooms: list[tuple[int, int]] = []  # (room, number), rising
        self.open: dict[int, Window] = {}
        self.done: list[Window] = []

    def new(self) -> Window:
        window = Window(self.next)
        self.next += 1
        return window

    def _put(self, window: Window, piece: tuple, length: int) -> None:
        window.pieces.append((piece, length, window.used))
        window.used += length
        if window.used == self.size:
            self.open.pop(window.number, None)
            self.done.append(window)
        else:
            self.open[window.number] = window
            insort(self.rooms, (self.size - window.used, window.number))

    def _take(self, at: int) -> Window:
        return self.open[self.rooms.pop(at)[1]]

    def add(self, piece: tuple, length: int) -> None:
        """A piece that is not to be cut; length is at most a sequence."""
        if length == self.size:
            self._put(self.new(), piece, length)
            return
        at = bisect_left(self.rooms, (length, -1))
        if at < len(self.rooms):
            self._put(self._take(at), piece, length)
            return
        if len(self.rooms) >= self.windows:
            fullest = self._take(0)
            self.done.append(self.open.pop(fullest.number))
        self._put(self.new(), piece, length)

    def room_for(self, length: int) -> int:
        """How much of a piece goes into the window that it is put in next."""
        if length >= self.size:
            return self.size
        if bisect_left(self.rooms, (length, -1)) < len(self.rooms) or len(self.rooms) < self.windows:
            return length
        room = self.rooms[0][0]
        return room if room > self.gap else length


def _packed(source: DataFrame, tokenizer_path: str, end_id: int, size: int, windows: int, gap: int) -> DataFrame:
    end = int(end_id).to_bytes(4, "little")
    kind = source.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "open"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = word_ids(tokenizer_path).__getitem__
        packer = Packer(size, windows, gap, TaskContext.get().partitionId() << 32)
        id_type = None

        def rows(done: list[Window], is_open: bool) -> pa.RecordBatch:
            out = [
                (doc, start, length, crc, total, w.number, offset, w.used, is_open)
                for w in done
                for (doc, start, crc, total), length, offset in w.pieces
            ]
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            kinds = [id_type, *[pa.int64()] * 7, pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in clean_rows(batches, 512):
            id_type = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = b"".join(map(of, text.split())) + end
                total, start = len(ids) // 4, 0
                while start < total:
                    length = packer.room_for(total - start)
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    packer.add((doc, start, crc, total), length)
                    start += length
            if packer.done:
                yield rows(packer.done, False)
                packer.done = []
        if packer.open:
            yield rows(list(packer.open.values()), True)

    return source.mapInArrow(run, f"doc_id {kind}, {PIECES}")


def _merged(leftovers: DataFrame, size: int, windows: int) -> DataFrame:
    """Leftover windows of a group of tasks in fewer windows, best fit by falling size;
    all but the `windows` emptiest are closed."""

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("sequence_length", "descending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        old, used = table.column("sequence_id").to_numpy(), table.column("sequence_length").to_numpy()
        heads = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
        rooms: list[tuple[int, int]] = []  # (room, window), rising
        into, shift = {}, {}
        for number, length in zip(old[heads].tolist(), used[heads].tolist(), strict=True):
            at = bisect_left(rooms, (length, -1))
            room, window = rooms.pop(at) if at < len(rooms) else (size, number)
            into[number], shift[number] = window, size - room
            insort(rooms, (room - length, window))
        full = {window: size - room for room, window in rooms}
        still_open = {window for _, window in rooms[-windows:]}
        target = [into[n] for n in old.tolist()]
        new = {
            "sequence_id": pa.array(target, pa.int64()),
            "offset": pa.array(table.column("offset").to_numpy() + [shift[n] for n in old.tolist()], pa.int64()),
            "sequence_length": pa.array([full[t] for t in target], pa.int64()),
            "open": pa.array([t in still_open for t in target], pa.bool_()),
        }
        for name, values in new.items():
            table = table.set_column(table.schema.get_field_index(name), name, values)
        return table

    return leftovers.groupBy("_group").applyInArrow(merge, leftovers.schema)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    size: int = 2048,
    windows: int = 64,
    gap: int = 8,
    fan_in: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_length (ids in the sequence before padding)."""
    made = stored(_packed(texts(docs, id_col, text_col), tokenizer_path, end_id, size, windows, gap), "packed")
    task = F.shiftright(F.col("sequence_id"), 32)
    last = made.filter("open").agg(F.max(task)).first()[0] or 0
    closed, leftovers, span = [made.filter("NOT open")], made.filter("open"), fan_in
    while True:
        grouped = leftovers.withColumn("_group", F.floor(task / F.lit(span)))
        merged = stored(_merged(grouped, size, windows), "leftovers").drop("_group")
        if span > last:
            closed.append(merged)
            break
        closed.append(merged.filter("NOT open"))
        leftovers, span = merged.filter("open"), span * fan_in
    out = closed[0]
    for part in closed[1:]:
        out = out.unionByName(part)
    return out.drop("open")


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    return pack(documents(spark, sf_dir), vocabularies.path("word_bpe_49k.json"))
