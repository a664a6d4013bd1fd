"""Exact duplicates by Patricia tries.

Texts are equal when identical after deleting white space. Each task first inserts its
texts into a compressed radix trie whose terminal nodes hold the owner so far (most code
points in the original text, then smallest doc_id) and a count; when the trie exceeds its
memory, the largest subtree below the root is spilled: its terminals go out as partial
owners. Partial owners are dealt out by length and SHA-256 of the text; within a
partition they arrive in that order, so a (length, hash) subtree is complete when the next
one begins, and is emitted and dropped. Full byte strings are compared along the edges.

A group of copies, however large, reaches the shuffle as a few rows per task; documents
learn their owner by a join on (length, hash), whose large side AQE can split.

Results by case: null counts as empty, and all empty texts are one group; very long texts
are single edges; of rows with equal text, code points and doc_id (repeated rows) each
names that doc_id as its owner, so all are marked kept, and `drop_copies` leaves one of
them; a null doc_id comes after all others; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CLASS, clean_rows, documents, query, texts, unused

# Bytes of labels that a task's trie may hold before its largest subtree is spilled.
TRIE_BYTES = 24 << 20


class Node:
    __slots__ = ("children", "label", "owner")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner = label, {}, None


def _common(a: bytes, b: bytes, at: int) -> int:
    """How many bytes `a` shares with `b` from `at` on."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def better(a: tuple, b: tuple) -> tuple:
    """Of two owners (code points, doc_id, rows) the one that stays, with both counts."""
    (points, doc, rows), (points2, doc2, rows2) = a, b
    first = points > points2 or points == points2 and (doc2 is None or doc is not None and doc <= doc2)
    return (points, doc, rows + rows2) if first else (points2, doc2, rows + rows2)


class Trie:
    """Compressed radix trie from byte strings to owners."""

    def __init__(self):
        self.root, self.held = Node(b""), 0

    def insert(self, key: bytes, owner: tuple) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.held += len(child.label) + 200
                node, at = child, len(key)
            elif key.startswith(child.label, at):
                node, at = child, at + len(child.label)
            else:
                shared = _common(child.label, key, at)
                middle = Node(child.label[:shared])
                child.label = child.label[shared:]
                middle.children[child.label[0]] = child
                node.children[middle.label[0]] = middle
                self.held += 200
                node, at = middle, at + shared
        node.owner = owner if node.owner is None else better(node.owner, owner)

    @staticmethod
    def terminals(top: Node, prefix: bytes = b"") -> Iterator[tuple[bytes, tuple]]:
        todo = [(top, prefix)]
        while todo:
            node, prefix = todo.pop()
            key = prefix + node.label
            if node.owner is not None:
                yield key, node.owner
            todo.extend((child, key) for child in node.children.values())

    def spill(self) -> Iterator[tuple[bytes, tuple]]:
        """Takes the largest subtree below the root out of the trie."""

        def size(node: Node) -> int:
            total, todo = 0, [node]
            while todo:
                n = todo.pop()
                total += len(n.label) + 200
                todo.extend(n.children.values())
            return total

        sizes = {first: size(child) for first, child in self.root.children.items()}
        largest = max(sizes, key=sizes.get)
        self.held -= sizes[largest]
        yield from self.terminals(self.root.children.pop(largest))


_PARTIAL = ["n_bytes", "digest", "form", "points", "owner", "rows"]


def _partial_owners(source: DataFrame) -> DataFrame:
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, id_type = Trie(), None

        def rows(found: list[tuple[bytes, tuple]]) -> pa.RecordBatch:
            columns = [
                pa.array([len(form) for form, _ in found], pa.int64()),
                pa.array([hashlib.sha256(form).digest() for form, _ in found], pa.binary()),
                pa.array([form for form, _ in found], pa.binary()),
                pa.array([o[0] for _, o in found], pa.int64()),
                pa.array([o[1] for _, o in found], id_type),
                pa.array([o[2] for _, o in found], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=_PARTIAL)

        def in_runs(found: Iterator[tuple[bytes, tuple]]) -> Iterator[pa.RecordBatch]:
            some, size = [], 0
            for item in found:
                some.append(item)
                size += len(item[0])
                if size >= 4 << 20 or len(some) >= 4096:
                    yield rows(some)
                    some, size = [], 0
            if some:
                yield rows(some)

        for batch in clean_rows(batches):
            id_type = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                points = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
                trie.insert(text.translate(None, SPACE), (points, doc, 1))
            while trie.held > TRIE_BYTES and trie.root.children:
                yield from in_runs(trie.spill())
        yield from in_runs(Trie.terminals(trie.root))

    return source.mapInArrow(run, f"n_bytes long, digest binary, form binary, points long, owner {kind}, rows long")


def _owners(partial: DataFrame) -> DataFrame:
    """(n_bytes, digest, keep_id, group_size): one row per distinct text."""
    kind = partial.schema["owner"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, current, id_type = Trie(), None, None
        out: list[tuple] = []

        def rows() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*out, strict=True)]
            kinds = [pa.int64(), pa.binary(), id_type, pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["n_bytes", "digest", "keep_id", "group_size"])

        def complete() -> None:
            ends = list(Trie.terminals(trie.root))
            if len(ends) > 1:
                raise ValueError("different texts with one SHA-256")
            out.extend((*current, owner[1], owner[2]) for _, owner in ends)

        for batch in clean_rows(batches):
            id_type = batch.schema.field(4).type
            for n, digest, form, points, owner, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (n, digest) != current:
                    if current is not None:
                        complete()
                    trie, current = Trie(), (n, digest)
                trie.insert(form, (points, owner, count))
            if len(out) >= 4096:
                yield rows()
                out.clear()
        if current is not None:
            complete()
            yield rows()

    dealt = partial.repartition("n_bytes", "digest").sortWithinPartitions("n_bytes", "digest")
    return dealt.mapInArrow(run, f"n_bytes long, digest binary, keep_id {kind}, group_size long")


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(n_bytes, digest, keep_id, group_size) of every distinct text."""
    return _owners(_partial_owners(texts(docs, id_col, text_col)))


def form_of(text_col: str):
    """The text without white space, as bytes."""
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"{SPACE_CLASS}+", "").cast("binary")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest."""
    members = (
        docs.select(F.col(id_col).alias("doc_id"), form_of(text_col).alias("_form"))
        .select("doc_id", F.length("_form").cast("long").alias("n_bytes"), F.unhex(F.sha2("_form", 256)).alias("digest"))
    )
    found = members.join(owners(docs, id_col, text_col), ["n_bytes", "digest"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts."""
    digest, mark, owner, owned = (unused(n, docs) for n in ("_digest", "_mark", "_keep", "_owned"))

    def marked(column: Column) -> Column:
        """The doc_id as text, null told apart: plain equality, so join and merge share one exchange."""
        return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))

    keep = owners(docs, id_col, text_col).select(F.col("digest").alias(owned), marked(F.col("keep_id")).alias(owner))
    keyed = docs.withColumn(digest, F.unhex(F.sha2(form_of(text_col), 256))).withColumn(mark, marked(F.col(id_col)))
    same = (F.col(digest) == F.col(owned)) & (F.col(mark) == F.col(owner))
    # Several rows of a text are left only where its owner's doc_id is repeated; one stays.
    return keyed.join(keep, same, "left_semi").dropDuplicates([digest, mark]).drop(digest, mark)


SQL = r"""
WITH forms AS (
    SELECT doc_id, length(coalesce(text, '')) AS points,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS form
    FROM documents
), ranked AS (
    SELECT *, first_value(doc_id) OVER (PARTITION BY form ORDER BY points DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY form) AS group_size
    FROM forms
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(form) AS text_sha256 FROM ranked
"""


@query("op7_exact_dedup", SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
