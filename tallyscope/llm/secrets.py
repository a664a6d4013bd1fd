"""Secret scans: keyword prefilter, anchored patterns, embedded checksums.

One Aho-Corasick pass over a text finds keywords in either case, a second one, over the
text folded to hex digits and everything else, finds long runs of hex digits. Patterns
are tried only at such hits, in order and behind the previous match of their kind, which
gives the same matches as a search of the whole text. Tokens that carry a checksum (kinds
`github` and `npm`: the last six characters are the CRC-32 of the thirty before, in base
62) count only if it holds.

Offsets are code points, the end exclusive. Results by case: a null or empty text has no
spans; repeated rows are scanned each; a null doc_id is carried; matches of different
kinds may overlap and are all reported; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clean_rows, documents, query, texts

# Kinds in the order of reports, their patterns and least lengths.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm")
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "apikey": "assign",
    "api_key": "assign",
    "akia": "access",
    "ghp_": "github",
    "gho_": "github",
    "ghu_": "github",
    "ghs_": "github",
    "ghr_": "github",
    "npm_": "npm",
}
HEX_LENGTH = 24
PATTERNS = {
    "assign": re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "hex": re.compile(rb"[0-9a-f]+"),
    "github": re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
}
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_HEX_FOLD = bytes(ord("h") if chr(b) in "0123456789abcdef" else ord(".") for b in range(256))


def checksum(payload: bytes) -> bytes:
    """CRC-32 in base 62, six digits."""
    value, digits = zlib.crc32(payload), []
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits.append(BASE62[digit])
    return bytes(reversed(digits))


def _accepted(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[1]) >= 6
    if kind == "access":
        return len(match[0]) >= 20
    if kind == "hex":
        return len(match[0]) >= HEX_LENGTH
    return checksum(match[0][4:34]) == match[0][34:]


def automata() -> tuple:
    import ahocorasick

    keywords, runs = ahocorasick.Automaton(), ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        keywords.add_word(word, (len(word), kind))
    runs.add_word("h" * HEX_LENGTH, (HEX_LENGTH, "hex"))
    keywords.make_automaton()
    runs.make_automaton()
    return keywords, runs


def find(text: bytes, machines: tuple) -> list[tuple[int, int, int, int]]:
    """(start, kind's number, end, start of the secret part), in bytes, in report order."""
    keywords, runs = machines
    past = dict.fromkeys(KINDS, 0)
    out = []
    # As Latin-1 every byte is one character, so hits are byte offsets.
    for machine, folded in ((keywords, text.lower()), (runs, text.translate(_HEX_FOLD))):
        hits = sorted({(end + 1 - length, kind) for end, (length, kind) in machine.iter(folded.decode("latin-1"))})
        for start, kind in hits:
            if start < past[kind]:
                continue
            match = PATTERNS[kind].match(text, start)
            if match:
                past[kind] = match.end()
                if _accepted(kind, match):
                    out.append((start, KINDS.index(kind), match.end(), match.start(1) if kind == "assign" else start))
    return sorted(out)


def _points(text: bytes, spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans with offsets in code points."""
    if not spans or text.isascii():
        return [(start, kind, end) for start, kind, end, _ in spans]
    offsets = sorted({x for start, _, end, _ in spans for x in (start, end)})
    at, points, seen = 0, {}, 0
    for offset in offsets:
        seen += len(text[at:offset].decode("utf-8", "replace"))
        points[offset], at = seen, offset
    return [(points[start], kind, points[end]) for start, kind, end, _ in spans]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, spans array<struct<kind, start, end>> in report order."""
    source = texts(docs, id_col, text_col)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = automata()
        for batch in clean_rows(batches):
            found = [
                [{"kind": KINDS[kind], "start": start, "end": end} for start, kind, end in _points(text, find(text, machines))]
                for text in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span)], names=["doc_id", "spans"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long>>")


def masked(text: bytes, spans: list[tuple[int, int, int, int]]) -> bytes:
    """The text with each secret part replaced by its kind in brackets; overlapping ones by the first's."""
    out, at = [], 0
    for secret, end, kind in sorted((secret, end, kind) for _, kind, end, secret in spans):
        if secret >= at:
            out += [text[at:secret], b"[", KINDS[kind].encode(), b"]"]
        at = max(at, end)
    return b"".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The input with secrets masked in its text, and its length column set anew where a text changed.

    Null texts stay null; all other columns are passed on as they are.
    """
    names, schema = docs.columns, docs.schema
    at = names.index(text_col)
    length_at = names.index(length_col) if length_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = automata()
        for batch in clean_rows(batches):
            columns = list(batch.columns)
            before = [None if t is None else t.encode() for t in columns[at].to_pylist()]
            after = [t and masked(t, find(t, machines)) for t in before]
            columns[at] = pa.array([None if t is None else t.decode("utf-8", "replace") for t in after], columns[at].type)
            if length_at is not None:
                old = columns[length_at].to_pylist()
                new = [n if a == b else len(b.decode("utf-8", "replace")) for n, a, b in zip(old, before, after, strict=True)]
                columns[length_at] = pa.array(new, columns[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of `scan`'s spans."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@query("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scan(documents(spark, sf_dir)))
