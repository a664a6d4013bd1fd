from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from tallyscope.llm import suffixes


def brute(texts: list[bytes], length: int) -> list[bytearray]:
    """For each text one byte per byte: 1 where a repeated string covers it."""
    counts = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if counts[t[p : p + length]] > 1:
                covered[p : p + length] = b"\1" * length
        out.append(covered)
    return out


@pytest.mark.parametrize(("letters", "n"), [(1, 400), (2, 2000), (4, 1500), (26, 800), (3, 1), (3, 0)])
def test_suffix_array_and_prefixes(letters, n):
    draw = random.Random(n)
    raw = np.array([97 + draw.randrange(letters) for _ in range(n)], dtype=np.uint8)
    data = raw.tobytes()
    order = suffixes.suffix_array(raw, n + 1).tolist()
    assert order == sorted(range(n), key=lambda i: data[i:])
    shared = suffixes.common_prefixes(raw, np.array(order, dtype=np.int64), 40).tolist()
    for k in range(1, n):
        a, b = data[order[k - 1] :], data[order[k] :]
        most = min(len(a), len(b), 40)
        assert shared[k] == next((i for i in range(most) if a[i] != b[i]), most)


def compare(frame, texts: dict, length: int):
    want = brute(list(texts.values()), length)
    got = {r["doc_id"]: r for r in frame.collect()}
    for doc, covered in zip(texts, want, strict=True):
        flags = np.frombuffer(bytes(covered), dtype=np.uint8)
        begins, ends = suffixes.runs(flags > 0)
        assert [(s["start"], s["end"]) for s in got[doc]["spans"]] == list(zip(begins.tolist(), ends.tolist(), strict=True)), doc
        assert bytes(got[doc]["kept"]) == bytes(b for b, f in zip(texts[doc], covered, strict=True) if not f)
        assert got[doc]["n_bytes"] == len(texts[doc])
        assert got[doc]["kept_text"] == bytes(got[doc]["kept"]).decode("utf-8", "ignore")


@pytest.mark.parametrize("most_contexts", [1024, 2])
def test_documents_match_brute_force(documents, most_contexts):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in documents.collect()}
    compare(suffixes.remove_repeats(documents, most_contexts=most_contexts), texts, suffixes.LENGTH)


def test_short_strings_of_few_letters(spark):
    draw = random.Random(5)
    texts = {i: "".join(draw.choice("ab") for _ in range(draw.randrange(0, 90))).encode() for i in range(60)}
    frame = spark.createDataFrame([(i, t.decode()) for i, t in texts.items()], "doc_id long, text string").repartition(4)
    for gram in (4, 12):
        compare(suffixes.remove_repeats(frame, length=12, gram=gram, most_contexts=8), texts, 12)


def test_long_text_is_cut_into_overlapping_pieces(spark, monkeypatch):
    part = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(3000))
    text = part + "x" + part[:1500]
    frame = spark.createDataFrame([(1, text), (2, "z" * 100)], "doc_id long, text string")
    compare(suffixes.remove_repeats(frame), {1: text.encode(), 2: b"z" * 100}, suffixes.LENGTH)
    pieces = list(suffixes.chunks([b"q" * (3 * suffixes.CHUNK_BYTES)], 400))
    starts = sum(len(p) - 399 for some, _, _ in pieces for p in some)
    assert starts == 3 * suffixes.CHUNK_BYTES - 399


def test_a_cut_through_a_character_leaves_no_part_of_it_in_the_text(spark):
    same = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(420))
    frame = spark.createDataFrame([(1, f"a {same}é b"), (2, f"c {same}ã d")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(frame).collect()}
    assert [bytes(got[i]["kept"]) for i in (1, 2)] == [b"a\xa9 b", b"c\xa3 d"]  # the blank and the first byte of the letter repeat too
    assert [got[i]["kept_text"] for i in (1, 2)] == ["a b", "c d"]


def test_odd_rows(nasty, empty):
    rows = suffixes.remove_repeats(nasty).collect()
    assert len(rows) == nasty.count()
    removed = {(r["doc_id"], r["n_bytes"]): r["n_bytes"] - len(r["kept"]) for r in rows}
    assert removed[1, 0] == removed[2, 0] == 0
    long_bytes = max(r["n_bytes"] for r in rows)
    assert removed[5, long_bytes] == removed[6, long_bytes] == long_bytes
    assert removed[12, 3000] == 3000  # one letter repeats itself
    assert suffixes.remove_repeats(empty).collect() == []
