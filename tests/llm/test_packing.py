from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as vocabularies
from tokenizers import Tokenizer

from tallyscope.llm import packing

PATH = vocabularies.path("word_bpe_49k.json")


def check(pieces, docs, size: int) -> float:
    """All ids of all documents in exactly one piece each, sequences without gaps; their fill."""
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for row in docs:
        ids = np.array([*tokenizer.encode(row["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want.append((row["doc_id"], ids))
    total = sum(len(ids) for _, ids in want)
    assert sum(p["length"] for p in pieces) == total
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"], p["doc_tokens"]].append(p)
    for doc, ids in want:
        own = sorted(by_doc[doc, len(ids)], key=lambda p: p["start"])
        assert any(p["start"] == 0 for p in own)
        for p in own:
            part = ids[p["start"] : p["start"] + p["length"]].tobytes()
            assert zlib.crc32(part) == p["ids_crc32"] or sum(d == doc for d, _ in want) > 1
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append(p)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= size and all(p["sequence_length"] == at for p in own)
    return total / (size * len(sequences))


def test_documents(spark, sf_dir, documents):
    assert check(packing.op8(spark, sf_dir).collect(), documents.collect(), 2048) > 0.95


def test_leftovers_meet_in_rounds(documents):
    pieces = packing.pack(documents.repartition(7), PATH, size=256, windows=4, gap=4, fan_in=2).collect()
    assert check(pieces, documents.collect(), 256) > 0.95


def test_odd_rows(nasty, empty):
    pieces = packing.pack(nasty, PATH, size=512, windows=2, gap=0).collect()
    assert check(pieces, nasty.collect(), 512) > 0.8
    assert {p["length"] for p in pieces if p["doc_id"] in (1, 2, 3)} == {1}
    assert packing.pack(empty, PATH).collect() == []


def test_best_fit_and_fullest_first():
    packer = packing.Packer(size=10, windows=2, gap=1, first=100)
    for name, length in (("a", 7), ("b", 5), ("c", 3), ("d", 4)):
        packer.add((name,), length)
    # c fits a (room 3) better than b (room 5) and completes it; d completes nothing.
    assert [w.number for w in packer.done] == [100]
    assert sorted((w.number, w.used) for w in packer.open.values()) == [(101, 9)]
    packer.add(("e",), 6)
    assert packer.room_for(7) == 7  # the fullest has room 1, not above the gap: it goes as it is
    packer.add(("f",), 7)
    assert [w.number for w in packer.done] == [100, 101]


ODD = [
    b"<|startoftext|>", b"a<|endoftext|>b", b"it's", b"!'s", b"'S", b"I'LL!!'ve'd'x", b"x'", b"''s", b"\x1c\x7f", b"A1b2--9'm", b"don't.can't",
    "Àßÿ×÷".encode(), "été".encode(), "µªº1½".encode(), "İĀǅ".encode(), "中文\U0001f600".encode(), b"\xff\xfea", b"",
]


def test_words_are_cut_as_the_tokenizer_cuts_them():
    whole, cut = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    rng = random.Random(5)
    signs = "'stremvldSTRELaZ09<|>!-~ÀßÿéÉµĀ́"
    made = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 12))).encode() for _ in range(5000)]
    assert cut.cuts
    for word in ODD + made:
        ids = whole.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        assert cut[word] == b"".join(i.to_bytes(4, "little") for i in ids), word


def test_new_words_of_known_matches_need_no_tokenizer():
    cut = packing.WordIds(PATH)
    known = cut[b"hello"] + cut[b"!!"]
    cut.tokenizer = cut.matches.tokenizer = cut.matches.model = None
    assert cut[b"HELLO!!"] == known
