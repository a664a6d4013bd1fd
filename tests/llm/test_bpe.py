from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as vocabularies
import pytest
import tiktoken

from tallyscope.llm import bpe

RANKS = vocabularies.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    with open(RANKS, "rb") as f:
        return bpe.Encoder(f.read(), vocabularies.PATTERN)


def test_every_character_and_all_kinds_of_space(library, encoder):
    draw = random.Random(2)
    texts = [
        "".join(f"{chr(c)}a " for c in range(0x20000) if not 0xD800 <= c <= 0xDFFF),
        "".join(draw.choice(" \t\n\r\x0b\x1c\x1f\x85\xa0 　ab'1.s") for _ in range(50_000)),
        "x" * 5000,
        "".join(draw.choice("abcdefgh") for _ in range(6000)),
        "it's we'll <|endoftext|>",
        "",
    ]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode_ordinary(text)


def test_long_and_short_trees_agree(encoder):
    draw = random.Random(3)
    words = [bytes(draw.choice(b"etaoin shrdlu") for _ in range(n)) for n in (2, 3, 8, 9, 64, 65, 200, 256)]
    assert encoder.merger.encode_many(words) == [
        encoder.merger._encode_long(w) if w not in encoder.merger.rank else encoder.merger.rank[w].to_bytes(4, "little") for w in words
    ]


def test_memory_starts_anew(encoder, monkeypatch):
    want = encoder.encode(["one two three", "four five"])
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 2)
    assert encoder.encode(["one two three", "four five"]) == want


def test_query_matches_library(spark, sf_dir, documents, library):
    got = {r["doc_id"]: r for r in bpe.op3(spark, sf_dir).collect()}
    for row in documents.collect():
        text = row["text"] or ""
        ids = library.encode_ordinary(text)
        r = got[row["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows(spark, nasty, empty, library):
    encoded = bpe.encode(nasty, RANKS, vocabularies.PATTERN)
    rows = bpe.decode(encoded, RANKS).collect()
    want = sorted((str(r["doc_id"]), library.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in nasty.collect())
    assert sorted((str(r["doc_id"]), r["ids"], bytes(r["decoded"])) for r in rows) == want
    assert bpe.decode(bpe.encode(empty, RANKS, vocabularies.PATTERN), RANKS).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, [72]), (3, [])], "decoded_id int, ids array<int>")
    assert [r["out"] if r["out"] is None else bytes(r["out"]) for r in bpe.decode(nulls, RANKS, out="out").orderBy("decoded_id").collect()] == [None, library.decode_bytes([72]), b""]
