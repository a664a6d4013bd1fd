from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest

from tallyscope.llm import exact


def form(text: str | None) -> str:
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


def want(rows) -> dict:
    groups = defaultdict(list)
    for r in rows:
        groups[form(r["text"])].append(r)
    out = {}
    for text, own in groups.items():
        best = min(own, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        out[hashlib.sha256(text.encode()).digest()] = (best["doc_id"], len(own))
    return out


@pytest.mark.parametrize("budget", [exact.TRIE_BYTES, 4000])
def test_odd_rows(nasty, monkeypatch, budget):
    monkeypatch.setattr(exact, "TRIE_BYTES", budget)
    rows = exact.duplicates(nasty).collect()
    expected = want(nasty.collect())
    assert len(rows) == nasty.count()
    for r in rows:
        keep, size = expected[bytes(r["digest"])]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, size, r["doc_id"] == keep)


def test_drop_copies_leaves_one_row_a_text(nasty, empty):
    kept = exact.drop_copies(nasty).collect()
    assert kept[0].__fields__ == nasty.columns
    forms = [form(r["text"]) for r in kept]
    assert sorted(forms) == sorted({form(r["text"]) for r in nasty.collect()})
    by_form = {hashlib.sha256(form(r["text"]).encode()).digest(): r["doc_id"] for r in kept}
    assert by_form == {k: v[0] for k, v in want(nasty.collect()).items()}
    assert exact.drop_copies(empty).collect() == [] and exact.duplicates(empty).collect() == []


def test_trie_against_dictionary():
    draw = random.Random(4)
    trie, plain = exact.Trie(), {}
    for _ in range(3000):
        key = bytes(draw.choice(b"ab") for _ in range(draw.randrange(0, 14)))
        owner = (draw.randrange(3), draw.choice([None, *range(9)]), 1)
        trie.insert(key, owner)
        plain[key] = owner if key not in plain else exact.better(plain[key], owner)
    spilled = list(trie.spill())
    rest = list(exact.Trie.terminals(trie.root))
    assert spilled and len(spilled) + len(rest) == len(plain)
    assert dict(spilled + rest) == plain


def test_better_is_points_then_smallest_id():
    assert exact.better((3, 9, 2), (3, 4, 1)) == (3, 4, 3)
    assert exact.better((3, None, 1), (3, 4, 1)) == (3, 4, 2)
    assert exact.better((4, None, 1), (3, 4, 1)) == (4, None, 2)
