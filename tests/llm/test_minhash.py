from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from tallyscope.llm import minhash


def sets(rows, k: int) -> list[frozenset]:
    out = []
    for r in rows:
        words = (r["text"] or "").encode().lower().split()
        width = min(k, len(words))
        out.append(frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if words else frozenset())
    return out


def brute(rows, k: int, num: int, den: int) -> list[tuple]:
    members = sets(rows, k)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    places = defaultdict(list)
    for i, s in enumerate(members):
        for x in s:
            places[x].append(i)
    pairs = {(a, b) for own in places.values() for a in own for b in own if a < b}
    for a, b in pairs:
        shared = len(members[a] & members[b])
        if den * shared >= num * len(members[a] | members[b]):
            root[find(a)] = find(b)
    least: dict[int, int | None] = {}
    for i, r in enumerate(rows):
        top, old = find(i), least.get(find(i))
        least[top] = r["doc_id"] if old is None else old if r["doc_id"] is None else min(old, r["doc_id"])
    return [(r["doc_id"], len(members[i]), least[find(i)] if members[i] else r["doc_id"]) for i, r in enumerate(rows)]


def check(frame, k, similarity, **options):
    got = minhash.near_duplicates(frame, k=k, similarity=similarity, **options).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got))) == sorted(map(str, brute(frame.collect(), k, *similarity)))


def family(seed: int, n: int, edits: int) -> list[str]:
    """Texts that differ from one base in a few words each, so links form chains."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(500)}" for _ in range(150)]
    out = []
    for _ in range(n):
        words = base.copy()
        for _ in range(draw.randrange(edits)):
            words[draw.randrange(len(words))] = f"x{draw.randrange(10_000)}"
        out.append(" ".join(words))
    return out


def test_families_with_links_near_the_threshold(spark):
    texts = [t for seed in range(6) for t in family(seed, 40, 12)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    check(frame, 3, (85, 100), bands=40, rows=5)


def test_bands_in_blocks_give_the_same(spark):
    texts = [t for seed in range(2) for t in family(seed, 60, 9)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    check(frame, 3, (85, 100), bands=40, rows=5, block=7)


def test_odd_rows(nasty, empty):
    check(nasty, 5, (80, 100))
    assert minhash.near_duplicates(empty).collect() == []


def test_drop_near_copies(nasty):
    kept = minhash.drop_near_copies(nasty)
    assert kept.columns == nasty.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert {1, 2, 3, 4, 5, 7, 11} <= set(ids) and not {6, 8, 9, 10} & set(ids)


def test_estimate_takes_out_chance_collisions():
    minima, count = minhash.Minima(200), 200
    draw = np.random.default_rng(1)
    pool = np.unique(draw.integers(0, 1 << 63, 4000, dtype=np.uint64))
    proposer = minhash.Proposer(count, 85, 100)
    for similarity, passes in ((0.95, True), (0.3, False)):
        n, shared = 1000, int(1000 * 2 * similarity / (1 + similarity))
        a, b = pool[:n], np.unique(np.concatenate([pool[:shared], pool[2000 : 2000 + n - shared]]))
        sketch = np.stack([np.frombuffer(minhash.packed(minima.of(s)).tobytes() + minhash.parity(s).tobytes(), dtype=np.uint64) for s in (a, b)])
        likely = proposer.likely(np.array([0]), np.array([1]), np.array([1, 2]), np.array([n, n]), sketch)
        assert (len(likely[0]) == 1) == passes


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r["node"]: r["comp"] for r in minhash.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("size", [0, 1, 2, 3])
def test_short_texts_are_one_shingle(size):
    members = minhash.shingles(b"one two three"[: [0, 3, 7, 13][size]], 3, minhash.WordHashes())
    assert len(members) == (0 if size == 0 else 1)


def test_recall_at_the_pipelines_setting(spark):
    """Five words, 0.8, 48 bands of 4: every pair of one component by brute force is found."""
    from collections import Counter, defaultdict

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {}
    for r in docs.collect():
        words = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else ({tuple(words)} if words else set())
    held = defaultdict(list)
    for doc, own in sets.items():
        for x in own:
            held[x].append(doc)
    shared = Counter((a, b) for own in held.values() for i, a in enumerate(own) for b in own[i + 1 :])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, k=5, similarity=(80, 100), bands=48, rows=4).collect()}
    want = {d: find(d) for d in sets}
    joined = [d for d, c in want.items() if c != d]
    recall = sum(found[d] == want[d] for d in joined) / len(joined)
    assert joined and recall == 1.0 and found == want
