"""Near duplicates by b-bit MinHash.

A document's set is the hashes (64 bits) of its distinct word shingles; documents with one
set are a class, and classes are what is compared. Each set gets `bands` x `rows` minima.
Classes that share a band of minima are candidates. Of each minimum BITS low bits are kept
in a packed signature; the share of equal fields, found by counting bits, estimates the
similarity after the collisions that chance brings are taken out. Candidates whose estimate
is six standard deviations below the threshold go, as do those that a parity sketch rules
out for certain (each element in one set alone flips one bit at most, so more different
bits than the threshold allows elements prove the sets too far apart). What remains is
confirmed on full sets.

Only components are asked for, so not all links of a band are followed: each band first
proposes a forest, its likeliest candidates that join parts not joined yet. Links that are
confirmed join components, refuted ones are remembered, and rounds go on until no band has a
candidate left between two components. In round r each class proposes its 16^(r - 1)
likeliest partners that are left, so a band of n classes is done after log16(n) rounds and
has proposed few more pairs than had to be refuted. A band with more than `block` classes is
dealt out as pairs of blocks.

A pair at the threshold shares no band with probability (1 - similarity^rows)^bands: 7e-11
for 0.85 with 40 bands of 5, 1e-11 for 0.8 with 48 bands of 4.

Results by case: null and empty texts, and those without words, have an empty set, no link
and are their own component; very long texts are whole sets; repeated rows are copies of
each other; a null doc_id is never a component's name unless all are null; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.session import stored

from .common import clean_rows, documents, query, row_key, without

BITS = 4
PARITY_BITS = 512
MEMO_ENTRIES = 400_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of a word."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO_ENTRIES:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes, k: int, memo: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; of a shorter text one for all its words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(k, len(words))
    out = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        out = _mixed(out * _ODD + hashes[i : len(hashes) - width + 1 + i])
    return np.unique(out)


class Minima:
    """`count` minima of a set under random linear functions of the hashes' high halves."""

    def __init__(self, count: int, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.factor = draw.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1)
        self.shift = draw.integers(0, 1 << 32, count, dtype=np.uint32)

    def of(self, members: np.ndarray) -> np.ndarray:
        high = (members >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.factor), np.iinfo(np.uint32).max, dtype=np.uint32)
        for at in range(0, len(high), 512):
            np.minimum(low, (high[at : at + 512, None] * self.factor + self.shift).min(axis=0), out=low)
        low = (low ^ (low >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        return low ^ (low >> np.uint32(13))


def band_hashes(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for column in minima.reshape(bands, rows).T:
        out = _mixed(out * _ODD + column.astype(np.uint64))
    return out.view(np.int64)


def packed(minima: np.ndarray) -> np.ndarray:
    """The low bits of the minima, 64 / BITS fields to a number."""
    fields = 64 // BITS
    low = np.zeros(-(-len(minima) // fields) * fields, dtype=np.uint64)
    low[: len(minima)] = minima & np.uint32((1 << BITS) - 1)
    shifts = np.arange(fields, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low.reshape(-1, fields) << shifts, axis=1).view(np.int64)


def parity(members: np.ndarray) -> np.ndarray:
    """One bit per cell: whether an odd number of members falls there."""
    cells = np.bincount((members & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS)
    return np.packbits((cells & 1).astype(np.uint8))


def _signed(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, row_key, n, node (hash of the set, null if empty), band hashes, sketch."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        memo, minima = WordHashes(), Minima(bands * rows)
        for batch in clean_rows(batches, 512):
            sizes, nodes, band_lists, sketches = [], [], [], []
            for text in batch.column(2).to_pylist():
                members = shingles(text, k, memo)
                sizes.append(len(members))
                if len(members):
                    low = minima.of(members)
                    nodes.append(xxhash.xxh3_64_intdigest(members.tobytes()) - (1 << 63))
                    band_lists.append(band_hashes(low, bands, rows))
                    sketches.append(packed(low).tobytes() + parity(members).tobytes())
                else:
                    nodes.append(None)
                    band_lists.append(None)
                    sketches.append(None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                 pa.array(band_lists, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                names=["doc_id", "row_key", "n", "node", "bands", "sketch"],
            )

    return docs.mapInArrow(run, f"doc_id {kind}, row_key long, n long, node long, bands array<long>, sketch binary")


@lru_cache(maxsize=64)
def _few_pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _all_pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j below n; only those of small n are kept for the next band of that size."""
    return _few_pairs(n) if n <= 64 else np.triu_indices(n, 1)


class Proposer:
    """Proposes forests of likely pairs for bands."""

    def __init__(self, count: int, num: int, den: int):
        self.num, self.den = num, den
        chance, level = 2.0**-BITS, num / den
        self.words = -(-count * BITS // 64)
        least = max(0.0, level - 6 * (level * (1 - level) / count) ** 0.5)
        # Least number of equal fields: the collision-corrected estimate solved for it.
        self.most_unequal = count - int(np.floor(count * (chance + (1 - chance) * least)))

    def likely(self, a: np.ndarray, b: np.ndarray, comp: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, ...]:
        """Those of the pairs that may be links, with their numbers of unequal fields."""
        small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        go = (comp[a] != comp[b]) & (small * self.den >= large * self.num)
        a, b = a[go], b[go]
        kept = []
        for at in range(0, len(a), 1 << 16):
            x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            differ = sketch[x, : self.words] ^ sketch[y, : self.words]
            differ |= differ >> np.uint64(2)
            differ |= differ >> np.uint64(1)
            unequal = np.bitwise_count(differ & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)
            odd = np.bitwise_count(sketch[x, self.words :] ^ sketch[y, self.words :]).sum(axis=1, dtype=np.int64)
            go = (unequal <= self.most_unequal) & (odd * (self.den + self.num) <= (n[x] + n[y]) * (self.den - self.num))
            kept.append((x[go], y[go], unequal[go]))
        return tuple(map(np.concatenate, zip(*kept, strict=True))) if kept else (a, b, a)

    def forest(self, a: np.ndarray, b: np.ndarray, unequal: np.ndarray, comp: np.ndarray, refuted: dict[int, set], node: np.ndarray) -> list[tuple[int, int]]:
        """Of the likely pairs of one band a forest over its components, likeliest first."""
        order = np.argsort(unequal, kind="stable")
        a, b = a[order], b[order]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out, step = [], 256
        while len(a):
            for i, j in zip(a[:step].tolist(), b[:step].tolist(), strict=True):
                u, v = find(int(comp[i])), find(int(comp[j]))
                if u != v and int(node[j]) not in refuted.get(int(node[i]), ()):
                    root[u] = v
                    out.append((int(node[i]), int(node[j])))
            a, b = a[step:], b[step:]
            if len(a):  # what is joined by now needs no look one by one
                labels = np.array([find(int(c)) for c in comp.tolist()])
                go = labels[a] != labels[b]
                a, b, step = a[go], b[go], step * 2
        return out

    def partners(self, a: np.ndarray, b: np.ndarray, unequal: np.ndarray, width: int, refuted: dict[int, set], node: np.ndarray) -> list[tuple[int, int]]:
        """Of the likely pairs of one band each class's `width` likeliest that are not refuted."""
        order = np.argsort(unequal, kind="stable")
        taken: dict[int, int] = {}
        out = []
        for i, j in zip(node[a[order]].tolist(), node[b[order]].tolist(), strict=True):
            if (taken.get(i, 0) < width or taken.get(j, 0) < width) and j not in refuted.get(i, ()):
                taken[i], taken[j] = taken.get(i, 0) + 1, taken.get(j, 0) + 1
                out.append((i, j))
        return out


def _proposed(rows: DataFrame, count: int, num: int, den: int, width: int) -> DataFrame:
    """Pairs (a, b) of nodes that each band proposes: a forest (width 1), or `width` for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proposer = Proposer(count, num, den)
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(table: pa.Table) -> pa.RecordBatch:
            columns = {c: table.column(c).to_numpy() for c in ("key", "left", "right", "block", "node", "comp", "n")}
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint64).reshape(table.num_rows, -1)
            refuted: dict[int, set] = {}
            if table.column("refuted").null_count < table.num_rows:
                for node, others in zip(columns["node"].tolist(), table.column("refuted").to_pylist(), strict=True):
                    if others:
                        refuted.setdefault(node, set()).update(others)
            ids = np.stack([columns[c] for c in ("key", "left", "right")], axis=1)
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            out: list[tuple[int, int]] = []
            pending_a, pending_b, owner, total = [], [], [], 0

            def propose() -> None:
                a, b, unequal = proposer.likely(np.concatenate(pending_a), np.concatenate(pending_b), columns["comp"], columns["n"], sketch)
                band = group[a]
                sort = np.argsort(band, kind="stable")
                for part in np.split(sort, np.flatnonzero(np.diff(band[sort])) + 1):
                    if len(part):
                        begin, end = begins[band[part[0]]], ends[band[part[0]]]
                        some, node = (a[part] - begin, b[part] - begin, unequal[part]), columns["node"][begin:end]
                        if width == 1:
                            out.extend(proposer.forest(*some, columns["comp"][begin:end], refuted, node))
                        else:
                            out.extend(proposer.partners(*some, width, refuted, node))

            begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [table.num_rows]])
            group = np.repeat(np.arange(len(begins)), ends - begins)
            for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
                left, right = columns["left"][begin], columns["right"][begin]
                if left == right:
                    a, b = _all_pairs(end - begin)
                else:
                    block = columns["block"][begin:end]
                    a, b = (x.ravel() for x in np.meshgrid(np.flatnonzero(block == left), np.flatnonzero(block == right)))
                pending_a.append(a + begin)
                pending_b.append(b + begin)
                total += len(a)
                if total >= 1 << 19:
                    propose()
                    pending_a.clear()
                    pending_b.clear()
                    total = 0
            if pending_a:
                propose()
            pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], names=["a", "b"])

        # A run of rows ends where a band does; the last band of a batch waits for the next batch.
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            table = pa.Table.from_batches(held)
            ids = [table.column(c).to_numpy() for c in ("key", "left", "right")]
            new = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in ids])) + 1
            if len(new) and size >= 2048:
                yield flush(table.slice(0, int(new[-1])))
                rest = table.slice(int(new[-1])).combine_chunks()
                held, size = rest.to_batches(), rest.num_rows
        if size:
            yield flush(pa.Table.from_batches(held))

    dealt = rows.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, bodies: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b, is_link) on full sets. Pairs meet at a; a node with many pairs is dealt out in parts."""
    parts = pairs.groupBy(F.col("a").alias("_a")).agg(F.ceil(F.count("*") / 256).alias("parts"))
    split = pairs.join(parts, F.col("a") == F.col("_a")).select("a", "b", "parts")
    members = split.select("a", F.pmod(F.col("b"), F.col("parts")).alias("part"), F.lit(True).alias("is_member"), F.col("b").alias("node"))
    heads = parts.select(F.col("_a").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("is_member"), F.col("_a").alias("node"))
    wanted = members.unionByName(heads).join(bodies, "node").select("a", "part", "is_member", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, head, own = WordHashes(), None, np.zeros(0, dtype=np.uint64)
        for batch in clean_rows(batches, 256):
            out = []
            for a, _part, is_member, node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                members = shingles(text, k, memo)
                if not is_member:
                    head, own = a, members
                else:
                    if head != a:
                        raise ValueError("a member came before its head")
                    shared = len(np.intersect1d(own, members, assume_unique=True))
                    out.append((a, node, den * shared >= num * (len(own) + len(members) - shared)))
            columns = zip(*out, strict=True) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["a", "b", "is_link"])

    dealt = wanted.repartition("a", "part").sortWithinPartitions("a", "part", "is_member")
    return dealt.mapInArrow(run, "a long, b long, is_link boolean")


# A large component's name is met by its members in this many places.
SALTS = 16


def _with_names(rows: DataFrame, column: str, names: DataFrame, how: str) -> DataFrame:
    """rows (with `node`) joined with names (_at, ...) where `column` is `_at`. One component may hold
    most rows, so its members are dealt out by their node and its name is there once per salt."""
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    spread = names.withColumn("_salt", salts)
    same = (F.col(column) == F.col("_at")) & (F.pmod("node", F.lit(SALTS).cast("long")) == F.col("_salt"))
    # Names grow with the data: they are never sent to all executors.
    return rows.join(spread.hint("merge"), same, how).drop("_at", "_salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): smallest node that each node of the edges (a, b) reaches.

    Labels go along edges and then jump to their label's label, so the rounds needed grow
    with the logarithm of the longest path.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    while True:
        told = both.join(labels, both["a"] == labels["node"]).groupBy(F.col("b").alias("_to")).agg(F.min("comp").alias("_told"))
        lower = labels.join(told, F.col("node") == F.col("_to"), "left").select("node", F.col("comp").alias("_old"), F.least("comp", "_told").alias("_new"))
        # Only nodes that have moved lead further.
        jump = labels.filter("comp <> node").select(F.col("node").alias("_at"), F.col("comp").alias("_next"))
        moved = stored(_with_names(lower, "_new", jump, "left").select("node", "_old", F.least("_new", "_next").alias("comp")), "labels")
        labels = moved.select("node", "comp")
        if moved.filter("comp <> _old").isEmpty():
            return labels


def near_duplicates(
    docs: DataFrame,
    k: int = 5,
    similarity: tuple[int, int] = (80, 100),
    bands: int = 48,
    rows: int = 4,
    block: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, row_key, n_shingles, component_id (smallest doc_id that
    links reach), kept (doc_id = component_id)."""
    num, den = similarity
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    source = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row_key"), text.alias("text"))
    signed = stored(_signed(source, k, bands, rows), "signatures")
    classes = stored(signed.filter("node IS NOT NULL").dropDuplicates(["node"]), "classes")
    placed = classes.select("node", F.explode("bands").alias("key"))
    crowds = placed.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("crowd")).filter("crowd > 1")
    placed = stored(placed.join(crowds, F.col("key") == F.col("_key")).select("key", "node", "crowd"), "bands")
    # Texts of the classes that share a band; later rounds read only these.
    needed = placed.select("node").distinct()
    reps = classes.select("node", F.col("row_key").alias("_key"), F.col("doc_id").alias("_doc")).join(needed, "node")
    same = (source["row_key"] == reps["_key"]) & source["doc_id"].eqNullSafe(reps["_doc"])
    # A row that is there twice has one key: its class still gets one text.
    bodies = stored(source.join(reps, same).select("node", "text").dropDuplicates(["node"]), "texts")

    comp: DataFrame | None = None
    refuted: DataFrame | None = None
    width = 1
    while True:
        at = placed.withColumn("comp", F.col("node"))
        if comp is not None:
            label = comp.select(F.col("node").alias("_node"), F.col("comp").alias("_comp"))
            at = placed.join(label, F.col("node") == F.col("_node"), "left").select("key", "node", "crowd", F.coalesce("_comp", "node").alias("comp"))
            mixed = at.groupBy(F.col("key").alias("_key")).agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).filter("_low < _high")
            at = at.join(mixed, F.col("key") == F.col("_key"), "left_semi")
        at = at.join(classes.select("node", "n", "sketch"), "node")
        if refuted is None:
            at = at.withColumn("refuted", F.lit(None).cast("array<long>"))
        else:
            both = refuted.select("a", "b").unionByName(refuted.select(F.col("b").alias("a"), F.col("a").alias("b")))
            at = at.join(both.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("refuted")), "node", "left")
        blocks = F.ceil(F.col("crowd") / block)
        at = at.withColumn("block", F.pmod(F.col("node"), blocks)).withColumn(
            "_pair",
            F.explode(F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.struct(F.least(F.col("block"), j).alias("left"), F.greatest(F.col("block"), j).alias("right")))),
        )
        at = at.select("key", "_pair.left", "_pair.right", "block", "node", "comp", "n", "sketch", "refuted")
        pairs = stored(_proposed(at, bands * rows, num, den, width), "pairs")
        width *= 16
        if pairs.isEmpty():
            break
        judged = stored(_confirmed(pairs, bodies, k, num, den), "judged")
        links, wrong = judged.filter("is_link").select("a", "b"), judged.filter("NOT is_link").select("a", "b")
        refuted = wrong if refuted is None else refuted.unionByName(wrong)
        if links.isEmpty():
            continue
        if comp is not None:  # labels of all that was joined before are links themselves
            links = links.unionByName(comp.filter("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b")))
        comp = components(links)

    named = signed.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    if comp is not None:
        label = comp.select(F.col("node").alias("_node"), F.col("comp").alias("_comp"))
        joined = named.join(label, F.col("node") == F.col("_node"), "left").select("node", "least", F.coalesce("_comp", "node").alias("comp"))
        lowest = joined.groupBy(F.col("comp").alias("_at")).agg(F.min("least").alias("component_id"))
        named = _with_names(joined, "comp", lowest, "inner").select("node", "component_id")
    else:
        named = named.withColumnRenamed("least", "component_id")
    found = signed.select("doc_id", "row_key", "node", F.col("n").alias("n_shingles")).join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "row_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay: one document of each component."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    return without(docs, found.filter("NOT kept"), id_col, text_col)


SQL = r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^ 	-
]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE
        WHEN len(w) = 0 THEN []
        WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    END AS s
    FROM worded
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS both_have
    FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY ALL
), links AS (SELECT a, b FROM shared WHERE 100 * both_have >= 85 * (na + nb - both_have)),
reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), named AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN named USING (doc_id)
"""


@query("op6_minhash", SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir), k=3, similarity=(85, 100), bands=40, rows=5)
    return found.drop("row_key")
