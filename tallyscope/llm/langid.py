"""Language identification by cross-parsing.

For each language a suffix automaton of labelled texts is built. A text is parsed against it
from left to right into phrases, each the longest match that the sample has, and the language
whose sample needs the fewest phrases, each weighed by the bits that name a place in the
sample, wins. Texts and samples are normalised first: letters (Unicode's category L) in lower
case, everything between words one blank. Whole texts are parsed; a phrase can span words.

Many texts are parsed side by side: they are cut into segments, each parsed as if a phrase
began there, all segments and languages one step at a time. Then each segment is entered again
with the state that the one before ends in, until a phrase begins where one began before; from
there on both parses are the same. So the phrases are those of one parse from left to right.

What is learned is bounded: `most_docs` labelled texts of each language, taken whole, among
those of at most `most_chars` characters, and `most_languages` languages, which is checked.

Results by case: a null text, or one without a letter, is `und` with score 0; texts of any
length are parsed whole, in blocks; ties go to the language that comes first; a null doc_id is
not held out and not learned from; repeated rows are predicted each; without labelled text all
is `und`; an empty table gives an empty table.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clean_rows, documents, query, texts

UNKNOWN = "und"
# Characters that are parsed side by side, and those of one segment.
BLOCK_CHARS, SEGMENT = 1 << 20, 512


def _letters() -> np.ndarray:
    """The lower-case form of every code point that is a letter, 0 for the others."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for code in range(sys.maxunicode + 1):
        if unicodedata.category(chr(code))[0] == "L":
            lower = chr(code).lower()
            table[code] = ord(lower) if len(lower) == 1 else code
    return table


_TABLES: dict[str, np.ndarray] = {}


def normalised(text: str) -> np.ndarray:
    """Code points of the words in lower case, with 0 for the blanks before, between and after them."""
    if not _TABLES:
        _TABLES["lower"] = _letters()
    codes = _TABLES["lower"][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    held = np.zeros(len(codes) + 2, dtype=np.uint32)
    held[1:-1] = codes
    stays = np.ones(len(held), dtype=bool)
    stays[1:] = (held[1:] != 0) | (held[:-1] != 0)
    return held[stays]


def spelled(codes: np.ndarray) -> str:
    """Normalised code points as text, blanks as spaces."""
    return np.where(codes == 0, 32, codes).astype("<u4").tobytes().decode("utf-32-le")


class Automaton:
    """Suffix automaton of a text: follows the longest match of what it reads."""

    def __init__(self, text: str):
        step: dict[int, int] = {}  # state << 21 | character -> state
        length, link, out = [0], [-1], [[]]
        last = 0
        for character in map(ord, text):
            state = len(length)
            length.append(length[last] + 1)
            link.append(0)
            out.append([])
            at = last
            while at != -1 and (at << 21 | character) not in step:
                step[at << 21 | character] = state
                out[at].append(character)
                at = link[at]
            if at != -1:
                target = step[at << 21 | character]
                if length[at] + 1 == length[target]:
                    link[state] = target
                else:
                    copy = len(length)
                    length.append(length[at] + 1)
                    link.append(link[target])
                    out.append(out[target].copy())
                    for c in out[target]:
                        step[copy << 21 | c] = step[target << 21 | c]
                    while at != -1 and step.get(at << 21 | character) == target:
                        step[at << 21 | character] = copy
                        at = link[at]
                    link[target] = link[state] = copy
            last = state
        self.step, self.states = step, len(length)
        self.bits = log2(len(text) + 2)

    def phrases(self, text: str) -> int:
        """Phrases of the greedy parse; a character that the sample lacks is a phrase."""
        step, state, count = self.step.get, 0, 0
        for character in map(ord, text):
            following = step(state << 21 | character)
            if following is None:
                if state:
                    count += 1
                following = step(character)
                if following is None:
                    count += 1
                    following = 0
            state = following
        return count + (state != 0)


class Parser:
    """Phrases and bits that each language needs for normalised texts.

    samples: (language, spelled text). States of all languages share one table of next states,
    a row of it per state and a column per character; -1 is no match.
    """

    def __init__(self, samples: list[tuple[str, str]]):
        self.languages = [language for language, _ in samples]
        known = sorted(set().union(*(set(t) for _, t in samples)) - {" "})
        # Column 0 is the blank; letters that no sample has share the last column.
        self.width = len(known) + 2
        self.column = np.full(sys.maxunicode + 1, self.width - 1, dtype=np.uint16)
        self.column[0] = 0
        self.column[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
        by_char = self.column.copy()
        by_char[32] = 0
        tables, self.roots, self.bits, base = [], [], [], 0
        for _, sample in samples:
            automaton = Automaton(sample)
            keys = np.fromiter(automaton.step.keys(), dtype=np.int64, count=len(automaton.step))
            table = np.full((automaton.states, self.width), -1, dtype=np.int32)
            table[keys >> 21, by_char[keys & ((1 << 21) - 1)]] = np.fromiter(automaton.step.values(), dtype=np.int32, count=len(keys)) + base
            tables.append(table.ravel())
            self.roots.append(base)
            self.bits.append(automaton.bits)
            base += automaton.states
        self.table = np.concatenate(tables) if tables else np.zeros(0, dtype=np.int32)
        self.roots, self.bits = np.array(self.roots, dtype=np.int32), np.array(self.bits)

    def _step(self, state: np.ndarray, root: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after one more character, and whether a phrase begins with it."""
        following = self.table[state.astype(np.int64) * self.width + codes]
        missed = following < 0
        begins = missed | (state == root)
        if missed.any():
            again = self.table[root[missed].astype(np.int64) * self.width + codes[missed]]
            following[missed] = np.where(again < 0, root[missed], again)
        return following, begins

    def phrases(self, codes: np.ndarray, ends: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in each of some texts, by language, and the states at their ends.

        codes: columns of all texts, one after the other; entry: states (texts, languages) that they
        are entered with.
        """
        sizes = np.diff(ends, prepend=0)
        pieces = np.maximum(1, -(-sizes // SEGMENT))
        owner = np.repeat(np.arange(len(sizes)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = (ends - sizes)[owner] + number * SEGMENT
        stop = np.minimum(start + SEGMENT, ends[owner])
        n, k = len(owner), len(self.roots)
        flags = np.zeros((len(codes), k), dtype=bool)

        def walk(lanes: np.ndarray, state: np.ndarray, until_met: bool) -> tuple[np.ndarray, np.ndarray]:
            """Runs lanes (segment * k + language) from these states; flags where phrases begin. Returns
            the last states, and which lanes met the parse that was there."""
            segment, language = lanes // k, lanes % k
            length = (stop - start)[segment]
            order = np.argsort(-length, kind="stable")
            segment, language, length, state = segment[order], language[order], length[order], state[order]
            root, at, met = self.roots[language], start[segment], np.zeros(len(lanes), dtype=bool)
            live = np.arange(len(lanes))
            for t in range(int(length[0]) if len(lanes) else 0):
                live = live[: np.searchsorted(-length[live], -t, side="left")]
                if not len(live):
                    break
                place = at[live] + t
                following, begins = self._step(state[live], root[live], codes[place])
                if until_met:
                    same = begins & flags[place, language[live]]
                    met[live[same]] = True
                    flags[place[~same], language[live[~same]]] = begins[~same]
                    state[live[~same]] = following[~same]
                    live = live[~same]
                else:
                    flags[place, language[live]] = begins
                    state[live] = following
            back = np.empty_like(order)
            back[order] = np.arange(len(order))
            return state[back], met[back]

        every = np.arange(n * k)
        first = np.where((number == 0)[:, None], entry[owner], self.roots[None, :]).astype(np.int32).ravel()
        leave, _ = walk(every, first, False)
        pending = every[np.repeat(number > 0, k)]
        while len(pending):
            state, met = walk(pending, leave[pending - k].copy(), True)
            apart = pending[~met]
            leave[apart] = state[~met]
            # A segment that never met its first parse hands a new state to the one after it.
            after = apart + k
            after = after[after < n * k]
            pending = after[number[after // k] > 0]
        sums = np.concatenate([np.zeros((1, k), dtype=np.int64), np.cumsum(flags, axis=0)])
        last = np.cumsum(pieces) - 1
        return sums[ends] - sums[ends - sizes], leave.reshape(n, k)[last]

    def needed(self, parts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each normalised text, by language."""
        out = np.zeros((len(parts), len(self.roots)), dtype=np.int64)
        some: list[int] = []
        held = 0

        def parse() -> None:
            joined = self.column[np.concatenate([parts[i] for i in some])]
            out[some] = self.phrases(joined, np.cumsum([len(parts[i]) for i in some]), np.tile(self.roots, (len(some), 1)))[0]

        for i, part in enumerate(parts):
            if len(part) > BLOCK_CHARS:
                state = self.roots[None, :]
                for at in range(0, len(part), BLOCK_CHARS):
                    block = self.column[part[at : at + BLOCK_CHARS]]
                    count, state = self.phrases(block, np.array([len(block)]), state)
                    out[i] += count[0]
                continue
            some.append(i)
            held += len(part)
            if held >= BLOCK_CHARS:
                parse()
                some, held = [], 0
        if some:
            parse()
        return out


_PARSERS: dict[int, Parser] = {}


def _parser(samples: list[tuple[str, str]]) -> Parser:
    key = hash(tuple(samples))
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = Parser(samples)
    return _PARSERS[key]


def samples(labelled: DataFrame, language: str, text: str, key: str, most_docs: int = 64, most_chars: int = 8_000, most_languages: int = 64) -> list[tuple[str, str]]:
    """Whole texts of some labelled rows of each language, normalised and joined.

    About `most_docs` rows a language (those of least hash of `key`) among those of at most
    `most_chars` characters: at most most_docs * most_chars characters a language reach the
    driver and are sent out. More than `most_languages` languages are an error.
    """
    fit = labelled.filter(F.length(text) <= most_chars)
    totals = {r[language]: r["count"] for r in fit.groupBy(language).count().limit(most_languages + 1).collect()}
    if len(totals) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not totals:
        return []
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col(key)), F.lit(1 << 30))
    limits = F.create_map(*[F.lit(x) for name, n in totals.items() for x in (name, int((1 << 30) * min(1.0, most_docs / n)))])
    chosen = fit.filter(draw < F.element_at(limits, F.col(language)))
    found: dict[str, list[tuple]] = {}
    for row in chosen.select(F.col(language).alias("l"), draw.alias("d"), F.col(text).alias("t")).collect():
        found.setdefault(row["l"], []).append((row["d"], row["t"]))
    out = []
    for name in sorted(found):
        words = [spelled(normalised(t)).strip() for _, t in sorted(found[name])]
        sample = " ".join(filter(None, words))
        if sample:
            out.append((name, f" {sample} "))
    return out


def predict(docs: DataFrame, learned: list[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (share of the winner in odds of
    2^-(bits per word)), bits_per_word, phrases (of the winner)."""
    source = texts(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(sent.value)
        for batch in clean_rows(batches, 512):
            parts = [normalised(t.decode("utf-8", "replace")) for t in batch.column(1).to_pylist()]
            # A word begins at each letter after a blank.
            words = [int(np.count_nonzero((p[1:] != 0) & (p[:-1] == 0))) for p in parts]
            counts = parser.needed(parts)
            names, scores, bits, phrases = [], [], [], []
            for n, count in zip(words, counts, strict=True):
                if not n or not len(count):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    bits.append(None)
                    phrases.append(None)
                    continue
                per_word = count * parser.bits / n
                best = int(np.argmin(per_word))
                names.append(parser.languages[best])
                scores.append(float(1.0 / np.exp2(per_word[best] - per_word).sum()))
                bits.append(float(per_word[best]))
                phrases.append(int(count[best]))
            columns = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64()), pa.array(phrases, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "lang_pred", "score", "bits_per_word", "phrases"])

    return source.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, bits_per_word double, phrases long")


def held_out(id_col: str) -> Column:
    """Documents that nothing is learned from: a quarter by the checksum of their id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    learnable = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").filter(~held_out("doc_id"))
    found = predict(docs, samples(learnable, "lang", "text", "doc_id"))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
