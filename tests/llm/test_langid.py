from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallyscope.llm import langid


def phrases(sample: str, text: str) -> int:
    count = at = 0
    while at < len(text):
        n = 0
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        at += max(n, 1)
        count += 1
    return count


def test_parse_against_substring_search():
    draw = random.Random(1)
    for letters in ("ab", "abcd", "abcdefghij"):
        sample = "".join(draw.choice(letters) for _ in range(200))
        automaton = langid.Automaton(sample)
        for _ in range(200):
            text = "".join(draw.choice(letters + "z") for _ in range(draw.randrange(0, 30)))
            assert automaton.phrases(text) == phrases(sample, text)


@pytest.mark.parametrize("segment", [3, 16, 512])
def test_whole_texts_against_substring_search(monkeypatch, segment):
    """Texts side by side, cut into segments and blocks, give the phrases of one parse each."""
    monkeypatch.setattr(langid, "SEGMENT", segment)
    draw = random.Random(segment)
    for letters in ("ab", "abcdeé", "abcdefghijklmn"):
        samples = [(name, " " + "".join(draw.choice(letters + " ") for _ in range(300)) + " ") for name in ("x", "y", "z")]
        parser = langid.Parser(samples)
        plain = ["", "½ ² ①", "aba", *("".join(draw.choice(letters.upper() + letters + "  .1ß") for _ in range(draw.randrange(0, 400))) for _ in range(40)), samples[1][1] * 3, "a" * 900]
        parts = [langid.normalised(t) for t in plain]
        for block in (50, 1 << 20):
            monkeypatch.setattr(langid, "BLOCK_CHARS", block)
            got = parser.needed(parts)
            assert got.tolist() == [[phrases(sample, langid.spelled(p)) for _, sample in samples] for p in parts]


def test_normalised():
    assert langid.spelled(langid.normalised("¡Hola,  MUNDO 42 straße½ İx!")) == " hola mundo straße İx "
    assert langid.spelled(langid.normalised("12 ½ ² ① _")) == " "


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = langid.op10(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    unseen = [r for r in rows if r["held_out"] and r["lang"]]
    assert sum(r["lang"] == r["lang_pred"] for r in unseen) > 0.97 * len(unseen)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(nasty, empty):
    learnable = nasty.filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").filter(~langid.held_out("doc_id"))
    learned = langid.samples(learnable, "lang", "text", "doc_id")
    rows = {r["doc_id"]: r for r in langid.predict(nasty, learned).collect()}
    assert {rows[i]["lang_pred"] for i in (1, 2, 3)} == {"und"} and rows[1]["score"] == 0
    assert rows[5]["lang_pred"] in {"en", "fr"}
    odd = nasty.sparkSession.createDataFrame([(1, "½ ² ①"), (2, "٣ _ 7"), (3, "é")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in langid.predict(odd, learned).orderBy("doc_id").collect()] == [True, True, False]
    assert langid.predict(empty, learned).collect() == []
    assert {r["lang_pred"] for r in langid.predict(nasty, langid.samples(learnable.limit(0), "lang", "text", "doc_id")).collect()} == {"und"}
    assert nasty.filter("doc_id IS NULL").select(langid.held_out("doc_id")).first()[0] is False


def test_sample_is_bounded_and_whole(spark):
    frame = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.repeat(F.lit("some words "), F.when(F.col("id") % 2 == 0, 3).otherwise(2000)).alias("text"))
    ((name, sample),) = langid.samples(frame, "lang", "text", "doc_id", most_docs=50, most_chars=100)
    assert name == "en" and set(sample.split()) == {"some", "words"} and len(sample.split()) % 6 == 0 and 30 * 6 < len(sample.split()) < 80 * 6
    with pytest.raises(ValueError):
        langid.samples(frame.withColumn("lang", F.col("doc_id").cast("string")), "lang", "text", "doc_id", most_languages=5)
