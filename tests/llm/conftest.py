from __future__ import annotations

import pytest

# Names that operators use themselves, to clash with.
EXTRA = ["row_key", "_key", "_doc", "_other", "_digest", "_keep", "node", "key", "digest", "_text", "_words", "p", "n", "spans", "ids", "start", "part"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)

PROSE = "the quick brown fox jumps over a lazy dog while seven wizards quietly mix potions for the old king of the hill and his court"


def prose(seed: int, n: int) -> str:
    words = PROSE.split()
    return " ".join(f"{words[(seed * 7 + i * (seed + 3)) % len(words)]}{(seed * 31 + i * i) % 97}" for i in range(n))


def nasty_rows() -> list[tuple]:
    long_text = prose(5, 20_000)
    base = prose(9, 120)
    near = base.replace("fox", "cat", 1) + " end"
    texts = [
        (1, ""), (2, None), (3, "   \n\t \x0b\x0c\r "), (4, "word"), (5, long_text), (6, long_text), (7, base), (8, near),
        (9, base.replace(" ", "  \n")), (10, base), (10, base), (None, base), (None, None), (11, "Ünï çødé " * 60 + "𝄞 ẞ İ"),
        (12, "a" * 3000), (13, "abc def " * 400), (14, 'password = "hunter2hunter2" token: abc AKIA' + "B" * 16 + " " + "0f" * 20),
        (15, "secretpassword=abcdefg password=short token=x apikey:'zzzzzzz' deadbeef" + "a1" * 12), (16, "<|endoftext|> it's 'll 12345 　 x"),
        (17, "AB!! CD!! " * 50), (18, "### $$$ %%% " * 40), (19, prose(11, 80)), (20, prose(11, 80).upper()),
    ]
    langs = ["en", None, "fr", "en"]
    return [
        (doc, text, langs[i % 4], None if i % 5 == 0 else f"s{i % 3}", None if text is None else len(text), *[f"x{i}"] * len(EXTRA))
        for i, (doc, text) in enumerate(texts)
    ]


@pytest.fixture(scope="session")
def nasty(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and clashing names."""
    return spark.createDataFrame(nasty_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(4, 1, 0), (7, 1, 0), (8, 1, 0), (17, 0, 0), (18, 0, 0), (19, 1, 0), (None, 1, 0), (99, 0, 0), (5, None, None), (13, 0, 0), (14, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
