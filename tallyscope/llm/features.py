"""Counts of a text in DataFrame functions, shared by the quality operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CLASS


def without(text: Column, pattern: str) -> Column:
    """Number of code points of the text that the pattern covers."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def counted(docs: DataFrame, text_col: str, *passed: Column) -> DataFrame:
    """`passed`, text (null: empty), words and lines, with counts:

    n_words, word_chars, n_symbols, n_lines (lines with a word), n_dup_lines (such lines
    equal to an earlier one), n_distinct (different words), n_upper, n_digits, n_marks
    (characters of [!?]).
    """
    base = docs.select(*passed, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    cut = base.withColumns({
        "_words": F.regexp_extract_all("_text", F.lit(f"({WORD_CLASS})"), F.lit(1)),
        "_lines": F.filter(F.split("_text", "\n", -1), lambda line: F.length(F.regexp_replace(line, SPACE_CLASS, "")) > 0),
    })
    text = F.col("_text")
    return cut.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": without(text, "[#*$%&|<>]+"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_distinct": F.size(F.array_distinct("_words")).cast("long"),
        "n_upper": without(text, "[A-Z]+"),
        "n_digits": without(text, "[0-9]+"),
        "n_marks": without(text, "[!?]+"),
    })


def _share(part: str, whole: str) -> Column:
    """part / whole, 0 where there is no whole."""
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


SHARE_NAMES = (
    "words", "word_length", "symbol_share", "dup_line_share", "distinct_share", "upper_share", "digit_share", "mark_share", "line_words",
)


def shares() -> dict[str, Column]:
    """What the quality operators look at, from the counts above."""
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": _share("word_chars", "n_words"),
        "symbol_share": _share("n_symbols", "word_chars"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "distinct_share": _share("n_distinct", "n_words"),
        "upper_share": _share("n_upper", "word_chars"),
        "digit_share": _share("n_digits", "word_chars"),
        "mark_share": _share("n_marks", "word_chars"),
        "line_words": _share("n_words", "n_lines"),
    }
