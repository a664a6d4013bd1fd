"""Quality rules: learned decision lists over text statistics, in DataFrame functions only.

Base counts come from one pass over the texts and are written, a few numbers a row. A list
is learned from labelled rows by sequential covering: a rule grows by one threshold
condition at a time (the best gain in purity on the growing part), is pruned to the prefix
of its conditions that does best on the pruning part, and is kept if it is pure enough
over both parts; rows it covers leave, and the next rule grows. Each step is one grouped count over
(statistic, bin), so the driver only sees counts of a few hundred bins. The list becomes
one ordered conditional expression.

Results by case: a null or empty text has no words and fails the base rules; very long
texts are counted whole; labels that are null or of no document are not used; without
labels the list is empty and only the base rules decide; repeated rows are counted each;
an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import pairwise
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.session import stored

from .common import documents, query
from .features import counted, shares


def repeat_words(words: str) -> Column:
    """Words in 3-word windows that the text has twice or more, the first included.

    Windows are compared by 64-bit hashes. The starts of repeated windows are found by a
    sort; each covers 3 words, or as many as there are up to the next start.
    """
    positions = F.col("_repeats")
    covered = F.transform(positions, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(positions, j + 1), p + 3) - p))
    return F.aggregate(covered, F.lit(0).cast("long"), lambda total, n: total + n)


def _with_repeats(counts: DataFrame) -> DataFrame:
    words = F.col("_words")
    windows = F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )
    hashed = counts.withColumn("_windows", windows)
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.when(again, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    sorted_rows = hashed.withColumn("_placed", placed)
    runs = F.col("_placed")
    starts = F.filter(
        F.transform(runs, lambda x, j: F.when((x["h"] == F.get(runs, j - 1)["h"]) | (x["h"] == F.get(runs, j + 1)["h"]), x["i"])),
        lambda i: i.isNotNull(),
    )
    found = sorted_rows.withColumn("_repeats", F.sort_array(starts))
    return found.withColumn("n_repeat_words", F.coalesce(repeat_words("_repeats"), F.lit(0).cast("long")))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, and the shares that rules look at."""
    counts = _with_repeats(counted(docs, text_col, F.col(id_col).alias("doc_id")))
    repeated = F.when(F.col("n_words") > 0, F.col("n_repeat_words") / F.col("n_words")).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts.select("doc_id", *COUNTS, failed.alias("base_failed"), *[c.alias(n) for n, c in shares().items()], repeated.alias("repeat_share"))



@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool  # > threshold, else <= threshold
    threshold: float

    def column(self) -> Column:
        value = F.col(self.statistic)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass
class DecisionList:
    """Rules in order; the first that holds rejects a document, none keeps it."""

    rules: list[list[Condition]] = field(default_factory=list)

    def rejects(self) -> Column:
        out = None
        for rule in self.rules:
            holds = _all(rule)
            out = F.when(holds, F.lit(True)) if out is None else out.when(holds, F.lit(True))
        return F.lit(False) if out is None else out.otherwise(F.lit(False))

    def __str__(self) -> str:
        return "\n".join(f"reject if {' and '.join(map(str, rule))}" for rule in self.rules) + "\nelse keep"


def _all(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def _best(rows: DataFrame, names: list[str], cuts: dict[str, list[float]]) -> Condition | None:
    """The condition with the most gain over rows that the rule so far covers."""
    # Bin b of a statistic holds values above its first b thresholds only.
    bins = [
        F.struct(F.lit(i).alias("s"), sum((F.when(F.col(n) > c, 1).otherwise(0) for c in cuts[n]), F.lit(0)).alias("b"))
        for i, n in enumerate(names)
    ]
    counted_bins = (
        rows.select("bad", F.explode(F.array(*bins)).alias("at"))
        .groupBy("at.s", "at.b")
        .agg(F.sum(F.col("bad").cast("long")).alias("bad"), F.count("*").alias("n"))
        .collect()
    )
    table = {i: [[0, 0] for _ in range(len(cuts[n]) + 1)] for i, n in enumerate(names)}
    for row in counted_bins:
        table[row["s"]][row["b"]] = [row["bad"], row["n"]]
    best, best_gain = None, 1e-9
    for i, name in enumerate(names):
        total_bad, total = (sum(x[k] for x in table[i]) for k in (0, 1))
        if not total_bad:
            return None
        low_bad = low = 0
        for at, threshold in enumerate(cuts[name]):
            low_bad, low = low_bad + table[i][at][0], low + table[i][at][1]
            for above, bad, n in ((False, low_bad, low), (True, total_bad - low_bad, total - low)):
                if bad:
                    gain = bad * (log2(bad / n) - log2(total_bad / total))
                    if gain > best_gain:
                        best, best_gain = Condition(name, above, threshold), gain
    return best


def learn(
    labelled: DataFrame,
    names: list[str],
    bad: str = "bad",
    key: str = "doc_id",
    most_rows: int = 50_000,
    bins: int = 40,
    most_rules: int = 8,
    most_conditions: int = 3,
    purity: float = 0.85,
) -> DecisionList:
    """A list from labelled statistics, fitted on a sample of about `most_rows` rows at most
    (the rows of least hash), two thirds of them to grow rules and one third to prune."""
    total = labelled.count()
    draw = F.pmod(F.xxhash64(F.lit("rules"), F.col(key)), F.lit(1 << 20))
    chosen = labelled.filter(draw < int((1 << 20) * min(1.0, most_rows / max(total, 1))))
    rows = stored(chosen.select(F.col(bad).alias("bad"), (F.pmod(draw, F.lit(3)) == 0).alias("prunes"), *names), "labelled")
    steps = [i / bins for i in range(1, bins)] + [0.005, 0.995]
    found = rows.agg(*[F.percentile_approx(n, steps, 10_000).alias(n) for n in names]).first()
    # Thresholds lie midway between neighbouring quantiles, away from either side's values.
    cuts = {n: [(a + b) / 2 for a, b in pairwise(sorted(set(found[n] or [])))] for n in names}
    learned = DecisionList()
    rest = rows
    while len(learned.rules) < most_rules:
        rule: list[Condition] = []
        growing = rest.filter("NOT prunes")
        while len(rule) < most_conditions:
            best = _best(growing.filter(_all(rule)), names, cuts)
            if best is None:
                break
            rule.append(best)
        if not rule:
            break
        hits = [_all(rule[: i + 1]) for i in range(len(rule))]
        parts = [(h, b, p) for h in hits for p in (True, False) for b in (True, False)]
        tallies = [F.sum(F.when(h & (F.col("bad") == b) & (F.col("prunes") == p), 1).otherwise(0)) for h, b, p in parts]
        tally = [x or 0 for x in rest.agg(*[t.alias(f"t{i}") for i, t in enumerate(tallies)]).first()]
        pruning = [(tally[i] + 1) / (tally[i] + tally[i + 1] + 2) for i in range(0, len(tally), 4)]
        # The shortest of the prefixes that do about as well as the best on the pruning part.
        keep = next(i for i, worth in enumerate(pruning) if worth >= max(pruning) - 0.005)
        bad_hits, good_hits = (tally[4 * keep + i] + tally[4 * keep + 2 + i] for i in (0, 1))
        if (bad_hits + 1) / (bad_hits + good_hits + 2) < purity:
            break
        rule = rule[: keep + 1]
        learned.rules.append(rule)
        rest = rest.filter(~_all(rule))
    return learned


def judged(counts: DataFrame, learned: DecisionList) -> DataFrame:
    """The counts with the verdict `kept`: false where the base rules fail or the list rejects."""
    return counts.withColumn("kept", ~(F.col("base_failed") | learned.rejects()))


@query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stored(statistics(documents(spark, sf_dir)), "statistics")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality IS NOT NULL")
    labelled = counts.join(labels.select("doc_id", (F.col("quality") == 0).alias("bad")), "doc_id")
    learned = learn(labelled, [*shares(), "repeat_share"])
    return judged(counts, learned).select("doc_id", *COUNTS, "base_failed", "kept")
