"""Small Column helpers used across the package."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def literal_array(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` (several times)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    """Sum of an ARRAY<DOUBLE>."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def moments(values: Column) -> Column:
    """Struct of an ARRAY<DOUBLE>: n, total and square (sum of squared distances from the mean),
    taken element by element in the array's order."""
    none = F.struct(*[F.lit(0.0).alias(k) for k in ("n", "total", "mean", "square")])

    def step(acc: Column, x: Column) -> Column:
        n = acc["n"] + 1.0
        mean = acc["mean"] + (x - acc["mean"]) / n
        return F.struct(
            n.alias("n"), (acc["total"] + x).alias("total"), mean.alias("mean"),
            (acc["square"] + (x - mean) * (x - acc["mean"])).alias("square"),
        )

    return F.aggregate(values, none, step)


def clip(value: Column, low: float, high: float) -> Column:
    """Value limited to low..high; a missing value counts as ``low``."""
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), value))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is 0 where there is nothing to divide by."""
    return F.coalesce(
        F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0)
    )


def texts(*conditional: Column) -> Column:
    """Array of the non-null texts, in order."""
    return F.array_compact(F.array(*conditional))


def order_key(seed: int | str, *parts: Column) -> Column:
    """Reproducible shuffle key: md5 of the parts, the last part breaking ties."""
    text = [p.cast("string") for p in parts]
    return F.concat(F.md5(F.concat_ws(":", F.lit(str(seed)), *text)), F.lit(":"), text[-1])


def uniform(seed: int | str, *parts: Column) -> Column:
    """Reproducible number in [0, 1): the first 52 bits of an md5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def by_sort(df: DataFrame) -> DataFrame:
    """A table that joins are to sort and merge: one with rows for each picture or more.

    At some sizes such a table still passes for small. Then it would be sent through the driver
    to every task, and a job of many joins would send many of them.
    """
    return df.hint("merge")


def pin(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns through a one-row generator.

    A later filter on such a column reads its value; on an ordinary projection the
    optimizer would rewrite the filter in terms of the whole defining expression and
    evaluate that again, once per mention.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
