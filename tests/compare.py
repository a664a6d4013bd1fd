"""Run a registered query and its SQL twin and compare the results."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    return type(value).__name__


def cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else float(repr(round(value, 9)))
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    return value


def rows_of(names, records) -> tuple[list[str], Counter, dict[str, set]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    kinds: dict[str, set] = {n: set() for n in names}
    bag: Counter = Counter()
    for record in records:
        for i in order:
            kinds[names[i]].add(kind(record[i]))
        bag[tuple(cell(record[i]) for i in order)] += 1
    return [names[i] for i in order], bag, kinds


def compare(spark_df, con, sql: str) -> tuple[int, list[str]]:
    """Number of rows and a list of differences (empty when equal)."""
    got_names, got, got_kinds = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    want_names, want, want_kinds = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got_names != want_names:
        return sum(got.values()), [f"columns {got_names} vs {want_names}"]
    problems = [
        f"type of {n}: {got_kinds[n]} vs {want_kinds[n]}"
        for n in got_names
        if (got_kinds[n] - {"null"}) != (want_kinds[n] - {"null"})
    ]
    if got != want:
        extra = list((got - want).items())[:3]
        missing = list((want - got).items())[:3]
        problems.append(
            f"rows {sum(got.values())} vs {sum(want.values())}\n   columns {got_names}"
            f"\n   only spark {extra}\n   only sql   {missing}"
        )
    return sum(got.values()), problems
