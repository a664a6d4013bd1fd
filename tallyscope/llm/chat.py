"""Chat formatting: minimum-cost repair of roles, then rendering.

A legal conversation is an optional system turn, then user and assistant turns in
alternation, from a user turn to an assistant turn. Each turn of the input can be kept,
given another role, or merged into the turn before it, and empty turns can be inserted;
dynamic programming over the automaton of legal turns finds the cheapest way.

The step of one turn is a small matrix of costs between states, and steps combine as
(min, +) products, so a conversation can be cut anywhere. Turns are dealt out by range of
(conversation, turn), so one that holds a third of all rows is spread over tasks; each
piece of a conversation that spans tasks becomes one matrix, the best states at the cuts
follow from these matrices alone (one per task), and each piece is then solved between
given states. Nothing of unbounded size is gathered: output is one row per input turn with
the fragment it adds, and a conversation's rendering is its fragments in order.

Results by case: a null role or an unknown one must be relabelled; a null text is empty; a
null conv_id is a conversation of its own; null turns come first; ties in turn are ordered
by role and text, and repeated rows are turns of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.session import stored

from .common import query

# States after a turn, and which role leads from one to the next.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = ("", "system", "user", "assistant")
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
FINAL = (ASSISTANT,)

RELABEL, MERGE, INSERT = 2.0, 1.5, 3.0


def _insertions() -> dict[tuple[int, int], tuple[int, ...]]:
    """Fewest empty turns that lead from one state to another."""
    paths = {(s, s): () for s in range(4)}
    for _ in range(4):
        for (a, b), path in list(paths.items()):
            for c in range(4):
                if (b, c) in LEGAL and len(path) + 1 < len(paths.get((a, c), range(9))):
                    paths[a, c] = (*path, c)
    return paths


INSERTIONS = _insertions()
_INF = float("inf")

# A choice for one turn: (cost, state after it, inserted states, merged, state it gets).
Choice = tuple[float, int, tuple[int, ...], bool]


def choices(role: str | None) -> list[list[Choice]]:
    """For each state before and after a turn of this role, the cheapest way; one row per state before."""
    own = ROLES.get(role)
    table: list[list[Choice]] = []
    for before in range(4):
        row: list[Choice] = [(_INF, after, (), False) for after in range(4)]
        for after in (SYSTEM, USER, ASSISTANT):
            change = 0.0 if after == own else RELABEL
            options = [(INSERT * len(INSERTIONS[before, at]) + change, after, INSERTIONS[before, at], False) for at in range(4) if (at, after) in LEGAL and (before, at) in INSERTIONS]
            if before == after:
                options.append((MERGE + change, after, (), True))
            row[after] = min(options, default=row[after])
        table.append(row)
    return table


_CHOICES = {role: choices(role) for role in (*ROLES, None)}
_MATRIX = {role: np.array([[c[0] for c in row] for row in table]) for role, table in _CHOICES.items()}
# Cost of ending in each state: the empty turns up to a final one.
ENDINGS = [min((INSERT * len(INSERTIONS[s, f]), INSERTIONS[s, f]) for f in FINAL) for s in range(4)]


def _known(role: str | None) -> str | None:
    return role if role in ROLES else None


def product(roles: list[str | None]) -> np.ndarray:
    """Costs from each state before these turns to each state after them."""
    out = np.where(np.eye(4) > 0, 0.0, _INF)
    for role in roles:
        out = (out[:, :, None] + _MATRIX[_known(role)][None, :, :]).min(axis=1)
    return out


def solve(roles: list[str | None], entry: int, leave: int | None) -> list[Choice]:
    """The cheapest choices from state `entry` to `leave` (None: to the end of the conversation)."""
    cost = [_INF] * 4
    cost[entry] = 0.0
    back: list[list[tuple[int, Choice] | None]] = []
    for role in roles:
        table = _CHOICES[_known(role)]
        new, via = [_INF] * 4, [None] * 4
        for before in range(4):
            if cost[before] < _INF:
                for choice in table[before]:
                    total = cost[before] + choice[0]
                    if total < new[choice[1]]:
                        new[choice[1]], via[choice[1]] = total, (before, choice)
        cost = new
        back.append(via)
    at = leave if leave is not None else min(range(4), key=lambda s: cost[s] + ENDINGS[s][0])
    out = []
    for via in reversed(back):
        at, choice = via[at]
        out.append(choice)
    return out[::-1]


def _opened(state: int) -> str:
    return f"<|im_start|>{NAMES[state]}\n"


_CLOSED = "<|im_end|>\n"


def render(texts: list[str | None], path: list[Choice], entry: int, last: bool) -> list[tuple[str, str, list[str], str]]:
    """Per turn: role, action, inserted roles, fragment. Fragments in order are the conversation."""
    out, state = [], entry
    for text, (_, after, inserted, merged) in zip(texts, path, strict=True):
        if merged:
            fragment = "\n\n" + (text or "")
        else:
            fragment = (_CLOSED if state != START else "") + "".join(_opened(s) + _CLOSED for s in inserted) + _opened(after) + (text or "")
        out.append([NAMES[after], "merge" if merged else "turn", [NAMES[s] for s in inserted], fragment])
        state = after
    if last and out:
        ending = ENDINGS[state][1]
        out[-1][2] += [NAMES[s] for s in ending]
        out[-1][3] += _CLOSED + "".join(_opened(s) + _CLOSED for s in ending)
    return [tuple(x) for x in out]


def _segments(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows that arrive sorted by the keys, one table per key; a key's rows are of one task's range."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        begin = 0
        for at in range(len(rows) + 1):
            if at == len(rows) or rows[at] != current:
                if at > begin:
                    held.append(batch.slice(begin, at - begin))
                if at < len(rows):
                    if held:
                        yield pa.Table.from_batches(held)
                    held, current, begin = [], rows[at], at
    if held:
        yield pa.Table.from_batches(held)


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tasks: int | None = None) -> DataFrame:
    """One row per input turn: conv_id, turn, old_role, role, action (turn, or merge into the one
    before), inserted (roles of empty turns around it), fragment, and place: its number in its
    conversation from 0 on. A conversation's rendering is its fragments by place. tasks: into how
    many ranges turns are dealt; by default as many as the session shuffles into."""
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("old_role"), F.col(text_col).cast("string").alias("text")
    )
    order = ["conv_id", "turn", "old_role", "text"]
    ranged = rows.repartitionByRange(*([tasks] if tasks else []), *order).sortWithinPartitions(*order)
    # The part and place of a turn are fixed once here; all later steps read them.
    dealt = stored(ranged.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "turns")
    kind, turn_kind = (dealt.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))

    spans = dealt.groupBy("conv_id").agg(F.min("part").alias("_first"), F.max("part").alias("_last")).filter("_first < _last")
    spans = spans.select(F.col("conv_id").alias("_conv"), "_last")
    split = dealt.join(spans, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi").select("conv_id", "part", "place", "old_role")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _segments(batches, ("conv_id", "part")):
            costs = product(table.column("old_role").to_pylist()).ravel().tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("conv_id").combine_chunks()[:1], pa.array(table.column("part").to_pylist()[:1], pa.int32()),
                    pa.array([costs], pa.list_(pa.float64())), pa.array([table.num_rows], pa.int64()),
                ],
                names=["conv_id", "part", "costs", "turns"],
            )

    sorted_split = split.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "place")
    pieces = sorted_split.mapInArrow(matrices, f"conv_id {kind}, part int, costs array<double>, turns long")

    def cuts(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        steps = [np.array(c).reshape(4, 4) for c in table.column("costs").to_pylist()]
        cost, back = np.full(4, _INF), []
        cost[START] = 0.0
        for step in steps:
            total = cost[:, None] + step
            back.append(total.argmin(axis=0))
            cost = total.min(axis=0)
        at = int(np.argmin(cost + [e[0] for e in ENDINGS]))
        states = [at]
        for choice in reversed(back):
            at = int(choice[at])
            states.append(at)
        states.reverse()
        turns = table.column("turns").to_numpy()
        return pa.table({
            "conv_id": table.column("conv_id"), "part": table.column("part"), "entry": pa.array(states[:-1], pa.int32()), "leave": pa.array(states[1:], pa.int32()),
            "before": pa.array(np.cumsum(turns) - turns, pa.int64()),
        })

    # One row per task that a spanning conversation reaches.
    given = pieces.groupBy("conv_id").applyInArrow(cuts, f"conv_id {kind}, part int, entry int, leave int, before long")
    given = given.join(spans, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "_conv", F.col("part").alias("_part"), "entry", "leave", "before", (F.col("part") == F.col("_last")).alias("ends")
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))
    ready = dealt.join(given, same, "left").select("conv_id", "part", "place", "turn", "old_role", "text", "entry", "leave", "before", "ends")
    names = ["conv_id", "turn", "old_role", "role", "action", "inserted", "fragment", "place"]

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for table in _segments(batches, ("conv_id", "part")):
            roles, texts = table.column("old_role").to_pylist(), table.column("text").to_pylist()
            entry, leave, before, ends = (table.column(c)[0].as_py() for c in ("entry", "leave", "before", "ends"))
            entry, last = START if entry is None else entry, ends is None or ends
            path = solve(roles, entry, None if ends is None else leave)
            made = list(zip(*render(texts, path, entry, last), strict=True))
            new = [pa.array(c, k) for c, k in zip(made, (pa.string(), pa.string(), pa.list_(pa.string()), pa.string()), strict=True)]
            place = pa.array(np.arange(table.num_rows) + (before or 0), pa.int64())
            held.append(pa.table([*(table.column(c) for c in names[:3]), *new, place], names=names))
            size += table.num_rows
            if size >= 2048:
                yield from pa.concat_tables(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    schema = f"conv_id {kind}, turn {turn_kind}, old_role string, role string, action string, inserted array<string>, fragment string, place long"
    return ready.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "place").mapInArrow(solved, schema)


@query("op9_chat_format")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return repaired.select("conv_id", "turn", "old_role", "role", "action", F.array_join("inserted", ",").alias("inserted"), "fragment", "place")
