from __future__ import annotations

import itertools
import random
import re

from tallyscope.llm import chat

LEGAL = re.compile(r"(s)?(ua)+")
ALPHABET = {"system": "s", "user": "u", "assistant": "a"}


def cheapest(roles: list[str | None]) -> float:
    """Least cost over all ways to relabel and merge, then insert, by trying them all."""
    best = float("inf")
    for kept in itertools.product("sua", repeat=len(roles)):
        changed = sum(chat.RELABEL for role, new in zip(roles, kept, strict=True) if ALPHABET.get(role) != new)
        for merges in itertools.product((False, True), repeat=len(roles)):
            if merges[0] or any(m and kept[i] != kept[i - 1] for i, m in enumerate(merges)):
                continue
            turns = "".join(k for k, m in zip(kept, merges, strict=True) if not m)
            cost = changed + chat.MERGE * sum(merges) + chat.INSERT * insertions(turns)
            best = min(best, cost)
    return best


def insertions(turns: str) -> float:
    """Fewest empty turns that make the string legal."""
    for n in range(2 * len(turns) + 3):
        for length in (len(turns) + n,):
            for legal in legal_strings(length):
                it = iter(legal)
                if all(c in it for c in turns):
                    return n
    return float("inf")


def legal_strings(length: int) -> list[str]:
    out = []
    if length >= 2 and length % 2 == 0:
        out.append("ua" * (length // 2))
    if length >= 3 and length % 2 == 1:
        out.append("s" + "ua" * (length // 2))
    return out


def cost_of(path) -> float:
    return sum(c[0] for c in path) + chat.ENDINGS[path[-1][1]][0]


def test_cost_is_least_of_all_ways():
    for n in range(1, 5):
        for roles in itertools.product(("system", "user", "assistant", None), repeat=n):
            assert cost_of(chat.solve(list(roles), chat.START, None)) == cheapest(list(roles)), roles


def rendered_roles(text: str) -> list[str]:
    return re.findall(r"<\|im_start\|>(\w+)\n", text)


def test_fragments_make_a_legal_conversation():
    draw = random.Random(1)
    for _ in range(300):
        roles = [draw.choice(["system", "user", "assistant", None, "tool"]) for _ in range(draw.randrange(1, 9))]
        path = chat.solve(roles, chat.START, None)
        text = "".join(r[3] for r in chat.render([f"t{i}" for i in range(len(roles))], path, chat.START, True))
        assert LEGAL.fullmatch("".join(ALPHABET[r] for r in rendered_roles(text)))
        assert text.count("<|im_start|>") == text.count("<|im_end|>") and text.endswith("<|im_end|>\n")
        assert [int(x) for x in re.findall(r"t(\d+)", re.sub(r"assistant|start", "", text))] == list(range(len(roles)))


def test_products_of_pieces_give_the_same_cost():
    draw = random.Random(2)
    for _ in range(50):
        roles = [draw.choice(["system", "user", "assistant", None]) for _ in range(12)]
        whole = chat.product(roles)
        cut = draw.randrange(13)
        left, right = chat.product(roles[:cut]), chat.product(roles[cut:])
        assert ((left[:, :, None] + right[None]).min(axis=1) == whole).all()
        assert cost_of(chat.solve(roles, chat.START, None)) == min(whole[chat.START] + [e[0] for e in chat.ENDINGS])


def conversations(frame) -> dict:
    rows = frame.orderBy("place").collect()
    out: dict = {}
    for r in rows:
        out.setdefault(r["conv_id"], []).append(r)
    return out


def test_long_conversation_over_many_tasks(spark):
    draw = random.Random(3)
    turns = [(1, i, draw.choice(["system", "user", "assistant", None]), f"t{i}") for i in range(900)]
    turns += [(c, i, draw.choice(["user", "assistant"]), f"t{i}") for c in range(2, 60) for i in range(5)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(6)
    found = conversations(chat.repair(frame, tasks=7))
    for conv, rows in found.items():
        assert [(r["place"], r["turn"]) for r in rows] == [(i, i) for i in range(len(rows))]
        roles = [t[2] for t in sorted(t for t in turns if t[0] == conv)]
        text = "".join(r["fragment"] for r in rows)
        assert LEGAL.fullmatch("".join(ALPHABET[r] for r in rendered_roles(text)))
        inserted = sum(len(r["inserted"]) for r in rows)
        changed = sum(r["role"] != r["old_role"] for r in rows)
        merged = sum(r["action"] == "merge" for r in rows)
        cost = chat.INSERT * inserted + chat.RELABEL * changed + chat.MERGE * merged
        assert cost == cost_of(chat.solve(roles, chat.START, None))


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, part string, place string, entry string, fragment string"
    rows = [(1, 0, None, None), (1, 0, None, None), (1, None, "tool", ""), (None, 3, "user", "x"), (None, 1, "assistant", "y"), (2, 0, "assistant", "z" * 300_000)]
    frame = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], schema)
    found = conversations(chat.repair(frame))
    assert {k: len(v) for k, v in found.items()} == {1: 3, None: 2, 2: 1}
    for own in found.values():
        assert LEGAL.fullmatch("".join(ALPHABET[r] for r in rendered_roles("".join(r["fragment"] for r in own))))
    assert chat.repair(frame.limit(0)).collect() == []


def test_renderings_are_rebuilt_from_the_result(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    given: dict = {}
    for t in sorted(turns, key=lambda t: (t["turn"] is not None, t["turn"] or 0, t["role"] is not None, t["role"] or "", t["text"] is not None, t["text"] or "")):
        given.setdefault(t["conv_id"], []).append(t)
    found = conversations(chat.op9(spark, sf_dir))
    assert set(found) == set(given)
    for conv, rows in found.items():
        assert [r["place"] for r in rows] == list(range(len(given[conv])))
        path = chat.solve([t["role"] for t in given[conv]], chat.START, None)
        want = "".join(r[3] for r in chat.render([t["text"] for t in given[conv]], path, chat.START, True))
        assert "".join(r["fragment"] for r in rows) == want and LEGAL.fullmatch("".join(ALPHABET[r] for r in rendered_roles(want)))
