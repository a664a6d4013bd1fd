from __future__ import annotations

import hashlib
import re

from tallyscope.llm import secrets

BASE = {
    "assign": re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
LEAST = {"access": 20, "hex": 24}


def brute(text: str) -> list[tuple[int, int, int, str]]:
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text):
            if len(m[1]) >= 6 if kind == "assign" else len(m[0]) >= LEAST[kind]:
                out.append((m.start(), order, m.end(), kind))
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


def check(report, docs):
    want = sorted((str(r["doc_id"]), joined(brute(r["text"] or ""))) for r in docs)
    got = sorted((str(r["doc_id"]), ",".join(s for s in r["spans"].split(",") if s.split(":")[0] in BASE)) for r in report)
    assert got == want
    digests = sorted((str(d), hashlib.sha256(s.encode()).hexdigest()) for d, s in want)
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in report) == digests
    for r in report:
        kinds = [s.split(":")[0] for s in r["spans"].split(",")]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(kinds.count(k) for k in BASE)


def test_query_matches_search_of_whole_texts(spark, sf_dir, documents):
    check(secrets.op4(spark, sf_dir).collect(), documents.collect())


def test_odd_rows(nasty, empty):
    rows = secrets.report(secrets.scan(nasty)).collect()
    check(rows, nasty.collect())
    assert {r["doc_id"]: r["n_assign"] for r in rows}[15] == 2
    assert secrets.report(secrets.scan(empty)).collect() == []


def test_checksums_decide(spark):
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = body + secrets.checksum(body.encode()).decode()
    wrong = body + ("000000" if not good.endswith("000000") else "000001")
    texts = [f"é ghp_{good}", f"ghp_{wrong}", f"npm_{good} ghp_{good}x", f"token=ghp_{good}"]
    rows = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    found = [[(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in rows]
    assert found == [[("github", 2, 42)], [], [("npm", 0, 40)], [("assign", 0, 46), ("github", 6, 46)]]


def test_letters_beyond_ascii_are_no_keywords(spark):
    texts = ["paſſword=abcdefgh", "TOKEN=abcdefgh", "PassWord='abcdef'"]
    rows = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [len(r["spans"]) for r in rows] == [0, 0, 1]


def test_redact(nasty):
    before = {str(r["doc_id"]): r for r in nasty.collect()}
    for row in secrets.redact(nasty, length_col="n_chars").collect():
        old = before[str(row["doc_id"])]
        if row["text"] != old["text"] and row["doc_id"] is not None:
            assert "hunter2" not in row["text"] and row["n_chars"] == len(row["text"])
        if row["doc_id"] == 14:
            assert row["text"] == 'password = "[assign]" token: abc [access] [hex]'
        assert row["node"] == old["node"] or row["doc_id"] in (10, None)
