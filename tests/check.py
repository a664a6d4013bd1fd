"""Compare registered queries with their SQL twins: python tests/check.py SF_DIR [name part ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import compare, connect  # noqa: E402

import __spark_entry__ as registry  # noqa: E402
from tallyscope.session import local_session  # noqa: E402


def main() -> int:
    sf_dir, parts = sys.argv[1], sys.argv[2:]
    spark, con = local_session("check", "8"), connect(sf_dir)
    queries, oracles = registry.queries(), registry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        started = time.time()
        try:
            if name in oracles:
                n, problems = compare(fn(spark, sf_dir), con, oracles[name])
            else:
                n, problems = len(fn(spark, sf_dir).collect()), []
        except Exception as exc:  # report and go on with the next query
            n, problems = -1, [f"{type(exc).__name__}: {str(exc)[:1500]}"]
        tag = "ok  " if not problems else "FAIL"
        if name not in oracles:
            tag = "rows" if not problems else "FAIL"
        bad += bool(problems)
        print(f"{tag} {name:38s} {n:7d} rows {time.time() - started:6.2f}s", flush=True)
        for p in problems:
            print("   ", p, flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
