"""Command line: python tests/check_all.py SF_DIR [name ...]"""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from contextmill.session import build_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

if __name__ == "__main__":
    sf, names = sys.argv[1], sys.argv[2:]
    spark = build_session("check", "8")
    con = connect(sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and not any(n in name for n in names):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in sql:
                problem = compare(df, con, sql[name])
                n = con.execute(f"SELECT count(*) FROM ({sql[name]})").fetchone()[0]
            else:
                n, problem = df.count(), None
        except Exception as e:
            problem, n = "".join(traceback.format_exception_only(e))[:1500], -1
        status = "ok " if problem is None else "BAD"
        bad += problem is not None
        print(f"{status} {name:28s} {time.time() - t:6.2f}s rows={n} {'' if name in sql else '(no sql)'} {problem or ''}", flush=True)
    print("bad:", bad)
