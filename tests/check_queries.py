"""Run registered queries against their SQL: python tests/check_queries.py [sf] [name ...]"""

import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

import __spark_entry__ as entry_module  # noqa: E402
from oracle import compare, connect  # noqa: E402

from hourloom.session import build_session  # noqa: E402


def main(sf="0.01", *names):
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("check", "local[8]", 8, {"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    queries, oracle = entry_module.queries(), entry_module.oracle_sql()
    bad = 0
    for name in names or queries:
        began = time.time()
        try:
            frame = queries[name](spark, sf_dir)
            if name in oracle:
                verdict = compare(frame, db, oracle[name])
            else:
                verdict = None if frame.count() > 0 else "no rows"
        except Exception as error:  # noqa: BLE001
            verdict = f"{type(error).__name__}: {str(error)[:600]}"
        bad += verdict is not None
        kind = "sql " if name in oracle else "rows"
        print(f"{'ok  ' if verdict is None else 'FAIL'} {kind} {time.time() - began:6.2f}s {name} {verdict or ''}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main(*sys.argv[1:])
