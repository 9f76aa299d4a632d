"""Run every registered query against its SQL: python tests/check_all.py [folder] [name ...]"""

import sys
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from tests.conftest import make_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark, con = make_session(), connect(folder)
    bad = 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        try:
            verdict, rows, seconds = compare(spark, con, folder, run, entry.oracle_sql().get(name))
        except Exception as error:
            verdict, rows, seconds = "".join(traceback.format_exception_only(error))[:900], -1, 0.0
        bad += bool(verdict)
        print(f"{name:28} {rows:8} {seconds:7.2f}s  {verdict or 'ok'}", flush=True)
    print("failures:", bad)
