"""Compare registered queries with their SQL on DuckDB: `python tools/check.py [--sf 0.01] [keys]`."""

from __future__ import annotations

import importlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from siftmill import catalog  # noqa: E402
from siftmill.session import get_spark  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return f"{value + 0.0:.5f}".replace("-0.00000", "0.00000")
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(made, key=str)


_UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def unwanted(df) -> list[str]:
    """Operators of the physical plan that do not scale: pair products, row-at-a-time Python."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [name for name in _UNWANTED if name in plan]


def compare(spark, con, key: str, folder: str) -> str:
    df = catalog.QUERIES[key](spark, folder)
    found = unwanted(df)
    if found:
        return f"FAIL plan holds {found}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if key not in catalog.ORACLES:
        return f"rows-only ({len(got[1])} rows)"
    answer = con.execute(catalog.ORACLES[key])
    kinds = {c[0]: str(c[1]) for c in answer.description}
    want = rows_of(list(kinds), answer.fetchall())
    if got[0] != want[0]:
        return f"FAIL columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"FAIL rows {len(got[1])} != {len(want[1])}"
    wrong = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if wrong:
        return f"FAIL {len(wrong)} values differ, e.g. {str(wrong[0])[:400]}"
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}
    for name, kind in df.dtypes:
        if pairs.get(kind) != kinds[name]:
            return f"ok ({len(got[1])} rows) TYPE {name}: {kind} / {kinds[name]}"
    return f"ok ({len(got[1])} rows)"


def main() -> None:
    args = sys.argv[1:]
    sf = "0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    loaded = [a for a in args if a.startswith("@")]
    if loaded:
        for name in loaded:
            importlib.import_module(f"siftmill.catalog.{name[1:]}")
    else:
        catalog.load_all()
    keys = [a for a in args if not a.startswith("@")] or list(catalog.QUERIES)
    folder = f"/root/testdata/sf{sf}"
    spark = get_spark(
        "check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for key in keys:
        start = time.time()
        try:
            said = compare(spark, con, key, folder)
        except Exception as error:  # noqa: BLE001
            said = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        bad += said.startswith(("FAIL", "ERROR"))
        print(f"{key:26s} {time.time() - start:6.2f}s {said}", flush=True)
    print(f"{len(keys)} checked, {bad} bad")


if __name__ == "__main__":
    main()
