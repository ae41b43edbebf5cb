"""Run the registered queries and their SQL twins side by side and report differences.

python tools/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from palimpsest.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else f"{value:.9g}"
    if value is not None and type(value).__name__ == "Decimal":
        return f"{float(value):.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return str(value)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--area")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    if args.area:
        import importlib
        from palimpsest.plans.registry import ORACLES, QUERIES
        for area in args.area.split(","):
            importlib.import_module(f"palimpsest.plans.{area}_queries")
    else:
        from palimpsest.plans.catalog import ORACLES, QUERIES
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    bad = []
    for name in args.names or list(QUERIES):
        try:
            start = time.time()
            df = QUERIES[name](spark, folder)
            cols = sorted(df.columns)
            got = sorted(tuple(plain(v) for v in row) for row in df.select(*cols).collect())
            took = time.time() - start
        except Exception as error:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name}: {str(error)[:1500]}", flush=True)
            continue
        if name not in ORACLES:
            print(f"rows {name}: {len(got)} rows {took:.2f}s, no SQL twin", flush=True)
            continue
        try:
            frame = con.sql(ORACLES[name])
            names = frame.columns
            kinds = dict(zip(names, map(str, frame.types)))
            index = [names.index(c) for c in cols] if sorted(names) == cols else None
            if index is None:
                bad.append(name)
                print(f"COLS {name}: {cols} / {sorted(names)}", flush=True)
                continue
            want = sorted(tuple(plain(row[i]) for i in index) for row in frame.fetchall())
        except Exception as error:  # noqa: BLE001
            bad.append(name)
            print(f"SQLFAIL {name}: {str(error)[:1500]}", flush=True)
            continue
        simple = {"LongType": "BIGINT", "IntegerType": "INTEGER", "StringType": "VARCHAR",
                  "DoubleType": "DOUBLE", "BooleanType": "BOOLEAN"}
        types = {f.name: simple.get(type(f.dataType).__name__, str(f.dataType)) for f in df.schema.fields}
        drift = {c: (types[c], kinds[c]) for c in cols if types[c] != kinds[c]}
        if got == want:
            print(f"ok   {name}: {len(got)} rows {took:.2f}s" + (f" TYPES {drift}" if drift else "")
                  + (" EMPTY" if not got else ""), flush=True)
        else:
            bad.append(name)
            extra = [r for r in got if r not in set(want)][:3]
            lack = [r for r in want if r not in set(got)][:3]
            print(f"DIFF {name}: {len(got)} / {len(want)} rows; cols {cols}\n   spark {extra}\n   sql   {lack}",
                  flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
