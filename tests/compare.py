"""Run registered queries and their SQL side by side: ``python tests/compare.py [names]``.

``COMPARE_DIR`` names the data folder.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


def oracle_rows(folder: str, sql: str) -> tuple[list[tuple[str, str]], list[tuple]]:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    found = con.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    schema = [(found.columns[i], TYPES.get(str(found.types[i]), str(found.types[i]))) for i in order]
    return schema, sorted((tuple(row[i] for i in order) for row in found.fetchall()), key=repr)


def spark_rows(df) -> tuple[list[tuple[str, str]], list[tuple]]:
    names = sorted(df.columns)
    types = dict(df.dtypes)
    rows = [tuple(row) for row in df.select(*names).collect()]
    return [(n, types[n]) for n in names], sorted(rows, key=repr)


def main() -> None:
    import __spark_entry__ as contract
    from docloom.session import get_session

    folder = os.environ.get("COMPARE_DIR", "/root/testdata/sf0.01")
    spark = get_session("local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="16g")
    queries, sql = contract.queries(), contract.oracle_sql()
    bad = []
    for name in sys.argv[1:] or queries:
        start = time.time()
        try:
            mine = spark_rows(queries[name](spark, folder))
            took = time.time() - start
            theirs = oracle_rows(folder, sql[name])
        except Exception as err:  # noqa: BLE001 - a report goes on to the next query
            print(f"{name:24s} ERROR {str(err)[:1500]}", flush=True)
            bad.append(name)
            continue
        same = mine == theirs
        print(f"{name:24s} {'ok ' if same else 'BAD'} {took:6.2f}s {len(mine[1])} rows", flush=True)
        if not same:
            bad.append(name)
            print("  schema", mine[0], theirs[0])
            a, b = set(map(repr, mine[1])), set(map(repr, theirs[1]))
            print("  rows", len(mine[1]), len(theirs[1]), "only mine", len(a - b), "only sql", len(b - a))
            for row in sorted(a - b)[:3] + ["--"] + sorted(b - a)[:3]:
                print("   ", row[:300])
    print("bad:", bad)


if __name__ == "__main__":
    main()
