"""Compare registered queries with their SQL on DuckDB: ``python tools/check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        if isinstance(value, float) and math.isnan(value):
            return "nan"
        return float(value) + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(df, con, sql: str) -> list[str]:
    problems = []
    columns = sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != columns:
        return [f"columns {columns} != {sorted(names)}"]
    at = [names.index(c) for c in columns]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    if sum(ours.values()) != sum(theirs.values()):
        problems.append(f"rows {sum(ours.values())} != {sum(theirs.values())}")
    if ours != theirs:
        a, b = ours - theirs, theirs - ours
        problems.append(f"{sum(a.values())} rows differ {columns}\n     ours   {sorted(map(str, a))[:2]}\n     theirs {sorted(map(str, b))[:2]}")
    types = {c: t for c, t in zip(names, con.execute(f"DESCRIBE {sql}").fetchall())}
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}
    for c, t in df.dtypes:
        if kinds.get(t, t) != types[c][1] and not (t == "bigint" and types[c][1] == "HUGEINT"):
            problems.append(f"type of {c}: {t} vs {types[c][1]}")
    return problems


def main() -> None:
    from hustings.registry import QUERIES
    from hustings.session import get_spark

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = get_spark(master="local[8]", **{"spark.sql.shuffle.partitions": "8"})
    con = duck(sf_dir)
    bad = 0
    for name in wanted:
        q = QUERIES[name]
        start = time.time()
        try:
            df = q.run(spark, sf_dir)
            problems = compare(df, con, q.sql) if q.sql else ([] if df.count() else ["no rows"])
        except Exception as e:  # report and go on
            problems = [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(problems)
        print(f"{'BAD ' if problems else 'ok  '} {name} {time.time() - start:.1f}s", *problems, sep="\n     ", flush=True)
    print(f"{len(wanted) - bad}/{len(wanted)} match")


if __name__ == "__main__":
    main()
