"""Run one registered query against its SQL answer on DuckDB."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(repr(v)) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _cell(x)) for k, x in v.items()))
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(df, con, sql):
    """None when equal, else a short account of the difference."""
    left_names, left = _rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    right_names, right = _rows(rel.columns, rel.fetchall())
    if left_names != right_names:
        return f"columns {left_names} != {right_names}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}: {left[:3]} / {right[:3]}"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(left)} rows differ, e.g. {wrong[:3]}"
    types = {
        n: (type(a).__name__, type(b).__name__)
        for row_a, row_b in zip(left, right)
        for n, a, b in zip(left_names, row_a, row_b)
        if a is not None and type(a) is not type(b)
    }
    return f"types differ {types}" if types else None


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from millrace.session import local_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session(8)
    sf_dir = f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    queries, answers = entry.queries(), entry.oracle_sql()
    for name, query in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in answers:
                verdict = compare(df, con, answers[name]) or "ok"
            else:
                verdict = f"rows only: {df.count()}"
        except Exception as exc:  # noqa: BLE001
            verdict = f"ERROR {type(exc).__name__}: {str(exc)[:1500]}"
        print(f"{name:28s} {time.time() - start:6.1f}s  {verdict[:1600]}", flush=True)
