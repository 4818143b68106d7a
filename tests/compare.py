"""Run registered queries next to their SQL: python tests/compare.py SF_DIR [name ...]"""

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(value):
    if value is None:
        return "\0"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    """(message or None, spark seconds, SQL seconds, rows)"""
    start = time.time()
    df = query(spark, sf_dir)
    got = df.collect()
    spent = time.time() - start
    if sql is None:
        return None, spent, 0.0, len(got)
    start = time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    sql_spent = time.time() - start
    problem = None
    if sorted(names) != sorted(df.columns):
        problem = f"columns {sorted(df.columns)} != {sorted(names)}"
    else:
        a, b = rows_of(df.columns, got), rows_of(names, want)
        if a != b:
            bad = [(x, y) for x, y in zip(a, b) if x != y][:2]
            problem = f"rows {len(a)} vs {len(b)}, first differences {bad}"
    return problem, spent, sql_spent, len(got)


def main():
    from tests.session import make_session

    import __spark_entry__ as entry

    sf_dir, chosen = sys.argv[1], sys.argv[2:]
    spark, con = make_session(), duck(sf_dir)
    oracles = entry.oracle_sql()
    failed = 0
    for name, query in entry.queries().items():
        if chosen and name not in chosen:
            continue
        try:
            problem, spent, sql_spent, n = compare(spark, con, name, query, oracles.get(name), sf_dir)
        except Exception as error:  # report and go on with the other queries
            problem, spent, sql_spent, n = f"{type(error).__name__}: {str(error)[:600]}", 0, 0, 0
        failed += problem is not None
        state = "FAIL" if problem else ("ok" if name in oracles else "rows")
        print(f"{state:5} {name:28} rows={n:7} spark={spent:6.2f}s sql={sql_spent:6.2f}s {problem or ''}", flush=True)
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    main()
