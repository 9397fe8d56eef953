"""Run registered queries next to their DuckDB oracles: oracle_check.py SF_DIR [NAME...]."""

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf):
    import duckdb

    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return (0, "")
    if isinstance(value, float):
        return (1, f"{value + 0.0:.9g}")
    return (1, str(value))


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(canonical(r[i]) for i in order) for r in rows])


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(spark, con, sf, query, sql):
    """Differences between the two results, empty when equal."""
    df = query(spark, sf)
    spark_cols, spark_rows = table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    duck_cols, duck_rows = table(names, cur.fetchall())
    problems = []
    if spark_cols != duck_cols:
        return [f"columns {spark_cols} vs {duck_cols}"]
    duck_types = {d[0]: str(d[1]) for d in con.execute(sql).description}
    for field in df.schema.fields:
        want = KINDS.get(field.dataType.simpleString())
        if want and duck_types[field.name].upper() not in (want, "NUMBER" if want != "VARCHAR" else "STRING", want):
            problems.append(f"type of {field.name}: {field.dataType.simpleString()} vs {duck_types[field.name]}")
    if len(spark_rows) != len(duck_rows):
        problems.append(f"rows {len(spark_rows)} vs {len(duck_rows)}")
    elif spark_rows != duck_rows:
        bad = [(a, b) for a, b in zip(spark_rows, duck_rows) if a != b]
        problems.append(f"{len(bad)} rows differ, e.g. {spark_cols}: {bad[0]}")
    if not spark_rows:
        problems.append("empty result")
    return problems


def main():
    import __spark_entry__ as entry
    from strideframe.session import local_session

    sf, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session("8", "oracle-check")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name in wanted or queries:
        start = time.time()
        try:
            if name in oracles:
                problems = compare(spark, con, sf, queries[name], oracles[name])
            else:
                rows = len(queries[name](spark, sf).collect())
                problems = [] if rows else ["no rows"]
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        mark = "ok  " if not problems else "FAIL"
        print(f"{mark} {name} {time.time() - start:.2f}s {'' if name in oracles else '(rows only) '}{' | '.join(problems)}", flush=True)
        if problems:
            failed.append(name)
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    main()
