"""Run queries in Spark and their SQL in DuckDB and compare all values.

    python -m checks.compare [sf_dir] [query ...]
"""

import sys
import time

import duckdb

from veilscan.session import builder, ship

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


def compare(spark, con, sf_dir, name, run, sql):
    started = time.time()
    df = run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spark_time = time.time() - started
    if sql is None:
        return None, len(got), spark_time, ""
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return False, len(got), spark_time, f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = rows(df.columns, got), rows(columns, want)
    if a == b:
        return True, len(got), spark_time, ""
    only_a, only_b = sorted(set(map(repr, a)) - set(map(repr, b))), sorted(set(map(repr, b)) - set(map(repr, a)))
    return False, len(got), spark_time, f"rows {len(a)} / {len(b)}\n    spark: {only_a[:2]}\n    sql:   {only_b[:2]}"


def main(argv):
    from checks.queries import ORACLE, QUERIES

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = (
        builder("compare").master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    con = connect(sf_dir)
    failed = []
    for name in names:
        try:
            ok, n, seconds, why = compare(spark, con, sf_dir, name, QUERIES[name], ORACLE.get(name))
        except Exception as problem:  # report and go on with the next query
            ok, n, seconds, why = False, 0, 0.0, str(problem)[:600]
        if ok is False:
            failed.append(name)
        print(f"{'ok  ' if ok else 'rows' if ok is None else 'FAIL'} {name:26} {n:8} {seconds:6.1f}s {why}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
