"""Run queries next to their SQL equivalents: ``python tests/compare.py [sf] [name ...]``."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def rows_of(arrow):
    names = sorted(arrow.column_names)
    columns = [arrow.column(n).to_pylist() for n in names]
    return sorted((tuple(normal(v) for v in row) for row in zip(*columns)), key=repr)


def compare(spark_df, con, sql):
    """Problems found, empty when both sides agree."""
    ours, theirs = spark_df.toArrow(), con.execute(sql).to_arrow_table()
    problems = []
    if sorted(ours.column_names) != sorted(theirs.column_names):
        return [f"columns {sorted(ours.column_names)} / {sorted(theirs.column_names)}"], ours.num_rows
    for n in ours.column_names:
        a, b = str(ours.schema.field(n).type), str(theirs.schema.field(n).type)
        if not a.startswith("list") and a.replace("large_", "") != b.replace("large_", ""):
            problems.append(f"type of {n}: {a} / {b}")
    a, b = rows_of(ours), rows_of(theirs)
    if a != b:
        missing = [r for r in a if r not in set(b)][:3]
        extra = [r for r in b if r not in set(a)][:3]
        problems.append(f"rows {len(a)} / {len(b)}; ours only {missing}; theirs only {extra}")
    return problems, ours.num_rows


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8") \
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false") \
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in sys.argv[2:] or queries:
        started = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                problems, n = compare(df, con, oracles[name])
            else:
                problems, n = [], df.toArrow().num_rows
        except Exception as error:  # report and go on with the other queries
            problems, n = [f"{type(error).__name__}: {str(error)[:900]}"], -1
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} rows={n} {'S' if name in oracles else 'R'} {time.time() - started:.1f}s", flush=True)
        for p in problems:
            print("     ", p[:1500], flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
