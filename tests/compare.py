"""Run every query in Spark and in DuckDB and compare the rows.

Usage: python tests/compare.py [sf_dir] [query ...]
"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def kind(type_name):
    """Types that mean the same in both engines share a name."""
    name = type_name.lower()
    return {"varchar": "string", "long": "bigint", "int": "integer"}.get(name, name)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def compare(spark, con, name, query, sql, sf_dir):
    """None when both agree, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    types = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    wanted = {c[0]: kind(str(c[1])) for c in cursor.description}
    if types != wanted:
        return f"types { {k: (v, wanted[k]) for k, v in types.items() if v != wanted[k]} }"
    if got != want:
        only_got = [r for r in got if r not in set(want)][:2]
        only_want = [r for r in want if r not in set(got)][:2]
        return f"rows {len(got)} vs {len(want)}\n  spark  {only_got}\n  duckdb {only_want}"
    return None if got else "no rows"


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    chosen = sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name in chosen:
        start = time.time()
        try:
            verdict = compare(spark, con, name, entry.queries()[name], oracles[name], sf_dir)
        except Exception as error:  # one broken query must not hide the others
            verdict = f"{type(error).__name__}: {str(error)[:600]}"
        bad += verdict is not None
        print(f"{name:24s} {time.time() - start:6.1f}s {verdict or 'ok'}", flush=True)
    missing = set(entry.queries()) ^ set(oracles)
    print(f"{len(chosen) - bad} of {len(chosen)} agree; without SQL or query: {sorted(missing)}")
    return bad


if __name__ == "__main__":
    sys.exit(main())
