"""Compare queries with their SQL oracles: python tests/compare.py FOLDER [names]."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder):
    import duckdb
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 6)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def difference(spark, con, query, sql, folder):
    """None when equal, else a short text."""
    df = query(spark, folder)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    theirs = rows_of(names, result.fetchall())
    if mine == theirs:
        return None
    pairs = [(a, b) for a, b in zip(mine, theirs) if a != b][:2]
    return f"{len(mine)} against {len(theirs)} rows; {str(pairs)[:1500]}"


def main():
    from __spark_entry__ import oracle_sql, queries
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con, oracles, bad = connect(sys.argv[1]), oracle_sql(), 0
    for name in sys.argv[2:] or list(oracles):
        start = time.time()
        try:
            found = difference(spark, con, queries()[name], oracles[name], sys.argv[1])
        except Exception as error:
            found = f"ERROR {str(error)[:1200]}"
        bad += found is not None
        print(f"{'OK  ' if found is None else 'DIFF'} {name} {time.time() - start:.1f}s {found or ''}", flush=True)
    print("different:", bad)


if __name__ == "__main__":
    main()
