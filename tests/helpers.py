"""Helpers shared by the tests: table folders, small frames, rows against SQL."""

import math

import duckdb

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def rows_df(spark, rows, cols):
    """Readings-like DataFrame from (ts_text, value...) tuples."""
    from pyspark.sql import functions as F
    schema = ", ".join(["ts string"] + [f"{c} double" for c in cols])
    df = spark.createDataFrame(rows, schema)
    return df.select(F.col("ts").cast("timestamp_ntz").alias("ts_eastern"), *cols)


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def sorted_rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in recs),
                  key=lambda t: tuple((x is None, str(x)) for x in t))


def duck(folder, *tables):
    """A DuckDB connection with views of the tables of a folder."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def assert_equals_sql(df, con, sql):
    """The rows and columns of ``df`` are those of ``sql`` (in any order)."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted_rows(df.columns, [tuple(r) for r in df.collect()]) == sorted_rows(names, cur.fetchall())
