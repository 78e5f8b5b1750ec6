"""A device holding a third of all rows: exact results, and no task sees the whole device."""

import duckdb
from pyspark.sql import functions as F

from helpers import SF01
from frostline.functions.columns import bucket_of, micros
from frostline.operators import intervals as I
from frostline.sources.events import events_to_readings, oracle_readings_cte

HOT = "CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END"


def _hot_readings(spark):
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    return events_to_readings(ev).withColumn("device_id", F.expr(HOT.replace("user_id", "device_id")))


def test_hot_device_results_match_global_window(spark):
    got = {r.device_id: r for r in I.runtime_hours(_hot_readings(spark), keys=["device_id"]).collect()}
    sql = (oracle_readings_cte().replace("user_id AS device_id", f"{HOT} AS device_id")
           + "\nSELECT device_id, CAST(SUM(CASE WHEN pu IS NOT NULL AND COALESCE(pulse_tube, 0) >= 0.5 "
             "THEN us - pu ELSE 0 END) AS DOUBLE) / 3600000000.0 AS h FROM (SELECT device_id, pulse_tube, "
             "epoch_us(ts_eastern) AS us, LAG(epoch_us(ts_eastern)) OVER (PARTITION BY device_id ORDER BY ts_eastern)"
             " AS pu FROM readings) GROUP BY device_id")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF01}/events.parquet')")
    exp = dict(con.execute(sql).fetchall())
    assert len(got) == len(exp) and got[0].total_hours_pulse_tube == exp[0]
    assert all(got[d].total_hours_pulse_tube == v for d, v in exp.items())


def test_hot_device_is_spread_over_buckets(spark):
    r = _hot_readings(spark)
    hot_rows = r.filter("device_id = 0").count()
    assert hot_rows * 3 >= r.count() * 0.95                  # about a third of all rows
    per_bucket = r.filter("device_id = 0").groupBy(bucket_of(micros("ts_eastern"), 3_600_000_000).alias("b")).count()
    stats = per_bucket.agg(F.count("*").alias("n"), F.max("count").alias("mx")).first()
    assert stats.n > 500 and stats.mx < hot_rows / 100      # >500 window partitions, each < 1 % of the device
