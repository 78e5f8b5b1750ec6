"""Adapter: the generic ``events`` table viewed as a multi-device readings table.

One event row becomes one reading row keyed by ``(device_id, ts_eastern)``.
The projection is a list of SQL expressions evaluated by ``selectExpr`` in
Spark and rendered as text for the DuckDB oracle, so both engines run the
identical adapter.  It is a pure projection: no shuffle, and Catalyst prunes
it down to the columns a query actually uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The adapter projection shared by Spark and the SQL oracle.
READINGS_FROM_EVENTS = [
    ("ts", "ts_eastern"),
    ("event_id", "event_id"),
    ("user_id", "device_id"),
    ("CAST(value * 0.1 AS DOUBLE)", "P1"),
    ("CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(value * 0.01 AS DOUBLE) END", "P2"),
    ("CAST(value * 0.001 AS DOUBLE)", "P3"),
    ("CASE WHEN event_type = 'click' OR event_type = 'view' THEN CAST(value * 2 AS DOUBLE) END", "P4"),
    ("CASE WHEN event_id % 4 = 0 THEN CAST(value AS DOUBLE) END", "P5"),
    ("CAST(value / 100 AS DOUBLE)", "P6"),
    ("CASE WHEN event_type = 'click' THEN CAST(value AS DOUBLE) END", "T_50K"),
    ("CASE WHEN event_type = 'view' THEN CAST(value / 10 AS DOUBLE) END", "T_4K"),
    ("CASE WHEN event_type = 'signup' THEN CAST(value / 50 AS DOUBLE) END", "T_Still"),
    ("CASE WHEN event_type = 'purchase' THEN CAST(value / 1000 AS DOUBLE) END", "T_MXC"),
    ("CASE WHEN event_type = 'error' THEN CAST(value AS DOUBLE) END", "Flow"),
    ("CAST(NULL AS DOUBLE)", "total_hours_scroll_1"),
    ("CAST(NULL AS DOUBLE)", "total_hours_scroll_2"),
    ("CAST(NULL AS DOUBLE)", "total_hours_turbo_1"),
    ("CAST(NULL AS DOUBLE)", "total_hours_pulse_tube"),
    ("CASE WHEN event_id % 4 = 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END", "scroll_1"),
    ("CASE WHEN event_id % 11 = 0 THEN NULL WHEN user_id % 3 = 0 THEN CAST(1.0 AS DOUBLE) "
     "ELSE CAST(0.0 AS DOUBLE) END", "scroll_2"),
    ("CASE WHEN event_id % 3 = 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END", "turbo_1"),
    ("CASE WHEN event_id % 7 = 0 THEN NULL WHEN user_id % 2 = 0 THEN CAST(1.0 AS DOUBLE) "
     "ELSE CAST(0.0 AS DOUBLE) END", "pulse_tube"),
    ("'day-' || CAST(CAST(ts AS DATE) AS STRING)", "source_file"),
]
# End of fixed values.


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_to_readings(events: DataFrame) -> DataFrame:
    """Project ``events`` to the readings columns plus ``device_id`` and ``event_id``."""
    return events.selectExpr(*[f"{e} AS {a}" for e, a in READINGS_FROM_EVENTS])


def readings_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_to_readings(read_table(spark, sf_dir, "events"))


def readings_sql() -> str:
    return "SELECT " + ",\n  ".join(f"{e} AS {a}" for e, a in READINGS_FROM_EVENTS) + "\nFROM events"


def oracle_readings_cte() -> str:
    """``WITH readings AS (...)`` prefix for DuckDB oracle queries."""
    return "WITH readings AS (\n" + readings_sql() + "\n)"
