import pytest
from pyspark.sql import functions as F

from helpers import SF001, SF01, rows_df
from frostline.operators import intervals as I
from frostline.sources.events import readings_from_events

# Anchor values computed independently from the events adapter (FIXTURES.md).
ANCHORS = {
    SF001: dict(pt=346.98160855416666, tb=249.13481167722222, cold=42.43514364166667,
                streak=1.0938847275, starts=(11, 14), rows=41),
    SF01: dict(pt=304.6222598808333, tb=239.86813584527778, cold=48.243349790277776,
               streak=0.0, starts=(82, 110), rows=329),
}


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_anchor_values(spark, sf):
    r = readings_from_events(spark, sf)
    a = ANCHORS[sf]
    h = I.history_stats(r).first()
    assert h.total_hours_pulse_tube == a["pt"]
    assert h.total_hours_turbo_1 == a["tb"]
    assert h.hours_below_20mK_total == a["cold"]
    assert h.hours_below_20mK_current == pytest.approx(a["streak"], abs=1e-12)
    w = I.window_stats(r).first()
    assert (w.pulse_tube_starts_24h, w.turbo_1_starts_24h) == a["starts"]
    assert w.rows_in_window == a["rows"]


@pytest.mark.parametrize("bucket_us", [60_000_000, 600_000_000, 86_400_000_000, 10**15])
def test_bucket_size_does_not_change_results(spark, bucket_us):
    """Property: stitched per-bucket partials equal the single global window."""
    r = readings_from_events(spark, SF001)
    ref = I.history_stats(r, keys=["device_id"], bucket_us=10**15).orderBy("device_id").collect()
    got = I.history_stats(r, keys=["device_id"], bucket_us=bucket_us).orderBy("device_id").collect()
    assert ref == got
    ref_w = I.window_stats(r, hours=240, bucket_us=10**15).collect()
    got_w = I.window_stats(r, hours=240, bucket_us=bucket_us).collect()
    assert ref_w == got_w


def test_runtime_backward_attribution_and_null_off(spark):
    rows = [("2024-01-01 00:00:00", None), ("2024-01-01 01:00:00", 1.0), ("2024-01-01 03:00:00", 0.0),
            ("2024-01-01 04:00:00", 1.0), ("2024-01-01 04:30:00", None)]
    df = rows_df(spark, rows, ["pulse_tube"])
    out = I.runtime_hours(df, pumps=["pulse_tube"], bucket_us=3_600_000_000).first()
    # gaps counted when the *current* row is on: 0->1h (on) + 3h->4h (on) = 2 h
    assert out.total_hours_pulse_tube == 2.0


def test_cold_forward_attribution_and_streak(spark):
    rows = [("2024-01-01 00:00:00", 0.01), ("2024-01-01 01:00:00", 0.05), ("2024-01-01 02:00:00", 0.01),
            ("2024-01-01 02:30:00", None), ("2024-01-01 04:00:00", 0.015)]
    df = rows_df(spark, rows, ["T_MXC"])
    h = I.history_stats(df, pumps=(), bucket_us=1_800_000_000).first()
    # forward: 0->1h cold (1 h) + 2h->2.5h cold (0.5 h); NULL row counts 0
    assert h.hours_below_20mK_total == 1.5
    # last warm row at 1h, streak starts at the next row (2h) -> 4h - 2h
    assert h.hours_below_20mK_current == 2.0


def test_streak_zero_when_latest_null_or_warm(spark):
    df = rows_df(spark, [("2024-01-01 00:00:00", 0.01), ("2024-01-01 01:00:00", None)], ["T_MXC"])
    assert I.cold_streak(df).first()[0] == 0.0
    df2 = rows_df(spark, [("2024-01-01 00:00:00", 0.01), ("2024-01-01 01:00:00", 0.03)], ["T_MXC"])
    assert I.cold_streak(df2).first()[0] == 0.0
    # never warm: streak from the first row
    df3 = rows_df(spark, [("2024-01-01 00:00:00", 0.01), ("2024-01-01 05:00:00", 0.01)], ["T_MXC"])
    assert I.cold_streak(df3, bucket_us=3_600_000_000).first()[0] == 5.0


def test_starts_filter_then_lag(spark):
    rows = [("2024-01-01 00:00:00", 0.0), ("2024-01-01 10:00:00", 1.0), ("2024-01-01 11:00:00", 1.0),
            ("2024-01-01 12:00:00", None), ("2024-01-01 13:00:00", 1.0)]
    df = rows_df(spark, rows, ["pulse_tube"])
    # window from 11:00: first row already on counts as a start; NULL is off -> second start
    out = I.pump_starts(df, as_of="2024-01-01 13:00:00", hours=2, pumps=["pulse_tube"]).first()
    assert out.pulse_tube_starts_24h == 2


def test_empty_window_is_null(spark):
    df = rows_df(spark, [("2024-01-01 00:00:00", 1.0)], ["pulse_tube"])
    out = I.pump_starts(df, as_of="2024-02-01 00:00:00", hours=1, pumps=["pulse_tube"]).first()
    assert out.pulse_tube_starts_24h is None


def test_latest_row_empty_table_has_no_row(spark):
    df = rows_df(spark, [("2024-01-01 00:00:00", 1.0)], ["T_MXC"]).filter(F.lit(False))
    assert I.latest_row(df).count() == 0


def test_window_filter_reaches_parquet_scan(spark):
    r = readings_from_events(spark, SF01)
    plan = I.window_minmax(r)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in plan


def test_single_partition_only_above_bucket_partials(spark):
    """Single device: the only SinglePartition exchange carries the bucket table
    (above the per-bucket aggregate), never raw rows."""
    r = readings_from_events(spark, SF01)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = I.history_stats(r)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    single = [i for i, line in enumerate(plan) if "Exchange SinglePartition" in line]
    raw = [i for i, line in enumerate(plan) if "Exchange hashpartitioning(_b" in line]
    agg = [i for i, line in enumerate(plan) if "HashAggregate(keys=[_b" in line]
    assert len(single) == 1 and len(raw) == 1 and agg
    # tree printed top-down: SinglePartition, then the bucket aggregate, then the raw-row exchange
    assert single[0] < min(agg) < raw[0]


def test_per_device_metrics_plan_has_no_single_partition(spark):
    from frostline.plans import queries as Q
    r = readings_from_events(spark, SF01)
    plan = Q.metrics(r, as_of="2024-01-30 23:57:12", keys=["device_id"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert "hashpartitioning(device_id" in plan and "_b" in plan
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line]
    # full history once (W1-W3 columns only), latest row in one pass, 24 h window with a pushed time filter
    assert len(scans) == 3
    assert sum("GreaterThanOrEqual(ts," in line for line in scans) == 1
    assert "GreaterThanOrEqual(ts,2024-01-29T23:57:12)" in plan


def test_results_do_not_depend_on_session_time_zone(spark):
    from frostline.functions.columns import from_micros, micros
    from frostline.operators import series as S
    r = readings_from_events(spark, SF001)
    gap = spark.createDataFrame([("2024-03-10 02:30:00",)], "t string").selectExpr(
        "CAST(t AS TIMESTAMP_NTZ) AS ts_eastern")
    out = {}
    for tz in ("UTC", "America/New_York", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", tz)
        try:
            out[tz] = (I.history_stats(r, keys=["device_id"]).orderBy("device_id").collect(),
                       S.downsample(r.select("ts_eastern", "event_id"), 100).orderBy("event_id").collect(),
                       gap.select(micros("ts_eastern").alias("us"), from_micros(micros("ts_eastern")).alias("b")).first())
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert out["UTC"] == out["America/New_York"] == out["Asia/Kolkata"]
    assert str(out["America/New_York"][2].b) == "2024-03-10 02:30:00"   # a DST-gap time survives
