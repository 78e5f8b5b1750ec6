"""Stream = batch: files in any time order, state across micro-batches."""

import tempfile
import time

import pytest
from pyspark.sql import functions as F

from helpers import SF001
from frostline.operators import intervals as I
from frostline.operators.series import to_series
from frostline.schema import TS
from frostline.sources.events import events_to_readings
from frostline.streaming import streams as T

LONG = "3650 days"


def _move_one(spark, df, folder, name):
    """Write one file and move it into the source folder (listed by modification time)."""
    df.coalesce(1).write.parquet(f"{folder}/tmp-{name}")
    jvm = spark.sparkContext._jvm
    src = jvm.org.apache.hadoop.fs.Path(f"{folder}/tmp-{name}")
    fs = src.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    f = [s.getPath() for s in fs.listStatus(src) if s.getPath().getName().endswith(".parquet")][0]
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{folder}/in"))
    fs.rename(f, jvm.org.apache.hadoop.fs.Path(f"{folder}/in/events-{name}.parquet"))
    time.sleep(1.1)


@pytest.fixture(scope="module")
def shuffled(spark):
    """The events in four files: the last days first, and rows of one day in two files."""
    folder = tempfile.mkdtemp(prefix="frostline-stream-")
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    odd = F.col("event_id") % 2 == 1
    for i, cond in enumerate([late & odd, ~late & odd, late & ~odd, ~late & ~odd]):
        _move_one(spark, ev.filter(cond), folder, i)
    return folder, events_to_readings(ev)


def _drain(spark, folder, make, mode):
    run = tempfile.mkdtemp(prefix="frostline-drain-")
    stream = T.events_stream(spark, f"{folder}/in", max_files_per_trigger=1)
    return T.run_available_now(make(stream), f"{run}/out", f"{run}/ck", mode=mode)


def test_counters_equal_batch(spark, shuffled):
    folder, readings = shuffled
    rows = _drain(spark, folder, lambda s: T.runtime_counters(s, delay=LONG), "update")
    cell = ["device_id", "bucket"]
    assert rows.groupBy(*cell).count().agg(F.max("count")).first()[0] >= 2          # cells were touched by several batches
    got = {r.device_id: r for r in T.latest_counters(T.final_rows(rows, cell)).collect()}
    exp = {r.device_id: r for r in I.runtime_hours(readings, keys=["device_id"]).collect()}
    starts = {r.device_id: r for r in I.window_stats(readings, hours=24 * 365, keys=["device_id"],
                                                       pumps=T.COUNTER_PUMPS, minmax=()).collect()}
    assert set(got) == set(exp) and sum(r.rows for r in got.values()) == readings.count()
    for d, e in exp.items():
        for p in T.COUNTER_PUMPS:
            assert got[d][f"total_hours_{p}"] == e[f"total_hours_{p}"]
            assert got[d][f"{p}_starts"] == starts[d][f"{p}_starts_24h"]


def test_minutes_lose_nothing(spark, shuffled):
    folder, readings = shuffled
    out = T.final_rows(_drain(spark, folder, lambda s: T.minute_last_values(s, keys=["device_id"], delay=LONG), "update"), ["device_id", TS])
    got = sorted(map(tuple, T.minute_points(out, keys=["device_id"]).collect()))
    points = to_series(readings, keys=["device_id"]).withColumn("m", F.date_trunc("minute", TS).cast("timestamp_ntz"))
    want = points.groupBy("device_id", "key", "m").agg(F.max_by("value", TS))
    assert got == sorted(map(tuple, want.collect()))


def test_sliding_windows_lose_nothing(spark, shuffled):
    folder, readings = shuffled
    hours = T.final_rows(_drain(spark, folder, lambda s: T.hour_minmax(s, delay=LONG), "update"), ["hour"])
    got = {r.window_end: r for r in T.sliding_minmax(hours).collect()}
    for end in sorted(got)[::97]:
        before = readings.filter(F.col(TS) < F.lit(end))
        want = I.window_minmax(before, as_of=end).first()
        assert all(got[end][c] == want[c] for c in want.asDict())


def test_rows_inside_the_delay_are_kept(spark):
    folder = tempfile.mkdtemp(prefix="frostline-late-")
    rows = [(1, "2024-01-01 00:00:00", 7, "click", 1.0, "{}"), (3, "2024-01-01 02:00:00", 7, "click", 1.0, "{}")]
    late = [(2, "2024-01-01 01:00:00", 7, "click", 1.0, "{}")]
    schema = "event_id long, ts string, user_id long, event_type string, value double, props string"
    for i, chunk in enumerate([rows, late]):
        _move_one(spark, spark.createDataFrame(chunk, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz")), folder, i)
    rows = _drain(spark, folder, lambda s: T.runtime_counters(s, delay="3 hours"), "update")
    out = T.latest_counters(T.final_rows(rows, ["device_id", "bucket"])).first()
    # event 3 has event_id % 3 == 0 -> turbo on: the hour since the late row counts
    assert out.rows == 3 and out.total_hours_turbo_1 == 1.0 and out.turbo_1_starts == 1
    with pytest.raises(TypeError):
        T.runtime_counters(spark.range(1))          # a delay must be named


def test_rows_beyond_the_delay_are_dropped_and_cells_close(spark):
    folder = tempfile.mkdtemp(prefix="frostline-drop-")
    schema = "event_id long, ts string, user_id long, event_type string, value double, props string"
    chunks = [[(1, "2024-01-01 00:00:00", 7, "click", 1.0, "{}"), (2, "2024-01-02 00:00:00", 7, "click", 2.0, "{}")],
              [(4, "2024-01-02 00:10:00", 7, "click", 3.0, "{}")],
              [(3, "2024-01-01 00:30:00", 7, "click", 9.0, "{}"), (5, "2024-01-02 00:20:00", 7, "click", 3.0, "{}")]]
    for i, chunk in enumerate(chunks):
        _move_one(spark, spark.createDataFrame(chunk, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz")), folder, i)
    closed = _drain(spark, folder, lambda s: T.hour_minmax(s, columns=["P1"], delay="3 hours"), "append").collect()
    # the first hour came out once, without the row that was a day late; the newest hour is still open
    assert [(str(r.hour), r.P1_min, r.P1_max) for r in closed] == [("2024-01-01 00:00:00", 0.1, 0.1)]


def test_no_python_in_the_counters_plan(spark, shuffled):
    stream = T.events_stream(spark, f"{shuffled[0]}/in")
    plan = T.runtime_counters(stream, delay="1 day")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_counters_of_any_cell_size(spark, shuffled):
    folder, readings = shuffled
    for size in (60_000_000, 21_600_000_000):
        rows = _drain(spark, folder, lambda s, b=size: T.runtime_counters(s, keys=(), bucket_us=b, delay=LONG), "update")
        got = T.latest_counters(T.final_rows(rows, ["bucket"]), keys=()).first()
        want = I.runtime_hours(readings).first()
        assert all(got[c] == want[c] for c in want.asDict())


def test_sliding_windows_over_gaps_equal_plain(spark):
    """Every window that holds an hour row, over gaps longer and shorter than a window, before and after 1970."""
    import datetime as dt
    hours = [-50, -3, 0, 1, 5, 23, 24, 47, 49, 200, 225, 226, 300]
    rows = [(d, dt.datetime(1970, 1, 1) + dt.timedelta(hours=h), None if h % 5 == 0 else float(h * 7 % 11), float(h)) for d in (1, 2) for h in hours[d - 1:]]
    df = spark.createDataFrame(rows, "device_id int, hour timestamp_ntz, P1_min double, P1_max double")
    got = {(r.device_id, r.window_end): (r.P1_min_24h, r.P1_max_24h) for r in T.sliding_minmax(df, keys=["device_id"], columns=["P1"]).collect()}
    want = {}
    for d, h, lo, hi in rows:
        for j in range(1, 25):
            at = (d, h + dt.timedelta(hours=j))
            a, b = want.get(at, (None, None))
            want[at] = (lo if a is None else a if lo is None else min(a, lo), hi if b is None else max(b, hi))
    assert got == want
    plan = T.sliding_minmax(df, keys=["device_id"], columns=["P1"])._jdf.queryExecution().toString()
    assert "HashAggregate" not in plan          # no copies to aggregate: every window end is made once
