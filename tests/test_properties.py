"""Property tests: bucketed Spark operators == brute force over one ordered list."""

import datetime as dt
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from frostline.operators import intervals as I
from frostline.operators import series as S

T0 = dt.datetime(2024, 1, 1)
STATE = st.one_of(st.none(), st.sampled_from([0.0, 1.0, 0.4, 0.6]))
TEMP = st.one_of(st.none(), st.sampled_from([0.005, 0.019, 0.02, 0.05]))
ROWS = st.lists(st.tuples(st.integers(1, 10_000_000), STATE, TEMP), min_size=0, max_size=60,
                unique_by=lambda r: r[0])
BUCKETS = st.sampled_from([60_000_000, 600_000_000, 3_600_000_000, 86_400_000_000])
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _frame(spark, rows):
    data = [(T0 + dt.timedelta(milliseconds=ms), s, t) for ms, s, t in rows]
    return spark.createDataFrame(data, "ts_eastern timestamp_ntz, pulse_tube double, T_MXC double")


def _brute(rows):
    rows = sorted(rows)
    us = [ms * 1000 for ms, _, _ in rows]
    run = sum(us[i] - us[i - 1] for i in range(1, len(rows)) if (rows[i][1] or 0) >= 0.5)
    cold = sum(us[i + 1] - us[i] for i in range(len(rows) - 1) if rows[i][2] is not None and rows[i][2] < 0.02)
    return run / 3.6e9, cold / 3.6e9


@SETTINGS
@given(rows=ROWS, bucket=BUCKETS)
def test_runtime_and_cold_hours_equal_brute_force(spark, rows, bucket):
    out = I.history_stats(_frame(spark, rows), pumps=["pulse_tube"], bucket_us=bucket).first()
    run, cold = _brute(rows)
    if not rows:
        assert out.total_hours_pulse_tube is None
        return
    assert out.total_hours_pulse_tube == run
    assert out.hours_below_20mK_total == cold


@SETTINGS
@given(rows=ROWS, bucket=BUCKETS, hours=st.integers(1, 3))
def test_window_starts_equal_brute_force(spark, rows, bucket, hours):
    as_of = T0 + dt.timedelta(milliseconds=10_000_000)
    out = I.pump_starts(_frame(spark, rows), as_of=as_of.isoformat(sep=" "), hours=hours,
                        pumps=["pulse_tube"], bucket_us=bucket).first()
    start = as_of - dt.timedelta(hours=hours)
    win = [r for r in sorted(rows) if T0 + dt.timedelta(milliseconds=r[0]) >= start]
    if not win:
        assert out.pulse_tube_starts_24h is None
        return
    on = [(s or 0) >= 0.5 for _, s, _ in win]
    expected = sum(1 for i, o in enumerate(on) if o and (i == 0 or not on[i - 1]))
    assert out.pulse_tube_starts_24h == expected


@SETTINGS
@given(n=st.integers(0, 450), m=st.integers(100, 130), bucket=BUCKETS)
def test_downsample_positions(spark, n, m, bucket):
    df = spark.range(n).selectExpr("timestampadd(SECOND, id * 37, TIMESTAMP_NTZ'2024-01-01 00:00:00') AS ts_eastern",
                                   "id")
    got = sorted(r.id for r in S.downsample(df, m, bucket_us=bucket).collect())
    if n <= m:
        assert got == list(range(n))
        return
    step = math.ceil(n / m)
    expected = sorted(set(range(0, n, step)) | {n - 1})
    assert got == expected and len(got) <= m + 1
