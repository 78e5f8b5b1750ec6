import pytest
from pyspark.sql import functions as F

from helpers import SF001, rows_df
from frostline.operators import series as S
from frostline.sources.events import readings_from_events

SIZES = [(101, 51), (199, 100), (200, 101), (201, 68), (300, 101), (1000, 101), (1050, 97), (100, 100)]


@pytest.mark.parametrize("n,expected", SIZES)
def test_downsample_sizes(spark, n, expected):
    df = spark.range(n).select(F.timestamp_add("SECOND", F.col("id") * 7, F.lit("2024-01-01 00:00:00")
                                               .cast("timestamp_ntz")).alias("ts_eastern"), F.col("id"))
    # small buckets force the stitched offsets across many buckets
    out = S.downsample(df, 100, bucket_us=60_000_000).orderBy("ts_eastern").collect()
    assert len(out) == expected
    assert out[0].id == 0 and out[-1].id == n - 1
    if n > 100:
        step = -(-n // 100)
        assert [r.id for r in out[:-1]] == list(range(0, n, step))[:len(out) - 1]


def test_to_series_drops_nulls(spark):
    df = rows_df(spark, [("2024-01-01 00:00:00", 1.0, None)], ["T_MXC", "T_4K"])
    out = S.to_series(df, series_keys=["T_MXC", "T_4K"]).collect()
    assert [(r.key, r.value) for r in out] == [("T_MXC", 1.0)]


def test_history_rejects_bad_args(spark):
    r = readings_from_events(spark, SF001)
    with pytest.raises(ValueError):
        S.history(r, "not_a_key")
    with pytest.raises(ValueError):
        S.history(r, "T_MXC", hours=0)
    with pytest.raises(ValueError):
        S.history(r, "T_MXC", max_points=99)


def _series(spark, rows):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "key string, ts string, value double")
    return df.select("key", F.col("ts").cast("timestamp_ntz").alias("ts_eastern"), "value")


def test_series_starts_anchor_and_small(spark):
    s = _series(spark, [("p", "2024-01-01 00:00:00", 1.0), ("p", "2024-01-02 00:00:00", 1.0),
                        ("p", "2024-01-02 01:00:00", 0.0), ("p", "2024-01-02 02:00:00", 1.0),
                        ("q", "2024-01-01 00:00:00", 1.0)])
    out = {r.key: r.starts for r in S.series_starts(s).collect()}
    # window anchored at 2024-01-02 02:00 - 24 h: first prev = 0 -> start, then off->on
    assert out == {"p": 2, "q": 0}


def test_time_below_bridges_gaps(spark):
    s = _series(spark, [("m", "2024-01-01 00:00:00", 0.01), ("m", "2024-01-01 02:00:00", 0.03),
                        ("m", "2024-01-01 03:00:00", 0.01)])
    assert S.time_below(s, bucket_us=60_000_000).first().hours_below == 2.0


def test_slope_window_and_tail_fallback(spark):
    s = _series(spark, [("m", "2024-01-01 00:00:00", 1.0), ("m", "2024-01-01 01:00:00", 2.0),
                        ("m", "2024-01-01 02:00:00", 3.0), ("m", "2024-01-01 10:00:00", 7.0)])
    # only one point in the last 3 h -> tail of up to 12 rows: (7-1)/10 h
    assert S.slope(s, bucket_us=3_600_000_000).first().slope_per_h == pytest.approx(0.6)
    s2 = _series(spark, [("m", "2024-01-01 00:00:00", 1.0), ("m", "2024-01-01 09:00:00", 2.0),
                         ("m", "2024-01-01 10:00:00", 4.0)])
    assert S.slope(s2).first().slope_per_h == pytest.approx(2.0)


def test_overlay_records_and_series(spark):
    p = spark.createDataFrame([(1, None, 2.0)], "device_id int, a double, b double")
    f = spark.createDataFrame([(1, 5.0, 9.0, 3.0), (2, 1.0, 1.0, 1.0)], "device_id int, a double, b double, c double")
    out = {r.device_id: r.asDict() for r in S.overlay_records(p, f, keys=["device_id"]).collect()}
    assert out[1] == {"device_id": 1, "a": 5.0, "b": 2.0, "c": 3.0}
    assert out[2]["a"] == 1.0
    ps = _series(spark, [("x", "2024-01-01 00:00:00", 1.0)])
    fs = _series(spark, [("x", "2024-01-01 00:00:00", 9.0), ("y", "2024-01-01 00:00:00", 2.0)])
    got = sorted((r.key, r.value) for r in S.overlay_series(ps, fs).collect())
    assert got == [("x", 1.0), ("y", 2.0)]


def test_freshest_values(spark):
    snap = spark.createDataFrame([("2024-01-01 05:00:00", 1.0, None)], "ts string, T_MXC double, T_4K double") \
        .select(F.col("ts").cast("timestamp_ntz").alias("ts_eastern"), "T_MXC", "T_4K")
    hist = _series(spark, [("T_MXC", "2024-01-01 04:00:00", 2.0), ("T_4K", "2024-01-01 04:00:00", 3.0),
                           ("T_MXC", "2024-01-01 05:00:00", None)])
    out = {r.key: r.value for r in S.freshest_values(snap, hist, series_keys=["T_MXC", "T_4K"]).collect()}
    # history older than the snapshot -> snapshot value; snapshot missing -> history
    assert out == {"T_MXC": 1.0, "T_4K": 3.0}


def test_dashboard_series_keeps_infinite_points_as_null(spark):
    df = rows_df(spark, [("2024-01-01 00:00:00", float("inf"), None), ("2024-01-01 00:01:00", float("nan"), 2.0)],
                 ["T_MXC", "T_4K"])
    out = sorted((r.key, str(r.ts_eastern), r.value) for r in
                 S.dashboard_series(df, hours=1, max_points=100, series_keys=["T_MXC", "T_4K"]).collect())
    assert out == [("T_4K", "2024-01-01 00:01:00", 2.0), ("T_MXC", "2024-01-01 00:00:00", None)]


def test_coerce_points(spark):
    pts = spark.createDataFrame([("2024-01-01T00:00:05", "0.5"), ("not a time", "1"), ("2024-01-01 00:00:06", "abc"),
                                 ("2024-01-01T00:00:07.250000", None)], "ts_eastern string, value string")
    out = [(str(r.ts_eastern), r.value) for r in S.coerce_points(pts).orderBy("ts_eastern").collect()]
    assert out == [("2024-01-01 00:00:05", 0.5), ("2024-01-01 00:00:06", None), ("2024-01-01 00:00:07.250000", None)]


def test_suggest_bucket_us(spark):
    from frostline.operators.intervals import suggest_bucket_us
    df = spark.range(3600).selectExpr("timestampadd(SECOND, id, TIMESTAMP_NTZ'2024-01-01 00:00:00') AS ts_eastern")
    assert suggest_bucket_us(df) == 24 * 3_600_000_000          # 3600 rows in the densest hour
    assert suggest_bucket_us(df, target_rows=1000) == 600_000_000   # 10 min buckets hold 600 rows
    assert suggest_bucket_us(df, target_rows=100) == 60_000_000     # 1 min buckets hold 60 rows


def test_series_answers_are_ordered(spark):
    from frostline.plans import queries as Q
    r = readings_from_events(spark, SF001)
    points = [(x.key, x.ts_eastern) for x in S.dashboard_series(r, hours=168, max_points=100).collect()]
    assert points == sorted(points) and len({k for k, _ in points}) > 5
    times = [x.ts_eastern for x in S.history(r, "T_MXC", hours=720, max_points=100).collect()]
    assert times == sorted(times)
    whole = [(x.part, x.key, x.ts_eastern) for x in Q.dashboard_points(r, hours=168, max_points=100).collect()]
    assert whole == sorted(whole) and {p for p, _, _ in whole} == {"metrics", "series"}


def test_request_errors_are_those_of_the_checks(spark):
    from frostline.functions.columns import check_hours, check_points, request_error
    asked = [(h, m) for h in (None, -3, 0, 1, 24, 8760, 8761) for m in (None, 99, 100, 10000, 10001)]
    df = spark.createDataFrame(asked, "hours int, max_points int").select("*", request_error("hours", "max_points").alias("error"))
    for r in df.collect():
        want = None
        try:
            check_hours(r.hours)
            check_points(r.max_points)
        except ValueError as e:
            want = str(e)
        assert r.error == want
