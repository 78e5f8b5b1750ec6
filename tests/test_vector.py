"""Fused composites against the series forms, plan shapes, and brute force for
anchored windows and the state history with any cell borders."""

import datetime as dt

import pytest
from helpers import SF001, SF01
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frostline.functions.columns import bucket_of, micros, resolve_as_of, window_start
from frostline.operators import anchored as A
from frostline.operators import intervals as I
from frostline.operators import series as S
from frostline.operators import state as C
from frostline.operators import thermal as E
from frostline.operators import vector as V
from frostline.plans import catalog as K
from frostline.plans import queries as Q
from frostline.schema import DASHBOARD_KEYS, STATE_KEYS, TS
from frostline.sources.events import readings_from_events

DEV = ("device_id",)
T0 = dt.datetime(2024, 1, 1)
HOUR = 3_600_000_000


def _sorted(df, cols=None):
    df = df.select(*(cols or sorted(df.columns)))
    return sorted((tuple(r) for r in df.collect()), key=str)


def _scans(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    before_aggregates = [line for line in plan.split("\n") if "Expand" in line and plan.find("Aggregate") < plan.find(line)]
    return plan.count("FileScan"), before_aggregates, plan


@pytest.mark.parametrize("name", ["fridge_state", "fridge_state_by_device", "snapshot", "snapshot_by_device", "ops_summary", "em_latest", "em_history"])
def test_composites_scan_little_and_multiply_no_rows(spark, name):
    # with the bounds (one aggregate over keys and time, run before) at most three scans
    scans, expands, _ = _scans(K.QUERIES[name](spark, SF01))
    assert scans <= 2 and not expands


@pytest.mark.parametrize("name", ["mxc_slope", "mxc_slope_by_device", "series_starts", "series_starts_by_device", "state_hours"])
def test_anchored_windows_read_the_rows_once(spark, name):
    scans, _, plan = _scans(K.QUERIES[name](spark, SF01))
    assert scans == 1
    for line in plan.split("\n"):       # raw rows meet only lists of cells
        if "Join" in line:
            assert "_b#" in line


@pytest.mark.parametrize("keys", [(), DEV])
def test_fused_equal_series_forms(spark, keys):
    r = readings_from_events(spark, SF01)
    a = resolve_as_of(r)
    snap = I.latest_row(r, keys=keys, columns=[TS, *DASHBOARD_KEYS])
    for hours in (24, 72):
        hist = S.window_series(S.to_series(r, keys=keys), hours=hours, as_of=a)
        assert _sorted(C.current_state(r, hours=hours, keys=keys)) == _sorted(C.fridge_state(snap, hist, keys=keys))
        assert _sorted(V.freshest_columns(r, hours=hours, keys=keys)) == _sorted(S.freshest_values(snap, hist, keys=keys))
        full = Q.synthesize_snapshot(snap, Q.metrics(r, keys=keys, as_of=a), hist, Q.health(r), keys=keys)
        assert _sorted(Q.snapshot(r, hours=hours, keys=keys)) == _sorted(full)
        assert _sorted(Q.snapshot(r, hours=hours, keys=keys, as_of=a)) == _sorted(full)     # without the bounds' floor
        starts = S.series_starts(S.window_series(S.to_series(r, keys=keys, series_keys=STATE_KEYS), hours=hours, as_of=a), keys=keys)
        duty = S.duty_cycle(S.window_series(S.to_series(r, keys=keys, series_keys=STATE_KEYS), hours=hours, as_of=a), keys=keys)
        w4 = {tuple(x[c] for c in keys): x for x in I.pump_starts(r, keys=keys).collect()}
        w5 = {tuple(x[c] for c in (*keys, "key")): x.starts for x in starts.collect()}
        want_duty = {tuple(x[c] for c in (*keys, "key")): x.duty_pct for x in duty.collect()}
        for x in Q.ops_summary(r, hours=hours, keys=keys).collect():
            at = tuple(x[c] for c in keys)
            own = w4[at][f"{x.key}_starts_24h"]
            assert x.starts_24h == (own if own is not None else w5.get((*at, x.key)))
            assert x.duty_pct == want_duty.get((*at, x.key))
    hist = S.to_series(r, keys=keys)
    assert _sorted(E.em_now(r, keys=keys)) == _sorted(E.em_latest(snap, hist, keys=keys))
    assert _sorted(E.em_history_of(r, keys=keys)) == _sorted(E.em_history(hist, keys=keys))
    assert _sorted(V.last_valid(r, keys=keys)) == _sorted(S.last_valid_point(hist, keys=keys))
    assert _sorted(A.column_slope(r, keys=keys)) == _sorted(S.slope(hist.filter("key = 'T_MXC'"), keys=keys))
    assert _sorted(A.column_starts(r, keys=keys)) == _sorted(S.series_starts(hist.filter(F.col("key").isin(STATE_KEYS)), keys=keys))


def test_fused_on_an_empty_table_and_empty_windows(spark):
    r = readings_from_events(spark, SF001)
    empty = r.filter("false")
    for f in (C.current_state, V.freshest_columns, Q.snapshot, Q.ops_summary, A.column_slope, A.column_starts, V.last_valid, E.em_now):
        assert f(empty).collect() == [] and f(empty, keys=DEV).collect() == []
    late = "2030-01-01 00:00:00"
    assert Q.ops_summary(r, as_of=late).filter("duty_pct IS NOT NULL OR starts_24h IS NOT NULL").count() == 0
    assert Q.ops_summary(r, as_of=late).filter("hours IS NOT NULL").count() == 4
    assert C.current_state(r, as_of=late).count() == 1 and Q.snapshot(r, as_of=late).count() == 1


def test_latest_row_of_tied_times_is_one_row(spark):
    rows = [(1, T0, 1.0, None), (1, T0, 2.0, None), (1, T0, 2.0, 5.0), (2, T0, None, None)]
    df = spark.createDataFrame(rows, "device_id int, ts_eastern timestamp_ntz, P1 double, P2 double")
    got = {r.device_id: (r.P1, r.P2) for r in I.latest_row(df.repartition(3), keys=["device_id"]).collect()}
    assert got == {1: (2.0, 5.0), 2: (None, None)}


# --- brute force -----------------------------------------------------------

VALUE = st.one_of(st.none(), st.just(float("nan")), st.sampled_from([0.0, 0.4, 0.6, 1.0, 0.012, 0.03]))
ROWS = st.lists(st.tuples(st.integers(0, 40 * 3600), st.integers(1, 2), VALUE), max_size=45, unique_by=lambda r: (r[0], r[1]))
WIDTHS = st.sampled_from([60_000_000, HOUR, 3 * HOUR, 1000 * HOUR])
FAST = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _frame(spark, rows):
    data = [(d, T0 + dt.timedelta(seconds=s), v) for s, d, v in rows]
    return spark.createDataFrame(data, "device_id int, ts_eastern timestamp_ntz, x double").repartition(3)


def _ok(v):
    return v is not None and v == v


def _slope(points, lookback=3 * 3600, tail=12):
    """Rows (seconds, value or None) in order, as the source system does it."""
    if len(points) < 2:
        return None
    chosen = [p for p in points if p[0] >= points[-1][0] - lookback]
    if len(chosen) < 2:
        chosen = points[-tail:]
    chosen = [p for p in chosen if _ok(p[1])]
    if len(chosen) < 2 or chosen[-1][0] <= chosen[0][0]:
        return None
    return (chosen[-1][1] - chosen[0][1]) / ((chosen[-1][0] - chosen[0][0]) / 3600.0)


def _starts(points, lookback=24 * 3600):
    points = [p for p in points if _ok(p[1])]
    if not points:
        return None
    on = [v >= 0.5 for s, v in points if s >= points[-1][0] - lookback]
    return 0 if len(on) < 2 else sum(o and (i == 0 or not on[i - 1]) for i, o in enumerate(on))


@FAST
@given(rows=ROWS, width=WIDTHS)
def test_anchored_equal_brute_force(spark, rows, width):
    df = _frame(spark, rows)
    us = micros(TS)
    value = F.coalesce(F.col("x"), F.lit(float("nan")))
    out = A.anchored(df, us, bucket_of(us, width), keys=["device_id"], slopes=[A.Slope("s", value)], starts=[A.Starts("p", A.sampled_on("x"))])
    got = {r.device_id: (r.slope_s, r.starts_p) for r in out.collect()}
    want = {}
    for d in {d for _, d, _ in rows}:
        mine = sorted((s, v) for s, e, v in rows if e == d)
        want[d] = (_slope(mine), _starts(mine))
    assert got.keys() == want.keys()
    for d, (slope, starts) in want.items():
        assert got[d][1] == starts
        assert got[d][0] == (pytest.approx(slope) if slope is not None else None)


@FAST
@given(rows=ROWS, width=st.sampled_from([HOUR, 3 * HOUR, 600_000_000]))
def test_state_history_slope_equals_brute_force(spark, rows, width):
    df = _frame(spark, rows).withColumnRenamed("x", "T_MXC")
    for c in ("T_Still", *STATE_KEYS):
        df = df.withColumn(c, F.lit(None).cast("double"))
    got = {(r.device_id, r.bucket_start): r.slope_per_h for r in C.state_timeline(df, keys=["device_id"], bucket_us=width).collect()}
    want = {}
    for s, d, _ in rows:
        b = s * 1_000_000 // width * width // 1_000_000
        end = b + width // 1_000_000
        points = sorted((t, v) for t, e, v in rows if e == d and t < end and _ok(v))
        base = T0 + dt.timedelta(seconds=s)
        day = (base - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
        want[(d, dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=day - day % width))] = _slope(points)
    assert got.keys() == want.keys()
    for at, slope in want.items():
        assert got[at] == (pytest.approx(slope) if slope is not None else None)


def test_newest_points_merge(spark):
    df = spark.createDataFrame([(k, b, [(b * 10 + i, float(i)) for i in range(n)]) for k, b, n in [(1, 0, 3), (1, 1, 2), (1, 2, 1), (2, 5, 1)]],
                               "k int, b int, pts array<struct<us:long,v:double>>")
    got = {r.k: [p.us for p in r.pts] for r in A.last_points(df, ["k"], "pts", 4).collect()}
    assert got == {1: [20, 11, 10, 2], 2: [50]}
