"""Composite read queries (Q1-Q6) and summaries (O1, O2).

Each returns lazy DataFrames; per-key parts are combined with
``series.combine`` (union + group) instead of joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.functions.columns import bucket_of, keys_list, micros, resolve_as_of, scrub, scrub_frame, since, window_start
from frostline.functions.fmt import fmt_state
from frostline.operators import intervals as I
from frostline.operators import series as S
from frostline.operators.anchored import Starts, anchored, sampled_on
from frostline.operators.vector import bounds
from frostline.schema import (
    DASHBOARD_KEYS, DEFAULT_BUCKET_US, METRICS_LATEST_COLUMNS, MINMAX_24H_COLUMNS, RUNTIME_PUMPS,
    STATE_KEYS, TS,
)
from frostline.operators.intervals import STARTS_PUMPS

RUNTIME_COLUMNS = [f"total_hours_{p}" for p in RUNTIME_PUMPS]
METRICS_COLUMNS = (
    METRICS_LATEST_COLUMNS
    + [f"{c}_{n}_24h" for c in MINMAX_24H_COLUMNS for n in ("min", "max")]
    + ["hours_below_20mK_total", "hours_below_20mK_current"]
    + [f"{p}_starts_24h" for p in STARTS_PUMPS]
)

COUNTS = [f"{p}_starts_24h" for p in STARTS_PUMPS]


def metrics(readings: DataFrame, *, as_of=None, keys=(), bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """Q3: latest row + 24 h min/max + cold hours + cold streak + starts + runtime hours.

    34 columns in the source system's order; the runtime counters replace the
    stored (NULL) ``total_hours_*`` in place.  Scans: the full history of the
    six columns W1-W3 need (one bucket-partial pass), the latest row (R1, value
    columns read only from recent row groups) and the pushed-down 24 h window.
    """
    k = keys_list(keys)
    a, floor = bounds(readings, as_of, k)
    latest = I.latest_row(readings, keys=k, floor=floor,
                          columns=[c for c in METRICS_LATEST_COLUMNS if c not in RUNTIME_COLUMNS])
    win = I.window_stats(readings, as_of=a, hours=24, keys=k, every_key=False, bucket_us=bucket_us).drop("rows_in_window")
    # the full-history pass reads only ts, the pump states and T_MXC
    hist = I.history_stats(readings, keys=k, bucket_us=bucket_us) \
        .select(*k, *RUNTIME_COLUMNS, "hours_below_20mK_total", "hours_below_20mK_current")
    out = S.combine([latest, win, hist], keys=k).filter(F.col(TS).isNotNull())
    return scrub_frame(out.select(*k, *METRICS_COLUMNS))


def latest(readings: DataFrame, *, keys=(), bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """Q1: the whole latest row with the runtime counters overlaid."""
    k = keys_list(keys)
    cols = [c for c in readings.columns if c not in k]
    row = I.latest_row(readings, keys=k, columns=[c for c in cols if c not in RUNTIME_COLUMNS])
    hours = I.runtime_hours(readings, keys=k, bucket_us=bucket_us)
    out = S.combine([row, hours], keys=k).filter(F.col(TS).isNotNull())
    return scrub_frame(out.select(*k, *cols))


def dashboard(readings: DataFrame, *, hours: int = 24, max_points: int = 1200, as_of=None, keys=(),
              bucket_us: int = DEFAULT_BUCKET_US) -> tuple[DataFrame, DataFrame]:
    """Q4: ``(metrics, series)`` for the dashboard."""
    a = resolve_as_of(readings, as_of)
    m = metrics(readings, as_of=a, keys=keys, bucket_us=bucket_us)
    s = S.dashboard_series(readings, hours=hours, max_points=max_points, as_of=a, keys=keys,
                           bucket_us=bucket_us)
    return m, s


def dashboard_points(readings: DataFrame, *, hours: int = 24, max_points: int = 1200, as_of=None, keys=(),
                     bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """Q4 as one answer: ``(keys, part, key, ts_eastern, value)`` with the metrics
    record (part ``metrics``, at the time of the latest row) and the sampled series
    (part ``series``), ordered."""
    k = keys_list(keys)
    m, s = dashboard(readings, hours=hours, max_points=max_points, as_of=as_of, keys=keys, bucket_us=bucket_us)
    named = [c for c in METRICS_COLUMNS if c != TS]
    record = m.select(*k, TS, *[F.col(c).cast("double").alias(c) for c in named]).unpivot([*k, TS], named, "key", "value")
    both = record.select(*k, F.lit("metrics").alias("part"), "key", TS, "value") \
        .unionByName(s.select(*k, F.lit("series").alias("part"), "key", TS, "value"))
    return both.orderBy(*k, "part", "key", TS)


def health(readings: DataFrame, *, manifest: DataFrame | None = None) -> DataFrame:
    """Q5."""
    return I.health(readings, manifest=manifest)


def synthesize_snapshot(latest_row: DataFrame, metrics_row: DataFrame, series: DataFrame,
                        health_row: DataFrame | None = None, *, keys=()) -> DataFrame:
    """Q6: overlay(latest, metrics); each series key filled from its last valid
    history point; the time filled from the newest series point, then health.
    """
    k = keys_list(keys)
    snap = S.overlay_records(latest_row, metrics_row, keys=k)
    lv = S.pivot_series(S.last_valid_point(series, keys=k).select(*k, "key", "value"), keys=k,
                        series_keys=DASHBOARD_KEYS)
    lv = lv.select(*k, *[F.col(c).alias(f"_lv_{c}") for c in DASHBOARD_KEYS])
    lts = S.latest_series_ts(series, keys=k).withColumnRenamed("latest_ts", "_hist_ts")
    parts = [snap, lv, lts]
    allin = S.combine(parts, keys=k)
    cols = [c for c in snap.columns if c not in k]
    out = []
    for c in cols:
        if c in DASHBOARD_KEYS:
            out.append(F.coalesce(F.when(~F.isnan(c), F.col(c)), F.col(f"_lv_{c}")).alias(c))
        elif c == TS:
            # one health time for all keys: a scalar, no row of its own
            ts_fill = [F.col(TS), F.col("_hist_ts")]
            if health_row is not None:
                ts_fill.append(health_row.agg(F.max("latest_ts_eastern")).scalar())
            out.append(F.coalesce(*ts_fill).alias(TS))
        else:
            out.append(F.col(c))
    for c in DASHBOARD_KEYS:
        if c not in cols:
            out.append(F.col(f"_lv_{c}").alias(c))
    return allin.select(*k, *out)


def snapshot(readings: DataFrame, *, hours: int = 24, as_of=None, keys=(), bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """Q6 straight from wide readings: :func:`synthesize_snapshot` of the latest
    row, the metrics and the history of the trailing ``hours``.

    Three scans: the bounds (``keys, ts``), the newest rows (latest row, last valid
    points, 24 h extremes and starts) and the history's six columns.  The latest
    row is also the metrics record's, so it is read once.
    """
    k = keys_list(keys)
    a, floor = bounds(readings, as_of, k)
    kept = [c for c in METRICS_LATEST_COLUMNS if c not in RUNTIME_COLUMNS and c != TS]
    # without a floor the latest row may lie anywhere: a map-side aggregate of its own, so that no old row is shuffled
    newest, apart = (kept, []) if floor is not None else ([], [I.latest_row(readings, keys=k, columns=[TS, *kept])])
    recent = I.window_stats(readings, as_of=a, hours=24, keys=k, every_key=False, bucket_us=bucket_us, newest=newest, floor=floor,
                            points=DASHBOARD_KEYS, points_start=window_start(a, hours)).drop("rows_in_window")
    hist = I.history_stats(readings, keys=k, bucket_us=bucket_us) \
        .select(*k, *RUNTIME_COLUMNS, "hours_below_20mK_total", "hours_below_20mK_current")
    allin = S.combine([*apart, recent, hist], keys=k).filter(F.col(TS).isNotNull())
    fills = {c: F.coalesce(scrub(c), F.col(f"lv_{c}")) for c in DASHBOARD_KEYS}
    return allin.select(*k, *[fills[c].alias(c) if c in fills else scrub(c).alias(c) if c not in (TS, *COUNTS) else F.col(c) for c in METRICS_COLUMNS])


def ops_summary(readings: DataFrame, *, hours: int = 24, as_of=None, keys=(),
                bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """O1: per pump: current state, runtime hours, duty % over the window, starts.

    Starts are the 24 h window count (W4), falling back to the series-anchored
    count (W5) when the window has no rows.  Long output
    ``(keys, key, state, hours, duty_pct, starts_24h)``; the pumps become rows
    after the aggregates.  Scans: the bounds, and the whole history of the four
    state columns, whose cells carry every part but W5; that is read (from the
    window's rows) only where the series window is longer than W4's, or begins
    elsewhere.
    """
    k = keys_list(keys)
    a, _ = bounds(readings, as_of, k)
    stats = I.history_stats(readings, keys=k, pumps=STATE_KEYS, cold_column=None, bucket_us=bucket_us, latest_columns=STATE_KEYS,
                            window=(window_start(a, 24), window_start(a, hours)))
    if hours > 24:      # a key without a row in the last 24 hours may have samples in the longer window
        us = micros(TS)
        w5 = anchored(since(readings, window_start(a, hours)), us, bucket_of(us, bucket_us), keys=k, starts=[Starts(p, sampled_on(p)) for p in STATE_KEYS])
        stats = S.combine([stats, w5], keys=k)
    starts = {p: F.coalesce(F.col(f"{p}_starts"), F.col(f"starts_{p}")) if hours > 24 else F.col(f"{p}_starts") for p in STATE_KEYS}
    parts = F.array(*[F.struct(F.lit(p).alias("key"), fmt_state(p).alias("state"), F.col(f"total_hours_{p}").alias("hours"),
                               F.col(f"duty_{p}").alias("duty_pct"), starts[p].alias("starts_24h")) for p in STATE_KEYS])
    return stats.filter(F.col("latest_ts").isNotNull()).select(*k, F.inline(parts))


def cold_summary(readings: DataFrame, *, hours: int = 24, as_of=None, keys=(),
                 threshold: float = 0.02, bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """O2: hours below 20 mK in the window (W6) and in total (W2, else W6)."""
    k = keys_list(keys)
    a = resolve_as_of(readings, as_of)
    mxc = S.window_series(S.to_series(readings, keys=k, series_keys=["T_MXC"]), hours=hours, as_of=a)
    w6 = S.time_below(mxc, threshold=threshold, keys=k, bucket_us=bucket_us).drop("key") \
        .withColumnRenamed("hours_below", "window_hours_below_20mK")
    w2 = I.hours_below_total(readings, keys=k, threshold=threshold, bucket_us=bucket_us)
    allin = S.combine([w6, w2], keys=k)
    win = F.coalesce(F.col("window_hours_below_20mK"), F.lit(0.0))
    return allin.select(*k, win.alias("window_hours_below_20mK"),
                        F.coalesce(F.col("hours_below_20mK_total"), win).alias("total_hours_below_20mK"),
                        F.col("hours_below_20mK_total").isNull().alias("total_is_window"))


__all__ = ["metrics", "latest", "dashboard", "health", "snapshot", "synthesize_snapshot", "ops_summary",
           "cold_summary"]
