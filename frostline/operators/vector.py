"""The state vector: what every composite needs of the newest rows, in one pass
over wide rows (R1, W8, W9, A1, A3, A4 fused).

One row per key set: the latest row, and per column the last valid value with
its time inside a trailing window.  Everything merges (``max``, ``max_by``,
``min``, counts), so tasks combine their rows before the one shuffle; rows are not
multiplied by column (no Expand before the aggregate) and the composites do not
scan again.  The parts that need row order (W7, W5) come from
:mod:`frostline.operators.anchored`, those over the whole history from
:mod:`frostline.operators.intervals`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.functions.columns import (
    bucket_of, keys_list, micros, missing, nan_to_null, resolve_as_of, since, ts_literal, window_start,
)
from frostline.operators import intervals as I
from frostline.operators.anchored import Slope, anchored
from frostline.schema import DASHBOARD_KEYS, DEFAULT_BUCKET_US, HOUR_US, STATE_KEYS, TS


def bounds(readings: DataFrame, as_of, k: list[str]):
    """``(as_of, floor)``: the default ``as_of`` and a time that no key's latest
    row lies before, from one aggregate over ``(keys, ts)``; with an explicit
    ``as_of`` no job runs and there is no floor."""
    if as_of is None:
        latest, floor = I.latest_time_bounds(readings, keys=k)
        return (ts_literal(latest) if latest is not None else F.lit(None).cast("timestamp_ntz")), floor
    return resolve_as_of(readings, as_of), None


def state_vector(readings: DataFrame, *, start: Column | None, floor=None, keys=(), columns=tuple(DASHBOARD_KEYS),
                 extra=(), latest: bool = True) -> DataFrame:
    """One row per key set: with ``latest`` the latest row (``ts_eastern`` and
    ``columns``, all of one row), and over rows with ``ts >= start`` (None: all)
    ``lv_<c>``, ``lvts_<c>`` (W8) and ``series_ts`` (A4).

    ``extra``: more aggregates, over the same rows, of ``_in`` (the row lies in
    the window) and the columns.  ``floor`` prunes the scan as in
    :func:`frostline.operators.intervals.latest_row`.
    """
    k, columns = keys_list(keys), list(columns)
    rows = readings
    if start is not None and (floor is not None or not latest):
        rows = since(readings, F.least(start, ts_literal(floor)) if latest else start)
    inside = F.lit(True) if start is None else F.coalesce(F.col(TS) >= start, F.lit(False))
    rows = rows.withColumn("_in", inside)
    aggs = [F.max(F.struct(TS, *columns)).alias("_row")] if latest else []
    for c in columns:
        at = F.when(F.col("_in") & ~missing(F.col(c).cast("double")), F.col(TS))
        aggs += [F.max_by(F.col(c).cast("double"), at).alias(f"lv_{c}"), F.max(at).alias(f"lvts_{c}")]
    has_point = F.lit(False)
    for c in columns:
        has_point = has_point | F.col(c).isNotNull()
    aggs.append(F.max(F.when(F.col("_in") & has_point, F.col(TS))).alias("series_ts"))
    res = rows.groupBy(*k).agg(*aggs, *extra)
    if not latest:
        return res
    return res.filter(F.col(f"_row.{TS}").isNotNull()).select(*k, f"_row.{TS}", *[f"_row.{c}" for c in columns],
                                                              *[c for c in res.columns if c not in (*k, "_row")])


def freshest(c: str) -> Column:
    """W9 of a column of the state vector: the window's last valid value when it
    is at least as new as the latest row, else that row's, else the window's."""
    lv, at, ts = F.col(f"lv_{c}"), F.col(f"lvts_{c}"), F.col(TS)
    newer = lv.isNotNull() & (ts.isNull() | F.coalesce(at >= ts, F.lit(False)))
    return F.when(newer, lv).otherwise(F.coalesce(nan_to_null(F.col(c).cast("double")), lv))


def last_valid(readings: DataFrame, *, keys=(), columns=tuple(DASHBOARD_KEYS), start: Column | None = None) -> DataFrame:
    """W8 of wide readings: ``(keys, key, value, ts_eastern)`` per column that has
    a valid point; the columns become rows after the aggregate."""
    k = keys_list(keys)
    v = state_vector(readings, start=start, keys=k, columns=columns, latest=False)
    points = F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"lv_{c}").alias("value"), F.col(f"lvts_{c}").alias(TS)) for c in columns])
    return v.select(*k, F.inline(points)).filter(F.col(TS).isNotNull())


def freshest_columns(readings: DataFrame, *, hours: int = 24, as_of=None, keys=(), columns=tuple(DASHBOARD_KEYS)) -> DataFrame:
    """W9 of every column: ``(keys, key, value)``."""
    k = keys_list(keys)
    a, floor = bounds(readings, as_of, k)
    v = state_vector(readings, start=window_start(a, hours), floor=floor, keys=k, columns=columns)
    return v.select(*k, *[freshest(c).alias(c) for c in columns]).unpivot(k, list(columns), "key", "value")


def state_inputs(readings: DataFrame, *, hours: int = 24, as_of=None, keys=(), slope_of: str = "T_MXC", lookback_hours: int = 3,
                 bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """What the machine state is decided on, one row per key set: freshest
    temperatures and pump states, slope, last valid point, times.

    Scans: the bounds (``keys, ts``; none with an explicit ``as_of``), the state
    vector of the newest rows, and the window's ``(ts, slope_of)`` for the slope.
    """
    k = keys_list(keys)
    wanted = [slope_of, "T_Still", *STATE_KEYS]
    a, floor = bounds(readings, as_of, k)
    start = window_start(a, hours)
    v = state_vector(readings, start=start, floor=floor, keys=k, columns=DASHBOARD_KEYS)
    v = v.select(*k, F.col(TS).alias("snap_ts"), "series_ts", nan_to_null(F.col(slope_of).cast("double")).alias("snap_mxc"),
                 F.col(f"lv_{slope_of}").alias("last_valid_mxc"), F.col(f"lvts_{slope_of}").alias("last_valid_mxc_ts"),
                 *[freshest(c).alias(c) for c in wanted])
    us = micros(TS)
    sl = anchored(since(readings, start), us, bucket_of(us, bucket_us), keys=k,
                  slopes=[Slope("s", F.col(slope_of).cast("double"), int(lookback_hours) * HOUR_US)]) \
        .select(*k, F.col("slope_s").alias("slope_per_h"))
    # both are one row per key set
    cols = [c for c in v.columns if c not in k]
    both = v.unionByName(sl, allowMissingColumns=True)
    return both.groupBy(*k).agg(*[F.max(c).alias(c) for c in [*cols, "slope_per_h"]]).filter(F.col("snap_ts").isNotNull())
