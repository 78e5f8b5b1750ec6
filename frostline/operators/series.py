"""Long-series operators.

A *series* DataFrame is long: ``(keys..., key, ts_eastern, value)``; the group
of one series is ``keys + ["key"]``.  Operators never collect a series; the
ordered ones use the bucket partial/stitch form of ``intervals``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frostline.functions.columns import (
    bucket_of, check_hours, check_points, keys_list, lenient_float, micros, missing, nan_to_null,
    resolve_as_of, scrub, since, window_start,
)
from frostline.operators import intervals as I
from frostline.operators.anchored import Slope, Starts, anchored, sampled_on
from frostline.schema import (
    ALLOWED_HISTORY_KEYS, COLD_THRESHOLD_K, DASHBOARD_KEYS, DEFAULT_BUCKET_US, HOUR_US, TS,
)


def to_series(wide: DataFrame, *, keys=(), series_keys=tuple(DASHBOARD_KEYS),
              drop_nulls: bool = True) -> DataFrame:
    """Wide readings -> long series, NULL values dropped per key.

    ``unpivot`` is a narrow Expand: no shuffle.
    """
    k = keys_list(keys)
    long = wide.select(*k, TS, *[F.col(c).cast("double").alias(c) for c in series_keys]) \
        .unpivot([*k, TS], list(series_keys), "key", "value")
    if drop_nulls:
        long = long.filter(F.col("value").isNotNull())
    return long.select(*k, "key", TS, "value")


# ---------------------------------------------------------------------------
# Stride downsampling with exact global positions
# ---------------------------------------------------------------------------

def downsample(df: DataFrame, max_points: int | None, *, keys=(),
               bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """Keep positions 0, step, 2*step, ... and the last row, step = ceil(n/m).

    No-op when ``max_points`` is None or n <= m.  The 0-based position of a row
    is its bucket offset (running sum of bucket counts over the small bucket
    table) plus its row number inside the bucket, so no window ever spans a
    whole series.  Output is unordered (callers sort at the edge).
    """
    if max_points is None:
        return df
    m = int(max_points)
    k = keys_list(keys)
    cols = df.columns
    us = micros(TS)
    rows = df.select("*", us.alias("_us"), bucket_of(us, bucket_us).alias("_b"))
    counts = rows.groupBy(*k, "_b").agg(F.count(F.lit(1)).alias("_nb"))
    wk = Window.partitionBy(*k)
    wo = wk.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*k, "_b", F.coalesce(F.sum("_nb").over(wo), F.lit(0)).alias("_off"),
                            F.sum("_nb").over(wk).alias("_n"))
    wb = Window.partitionBy(*k, "_b").orderBy("_us")
    numbered = rows.select("*", (F.row_number().over(wb) - 1).alias("_rn"))
    pos = numbered.join(offsets, [*k, "_b"], "inner")
    n, p = F.col("_n"), F.col("_off") + F.col("_rn")
    step = F.ceil(n / F.lit(m)).cast("long")
    keep = (n <= m) | (F.pmod(p, step) == 0) | (p == n - 1)
    return pos.filter(keep).select(*cols)


# ---------------------------------------------------------------------------
# Q2 / Q4 helpers: history of one key, dashboard series
# ---------------------------------------------------------------------------

def history(readings: DataFrame, key: str, *, hours: int = 24, max_points: int | None = None,
            as_of=None, keys=(), bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """Q2: ``(keys, ts_eastern, value)`` of one allowed key in the trailing window.

    NULL points are kept (as the single-key endpoint does); values are scrubbed
    (P7).  Ordered by time at the output edge.
    """
    if key not in ALLOWED_HISTORY_KEYS:
        raise ValueError(f"Invalid key: {key}")
    check_hours(hours)
    check_points(max_points)
    k = keys_list(keys)
    start = window_start(resolve_as_of(readings, as_of), hours)
    win = since(readings, start).select(*k, TS, F.col(key).cast("double").alias("value"))
    win = downsample(win, max_points, keys=k, bucket_us=bucket_us)
    return win.select(*k, TS, scrub("value").alias("value")).orderBy(*k, TS)


def dashboard_series(readings: DataFrame, *, hours: int = 24, max_points: int = 1200,
                     as_of=None, keys=(), series_keys=tuple(DASHBOARD_KEYS),
                     bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """Q4 series part: window, downsample the *wide* rows, then P6 (drop missing
    points), then P7 (an infinite value becomes a NULL value, the point stays)."""
    check_hours(hours)
    check_points(max_points, optional=False)
    k = keys_list(keys)
    start = window_start(resolve_as_of(readings, as_of), hours)
    win = since(readings, start).select(*k, TS, *series_keys)
    win = downsample(win, max_points, keys=k, bucket_us=bucket_us)
    long = to_series(win, keys=k, series_keys=series_keys, drop_nulls=False)
    # missing points (NULL/NaN) are dropped first; +-inf points stay, with a NULL value
    # ordered at the output edge (R5): the sampling has bounded the rows of a key
    return long.filter(~missing("value")).select(*k, "key", TS, scrub("value").alias("value")).orderBy(*k, "key", TS)


def coerce_points(points: DataFrame, *, keys=(), ts_col: str = TS, value_col: str = "value") -> DataFrame:
    """text/loosely typed points -> ``(keys, ts_eastern, value)``.

    Unparsable timestamps drop the point; unparsable values become NULL (the
    point stays).  ISO text with ``T`` or space separators is accepted.
    Ordering is left to the caller (R5: sort at the output edge).
    """
    k = keys_list(keys)
    ts_text = F.regexp_replace(F.col(ts_col).cast("string"), "T", " ")
    ts = ts_text.try_cast("timestamp_ntz")
    val = lenient_float(F.col(value_col).cast("string"))
    return points.select(*k, ts.alias(TS), val.alias("value")).filter(F.col(TS).isNotNull())


def window_series(series: DataFrame, *, hours: int, as_of=None) -> DataFrame:
    """P3 on a long series."""
    start = window_start(resolve_as_of(series, as_of), hours)
    return since(series, start)


# ---------------------------------------------------------------------------
# Series statistics
# ---------------------------------------------------------------------------

def _group(keys) -> list[str]:
    return [*keys_list(keys), "key"]


def duty_cycle(series: DataFrame, *, keys=()) -> DataFrame:
    """A3: percent of non-null samples that are on (>= 0.5); sample-weighted."""
    g = _group(keys)
    v = nan_to_null("value")
    frac = F.avg(F.when(v >= 0.5, F.lit(1.0)).when(v.isNotNull(), F.lit(0.0)))
    return series.groupBy(*g).agg((frac * F.lit(100.0)).alias("duty_pct"))


def latest_series_ts(series: DataFrame, *, keys=()) -> DataFrame:
    """A4: latest timestamp over all series of a key set (NULL values included)."""
    k = keys_list(keys)
    return series.groupBy(*k).agg(F.max(TS).alias("latest_ts"))


def last_valid_point(series: DataFrame, *, keys=()) -> DataFrame:
    """Value and time of the last non-missing point of each series."""
    g = _group(keys)
    valid_ts = F.when(~missing("value"), F.col(TS))
    return series.groupBy(*g).agg(F.max_by("value", valid_ts).alias("value"),
                                  F.max(valid_ts).alias(TS))


def series_starts(series: DataFrame, *, lookback_hours: int = 24, keys=(),
                  bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """Off->on transitions in the window anchored at each series' own last time.

    Non-null samples only; the first sample in the window has previous 0.
    Fewer than 2 samples -> 0.  See :mod:`anchored`: one scan, one shuffle of the
    rows by (series, cell).
    """
    g = _group(keys)
    valid = series.filter(~missing("value"))
    us = micros(TS)
    out = anchored(valid, us, bucket_of(us, bucket_us), keys=g,
                   starts=[Starts("value", sampled_on("value"), int(lookback_hours) * HOUR_US)])
    return out.select(*g, F.col("starts_value").alias("starts"))


def time_below(series: DataFrame, *, threshold: float = COLD_THRESHOLD_K, keys=(),
               bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """Hours below ``threshold`` with forward attribution; gaps bridge to the next point."""
    g = _group(keys)
    res = I.history_stats(series, keys=g, pumps=(), cold_column="value", threshold=threshold,
                          bucket_us=bucket_us)
    return res.select(*g, F.coalesce("hours_below_20mK_total", F.lit(0.0)).alias("hours_below"))


def slope(series: DataFrame, *, lookback_hours: int = 3, tail_rows: int = 12, keys=(),
          bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """Endpoint slope (value units per hour) over the last ``lookback_hours``.

    When fewer than 2 points fall in that window the last ``tail_rows`` points
    are used instead (R4, merged from the newest points of the newest cells).
    NULL points are dropped after choosing the rows; fewer than 2 or a
    non-positive time span gives NULL.  Not a regression.  See :mod:`anchored`:
    one scan, one shuffle of the rows by (series, cell).
    """
    g = _group(keys)
    us = micros(TS)
    out = anchored(series, us, bucket_of(us, bucket_us), keys=g,
                   slopes=[Slope("value", F.coalesce(F.col("value").cast("double"), F.lit(float("nan"))), int(lookback_hours) * HOUR_US, tail_rows)])
    return out.select(*g, F.col("slope_value").alias("slope_per_h"))


# ---------------------------------------------------------------------------
# W9 and overlays
# ---------------------------------------------------------------------------

def freshest_values(snapshot: DataFrame, series: DataFrame, *, keys=(),
                    series_keys=tuple(DASHBOARD_KEYS)) -> DataFrame:
    """W9 per series key: the history's last valid value when it is at least as
    new as the snapshot (or the snapshot has no time), else the snapshot value,
    else the history value.  Output ``(keys, key, value)``.
    """
    k = keys_list(keys)
    present = [c for c in series_keys if c in snapshot.columns]
    snap = snapshot.select(*k, F.col(TS).alias("_sts"),
                           *[F.col(c).cast("double").alias(c) for c in present]) \
        .unpivot([*k, "_sts"], present, "key", "_sv")
    hist = last_valid_point(series.filter(F.col("key").isin(list(series_keys))), keys=k) \
        .select(*k, "key", F.col("value").alias("_hv"), F.col(TS).alias("_hts"))
    # union + group instead of a join: both sides are one row per (keys, key)
    both = snap.select(*k, "key", "_sts", "_sv", F.lit(None).cast("double").alias("_hv"),
                       F.lit(None).cast("timestamp_ntz").alias("_hts")) \
        .unionByName(hist.select(*k, "key", F.lit(None).cast("timestamp_ntz").alias("_sts"),
                                 F.lit(None).cast("double").alias("_sv"), "_hv", "_hts")) \
        .groupBy(*k, "key").agg(F.max("_sts").alias("_sts"), F.max("_sv").alias("_sv"),
                                F.max("_hv").alias("_hv"), F.max("_hts").alias("_hts"))
    hv, hts, sv, sts = F.col("_hv"), F.col("_hts"), F.col("_sv"), F.col("_sts")
    use_hist = ~missing(hv) & hv.isNotNull() & (sts.isNull() | (hts.isNotNull() & (hts >= sts)))
    value = F.when(use_hist, hv).otherwise(F.coalesce(nan_to_null(sv), hv))
    return both.select(*k, "key", value.alias("value"))


def combine(frames: list[DataFrame], *, keys=()) -> DataFrame:
    """Join-free combination of per-key results whose columns are disjoint.

    ``unionByName`` + ``groupBy(keys).max(col)``: each column is non-NULL in at
    most one input, so ``max`` just picks it.  The inputs are per-key
    aggregates, so the shuffle is small; for ``keys=()`` it is a global
    aggregate of a handful of rows.
    """
    k = keys_list(keys)
    cols: list[str] = []
    for f in frames:
        cols += [c for c in f.columns if c not in k and c not in cols]
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    return u.groupBy(*k).agg(*[F.max(c).alias(c) for c in cols])


def overlay_records(primary: DataFrame, fallback: DataFrame, *, keys=()) -> DataFrame:
    """Per column, the primary's value unless missing (NULL/NaN), else the fallback's.

    Column order: fallback's columns, then primary-only ones.
    """
    k = keys_list(keys)
    cols = [c for c in fallback.columns if c not in k] + \
           [c for c in primary.columns if c not in k and c not in fallback.columns]
    pf, ff = primary.columns, fallback.columns

    def side(df, present, prio):
        sel = [*k, F.lit(prio).alias("_p")]
        for c in cols:
            if c in present:
                sel.append(F.col(c).alias(c))
            else:
                sel.append(F.lit(None).alias(c))
        return df.select(*sel)

    u = side(primary, pf, 2).unionByName(side(fallback, ff, 1), allowMissingColumns=True)
    aggs = []
    for c in cols:
        ok = ~missing(c) if dict(u.dtypes)[c] in ("double", "float") else F.col(c).isNotNull()
        aggs.append(F.coalesce(F.max_by(c, F.when(ok & (F.col("_p") == 2), F.lit(1))),
                               F.max_by(c, F.when(F.col("_p") == 1, F.lit(1)))).alias(c))
    return u.groupBy(*k).agg(*aggs)


def overlay_series(primary: DataFrame, fallback: DataFrame, *, keys=()) -> DataFrame:
    """Per series, the primary series when it has rows, else the fallback series."""
    g = _group(keys)
    have = primary.select(*g).distinct()
    return primary.unionByName(fallback.join(have, g, "left_anti"))


def pivot_series(long: DataFrame, *, keys=(), series_keys=tuple(DASHBOARD_KEYS),
                 value: str = "value") -> DataFrame:
    """Long ``(keys, key, value)`` -> one wide row per keys (conditional aggregates)."""
    k = keys_list(keys)
    return long.groupBy(*k).agg(*[F.max(F.when(F.col("key") == c, F.col(value))).alias(c)
                                  for c in series_keys])
