"""Interval analytics over the wide readings table.

Scale form (no single-partition window, no whole-device window):

1. rows are keyed by ``(keys..., _b)`` where ``_b`` is a fixed-size time
   bucket; lag/lead run inside that partition only, and each bucket collapses
   to one partial row (sums in integer microseconds, first/last values via
   ``min_by``/``max_by``);
2. the small bucket table is stitched with lag/lead over ``_b`` per key, which
   adds the contribution of the first and last row of each bucket;
3. a final ``groupBy(keys)`` sums the partials.

A device holding a third of all rows is therefore spread over all of its
buckets; only the stitch window (one row per non-empty bucket) sees a whole
device, and that table grows with time span / bucket size, not with data.
Results are identical to the global ordered window (integer sums do not depend
on evaluation order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frostline.functions.columns import (
    US_PER_HOUR, bucket_of, from_micros, is_on, keys_list, micros, nan_to_null, resolve_as_of, since, ts_literal,
    window_start,
)
from frostline.operators.cells import TimeCells
from frostline.schema import (
    COLD_THRESHOLD_K, DEFAULT_BUCKET_US, MINMAX_24H_COLUMNS,
    HOUR_US, MINUTE_US, RUNTIME_PUMPS, STATE_KEYS, TS,
)

STARTS_PUMPS = STATE_KEYS


def _zero():
    return F.lit(0).cast("long")


def _bucketed(df: DataFrame, k: list[str], cols: list, bucket_us) -> DataFrame:
    """Rows with their time and cell; ``bucket_us`` is a width or :class:`TimeCells`."""
    us = micros(TS)
    if isinstance(bucket_us, TimeCells):
        if bucket_us.keys != tuple(k):
            raise ValueError(f"cells were made for keys {bucket_us.keys}, not {tuple(k)}")
        return bucket_us.assign(df.select(*k, us.alias("_us"), *cols))
    return df.select(*k, us.alias("_us"), bucket_of(us, bucket_us).alias("_b"), *cols)


def _hours(us_col) -> F.Column:
    return us_col.cast("double") / F.lit(US_PER_HOUR)


# ---------------------------------------------------------------------------
# Full-history partials: W1 runtime counters, W2 cold hours, W3 cold streak, A2
# ---------------------------------------------------------------------------

def history_stats(readings: DataFrame, *, keys=(), pumps=tuple(RUNTIME_PUMPS),
                  cold_column: str = "T_MXC", threshold: float = COLD_THRESHOLD_K,
                  bucket_us: int = DEFAULT_BUCKET_US, latest_columns=(), window=None) -> DataFrame:
    """One scan, one shuffle on ``(keys, bucket)``: every full-history statistic.

    Columns: ``total_hours_<pump>`` (W1, backward attribution: the gap before
    a row counts when that row is on), ``hours_below_20mK_total`` (W2, forward
    attribution: the gap after a row counts when that row is below the
    threshold), ``hours_below_20mK_current`` (W3), ``rows``, ``latest_ts``,
    ``first_ts``, and the values of the latest row for ``latest_columns`` (R1
    fused into the same pass: ``max_by`` per bucket, then over buckets).
    ``window=(starts_from, duty_from)`` adds, per pump, ``<pump>_starts`` (W4 over
    rows from the first time on; NULL without one) and ``duty_<pump>`` (A3 over
    rows from the second time on).  Unused outputs are pruned by Catalyst.
    """
    part = history_cells(readings, keys=keys, pumps=pumps, cold_column=cold_column, threshold=threshold, bucket_us=bucket_us,
                         latest_columns=latest_columns, window=window)
    return stitch_history(part, keys=keys, pumps=pumps, threshold=threshold, latest_columns=latest_columns, window=window)


def history_cells(readings: DataFrame, *, keys=(), pumps=tuple(RUNTIME_PUMPS), cold_column: str | None = "T_MXC",
                  threshold: float = COLD_THRESHOLD_K, bucket_us=DEFAULT_BUCKET_US, latest_columns=(), window=None, minmax=()) -> DataFrame:
    """Partials of :func:`history_stats`: one row per key set and time cell; with
    ``window`` and ``minmax`` also those of :func:`stitch_recent`."""
    k = keys_list(keys)
    pumps = list(pumps)
    thr = F.lit(float(threshold))
    on_cols = [is_on(p).alias(f"_on{i}") for i, p in enumerate(pumps)]
    cv_col = (F.col(cold_column).cast("double") if cold_column and cold_column in readings.columns
              else F.lit(None).cast("double"))
    lcols = [c for c in latest_columns if c != TS]
    extra = []
    if window is not None:
        in_w = F.coalesce(F.col(TS) >= window[0], F.lit(False))
        in_d = F.coalesce(F.col(TS) >= window[1], F.lit(False))
        extra = [c for i, p in enumerate(pumps) for c in (F.when(in_w, is_on(p)).alias(f"_won{i}"), F.when(in_d, nan_to_null(p) >= 0.5).alias(f"_d{i}"))]
        extra += [F.when(in_w, F.col(c)).alias(f"_m{j}") for j, c in enumerate(minmax)]
    base = _bucketed(readings, k, [*on_cols, cv_col.alias("_cv"),
                                   *[F.col(c).alias(f"_lc{j}") for j, c in enumerate(lcols)], *extra], bucket_us)

    w = Window.partitionBy(*k, "_b").orderBy("_us")
    rows = base.select("*", F.lag("_us").over(w).alias("_prev"), F.lead("_us").over(w).alias("_next"),
                       *[F.lag(f"_won{i}").over(w).alias(f"_wpo{i}") for i in range(len(pumps)) if window is not None])

    us, prev, nxt, cv = F.col("_us"), F.col("_prev"), F.col("_next"), F.col("_cv")
    cold = F.coalesce(cv < thr, F.lit(False))
    warm = F.coalesce(cv >= thr, F.lit(False))
    aggs = [F.count(F.lit(1)).alias("_n"), F.min(us).alias("_first"), F.max(us).alias("_last")]
    for i in range(len(pumps)):
        on = F.col(f"_on{i}")
        aggs.append(F.sum(F.when(prev.isNotNull() & on, us - prev).otherwise(_zero())).alias(f"_run{i}"))
        aggs.append(F.min_by(on, us).alias(f"_fon{i}"))
    aggs += [
        F.sum(F.when(nxt.isNotNull() & cold, nxt - us).otherwise(_zero())).alias("_cold"),
        F.max_by(cold, us).alias("_lcold"),
        F.max_by(cv, us).alias("_lcv"),
        F.max(F.when(warm, us)).alias("_warm"),
        # first row after the bucket's last warm row (NULL when that row ends the bucket)
        F.max_by(nxt, F.when(warm, us)).alias("_after"),
        *[F.max_by(f"_lc{j}", us).alias(f"_lc{j}") for j in range(len(lcols))],
    ]
    if window is not None:
        for i in range(len(pumps)):
            won, at = F.col(f"_won{i}"), F.when(F.col(f"_won{i}").isNotNull(), us)
            aggs += [F.count(won).alias(f"_wn{i}"), F.count_if(~F.col(f"_wpo{i}") & won).alias(f"_wst{i}"), F.min_by(won, at).alias(f"_wf{i}"),
                     F.max_by(won, at).alias(f"_wl{i}"), F.count(f"_d{i}").alias(f"_dn{i}"), F.count_if(f"_d{i}").alias(f"_do{i}")]
        aggs += [a for j in range(len(minmax)) for a in (F.min(f"_m{j}").alias(f"_mn{j}"), F.max(f"_m{j}").alias(f"_mx{j}"))]
    return rows.groupBy(*k, "_b").agg(*aggs)


def stitch_history(part: DataFrame, *, keys=(), pumps=tuple(RUNTIME_PUMPS), threshold: float = COLD_THRESHOLD_K,
                   latest_columns=(), window=None) -> DataFrame:
    """The statistics of :func:`history_stats` from the partials of all cells
    (:func:`history_cells`, whichever jobs and borders they came from)."""
    k, pumps = keys_list(keys), list(pumps)
    thr = F.lit(float(threshold))
    lcols = [c for c in latest_columns if c != TS]
    ws = Window.partitionBy(*k).orderBy("_b")
    st = part.select("*", F.lag("_last").over(ws).alias("_pl"), F.lead("_first").over(ws).alias("_nf"),
                     *[F.lag(f"_wl{i}").over(ws).alias(f"_wpl{i}") for i in range(len(pumps)) if window is not None])
    first, last, pl, nf = F.col("_first"), F.col("_last"), F.col("_pl"), F.col("_nf")
    warm_b = F.col("_warm").isNotNull()
    out = []
    for i, p in enumerate(pumps):
        edge = F.when(pl.isNotNull() & F.col(f"_fon{i}"), first - pl).otherwise(_zero())
        out.append(_hours(F.sum(F.col(f"_run{i}") + edge)).alias(f"total_hours_{p}"))
    cold_edge = F.when(nf.isNotNull() & F.col("_lcold"), nf - last).otherwise(_zero())
    out += [
        _hours(F.sum(F.col("_cold") + cold_edge)).alias("hours_below_20mK_total"),
        F.max(last).alias("_latest_us"),
        F.max_by(F.col("_lcv"), F.col("_b")).alias("_latest_v"),
        F.min(first).alias("_min_us"),
        F.max_by(F.when(warm_b, F.coalesce(F.col("_after"), nf)), F.when(warm_b, F.col("_b"))).alias("_start"),
        F.sum("_n").alias("rows"),
        *[F.max_by(f"_lc{j}", "_b").alias(c) for j, c in enumerate(lcols)],
    ]
    in_window = []
    if window is not None:
        for i, p in enumerate(pumps):
            edge = F.when(~F.coalesce(F.col(f"_wpl{i}"), F.lit(False)) & F.col(f"_wf{i}"), 1).otherwise(0)
            out += [F.when(F.sum(f"_wn{i}") > 0, F.sum(F.col(f"_wst{i}") + edge)).cast("long").alias(f"{p}_starts"),
                    (F.try_divide(F.sum(f"_do{i}").cast("double"), F.sum(f"_dn{i}").cast("double")) * F.lit(100.0)).alias(f"duty_{p}")]
            in_window += [f"{p}_starts", f"duty_{p}"]
    res = st.groupBy(*k).agg(*out)
    streak = F.when(F.col("_latest_v") < thr,
                    _hours(F.col("_latest_us") - F.coalesce(F.col("_start"), F.col("_min_us")))
                    ).otherwise(F.lit(0.0))
    return res.select(
        *k, *[f"total_hours_{p}" for p in pumps], "hours_below_20mK_total",
        streak.alias("hours_below_20mK_current"), "rows",
        from_micros("_latest_us").alias("latest_ts"), from_micros("_min_us").alias("first_ts"), *lcols, *in_window,
    )


def stitch_recent(part: DataFrame, *, keys=(), pumps=tuple(RUNTIME_PUMPS), minmax=tuple(MINMAX_24H_COLUMNS), suffix: str = "_24h") -> DataFrame:
    """W4 and A1 from those cells of :func:`history_cells` (with ``window`` and
    ``minmax``) that make up the window: starts per pump, min and max per column."""
    k, pumps, minmax = keys_list(keys), list(pumps), list(minmax)
    ws = Window.partitionBy(*k).orderBy("_b")
    st = part.select("*", *[F.lag(f"_wl{i}").over(ws).alias(f"_wpl{i}") for i in range(len(pumps))])
    out = []
    for i, p in enumerate(pumps):
        edge = F.when(~F.coalesce(F.col(f"_wpl{i}"), F.lit(False)) & F.col(f"_wf{i}"), 1).otherwise(0)
        out.append(F.when(F.sum(f"_wn{i}") > 0, F.sum(F.col(f"_wst{i}") + edge)).cast("long").alias(f"{p}_starts{suffix}"))
    for j, c in enumerate(minmax):
        out += [F.min(f"_mn{j}").alias(f"{c}_min{suffix}"), F.max(f"_mx{j}").alias(f"{c}_max{suffix}")]
    return st.groupBy(*k).agg(*out)


def runtime_hours(readings: DataFrame, *, keys=(), pumps=tuple(RUNTIME_PUMPS),
                  bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """Integrated on-time per pump in hours (``total_hours_<pump>``)."""
    k = keys_list(keys)
    return history_stats(readings, keys=k, pumps=pumps, cold_column=None, bucket_us=bucket_us) \
        .select(*k, *[f"total_hours_{p}" for p in pumps])


def hours_below_total(readings: DataFrame, *, keys=(), column: str = "T_MXC",
                      threshold: float = COLD_THRESHOLD_K, bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """Total hours the column spent strictly below ``threshold``."""
    k = keys_list(keys)
    return history_stats(readings, keys=k, pumps=(), cold_column=column, threshold=threshold,
                         bucket_us=bucket_us).select(*k, "hours_below_20mK_total")


def cold_streak(readings: DataFrame, *, keys=(), column: str = "T_MXC",
                threshold: float = COLD_THRESHOLD_K, bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """Hours since the row following the last warm row, if the latest row is cold.

    NULL readings neither break nor require the streak; a NULL latest value
    gives 0.  Computed from the bucket partials: no sort of the raw rows
    beyond the bucket-local one, no self-join.
    """
    k = keys_list(keys)
    return history_stats(readings, keys=k, pumps=(), cold_column=column, threshold=threshold,
                         bucket_us=bucket_us).select(*k, "hours_below_20mK_current")


def health(readings: DataFrame, *, keys=(), manifest: DataFrame | None = None) -> DataFrame:
    """A2: row count, tracked source count and latest timestamp.

    Sources come from the manifest when given, else from distinct
    ``source_file`` values (partial aggregation, no raw-row shuffle).
    """
    k = keys_list(keys)
    agg = readings.groupBy(*k).agg(F.count(F.lit(1)).alias("rows"),
                                   F.max(TS).alias("latest_ts_eastern"),
                                   F.count_distinct("source_file").alias("files"))
    if manifest is not None:
        # scalar subquery over the (small) manifest: no join needed
        agg = agg.withColumn("files", manifest.select(F.count_distinct("path")).scalar())
    return agg.select(F.lit("ok").alias("status"), *k, "rows", "files", "latest_ts_eastern")


# ---------------------------------------------------------------------------
# Trailing-window statistics: W4 pump starts, A1 min/max
# ---------------------------------------------------------------------------

def _every_key(readings: DataFrame, k: list[str], stats: DataFrame) -> DataFrame:
    """``stats`` with a row for every key of the readings, NULL statistics where
    the window is empty.  One row per key meets here; the keys come from a scan
    of the key columns alone."""
    if not k:
        return stats
    named = stats.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(k)], *[c for c in stats.columns if c not in k])
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(k)]
    return readings.select(*k).distinct().join(named, same, "left").select(*stats.columns)


def window_stats(readings: DataFrame, *, as_of=None, hours: int = 24, keys=(),
                 pumps=tuple(STARTS_PUMPS), minmax=tuple(MINMAX_24H_COLUMNS),
                 bucket_us: int = DEFAULT_BUCKET_US, suffix: str = "_24h", every_key: bool = True,
                 newest=(), floor=None, points=(), points_start=None) -> DataFrame:
    """W4 + A1 over ``ts >= as_of - hours`` (inclusive, no upper bound).

    Rows before the window have no say, so the first row of the window has
    no predecessor: a pump already on there counts as one start.  The time
    predicate is a literal, so it is pushed into the Parquet scan.  Every key
    of the readings has a row; an empty window has NULL statistics
    (``every_key=False`` leaves it out, for callers that have the keys anyway).

    In the same pass: ``newest`` adds the latest row (``ts_eastern`` and these
    columns, all of one row; ``floor`` is a time that no key's latest row lies
    before), ``points`` the last valid value ``lv_<c>`` of these columns from
    ``points_start`` on (W8).
    """
    k = keys_list(keys)
    pumps, minmax, newest, points = list(pumps), list(minmax), list(newest), list(points)
    start = window_start(resolve_as_of(readings, as_of), hours)
    recent, inside = since(readings, start), F.lit(True)
    if newest or points:
        inside = F.coalesce(F.col(TS) >= start, F.lit(False))
        starts = [start, *([points_start] if points else []), *([ts_literal(floor)] if newest and floor is not None else [])]
        recent = readings if newest and floor is None else since(readings, F.least(*starts) if len(starts) > 1 else start)
    of_points = F.lit(True) if points_start is None else F.coalesce(F.col(TS) >= points_start, F.lit(False))
    base = _bucketed(recent, k, [inside.alias("_in"), *[F.when(inside, is_on(p)).alias(f"_on{i}") for i, p in enumerate(pumps)],
                                 *[F.when(inside, F.col(c)).alias(f"_m{j}") for j, c in enumerate(minmax)],
                                 *[F.col(c).alias(f"_nw{j}") for j, c in enumerate(newest)],
                                 *[F.when(of_points, nan_to_null(F.col(c).cast("double"))).alias(f"_pt{j}") for j, c in enumerate(points)]], bucket_us)
    w = Window.partitionBy(*k, "_b").orderBy("_us")
    rows = base.select("*", *[F.lag(f"_on{i}").over(w).alias(f"_pon{i}") for i in range(len(pumps))])
    us = F.col("_us")
    at = F.when(F.col("_in"), us)
    aggs = []
    for i in range(len(pumps)):
        on, pon = F.col(f"_on{i}"), F.col(f"_pon{i}")
        aggs += [F.count_if(~pon & on).alias(f"_st{i}"), F.min_by(on, at).alias(f"_fon{i}"),
                 F.max_by(on, at).alias(f"_lon{i}")]
    for j in range(len(minmax)):
        aggs += [F.min(f"_m{j}").alias(f"_mn{j}"), F.max(f"_m{j}").alias(f"_mx{j}")]
    for j in range(len(points)):
        valid = F.when(F.col(f"_pt{j}").isNotNull(), us)
        aggs += [F.max_by(f"_pt{j}", valid).alias(f"_lv{j}"), F.max(valid).alias(f"_lt{j}")]
    if newest:
        aggs.append(F.max(F.struct("_us", *[f"_nw{j}" for j in range(len(newest))])).alias("_row"))
    aggs.append(F.count_if("_in").alias("_n"))
    part = rows.groupBy(*k, "_b").agg(*aggs)
    res = stitch_window(part, keys=k, pumps=pumps, minmax=minmax, suffix=suffix, newest=newest, points=points)
    if every_key:
        res = _every_key(readings, k, res)
    return res


def stitch_window(part: DataFrame, *, keys=(), pumps=tuple(STARTS_PUMPS), minmax=tuple(MINMAX_24H_COLUMNS), suffix: str = "_24h",
                  newest=(), points=()) -> DataFrame:
    """The statistics of :func:`window_stats` from the partials of its cells."""
    k = keys_list(keys)
    ws = Window.partitionBy(*k).orderBy("_b")
    st = part.select("*", *[F.lag(f"_lon{i}").over(ws).alias(f"_plon{i}") for i in range(len(pumps))])
    out = []
    for i, p in enumerate(pumps):
        edge = F.when(~F.coalesce(F.col(f"_plon{i}"), F.lit(False)) & F.col(f"_fon{i}"), 1).otherwise(0)
        out.append(F.when(F.sum("_n") > 0, F.sum(F.col(f"_st{i}") + edge)).cast("long").alias(f"{p}_starts{suffix}"))
    for j, c in enumerate(minmax):
        out += [F.min(f"_mn{j}").alias(f"{c}_min{suffix}"), F.max(f"_mx{j}").alias(f"{c}_max{suffix}")]
    out += [F.max_by(f"_lv{j}", f"_lt{j}").alias(f"lv_{c}") for j, c in enumerate(points)]
    if newest:
        out.append(F.max("_row").alias("_row"))
    out.append(F.sum("_n").alias("rows_in_window"))
    res = st.groupBy(*k).agg(*out)
    if newest:
        res = res.select("*", from_micros("_row._us").alias(TS), *[F.col(f"_row._nw{j}").alias(c) for j, c in enumerate(newest)])
    mm = [n for c in minmax for n in (f"{c}_min{suffix}", f"{c}_max{suffix}")]
    return res.select(*k, *([TS] if newest else []), *newest, *[f"lv_{c}" for c in points], *mm, *[f"{p}_starts{suffix}" for p in pumps], "rows_in_window")


def pump_starts(readings: DataFrame, *, as_of=None, hours: int = 24, keys=(),
                pumps=tuple(STARTS_PUMPS), bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """Off->on transitions inside the trailing window (NULL = off)."""
    k = keys_list(keys)
    return window_stats(readings, as_of=as_of, hours=hours, keys=k, pumps=pumps, minmax=(),
                        bucket_us=bucket_us).select(*k, *[f"{p}_starts_24h" for p in pumps])


def window_minmax(readings: DataFrame, *, as_of=None, hours: int = 24, keys=(),
                  columns=tuple(MINMAX_24H_COLUMNS)) -> DataFrame:
    """A1: min and max per column in the trailing window; NULLs skipped, and an
    empty window gives NULLs (every key of the readings has a row).

    Plain partial aggregation: no window, no sort.
    """
    k = keys_list(keys)
    start = window_start(resolve_as_of(readings, as_of), hours)
    aggs = [f(c).alias(f"{c}_{n}_24h") for c in columns for f, n in ((F.min, "min"), (F.max, "max"))]
    return _every_key(readings, k, since(readings, start).groupBy(*k).agg(*aggs))


# ---------------------------------------------------------------------------
# Latest row
# ---------------------------------------------------------------------------

def latest_time_bounds(readings: DataFrame, *, keys=()):
    """``(latest, floor)`` in one aggregate job: the latest timestamp overall
    (the default ``as_of``) and the smallest per-key latest timestamp (the
    pruning floor of :func:`latest_row`).  Both are NULL for an empty table."""
    k = keys_list(keys)
    per_key = readings.groupBy(*k).agg(F.max(TS).alias("_mx"))
    row = per_key.agg(F.max("_mx"), F.min("_mx")).first()
    return row[0], row[1]


def latest_row(readings: DataFrame, *, keys=(), columns=None, floor=None) -> DataFrame:
    """The row with the greatest timestamp, per key (NULLs kept as stored).

    One ``max`` over a struct that begins with the time, so all columns come from
    one row; of rows with the same time it is the one with the greatest values,
    column by column in the order given (NULL is the least).  A partial (map-side)
    aggregate, no window, no job of its own.  ``floor`` (a time that no key's
    latest row lies before, e.g. from :func:`latest_time_bounds`) prunes row
    groups and ``day`` partitions.
    """
    k = keys_list(keys)
    cols = list(columns) if columns is not None else [c for c in readings.columns if c not in k]
    recent = readings if floor is None else since(readings, ts_literal(floor))
    values = [c for c in cols if c != TS]
    res = recent.groupBy(*k).agg(F.max(F.struct(F.col(TS).alias("_ts"), *values)).alias("_row"))
    # an empty table has no latest row (a global aggregate would give a NULL row)
    return res.filter(F.col("_row._ts").isNotNull()).select(*k, *[F.col("_row._ts").alias(TS) if c == TS else F.col(f"_row.{c}").alias(c) for c in cols])


def suggest_bucket_us(readings: DataFrame, *, keys=(), target_rows: int = 2_000_000) -> int:
    """Pick the largest bucket (1 day ... 1 minute) whose densest ``(keys, bucket)``
    cell stays under ``target_rows`` rows, from the densest hour of the data.

    One aggregate job (partial aggregation; one row per key and hour leaves the
    tasks) and a single scalar to the driver.  The bucket bounds the rows one
    window task sorts, so a device holding a large share of all rows is still
    split into many small tasks.
    """
    k = keys_list(keys)
    per_hour = readings.groupBy(*k, bucket_of(micros(TS), HOUR_US).alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    densest = per_hour.agg(F.max("_n")).first()[0] or 0
    for size in (24 * HOUR_US, 6 * HOUR_US, HOUR_US, 10 * MINUTE_US):
        if densest * size / HOUR_US <= target_rows:
            return size
    return MINUTE_US
