"""Machine-state classification (C1) and its history form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.functions.columns import (
    bucket_of, from_micros, keys_list, micros, nan_to_null,
)
from frostline.functions.fmt import fmt_temp
from frostline.operators.anchored import newest, tail_slope
from frostline.operators.series import (
    combine, freshest_values, last_valid_point, latest_series_ts, pivot_series, slope,
)
from frostline.operators.vector import state_inputs
from frostline.schema import DEFAULT_BUCKET_US, HOUR_US, STATE_KEYS, TS

# Thresholds and texts of the decision list.
BASE_K = 0.010
BASE_MARGIN_K = 0.005
FLOOR_BELOW_K = 0.009
FLOOR_MAX_AGE_H = 3.0
STEADY_KPH = 0.004
FALLING_KPH = 0.006
RISING_KPH = 0.006
PRECOOL_MXC_K = 1.0
PRECOOL_STILL_K = 10.0
WARM_MXC_K = 20.0
WARM_STILL_K = 250.0
TEXT_SENSOR_FLOOR = ("Last valid MXC point was {}; the fridge appears colder than the "
                     "readable sensor floor.")
TEXT_UNKNOWN = "MXC reading unavailable."
TEXT_WARM = "Cryostat is still near ambient temperature and far from base."
TEXT_WARMING_TREND = "MXC is trending warmer."
TEXT_AT_BASE_BAND = "MXC is at {} and within the base-temperature band."
TEXT_PRECOOLING = "Cryostat is far above base and still in the warm part of the cooldown."
TEXT_COOLING_TREND = "MXC is still trending colder."
TEXT_NOT_ENGAGED = "Cooling hardware is not fully engaged."
TEXT_COOLING_ACTIVE = "Cooling hardware is active above base temperature."
TEXT_HOLDING_BASE = "Cryostat is holding near its base temperature."
TEXT_SETTLING = "Cryostat is settling toward a colder state."
# End of fixed values.


def _text(template: str, value: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), value, F.lit(after))


def classify(mxc: Column, still: Column, pumps_on: Column, slope_kph: Column,
             last_valid_mxc: Column, age_h: Column) -> Column:
    """C1 decision list, first match wins -> ``struct(label, detail, tone)``."""
    warm_thr = F.when(mxc < 0.05, F.lit(RISING_KPH)).otherwise(F.lit(0.01))
    cool_thr = F.when(mxc < 0.05, F.lit(FALLING_KPH)).otherwise(F.lit(0.01))
    has_slope = slope_kph.isNotNull()
    has_still = still.isNotNull()
    in_base = (mxc <= BASE_K) | (
        (mxc <= F.lit(BASE_K + BASE_MARGIN_K))
        & (~has_slope | (F.abs(slope_kph) <= STEADY_KPH)))
    in_warm = (mxc >= WARM_MXC_K) | (has_still & (still >= WARM_STILL_K))
    floor_arm = (last_valid_mxc.isNotNull() & age_h.isNotNull() & (age_h <= FLOOR_MAX_AGE_H)
                 & (last_valid_mxc <= FLOOR_BELOW_K) & pumps_on)

    def st(label, detail, tone):
        return F.struct(F.lit(label).alias("label"),
                        (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"),
                        F.lit(tone).alias("tone"))

    return (
        F.when(mxc.isNull() & floor_arm,
               st("Below sensor range", _text(TEXT_SENSOR_FLOOR, fmt_temp(last_valid_mxc, True)), "sensor-floor"))
        .when(mxc.isNull(), st("Unknown", TEXT_UNKNOWN, "default"))
        .when(in_warm, st("Warm", TEXT_WARM, "default"))
        .when(has_slope & (slope_kph >= warm_thr), st("Warming up", TEXT_WARMING_TREND, "warming"))
        .when(in_base, st("At base", _text(TEXT_AT_BASE_BAND, fmt_temp(mxc, True)), "base"))
        .when(pumps_on & ((mxc >= PRECOOL_MXC_K) | (has_still & (still >= PRECOOL_STILL_K))),
              st("Precooling", TEXT_PRECOOLING, "cooling"))
        .when(has_slope & (slope_kph <= -cool_thr), st("Cooling down", TEXT_COOLING_TREND, "cooling"))
        .when(~pumps_on & ((mxc >= 0.02) | (has_still & (still > 1.0))),
              st("Warming up", TEXT_NOT_ENGAGED, "warming"))
        .when(pumps_on & (mxc >= 0.02), st("Cooling down", TEXT_COOLING_ACTIVE, "cooling"))
        .when(mxc < 0.02, st("At base", TEXT_HOLDING_BASE, "base"))
        .otherwise(st("Cooling down", TEXT_SETTLING, "cooling"))
    )


def fridge_state(snapshot: DataFrame, series: DataFrame, *, keys=(), mode: str = "reference",
                 lookback_hours: int = 3, bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """C1 per key set: ``label``, ``detail``, ``tone`` plus the inputs used.

    ``mode='reference'`` feeds the freshest MXC value (snapshot or history) as
    the source system does, which makes the sensor-floor arm unreachable;
    ``mode='strict'`` feeds the snapshot's own MXC value so that arm can fire.
    """
    k = keys_list(keys)
    wanted = ["T_MXC", "T_Still", *STATE_KEYS]
    fresh = pivot_series(freshest_values(snapshot, series, keys=k, series_keys=wanted),
                         keys=k, series_keys=wanted)
    mxc_series = series.filter(F.col("key") == "T_MXC")
    sl = slope(mxc_series, lookback_hours=lookback_hours, keys=k, bucket_us=bucket_us).select(*k, "slope_per_h")
    lv = last_valid_point(mxc_series, keys=k).select(*k, F.col("value").alias("last_valid_mxc"),
                                                    F.col(TS).alias("last_valid_mxc_ts"))
    lts = latest_series_ts(series, keys=k).select(*k, F.col("latest_ts").alias("_hist_ts"))
    snap = snapshot.select(*k, F.col(TS).alias("_snap_ts"), nan_to_null(F.col("T_MXC")).alias("_snap_mxc"))
    allin = combine([fresh, sl, lv, lts, snap], keys=k)
    return _decide(allin.withColumnRenamed("_hist_ts", "series_ts").withColumnRenamed("_snap_ts", "snap_ts")
                   .withColumnRenamed("_snap_mxc", "snap_mxc"), k, mode)


def _decide(inputs: DataFrame, k: list[str], mode: str) -> DataFrame:
    cur = F.greatest("snap_ts", "series_ts")
    age = F.greatest(F.lit(0.0), (micros(cur) - micros("last_valid_mxc_ts")).cast("double") / F.lit(float(HOUR_US)))
    mxc = F.col("T_MXC") if mode == "reference" else F.col("snap_mxc")
    pumps_on = F.greatest(*[F.coalesce(F.col(p) >= 0.5, F.lit(False)) for p in STATE_KEYS])
    cls = classify(mxc, F.col("T_Still"), pumps_on, F.col("slope_per_h"), F.col("last_valid_mxc"), age)
    return inputs.select(*k, cls.label.alias("label"), cls.detail.alias("detail"), cls.tone.alias("tone"),
                         mxc.alias("mxc"), F.col("T_Still").alias("still"), F.col("slope_per_h"),
                         pumps_on.alias("pumps_on"))


def current_state(readings: DataFrame, *, hours: int = 24, as_of=None, keys=(), mode: str = "reference",
                  lookback_hours: int = 3, bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """C1 straight from wide readings: :func:`fridge_state` of the latest row and
    the history of the trailing ``hours``, from at most three scans (see
    :func:`frostline.operators.vector.state_inputs`)."""
    k = keys_list(keys)
    return _decide(state_inputs(readings, hours=hours, as_of=as_of, keys=k, lookback_hours=lookback_hours, bucket_us=bucket_us), k, mode)


def state_timeline(readings: DataFrame, *, keys=(), bucket_us: int = DEFAULT_BUCKET_US,
                   lookback_hours: int = 3, tail_rows: int = 12) -> DataFrame:
    """The C1 state of each key set as of the end of every non-empty time bucket.

    Inputs per bucket: the bucket's last MXC reading (its own value, so the
    sensor-floor arm works), last non-NULL Still and pump values carried
    forward, the last valid MXC point carried forward, and the endpoint slope W7
    of the MXC points up to there: the window reaches back exactly
    ``lookback_hours`` from the last point (a whole number of buckets), and with
    fewer than two points in it the last ``tail_rows`` points count.  The state
    holds from the bucket's first reading to the next bucket's first reading (the
    last bucket: to its last reading), so durations add up to the covered span.

    The rows are shuffled once, by (keys, bucket).  Windows run over the bucket
    table alone; the newest points merge over the last ``tail_rows`` buckets that
    have any, and the bucket that a window's border cuts meets its rows again
    where the shuffle put them.
    """
    k = keys_list(keys)
    lb_us = int(lookback_hours) * HOUR_US
    if lb_us % bucket_us:
        raise ValueError("lookback_hours must be a whole number of buckets")
    us = F.coalesce(micros(TS), F.lit(0).cast("long"))
    g = ["_g"] if k else []
    names = ["_mxc", "_still", *STATE_KEYS]
    values = F.array(*[nan_to_null(F.col(c).cast("double")) for c in ("T_MXC", "T_Still", *STATE_KEYS)])
    rows = readings.select(*[F.struct(*k).alias("_g") for _ in g], us.alias("_us"),
                           F.coalesce(bucket_of(us, bucket_us), F.lit(0).cast("long")).alias("_b"), values.alias("_p")) \
        .repartition(*g, "_b").select(*g, "_us", "_b", *[F.get("_p", F.lit(i)).alias(c) for i, c in enumerate(names)])

    def last_valid(c):
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_us")))

    newer = Window.partitionBy(*g, "_b").orderBy(F.col("_us").desc()).rowsBetween(Window.unboundedPreceding, -1)
    vt = F.when(F.col("_mxc").isNotNull(), F.col("_us"))
    is_new = F.col("_mxc").isNotNull() & (F.col("_r") < tail_rows)
    part = rows.select("*", F.count("_mxc").over(newer).alias("_r")).groupBy(*g, "_b").agg(
        F.min("_us").alias("_first"), F.max("_us").alias("_last"),
        F.max_by("_mxc", "_us").alias("_own_mxc"),
        F.max_by("_mxc", vt).alias("_v1"), F.max(vt).alias("_t1"),
        F.min_by("_mxc", vt).alias("_v0"), F.min(vt).alias("_t0"), F.count(vt).alias("_cnt"),
        F.collect_list(F.when(is_new, F.struct(F.col("_us").alias("us"), F.col("_mxc").alias("v")))).alias("_tail"),
        last_valid("_still").alias("_still"),
        *[last_valid(p).alias(p) for p in STATE_KEYS],
    )

    # slope as of every bucket with a point
    group = Window.partitionBy(*g).orderBy("_b")
    whole = group.rangeBetween(-(lb_us - bucket_us), 0)
    mx = part.filter(F.col("_cnt") > 0).select(
        *g, "_b", "_t1", "_v1", F.sum("_cnt").over(whole).alias("_n"), F.min("_t0").over(whole).alias("_t0"),
        F.min_by("_v0", "_t0").over(whole).alias("_v0"),
        newest(F.flatten(F.collect_list("_tail").over(group.rowsBetween(-(tail_rows - 1), 0))), tail_rows).alias("_tail"))
    borders = mx.select(*g, (F.col("_b") - F.lit(lb_us)).alias("_b"), (F.col("_t1") - F.lit(lb_us)).alias("_cut"))
    # no filter of the rows: it would move below the shuffle, which could then not be the same one
    at = F.when((F.col("_us") >= F.col("_cut")) & F.col("_mxc").isNotNull(), F.col("_us"))
    half = rows.join(borders, [*g, "_b"]).groupBy(*g, "_b").agg(
        F.count(at).alias("_hn"), F.min(at).alias("_ht0"), F.min_by("_mxc", at).alias("_hv0")) \
        .withColumn("_b", F.col("_b") + F.lit(lb_us))
    both = mx.join(half, [*g, "_b"], "left")
    t0, v0 = F.coalesce("_ht0", "_t0"), F.coalesce("_hv0", "_v0")
    dt_h = (F.col("_t1") - t0).cast("double") / F.lit(float(HOUR_US))
    in_window = F.when(dt_h > 0, (F.col("_v1") - v0) / dt_h)
    n = F.col("_n") + F.coalesce("_hn", F.lit(0))
    slopes = both.select(*g, "_b", F.struct(F.when(n >= 2, in_window).otherwise(tail_slope(F.col("_tail"))).alias("v")).alias("_sl"))

    w_ff = group.rowsBetween(Window.unboundedPreceding, 0)

    def ffill(c):
        return F.last(c, ignorenulls=True).over(w_ff)

    t = part.join(slopes, [*g, "_b"], "left").select(
        *g, "_b", "_first", "_last", "_own_mxc",
        ffill("_v1").alias("_lv"), ffill("_t1").alias("_lvts"), ffill("_still").alias("_still"),
        *[ffill(p).alias(p) for p in STATE_KEYS], ffill("_sl").alias("_sl"),
        F.lead("_first").over(group).alias("_next_first"),
    )
    sl = F.col("_sl.v")
    age = F.greatest(F.lit(0.0), (F.col("_last") - F.col("_lvts")).cast("double") / F.lit(float(HOUR_US)))
    pumps_on = F.greatest(*[F.coalesce(F.col(p) >= 0.5, F.lit(False)) for p in STATE_KEYS])
    cls = classify(F.col("_own_mxc"), F.col("_still"), pumps_on, sl, F.col("_lv"), age)
    end = F.coalesce(F.col("_next_first"), F.col("_last"))
    dur = end - F.col("_first")
    return t.select(*[F.col(f"_g.{c}").alias(c) for c in k], from_micros("_b").alias("bucket_start"), cls.label.alias("label"),
                    cls.tone.alias("tone"), sl.alias("slope_per_h"), dur.alias("duration_us"),
                    (dur.cast("double") / F.lit(float(HOUR_US))).alias("hours"))


def state_hours(readings: DataFrame, *, keys=(), bucket_us: int = DEFAULT_BUCKET_US,
                lookback_hours: int = 3) -> DataFrame:
    """C2 summary: hours spent in each state label per key set."""
    k = keys_list(keys)
    tl = state_timeline(readings, keys=k, bucket_us=bucket_us, lookback_hours=lookback_hours)
    hours = F.sum("duration_us").cast("double") / F.lit(float(HOUR_US))
    return tl.groupBy(*k, "label").agg(hours.alias("hours"), F.count(F.lit(1)).alias("buckets"))


__all__ = ["classify", "current_state", "fridge_state", "state_timeline", "state_hours"]
