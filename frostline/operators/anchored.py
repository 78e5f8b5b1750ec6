"""Windows anchored at a series' own end (W5, W7) by cell pruning, and the
mergeable newest-N partial (R4).

Rows are shuffled once, by (group, time cell).  Every cell collapses to one
partial: counts, first and last valid point, starts inside the cell, its newest
points.  The partials of a group tell where each series ends, so where its window
begins, so which cells lie wholly inside.  Of the one cell that the border cuts
the raw rows are needed again: a list of (group, cell, border) meets them where
the first shuffle put them.  No raw row is joined on a device, and no task sees
more than a cell of raw rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.functions.columns import bucket_of, keys_list, micros, nan_to_null
from frostline.schema import DEFAULT_BUCKET_US, HOUR_US, STATE_KEYS, TS


@dataclass(frozen=True)
class Slope:
    """W7 of a series in wide rows: ``value`` is NULL in rows that are none of
    the series, and NaN in rows of it without a value."""
    name: str
    value: Column
    lookback_us: int = 3 * HOUR_US
    tail: int = 12


@dataclass(frozen=True)
class Starts:
    """W5 of a series in wide rows: ``on`` (boolean) is NULL where there is no sample."""
    name: str
    on: Column
    lookback_us: int = 24 * HOUR_US


def newest(points: Column, n: int) -> Column:
    """The ``n`` newest of an array of structs whose first field is the time:
    the mergeable form of the last n rows (concatenate, then cut again)."""
    return F.slice(F.sort_array(points, asc=False), 1, n)


def last_points(cells: DataFrame, over: list[str], points: str, n: int) -> DataFrame:
    """R4 per group: the ``n`` newest points, merged over the groups' cells."""
    return cells.groupBy(*over).agg(newest(F.flatten(F.collect_list(points)), n).alias(points))


def tail_slope(points: Column) -> Column:
    """Endpoint slope per hour of an array of (us, value) points: rows without a
    value go out, then fewer than two or no time between them gives NULL."""
    ok = F.filter(points, lambda p: p["v"].isNotNull())
    first, last = F.array_min(ok), F.array_max(ok)
    hours = (last["us"] - first["us"]).cast("double") / F.lit(float(HOUR_US))
    return F.when((F.size(ok) >= 2) & (hours > 0), (last["v"] - first["v"]) / hours)


def _partials(rows: DataFrame, g: list[str], slopes: list[Slope], starts: list[Starts], tails: bool) -> DataFrame:
    by_time = Window.partitionBy(*g, "_b").orderBy("_us")
    before = by_time.rowsBetween(Window.unboundedPreceding, -1)
    newer = Window.partitionBy(*g, "_b").orderBy(F.col("_us").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.last(F.col(f"_on_{s.name}"), ignorenulls=True).over(before).alias(f"_was_{s.name}") for s in starts]
    if tails:
        cols += [F.count(f"_v_{s.name}").over(newer).alias(f"_r_{s.name}") for s in slopes]
    rows = rows.select("*", *cols)
    us = F.col("_us")
    aggs = []
    for s in slopes:
        v = nan_to_null(F.col(f"_v_{s.name}"))
        m = F.col(f"_v_{s.name}").isNotNull()
        at, ok = F.when(m, us), F.when(v.isNotNull(), us)
        aggs += [F.count(at).alias(f"n_{s.name}"), F.min(at).alias(f"first_{s.name}"), F.max(at).alias(f"last_{s.name}"),
                 F.count(ok).alias(f"ok_{s.name}"), F.min(ok).alias(f"t0_{s.name}"), F.min_by(v, ok).alias(f"v0_{s.name}"),
                 F.max(ok).alias(f"t1_{s.name}"), F.max_by(v, ok).alias(f"v1_{s.name}")]
        if tails:
            point = F.struct(us.alias("us"), v.alias("v"))
            aggs.append(F.collect_list(F.when(m & (F.col(f"_r_{s.name}") < s.tail), point)).alias(f"tail_{s.name}"))
    for s in starts:
        on, was = F.col(f"_on_{s.name}"), F.col(f"_was_{s.name}")
        at = F.when(on.isNotNull(), us)
        aggs += [F.count(at).alias(f"n_{s.name}"), F.min(at).alias(f"first_{s.name}"), F.max(at).alias(f"last_{s.name}"),
                 F.min_by(on, at).alias(f"fon_{s.name}"), F.max_by(on, at).alias(f"lon_{s.name}"), F.count_if(on & ~was).alias(f"st_{s.name}")]
    return rows.groupBy(*g, "_b").agg(*aggs)


def anchored(df: DataFrame, us: Column, cell: Column, *, keys=(), slopes: list[Slope] = (), starts: list[Starts] = (),
             cut: bool = True) -> DataFrame:
    """One row per group: ``slope_<name>`` and ``rows_<name>`` (W7; rows of the
    whole series), ``starts_<name>`` (W5; NULL without a sample).

    ``cell`` is the start of the row's time cell, in microseconds (any borders
    give the same result).  ``cut=False`` promises that no window begins after
    the first row of its series, so that whole cells are enough.
    """
    k, slopes, starts = keys_list(keys), list(slopes), list(starts)
    every = [*slopes, *starts]
    # group and cell are never NULL, so that joins on them meet the rows where the shuffle put them
    g = ["_g"] if k else []
    named = [F.struct(*k).alias("_g")] if k else []
    # one array of all values: every use below reads the same columns, so that the shuffle is done once and reused
    values = F.array(*[s.value.cast("double") for s in slopes], *[s.on.cast("double") for s in starts])
    packed = df.select(*named, F.coalesce(us, F.lit(0).cast("long")).alias("_us"), F.coalesce(cell, F.lit(0).cast("long")).alias("_b"), values.alias("_p")) \
        .repartition(*g, "_b")
    cols = [F.get("_p", F.lit(i)).alias(f"_v_{s.name}") for i, s in enumerate(slopes)]
    cols += [(F.get("_p", F.lit(len(slopes) + i)) == 1.0).alias(f"_on_{s.name}") for i, s in enumerate(starts)]
    rows = packed.select(*g, "_us", "_b", *cols)
    cells = _partials(rows, g, slopes, starts, tails=True)

    group = Window.partitionBy(*g)
    newer = group.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    st = cells.select("*", *[(F.max(f"last_{s.name}").over(group) - F.lit(int(s.lookback_us))).alias(f"cut_{s.name}") for s in every],
                      *[F.coalesce(F.sum(f"n_{s.name}").over(newer), F.lit(0)).alias(f"newer_{s.name}") for s in slopes])
    sums = {s.name: ["n", "ok", "t0", "v0", "t1", "v1"] for s in slopes} | {s.name: ["n", "fon", "lon", "st"] for s in starts}

    def whole(s):
        return F.col(f"first_{s.name}") >= F.col(f"cut_{s.name}")

    tails = [F.when((F.col(f"newer_{s.name}") < s.tail) & (F.size(f"tail_{s.name}") > 0), F.col(f"tail_{s.name}")).alias(f"tail_{s.name}") for s in slopes]
    used = st.select(*g, "_b", *[F.when(whole(s), F.col(f"{c}_{s.name}")).alias(f"{c}_{s.name}") for s in every for c in sums[s.name]],
                     *tails, *[F.col(f"n_{s.name}").alias(f"all_{s.name}") for s in slopes])
    if cut:
        half = {s.name: ~whole(s) & (F.col(f"last_{s.name}") >= F.col(f"cut_{s.name}")) for s in every}
        any_half = F.lit(False)
        for c in half.values():
            any_half = any_half | F.coalesce(c, F.lit(False))
        borders = st.filter(any_half).select(*g, "_b", *[F.when(c, F.col(f"cut_{n}")).alias(f"_cut_{n}") for n, c in half.items()])
        inside = {s.name: F.coalesce(F.col("_us") >= F.col(f"_cut_{s.name}"), F.lit(False)) for s in every}
        masked = rows.join(borders, [*g, "_b"]).select(
            *g, "_us", "_b", *[F.when(inside[s.name], F.col(f"_v_{s.name}")).alias(f"_v_{s.name}") for s in slopes],
            *[F.when(inside[s.name], F.col(f"_on_{s.name}")).alias(f"_on_{s.name}") for s in starts])
        again = _partials(masked, g, slopes, starts, tails=False) \
            .select(*g, "_b", *[f"{c}_{s.name}" for s in every for c in sums[s.name]])
        used = used.unionByName(again, allowMissingColumns=True)

    order = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    used = used.select("*", *[F.last(f"lon_{s.name}", ignorenulls=True).over(order).alias(f"_was_{s.name}") for s in starts])
    aggs = []
    for s in slopes:
        n = s.name
        aggs += [F.sum(f"n_{n}").alias(f"n_{n}"), F.sum(f"ok_{n}").alias(f"ok_{n}"), F.min(f"t0_{n}").alias(f"t0_{n}"), F.min_by(f"v0_{n}", f"t0_{n}").alias(f"v0_{n}"),
                 F.max(f"t1_{n}").alias(f"t1_{n}"), F.max_by(f"v1_{n}", f"t1_{n}").alias(f"v1_{n}"), F.sum(f"all_{n}").alias(f"all_{n}"),
                 newest(F.flatten(F.collect_list(f"tail_{n}")), s.tail).alias(f"tail_{n}")]
    for s in starts:
        n = s.name
        edge = F.when(F.col(f"fon_{n}") & ~F.coalesce(F.col(f"_was_{n}"), F.lit(False)), 1).otherwise(0)
        aggs += [F.sum(f"n_{n}").alias(f"n_{n}"), F.sum(F.col(f"st_{n}") + edge).cast("long").alias(f"st_{n}")]
    res = used.groupBy(*g).agg(*aggs)
    out = []
    for s in slopes:
        n = s.name
        hours = (F.col(f"t1_{n}") - F.col(f"t0_{n}")).cast("double") / F.lit(float(HOUR_US))
        in_window = F.when((F.col(f"ok_{n}") >= 2) & (hours > 0), (F.col(f"v1_{n}") - F.col(f"v0_{n}")) / hours)
        out += [F.when(F.col(f"n_{n}") >= 2, in_window).when(F.col(f"all_{n}") >= 2, tail_slope(F.col(f"tail_{n}"))).alias(f"slope_{n}"),
                F.col(f"all_{n}").alias(f"rows_{n}")]
    for s in starts:
        n = s.name
        out.append(F.when(F.col(f"n_{n}") == 1, F.lit(0).cast("long")).when(F.col(f"n_{n}") > 1, F.col(f"st_{n}")).alias(f"starts_{n}"))
    return res.select(*[F.col(f"_g.{c}").alias(c) for c in k], *out)


def sampled_on(column: str) -> Column:
    """On/off of a sample, NULL where there is none."""
    return nan_to_null(F.col(column).cast("double")) >= 0.5


def column_slope(readings: DataFrame, column: str = "T_MXC", *, lookback_hours: int = 3, tail_rows: int = 12, keys=(),
                 bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """W7 of one column of wide readings (its non-NULL rows are the series):
    ``(keys, key, slope_per_h)``, a row per key set that has the series."""
    k = keys_list(keys)
    us = micros(TS)
    out = anchored(readings, us, bucket_of(us, bucket_us), keys=k, slopes=[Slope("s", F.col(column).cast("double"), int(lookback_hours) * HOUR_US, tail_rows)])
    return out.filter(F.col("rows_s") > 0).select(*k, F.lit(column).alias("key"), F.col("slope_s").alias("slope_per_h"))


def column_starts(readings: DataFrame, columns=tuple(STATE_KEYS), *, lookback_hours: int = 24, keys=(),
                  bucket_us: int = DEFAULT_BUCKET_US) -> DataFrame:
    """W5 of state columns of wide readings: ``(keys, key, starts)``, a row per
    key set and column that has samples.  The rows are not multiplied by column."""
    k = keys_list(keys)
    us = micros(TS)
    out = anchored(readings, us, bucket_of(us, bucket_us), keys=k, starts=[Starts(c, sampled_on(c), int(lookback_hours) * HOUR_US) for c in columns])
    long = out.select(*k, *[F.col(f"starts_{c}").alias(c) for c in columns]).unpivot(k, list(columns), "key", "starts")
    return long.filter(F.col("starts").isNotNull()).select(*k, "key", "starts")
