"""Structured Streaming forms of the per-minute, counter and 24 h operators.

Streams read an append-only source (``events`` parquet files or readings
batches), never the growing raw logs (a file source does not re-read a file
that grew).  Sinks are parquet folders with a checkpoint in the shared
scratch folder, so a restarted query resumes exactly once.

Files may arrive in any time order.  Every operator takes a ``delay``: a row at
most that much older than the newest row of an earlier batch is never lost;
older ones Spark drops and counts in the query's progress
(``numRowsDroppedByWatermark``).  State covers (keys, time bucket) cells, so no
state holds a whole device, and all of it is native: no Python runs in a task.
In update mode the sink gets a
row of each cell that a batch changed, and :func:`final_rows` keeps the last
version of each; in append mode it gets a cell once, when the watermark closes
it, so the newest cells are still missing there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frostline.functions.columns import bucket_of, from_micros, keys_list, micros
from frostline.operators.series import to_series
from frostline.schema import DASHBOARD_KEYS, HOUR_US, RUNTIME_PUMPS, TS
from frostline.sources.events import events_to_readings

COUNTER_PUMPS = RUNTIME_PUMPS


def events_stream(spark: SparkSession, sf_dir: str, *, max_files_per_trigger: int | None = None,
                  files: str = "events*.parquet") -> DataFrame:
    """Streaming readings from the ``events`` table files (adapter applied)."""
    schema = spark.read.option("pathGlobFilter", files).parquet(sf_dir).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return events_to_readings(reader.parquet(sf_dir))


def _event_time(df: DataFrame, delay: str) -> DataFrame:
    # watermarks need TIMESTAMP (LTZ): the naive time read as UTC, independent of the session zone
    return df.withColumn("_t", F.timestamp_micros(micros(TS))).withWatermark("_t", delay)


def _naive(instant) -> F.Column:
    """Back from the UTC instant of :func:`_event_time` to TIMESTAMP_NTZ."""
    return from_micros(F.unix_micros(instant))


def minute_last_values(stream: DataFrame, *, delay: str, keys=(), series_keys=tuple(DASHBOARD_KEYS)) -> DataFrame:
    """Last point of every series in a minute (a NULL is no point), one wide
    row per minute; :func:`minute_points` makes the points of it."""
    k = keys_list(keys)
    w = _event_time(stream, delay).groupBy(*k, F.window("_t", "1 minute").alias("w")) \
        .agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(TS))).alias(c) for c in series_keys])
    return w.select(*k, _naive(F.col("w.start")).alias(TS), *series_keys)


def minute_points(minutes: DataFrame, *, keys=(), series_keys=tuple(DASHBOARD_KEYS)) -> DataFrame:
    """Wide minutes -> points (keys, key, ts_eastern, value)."""
    k = keys_list(keys)
    return to_series(minutes, keys=k, series_keys=series_keys).select(*k, "key", TS, "value")


def hour_minmax(stream: DataFrame, *, delay: str, keys=(), columns=("T_Still", "T_MXC", "P1", "Flow")) -> DataFrame:
    """T4, streaming part: min/max per column, key and hour."""
    k = keys_list(keys)
    aggs = [f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.min, "min"), (F.max, "max"))]
    w = _event_time(stream, delay).groupBy(*k, F.window("_t", "1 hour").alias("w")).agg(*aggs)
    return w.select(*k, _naive(F.col("w.start")).alias("hour"), *[f"{c}_{n}" for c in columns for n in ("min", "max")])


def sliding_minmax(hours: DataFrame, *, keys=(), columns=("T_Still", "T_MXC", "P1", "Flow"), length: int = 24) -> DataFrame:
    """T4: min/max over every window of ``length`` hours that holds a row, from
    the hour rows; at each window end equals A1 with ``as_of`` = that end
    restricted to earlier rows.

    Two passes over blocks of ``length`` hours: a window is the rest of one block
    and the beginning of the next, so its extremes are those of a suffix and of a
    prefix, each a running extreme inside one block.  Every window end is made
    once, by the last hour row before it.
    """
    k = keys_list(keys)
    names = [(f, f"{c}_{n}") for c in columns for f, n in ((F.min, "min"), (F.max, "max"))]
    stats = [n for _, n in names]
    h = F.floor(micros("hour") / F.lit(HOUR_US)).cast("long")
    hour_rows = hours.select(*k, h.alias("_h"), F.floor(h / F.lit(length)).cast("long").alias("_blk"), *stats)
    in_block = Window.partitionBy(*k, "_blk").orderBy("_h")
    up_to = in_block.rowsBetween(Window.unboundedPreceding, 0)
    onward = in_block.rowsBetween(0, Window.unboundedFollowing)
    runs = hour_rows.select(*k, "_h", "_blk", *[f(n).over(up_to).alias(f"_pre_{n}") for f, n in names],
                            *[f(n).over(onward).alias(f"_suf_{n}") for f, n in names],
                            F.lead("_h").over(Window.partitionBy(*k).orderBy("_h")).alias("_next"))
    # the ends after this hour row, up to the next one; the beginning of the last block of a window
    last_end = F.least(F.coalesce(F.col("_next"), F.col("_h") + length), F.col("_h") + length)
    ends = runs.select(*k, "_h", "_blk", *[f"_pre_{n}" for n in stats], F.explode(F.sequence(F.col("_h") + 1, last_end)).alias("_end"))
    same = F.floor((F.col("_end") - 1) / F.lit(length)) == F.col("_blk")
    probes = ends.select(*k, (F.col("_end") - length).alias("_at"), F.lit(0).alias("_kind"), "_end",
                         *[F.when(same, F.col(f"_pre_{n}")).alias(f"_pre_{n}") for n in stats], *[F.lit(None).cast("double").alias(f"_suf_{n}") for n in stats])
    marks = runs.select(*k, F.col("_h").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_end"),
                        *[F.lit(None).cast("double").alias(f"_pre_{n}") for n in stats], *[f"_suf_{n}" for n in stats])
    # the suffix of a window's first block: that of the first hour row at or after the window's start in that block
    both = probes.unionByName(marks).withColumn("_blk", F.floor(F.col("_at") / F.lit(length)).cast("long"))
    after = Window.partitionBy(*k, "_blk").orderBy("_at", "_kind").rowsBetween(0, Window.unboundedFollowing)
    found = both.select(*k, "_end", *[f"_pre_{n}" for n in stats],
                        F.first(F.when(F.col("_kind") == 1, F.struct(*[f"_suf_{n}" for n in stats])), ignorenulls=True).over(after).alias("_s")) \
        .filter(F.col("_end").isNotNull())
    pick = {"min": F.least, "max": F.greatest}      # both skip NULLs
    return found.select(*k, from_micros(F.col("_end") * F.lit(HOUR_US)).alias("window_end"),
                        *[pick[n[-3:]](f"_pre_{n}", F.col(f"_s._suf_{n}")).alias(f"{n}_{length}h") for n in stats])


def runtime_counters(stream: DataFrame, *, delay: str, keys=("device_id",), pumps=tuple(COUNTER_PUMPS),
                     bucket_us: int = HOUR_US) -> DataFrame:
    """T3, streaming part: on-time and starts inside a (key, time bucket) cell.

    State of a cell: a native list of its rows, each packed into one long (time
    and on/off bits), so a row may come in any order.  Use update mode: every
    batch that touches a cell emits its partial again (:func:`final_rows` keeps
    the last); the state goes when the watermark passes the cell.
    :func:`latest_counters` stitches the partials.  ``bucket_us`` bounds what one
    state holds; it must divide an hour or be a whole number of them.
    """
    k, pumps = keys_list(keys), list(pumps)
    shift = 1 << len(pumps)
    bits = sum((F.when(F.col(p) >= 0.5, F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate(pumps)), F.lit(0))
    packed = micros(TS) * F.lit(shift) + bits.cast("long")
    cells = _event_time(stream, delay).groupBy(*k, F.window("_t", f"{int(bucket_us)} microseconds").alias("w")) \
        .agg(F.sort_array(F.collect_list(packed)).alias("_rows"))

    def us(x):
        return F.shiftright(x, len(pumps))

    def on(x, i):
        return F.shiftright(x, i).bitwiseAND(F.lit(1))

    first, last = F.element_at("_rows", 1), F.element_at("_rows", -1)
    zero = F.struct(first.alias("was"), *[F.lit(0).cast("long").alias(f"{n}_{p}") for p in pumps for n in ("run", "st")])

    def step(acc, x):
        parts = [x.alias("was")]
        for i, p in enumerate(pumps):
            lit = on(x, i)
            parts.append((acc[f"run_{p}"] + (us(x) - us(acc["was"])) * lit).alias(f"run_{p}"))
            parts.append((acc[f"st_{p}"] + lit * (F.lit(1).cast("long") - on(acc["was"], i))).alias(f"st_{p}"))
        return F.struct(*parts)

    # from the second row on: the first one's gap and start belong to the stitch
    folded = F.aggregate(F.slice("_rows", F.lit(2), F.size("_rows")), zero, step)
    mask = F.lit(shift - 1).cast("long")
    return cells.select(*k, F.unix_micros("w.start").alias("bucket"), us(first).alias("first_us"), us(last).alias("last_us"),
                        first.bitwiseAND(mask).alias("first_on"), last.bitwiseAND(mask).alias("last_on"),
                        F.size("_rows").cast("long").alias("rows"), folded.alias("_f")) \
        .select("*", *[f"_f.{n}_{p}" for n in ("run", "st") for p in pumps]).drop("_f")


def latest_counters(cells: DataFrame, *, keys=("device_id",), pumps=tuple(COUNTER_PUMPS)) -> DataFrame:
    """Running on-hours, start counts and rows per key, from one partial per
    cell; the gaps and starts between neighbouring cells are added here (one row
    per key and cell)."""
    k, pumps = keys_list(keys), list(pumps)
    w = Window.partitionBy(*k).orderBy("bucket")
    st = cells.withColumn("_before", F.lag("last_us").over(w)).withColumn("_was", F.coalesce(F.lag("last_on").over(w), F.lit(0)))
    aggs = []
    for i, p in enumerate(pumps):
        on, was = F.getbit("first_on", F.lit(i)) == 1, F.getbit("_was", F.lit(i)) == 1
        gap = F.when(on, F.coalesce(F.col("first_us") - F.col("_before"), F.lit(0))).otherwise(0)
        aggs.append((F.sum(F.col(f"run_{p}") + gap).cast("double") / F.lit(float(HOUR_US))).alias(f"total_hours_{p}"))
        aggs.append(F.sum(F.col(f"st_{p}") + (on & ~was).cast("long")).cast("long").alias(f"{p}_starts"))
    got = st.groupBy(*k).agg(*aggs, F.sum("rows").alias("rows"))
    return got.select(*k, *[f"total_hours_{p}" for p in pumps], *[f"{p}_starts" for p in pumps], "rows")


def run_available_now(df: DataFrame, out_path: str, checkpoint: str, *, mode: str = "append") -> DataFrame:
    """Drain the source once (``availableNow``) into a parquet sink and return the
    sink as a batch DataFrame.  In update mode each row has the number of its
    batch (``_batch``), and a batch that is run again replaces its own folder."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if mode == "update":
        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out_path}/_batch={number}")
        q = writer.foreachBatch(keep).start()
    else:
        q = writer.format("parquet").option("path", out_path).start()
    q.awaitTermination()
    spark = df.sparkSession
    if mode == "update":
        schema = df.schema.add("_batch", "long")
        return spark.read.schema(schema).parquet(out_path)
    return spark.read.parquet(out_path)


def final_rows(updates: DataFrame, cell: list[str]) -> DataFrame:
    """The last version of every cell of an update-mode sink."""
    cols = [c for c in updates.columns if c not in (*cell, "_batch")]
    last = updates.groupBy(*cell).agg(F.max_by(F.struct(*cols), "_batch").alias("_v"))
    return last.select(*cell, *[f"_v.{c}" for c in cols])
