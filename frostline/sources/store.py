"""Append-only readings store with a manifest commit point.

Layout below ``store_root`` (any Hadoop path, normally under the shared
``spark.checkpoint.dir`` or a warehouse folder)::

    raw/batch_id=<id>/day=<yyyy-mm-dd>/part-*.parquet   parsed wide rows
    spans/part-*.parquet                                 (source_file, day, first_us, last_us, n_rows, batch_id)
    manifest/part-*.parquet                              (path, size, mtime, ingested_at, batch_id)
    partials/pass_id=<id>/day=<yyyy-mm-dd>/part-*        hour partials of W1-W4, A1, A2
    partial_days/part-*.parquet                          (day, pass_id, batch_id, n_rows, last_us, refreshed_at)

A pass writes the rebuilt sources as a new batch, then appends one manifest row
per rebuilt source.  The manifest append is the commit: a failed pass leaves an
unreferenced batch that readers ignore, and a rebuild that yields no rows still
replaces the source (its new batch simply has no rows).  Then the hour partials
of the days that the batch touches are made anew; a pass that dies before that is
made up for by the next one, because its batch is missing in ``partial_days``.
Re-running a pass after a failure is safe; nothing is updated in place.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline.functions.columns import from_micros, micros, scrub_frame, ts_literal
from frostline.operators import intervals as I
from frostline.schema import (
    DEFAULT_BUCKET_US, HOUR_US, MANIFEST_SCHEMA, METRICS_LATEST_COLUMNS, MINMAX_24H_COLUMNS, READING_COLUMNS, RUNTIME_PUMPS, TS,
    readings_schema,
)
from frostline.session import jit_sized_methods
from frostline.sources.logfiles import (
    changed_sources, current_manifest, list_log_files, path_exists, qualify, source_folders,
)
from frostline.sources.logparse import build_readings


RAW_SCHEMA = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in readings_schema().fields),
                           T.StructField("batch_id", T.StringType()), T.StructField("day", T.DateType())])
SPANS_SCHEMA = "source_file string, day date, first_us long, last_us long, n_rows long, batch_id string"
DAYS_SCHEMA = "day date, pass_id string, batch_id string, n_rows long, last_us long, refreshed_at timestamp"
# the stored partials hold every row in their window part
_ALL = dt.datetime(1, 1, 1)
_LATEST = [c for c in METRICS_LATEST_COLUMNS if c != TS and not c.startswith("total_hours_")]


def _path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def _read(spark: SparkSession, store_root: str, name: str, schema) -> DataFrame:
    p = _path(store_root, name)
    return spark.read.schema(schema).parquet(p) if path_exists(spark, p) else spark.createDataFrame([], schema)


def read_manifest(spark: SparkSession, store_root: str) -> DataFrame | None:
    p = _path(store_root, "manifest")
    return spark.read.schema(MANIFEST_SCHEMA).parquet(p) if path_exists(spark, p) else None


def _live_spans(spark: SparkSession, store_root: str, current: DataFrame) -> DataFrame:
    """One span per live source and day it has rows of."""
    live = current.select(F.col("path").alias("source_file"), "batch_id")
    return _read(spark, store_root, "spans", SPANS_SCHEMA).join(live, ["source_file", "batch_id"]).dropDuplicates(["source_file", "day"])


def overlaps(spans: DataFrame) -> DataFrame:
    """The stretches ``(day, from_us, to_us)`` (ends included) in which spans of
    two sources or more lie over each other.  One sweep over the sorted ends of a
    day's spans, counting the open ones; a day is a task's work, whatever the
    number of rows in it."""
    ends = spans.select("day", F.explode(F.array(F.struct(F.col("first_us").alias("at"), F.lit(1).alias("step")),
                                                 F.struct(F.col("last_us").alias("at"), F.lit(-1).alias("step")))).alias("e"))
    # a span that ends where another begins meets it: beginnings first
    sweep = Window.partitionBy("day").orderBy("e.at", F.col("e.step").desc())
    opened = ends.select("day", F.col("e.at").alias("from_us"), F.lead("e.at").over(sweep).alias("to_us"),
                         F.sum("e.step").over(sweep.rowsBetween(Window.unboundedPreceding, 0)).alias("_open"))
    return opened.filter(F.col("_open") > 1).select("day", "from_us", "to_us")


def readings(spark: SparkSession, store_root: str, *, dedupe: bool = True, days=None) -> DataFrame:
    """S8 + S10: the current readings table (of ``days``, a list of dates, alone).

    Read are the folders of live batches (and of the wanted days), which the span
    index names: no folder is asked for and no replaced copy is listed.  With
    ``dedupe`` there is one row per timestamp: the later-ingested source wins the
    whole row.  Only rows in the overlapping stretches of two live sources can
    collide (:func:`overlaps`); they alone are shuffled by timestamp.  ``day``
    stays available for pruning.
    """
    man = read_manifest(spark, store_root)
    empty = spark.createDataFrame([], readings_schema()).withColumn("day", F.lit(None).cast("date"))
    if man is None:
        return empty
    current = current_manifest(man)
    spans = _live_spans(spark, store_root, current)
    if days is not None:
        spans = spans.filter(F.col("day").isin(list(days))) if days else spans.limit(0)
    # the folders of the read: store metadata, as many as live batches (and days)
    raw = _path(store_root, "raw")
    if days is None:
        folders = [f"{raw}/batch_id={r.batch_id}" for r in spans.select("batch_id").distinct().collect()]
    else:
        folders = [f"{raw}/batch_id={r.batch_id}/day={r.day}" for r in spans.select("batch_id", "day").distinct().collect()]
    if not folders:
        return empty
    cur = current.select(F.col("path").alias("source_file"), "batch_id", F.col("ingested_at").alias("_ing"))
    live = spark.read.schema(RAW_SCHEMA).option("basePath", raw).parquet(*folders).join(cur, ["source_file", "batch_id"], "inner")
    if not dedupe:
        return live.select(*READING_COLUMNS, "day")
    live = live.withColumn("_us", micros(TS))
    shared = overlaps(spans).withColumnRenamed("day", "_day")
    inside = (F.col("day") == F.col("_day")) & (F.col("_us") >= F.col("from_us")) & (F.col("_us") <= F.col("to_us"))
    single = live.join(shared, inside, "left_anti")
    multi = live.join(shared, inside, "left_semi")
    rest = [c for c in READING_COLUMNS if c != TS] + ["day"]
    best = multi.groupBy(TS).agg(F.max_by(F.struct(*rest), F.struct("_ing", "source_file")).alias("_row"))
    return single.select(*READING_COLUMNS, "day").unionByName(
        best.select(TS, *[f"_row.{c}" for c in rest]).select(*READING_COLUMNS, "day"))


# ---------------------------------------------------------------------------
# Hour partials: metrics and summary without reading the history again
# ---------------------------------------------------------------------------

def _current_days(spark: SparkSession, store_root: str) -> DataFrame:
    """The last partials of every day that has rows: ``(day, pass_id, n_rows, last_us)``."""
    rows = _read(spark, store_root, "partial_days", DAYS_SCHEMA).filter(F.col("day").isNotNull())
    last = rows.groupBy("day").agg(F.max_by(F.struct("pass_id", "n_rows", "last_us"), F.struct("refreshed_at", "pass_id")).alias("_r"))
    return last.select("day", "_r.*").filter(F.col("n_rows") > 0)


def _hour_partials(rows: DataFrame, since_us=None) -> DataFrame:
    start = ts_literal(_ALL) if since_us is None else since_us
    return I.history_cells(rows, pumps=RUNTIME_PUMPS, latest_columns=_LATEST, window=(start, start), minmax=MINMAX_24H_COLUMNS,
                           bucket_us=DEFAULT_BUCKET_US)


def stale_days(spark: SparkSession, store_root: str) -> tuple[list[str], list[dt.date]]:
    """Committed batches whose days are not yet in the partials, and these days:
    all that the batches' sources have, or had, rows of."""
    man = read_manifest(spark, store_root)
    if man is None:
        return [], []
    done = _read(spark, store_root, "partial_days", DAYS_SCHEMA).select("batch_id").distinct()
    fresh = man.join(done, "batch_id", "left_anti").select(F.col("path").alias("source_file"), "batch_id").distinct()
    batches = [r.batch_id for r in fresh.select("batch_id").distinct().collect()]
    if not batches:
        return [], []
    days = _read(spark, store_root, "spans", SPANS_SCHEMA).join(fresh.select("source_file").distinct(), "source_file").select("day").distinct()
    return sorted(batches), sorted(r.day for r in days.collect())


def refresh_partials(spark: SparkSession, store_root: str) -> list[dt.date]:
    """Make the hour partials of the stale days anew, from the raw rows of these
    days alone; returns the days."""
    batches, days = stale_days(spark, store_root)
    if not batches:
        return []
    pass_id = dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S") + "-" + uuid.uuid4().hex[:8]
    folder = _path(store_root, f"partials/pass_id={pass_id}")
    if days:
        cells = _hour_partials(readings(spark, store_root, days=days)).withColumn("day", F.to_date(from_micros("_b")))
        with jit_sized_methods(spark):
            cells.repartition("day").write.partitionBy("day").parquet(folder)
        got = {r.day: (r.n, r.last) for r in spark.read.parquet(folder).groupBy("day").agg(F.sum("_n").alias("n"), F.max("_last").alias("last")).collect()} \
            if path_exists(spark, folder) and any(_day_folders(spark, folder)) else {}
    else:
        got = {}
    now = dt.datetime.now(dt.timezone.utc)
    rows = [(d, pass_id, batches[-1], *got.get(d, (0, None)), now) for d in days]
    rows += [(None, pass_id, b, 0, None, now) for b in batches]     # these batches are done
    spark.createDataFrame(rows, DAYS_SCHEMA).coalesce(1).write.mode("append").parquet(_path(store_root, "partial_days"))
    return days


def _day_folders(spark: SparkSession, folder: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [st.getPath().getName() for st in fs.listStatus(path) if st.isDirectory()]


def partial_cells(spark: SparkSession, store_root: str) -> DataFrame | None:
    """The current hour partials of the whole store (None: it has no rows)."""
    days = _current_days(spark, store_root).select("day", "pass_id").collect()
    if not days:
        return None
    root = _path(store_root, "partials")
    first = spark.read.option("basePath", root).parquet(f"{root}/pass_id={days[0].pass_id}/day={days[0].day}").schema
    return spark.read.schema(first).option("basePath", root).parquet(*[f"{root}/pass_id={r.pass_id}/day={r.day}" for r in days])


def store_metrics(spark: SparkSession, store_root: str, *, as_of=None) -> DataFrame:
    """Q3 from the hour partials: the metrics record of the store's readings.

    Counters, cold hours, streak and the latest row come from all cells (one row
    per hour), the 24 h figures from the cells that lie in the window; of the one
    hour that the window's border cuts the raw rows are read, from its day's
    folders.
    """
    cells = partial_cells(spark, store_root)
    columns = [*METRICS_LATEST_COLUMNS, *[f"{c}_{n}_24h" for c in MINMAX_24H_COLUMNS for n in ("min", "max")],
               "hours_below_20mK_total", "hours_below_20mK_current", *[f"{p}_starts_24h" for p in I.STARTS_PUMPS]]
    if cells is None:
        empty = readings_schema().fields
        types = {f.name: f.dataType.simpleString() for f in empty}
        return spark.createDataFrame([], ", ".join(f"{c} {'long' if c.endswith('_starts_24h') else types.get(c, 'double')}" for c in columns))
    end_us = cells.agg(F.max("_last")).first()[0] if as_of is None else \
        int((dt.datetime.fromisoformat(str(as_of)) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    start_us = end_us - 24 * HOUR_US
    hist = I.stitch_history(cells, pumps=RUNTIME_PUMPS, latest_columns=_LATEST)
    recent = cells.filter(F.col("_first") >= F.lit(start_us))
    cut_b = start_us - start_us % DEFAULT_BUCKET_US
    day = (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=cut_b)).date()
    cut = readings(spark, store_root, days=[day]).filter((micros(TS) >= F.lit(start_us)) & (micros(TS) < F.lit(cut_b + DEFAULT_BUCKET_US)))
    # an hour that begins inside the window is whole
    whole = recent.filter(F.col("_b") != F.lit(cut_b)).drop("day", "pass_id")
    win = I.stitch_recent(whole.unionByName(_hour_partials(cut)), pumps=RUNTIME_PUMPS)
    both = hist.withColumnRenamed("latest_ts", TS).crossJoin(win)      # one row each
    return scrub_frame(both.select(*columns))


def vacuum(spark: SparkSession, store_root: str) -> int:
    """Delete the folders of batches and partials that hold nothing current, and
    cut manifest, spans and day list down to their current state (a compacted copy
    is appended before the old files go, so a reader in between sees each state
    at least once); returns the number of batch folders.  Like any clean-up of
    replaced files it must not run while an older reader still uses them, so a
    pass does it only when asked."""
    man = read_manifest(spark, store_root)
    if man is None:
        return 0
    current = current_manifest(man)
    live = {r.batch_id for r in current.select("batch_id").distinct().collect()}
    passes = {r.pass_id for r in _current_days(spark, store_root).select("pass_id").distinct().collect()}
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def children(name):
        root = jvm.org.apache.hadoop.fs.Path(_path(store_root, name))
        fs = root.getFileSystem(conf)
        return fs, [st.getPath() for st in (fs.listStatus(root) if fs.exists(root) else [])]

    spans = _live_spans(spark, store_root, current)
    days = _read(spark, store_root, "partial_days", DAYS_SCHEMA)
    kept_days = days.filter(F.col("day").isNotNull()).groupBy("day").agg(
        F.max_by(F.struct(*[c for c in days.columns if c != "day"]), F.struct("refreshed_at", "pass_id")).alias("_r")).select("day", "_r.*")
    done = days.filter(F.col("day").isNull()).join(current.select("batch_id").distinct(), "batch_id", "left_semi").select(*days.columns).distinct()
    replaced = []
    for name, state in (("manifest", current.select(*MANIFEST_SCHEMA.fieldNames())), ("spans", spans.select("source_file", "day", "first_us", "last_us", "n_rows", "batch_id")),
                        ("partial_days", kept_days.select(*days.columns).unionByName(done))):
        fs, old = children(name)
        if len(old) > 2:            # more than one part file and its marker
            state.coalesce(1).write.mode("append").parquet(_path(store_root, name))
            replaced += [(fs, path) for path in old]
    # every state is written before the first file goes that another one is read from
    for fs, path in replaced:
        fs.delete(path, False)
    dead = 0
    for name, label, keep in (("raw", "batch_id=", live), ("partials", "pass_id=", passes)):
        fs, folders = children(name)
        for path in folders:
            if path.getName().startswith(label) and path.getName()[len(label):] not in keep:
                fs.delete(path, True)
                dead += name == "raw"
    return dead


def ingest_sources(spark: SparkSession, store_root: str, sources: list[tuple[str, int, int]],
                   *, batch_id: str | None = None) -> str:
    """Rebuild the given ``(path, size_bytes, mtime_ns)`` sources as one batch and commit."""
    batch_id = batch_id or dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S") + "-" + uuid.uuid4().hex[:8]
    sources = [(qualify(spark, p), s, m) for p, s, m in sources]
    paths = [p for p, _, _ in sources]
    wide = build_readings(spark, paths).withColumn("batch_id", F.lit(batch_id)) \
        .withColumn("day", F.to_date(TS))
    # rebalance by day: few files per (batch, day) folder, and AQE splits a day that holds a
    # large share of the rows into several tasks instead of sending it to one
    with jit_sized_methods(spark):
        wide.hint("rebalance", "day").write.mode("append").partitionBy("batch_id", "day") \
            .parquet(_path(store_root, "raw"))
    batch_path = _path(store_root, f"raw/batch_id={batch_id}")
    if path_exists(spark, batch_path):
        # span index of the batch, from two columns of the files just written (one row per source and day)
        us = micros(TS)
        (spark.read.schema(RAW_SCHEMA).parquet(batch_path).groupBy("source_file", "day")
         .agg(F.min(us).alias("first_us"), F.max(us).alias("last_us"), F.count(F.lit(1)).alias("n_rows"))
         .withColumn("batch_id", F.lit(batch_id))
         .coalesce(1).write.mode("append").parquet(_path(store_root, "spans")))
    now = dt.datetime.now(dt.timezone.utc)      # aware: no detour over the driver's local zone
    rows = [(p, int(s), int(m), now, batch_id) for p, s, m in sources]
    spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1).write.mode("append").parquet(_path(store_root, "manifest"))
    return batch_id


def sync_once(spark: SparkSession, logs_root: str, store_root: str, *, clean: bool = False) -> dict:
    """Discover -> diff -> rebuild every changed source in one job -> commit ->
    refresh the hour partials of the changed days -> summary (S12, from the day
    list: nothing is counted again).

    The signature is taken before parsing, so files growing during the pass
    trigger another rebuild next time.  Sources that vanished keep their rows.
    With ``clean`` replaced batches are deleted at the end (see :func:`vacuum`).
    """
    if not path_exists(spark, logs_root):
        raise FileNotFoundError(f"logs root not found: {logs_root}")
    files = list_log_files(spark, logs_root)
    sources = source_folders(files, logs_root)
    man = read_manifest(spark, store_root)
    changed = changed_sources(sources, man).select("path", "size_bytes", "mtime_ns") \
        .orderBy("path").collect()  # the input path list of the next read (metadata only)
    n_seen = sources.count()
    batch = None
    if changed:
        batch = ingest_sources(spark, store_root, [(r.path, r.size_bytes, r.mtime_ns) for r in changed])
    days = refresh_partials(spark, store_root)
    total = _current_days(spark, store_root).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows_total"),
                                                 from_micros(F.max("last_us")).alias("latest")).first()
    if clean:
        vacuum(spark, store_root)
    man2 = read_manifest(spark, store_root)
    tracked = 0 if man2 is None else man2.select("path").distinct().count()
    return {
        "status": "ok",
        "checked_at": dt.datetime.now().isoformat(timespec="seconds"),
        "sources_seen": n_seen,
        "sources_changed": len(changed),
        "sources_synced": len(changed),
        "tracked_sources": tracked,
        "rows_total": total.rows_total,
        "latest_ts_eastern": total.latest.isoformat() if total.latest else None,
        "batch_id": batch,
        "days_refreshed": len(days),
    }
