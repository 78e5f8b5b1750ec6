"""Registered queries: ``name -> f(spark, sf_dir) -> DataFrame``.

Every query reads the whole ``events`` table through the readings adapter
(single device: ``keys=()``, or per device: ``keys=("device_id",)``), with
``as_of`` = the latest timestamp of the data.  Floating results that go
through transcendental functions are rounded to fixed decimals so that the
SQL oracle (which lacks ``expm1``/``log1p``) can be compared exactly.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.functions import fmt
from frostline.functions.columns import request_error, resolve_as_of, ts_literal, window_start
from frostline.operators import anchored as A
from frostline.operators import intervals as I
from frostline.operators import series as S
from frostline.operators import state as C
from frostline.operators import thermal as E
from frostline.operators import vector as V
from frostline.operators.cells import equi_depth
from frostline.plans import queries as Q
from frostline.schema import DASHBOARD_KEYS, STATE_KEYS, TS
from frostline.sources.events import readings_from_events

DEV = ("device_id",)


def _r(spark: SparkSession, sf: str) -> DataFrame:
    return readings_from_events(spark, sf)


def q_runtime_hours(spark, sf):
    return I.runtime_hours(_r(spark, sf))


def q_runtime_hours_by_device(spark, sf):
    return I.runtime_hours(_r(spark, sf), keys=DEV)


def _equi_depth_stats(spark, sf, keys):
    """W1-W3 over equi-depth cells: about 100,000 cells, of 64 to a million rows."""
    r = _r(spark, sf)
    rows = r.agg(F.count(F.lit(1))).first()[0]
    cells = equi_depth(r, keys=keys, max_rows=min(1_000_000, max(64, rows // 100_000)))
    return I.history_stats(r, keys=keys, bucket_us=cells).drop("first_ts")


def q_equi_depth_stats(spark, sf):
    return _equi_depth_stats(spark, sf, ())


def q_equi_depth_stats_by_device(spark, sf):
    return _equi_depth_stats(spark, sf, DEV)


def q_cold_hours_total(spark, sf):
    return I.hours_below_total(_r(spark, sf))


def q_cold_streak(spark, sf):
    return I.cold_streak(_r(spark, sf))


def q_cold_streak_by_device(spark, sf):
    return I.cold_streak(_r(spark, sf), keys=DEV)


def q_pump_starts_24h(spark, sf):
    return I.pump_starts(_r(spark, sf))


def q_pump_starts_24h_by_device(spark, sf):
    return I.pump_starts(_r(spark, sf), keys=DEV)


def q_minmax_24h(spark, sf):
    return I.window_minmax(_r(spark, sf))


def q_minmax_24h_by_device(spark, sf):
    return I.window_minmax(_r(spark, sf), keys=DEV)


def q_latest_reading(spark, sf):
    from frostline.schema import METRICS_LATEST_COLUMNS
    return I.latest_row(_r(spark, sf), columns=METRICS_LATEST_COLUMNS)


def q_latest_per_device(spark, sf):
    from frostline.schema import METRICS_LATEST_COLUMNS
    return I.latest_row(_r(spark, sf), keys=DEV, columns=METRICS_LATEST_COLUMNS)


def q_latest_overlay(spark, sf):
    r = _r(spark, sf).drop("event_id", "device_id")
    return Q.latest(r)


def q_metrics_snapshot(spark, sf):
    return Q.metrics(_r(spark, sf))


def q_metrics_by_device(spark, sf):
    return Q.metrics(_r(spark, sf), keys=DEV)


def q_health(spark, sf):
    return Q.health(_r(spark, sf))


def q_history_mxc(spark, sf):
    return S.history(_r(spark, sf), "T_MXC", hours=24)


def q_history_sampled(spark, sf):
    return S.history(_r(spark, sf), "T_MXC", hours=720, max_points=100)


def q_dashboard_series(spark, sf):
    return S.dashboard_series(_r(spark, sf), hours=168, max_points=100)


def q_history_payload(spark, sf):
    """History as API text (ISO time, value text), coerced back (P8) and sampled for a plot (R3, m=1200)."""
    from frostline.functions.columns import iso_text
    h = S.history(_r(spark, sf), "T_MXC", hours=720)
    text = h.select(iso_text(TS).alias("ts_text"), F.col("value").cast("string").alias("value_text"))
    pts = S.coerce_points(text, ts_col="ts_text", value_col="value_text")
    return S.downsample(pts, 1200)


def _series(spark, sf, keys=(), series_keys=tuple(DASHBOARD_KEYS)):
    return S.to_series(_r(spark, sf), keys=keys, series_keys=series_keys)


def q_duty_cycle(spark, sf):
    return S.duty_cycle(_series(spark, sf, series_keys=STATE_KEYS))


def q_series_starts(spark, sf):
    return A.column_starts(_r(spark, sf))


def q_series_starts_by_device(spark, sf):
    return A.column_starts(_r(spark, sf), keys=DEV)


def q_hours_below(spark, sf):
    return S.time_below(_series(spark, sf, series_keys=["T_MXC"]), threshold=0.02)


def q_hours_below_by_device(spark, sf):
    return S.time_below(_series(spark, sf, keys=DEV, series_keys=["T_MXC"]), threshold=0.02, keys=DEV)


def q_mxc_slope(spark, sf):
    return A.column_slope(_r(spark, sf))


def q_mxc_slope_by_device(spark, sf):
    return A.column_slope(_r(spark, sf), keys=DEV)


def q_last_valid_point(spark, sf):
    return V.last_valid(_r(spark, sf))


def q_labeled_last_values(spark, sf):
    """W8 per series labelled through the channel dimension (F13); the dimension
    has a fixed 19 rows, so broadcasting it is size-bounded by construction."""
    from frostline.schema import channels_dimension
    lv = V.last_valid(_r(spark, sf))
    return lv.join(F.broadcast(channels_dimension(spark)), "key", "left") \
        .select("key", "label", "grp", "unit", "value", TS)


def q_freshest_values(spark, sf):
    return V.freshest_columns(_r(spark, sf), hours=24)


def _latest_before(r, keys, hours):
    a = resolve_as_of(r)
    return I.latest_row(r.filter(F.col(TS) < window_start(a, hours)), keys=keys, columns=[TS, *DASHBOARD_KEYS])


def q_overlay_records(spark, sf):
    r = _r(spark, sf)
    primary = I.latest_row(r, keys=DEV, columns=[TS, *DASHBOARD_KEYS])
    fallback = _latest_before(r, DEV, 24)
    return S.overlay_records(primary, fallback, keys=DEV)


def q_overlay_series(spark, sf):
    r = _r(spark, sf)
    a = resolve_as_of(r)
    s = S.to_series(r, keys=DEV)
    return S.overlay_series(S.window_series(s, hours=24, as_of=a), S.window_series(s, hours=72, as_of=a),
                            keys=DEV)


def q_stage_minutes(spark, sf):
    return E.stage_minutes_of(_r(spark, sf))


def q_em_history(spark, sf):
    h = E.em_history_of(_r(spark, sf))
    return h.select("key", TS, F.round("value", 6).alias("value"))


def _em_latest(spark, sf, keys):
    out = E.em_now(_r(spark, sf), keys=keys)
    return out.select(*[F.round(c, 6).alias(c) if c.startswith("teff_") else F.col(c) for c in out.columns])


def q_em_latest(spark, sf):
    return _em_latest(spark, sf, ())


def q_fridge_state(spark, sf):
    return C.current_state(_r(spark, sf), hours=24).select("label", "detail", "tone")


def q_fridge_state_by_device(spark, sf):
    return C.current_state(_r(spark, sf), hours=72, keys=DEV).select("device_id", "label", "detail", "tone")


def q_state_hours(spark, sf):
    return C.state_hours(_r(spark, sf))


def q_ops_summary(spark, sf):
    return Q.ops_summary(_r(spark, sf), hours=24)


def q_cold_summary(spark, sf):
    return Q.cold_summary(_r(spark, sf), hours=24)


def q_snapshot(spark, sf):
    return Q.snapshot(_r(spark, sf), hours=24)


def q_snapshot_by_device(spark, sf):
    return Q.snapshot(_r(spark, sf), hours=24, keys=DEV)


def q_formatted_metrics(spark, sf):
    m = Q.metrics(_r(spark, sf), keys=DEV)
    return m.select(
        "device_id",
        fmt.fmt_temp("T_MXC", True).alias("mxc"), fmt.fmt_temp("T_50K").alias("t50k"),
        fmt.fmt_pressure("P1").alias("p1"), fmt.fmt_flow("Flow").alias("flow"),
        fmt.fmt_hours("total_hours_pulse_tube").alias("pt_hours"),
        fmt.fmt_count("pulse_tube_starts_24h").alias("pt_starts"),
        fmt.fmt_state("pulse_tube").alias("pt_state"), fmt.fmt_em_temp("T_Still").alias("still_em"),
    )


def q_formatted_ops(spark, sf):
    """F7 percent and hours, F9 state and chip colour, per device and pump."""
    st = I.history_stats(_r(spark, sf), keys=DEV, pumps=STATE_KEYS, cold_column=None, latest_columns=STATE_KEYS,
                         window=(ts_literal("1970-01-01 00:00:00"), ts_literal("1970-01-01 00:00:00")))
    parts = F.array(*[F.struct(F.lit(p).alias("key"), fmt.fmt_state(p).alias("state"), fmt.chip_color(p).alias("chip"),
                               fmt.fmt_hours(f"total_hours_{p}").alias("hours"), fmt.fmt_percent(f"duty_{p}").alias("duty"),
                               fmt.fmt_count(f"{p}_starts").alias("starts")) for p in STATE_KEYS])
    return st.select("device_id", F.inline(parts))


def q_request_errors(spark, sf):
    """P2 over many requests (one per event): the refused ones with their error."""
    r = spark.read.parquet(f"{sf}/events.parquet")
    asked = r.select("event_id", (F.floor(F.col("value") * 100).cast("long") - 5).alias("hours"),
                     F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 11000).alias("max_points"))
    return asked.withColumn("error", request_error("hours", "max_points")).filter(F.col("error").isNotNull())


def q_dashboard(spark, sf):
    return Q.dashboard_points(_r(spark, sf), hours=168, max_points=100)


ROUNDTRIP_COLUMNS = ["P1", "P2", "P3", "P4", "P5", "P6", "T_50K", "T_4K", "T_Still", "T_MXC", "Flow",
                     "scroll_1", "scroll_2", "turbo_1", "pulse_tube"]


def q_ingest_roundtrip(spark, sf):
    """Render every event as raw log lines (one file per day and kind), ingest
    them with the incremental pass, and read the store back."""
    from frostline.session import scratch_path
    from frostline.sources.render import write_logs
    from frostline.sources.store import sync_once
    root = scratch_path(spark, "roundtrip")
    logs = write_logs(spark, _r(spark, sf), root)
    sync_once(spark, logs, f"{root}/store")
    return _store_rows(spark, f"{root}/store")


def _store_rows(spark, store):
    from frostline.sources.store import readings as store_readings
    return store_readings(spark, store).select(TS, *ROUNDTRIP_COLUMNS, F.regexp_extract("source_file", r"([^/]+)$", 1).alias("source_day"))


def q_ingest_second_pass(spark, sf):
    """A first pass over the logs of which every second day holds the
    morning only; then these days' logs are written anew, whole and in the less
    common forms (even payload, quoted and repeated keys, second name of the pulse
    tube, turbo in the status log), and a second pass replaces their rows."""
    from frostline.session import scratch_path
    from frostline.sources.render import write_logs
    from frostline.sources.store import sync_once
    root = scratch_path(spark, "second-pass")
    r = _r(spark, sf)
    grown = F.dayofmonth(TS) % 2 == 0
    logs = write_logs(spark, r.filter(~grown | (F.hour(TS) < 12)), root)
    sync_once(spark, logs, f"{root}/store")
    write_logs(spark, r.filter(grown), root, odd_forms=True)
    done = sync_once(spark, logs, f"{root}/store")
    return _store_rows(spark, f"{root}/store").withColumn("sources_rebuilt", F.lit(done["sources_changed"]).cast("long"))


def q_ingest_overlap(spark, sf):
    """A second source per day, ingested later, covers the hours from 6 to 12
    with other values; where both have a row the later source's whole row counts."""
    from frostline.session import scratch_path
    from frostline.sources.render import write_logs
    from frostline.sources.store import sync_once
    root = scratch_path(spark, "overlap")
    r = _r(spark, sf)
    logs = write_logs(spark, r, root)
    sync_once(spark, logs, f"{root}/store")
    again = r.filter((F.hour(TS) >= 6) & (F.hour(TS) < 12) & (F.col("event_id") % 2 == 0))
    write_logs(spark, again.withColumn("P1", F.col("P1") * 2.0).withColumn("T_MXC", F.lit(None).cast("double")), root, suffix="b")
    sync_once(spark, logs, f"{root}/store")
    return _store_rows(spark, f"{root}/store")


def q_store_metrics(spark, sf):
    """Q3 from the store's hour partials, after two passes (the second one refreshed
    the grown days alone)."""
    from frostline.session import scratch_path
    from frostline.sources.render import write_logs
    from frostline.sources.store import store_metrics, sync_once
    root = scratch_path(spark, "store-metrics")
    r = _r(spark, sf)
    last = F.dayofmonth(TS) >= 28
    logs = write_logs(spark, r.filter(~last | (F.hour(TS) < 12)), root)
    sync_once(spark, logs, f"{root}/store")
    write_logs(spark, r.filter(last), root)
    sync_once(spark, logs, f"{root}/store")
    return store_metrics(spark, f"{root}/store")


def q_changed_sources_grown(spark, sf):
    """S4, S5 with exact sizes: the channels logs of a first listing, of which every
    third day is missing and every other third holds the morning only, against a
    second listing of all; each folder is new, grown or the same."""
    from frostline.session import scratch_path
    from frostline.sources.logfiles import list_log_files, signature_changes, source_folders
    from frostline.sources.render import write_logs
    from frostline.session import written
    root = scratch_path(spark, "grown")
    r = _r(spark, sf)
    part = F.dayofmonth(TS) % 3
    logs = write_logs(spark, r.filter((part == 2) | ((part == 1) & (F.hour(TS) < 12))), root, kinds=("channels",))
    before = written(source_folders(list_log_files(spark, logs), logs), "listing")
    write_logs(spark, r.filter(part != 2), root, kinds=("channels",))
    out = signature_changes(source_folders(list_log_files(spark, logs), logs), before)
    return out.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source_day"), "status", "size_before", "size_bytes")


def q_changed_sources(spark, sf):
    """Render every event to raw logs, list them, sign each day folder and diff
    against an empty manifest (every folder is new)."""
    from frostline.session import scratch_path
    from frostline.sources.logfiles import changed_sources, list_log_files, source_folders
    from frostline.sources.render import write_logs
    logs = write_logs(spark, _r(spark, sf), scratch_path(spark, "changed"))
    src = changed_sources(source_folders(list_log_files(spark, logs), logs), None)
    return src.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source_day"), "n_files",
                      (F.col("size_bytes") > 0).alias("has_bytes"), (F.col("mtime_ns") > 0).alias("has_mtime"))


def q_path_check(spark, sf):
    """S7 over rendered logs: root exists, number of source folders, first five in path order."""
    from frostline.session import scratch_path
    from frostline.sources.logfiles import path_check
    from frostline.sources.render import write_logs
    logs = write_logs(spark, _r(spark, sf), scratch_path(spark, "pathcheck"))
    chk = path_check(spark, logs)
    days = F.transform("sample_sources", lambda p: F.regexp_extract(p, r"([^/]+)$", 1))
    return chk.select("logs_root_exists", "source_count", F.array_join(days, ", ").alias("sample_sources"))


def q_sync_summary(spark, sf):
    """Two incremental passes over the rendered logs; the second one's summary
    (nothing changed, so nothing is rebuilt: the pass is idempotent)."""
    from frostline.session import scratch_path
    from frostline.sources.render import write_logs
    from frostline.sources.store import sync_once
    root = scratch_path(spark, "sync")
    logs = write_logs(spark, _r(spark, sf), root)
    sync_once(spark, logs, f"{root}/store")
    s2 = sync_once(spark, logs, f"{root}/store")
    latest = dt.datetime.fromisoformat(s2["latest_ts_eastern"]) if s2["latest_ts_eastern"] else None
    row = (s2["status"], s2["sources_seen"], s2["sources_changed"], s2["sources_synced"], s2["tracked_sources"],
           s2["rows_total"], latest)
    return spark.createDataFrame([row], "status string, sources_seen long, sources_changed long, "
                                        "sources_synced long, tracked_sources long, rows_total long, "
                                        "latest_ts_eastern timestamp_ntz")


def q_em_latest_by_device(spark, sf):
    return _em_latest(spark, sf, DEV)


# The events arrive in slices of this many days; a third of a slice's rows comes one slice late.
STREAM_SLICE_DAYS = 10
# a row is never older than two slices: files of one slice may come in any order
STREAM_DELAY = f"{2 * STREAM_SLICE_DAYS} days"


def _arriving_stream(spark, sf):
    """The events table as files that arrive slice by slice, with late rows.

    Every slice is a job over the row groups of its days alone (a literal range,
    pushed to the scan), written with as many tasks as the scan has; a batch
    takes about the files of one slice."""
    from frostline.session import scratch_path
    from frostline.streaming import streams as T
    root = scratch_path(spark, "stream-in")
    ev = spark.read.parquet(f"{sf}/events.parquet")
    first, last = ev.agg(F.min("ts"), F.max("ts")).first()
    width = dt.timedelta(days=STREAM_SLICE_DAYS)
    late = F.pmod(F.hash("event_id"), F.lit(3)) == 0
    start = dt.datetime.combine(first.date(), dt.time()) if first else dt.datetime(2000, 1, 1)
    n = (last - start) // width + 1 if first else 0
    if not n:
        ev.write.parquet(root)
    for i in range(n + 1 if n else 0):
        at = start + i * width
        days = (F.col("ts") >= ts_literal(at - width)) & (F.col("ts") < ts_literal(at + width))
        own = F.col("ts") >= ts_literal(at)
        ev.filter(days & F.when(own, ~late).otherwise(late)).write.mode("append").parquet(root)
    files = len(spark.read.parquet(root).inputFiles())
    return T.events_stream(spark, root, max_files_per_trigger=-(-files // (n + 1)) or 1, files="part-*.parquet")


def _drain(spark, name, df, mode="update"):
    from frostline.session import scratch_path
    from frostline.streaming.streams import run_available_now
    root = scratch_path(spark, name)
    return run_available_now(df, f"{root}/out", f"{root}/checkpoint", mode=mode)


def q_stream_minutes(spark, sf):
    from frostline.streaming import streams as T
    out = _drain(spark, "stream-minutes", T.minute_last_values(_arriving_stream(spark, sf), delay=STREAM_DELAY))
    return T.minute_points(T.final_rows(out, [TS]))


def q_stream_counters(spark, sf):
    from frostline.streaming import streams as T
    out = _drain(spark, "stream-counters", T.runtime_counters(_arriving_stream(spark, sf), delay=STREAM_DELAY))
    return T.latest_counters(T.final_rows(out, ["device_id", "bucket"]))


def _stream_minmax(spark, sf, keys):
    from frostline.streaming import streams as T
    out = _drain(spark, "stream-minmax", T.hour_minmax(_arriving_stream(spark, sf), keys=keys, delay=STREAM_DELAY))
    return T.sliding_minmax(T.final_rows(out, [*keys, "hour"]), keys=keys)


def q_stream_minmax(spark, sf):
    return _stream_minmax(spark, sf, ())


def q_stream_minmax_by_device(spark, sf):
    return _stream_minmax(spark, sf, DEV)


def q_stream_hours_closed(spark, sf):
    """T4, streaming part, in append mode: every hour once, when the watermark has
    passed its end (the newest hours, inside the delay, are still open)."""
    from frostline.streaming import streams as T
    return _drain(spark, "stream-hours", T.hour_minmax(_arriving_stream(spark, sf), delay=STREAM_DELAY), mode="append")


QUERIES = {
    "runtime_hours": q_runtime_hours,
    "runtime_hours_by_device": q_runtime_hours_by_device,
    "equi_depth_stats": q_equi_depth_stats,
    "equi_depth_stats_by_device": q_equi_depth_stats_by_device,
    "cold_hours_total": q_cold_hours_total,
    "cold_streak": q_cold_streak,
    "cold_streak_by_device": q_cold_streak_by_device,
    "pump_starts_24h": q_pump_starts_24h,
    "pump_starts_24h_by_device": q_pump_starts_24h_by_device,
    "minmax_24h": q_minmax_24h,
    "minmax_24h_by_device": q_minmax_24h_by_device,
    "latest_reading": q_latest_reading,
    "latest_per_device": q_latest_per_device,
    "latest_overlay": q_latest_overlay,
    "metrics_snapshot": q_metrics_snapshot,
    "metrics_by_device": q_metrics_by_device,
    "health": q_health,
    "history_mxc": q_history_mxc,
    "history_sampled": q_history_sampled,
    "dashboard_series": q_dashboard_series,
    "history_payload": q_history_payload,
    "duty_cycle": q_duty_cycle,
    "series_starts": q_series_starts,
    "series_starts_by_device": q_series_starts_by_device,
    "hours_below": q_hours_below,
    "hours_below_by_device": q_hours_below_by_device,
    "mxc_slope": q_mxc_slope,
    "mxc_slope_by_device": q_mxc_slope_by_device,
    "last_valid_point": q_last_valid_point,
    "freshest_values": q_freshest_values,
    "labeled_last_values": q_labeled_last_values,
    "overlay_records": q_overlay_records,
    "overlay_series": q_overlay_series,
    "stage_minutes": q_stage_minutes,
    "em_history": q_em_history,
    "em_latest": q_em_latest,
    "em_latest_by_device": q_em_latest_by_device,
    "fridge_state": q_fridge_state,
    "fridge_state_by_device": q_fridge_state_by_device,
    "state_hours": q_state_hours,
    "ops_summary": q_ops_summary,
    "cold_summary": q_cold_summary,
    "snapshot": q_snapshot,
    "snapshot_by_device": q_snapshot_by_device,
    "dashboard": q_dashboard,
    "formatted_metrics": q_formatted_metrics,
    "formatted_ops": q_formatted_ops,
    "request_errors": q_request_errors,
    "ingest_roundtrip": q_ingest_roundtrip,
    "ingest_second_pass": q_ingest_second_pass,
    "ingest_overlap": q_ingest_overlap,
    "store_metrics": q_store_metrics,
    "changed_sources": q_changed_sources,
    "changed_sources_grown": q_changed_sources_grown,
    "path_check": q_path_check,
    "sync_summary": q_sync_summary,
    "stream_minutes": q_stream_minutes,
    "stream_counters": q_stream_counters,
    "stream_minmax": q_stream_minmax,
    "stream_minmax_by_device": q_stream_minmax_by_device,
    "stream_hours_closed": q_stream_hours_closed,
}
