"""Table schemas, key groups and constants of the telemetry data model."""

from __future__ import annotations

from pyspark.sql import types as T

TS = "ts_eastern"
DEVICE = "device_id"

# ---------------------------------------------------------------------------
# They must equal the source system's for identical results.
# Column order of the wide readings table.
READING_COLUMNS = [
    "ts_eastern",
    "P1", "P2", "P3", "P4", "P5", "P6",
    "T_50K", "T_4K", "T_Still", "T_MXC",
    "Flow",
    "total_hours_scroll_1", "total_hours_scroll_2",
    "total_hours_turbo_1", "total_hours_pulse_tube",
    "scroll_1", "scroll_2", "turbo_1", "pulse_tube",
    "source_file",
]
TEMPERATURE_KEYS = ["T_50K", "T_4K", "T_Still", "T_MXC"]
PRESSURE_KEYS = ["P1", "P2", "P3", "P4", "P5", "P6"]
FLOW_KEYS = ["Flow"]
STATE_KEYS = ["pulse_tube", "turbo_1", "scroll_1", "scroll_2"]
# Keys served as series by the dashboard, in this order.
DASHBOARD_KEYS = [
    "T_50K", "T_4K", "T_Still", "T_MXC",
    "P1", "P2", "P3", "P4", "P5", "P6",
    "Flow",
    "pulse_tube", "turbo_1", "scroll_1", "scroll_2",
]
# Pumps in the order of the runtime counters.
RUNTIME_PUMPS = ["scroll_1", "scroll_2", "turbo_1", "pulse_tube"]
# Keys accepted by the single-series history query: the table's value columns, temperatures first.
ALLOWED_HISTORY_KEYS = [*TEMPERATURE_KEYS, *PRESSURE_KEYS, *READING_COLUMNS[READING_COLUMNS.index("Flow"):-1]]
# Columns of the latest-row part of the metrics record, in its order (not the store's).
METRICS_LATEST_COLUMNS = [TS, *ALLOWED_HISTORY_KEYS]
MINMAX_24H_COLUMNS = ["T_Still", "T_MXC", "P1", "Flow"]
# Human labels and units per key (channel dimension).
PRETTY_NAMES = {
    "T_50K": "50 K Stage",
    "T_4K": "4 K Stage",
    "T_Still": "Still",
    "T_MXC": "Mixing Chamber",
    "P1": "Pressure P1",
    "P2": "Pressure P2",
    "P3": "Pressure P3",
    "P4": "Pressure P4",
    "P5": "Pressure P5",
    "P6": "Pressure P6",
    "Flow": "Flow",
    "pulse_tube": "Pulse Tube",
    "turbo_1": "Turbo",
    "scroll_1": "Scroll 1",
    "scroll_2": "Scroll 2",
    "total_hours_pulse_tube": "Pulse Tube Hours",
    "total_hours_turbo_1": "Turbo Hours",
    "total_hours_scroll_1": "Scroll 1 Hours",
    "total_hours_scroll_2": "Scroll 2 Hours",
}
PRESSURE_UNIT = "mbar"
# Thresholds.
ON_THRESHOLD = 0.5
COLD_THRESHOLD_K = 0.02
# Argument ranges of the read API.
MIN_HOURS, MAX_HOURS = 1, 24 * 365
MIN_POINTS, MAX_POINTS = 100, 10000
DEFAULT_DASHBOARD_POINTS = 1200
# End of fixed values.
# ---------------------------------------------------------------------------

HOUR_US = 3_600_000_000
MINUTE_US = 60_000_000
DEFAULT_BUCKET_US = HOUR_US


def readings_schema(with_device: bool = False) -> T.StructType:
    fields = [T.StructField(TS, T.TimestampNTZType(), False)]
    for c in READING_COLUMNS[1:-1]:
        fields.append(T.StructField(c, T.DoubleType(), True))
    fields.append(T.StructField("source_file", T.StringType(), True))
    if with_device:
        fields.insert(0, T.StructField(DEVICE, T.StringType(), True))
    return T.StructType(fields)


MANIFEST_SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("size_bytes", T.LongType(), True),
    T.StructField("mtime_ns", T.LongType(), True),
    T.StructField("ingested_at", T.TimestampType(), True),
    T.StructField("batch_id", T.StringType(), True),
])

SERIES_SCHEMA = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField(TS, T.TimestampNTZType(), True),
    T.StructField("value", T.DoubleType(), True),
])


def channels_dimension(spark):
    """Small dimension table ``(key, label, grp, unit)`` for labelling series."""
    groups = ([(k, "temperature", "K") for k in TEMPERATURE_KEYS]
              + [(k, "pressure", PRESSURE_UNIT) for k in PRESSURE_KEYS]
              + [(k, "flow", None) for k in FLOW_KEYS]
              + [(k, "state", None) for k in STATE_KEYS]
              + [(f"total_hours_{k}", "runtime", "h") for k in RUNTIME_PUMPS])
    rows = [(k, PRETTY_NAMES.get(k, k), g, u) for k, g, u in groups]
    return spark.createDataFrame(rows, "key string, label string, grp string, unit string")
