"""Render readings back to raw log text (test fixture for the ingest round trip).

Spark writes one text file per ``(day, log kind)``; the part files are then
renamed to the log naming scheme with the Hadoop FileSystem API (metadata
operations only, one per file), so this works on any shared file system.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.schema import TS

# File names per rendered kind (the day "yy-MM-dd" is appended).
FILE_NAMES = {
    "T_50K": "CH1 T", "T_4K": "CH2 T", "T_Still": "CH5 T", "T_MXC": "CH6 T", "Flow": "Flowmeter",
    "channels": "Channels", "maxigauge": "maxigauge", "status": "Status_",
}
# End of fixed values.


def _num(c) -> F.Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def render_lines(readings: DataFrame, *, kinds=None, odd_forms: bool = False) -> DataFrame:
    """``(day, kind, ts, line)``: one line per reading and kind with a value.

    ``odd_forms`` writes the same values in the less common forms of a log: an
    even payload with quoted and repeated keys, the pulse tube under its second
    name, and the turbo in the status log instead of the channels log.
    """
    d = F.date_format(TS, "dd-MM-yy")
    t = F.date_format(TS, "HH:mm:ss")
    head = F.concat_ws(",", d, t)
    parts = []

    def line(kind, text, when=None):
        one = F.struct(F.lit(kind).alias("kind"), text.alias("line"))
        if kinds is None or kind in kinds:
            parts.append(one if when is None else F.when(when, one))

    for c in ("T_50K", "T_4K", "T_Still", "T_MXC", "Flow"):
        line(c, F.concat_ws(",", head, _num(c)), F.col(c).isNotNull())
    if odd_forms:
        line("channels", F.concat_ws(
            ",", head, F.lit('"scroll1"'), F.lit("7"), F.lit(" Scroll1 "), _num("scroll_1"), F.lit("scroll2"), F.concat(F.lit('"'), _num("scroll_2"), F.lit('"')),
            F.lit("pulsetube"), F.lit("x"), F.lit("compressor"), _num("pulse_tube")))
        line("status", F.concat_ws(",", head, F.lit("tc400pumpstatn_2"), F.lit("0"), F.lit("tc400pumpstatn"), _num("turbo_1")))
    else:
        line("channels", F.concat_ws(
            ",", head, F.lit("0"), F.lit("turbo1"), _num("turbo_1"), F.lit("scroll1"), _num("scroll_1"),
            F.lit("scroll2"), _num("scroll_2"), F.lit("pulsetube"), _num("pulse_tube")))
    gauge = [F.concat_ws(",", F.lit(f"CH{i}"), F.lit(f"P{i}"), F.lit("1"), _num(f"P{i}"), F.lit("0"), F.lit("1"))
             for i in range(1, 7)]
    line("maxigauge", F.concat(F.concat_ws(",", head, *gauge), F.lit(",")))
    exploded = readings.select(TS, F.date_format(TS, "yy-MM-dd").alias("day"),
                               F.explode(F.filter(F.array(*parts), lambda s: s.isNotNull())).alias("r"))
    return exploded.select("day", F.col("r.kind").alias("kind"), TS, F.col("r.line").alias("line"))


def write_logs(spark: SparkSession, readings: DataFrame, out_root: str, *, suffix: str = "", kinds=None, odd_forms: bool = False) -> str:
    """Write ``<out_root>/logs/<yy-MM-dd><suffix>/<Name> <yy-MM-dd>.log`` files (a
    log that is already there is replaced); returns the logs root."""
    staging = f"{out_root.rstrip('/')}/staging-{uuid.uuid4().hex[:8]}"
    logs_root = f"{out_root.rstrip('/')}/logs"
    lines = render_lines(readings, kinds=kinds, odd_forms=odd_forms)
    # a log is one file per (day, kind) by format, so each such file is written by one task
    (lines.repartition("day", "kind").sortWithinPartitions("day", "kind", TS)
     .select("day", "kind", "line").write.partitionBy("day", "kind").text(staging))
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    Path = jvm.org.apache.hadoop.fs.Path
    fs = Path(staging).getFileSystem(conf)
    for day_st in fs.listStatus(Path(staging)):
        dname = day_st.getPath().getName()
        if not dname.startswith("day="):
            continue
        day = dname[4:]
        target_dir = Path(f"{logs_root}/{day}{suffix}")
        fs.mkdirs(target_dir)
        for kind_st in fs.listStatus(day_st.getPath()):
            kname = kind_st.getPath().getName()[5:]
            parts = [s.getPath() for s in fs.listStatus(kind_st.getPath()) if s.getPath().getName().startswith("part-")]
            for i, part in enumerate(sorted(parts, key=lambda p: p.getName())):
                name, more = FILE_NAMES[kname], "" if i == 0 else f" {i}"
                target = Path(target_dir, f"{name}{'' if name.endswith('_') else ' '}{day}{more}.log")
                fs.delete(target, False)
                fs.rename(part, target)
    return logs_root
