"""Log-file discovery, source signatures and change detection.

The listing is file-system metadata (no file bytes are read), taken by tasks;
everything after it is DataFrame work.  Only the list of changed source folders is
collected (it is the input path list of the next read).
"""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.functions.columns import strip

# File-name prefixes (lower-cased stem) of the known logs.
SIMPLE_PREFIXES = {"ch1 t": "T_50K", "ch2 t": "T_4K", "ch5 t": "T_Still", "ch6 t": "T_MXC", "flowmeter": "Flow"}
CHANNELS_PREFIX = "channels "
MAXIGAUGE_PREFIX = "maxigauge "
STATUS_PREFIX = "status_"
UNPARSED_PREFIXES = ["heaters ", "ch1 r", "ch2 r", "ch5 r", "ch6 r"]
# End of fixed values.

KNOWN_PREFIXES = [*SIMPLE_PREFIXES, CHANNELS_PREFIX, MAXIGAUGE_PREFIX, STATUS_PREFIX, *UNPARSED_PREFIXES]


def stem_lower(name: Column) -> Column:
    """lower-cased, trimmed file stem (name without its last suffix)."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.lower(strip(stem))


def is_known_log(name: Column) -> Column:
    """The stem starts with one of the known prefixes."""
    s = stem_lower(name)
    return F.greatest(*[s.startswith(p) for p in KNOWN_PREFIXES])


def log_kind(name: Column) -> Column:
    """Parser kind of a file: a target column for single-value logs, or
    ``channels`` / ``maxigauge`` / ``status``; NULL for known-but-unparsed logs."""
    return stem_kind(stem_lower(name))


def stem_kind(s: Column) -> Column:
    """:func:`log_kind` of a file's :func:`stem_lower`; per line, give it a column
    of its own, or it is worked out anew for every prefix."""
    expr = None
    for prefix, col in SIMPLE_PREFIXES.items():
        expr = F.when(s.startswith(prefix), F.lit(col)) if expr is None else expr.when(s.startswith(prefix), F.lit(col))
    return (expr.when(s.startswith(CHANNELS_PREFIX), F.lit("channels"))
            .when(s.startswith(MAXIGAUGE_PREFIX), F.lit("maxigauge"))
            .when(s.startswith(STATUS_PREFIX), F.lit("status")))


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def qualify(spark: SparkSession, path: str) -> str:
    """Fully qualified path string, as the file readers report it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return str(fs.makeQualified(p).toString()).rstrip("/")


_LISTED = "parent string, name string, is_dir boolean, size_bytes bigint, mtime_ns bigint"


def _folder_lister():
    """The listing as a function that workers run without this package."""
    import pyarrow as pa
    from pyarrow import fs as pafs
    schema = pa.schema([("parent", pa.string()), ("name", pa.string()), ("is_dir", pa.bool_()), ("size_bytes", pa.int64()), ("mtime_ns", pa.int64())])

    def run(batches):
        for b in batches:
            for folder in b.column(0).to_pylist():
                fs, local = pafs.FileSystem.from_uri(folder)
                infos = [i for i in fs.get_file_info(pafs.FileSelector(local))
                         if i.type == pafs.FileType.Directory or i.base_name.endswith(".log")]
                yield pa.RecordBatch.from_pydict({
                    "parent": [folder] * len(infos), "name": [i.base_name for i in infos], "is_dir": [i.type == pafs.FileType.Directory for i in infos],
                    "size_bytes": [i.size or 0 for i in infos], "mtime_ns": [i.mtime_ns or 0 for i in infos]}, schema=schema)

    return run


def list_log_files(spark: SparkSession, root: str) -> DataFrame:
    """S2 over the root and its child folders: ``(path, name, parent, depth, size_bytes, mtime_ns, known)``.

    Folders are listed by tasks, spread over the cluster; the driver makes no call
    per folder or file.  Files of no length count too (Spark's own file index
    leaves them out): a log rewritten to empty must still change its folder's
    signature.  ``depth`` is 0 for files directly in ``root`` and 1 for day
    folders; the layout is one level deep.  A file system that only Spark's
    readers know is listed by Spark's file index, without the empty logs.
    """
    schema = "parent string, name string, size_bytes bigint, mtime_ns bigint, depth int, path string, known boolean"
    if not path_exists(spark, root):
        return spark.createDataFrame([], schema)
    top = qualify(spark, root)
    try:
        pafs.FileSystem.from_uri(top)
    except (pa.ArrowInvalid, OSError):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.log").load(root)
        parent = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
        files = files.select(parent.alias("parent"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size_bytes"),
                             (F.unix_millis("modificationTime") * F.lit(1_000_000)).alias("mtime_ns"),
                             F.when(parent == top, 0).when(F.regexp_extract(parent, r"^(.*)/[^/]+$", 1) == top, 1).alias("depth"))
    else:
        list_folders = _folder_lister()
        at_top = spark.createDataFrame([(top,)], "path string").mapInArrow(list_folders, _LISTED)
        folders = at_top.filter("is_dir").select(F.concat_ws("/", "parent", "name")).repartition(spark.sparkContext.defaultParallelism)
        files = at_top.withColumn("depth", F.lit(0)).unionByName(folders.mapInArrow(list_folders, _LISTED).withColumn("depth", F.lit(1))) \
            .filter("NOT is_dir").drop("is_dir")
    return files.filter(F.col("depth").isNotNull()).withColumn("path", F.concat_ws("/", "parent", "name")).withColumn("known", is_known_log(F.col("name")))


def source_folders(files: DataFrame, root: str) -> DataFrame:
    """S3 + S4: source folders with their signature ``(path, size_bytes, mtime_ns, n_files)``.

    If the root itself holds known logs it is the only source; otherwise each
    child folder holding a known log is one.  The root test is a scalar
    subquery over the listing, so nothing is collected.
    """
    known = files.filter("known")
    root_has = known.filter(F.col("depth") == 0).select(F.count(F.lit(1))).scalar()
    chosen = known.filter(F.when(root_has > 0, F.col("depth") == 0).otherwise(F.col("depth") == 1))
    return chosen.groupBy(F.col("parent").alias("path")).agg(
        F.sum("size_bytes").alias("size_bytes"),
        F.max("mtime_ns").alias("mtime_ns"),
        F.count(F.lit(1)).alias("n_files"))


def current_manifest(manifest: DataFrame) -> DataFrame:
    """Latest manifest row per path (S11 read side)."""
    return manifest.groupBy("path").agg(
        *[F.max_by(c, F.struct("ingested_at", "batch_id")).alias(c)
          for c in ("size_bytes", "mtime_ns", "ingested_at", "batch_id")])


def changed_sources(sources: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """Sources that are new or whose size or mtime differ from the manifest."""
    if manifest is None:
        return sources
    cur = current_manifest(manifest).select("path", F.col("size_bytes").alias("_ms"),
                                            F.col("mtime_ns").alias("_mm"))
    j = sources.join(cur, "path", "left")
    same = F.col("size_bytes").eqNullSafe(F.col("_ms")) & F.col("mtime_ns").eqNullSafe(F.col("_mm"))
    return j.filter(~same).drop("_ms", "_mm")


def signature_changes(sources: DataFrame, before: DataFrame) -> DataFrame:
    """S5 with its reason: ``(path, status, size_before, size_bytes)`` of every source,
    ``new``, ``grown``, ``shrunk``, ``rewritten`` (same size, other time) or ``same``
    against an earlier listing or the current manifest."""
    old = before.select("path", F.col("size_bytes").alias("size_before"), F.col("mtime_ns").alias("_mtime"), F.lit(True).alias("_known"))
    j = sources.select("path", "size_bytes", "mtime_ns").join(old, "path", "left")
    status = (F.when(F.col("_known").isNull(), "new").when(F.col("size_bytes") > F.col("size_before"), "grown")
              .when(F.col("size_bytes") < F.col("size_before"), "shrunk").when(F.col("mtime_ns") != F.col("_mtime"), "rewritten").otherwise("same"))
    return j.select("path", status.alias("status"), "size_before", "size_bytes")


def path_check(spark: SparkSession, root: str, sample: int = 5) -> DataFrame:
    """Root exists, number of sources, first sources in path order."""
    exists = path_exists(spark, root)
    if not exists:
        return spark.createDataFrame([(False, root, 0, [])],
                                     "logs_root_exists boolean, logs_root string, source_count bigint, "
                                     "sample_sources array<string>")
    src = source_folders(list_log_files(spark, root), root)
    # distributed top-k (TakeOrderedAndProject): only `sample` rows leave the tasks
    firsts = src.select("path").orderBy("path").limit(sample)
    cnt = src.select(F.count(F.lit(1))).scalar()
    return firsts.agg(F.lit(True).alias("logs_root_exists"), F.lit(root).alias("logs_root"),
                      cnt.alias("source_count"), F.array_sort(F.collect_list("path")).alias("sample_sources"))
