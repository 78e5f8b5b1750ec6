"""Session construction and shared scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


# local-mode fallback folders, per SparkContext, when the setting cannot be stored
_LOCAL_DIRS: dict[int, str] = {}


def get_session(master: str | None = None, app: str = "frostline",
                conf: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes.

    Time columns are TIMESTAMP_NTZ and durations are integer microseconds taken
    from the naive fields, so results do not depend on the session time zone;
    UTC is still the default so that casts done by users stay DST-free.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", (conf or {}).get("spark.sql.session.timeZone", "UTC"))
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting points to shared storage and is used as is.  Only
    when it is unset (local tests) a fresh private folder is created.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        conf_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        conf_dir = _LOCAL_DIRS.get(id(spark.sparkContext))
    if not conf_dir:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster "
                               "(scratch output and stream checkpoints are written below it)")
        conf_dir = tempfile.mkdtemp(prefix="frostline-ckpt-")
        _LOCAL_DIRS[id(spark.sparkContext)] = conf_dir
        try:
            spark.conf.set("spark.checkpoint.dir", conf_dir)
        except Exception:  # noqa: BLE001 - some sessions refuse core settings at runtime
            pass
    spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder below the shared checkpoint dir (never reused)."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/frostline/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new shared folder and read back: computed once, and
    kept when executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def jit_sized_methods(spark: SparkSession):
    """Inside, stages whose generated method is beyond what the JVM's compiler takes
    (8,000 bytes of bytecode) run as separate projections, which it does compile.
    For row-wise work with very many expressions, which would else be interpreted."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def local_path(path: str) -> str | None:
    """Filesystem path for ``file:`` / plain paths, else None."""
    if path.startswith("file:"):
        return path[len("file:"):].replace("///", "/")
    if "://" in path:
        return None
    return os.path.abspath(path)
