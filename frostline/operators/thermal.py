"""Effective-noise-temperature operators over stage temperatures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.functions.columns import floor_minute, keys_list
from frostline.functions.thermal import (
    EM_DEFAULT_FREQ_GHZ, EM_ROOM_TEMP_DEFAULT_K, EM_STAGE_KEYS, em_chain_columns,
)
from frostline.operators.series import freshest_values, pivot_series
from frostline.operators.vector import freshest, state_vector
from frostline.schema import PRETTY_NAMES, TS


def em_chain(df: DataFrame, *, attens_db: dict | None = None, freq_ghz: float = EM_DEFAULT_FREQ_GHZ,
             room_k: float = EM_ROOM_TEMP_DEFAULT_K, stages=tuple(EM_STAGE_KEYS),
             with_occupation: bool = False) -> DataFrame:
    """E1 on every row of a frame holding the stage temperature columns.

    Adds ``teff_<stage>`` (and ``n_<stage>`` when asked); pure projection.
    """
    n_map, t_map = em_chain_columns({s: F.col(s) for s in stages}, attens_db, freq_ghz, room_k, stages)
    extra = [t_map[s].alias(f"teff_{s}") for s in stages]
    if with_occupation:
        extra += [n_map[s].alias(f"n_{s}") for s in stages]
    return df.select("*", *extra)


def stage_minutes(series: DataFrame, *, keys=(), stages=tuple(EM_STAGE_KEYS)) -> DataFrame:
    """Per minute, the last point of each stage (NULL value kept), outer-merged.

    A conditional ``max_by`` per stage replaces the outer joins: one shuffle on
    ``(keys, minute)``.
    """
    k = keys_list(keys)
    s = series.filter(F.col("key").isin(list(stages))).select(*k, "key", TS, "value",
                                                              floor_minute(TS).alias("_min"))
    aggs = [F.max_by("value", F.when(F.col("key") == st, F.col(TS))).alias(st) for st in stages]
    return s.groupBy(*k, "_min").agg(*aggs).withColumnRenamed("_min", TS).select(*k, TS, *stages)


def stage_minutes_of(readings: DataFrame, *, keys=(), stages=tuple(EM_STAGE_KEYS)) -> DataFrame:
    """E4 straight from wide readings: per minute the last point of each stage (a
    NULL is no point); a minute without a point of any stage has no row."""
    k = keys_list(keys)
    minute = floor_minute(TS)
    some = F.coalesce(*[F.col(s).cast("double") for s in stages]).isNotNull()
    aggs = [F.max_by(F.col(s).cast("double"), F.when(F.col(s).isNotNull(), F.col(TS))).alias(s) for s in stages]
    return readings.filter(some).groupBy(*k, minute.alias("_min")).agg(*aggs).withColumnRenamed("_min", TS).select(*k, TS, *stages)


def em_history_of(readings: DataFrame, *, keys=(), attens_db: dict | None = None, freq_ghz: float = EM_DEFAULT_FREQ_GHZ,
                  room_k: float = EM_ROOM_TEMP_DEFAULT_K, stages=tuple(EM_STAGE_KEYS)) -> DataFrame:
    """E3 straight from wide readings."""
    return _em_points(stage_minutes_of(readings, keys=keys, stages=stages), keys_list(keys), attens_db, freq_ghz, room_k, stages)


def em_history(series: DataFrame, *, keys=(), attens_db: dict | None = None,
               freq_ghz: float = EM_DEFAULT_FREQ_GHZ, room_k: float = EM_ROOM_TEMP_DEFAULT_K,
               stages=tuple(EM_STAGE_KEYS)) -> DataFrame:
    """E4 -> E1 per minute -> long ``(keys, key, ts_eastern, value)`` per stage."""
    k = keys_list(keys)
    return _em_points(stage_minutes(series, keys=k, stages=stages), k, attens_db, freq_ghz, room_k, stages)


def _em_points(minutes: DataFrame, k: list[str], attens_db, freq_ghz, room_k, stages) -> DataFrame:
    wide = em_chain(minutes, attens_db=attens_db, freq_ghz=freq_ghz, room_k=room_k, stages=stages)
    cols = [f"teff_{s}" for s in stages]
    long = wide.select(*k, TS, *cols).unpivot([*k, TS], cols, "key", "value")
    return long.select(*k, F.substring("key", 6, 100).alias("key"), TS, "value")


def em_latest(snapshot: DataFrame, series: DataFrame, *, keys=(), attens_db: dict | None = None,
              freq_ghz: float = EM_DEFAULT_FREQ_GHZ, room_k: float = EM_ROOM_TEMP_DEFAULT_K,
              stages=tuple(EM_STAGE_KEYS)) -> DataFrame:
    """E1 on the freshest stage temperatures.

    ``missing_stages`` lists the labels of stages without a value; the chain is
    only evaluated (``teff_*`` non-NULL) when none is missing.
    """
    k = keys_list(keys)
    fresh = pivot_series(freshest_values(snapshot, series, keys=k, series_keys=stages),
                         keys=k, series_keys=stages)
    return _chain_if_complete(fresh, k, attens_db, freq_ghz, room_k, stages)


def em_now(readings: DataFrame, *, keys=(), attens_db: dict | None = None, freq_ghz: float = EM_DEFAULT_FREQ_GHZ,
           room_k: float = EM_ROOM_TEMP_DEFAULT_K, stages=tuple(EM_STAGE_KEYS)) -> DataFrame:
    """E2 straight from wide readings: :func:`em_latest` of the latest row and the
    whole history, in one scan of the stage columns and one aggregate."""
    k = keys_list(keys)
    v = state_vector(readings, start=None, keys=k, columns=stages)
    return _chain_if_complete(v.select(*k, *[freshest(s).alias(s) for s in stages]), k, attens_db, freq_ghz, room_k, stages)


def _chain_if_complete(fresh: DataFrame, k: list[str], attens_db, freq_ghz, room_k, stages) -> DataFrame:
    chained = em_chain(fresh, attens_db=attens_db, freq_ghz=freq_ghz, room_k=room_k, stages=stages)
    miss = F.concat_ws(", ", *[F.when(F.col(s).isNull(), F.lit(PRETTY_NAMES[s])) for s in stages])
    complete = F.greatest(*[F.col(s).isNull().cast("int") for s in stages]) == 0
    return chained.select(*k, *stages, F.when(miss == "", None).otherwise(miss).alias("missing_stages"),
                          *[F.when(complete, F.col(f"teff_{s}")).alias(f"teff_{s}") for s in stages])
