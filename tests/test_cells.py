"""Equi-depth cells: no cell passes the bound, and the results do not depend on the borders."""

import datetime as dt

import pytest
from helpers import SF01
from pyspark.sql import functions as F

from frostline.functions.columns import micros
from frostline.operators import intervals as I
from frostline.operators.cells import TimeCells, equi_depth
from frostline.schema import HOUR_US, TS
from frostline.sources.events import readings_from_events


def _dense(spark):
    """Device 1 has most rows in one hour, most of these in one second; 2 is sparse; one device is null."""
    t0 = dt.datetime(2024, 1, 1, 5)
    rows = [(1, t0 + dt.timedelta(microseconds=i), float(i % 3 == 0), 0.01 if i % 5 else 0.03) for i in range(400)]
    rows += [(1, t0 + dt.timedelta(seconds=7 * i + 2), 1.0, None) for i in range(300)]
    rows += [(1, t0 + dt.timedelta(hours=9 * i + 1), 0.0, 0.01) for i in range(20)]
    rows += [(d, t0 + dt.timedelta(hours=5 * i), 1.0, 0.01) for d in (2, None) for i in range(30)]
    return spark.createDataFrame(rows, "device_id int, ts_eastern timestamp_ntz, pulse_tube double, T_MXC double").repartition(5)


@pytest.mark.parametrize("bound", [5, 50, 100_000])
def test_no_cell_passes_the_bound(spark, bound):
    df = _dense(spark)
    cells = equi_depth(df, keys=["device_id"], max_rows=bound)
    got = cells.assign(df.withColumn("_us", micros(TS))).groupBy("device_id", "_b").agg(F.count("*").alias("n"), F.min("_us").alias("a"), F.max("_us").alias("z")).collect()
    assert sum(r.n for r in got) == df.count() and max(r.n for r in got) <= bound
    assert all(r._b <= r.a for r in got)
    # cells of a device do not overlap in time
    for d in (1, 2, None):
        mine = sorted((r._b, r.a, r.z) for r in got if r.device_id == d)
        assert all(x[2] < y[1] for x, y in zip(mine, mine[1:]))
    if bound == 5:      # down to microseconds in the dense hour, still wide where the device is idle
        assert cells.widths[-1] == 1 and cells.widths[0] >= HOUR_US


@pytest.mark.parametrize("bound", [5, 50])
def test_results_do_not_depend_on_the_borders(spark, bound):
    df = _dense(spark)
    cells = equi_depth(df, keys=["device_id"], max_rows=bound)
    for f in (lambda b: I.history_stats(df, keys=["device_id"], pumps=["pulse_tube"], bucket_us=b),
              lambda b: I.window_stats(df, keys=["device_id"], hours=100, pumps=["pulse_tube"], minmax=["T_MXC"], bucket_us=b)):
        assert sorted(map(str, f(cells).collect())) == sorted(map(str, f(10**15).collect()))


def test_cells_of_other_keys_are_refused_and_empty_tables_have_none(spark):
    r = readings_from_events(spark, SF01)
    cells = equi_depth(r, keys=(), max_rows=8)
    assert isinstance(cells, TimeCells) and cells.dense
    with pytest.raises(ValueError):
        I.runtime_hours(r, keys=["device_id"], bucket_us=cells)
    none = equi_depth(r.filter("false"), max_rows=8)
    assert none.dense == () and I.runtime_hours(r.filter("false"), bucket_us=none).count() == 1
