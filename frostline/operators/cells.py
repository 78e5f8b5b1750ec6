"""Equi-depth time cells: borders from the data, so that no cell passes a row bound.

The bucketed operators sort the rows of one (keys, cell) in a task.  A fixed cell
width is too wide where a device logs densely and too narrow where it is idle.
Here the base width follows from the average density, and every cell with too
many rows is cut into finer ones, level by level (histograms of the dense cells
alone), down to a microsecond.  Results do not depend on the borders.

The lists of dense cells are written to the shared folder; a level has at most
rows / ``max_rows`` of them, and their number is checked before a broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.functions.columns import bucket_of, keys_list, micros
from frostline.schema import HOUR_US, MINUTE_US, TS
from frostline.session import written

# base widths, widest first; a dense cell is cut into cells of the next finer level
BASES = (30 * 24 * HOUR_US, 24 * HOUR_US, 6 * HOUR_US, HOUR_US)
LEVELS = (*BASES, MINUTE_US, 1_000_000, 1_000, 1)
BROADCAST_CELLS = 1_000_000


@dataclass(frozen=True)
class TimeCells:
    """Borders of one table for one key set: the base width and, level by level,
    the dense cells ``(_g, _b)`` that are cut further (with their number)."""
    keys: tuple
    widths: tuple
    dense: tuple = field(default=(), compare=False)

    def assign(self, df: DataFrame, us: str = "_us") -> DataFrame:
        """``df`` with ``_b``, the start of the row's cell in microseconds."""
        out = df.withColumn("_b", F.coalesce(bucket_of(us, self.widths[0]), F.lit(0).cast("long")))
        for width, (cells, n) in zip(self.widths[1:], self.dense, strict=True):
            out = self._mark(out, cells, n).withColumn(
                "_b", F.when(F.col("_dense"), F.coalesce(bucket_of(us, width), F.lit(0).cast("long"))).otherwise(F.col("_b"))).drop("_dense")
        return out

    def _mark(self, df: DataFrame, cells: DataFrame, n: int) -> DataFrame:
        marked = cells.select(F.col("_g").alias("_dg"), F.col("_b").alias("_db"), F.lit(True).alias("_dense"))
        if n <= BROADCAST_CELLS:
            marked = F.broadcast(marked)
        group = _group(self.keys)
        return df.join(marked, (group == F.col("_dg")) & (F.col("_b") == F.col("_db")), "left") \
            .withColumn("_dense", F.coalesce("_dense", F.lit(False))).drop("_dg", "_db")


def _group(keys) -> F.Column:
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("one"))


def equi_depth(readings: DataFrame, *, keys=(), max_rows: int = 1_000_000) -> TimeCells:
    """Cells of at most ``max_rows`` rows each (rows of one microsecond stay
    together).  One aggregate for the base width; then one per level, over the
    rows of the dense cells alone, until none is left."""
    k = keys_list(keys)
    rows = readings.select(*k, micros(TS).alias("_us"))
    hours, total = rows.groupBy(*k, bucket_of("_us", HOUR_US).alias("_h")).agg(F.count(F.lit(1)).alias("_n")) \
        .agg(F.count(F.lit(1)), F.sum("_n")).first()
    per_hour = (total or 0) / max(1, hours)
    base = next((w for w in BASES if per_hour * w / HOUR_US <= max_rows), BASES[-1])
    cells = TimeCells(tuple(k), (base,))
    for finer in [w for w in LEVELS if w < base]:
        counted = cells.assign(rows)
        if cells.dense:     # only what the last level cut can still be too dense
            last, n = cells.dense[-1]
            above = counted.withColumn("_fine", F.col("_b")).withColumn("_b", bucket_of("_us", cells.widths[-2]))
            counted = cells._mark(above, last, n).filter("_dense").withColumn("_b", F.col("_fine"))
        dense = written(counted.groupBy(_group(k).alias("_g"), "_b").agg(F.count(F.lit(1)).alias("_n"))
                        .filter(F.col("_n") > max_rows).select("_g", "_b"), "dense-cells")
        n = dense.count()
        if not n:
            break
        cells = TimeCells(cells.keys, (*cells.widths, finer), (*cells.dense, (dense, n)))
    return cells
