"""Integer vectors and the join of rows with their group: shared by whitening
and code compression.

A vector takes part if it is not null and none of its entries is null, NaN or
infinite.  Its entries become ``floor(scale * entry)``, as long; beyond
``LARGEST`` units they stay there (so that sums over a table fit a long).
Shorter vectors are filled up with zeros to the longest one of the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import materialize

LARGEST = 2**31 - 1
# a group with more than one in HOT_SHARE of all rows is hot; by counting there are fewer than HOT_SHARE of them
HOT_SHARE = 1000


def integer_vectors(table: DataFrame, vec: str, scale: float, carried: dict, multiple: int = 1) -> tuple[DataFrame, int]:
    """Rows ``(carried..., x array<long>)``, written to the shared folder, and
    the common length of x (a multiple of ``multiple``; 0: no row or only empty
    vectors).  ``carried`` maps output names to columns of ``table``."""
    entries = F.transform(F.col(vec), lambda c: c.cast("double"))
    whole = F.coalesce(F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))), F.lit(False))
    unit = F.lit(float(scale))
    x = F.transform(F.col("__v"), lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(unit * c))).cast("long"))
    rows = table.filter(whole).select(*[c.alias(n) for n, c in carried.items()], entries.alias("__v")).withColumn("x", x).drop("__v")
    rows = materialize(rows, "vectors")
    longest, shortest = rows.agg(F.max(F.size("x")), F.min(F.size("x"))).first()
    size = -(-(longest or 0) // multiple) * multiple
    if size and shortest < size:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("x"))))
    return rows, size


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """An Arrow list column whose lists all have ``size`` entries, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, members: str) -> DataFrame:
    """Each row with its group's columns (``members``: rows of the group; nulls
    are a group).  Hot groups, fewer than ``HOT_SHARE`` by counting, are
    broadcast; the others meet their rows in a shuffle in which no key holds
    more than one in ``HOT_SHARE`` of the rows."""
    total = groups.agg(F.sum(members)).first()[0] or 0
    named = groups.withColumnRenamed(key, "__key")
    hot = F.col(members) * F.lit(HOT_SHARE) > F.lit(total)
    same = F.col(key).eqNullSafe(F.col("__key"))
    of_hot = rows.join(F.broadcast(named.filter(hot)), same)
    rest = rows.join(F.broadcast(named.filter(hot).select("__key")), same, "left_anti").join(named.filter(~hot), same)
    return of_hot.unionByName(rest).drop("__key", members)
