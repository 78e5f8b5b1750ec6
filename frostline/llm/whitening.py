"""Embedding whitening by weighted multiplicity covariance.

Rows with identical integer vectors are one group; the fit list is the groups,
each with weight one or with its number of rows.  Sums are exact integers; the
covariance is a weighted product of centred blocks, one matrix per task, added
up cell by cell in a shuffle (no task sees more than a block of vectors).  Each
distinct vector is whitened once, and the result is joined back to its rows;
groups that hold a large share of the rows are broadcast in that join.

To the driver come the sums and one matrix of ``size`` x ``size`` numbers, where
``size`` is the length of a vector (at most ``LONGEST``), never rows.

Defined cases: vectors that are null or hold null or non-finite entries are
dropped; ids may be null or repeated, and every remaining row has its result;
shorter vectors are filled up with zeros; components without variance (less than
``FLAT`` of the trace) are left out, so a table with one distinct vector, like
an empty one, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import materialize
from frostline.llm.vectors import integer_vectors, join_groups, matrix

LONGEST = 2048
FLAT = 1e-10
BLOCK = 4096        # vectors multiplied at a time
SAFE = 2**62
_OUT = "vec_id {}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def _blocks(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for start in range(0, b.num_rows, BLOCK):
            part = b.slice(start, BLOCK)
            yield matrix(part.column(0), size), part.column(1).to_numpy(zero_copy_only=False)


def _sums(points: DataFrame, vec: str, weight: F.Column, size: int) -> tuple[int, list]:
    """Total weight and weighted sum of every entry (integers: exact)."""
    whole = dict(points.dtypes)[vec] == "array<bigint>"
    kind = "decimal(38,0)" if whole else "double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Python integers (objects) over tasks' int64 blocks: entries are below 2^31, so a block cannot overflow
        total, acc = 0, np.zeros(size, object if whole else float)
        for x, w in _blocks(batches, size):
            total += int(w.sum())
            acc = acc + (w.astype(object) @ x if whole and int(w.max()) * BLOCK >= 2**31 else w @ x)
        values = [total, *acc.tolist()]
        out = pa.array([Decimal(int(v)) for v in values], pa.decimal128(38)) if whole else pa.array(values, pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(range(size + 1), pa.int32()), out], names=["cell", "v"])

    got = points.select(vec, weight.cast("long")).mapInArrow(run, f"cell int, v {kind}") \
        .groupBy("cell").agg(F.sum("v").alias("v")).collect()
    values = [v for _, v in sorted(map(tuple, got))]
    return int(values[0]), [int(v) for v in values[1:]] if whole else values[1:]


def _covariance(points: DataFrame, vec: str, weight: F.Column, mean: np.ndarray, total: int) -> np.ndarray:
    """Covariance (divisor: the total weight), centred before multiplying."""
    size = len(mean)
    upper = np.triu_indices(size)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((size, size))
        for x, w in _blocks(batches, size):
            centred = x - mean
            acc += (centred * w[:, None]).T @ centred
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(acc[upper])], names=["cell", "v"])

    cells = points.select(vec, weight.cast("long")).mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    out = np.zeros((size, size))
    flat = np.array(sorted(map(tuple, cells.collect())))[:, 1]
    out[upper] = flat / total
    return out + np.triu(out, 1).T


def _deviations(x: np.ndarray, n: int, s: list[int]) -> pa.Array:
    """Sum over the entries of (n * x - s)^2, exact."""
    reach = n * int(np.abs(x).max(initial=0)) + max(map(abs, s), default=0)
    if reach * reach * max(1, x.shape[1]) < SAFE:
        return pa.array(((n * x - np.array(s, np.int64)) ** 2).sum(1)).cast(pa.decimal128(38))
    exact = ((n * x.astype(object) - np.array(s, object)) ** 2).sum(1)
    return pa.array([Decimal(int(v)) if v < 10**38 else None for v in exact], pa.decimal128(38))


def whiten(table: DataFrame, *, vec_id: str = "vec_id", vec: str = "embedding", scale: float = 256.0, components: int = 4,
           weights: str = "one") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``
    of every remaining row and each of the leading components.

    ``weights``: ``one`` (every distinct vector counts once) or ``counts`` (as
    often as it has rows); ``n`` is the total weight, ``deviation`` the exact
    squared distance of n times the vector from the weighted sums.
    """
    if weights not in ("one", "counts"):
        raise ValueError(f"weights must be 'one' or 'counts', got {weights!r}")
    spark = table.sparkSession
    out_schema = _OUT.format(dict(table.dtypes)[vec_id])
    rows, size = integer_vectors(table, vec, scale, {"vec_id": F.col(vec_id)})
    if size > LONGEST:
        raise ValueError(f"vectors of {size} entries; a covariance of more than {LONGEST} does not go through the driver")
    if not size:
        return spark.createDataFrame([], out_schema)
    groups = materialize(rows.groupBy("x").agg(F.count(F.lit(1)).alias("members")), "distinct-vectors")
    weight = F.lit(1) if weights == "one" else F.col("members")

    n, s = _sums(groups, "x", weight, size)
    mean = np.array([v / n for v in s])
    spread = _covariance(groups, "x", weight, mean, n)
    values, vectors = np.linalg.eigh(spread)
    trace = float(np.trace(spread))
    kept = [i for i in range(size - 1, -1, -1) if values[i] > FLAT * trace][:components]
    if not kept:
        return spark.createDataFrame([], out_schema)
    project = vectors[:, kept] / np.sqrt(values[kept])
    explained = [float(v) / trace for v in values[kept]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, BLOCK):
                part = b.slice(start, BLOCK)
                x = matrix(part.column(0), size)
                z = ((x - mean) @ project).ravel()
                lists = pa.ListArray.from_arrays(pa.array(range(0, len(z) + 1, len(kept)), pa.int32()), pa.array(z))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, _deviations(x, n, s)],
                                                 names=["x", "members", "z", "deviation"])

    white = materialize(groups.mapInArrow(run, "x array<long>, members long, z array<double>, deviation decimal(38,0)"), "whitened")
    # the check of the result: the same covariance, of the whitened vectors
    zn, zs = _sums(white, "z", weight, len(kept))
    z_spread = _covariance(white, "z", weight, np.array(zs) / zn, zn)
    error = float(np.abs(z_spread - np.eye(len(kept))).max())

    joined = join_groups(rows, white, "x", "members")
    share = F.array(*[F.lit(v) for v in explained])
    return joined.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", F.posexplode("z").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.element_at(share, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"))
