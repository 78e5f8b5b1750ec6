"""Vector code compression with an integer Walsh-Hadamard nearest-entry search.

A vector of integers is cut into equal parts; each part position has a codebook,
fitted by rounds of assignment and averaging over every vector.  The nearest
entry of a part is found exactly, without floating point: parts and entries are
filled up with zeros to a power of two and transformed (the transform keeps
squared distances, times the length); squared differences of the coefficients
are added in sequency order, and an entry goes out as soon as its sum passes the
whole distance of the best entry known.

The codebooks (``entries`` x vector length integers) are all that the driver
holds; a round sends it their sums, added up over the tasks in a shuffle.

Defined cases: vectors that are null or hold null or non-finite components are
dropped; shorter vectors are filled up with zeros to the longest one, and that
to a multiple of ``parts``; rows with a null or repeated id take part each (ids
order null last, equal ids by vector); with fewer rows than ``entries`` the
codebooks are smaller; an empty table, or one of empty vectors alone, gives an
empty result; null labels are one label; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.common import materialize
from frostline.llm.vectors import integer_vectors, join_groups, matrix

BLOCK = 256             # parts compared at a time
STEP = 8                # coefficients between two eliminations
SAFE = 2**62


def sequency_order(size: int) -> np.ndarray:
    """Rows of the natural Walsh-Hadamard matrix by number of sign changes:
    the bit reversal of the Gray code."""
    bits = size.bit_length() - 1
    gray = [k ^ (k >> 1) for k in range(size)]
    return np.array([int(format(g, f"0{bits}b")[::-1], 2) if bits else 0 for g in gray])


def transform(vectors: np.ndarray) -> np.ndarray:
    """Integer Walsh-Hadamard transform of every row, zero-padded to a power of
    two, coefficients in sequency order.  Squared distances grow by the number of
    coefficients, exactly; entries too large for that in 64 bits become Python
    integers."""
    n, size = vectors.shape
    padded = 1 << max(0, size - 1).bit_length()
    out = np.zeros((n, padded), vectors.dtype)
    out[:, :size] = vectors
    reach = int(np.abs(vectors).max(initial=0))
    if 4 * reach * reach * padded**3 >= SAFE:
        out = out.astype(object)
    half = 1
    while half < padded:
        pairs = out.reshape(n, padded // (2 * half), 2, half)
        a, b = pairs[:, :, 0, :].copy(), pairs[:, :, 1, :].copy()
        pairs[:, :, 0, :], pairs[:, :, 1, :] = a + b, a - b
        half *= 2
    return out[:, sequency_order(padded)]


def nearest_entries(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row of ``parts`` its nearest row of ``entries`` (ties: the
    smaller index) and their squared distance.  Exact."""
    p, c = transform(parts), transform(entries)
    if p.dtype != c.dtype:
        p, c = p.astype(object), c.astype(object)
    size = p.shape[1]
    best = np.zeros(len(p), np.int64)
    dist = np.zeros(len(p), p.dtype)
    for start in range(0, len(p), BLOCK):
        rows = slice(start, start + BLOCK)
        best[rows], dist[rows] = _search(p[rows], c, size)
    return best, dist // size


def _search(p: np.ndarray, c: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(p)
    sums = np.zeros((n, len(c)), p.dtype)
    at = 0
    bound = None
    while at < size:                    # while most pairs live: all of them at once
        for k in range(at, min(at + STEP, size)):
            diff = p[:, k, None] - c[None, :, k]
            sums += diff * diff
        at = min(at + STEP, size)
        lead = sums.argmin(1)
        whole = ((p - c[lead]) ** 2).sum(1)
        bound = whole if bound is None else np.minimum(bound, whole)
        alive = sums <= bound[:, None]
        if alive.sum() * 4 < alive.size:
            break
    row, entry = np.nonzero(alive)
    left = sums[row, entry]
    while at < size:                    # then only the pairs not yet eliminated
        to = min(at + STEP, size)
        left = left + ((p[row, at:to] - c[entry, at:to]) ** 2).sum(1)
        at = to
        stay = left <= bound[row]
        row, entry, left = row[stay], entry[stay], left[stay]
    # pairs come row by row, entries ascending; a stable sort keeps that order among equal distances
    order = np.lexsort((entry, left, row)) if left.dtype != object else np.array(
        sorted(range(len(row)), key=lambda i: (row[i], left[i], entry[i])), np.int64)
    row, entry, left = row[order], entry[order], left[order]
    first = np.searchsorted(row, np.arange(n))
    return entry[first], left[first]


def _assign(x: np.ndarray, books: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [nearest_entries(part, book) for part, book in zip(np.split(x, len(books), axis=1), books, strict=True)]


def _refit(rows: DataFrame, books: list[np.ndarray], size: int) -> list[np.ndarray]:
    """One round: every entry becomes the floor of the mean of its parts."""
    width = size // len(books)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros((len(b), width), np.int64) for b in books]
        for b in batches:
            x = matrix(b.column(0), size)
            for i, (part, (entry, _)) in enumerate(zip(np.split(x, len(books), axis=1), _assign(x, books), strict=True)):
                order = np.argsort(entry, kind="stable")
                used, first = np.unique(entry[order], return_index=True)
                if len(used):
                    sums[i][used] += np.add.reduceat(part[order], first, axis=0)
                counts[i] += np.bincount(entry, minlength=len(counts[i]))
        for i in range(len(books)):
            used = np.flatnonzero(counts[i])
            flat = sums[i][used].ravel()
            lists = pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, width), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), i, np.int32)), pa.array(used.astype(np.int32)),
                                              pa.array(counts[i][used]), lists], names=["part", "entry", "n", "sums"])

    partial = rows.select("x").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    cells = partial.select("part", "entry", "n", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at") \
        .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = [b.copy() for b in books]
    for part, entry, at, n, s in cells.collect():         # entries x vector length integers, whatever the table
        out[part][entry, at] = int(s) // n
    return out


def books_digest(books: list[np.ndarray]) -> str:
    """Hex SHA-256 of all entries, decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress(table: DataFrame, *, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256,
             rounds: int = 4, scale: float = 1024.0) -> tuple[DataFrame, list[np.ndarray]]:
    """``(vec_id, label, code, error)`` of every remaining row, and the codebooks.
    ``code`` has two hex digits a part; ``error`` is the squared distance of the
    vector from its code, in squared units of 1 / ``scale``."""
    if not 0 < entries <= 256:
        raise ValueError(f"two hex digits name at most 256 entries, got {entries}")
    types = dict(table.dtypes)
    schema = f"vec_id {types[vec_id]}, label {types[label]}, code string, error decimal(38,0)"
    rows, size = integer_vectors(table, vec, scale, {"vec_id": F.col(vec_id), "label": F.col(label)}, multiple=parts)
    if not size:
        return table.sparkSession.createDataFrame([], schema), []
    # a fixed number of rows, the same on every run
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    books = np.split(np.array([r.x for r in first], np.int64), parts, axis=1)
    for _ in range(rounds):
        books = _refit(rows, books, size)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            found = _assign(matrix(b.column(2), size), books)
            code = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8)
            text = [c.tobytes().hex() for c in code]
            error = sum(d.astype(object) for _, d in found)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()),
                                              pa.array([Decimal(int(e)) for e in error], pa.decimal128(38))], names=["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "x").mapInArrow(run, schema), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``: the error summed over the rows of its label."""
    coded = materialize(coded, "codes")
    labels = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("members")), "label-errors")
    return join_groups(coded, labels, "label", "members")
