"""Best-fit packing of documents into sequences of at most ``capacity`` tokens.

Hierarchical residual packing.  Every partition packs its own pieces best-fit
(longest first) and emits the bins that are nearly full.  The underfull bins
go on as items of their own - a bin that moves takes its pieces along - to a
round with fewer partitions, where best-fit runs again, until one partition
is left or a round no longer joins anything.

Defined cases: a null text is empty (its sequence is just the end id); a null
``doc_id`` is carried as null; repeated rows and ids are packed once per row;
an empty table gives an empty result; other columns are ignored.  No text is
cut unless it alone is longer than a sequence.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.bpe_ids import encoder
from frostline.llm.common import TEXTS, materialize

END_ID = 2
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
_BINS = "done boolean, fill int, members binary"
_BINS_ARROW = pa.schema([("done", pa.bool_()), ("fill", pa.int32()), ("members", pa.binary())])
# one piece inside a bin
_MEMBER = np.dtype([("doc_id", "<i8"), ("no_id", "u1"), ("piece", "<i4"), ("start", "<i8"),
                    ("length", "<i4"), ("ids_crc32", "<u4")])
CHUNK = 50_000          # items that one best-fit run looks at together
NEARLY_FULL = 4         # a bin lacking at most so many tokens is emitted at once


def cut(n_tokens: int, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(piece, start, length); the first piece takes the remainder."""
    first = n_tokens % capacity or min(n_tokens, capacity)
    start, piece, length = 0, 0, first
    while start < n_tokens:
        yield piece, start, length
        start, piece, length = start + length, piece + 1, capacity


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = END_ID) -> DataFrame:
    """Tokenize whole texts and cut the long ones: one row per piece."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary), int(end_id).to_bytes(4, "little")
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = memoryview(enc.encode(text) + end)
                for piece, start, length in cut(len(ids) // 4, capacity):
                    out.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start:4 * (start + length)])))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of item positions.

    Open bins are kept by free space; a bit per free space tells in one step
    which is the smallest that still takes the item."""
    by_free: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    has, bins = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = has >> s
        if fits:
            free = s + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                has &= ~(1 << free)
        else:
            free, b = capacity, []
            bins.append(b)
        b.append(i)
        left = free - s
        if left:
            by_free[left].append(b)
            has |= 1 << left
    return bins


def _pack(items: Iterable[tuple[int, bytes]], capacity: int, last: bool) -> Iterator[tuple[bool, int, bytes]]:
    """Best-fit over a stream of (size, members), ``CHUNK`` items at a time;
    underfull bins stay for the next chunk as items."""
    held: list[tuple[int, bytes]] = []

    def settle(final: bool):
        bins = best_fit(np.fromiter((s for s, _ in held), np.int64, len(held)), capacity)
        merged = [(sum(held[i][0] for i in b), b"".join(held[i][1] for i in b)) for b in bins]
        held.clear()
        for fill, members in merged:
            if fill >= capacity - NEARLY_FULL or (final and last):
                yield True, fill, members
            elif final:
                yield False, fill, members
            else:
                held.append((fill, members))
        if len(held) > CHUNK // 2:      # hardly anything fits together here
            yield from ((last, f, m) for f, m in held)
            held.clear()

    for item in items:
        if item[0] >= capacity - NEARLY_FULL:
            yield True, *item
            continue
        held.append(item)
        if len(held) >= CHUNK:
            yield from settle(False)
    yield from settle(True)


def _batches(rows: Iterator[tuple[bool, int, bytes]]) -> Iterator[pa.RecordBatch]:
    out = []
    for r in rows:
        out.append(r)
        if len(out) >= 2_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _BINS_ARROW, strict=True)], schema=_BINS_ARROW)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _BINS_ARROW, strict=True)], schema=_BINS_ARROW)


def _first_round(capacity: int, last: bool):
    def run(batches):
        def items():
            for b in batches:
                m = np.zeros(b.num_rows, _MEMBER)
                for name in ("piece", "start", "length", "ids_crc32"):
                    m[name] = b.column(name).to_numpy(zero_copy_only=False)
                m["doc_id"] = b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
                m["no_id"] = b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                raw, w = m.tobytes(), _MEMBER.itemsize
                yield from ((n, raw[i * w:(i + 1) * w]) for i, n in enumerate(m["length"].tolist()))
        yield from _batches(_pack(items(), capacity, last))
    return run


def _next_round(capacity: int, last: bool):
    def run(batches):
        items = ((f, m) for b in batches for f, m in zip(b.column("fill").to_pylist(), b.column("members").to_pylist(), strict=True))
        yield from _batches(_pack(items, capacity, last))
    return run


def _unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bins -> one row per piece with its place in the sequence."""
    for b in batches:
        if not b.num_rows:
            continue
        blobs = b.column("members").to_pylist()
        m = np.frombuffer(b"".join(blobs), _MEMBER)
        counts = np.fromiter((len(x) // _MEMBER.itemsize for x in blobs), np.int64, len(blobs))
        ends = np.cumsum(m["length"], dtype=np.int64)
        before = ends - m["length"]
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        yield pa.RecordBatch.from_arrays([
            pa.array(m["doc_id"].astype(np.int64), mask=m["no_id"].astype(bool)), pa.array(m["piece"].astype(np.int32)),
            pa.array(m["start"].astype(np.int64)), pa.array(m["length"].astype(np.int64)),
            pa.array(m["ids_crc32"].astype(np.int64)),
            pa.array(np.repeat(b.column("sequence_id").to_numpy(), counts)),
            pa.array(before - np.repeat(before[first], counts))],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(items: DataFrame, capacity: int, fan_in: int = 8) -> DataFrame:
    """Pack a table of pieces; ``sequence_id`` and ``offset`` are added."""
    bins = materialize(items.mapInArrow(_first_round(capacity, False), _BINS), "pack-0")
    done, rounds = [bins.filter("done")], 0
    still = bins.filter("not done")
    count = still.count()
    parts = fan_in * math.ceil(count / CHUNK)
    while count:
        rounds += 1
        parts = math.ceil(min(parts / fan_in, count / CHUNK))
        bins = materialize(still.select("fill", "members").repartition(parts)
                           .mapInArrow(_next_round(capacity, parts == 1), _BINS), f"pack-{rounds}")
        done.append(bins.filter("done"))
        still = bins.filter("not done")
        before, count = count, still.count()
        joined = before - count
        if count and parts > 1 and joined < before // 100:
            done.append(still)          # what is left does not fit together
            break
    every = done[0]
    for d in done[1:]:
        every = every.union(d)
    numbered = every.select("members", F.monotonically_increasing_id().alias("sequence_id"))
    # numbers depend on how the files are split, so they are written once
    out = numbered.mapInArrow(_unpack, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                       "sequence_id long, offset long")
    return materialize(out, "packed")


def pack_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = 1024,
                   end_id: int = END_ID) -> DataFrame:
    """Tokenize, cut and pack ``docs(doc_id, text)``; one row per piece."""
    return pack(materialize(pieces(docs, vocabulary, capacity, end_id), "pieces", batch=TEXTS), capacity)
