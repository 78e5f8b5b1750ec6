"""Token-ID files: independent zstandard frames with a trailing seek table.

A file is a run of zstandard frames, one per document (its ids, unsigned 32-bit
little endian), then one frame with the documents' ids, then the seek table of
the public "zstd seekable format": a skippable frame with the compressed and
decompressed size and the checksum (low half of XXH64 of the content) of every
frame.  A reader finds a document through the table and decompresses only its
frame; any zstandard tool can decompress the whole file.

Documents are dealt out by ranges of ``doc_id``, so the files in the order of
their numbers hold all documents in ascending order.  A task writes under a
name of its own and moves the finished file into place, so a lost executor or a
second attempt leaves no partial file.

Defined cases: a null text is empty (its document is the end id alone); a null
``doc_id`` comes first and is read back as null; rows with the same id follow
each other by text hash; an empty table gives no files and an empty result;
other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frostline.llm.bpe_ids import batch_encoder, text_slices

END_ID = 2
LEVEL = 3
# the seekable format (fixed values)
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
WITH_CHECKSUMS = 0x80
_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("checksum", "<u4")])
_FOOTER = struct.Struct("<IBI")     # number of frames, descriptor, magic number
_FILES = "file_no int, path string, n_docs long, n_ids long"


def _open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class SeekableWriter:
    def __init__(self, out, level: int = LEVEL):
        import xxhash
        import zstandard
        self.out, self.digest = out, xxhash.xxh64_intdigest
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.entries: list[tuple[int, int, int]] = []

    def frame(self, content: bytes) -> None:
        packed = self.packer.compress(content)
        self.entries.append((len(packed), len(content), self.digest(content) & 0xFFFFFFFF))
        self.out.write(packed)

    def close(self) -> None:
        table = np.array(self.entries, _ENTRY).tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + _FOOTER.size) + table
                       + _FOOTER.pack(len(self.entries), WITH_CHECKSUMS, SEEKABLE))


class SeekableReader:
    """Random access to the frames of a file."""

    def __init__(self, source, size: int):
        import xxhash
        import zstandard
        self.source, self.digest, self.unpacker = source, xxhash.xxh64_intdigest, zstandard.ZstdDecompressor()
        n, flags, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != SEEKABLE or not flags & WITH_CHECKSUMS:
            raise ValueError("not a seekable token file")
        self.table = np.frombuffer(self._at(size - _FOOTER.size - n * _ENTRY.itemsize, n * _ENTRY.itemsize), _ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.table["packed"], dtype=np.int64)])

    def _at(self, start: int, n: int) -> bytes:
        self.source.seek(int(start))
        return self.source.read(int(n))

    def __len__(self) -> int:
        return len(self.table)

    def frame(self, i: int) -> bytes:
        e = self.table[i]
        content = self.unpacker.decompress(self._at(self.starts[i], e["packed"]), max_output_size=max(1, int(e["plain"])))
        if len(content) != e["plain"] or self.digest(content) & 0xFFFFFFFF != e["checksum"]:
            raise ValueError(f"frame {i} is damaged")
        return content

    def doc_ids(self) -> list[int | None]:
        raw = self.frame(len(self) - 1)
        n = len(raw) // 9
        ids, known = np.frombuffer(raw[:8 * n], "<i8"), np.frombuffer(raw[8 * n:], "u1")
        return [i if k else None for i, k in zip(ids.tolist(), known.tolist(), strict=True)]


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = END_ID,
                      files: int | None = None, level: int = LEVEL) -> None:
    """Encode ``docs(doc_id, text)`` into ``folder``: token files, and a small
    Parquet list of them in ``folder/_files``."""
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(
        spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open_fs(folder)
        enc, end, no = batch_encoder(vocabulary), int(end_id).to_bytes(4, "little"), TaskContext.get().partitionId()
        name, own = f"{root}/part-{no:06d}.zst", f"{root}/.part-{no:06d}-{uuid.uuid4().hex}"
        ids, total, out, writer = [], 0, None, None
        for b in text_slices(batches, 1):
            found, begins = enc.encode(b.column(1))
            for doc_id, (first, last) in zip(b.column(0).to_pylist(), pairwise(begins.tolist()), strict=True):
                if writer is None:
                    out = store.open_output_stream(own)
                    writer = SeekableWriter(out, level)
                content = found[first:last].tobytes() + end
                writer.frame(content)
                ids.append(doc_id)
                total += len(content) // 4
        if writer is not None:
            writer.frame(np.array([i or 0 for i in ids], "<i8").tobytes() + bytes(i is not None for i in ids))
            writer.close()
            out.close()
            store.move(own, name)
            yield pa.RecordBatch.from_arrays(
                [pa.array([no], pa.int32()), pa.array([f"part-{no:06d}.zst"]), pa.array([len(ids)], pa.int64()), pa.array([total], pa.int64())],
                names=["file_no", "path", "n_docs", "n_ids"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = d.withColumn("h", F.xxhash64("text"))
    (d.repartitionByRange(files, F.asc_nulls_first("doc_id"), "h").sortWithinPartitions(F.asc_nulls_first("doc_id"), "h")
     .select("doc_id", "text").mapInArrow(run, _FILES).write.parquet(f"{folder}/_files"))


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder with the number of ids before each (one row per
    file, so the running sum is over a short table)."""
    order = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (spark.read.schema(_FILES).parquet(f"{folder}/_files")
            .withColumn("ids_before", F.sum("n_ids").over(order) - F.col("n_ids")))


def read_documents(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Read documents back: doc_id, start (ids of all documents before it),
    n_tokens, ids (bytes).  With ``doc_ids`` only their frames are decompressed."""
    wanted = None if doc_ids is None else set(doc_ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open_fs(folder)
        for b in batches:
            for name, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as source:
                    reader = SeekableReader(source, source.size())
                    ids = reader.doc_ids()
                    n = reader.table["plain"][:-1] // 4
                    starts = before + np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
                    rows, size = [], 0
                    for i, doc_id in enumerate(ids):
                        if wanted is not None and doc_id not in wanted:
                            continue
                        rows.append((doc_id, int(starts[i]), int(n[i]), reader.frame(i)))
                        size += int(n[i])
                        if size > 1_000_000:
                            yield _read_batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield _read_batch(rows)

    listed = token_files(spark, folder).select("path", "ids_before")
    n = listed.count()
    return listed.repartition(max(1, n)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      names=["doc_id", "start", "n_tokens", "ids"])


def digests(read: DataFrame) -> DataFrame:
    """crc32 in place of the ids (``F.crc32`` is the JVM's, over the same bytes)."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
