"""Binary log segments: records of two varint lengths, key and value, up to a zero key length.

Segments are written and read as streams of records, so none is held whole but as one binary value
where ``encode`` is asked for that.  Keys and values are bytes; ``decode`` hands them on as they are,
in strings too, so bytes that are no UTF-8 do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import octets, varint_hex


def record(key: Column, val: Column) -> Column:
    """A log record, as bytes."""
    head = F.concat(varint_hex(octets(key)), varint_hex(octets(val)))
    return F.concat(F.unhex(head), key.cast("binary"), val.cast("binary"))


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while shift < 35 and at < len(data):
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7
    return 0, len(data)


def records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Records of a segment; a torn last record is left out."""
    at = 0
    while at < len(data):
        k, at = _varint(data, at)
        if not k:
            return
        v, at = _varint(data, at)
        if at + k + v > len(data):
            return
        yield data[at : at + k], data[at + k : at + k + v]
        at += k + v


def _by_segment(entries: DataFrame) -> DataFrame:
    """fid, record of entries (fid, key, val, seq), each segment's in order of seq in one partition."""
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = entries.select(F.col("fid").cast("long").alias("fid"), "seq", record(F.col("key"), F.col("val")).alias("record"))
    return rows.repartition(n, "fid").sortWithinPartitions("fid", "seq").select("fid", "record")


def encode(entries: DataFrame) -> DataFrame:
    """fid, content: the segments of entries (fid, key, val, seq), in order of seq.  A segment is one
    file of at most a memtable's size, and is one value here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, content = None, bytearray()

        def segment() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([bytes(content)], pa.binary())], ["fid", "content"])

        for batch in batches:
            for fid, data in zip(*(c.to_pylist() for c in batch.columns)):
                if content and fid != now:
                    yield segment()
                    content.clear()
                now = fid
                content += data
        if content:
            yield segment()

    return _by_segment(entries).mapInArrow(run, "fid long, content binary")


def write_segments(entries: DataFrame, folder: str) -> DataFrame:
    """Write each segment of entries (fid, key, val, seq) to a ``*.wal`` file of a folder, record by record.
    fid, path, bytes of each.  Files are moved into place whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        fs.create_dir(root, recursive=True)
        now, sink, size = None, None, 0

        def finished() -> pa.RecordBatch:
            sink.close()
            path = f"{root}/{now:05d}.wal"
            if fs.get_file_info(path).type != pafs.FileType.NotFound:  # of a task that ran before
                fs.delete_file(path)
            fs.move(f"{root}/_{now}-{attempt}", path)
            return pa.RecordBatch.from_pydict({"fid": [now], "path": [path], "bytes": [size]})

        for batch in batches:
            for fid, data in zip(*(c.to_pylist() for c in batch.columns)):
                if fid != now:
                    if sink:
                        yield finished()
                    now, size = fid, 0
                    sink = fs.open_output_stream(f"{root}/_{now}-{attempt}")
                sink.write(data)
                size += len(data)
        if sink:
            yield finished()

    return _by_segment(entries).mapInArrow(run, "fid long, path string, bytes long")


def decode(segments: DataFrame, *, raw: bool = False) -> DataFrame:
    """fid, ord, key, val of segments (fid, content); ord counts a segment's records from 0.  Key and value
    are strings of the same bytes, or, ``raw``, the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(fid: int, first: int, rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            at = range(first, first + len(rows))
            keys, vals = (pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array([fid] * len(rows), pa.int64()), pa.array(at, pa.int64()), keys, vals], ["fid", "ord", "key", "val"])

        for batch in batches:
            for fid, content in zip(*(c.to_pylist() for c in batch.columns)):
                first, rows = 0, []
                for r in records(content or b""):
                    rows.append(r)
                    if len(rows) == 1 << 14:
                        yield part(fid, first, rows)
                        first, rows = first + len(rows), []
                yield part(fid, first, rows)

    rows = segments.select(F.col("fid").cast("long"), "content").mapInArrow(run, "fid long, ord long, key binary, val binary")
    return rows if raw else rows.select("fid", "ord", *[F.col(c).cast("string").alias(c) for c in ("key", "val")])


def read_segments(spark, folder: str) -> DataFrame:
    """fid, content of the ``*.wal`` files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wal").load(folder)
    return files.select(F.regexp_extract("path", r"([0-9]+)\.wal$", 1).try_cast("bigint").alias("fid"), "content")
