"""Token-id files with bit-plane shuffling.

A file holds the ids of consecutive documents in chunks of a fixed number of ids.
Each chunk is transposed into planes (one per bit, or one per byte, as far as its
largest id needs), and each plane is compressed with zstandard on its own.  A footer
holds the chunk index and the documents' ids and lengths, so that a reader can fetch
any chunk, or only the planes it needs.

    magic, chunks, footer, <footer length u64, footer crc32 u32>, magic

``write_tokens`` encodes texts where they lie, then sorts the packed ids by doc_id and writes
files of bounded size, each a range of doc_id; ``read_tokens`` reads them back.  Null text counts
as empty (its document still gets the end id); null doc_ids sort first; documents with one doc_id
are ordered by a hash of their text, and equal rows may lie in different files; a special token's
string in a text gives that token's id (see ``tokens``); a very long text makes a long file; other
columns are ignored; an empty table gives no files and no rows.  Files are written under another
name and moved into place, so a task that runs twice leaves one file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch, tokens

MAGIC = b"BITPLANE"
CHUNK = 1 << 16
LEVEL = 3
FILE_IDS = 1 << 27  # ids of a file, about; with few ids, a file for each shuffle partition
ROWS = 1 << 16  # documents of a batch that is read back
ENCODED = "doc_id long, print long, place long, n long, ids binary"


def planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of some ids, lowest first: ``bit`` (packed, least bit first) or ``byte``."""
    bits = int(ids.max()).bit_length() if len(ids) else 0
    if kind == "byte":
        raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [raw[:, k].tobytes() for k in range((bits + 7) // 8)]
    if bits <= 16:
        ids = ids.astype(np.uint16)
    one = ids.dtype.type(1)
    return [np.packbits(((ids >> ids.dtype.type(k)) & one).astype(bool), bitorder="little").tobytes() for k in range(bits)]


def unplanes(raw: list[bytes], n: int, kind: str) -> np.ndarray:
    """Ids from their planes."""
    if kind == "byte":
        out = np.zeros((n, 4), np.uint8)
        for k, b in enumerate(raw):
            out[:, k] = np.frombuffer(b, np.uint8)
        return out.view("<u4")[:, 0]
    out = np.zeros(n, np.uint16 if len(raw) <= 16 else np.uint32)
    for k, b in enumerate(raw):
        out |= np.unpackbits(np.frombuffer(b, np.uint8), count=n, bitorder="little").astype(out.dtype) << out.dtype.type(k)
    return out.astype(np.uint32)


class Writer:
    """Writes one file; ``add`` takes the ids of whole documents in order."""

    def __init__(self, sink, kind: str = "byte", chunk: int = CHUNK):
        self.sink, self.kind, self.chunk = sink, kind, chunk
        self.zip = zstandard.ZstdCompressor(level=LEVEL)
        self.rest: list[np.ndarray] = []
        self.held = self.n_ids = 0
        self.at = len(MAGIC)
        self.index: list[tuple[int, int, list[int]]] = []
        self.docs: list[int | None] = []
        self.lengths: list[np.ndarray] = []
        sink.write(MAGIC)

    def _flush(self, whole: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        upto = len(ids) if whole else len(ids) // self.chunk * self.chunk
        for a in range(0, upto, self.chunk):
            part = ids[a : min(a + self.chunk, upto)]
            packed = [self.zip.compress(p) for p in planes(part, self.kind)]
            self.index.append((self.at, len(part), [len(p) for p in packed]))
            for p in packed:
                self.sink.write(p)
                self.at += len(p)
        self.rest, self.held = [ids[upto:]], len(ids) - upto

    def add(self, doc_ids: list[int | None], ids: np.ndarray, count: np.ndarray) -> None:
        self.docs += doc_ids
        self.lengths.append(count)
        self.rest.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        if self.held >= self.chunk:
            self._flush(False)

    def close(self) -> None:
        self._flush(True)
        lengths = np.concatenate(self.lengths) if self.lengths else np.zeros(0, np.int64)
        null = np.array([d is None for d in self.docs], np.uint8)
        docs = np.array([d or 0 for d in self.docs], "<i8")
        head = struct.pack("<BIQ", self.kind == "byte", len(self.index), len(docs))
        body = b"".join(struct.pack(f"<QIB{len(s)}I", at, n, len(s), *s) for at, n, s in self.index)
        footer = self.zip.compress(head + body + null.tobytes() + docs.tobytes() + lengths.astype("<i8").tobytes())
        self.sink.write(footer + struct.pack("<QI", len(footer), zlib.crc32(footer)) + MAGIC)


class Reader:
    """Reads one file by its index; ``size`` is the file's length in bytes."""

    def __init__(self, source, size: int):
        self.source = source
        tail = len(MAGIC) + 12
        source.seek(size - tail)
        length, crc = struct.unpack("<QI", (end := source.read(tail))[:12])
        if end[12:] != MAGIC:
            raise ValueError("not a bit-plane file, or one cut short")
        source.seek(size - tail - length)
        footer = source.read(length)
        if zlib.crc32(footer) != crc:
            raise ValueError("the footer is damaged")
        self.unzip = zstandard.ZstdDecompressor()
        raw = self.unzip.decompress(footer)
        byte, n_chunks, n_docs = struct.unpack_from("<BIQ", raw)
        self.kind, at, self.index = "byte" if byte else "bit", struct.calcsize("<BIQ"), []
        for _ in range(n_chunks):
            where, n, k = struct.unpack_from("<QIB", raw, at)
            at += 13
            self.index.append((where, n, struct.unpack_from(f"<{k}I", raw, at)))
            at += 4 * k
        null = np.frombuffer(raw, np.uint8, n_docs, at)
        docs = np.frombuffer(raw, "<i8", n_docs, at + n_docs)
        self.docs = [None if x else d for x, d in zip(null.tolist(), docs.tolist())]
        self.lengths = np.frombuffer(raw, "<i8", n_docs, at + 9 * n_docs)

    def chunk(self, k: int) -> np.ndarray:
        at, n, sizes = self.index[k]
        self.source.seek(at)
        return unplanes([self.unzip.decompress(self.source.read(s)) for s in sizes], n, self.kind)

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """doc_id, number of ids and the ids, in parts that are to be used up in turn."""
        chunks = (self.chunk(k) for k in range(len(self.index)))
        left = np.zeros(0, np.uint32)

        def parts(n: int) -> Iterator[np.ndarray]:
            nonlocal left
            while n:
                if not len(left):
                    left = next(chunks)
                take = left[:n]
                left, n = left[len(take) :], n - len(take)
                yield take

        for doc, n in zip(self.docs, self.lengths.tolist()):
            yield doc, n, parts(n)


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """``ENCODED`` of every row: a hash of its text, a number that no other row has, how many ids it has and
    its ids, of two bytes each where they fit, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1, write_checksum=False, write_content_size=True).compress
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, ids, count in tokens.encode_blocks(batch.column(2), tokenizer):
                ids, count = tokens.with_end(ids, count, end_id)
                wide = bool(len(ids)) and int(ids.max()) >= 1 << 16
                raw = ids.astype("<u4" if wide else "<u2").tobytes()
                end = np.cumsum(count) * (4 if wide else 2)
                packed = [squeeze(raw[a:b]) for a, b in zip([0, *end.tolist()], end.tolist())]
                own = [batch.column(k).slice(first, len(count)) for k in (0, 1)]
                places = pa.array(np.arange(place, place + len(count)))
                place += len(count)
                yield pa.RecordBatch.from_arrays([*own, places, pa.array(count), pa.array(packed, pa.binary())], ["doc_id", "print", "place", "n", "ids"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), text.alias("text"))
    return scratch.written(rows.mapInArrow(run, ENCODED), "bitplane-ids")


def write_tokens(
    docs: DataFrame, folder: str, *, tokenizer: str | None = None, end_id: int = 0, kind: str = "byte", chunk: int = CHUNK, files: int | None = None
) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write them to ``folder`` in ascending doc_id order, one file
    per range of doc_id.  Returns the manifest: file (ascending with doc_id), path, n_docs, n_ids."""
    spark = docs.sparkSession
    rows = encoded(docs, tokenizer or tokens.default_tokenizer(), end_id)
    if files is None:
        n_ids = rows.agg(F.sum("n")).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_ids // FILE_IDS))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        name, draft = f"{root}/{part:06d}.bitplane", f"{root}/_{part:06d}-{attempt}"
        unzip = zstandard.ZstdDecompressor().decompress
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                sink = fs.open_output_stream(draft)
                out = Writer(sink, kind, chunk)
            doc_ids, count = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for k, (n, packed) in enumerate(zip(count.tolist(), batch.column(2).to_pylist())):
                raw = unzip(packed)
                out.add(doc_ids[k : k + 1], np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.uint32), count[k : k + 1])
        if out is not None:
            out.close()
            sink.close()
            if fs.get_file_info(name).type != pafs.FileType.NotFound:  # of a task that ran before
                fs.delete_file(name)
            fs.move(draft, name)
            found = {"file": pa.array([part], pa.int32()), "path": [name], "n_docs": pa.array([len(out.docs)], pa.int64()), "n_ids": pa.array([out.n_ids], pa.int64())}
            yield pa.RecordBatch.from_pydict(found)

    # Places make every row's key its own, so a document that repeats is dealt over files too.
    rows = rows.repartitionByRange(files, "doc_id", "print", "place").sortWithinPartitions("doc_id", "print", "ids", "place")
    return scratch.written(rows.select("doc_id", "n", "ids").mapInArrow(write, "file int, path string, n_docs long, n_ids long"), "bitplane-manifest")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document of the files in ``manifest``: doc_id, start (ids before it in all files),
    n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""
    spark = manifest.sparkSession
    base, jobs = 0, []
    for r in sorted(manifest.collect()):  # a row per file
        jobs.append((r.file, r.path, base))
        base += r.n_ids

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(row["path"]) as f:
                    r, at = Reader(f, f.size()), row["base"]
                    found = []
                    for doc, n, parts in r.documents():
                        crc = 0
                        for p in parts:
                            crc = zlib.crc32(np.ascontiguousarray(p, "<u4"), crc)
                        found.append((doc, at, n, crc))
                        at += n
                        if len(found) == ROWS:
                            yield batch_of(found)
                            found = []
                    if found:
                        yield batch_of(found)

    frame = spark.createDataFrame(jobs, "file int, path string, base long")
    if jobs:
        frame = frame.repartition(len(jobs), "file")
    return frame.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_bitplane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch.new_path(spark, "bitplane")
    return read_tokens(write_tokens(scratch.documents(spark, sf_dir), folder), folder)
