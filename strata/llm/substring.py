"""Substring dedup: every word in a window of ``WINDOW`` words that occurs elsewhere too is removed.

Count-min prefilter.  Documents are gathered into chunks of a few megabytes.  Each chunk has
a count-min sketch: ``DEPTH`` rows of cells, with counts kept as "none, once here, more often
here", stored sparsely and cut into slices of a fixed number of cells.  Slices of one range
are merged by one task, and each chunk gets back, as one bit a cell, which of its own cells
are counted twice or more in all.  So a sketch as wide as the corpus needs is never held or
broadcast in one place, and an estimate is never below the true count: a window not estimated
repeated occurs once.  The second pass groups exactly (by SHA-256 of the words, cut to 128 bits)
only the windows estimated repeated, a distinct digest of a chunk counting once, and again
returns a bit for each.
The third pass drops the covered words.

Every task holds one chunk, or one slice of about a fixed number of entries, and a passage that
a third of the rows share is one entry in each chunk, so no key gathers rows.

Null text has no words and stays null in ``dedup``; equal rows are documents of their own, so
their windows repeat; texts under ``WINDOW`` words are left alone; a very long text makes a
chunk of its own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from . import text as tx

WINDOW = 35
DEPTH = 2
CHUNK = 4 << 20  # characters
LEAST_SLICE, MOST_SLICE = 22, 26  # cells of a slice, as powers of two
ENTRY = "chunk long, slice int, entries binary"
BITS = "chunk long, slice int, bits binary"


def chunked(docs: DataFrame) -> DataFrame:
    """chunk, rows: the rows of ``docs`` (text is the last column) in compressed chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, 0
        part = TaskContext.get().partitionId()

        def packed() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as w:
                for b in held:
                    w.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "rows"])

        for batch in batches:
            length = np.array([len(t.as_py() or "") for t in batch.column(batch.num_columns - 1)], np.int64)
            at = 0
            while at < batch.num_rows:
                upto = np.cumsum(length[at:])
                take = max(int(np.searchsorted(upto, CHUNK - size, "right")), 0 if held else 1)
                if take:
                    held.append(batch.slice(at, take))
                    size += int(upto[take - 1])
                    at += take
                if at < batch.num_rows:
                    yield packed()
                    held, size, n = [], 0, n + 1
        if held:
            yield packed()

    return scratch.written(docs.mapInArrow(run, "chunk long, rows binary"), "chunks")


def _rows(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _slice(bits: int) -> int:
    """Cells of a slice of a row with 2**bits cells: about a thousand slices, as far as the bounds go."""
    return max(LEAST_SLICE, min(MOST_SLICE, bits - 10))


class Windows:
    """The windows of a chunk's texts, with their rolling hashes (``h``, for the sketch alone)."""

    def __init__(self, texts: pa.ChunkedArray, width: int = WINDOW):
        self.texts, self.width = texts, width
        h, first, before, base = [], [], [], [0]
        for _, block in tx.blocks(texts):
            starts, ends, upto = block.words()
            word = tx.ROLL.ranges(tx.ROLL.prefix(tx.char_values(block.cps)), starts, ends)
            at, _ = tx.windows(upto, width)
            h.append(tx.ROLL2.ranges(tx.ROLL2.prefix(word), at, at + width))
            first.append(at + base[-1])
            before.append(upto[:-1] + base[-1])
            base.append(base[-1] + len(starts))
        self.base = base  # words before each block
        self.h = np.concatenate(h or [np.zeros(0, tx.U64)])
        self.first = np.concatenate(first or [np.zeros(0, np.int64)])
        self.before = np.append(np.concatenate(before or [np.zeros(0, np.int64)]), base[-1])

    def digests(self, which: np.ndarray) -> np.ndarray:
        """Digests of the words of the windows at these (ascending) places."""
        first, out = self.first[which], [np.zeros((0, 2), tx.U64)]
        for (_, block), a, b in zip(tx.blocks(self.texts), self.base, self.base[1:]):
            at = first[np.searchsorted(first, a) : np.searchsorted(first, b)] - a
            if len(at):
                data, starts, ends = block.spaced()
                out.append(tx.digests(data, starts[at], ends[at + self.width - 1]))
        return np.concatenate(out)

    def cells(self, row: int, bits: int) -> np.ndarray:
        return (tx.mix(self.h ^ tx.U64(0xA0761D6478BD642F * (row + 1) & (1 << 64) - 1)) >> tx.U64(64 - bits)).astype(np.uint32 if bits <= 32 else np.uint64)


def _sorted_once(keys: np.ndarray) -> np.ndarray:
    s = np.sort(keys)
    return s[np.flatnonzero(np.append(True, s[1:] != s[:-1]))] if len(s) else s


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, which of them is each entry's, and which occur more than once."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    begin = np.flatnonzero(new)
    inverse = np.empty(len(s), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return s[begin], inverse, np.diff(np.append(begin, len(s))) > 1


def _planes(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, each compressed on its own (an empty one: all zero)."""
    width = values.dtype.itemsize
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T)
    parts = [pa.compress(p.tobytes(), codec="zstd", asbytes=True) if p.any() else b"" for p in raw]
    return np.array([len(values), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def _unplanes(data: bytes, width: int, at: int = 0) -> tuple[np.ndarray, int]:
    """The integers, and where in ``data`` they end."""
    n, *sizes = np.frombuffer(data, "<u4", width + 1, at).tolist()
    at += 4 * (width + 1)
    out = np.zeros((n, width), np.uint8)
    for k, size in enumerate(sizes):
        if size:
            out[:, k] = np.frombuffer(pa.decompress(data[at : at + size], decompressed_size=n, codec="zstd", asbytes=True), np.uint8)
        at += size
    return out.view(f"<u{width}")[:, 0], at


def _emit(chunk: int, slices: list[int], values: list[bytes], name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk] * len(slices), pa.int64()), pa.array(slices, pa.int32()), pa.array(values, pa.binary())], ["chunk", "slice", name])


def _sketch_entries(chunk: int, w: Windows, bits: int, size: int) -> pa.RecordBatch:
    slices, values = [], []
    for row in range(DEPTH):
        own = _sorted_once(w.cells(row, bits))
        of = (own >> own.dtype.type(size)).astype(np.int64)
        cut = np.flatnonzero(np.diff(of, prepend=-1))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(own)]):
            slices.append(row << bits - size | int(of[a]))
            inside = own[a:b] & own.dtype.type((1 << size) - 1)
            values.append(_planes(np.diff(inside, prepend=inside.dtype.type(0)).astype("<u4")))
    return _emit(chunk, slices, values, "entries")


def _bits_of(answers: list[dict], slices: np.ndarray) -> np.ndarray:
    """The answered bits of sorted distinct entries, whose slices are given, in their order."""
    got = {a["slice"]: a["bits"] for a in answers or []}
    out = np.zeros(len(slices), bool)
    cut = np.flatnonzero(np.diff(slices, prepend=-1))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(slices)]):
        out[a:b] = np.unpackbits(np.frombuffer(got[int(slices[a])], np.uint8), count=b - a).astype(bool)
    return out


def _estimated(w: Windows, answers: list[dict], bits: int, size: int) -> np.ndarray:
    """Windows whose smallest count over the sketch's rows is two or more."""
    out = np.ones(len(w.h), bool)
    for row in range(DEPTH):
        own, inverse, here = _distinct(w.cells(row, bits))
        of = (own >> own.dtype.type(size)).astype(np.int64) | row << bits - size
        out &= (here | _bits_of(answers, of))[inverse]
    return out


class _Exact:
    """Distinct digests of a chunk's windows that are estimated repeated, in order."""

    def __init__(self, w: Windows, estimated: np.ndarray, slice_bits: int):
        self.at = np.flatnonzero(estimated)
        h, g = w.digests(self.at).T
        order, begin = tx.distinct_rows([h, g])
        self.h, self.g = h[order[begin]], g[order[begin]]
        size = np.diff(np.append(begin, len(h)))
        self.here = size > 1
        self.inverse = np.empty(len(h), np.int64)
        self.inverse[order] = np.repeat(np.arange(len(begin)), size)
        self.slice = (self.h >> np.uint64(64 - slice_bits)).astype(np.int64) if slice_bits else np.zeros(len(self.h), np.int64)

    def entries(self, chunk: int) -> pa.RecordBatch:
        cut = np.flatnonzero(np.diff(self.slice, prepend=-1)).tolist()
        values = [
            _planes(np.diff(self.h[a:b], prepend=np.uint64(0)).astype("<u8")) + self.g[a:b].astype("<u8").tobytes()
            for a, b in zip(cut, [*cut[1:], len(self.h)])
        ]
        return _emit(chunk, self.slice[cut].tolist(), values, "entries")

    def repeated(self, answers: list[dict]) -> np.ndarray:
        return self.at[(self.here | _bits_of(answers, self.slice))[self.inverse]]


def _answer(table: pa.Table, sizes: list[int], repeated: np.ndarray) -> pa.Table:
    cut = np.append(0, np.cumsum(sizes)).tolist()
    bits = [np.packbits(repeated[a:b]).tobytes() for a, b in zip(cut, cut[1:])]
    return pa.table({"chunk": table["chunk"], "slice": table["slice"], "bits": pa.array(bits, pa.binary())})


def _merge_cells(table: pa.Table) -> pa.Table:
    """Of each chunk's cells those that another chunk has too.  A chunk's own cells are distinct."""
    cells = [np.cumsum(_unplanes(v, 4)[0], dtype=np.int64) for v in table["entries"].to_pylist()]
    once = np.zeros(max(int(c[-1]) for c in cells) + 1, bool)
    more = once.copy()
    for c in cells:
        more[c] |= once[c]
        once[c] = True
    return _answer(table, [*map(len, cells)], np.concatenate([more[c] for c in cells]))


def _merge_digests(table: pa.Table) -> pa.Table:
    h, g = [], []
    for v in table["entries"].to_pylist():
        d, at = _unplanes(v, 8)
        h.append(np.cumsum(d, dtype=np.uint64))
        g.append(np.frombuffer(v, "<u8", len(d), at))
    sizes = [*map(len, h)]
    order, begin = tx.distinct_rows([np.concatenate(h), np.concatenate(g)])
    size = np.diff(np.append(begin, len(order)))
    out = np.zeros(len(order), bool)
    out[order] = np.repeat(size > 1, size)
    return _answer(table, sizes, out)


def _returned(entries: DataFrame, merge: Callable[[pa.Table], pa.Table], name: str) -> DataFrame:
    """Entries merged by slice; the answers of each chunk in one row."""
    answers = entries.groupBy("slice").applyInArrow(merge, BITS)
    return answers.groupBy("chunk").agg(F.collect_list(F.struct("slice", "bits")).alias(name))


def repeats(docs: DataFrame, finish: Callable[[pa.Table, Windows, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``finish`` applied to each chunk's rows, windows and the windows that occur elsewhere too.
    ``docs`` has its text in the last column."""
    text = docs.columns[-1]
    octets = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = max(LEAST_SLICE, int(octets).bit_length())
    size = _slice(bits)
    slice_bits = bits - size
    chunks = chunked(docs)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(*(c.to_pylist() for c in batch.columns)):
                yield _sketch_entries(chunk, Windows(_rows(blob)[text]), bits, size)

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob, answers in zip(*(c.to_pylist() for c in batch.columns)):
                w = Windows(_rows(blob)[text])
                flags = _estimated(w, answers, bits, size)
                yield _Exact(w, flags, slice_bits).entries(chunk)
                yield _emit(chunk, [-1], [np.packbits(flags).tobytes()], "entries")

    def conclude(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob, flags, answers in zip(*(c.to_pylist() for c in batch.columns)):
                rows = _rows(blob)
                w = Windows(rows[text])
                flagged = np.unpackbits(np.frombuffer(flags, np.uint8), count=len(w.h)).astype(bool)
                yield finish(rows, w, _Exact(w, flagged, slice_bits).repeated(answers))

    cells = _returned(chunks.select("chunk", "rows").mapInArrow(sketch, ENTRY), _merge_cells, "answers")
    found = scratch.written(chunks.join(cells, "chunk", "left").select("chunk", "rows", "answers").mapInArrow(estimate, ENTRY), "repeated-windows")
    flags = found.filter(F.col("slice") < 0).select("chunk", F.col("entries").alias("flags"))
    exact = _returned(found.filter(F.col("slice") >= 0), _merge_digests, "answers")
    last = chunks.join(flags, "chunk").join(exact, "chunk", "left").select("chunk", "rows", "flags", "answers")
    return last.mapInArrow(conclude, schema)


def _removed(w: Windows, repeated: np.ndarray) -> np.ndarray:
    return tx.covered(int(w.before[-1]), w.first[repeated], WINDOW)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space."""

    def finish(rows: pa.Table, w: Windows, repeated: np.ndarray) -> pa.RecordBatch:
        gone = _removed(w, repeated)
        upto = np.append(0, np.cumsum(gone))
        n_gone = np.diff(upto[w.before])
        sums = []
        for t, a, b, k in zip(rows["text"], w.before.tolist(), w.before[1:].tolist(), n_gone.tolist()):
            words = (t.as_py() or "").encode().split()
            sums.append(hashlib.sha256(b" ".join(compress(words, ~gone[a:b]) if k else words)).hexdigest())
        ids = rows["doc_id"].combine_chunks()
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(w.before)), pa.array(n_gone), pa.array(sums, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return repeats(rows, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without(text: str, gone: np.ndarray) -> str:
    """``text`` without some of its words.  White space within what is kept stays; where words went,
    there is a line feed if one stood there, else a space."""
    block = tx.Block([text])
    starts, ends, _ = block.words()
    keep = np.flatnonzero(~gone)
    if not len(keep):
        return ""
    cut = np.flatnonzero(np.diff(keep) > 1)
    first, last = keep[np.append(0, cut + 1)], keep[np.append(cut, len(keep) - 1)]
    out, at = [], 0
    for a, b in zip(starts[first].tolist(), ends[last].tolist()):
        if out:
            out.append("\n" if "\n" in text[at:a] else " ")
        out.append(text[a:b])
        at = b
    return "".join(out)


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated words; n_chars, where there is one, follows the text."""
    cols, schema = docs.columns, docs.schema
    order = [c for c in cols if c != "text"] + ["text"]

    def finish(rows: pa.Table, w: Windows, repeated: np.ndarray) -> pa.RecordBatch:
        gone = _removed(w, repeated)
        texts = rows["text"].to_pylist()
        upto = np.append(0, np.cumsum(gone))
        for i in np.flatnonzero(np.diff(upto[w.before])).tolist():
            texts[i] = without(texts[i], gone[w.before[i] : w.before[i + 1]])
        arrays = [rows[c].combine_chunks() for c in order[:-1]] + [pa.array(texts, pa.string())]
        if "n_chars" in order:
            k = order.index("n_chars")
            changed = np.diff(upto[w.before]) > 0
            arrays[k] = pa.array([len(t) if c else n for t, c, n in zip(texts, changed.tolist(), arrays[k].to_pylist())], arrays[k].type)
        return pa.RecordBatch.from_arrays(arrays, order)

    out_schema = ", ".join(f"`{c}` {schema[c].dataType.simpleString()}" for c in order)
    return repeats(docs.select(*order), finish, out_schema).select(*cols)


def op7_count_min_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(scratch.documents(spark, sf_dir))


OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d WHERE len(ws) >= {WINDOW}
), keyed AS (
  SELECT r, i, array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ') AS win FROM win
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY win) AS n FROM keyed) WHERE n > 1
), gone AS (
  SELECT r, list(DISTINCT i + j) AS removed FROM again, range(0, {WINDOW}) AS x(j) GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(removed), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN removed IS NULL THEN ws ELSE
    list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda p: NOT list_contains(removed, p[2])), lambda p: p[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""
