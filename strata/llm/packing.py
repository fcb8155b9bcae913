"""Packing documents into training sequences by shortest-pack-first over the length histogram.

Each document (its ids and an end id) is cut into full sequences and one rest.  The
histogram of piece lengths (at most ``size`` numbers, however many documents) is packed
on the driver: lengths are placed longest first, each into the packs with the least
filling so far, and packs with one pattern are only counted.  Pieces are then ranked
within their length, and a pattern's slots take ranges of ranks.

Null text counts as empty, so every row gives at least its end id; rows with one doc_id,
also equal rows, are packed each on its own (equal pieces are interchangeable); null
doc_ids are kept; an empty table gives no rows.  A special token's string in a text gives that
token's id (see ``tokens``).  Other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch, tokens

SIZE = 2048
END = 1
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def shortest_pack_first(counts: dict[int, int], size: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns and how many packs have each.  A pattern is runs (length, how many in a row)."""
    heap: list[tuple[int, int, tuple]] = []  # filling, age, pattern: the least filled first
    number: dict[tuple, int] = {}
    age = 0

    def put(pattern: tuple, filled: int, n: int) -> None:
        nonlocal age
        if pattern in number:
            number[pattern] += n
        else:
            number[pattern] = n
            heapq.heappush(heap, (filled, age, pattern))
            age += 1

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not heap or heap[0][0] + length > size:
                per = size // length if left * length > size else 1
                n = max(left // per, 1) if per > 1 else left
                per = min(per, left)
                put(((length, per),), per * length, n)
                left -= n * per
                continue
            filled, _, pattern = heapq.heappop(heap)
            have = number.pop(pattern)
            take = min(have, left)
            *before, last = pattern
            longer = (*before, (length, last[1] + 1)) if last[0] == length else (*pattern, (length, 1))
            put(longer, filled + length, take)
            if have > take:
                put(pattern, filled, have - take)
            left -= take
    return sorted(number.items(), reverse=True)


def slots(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[str, np.ndarray]:
    """For each run of each pattern: its length, the first rank it takes, how many in a row, the first
    sequence and the offset there; ordered by length and rank."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for length, per in pattern:
            rows.append((length, taken.get(length, 0), per, sequence, offset))
            taken[length] = taken.get(length, 0) + n * per
            offset += length * per
        sequence += n
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "per", "sequence", "offset"), cols))


def cut(docs: DataFrame, size: int, end_id: int, tokenizer: str) -> DataFrame:
    """The pieces of each document, as ``PIECE``."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, ids, count in tokens.encode_blocks(batch.column(1), tokenizer):
                ids, count = tokens.with_end(ids, count, end_id)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                per = -(-count // size)
                row = np.repeat(np.arange(len(count)), per)
                start = size * (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per))
                length = np.minimum(count[row] - start, size)
                at = (np.cumsum(count) - count)[row] + start
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                doc = batch.column(0).take(pa.array(row + first))
                yield pa.RecordBatch.from_arrays([doc, *(pa.array(x, pa.int64()) for x in (start, length, crc, count[row]))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, PIECE)


def ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with their rank (from 0) among those of one length.  Ranks are counted in buckets, so
    a length that many pieces share is spread over many tasks."""
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = pieces.columns
    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int"))
    before = spread.groupBy("length", "bucket").count()
    before = before.select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*[c for c in cols if c != "length"])) - 1
    return spread.withColumn("within", within).join(before, ["length", "bucket"]).select(*cols, (F.col("within") + F.col("before")).alias("rank"))


def pack(docs: DataFrame, *, size: int = SIZE, end_id: int = END, tokenizer: str | None = None) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with the sequence and offset each goes to."""
    pieces = scratch.written(cut(docs, size, end_id, tokenizer or tokens.default_tokenizer()), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    table = slots(shortest_pack_first(counts, size))
    key = table["length"] << 44 | table["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            k = np.searchsorted(key, length << 44 | rank, "right") - 1
            step = rank - table["rank"][k]
            sequence = table["sequence"][k] + step // table["per"][k]
            offset = table["offset"][k] + step % table["per"][k] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked(pieces).mapInArrow(place, PIECE + ", sequence_id long, offset long")


def op3_pack_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(scratch.documents(spark, sf_dir))
