"""Reading versions of keys: newest wins, empty value is a tombstone.

Entries are rows (key, val, seq); seq is unique within a key.  ``max_by`` plans as partial and
final aggregation, so a key with very many versions is reduced before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import common_prefix, octets, record_size
from ..sources.shared import written
from .ranges import meeting

TOMBSTONE = ""
#: Keys looked up at once up to which they are broadcast (a probe is a short string).
BROADCAST_KEYS = 100_000


def latest(entries: DataFrame, *by: str) -> DataFrame:
    """The newest version of each key (within each ``by``), tombstones included."""
    newest = F.max_by(F.struct("val", "seq"), F.col("seq"))
    return entries.groupBy(*by, "key").agg(newest.alias("_v")).select(*by, "key", "_v.val", "_v.seq")


def live(entries: DataFrame) -> DataFrame:
    """The newest version of each key that is not deleted."""
    return latest(entries).filter(F.col("val") != TOMBSTONE)


def asked_for(entries: DataFrame, keys: DataFrame, newest: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``newest`` of the entries whose key is asked for.  Few keys are broadcast and met first; many meet
    what is left when each key has been reduced to a row, so a key of very many versions is no burden."""
    keys = keys.select("key").distinct()
    if keys.count() <= BROADCAST_KEYS:
        return newest(entries.join(F.broadcast(keys), "key", "left_semi"))
    return newest(entries).join(keys, "key", "left_semi")


def get(entries: DataFrame, keys: DataFrame, *, raw: bool = False) -> DataFrame:
    """Newest versions of the keys asked for; ``raw`` shows tombstones."""
    found = asked_for(entries, keys, latest)
    return found if raw else found.filter(F.col("val") != TOMBSTONE)


def get_or_null(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """One row for each key asked for; val is null if there is none."""
    return keys.select("key").distinct().join(get(entries, keys).select("key", "val"), "key", "left")


def scan(entries: DataFrame, low: str | None = None, high: str | None = None) -> DataFrame:
    """Live entries with low <= key <= high.  The bounds are applied before anything is merged, so they
    reach the files' statistics."""
    if low is not None:
        entries = entries.filter(F.col("key") >= low)
    if high is not None:
        entries = entries.filter(F.col("key") <= high)
    return live(entries)


def merged(inputs: list[DataFrame]) -> DataFrame:
    """All versions from several inputs; version counts from 1, the newest, within each key.  Entries are
    laid out by key and age, so the versions of a key that has very many lie in several parts; what
    comes before a part within its key is counted, a row for each key and part that it shares."""
    every = reduce(DataFrame.unionByName, inputs)
    n = int(every.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = every.repartitionByRange(n, "key", F.desc("seq")).withColumn("part", F.spark_partition_id())
    laid = written(laid, "merge")
    counts = laid.groupBy("key", "part").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shared = counts.withColumn("earlier", earlier).filter("earlier > 0").select("key", "part", "earlier")  # fewer rows than parts
    within = F.row_number().over(Window.partitionBy("key", "part").orderBy(F.desc("seq")))
    out = laid.withColumn("within", within).join(F.broadcast(shared), ["key", "part"], "left")
    return out.select(*every.columns, (F.col("within") + F.coalesce("earlier", F.lit(0))).alias("version"))


def first_last(entries: DataFrame, *by: str) -> DataFrame:
    """First and last entry in key order of each group."""
    e = F.struct("key", "val")
    return entries.groupBy(*by).agg(F.min_by(e, "key").alias("a"), F.max_by(e, "key").alias("b")).select(*by, F.col("a.key").alias("first_key"), F.col("a.val").alias("first_val"), F.col("b.key").alias("last_key"), F.col("b.val").alias("last_val"))


def segment_stats(entries: DataFrame) -> DataFrame:
    """Entries and log bytes of each segment (fid)."""
    return entries.groupBy("fid").agg(F.count("*").alias("entries"), F.sum(record_size(F.col("key"), F.col("val"))).alias("wal_bytes"), F.sum(octets(F.col("key")) + octets(F.col("val")) + 8).alias("estimate"))


def table_stats(entries: DataFrame) -> DataFrame:
    """Smallest and largest key, rows and payload bytes of each table (fid)."""
    return entries.groupBy("fid").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("num_rows"), F.sum(octets(F.col("key")) + octets(F.col("val"))).alias("bytes"))


def pending(entries: DataFrame, manifest: DataFrame) -> DataFrame:
    """Entries of log segments that no table in ``manifest`` (fid) holds yet."""
    return entries.join(manifest.select("fid").distinct(), "fid", "left_anti")


def block_index(entries: DataFrame, per_block: int) -> DataFrame:
    """Sparse index of sorted tables (fid): blocks of ``per_block`` entries with base key, entries,
    bytes and offset."""
    w = Window.partitionBy("fid").orderBy("key")
    rows = entries.withColumn("block", ((F.row_number().over(w) - 1) / per_block).cast("bigint"))
    blocks = rows.groupBy("fid", "block").agg(F.min("key").alias("base_key"), F.count("*").alias("n"), F.sum(octets(F.col("key")) + octets(F.col("val")) + 4).alias("len"))
    return blocks.withColumn("offset", F.sum("len").over(Window.partitionBy("fid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).fillna({"offset": 0})


BLOCK = "fid bigint, block bigint, base_key string, n bigint, len bigint"
HEADER, OFFSET, TAIL = 4, 4, 16  # bytes of an entry's header, of its offset, and of a block's own fields


def cut_blocks(entries: DataFrame, block_size: int) -> DataFrame:
    """Blocks of sorted tables (fid) as they fill up: an entry begins a new block if the block with it would
    take more than ``block_size`` bytes (its key counted whole; in the block, keys are kept as what
    they add to the block's first).  fid, block, base_key, n entries, len bytes of entries.  One pass
    over each table in order of key, with one block in memory."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, base, n, size = None, 0, b"", 0, 0
        out: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                cols = zip(*out)
                types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["fid", "block", "base_key", "n", "len"])
                out.clear()

        for batch in batches:
            for fid, key, val in zip(*(c.to_pylist() for c in batch.columns)):
                if n and (fid != now or size + HEADER + len(key) + val + (n + 1) * OFFSET + TAIL > block_size):
                    out.append((now, block, base.decode(), n, size))
                    block, n, size = block + 1, 0, 0
                if fid != now:
                    now, block = fid, 0
                if not n:
                    base = key
                same = 0
                if n:
                    same = next((i for i, (x, y) in enumerate(zip(key, base)) if x != y), min(len(key), len(base)))
                size += HEADER + len(key) - same + val
                n += 1
            yield from flush()
        if n:
            out.append((now, block, base.decode(), n, size))
            yield from flush()

    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = entries.select(F.col("fid").cast("bigint").alias("fid"), F.col("key").cast("binary").alias("key"), octets(F.col("val")).alias("val"))
    return rows.repartition(parts, "fid").sortWithinPartitions("fid", "key").mapInArrow(fold, BLOCK)


def rolled(blocks: DataFrame, table_size: int) -> DataFrame:
    """fid, block, full: after which block a table has reached its capacity (the bytes of the blocks up to it
    are more than ``table_size``)."""
    so_far = F.sum("len").over(Window.partitionBy("fid").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    return blocks.select("fid", "block", (so_far > table_size).alias("full"))


def prefix_delta(entries: DataFrame, per_block: int) -> DataFrame:
    """Each key as its overlap with its block's base key and the rest (``fid`` partitions the tables)."""
    w = Window.partitionBy("fid").orderBy("key")
    rows = entries.withColumn("block", ((F.row_number().over(w) - 1) / per_block).cast("bigint"))
    rows = rows.withColumn("base_key", F.min("key").over(Window.partitionBy("fid", "block")))
    rows = rows.withColumn("overlap", common_prefix(F.col("key"), F.col("base_key")))
    return rows.select("fid", "block", "key", "base_key", "overlap", F.expr("substring(key, overlap + 1)").alias("diff"))


def prefix_decode(deltas: DataFrame) -> DataFrame:
    """Keys rebuilt from base key, overlap and rest."""
    return deltas.withColumn("decoded", F.concat(F.expr("left(base_key, overlap)"), "diff"))


def floor_seek(probes: DataFrame, index: DataFrame) -> DataFrame:
    """For each key of ``probes`` the largest base_key of ``index`` that is not above it, null if none.

    Both are laid out in ranges of the key; each range fills forward on its own, and what comes into
    a range from those below is the largest base key there (one row a range)."""
    n = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = probes.select("key", F.lit(1).alias("asks")).distinct().unionByName(index.select(F.col("base_key").alias("key"), F.lit(0).alias("asks")).distinct())
    laid = written(both.repartitionByRange(n, "key").withColumn("part", F.spark_partition_id()), "floor-seek")
    base = F.when(F.col("asks") == 0, F.col("key"))
    tops = laid.groupBy("part").agg(F.max(base).alias("top"))
    into = tops.select("part", F.max("top").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("below"))
    within = F.max(base).over(Window.partitionBy("part").orderBy("key", "asks").rowsBetween(Window.unboundedPreceding, 0))
    return laid.withColumn("floor", within).filter("asks = 1").join(F.broadcast(into), "part").select("key", F.coalesce("floor", "below").alias("base_key"))


def newest_hit(keys: DataFrame, tables: DataFrame) -> DataFrame:
    """For each key the newest table (fid) that has it, with its newest value there."""
    best = F.max_by(F.struct("fid", "val"), F.struct("fid", "seq"))
    return asked_for(tables, keys, lambda t: t.groupBy("key").agg(best.alias("b")).select("key", "b.fid", "b.val"))


def candidate_tables(keys: DataFrame, stats: DataFrame) -> DataFrame:
    """Tables whose key range holds each key.  ``stats`` is file-level metadata (a row a file)."""
    asked = keys.select("key").distinct()
    return meeting(asked, stats.select("fid", "min_key", "max_key"), "key", "key", "min_key", "max_key").select("key", "fid")
