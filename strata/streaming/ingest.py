"""Structured Streaming into a store, and the newest version of each key as streaming state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..store import Store


def into_store(stream: DataFrame, store: Store, checkpoint: str, *, flush_bytes: int | None = None) -> StreamingQuery:
    """Put each micro-batch (key, val, optionally ord) of a stream; flush when the log is large, then
    compact what is due.  Everything available is taken in, then the query ends."""
    limit = flush_bytes or store.options.memtable_size

    def batch(df: DataFrame, _: int) -> None:
        store.put(df)
        if sum(f.bytes for f in store.now.level(-1)) >= limit:
            store.flush()
            store.compact()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_stream(stream: DataFrame) -> DataFrame:
    """Streaming newest version of each key (key, val, seq), for complete or update output."""
    newest = F.max_by(F.struct("val", "seq"), F.col("seq"))
    return stream.groupBy("key").agg(newest.alias("_v")).select("key", "_v.val", "_v.seq")
