"""Near copies by the Jaccard resemblance of their word shingles.

``BANDS`` keys of ``ROWS`` MinHash values each give candidates, and every candidate is verified
on the two whole sets of shingles, so no pair below the limit is linked.  A pair at the limit of
0.8 has no key in common with probability (1 - 0.8**5)**28, about 1.5 in 100,000; above it, less.

Under one key the first ``CROWD`` texts are paired in full, and each further one with the
``NEXT`` before it, so that a large group of near copies falls together by rows that grow with its
texts and not with their pairs.  Keys of more texts that then still lie in several groups get the rest:
their texts are dealt to blocks of about ``BLOCK`` shingles, and each two blocks meet in one task, where every
pair of texts of different groups is compared.  That costs time with the square of such a key's texts, but
no link between texts that share a key is lost.  Pairs that are in one group already are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import text as tx
from .components import components

SHINGLE = 5
BANDS, ROWS = 28, 5
CROWD, NEXT = 32, 3
BLOCK = 1 << 19
PART = 1 << 12
#: Candidates up to which their keys are broadcast to the texts (8 bytes each).
BROADCAST_ROWS = 1_000_000
_FACTORS = tx.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def _keys(shingles: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles, one a band."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), PART):
        np.minimum(least, (shingles[k : k + PART] * _FACTORS[:, None]).min(1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = tx.mix(key ^ row)
    return key.view(np.int64)


def _near(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def _pairs(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (key, text, n, root) in order of key: candidates a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place = [np.zeros(0, np.int64)] * 4, np.zeros(0, np.int64)
        for batch in batches:
            old = len(place)
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns)]
            key, text, n, root = held
            new = np.flatnonzero(np.diff(key, prepend=key[:1] - 1) != 0)
            run_of = np.repeat(new, np.diff(np.append(new, len(key))))
            begin = place[0] if old else 0  # of the first run, the rows before those held
            place = np.arange(len(key)) - run_of + np.where(run_of == 0, begin, 0)
            for k in range(1, CROWD):
                at = np.arange(max(old, k), len(key))
                at = at[(key[at] == key[at - k]) & ((place[at] < CROWD) | (k <= NEXT))]
                if not len(at):
                    continue
                few, many = np.minimum(n[at], n[at - k]), np.maximum(n[at], n[at - k])
                at = at[(root[at] != root[at - k]) & (few >= least * many)]
                a, b = text[at], text[at - k]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            last = max(int(np.searchsorted(key, key[-1])) if len(key) else 0, len(key) - CROWD)
            held, place = [h[last:] for h in held], place[last:]

    return run


def _between(least: float) -> Callable[[pa.Table], pa.Table]:
    """From the texts (i, j, block, root, shingles) of two blocks i and j, or of one: edges a, b between their groups
    by all pairs of one text of each block.  Groups that are linked already are not compared again."""

    def run(table: pa.Table) -> pa.Table:
        one, two, block, root = (table.column(c).to_numpy() for c in ("i", "j", "block", "root"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        n = np.array([len(x) for x in sets], np.int64)
        values, ids = np.unique(np.concatenate(sets), return_inverse=True)
        start = np.cumsum(n) - n
        names, group = np.unique(root, return_inverse=True)
        label, mark, a, b = np.arange(len(names)), np.zeros(len(values), bool), [], []
        left, right = np.flatnonzero(block == one[0]), np.flatnonzero(block == two[0])
        for x in left.tolist():
            others = right if one[0] != two[0] else right[right > x]
            others = others[label[group[others]] != label[group[x]]]
            others = others[np.minimum(n[others], n[x]) >= least * np.maximum(n[others], n[x])]
            if not len(others):
                continue
            own = ids[start[x] : start[x] + n[x]]
            mark[own] = True
            held = mark[ids[tx.ragged(start[others], n[others])]].astype(np.int64)
            mark[own] = False
            both = np.add.reduceat(held, np.cumsum(n[others]) - n[others])
            for y in np.unique(group[others[both >= least * (n[x] + n[others] - both)]]).tolist():
                if label[y] != label[group[x]]:
                    a.append(int(names[group[x]]))
                    b.append(int(names[y]))
                    label[label == label[y]] = label[group[x]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _rest(rows: DataFrame, linked: DataFrame, sets_of: Callable[[DataFrame], DataFrame], least: float) -> DataFrame | None:
    """Edges a, b by the pairs that ``_pairs`` has not formed from ``rows`` (key, text, n, root), beside those ``linked``
    already; None if no key leaves any."""

    def several(rows: DataFrame) -> DataFrame:
        keys = rows.groupBy("key").agg(F.count("*").alias("many"), F.min("root").alias("x"), F.max("root").alias("y"), F.sum("n").alias("shingles"))
        parts = F.ceil(F.col("shingles") / BLOCK)
        return scratch.written(keys.filter((F.col("many") > CROWD) & (F.col("x") != F.col("y"))).select("key", parts.alias("parts")), "resemblance-crowds")

    crowds = several(rows)
    if crowds.isEmpty():
        return None
    now = components(linked, "resemblance-groups").select(F.col("node").alias("root"), F.col("root").alias("group"))
    held = rows.join(crowds.select("key"), "key", "left_semi").join(now, "root", "left")
    held = scratch.written(held.select("key", "text", "n", F.coalesce("group", "root").alias("root")), "resemblance-crowded")
    crowds = several(held)
    if crowds.isEmpty():
        return None
    held = held.join(crowds, "key").withColumn("block", F.pmod(F.xxhash64("text"), "parts"))
    sets = sets_of(held.select("text").distinct())
    met = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = met.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "text", "root")
    return met.join(sets, "text").drop("text").groupBy("key", "i", "j").applyInArrow(_between(least), "a long, b long").distinct()


def links(docs: DataFrame, roots: DataFrame, hashes: Callable[[str, int], np.ndarray], least: float) -> DataFrame:
    """Edges a, b between the groups of texts of which two resemble each other by ``least`` or more.
    ``roots`` has the hash (text) of every text and its group (root) so far; ``hashes`` gives a text's shingles."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("text").cast("string").alias("words")).select(F.xxhash64("words").alias("text"), "words").filter("words IS NOT NULL")

    def shingles(t: str) -> np.ndarray:
        return np.unique(hashes(t, SHINGLE))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = [], []
            for t in batch.column(1):
                s = shingles(t.as_py())
                sizes.append(len(s))
                keys.append(_keys(s) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["text", "n", "keys"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, t in zip(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array([row.as_py()], pa.int64()), pa.array([shingles(t.as_py()).tobytes()], pa.binary())], ["text", "shingles"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [_near(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), least) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def sets_of(own: DataFrame) -> DataFrame:
        own = scratch.written(own, "resemblance-texts")
        wanted = F.broadcast(own) if own.count() <= BROADCAST_ROWS else own
        sets = texts.join(wanted, "text", "left_semi").mapInArrow(whole, "text long, shingles binary").groupBy("text").agg(F.first("shingles").alias("shingles"))
        return scratch.written(sets, "resemblance-sets")

    # Copies are merged in partial sums, so that a large group of them is never gathered.
    sketches = texts.mapInArrow(sketch, "text long, n long, keys array<long>").groupBy("text").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    sketches = scratch.written(sketches.join(roots, "text"), "resemblance-sketches")
    rows = sketches.select(F.explode("keys").alias("key"), "text", "n", "root")
    found = rows.repartition(parts, "key").sortWithinPartitions("key", "text").mapInArrow(_pairs(least), "a long, b long").distinct()
    found = scratch.written(found, "resemblance-candidates")
    sets = sets_of(found.select(F.explode(F.array("a", "b")).alias("text")).distinct())
    both = found.join(sets.withColumnsRenamed({"text": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"text": "b", "shingles": "y"}), "b")
    good = both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")
    of = roots.select(F.col("text").alias("a"), F.col("root").alias("root_a")), roots.select(F.col("text").alias("b"), F.col("root").alias("root_b"))
    linked = scratch.written(good.join(of[0], "a").join(of[1], "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "resemblance-links")
    rest = _rest(rows, linked, sets_of, least)
    return linked if rest is None else linked.unionByName(rest)
