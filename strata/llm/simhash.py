"""SimHash near-dedup by deletion-variant signatures.

Fingerprints of 64 bits link at ``MOST`` (4) or fewer differing bits.  They are cut into parts, and
segments are made of some of the parts so that two such fingerprints agree in one segment but for at
most one bit: any of 3 parts alone, any 2 of 5, any 3 of 6, or any 4 of 7.  Each distinct fingerprint
is indexed under its segments with one bit left out each; equal keys give candidates, which are
verified.  More parts make more, but rarer keys; the cut follows from the counted fingerprints, so
that chance brings few together (``CHANCE``).  A pair is reported under the first key that it has in
common only.

Keys with more than ``CROWD`` fingerprints (large groups of near copies) are not paired.
Their fingerprints are linked exactly in another way: two fingerprints are within four
bits if and only if some value is within two bits of both, so each is sent to the 2081
values within two bits of it, and those that meet at a value are linked in a star.  At
most 2081 fingerprints can meet there.  That costs a fixed number of rows for each
fingerprint, however many are alike.  Keys that hold more than a thousandth of all index rows as well
are found by counts first, and their rows are never shuffled by key.

Copies have one fingerprint and enter only once.  Null text has no words and fingerprint
zero, as has empty text; null doc_ids are never the smallest (a component with no other has
a null component_id); equal rows fall together; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import resemblance, scratch
from .components import components

SHINGLE = 4
SEED = 42
MOST = 4
#: Parts that fingerprints are cut into, and how many of them make a segment.
CUTS = ((3, 1), (5, 2), (6, 3), (7, 4))
CHANCE = 128  # fingerprints that may meet one under its keys by chance, on average
CROWD = 512
BATCH = 1 << 17
BUCKETS = 1 << 16  # of keys, counted to find those that may be hot


def _hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of a text's shingles, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    words.clear()
    n = max(len(ends) - shingle + 1, 1)
    starts, ends = np.append(0, ends[: n - 1] + 1), ends[-n:]
    out = np.empty(n, np.uint64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, BATCH):
        out[k : k + BATCH] = [digest(joined[a:b], SEED) for a, b in zip(starts[k : k + BATCH].tolist(), ends[k : k + BATCH].tolist())]
    return out


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _majority(groups: list[np.ndarray]) -> np.ndarray:
    """For each group of hashes, the bits set in over half of them.  A large group is counted in parts."""
    counts = np.array([len(g) for g in groups], np.int64)
    total = np.zeros((len(groups), 64), np.int64)
    large = np.flatnonzero(counts > BATCH)
    for i in large.tolist():
        for k in range(0, len(groups[i]), BATCH):
            total[i] += _set_bits(groups[i][k : k + BATCH]).sum(0, dtype=np.int64)
    some = np.flatnonzero((counts > 0) & (counts <= BATCH))
    if len(some):
        begin = np.cumsum(counts[some]) - counts[some]
        total[some] = np.add.reduceat(_set_bits(np.concatenate([groups[i] for i in some.tolist()])), begin, axis=0, dtype=np.int32)
    return np.packbits(2 * total > counts[:, None], axis=1, bitorder="little").view("<u8")[:, 0] if len(groups) else np.zeros(0, np.uint64)


def _prints(texts: pa.Array, shingle: int) -> pa.Array:
    """The fingerprints of a column (as signed longs), a bounded number of shingles at a time."""
    out, held, n = [], [], 0
    for t in texts:
        held.append(_hashes(t.as_py() or "", shingle))
        n += len(held[-1])
        if n > BATCH:
            out.append(_majority(held))
            held, n = [], 0
    out.append(_majority(held))
    return pa.array(np.concatenate(out).view(np.int64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text (its hash; null for null), fp (the fingerprint's bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], _prints(batch.column(2), shingle)], ["doc_id", "text", "fp"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.isNotNull(), F.xxhash64(text)).alias("text"), text.alias("words"))
    return rows.mapInArrow(run, "doc_id long, text long, fp long")


def segments(parts: int, used: int) -> list[int]:
    """The segments of a cut, as masks of their bits."""
    bounds = [64 * k // parts for k in range(parts + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(bounds, bounds[1:])]
    return [sum(chosen) for chosen in combinations(masks, used)]


def chosen_cut(n: int) -> list[int]:
    """The segments for n distinct fingerprints: of the first cut under whose keys few meet by chance, else
    of the last."""
    for cut in CUTS:
        masks = segments(*cut)
        if n * sum(m.bit_count() / 2 ** (m.bit_count() - 1) for m in masks) <= CHANCE:
            break
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(fps: DataFrame, masks: list[int]) -> DataFrame:
    """key, fp: every fingerprint under its one-wildcard segments.  A key's upper 12 bits are its segment and
    wildcard (see ``_first_common``), the others a hash of the bits that are left."""
    places, n = [], 0
    for mask in masks:
        for k in range(64):
            if mask >> k & 1:
                places.append(F.struct(F.lit(_signed((n & 0xFFF) << 52)).alias("place"), F.lit(_signed(mask & ~(1 << k))).alias("mask")))
                n += 1
    each = fps.select("fp", F.explode(F.array(*places)).alias("x"))
    return each.select(F.col("x.place").bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.col("fp").bitwiseAND(F.col("x.mask"))), 12)).alias("key"), "fp")


def _first_common(x: np.ndarray, masks: list[int]) -> np.ndarray:
    """Number of the first segment and wildcard that two fingerprints with these differing bits have in
    common; -1 if none.  Wildcards count from a segment's lowest bit, segments one after another."""
    out = np.full(len(x), -1, np.int64)
    before = sum(m.bit_count() for m in masks)
    for mask in reversed(masks):
        before -= mask.bit_count()
        d = x & np.uint64(mask)
        low = d - (d > 0)  # of a single bit: all below it
        bit = np.where(d > 0, np.bitwise_count(low & np.uint64(mask)), 0).astype(np.int64)
        out = np.where(np.bitwise_count(d) <= 1, before + bit, out)
    return out


def _pairs(key: np.ndarray, fp: np.ndarray, masks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of fingerprints that stand under equal (neighbouring) keys."""
    a, b, at, k = [], [], np.arange(len(key)), 1
    place = (key.view(np.uint64) >> np.uint64(52)).astype(np.int64)
    while len(at):
        at = at[at + k < len(key)]
        at = at[key[at] == key[at + k]]
        x = fp[at] ^ fp[at + k]
        near = np.flatnonzero(np.bitwise_count(x) <= MOST)
        good = at[near[_first_common(x[near], masks) == place[at[near]]]]
        a.append(fp[good])
        b.append(fp[good + k])
        k += 1
    return np.concatenate(a or [fp[:0]]), np.concatenate(b or [fp[:0]])


def _linked(batches: Iterator[pa.RecordBatch], masks: list[int]) -> Iterator[pa.RecordBatch]:
    """From rows in order of key: pairs (a, b), and (a, null) for each fingerprint of a crowded key."""

    def rows(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        other = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), other], ["a", "b"])

    key, fp, crowded = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

    def settled(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        crowd = np.repeat(np.diff(np.append(cut, len(key))) > CROWD, np.diff(np.append(cut, len(key))))
        if crowd.any():
            yield rows(np.unique(fp[crowd]), None)
        yield rows(*_pairs(key[~crowd], fp[~crowd], masks))

    for batch in batches:
        k, f = (c.to_numpy() for c in batch.columns)
        if crowded is not None:
            n = int(np.searchsorted(k, crowded, "right"))
            if n:
                yield rows(np.unique(f[:n].view(np.uint64)), None)
            k, f = k[n:], f[n:]
            if not len(k):
                continue
            crowded = None
        key, fp = np.concatenate([key, k]), np.concatenate([fp, f.view(np.uint64)])
        last = int(np.searchsorted(key, key[-1]))
        yield from settled(key[:last], fp[:last])
        key, fp = key[last:], fp[last:]
        if len(key) > CROWD:
            yield rows(np.unique(fp), None)
            crowded = key[0]
            key, fp = key[:0], fp[:0]
    if len(key):
        yield from settled(key, fp)


def _ball() -> np.ndarray:
    one = [1 << k for k in range(64)]
    return np.array([0, *one, *(a | b for a, b in combinations(one, 2))], np.uint64)


def _met(crowd: DataFrame) -> DataFrame:
    """a, b: stars of the fingerprints within two bits of one value."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = _ball()
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(fp), 64):
                part = fp[k : k + 64]
                mid = (part[:, None] ^ ball).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(mid.view(np.int64)), pa.array(np.repeat(part, len(ball)).view(np.int64))], ["mid", "fp"])

    n = int(crowd.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stars = crowd.repartition(n).mapInArrow(spread, "mid long, fp long").groupBy("mid").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"))
    return stars.filter(F.size("all") > 1).select("a", F.explode("all").alias("b")).filter(F.col("a") != F.col("b")).distinct()


def _hot_keys(index: DataFrame, total: int) -> DataFrame:
    """key: those of more rows than ``CROWD`` and than a thousandth of all, so fewer than a thousand.  Buckets
    of keys are counted first; only the keys of buckets above the limit, which no hot key can be outside of, are
    counted one by one."""
    least = max(CROWD, total // scratch.COMMON)
    placed = index.withColumn("bucket", F.col("key").bitwiseAND(BUCKETS - 1))
    large = placed.groupBy("bucket").count().filter(F.col("count") > least).select("bucket")
    keys = placed.join(F.broadcast(large), "bucket", "left_semi").groupBy("key").count()
    return scratch.written(keys.filter(F.col("count") > least).select("key"), "simhash-hot")


def links(fps: DataFrame) -> DataFrame:
    """Edges a, b between distinct fingerprints whose components are those of all links."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fps = scratch.written(fps.select("fp").distinct(), "simhash-distinct")
    count = fps.count()
    masks = chosen_cut(count)
    index = variants(fps, masks)
    hot = F.broadcast(_hot_keys(index, count * sum(m.bit_count() for m in masks)))
    rest = index.join(hot, "key", "left_anti").repartition(n, "key").sortWithinPartitions("key")
    found = scratch.written(rest.mapInArrow(lambda batches: _linked(batches, masks), "a long, b long"), "simhash-links")
    crowd = found.filter(F.col("b").isNull()).select(F.col("a").alias("fp")).unionByName(index.join(hot, "key", "left_semi").select("fp"))
    crowd = scratch.written(crowd.distinct(), "simhash-crowd")
    pairs = found.filter(F.col("b").isNotNull())
    return pairs if crowd.isEmpty() else pairs.unionByName(_met(crowd))


def near_duplicates(docs: DataFrame, jaccard: float | None = None, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, root (the component's smallest fingerprint), component_id of every row.  With
    ``jaccard``, texts whose sets of ``resemblance.SHINGLE``-word shingles have that Jaccard resemblance or
    more are linked too, however many bits their fingerprints differ in."""
    fps = scratch.written(fingerprints(docs, shingle), "simhash-fingerprints")
    roots = scratch.written(components(links(fps)), "simhash-roots")
    if jaccard is not None:
        texts = fps.filter("text IS NOT NULL").select("text", F.col("fp").alias("node")).distinct()
        each = texts.join(roots, "node", "left")
        each = scratch.written(each.select("text", F.coalesce("root", "node").alias("root")), "simhash-texts")
        more = scratch.written(resemblance.links(docs, each, _hashes, jaccard), "simhash-resemblance")
        roots = scratch.written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "simhash-roots")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("many"))
    linked = least.join(roots.withColumnRenamed("node", "fp"), "fp")
    of_root = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("many"))
    moved = scratch.joined(linked.select("fp", "root"), of_root, "root", roots.count())
    each = least.join(moved, "fp", "left")
    each = each.select("fp", "many", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    each = scratch.written(each, "simhash-each")
    return scratch.joined(fps, each, "fp", fps.count()).select("doc_id", "fp", "root", "component_id")


def deduplicated(docs: DataFrame, jaccard: float | None = None, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each group of near copies (see ``near_duplicates``): that with the
    smallest doc_id.  Where several rows share that id, or none of the group has one, the row with the
    smallest hash of its values."""
    cols = docs.columns
    found = scratch.written(near_duplicates(docs, jaccard, shingle), "simhash-groups")
    several = scratch.written(found.groupBy("doc_id").count().filter((F.col("count") > 1) | F.col("doc_id").isNull()).select("doc_id"), "simhash-several")
    first = found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").join(several, "doc_id", "left_anti")
    once = docs.join(first, "doc_id", "left_semi").select(*cols)
    if several.isEmpty():
        return once
    # Rows whose id repeats or is null: few, if any.  They find their group by id and fingerprint.
    fp, root, place, own, mark = scratch.fresh(docs, "_fp", "_root", "_place", "_id", "_print")
    odd = docs.join(several.select(F.col("doc_id").alias(own)), docs["doc_id"].eqNullSafe(F.col(own)), "left_semi").select(*cols)
    groups = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(own), F.col("fp").alias(mark), F.col("root").alias(root)).distinct()
    mine = _with_fingerprint(odd, fp, shingle).join(groups, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(fp) == F.col(mark))).select(*cols, root)
    order = Window.partitionBy(root).orderBy(F.xxhash64(*cols), "text")
    return once.unionByName(mine.withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).select(*cols))


def _with_fingerprint(docs: DataFrame, name: str, shingle: int) -> DataFrame:
    """``docs`` with their fingerprints in column ``name``."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _prints(batch.column(at), shingle)], [*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{name}` long")


def op5_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(scratch.documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
