"""The engine: an append-only log, sorted tables in levels, newest-wins reads and compaction.

    store = Store.open(spark, path)
    store.put(df)             # key, val (and ord, if rows of one batch may share a key)
    store.get(keys), store.scan(low, high), store.flush(), store.compact()

Writes become durable with the manifest commit that names their segment.  Tables of level 1 and
deeper are written by key range, so their ranges are disjoint.  A flush or a compaction never
changes what ``get`` and ``scan`` return.  One store object may be used by several threads.
"""

from __future__ import annotations

import threading
import time
import uuid
from bisect import bisect_left
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .functions.codec import record_size
from .operators import ranges, resolve
from .options import Options
from .plans import planner
from .sources.manifest import LOG, File, Manifest, Snapshot, Storage

ENTRY = "key string, val string, seq bigint"
#: Keys asked for at once up to which they are part of the scan's filter, so that files, row groups and
#: Parquet's Bloom filters are asked for each; beyond, files are asked for each and row groups for the keys' hull.
PUSHED_KEYS = 1000
#: Values of one IN that Spark pushes to Parquet value by value (the default of its threshold).
IN_VALUES = 10


def _one_of(keys: list[str]) -> Column:
    """key IN keys, as a balanced OR of INs short enough to be pushed down."""
    tests = [F.col("key").isin(keys[k : k + IN_VALUES]) for k in range(0, len(keys), IN_VALUES)]
    while len(tests) > 1:
        tests = [reduce(Column.__or__, tests[k : k + 2]) for k in range(0, len(tests), 2)]
    return tests[0]


def _print() -> Column:
    """What the checksum of a table is summed from: a hash of each entry."""
    return F.bit_xor(F.xxhash64("key", "val", "seq"))


class Store:
    def __init__(self, spark: SparkSession, path: str, options: Options | None = None):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options or Options()
        self.storage = Storage(spark, self.path)
        self.manifest = Manifest(self.storage)
        self.busy: dict[str, planner.Plan] = {}  # compactions in flight
        self._writing = threading.Lock()
        present = {name for name, _ in self.storage.walk("data")}
        if missing := [f.path for f in self.now.files if f.path not in present]:
            raise FileNotFoundError(f"files that the manifest names are missing: {missing}")

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None) -> Store:
        """Open or create a store.  A file that the manifest names and is missing is an error.  Files that
        it does not name stay (they may be a writer's that has not committed yet) until ``vacuum``."""
        return cls(spark, path, options)

    @property
    def now(self) -> Snapshot:
        return self.manifest.now

    def _write(self, df: DataFrame, level: int) -> list[File]:
        """Write entries and describe the files, from one pass over what was written.  Null keys count
        in ``rows`` only."""
        batch = f"data/{uuid.uuid4().hex}"
        out = df.select("key", "val", "seq").write
        if self.options.bloom_false_positive > 0:
            out = out.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(self.options.bloom_false_positive))
        out.parquet(f"{self.path}/{batch}")
        rows = self.spark.read.schema(ENTRY).parquet(f"{self.path}/{batch}").groupBy(F.col("_metadata.file_name").alias("name"))
        size = F.sum(record_size(F.col("key"), F.col("val")))
        named = {"a": F.min("key"), "b": F.max("key"), "n": F.count("*"), "keys": F.count("key"), "bytes": size, "s": F.min("seq"), "e": F.max("seq"), "print": _print()}
        stats = rows.agg(*[c.alias(name) for name, c in named.items()]).collect()  # a row a file
        if any(r["keys"] < r.n or not r.a for r in stats):
            self.storage.delete(batch)
            raise ValueError("a key is null or empty")
        when = time.time()
        return [File(0, level, f"{batch}/{r.name}", r.a, r.b, r.n, r.bytes, r.s, r.e, when, r.print) for r in sorted(stats, key=lambda r: (r.a, r.name))]

    def _read(self, files: list[File]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(*[f"{self.path}/{f.path}" for f in files])

    def put(self, entries: DataFrame) -> Snapshot:
        """Append entries (key, val, optionally ord).  Of equal keys in a batch the one with the largest ord
        wins; without ord, the last in the frame's order.  Null and empty keys are refused; a null value
        deletes, as an empty one does.  Rows are written once; whole-number ords become sequence numbers as
        they are, from the smallest on, others (and no ord) by the place of the row."""
        with self._writing:
            base = self.now.next_seq
            place = F.monotonically_increasing_id()
            rows = entries
            if "ord" in entries.columns and isinstance(entries.schema["ord"].dataType, IntegralType):
                least = entries.agg(F.min("ord")).first()[0]
                place = F.coalesce(F.col("ord").cast("long") - F.lit(least or 0), F.lit(-1).cast("long")) + 1
            elif "ord" in entries.columns:
                n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
                rows = entries.repartitionByRange(n, "ord").sortWithinPartitions("ord")
            cols = [F.col("key").cast("string").alias("key"), F.coalesce(F.col("val").cast("string"), F.lit("")).alias("val")]
            files = self._write(rows.select(*cols, (place + F.lit(base)).alias("seq")), LOG)
            if not files:
                return self.now
            return self.manifest.commit(files, [], next_seq=max(f.max_seq for f in files) + 1)

    def delete(self, keys: DataFrame) -> Snapshot:
        return self.put(keys.select("key", F.lit("").alias("val")))

    def entries(self, low: str | None = None, high: str | None = None, *, version: int | None = None) -> DataFrame:
        """All versions of all keys in files whose key range meets low..high."""
        snapshot = self.now if version is None else self.manifest.at(version)
        return self._read([f for f in snapshot.files if f.overlaps(low, high)])

    def get(self, keys: DataFrame | list[str], *, raw: bool = False) -> DataFrame:
        """key, val, seq of the newest versions.  Only files whose range holds one of the keys are read.  Up to
        ``PUSHED_KEYS`` keys, the scan is filtered by the keys themselves; more, however many, are joined with what
        the scan finds between the smallest and the largest of them."""
        if isinstance(keys, list):
            keys = self.spark.createDataFrame([(k,) for k in keys], "key string")
        few = [r.key for r in keys.select("key").dropna().distinct().limit(PUSHED_KEYS + 1).collect()]
        if not few:
            return self._read([])
        if len(few) <= PUSHED_KEYS:
            few.sort()
            held = [f for f in self.now.files if (i := bisect_left(few, f.min_key)) < len(few) and few[i] <= f.max_key]
            found = resolve.latest(self._read(held).filter(_one_of(few)))
            return found if raw else found.filter(F.col("val") != resolve.TOMBSTONE)
        low, high = keys.agg(F.min("key"), F.max("key")).first()
        return resolve.get(self._read(self._holding(keys, low, high)).filter(F.col("key").between(low, high)), keys, raw=raw)

    def _holding(self, keys: DataFrame, low: str, high: str) -> list[File]:
        """The files whose range holds one of ``keys``, which lie between ``low`` and ``high``.  The keys stay on
        the executors."""
        files = {f.fid: f for f in self.now.files if f.overlaps(low, high)}
        stats = self.spark.createDataFrame([(f.fid, f.min_key, f.max_key) for f in files.values()], "fid bigint, min_key string, max_key string")
        met = ranges.meeting(stats, keys.select("key"), "min_key", "max_key", "key", "key", "left_semi")
        return [files[r.fid] for r in met.select("fid").collect()]  # a row a file

    def scan(self, low: str | None = None, high: str | None = None, *, version: int | None = None) -> DataFrame:
        return resolve.scan(self.entries(low, high, version=version), low, high)

    def flush(self) -> Snapshot:
        """Turn the log into tables of level 0."""
        with self._writing:
            segments = self.now.level(LOG)
            if not segments:
                return self.now
            size = sum(f.bytes for f in segments)
            files = self._write(self._ranged(resolve.latest(self._read(segments)), size, self.options.sstable_size), 0)
            return self.manifest.commit(files, [f.fid for f in segments])

    @staticmethod
    def _ranged(df: DataFrame, size: int, table_size: int) -> DataFrame:
        n = max(1, -(-size // table_size))
        return df.repartitionByRange(n, "key").sortWithinPartitions("key")

    def compact(self, *, force: bool = False) -> bool:
        """Carry out the most urgent compaction that meets none in flight; False if none is due (``force``
        takes the first level that has tables).  A tombstone goes once no older version of its key can be
        left."""
        name = uuid.uuid4().hex
        with self.manifest.lock:
            now = self.now
            plan = planner.choose(now, self.options, force=force, busy=self.busy.values())
            if plan is None:
                return False
            self.busy[name] = plan
        try:
            files = self._write(self._merged(plan, planner.deeper_overlap(now, plan, self.options), now), plan.target)
            with self.manifest.lock:
                self.manifest.commit(files, [f.fid for f in plan.files])
                del self.busy[name]
        finally:
            self.busy.pop(name, None)
        return True

    def _merged(self, plan: planner.Plan, keep: bool, now: Snapshot) -> DataFrame:
        """The newest versions in a plan's files, cut into key ranges that are merged on their own, each from
        the files that meet it, into tables of the target level's size.  Within level 0 they make one table."""
        newest = resolve.latest if keep else resolve.live
        if plan.source == plan.target:
            return newest(self._read(list(plan.files))).repartition(1).sortWithinPartitions("key")
        sizes = [sum(f.bytes for f in now.level(i)) for i in range(self.options.max_level_num)]
        table_size = planner.level_targets(sizes, self.options).table_size(plan.target, self.options)
        parts, bounds = [], [None, *planner.split_points(plan.bottom), None]
        for low, high in zip(bounds, bounds[1:]):
            held = [f for f in plan.files if (low is None or f.max_key > low) and (high is None or f.min_key <= high)]
            rows = self._read(held)
            if low is not None:
                rows = rows.filter(F.col("key") > low)
            if high is not None:
                rows = rows.filter(F.col("key") <= high)
            parts.append(self._ranged(newest(rows), sum(f.bytes for f in held), table_size))
        return reduce(DataFrame.unionByName, parts)

    def compact_all(self, workers: int | None = None) -> int:
        """Carry out all compactions that are due, several at a time where they do not meet; returns how
        many."""
        workers = workers or self.options.num_compactors

        def work(_: int) -> int:
            n = 0
            while self.compact():
                n += 1
            return n

        total = 0
        with ThreadPoolExecutor(workers) as pool:
            while done := sum(pool.map(work, range(workers))):  # what was held up may be due once others end
                total += done
        return total

    def start_compactors(self, workers: int | None = None, tick_s: float = 5.0) -> Compactors:
        """Look for compactions every ``tick_s`` seconds, in threads of the driver, until stopped."""
        return Compactors(self, workers or self.options.num_compactors, tick_s)

    def verify(self) -> DataFrame:
        """path, rows, checksum, ok: of every live file, whether it holds what was written."""
        want = self.spark.createDataFrame([(f.path, f.rows, f.checksum) for f in self.now.files], "path string, rows bigint, checksum bigint")
        name = F.element_at(F.split("path", "/"), -1)
        have = self._read(list(self.now.files))
        if self.now.files:
            have = have.groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("n"), _print().alias("print"))
        else:
            have = self.spark.createDataFrame([], "name string, n bigint, print bigint")
        both = want.join(have, name == F.col("name"), "left")
        ok = F.coalesce((F.col("n") == F.col("rows")) & (F.col("print") == F.col("checksum")), F.lit(False))
        return both.select("path", "rows", "checksum", ok.alias("ok"))

    def vacuum(self, older_than_s: float = 24 * 3600.0) -> int:
        """Remove data files that no retained version names: at once those of versions that are not retained
        any more, and those that no version ever named once they are ``older_than_s`` old, since a writer
        may be about to commit them.  Returns how many."""
        kept = {f.path for s in self.manifest.retained(self.options.keep_versions) for f in s.files}
        known = self.manifest.prune(self.options.keep_versions)
        limit, n = time.time() - older_than_s, 0
        for path, changed in [*self.storage.walk("data")]:
            name = path.rpartition("/")[2]
            if path not in kept and (path in known or changed < limit) and not name.startswith(("_", ".")):
                self.storage.delete(path)
                n += 1
        return n


class Compactors:
    """Threads that compact a store until ``stop``, or the end of a ``with`` block."""

    def __init__(self, store: Store, workers: int, tick_s: float):
        self.store, self.tick_s, self.errors = store, tick_s, []
        self._stop = threading.Event()
        self._threads = [threading.Thread(target=self._run, daemon=True) for _ in range(workers)]
        for t in self._threads:
            t.start()

    def _run(self) -> None:
        while not self._stop.is_set():
            try:
                if self.store.compact():
                    continue
            except Exception as e:  # the next tick tries again; what happened stays to be seen
                self.errors.append(e)
            self._stop.wait(self.tick_s)

    def stop(self) -> None:
        """Let what is under way end, and no more begin."""
        self._stop.set()
        for t in self._threads:
            t.join()

    def __enter__(self) -> Compactors:
        return self

    def __exit__(self, *_) -> None:
        self.stop()
