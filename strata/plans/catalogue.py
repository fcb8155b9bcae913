"""A query for each operator, over the driver's tables, and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import bloom, ranges, resolve
from ..options import Options
from ..sources import manifest, wal
from ..sources.shared import new_path
from ..store import Store
from ..streaming import ingest
from . import planner
from .fixtures import SQL, changes, kv_customers, kv_events, kv_orders, kv_parts, level_tables, order_tables, sst_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OPTIONS = Options(memtable_size=16_384, num_level_zero_tables=1, base_level_size=8_192)
PER_BLOCK = 64


def query(sql: str | None = None, *tables: str):
    """Register a query with its SQL, which may use the fixtures named."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = ("WITH RECURSIVE " + ", ".join(SQL[t] for t in tables) + "\n" if tables else "") + sql
        return f

    return register


EVENTS = ("kv_events", "latest_events")
SST = ("kv_events", "sst_events", "stats_events")
#: Keys to look up: those of a whole table, some of which are there and some not.
ASKED = "SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("key"))


# Reading


@query("SELECT key, val, seq FROM latest_events", *EVENTS)
def kv_latest(spark, d):
    return resolve.latest(kv_events(spark, d))


@query("SELECT key, val, seq FROM latest_events WHERE val <> ''", *EVENTS)
def kv_compact(spark, d):
    return resolve.live(kv_events(spark, d))


@query(f"SELECT key, val, seq FROM latest_events WHERE val <> '' AND key IN ({ASKED})", *EVENTS)
def kv_get(spark, d):
    return resolve.get(kv_events(spark, d), _asked(spark, d))


@query(f"SELECT a.key, l.val FROM ({ASKED}) a LEFT JOIN (SELECT * FROM latest_events WHERE val <> '') l USING (key)", *EVENTS)
def kv_get_missing(spark, d):
    return resolve.get_or_null(kv_events(spark, d), _asked(spark, d))


@query(f"SELECT key, val, seq FROM latest_events WHERE key IN ({ASKED})", *EVENTS)
def kv_raw_get(spark, d):
    return resolve.get(kv_events(spark, d), _asked(spark, d), raw=True)


@query("SELECT key, val, seq FROM latest_events WHERE val <> '' AND key >= '12' AND key <= '5'", *EVENTS)
def kv_scan_range(spark, d):
    return resolve.scan(kv_events(spark, d), "12", "5")


@query("SELECT key, val, seq, fid, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS version FROM sst_events", "kv_events", "sst_events")
def kv_merge_all_versions(spark, d):
    s = sst_events(spark, d)
    return resolve.merged([s.filter("fid % 2 = 0"), s.filter("fid % 2 = 1")]).withColumn("version", F.col("version").cast("bigint"))


@query("SELECT seq // 500 AS fid, min(key) AS first_key, arg_min(val, key) AS first_val, max(key) AS last_key, arg_max(val, key) AS last_val FROM kv_orders GROUP BY ALL", "kv_orders")
def kv_first_last(spark, d):
    return resolve.first_last(kv_orders(spark, d).withColumn("fid", F.expr("seq div 500")), "fid")


@query(f"SELECT key, fid, val FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY fid DESC, seq DESC) AS n FROM sst_events WHERE key IN ({ASKED})) WHERE n = 1", "kv_events", "sst_events")
def l0_search(spark, d):
    return resolve.newest_hit(_asked(spark, d), sst_events(spark, d))


@query(f"SELECT a.key, t.fid FROM ({ASKED}) a JOIN order_tables t ON a.key BETWEEN t.min_key AND t.max_key", "kv_orders", "order_tables")
def level_search(spark, d):
    return resolve.candidate_tables(_asked(spark, d), order_tables(spark, d))


# Segments and tables

_VARINT = "CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 WHEN {0} < 268435456 THEN 4 ELSE 5 END"
_KL, _VL = "octet_length(encode(key))", "octet_length(encode(val))"


@query(f"SELECT fid, count(*) AS entries, CAST(sum({_VARINT.format(_KL)} + {_VARINT.format(_VL)} + {_KL} + {_VL}) AS BIGINT) AS wal_bytes, CAST(sum({_KL} + {_VL} + 8) AS BIGINT) AS estimate FROM sst_events GROUP BY fid", "kv_events", "sst_events")
def memtable_stats(spark, d):
    return resolve.segment_stats(sst_events(spark, d))


@query("SELECT fid, key, val, seq FROM sst_events WHERE fid NOT IN (SELECT fid FROM sst_events WHERE fid % 3 = 0)", "kv_events", "sst_events")
def wal_pending(spark, d):
    s = sst_events(spark, d)
    return resolve.pending(s, s.filter("fid % 3 = 0")).select("fid", "key", "val", "seq")


@query("SELECT fid, key, arg_max(val, seq) AS val, max(seq) AS seq FROM sst_events GROUP BY fid, key", "kv_events", "sst_events")
def flush_dedupe(spark, d):
    return resolve.latest(sst_events(spark, d), "fid")


@query("SELECT fid, min_key, max_key, num_rows, bytes FROM stats_events", *SST)
def sst_stats(spark, d):
    return resolve.table_stats(sst_events(spark, d))


_BLOCKS = f"blocks AS (SELECT seq // 5000 AS fid, key, val, (row_number() OVER (PARTITION BY seq // 5000 ORDER BY key) - 1) // {PER_BLOCK} AS block FROM kv_orders), idx AS (SELECT fid, CAST(block AS BIGINT) AS block, min(key) AS base_key, count(*) AS n, CAST(sum({_KL} + {_VL} + 4) AS BIGINT) AS len FROM blocks GROUP BY ALL)"
SQL["blocks"] = _BLOCKS


def _index(spark, d):
    return resolve.block_index(kv_orders(spark, d).withColumn("fid", F.expr("seq div 5000")), PER_BLOCK)


@query('SELECT *, CAST(coalesce(sum(len) OVER (PARTITION BY fid ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM idx', "kv_orders", "blocks")
def block_index(spark, d):
    return _index(spark, d)


BLOCK_SIZE, TABLE_SIZE = 1024, 4096
# The fold that fills blocks, an entry a step, all tables at once.
SQL["cut"] = f"""ordered AS (
  SELECT seq // 500 AS fid, key, {_KL} AS k, {_VL} AS v, row_number() OVER (PARTITION BY seq // 500 ORDER BY key) AS i FROM kv_orders
), fold AS (
  SELECT fid, i, CAST(0 AS BIGINT) AS block, key AS base_key, CAST(1 AS BIGINT) AS n, CAST(4 + k + v AS BIGINT) AS len FROM ordered WHERE i = 1
  UNION ALL
  SELECT fid, i, CASE WHEN over THEN block + 1 ELSE block END, CASE WHEN over THEN key ELSE base_key END, CASE WHEN over THEN 1 ELSE n + 1 END,
    CASE WHEN over THEN 4 + k + v ELSE len + 4 + k + v - same END
  FROM (
    SELECT o.*, f.block, f.base_key, f.n, f.len, f.len + 4 + o.k + o.v + (f.n + 1) * 4 + 16 > {BLOCK_SIZE} AS over,
      len(list_filter(range(1, length(o.key) + 1), lambda c: left(o.key, c) = left(f.base_key, c))) AS same
    FROM fold f JOIN ordered o ON o.fid = f.fid AND o.i = f.i + 1)
), cut AS (
  SELECT fid, block, base_key, max(n) AS n, max(len) AS len FROM fold GROUP BY ALL
)"""


def _cut(spark, d):
    return resolve.cut_blocks(kv_orders(spark, d).withColumn("fid", F.expr("seq div 500")), BLOCK_SIZE)


@query("SELECT fid, block, base_key, n, len FROM cut", "kv_orders", "cut")
def block_cut(spark, d):
    return _cut(spark, d)


@query(f"SELECT fid, block, sum(len) OVER (PARTITION BY fid ORDER BY block) > {TABLE_SIZE} AS \"full\" FROM cut", "kv_orders", "cut")
def table_capacity(spark, d):
    return resolve.rolled(_cut(spark, d), TABLE_SIZE)


_DELTAS = """deltas AS (
  SELECT *, CAST(len([i FOR i IN range(1, length(key) + 1) IF left(key, i) = left(base_key, i)]) AS INTEGER) AS overlap FROM (
    SELECT *, min(key) OVER (PARTITION BY fid, block) AS base_key FROM (
      SELECT fid, key, CAST((row_number() OVER (PARTITION BY fid ORDER BY key) - 1) // 16 AS BIGINT) AS block FROM kv_parts)))"""
SQL["deltas"] = _DELTAS


@query("SELECT fid, block, key, base_key, overlap, substring(key, overlap + 1) AS diff FROM deltas", "kv_parts", "deltas")
def prefix_delta(spark, d):
    return resolve.prefix_delta(kv_parts(spark, d), 16)


@query("SELECT key, key AS decoded FROM kv_parts", "kv_parts")
def prefix_decode(spark, d):
    return resolve.prefix_decode(resolve.prefix_delta(kv_parts(spark, d), 16)).select("key", "decoded")


@query("SELECT p.key, max(i.base_key) AS base_key FROM (SELECT DISTINCT CAST(c_custkey * 7 AS VARCHAR) AS key FROM customer) p LEFT JOIN idx i ON i.base_key <= p.key GROUP BY p.key", "kv_orders", "blocks")
def floor_seek(spark, d):
    asked = spark.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") * 7).cast("string").alias("key"))
    return resolve.floor_seek(asked, _index(spark, d))


# Bloom filters

PER_KEY = bloom.bits_per_key(0.01)
SQL["shape"] = f"shape AS (SELECT count(*) AS n, {bloom.sizing(0, PER_KEY)[0]} AS k, (greatest(64, count(*) * {PER_KEY}) + 7) // 8 * 8 AS n_bits FROM kv_customers)"
_HASH = "CAST('0x' || substring(md5(key), 1, 8) AS BIGINT)"
SQL["hashed"] = f"""hashed AS (SELECT key, inside, {_HASH} AS h, ({_HASH} >> 17) | (({_HASH} * 32768) & 4294967295) AS delta FROM (
  SELECT key, true AS inside FROM kv_customers UNION ALL SELECT s_name, false FROM supplier UNION ALL SELECT p_name || '#' || p_partkey, false FROM part))"""
SQL["bits"] = "bits AS (SELECT key, inside, ((h + i * delta) & 4294967295) % n_bits AS bit FROM hashed, shape, range(0, k) AS r(i))"
BLOOM = ("kv_customers", "shape", "hashed", "bits")


def _filter(spark, d):
    """The filter of all customers' names."""
    return bloom.build(kv_customers(spark, d).select("key"), PER_KEY)


@query("SELECT DISTINCT CAST(bit AS BIGINT) AS bit FROM bits WHERE inside", *BLOOM)
def bloom_bits(spark, d):
    return _filter(spark, d)[0]


@query("SELECT key, bool_and(bit IN (SELECT bit FROM bits WHERE inside)) AS may_contain FROM bits GROUP BY key", *BLOOM)
def bloom_probe(spark, d):
    """Asked for customers, who are all in it, and for suppliers and parts, who are not."""
    bits, k, n_bits = _filter(spark, d)
    suppliers = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_name").alias("key"))
    asked = kv_customers(spark, d).select("key").unionByName(suppliers).unionByName(kv_parts(spark, d).select("key"))
    return bloom.probe(asked, bits, k, n_bits)


@query("SELECT CAST(p_size AS BIGINT) AS n, CAST(least(greatest(CAST(floor(bpk * CAST(0.69 AS DOUBLE)) AS BIGINT), 1), 30) AS BIGINT) AS k, CAST((greatest(64, p_size * bpk) + 7) // 8 * 8 AS BIGINT) AS n_bits FROM (SELECT DISTINCT p_size, CAST(ceil(-ln(CAST(0.01 AS DOUBLE)) / (CAST(0.69314718056 AS DOUBLE) * CAST(0.69314718056 AS DOUBLE))) AS BIGINT) AS bpk FROM part)")
def bloom_sizing(spark, d):
    sizes = [r.p_size for r in spark.read.parquet(f"{d}/part.parquet").select("p_size").distinct().collect()]  # a few dozen
    return spark.createDataFrame([(n, *bloom.sizing(n, PER_KEY)) for n in sizes], "n bigint, k bigint, n_bits bigint")


# Key ranges and planning


@query("SELECT a.fid AS fid_a, b.fid AS fid_b FROM order_tables a JOIN order_tables b ON a.min_key <= b.max_key AND a.max_key >= b.min_key AND a.fid < b.fid", "kv_orders", "order_tables")
def range_overlap(spark, d):
    t = order_tables(spark, d)
    side = [t.select(F.col("fid").alias(f"fid_{x}"), F.col("min_key").alias(f"left_{x}"), F.col("max_key").alias(f"right_{x}")) for x in "ab"]
    return ranges.overlapping(*side).filter("fid_a < fid_b").select("fid_a", "fid_b")


@query('SELECT level, min(min_key) AS "left", max(max_key) AS "right" FROM level_tables GROUP BY level', *SST, "level_tables")
def range_hull(spark, d):
    return ranges.hull(level_tables(spark, d), "level")


@query("""SELECT fid, min_key, max_key, sum(CASE WHEN min_key > high OR max_key < low THEN 1 ELSE 0 END) OVER (ORDER BY fid) = 0 AS in_chain FROM (
  SELECT *, min(min_key) OVER w AS low, max(max_key) OVER w AS high FROM order_tables WINDOW w AS (ORDER BY fid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""", "kv_orders", "order_tables")
def overlap_chain(spark, d):
    return ranges.chain(order_tables(spark, d))


@query("SELECT level, count(*) AS num_tables, CAST(sum(bytes) AS BIGINT) AS total_size FROM level_tables GROUP BY level", *SST, "level_tables")
def level_stats(spark, d):
    return planner.level_stats(level_tables(spark, d))


SQL["seven"] = """seven AS (
  SELECT CAST(i AS BIGINT) AS level, CAST(coalesce(sum(bytes) FILTER (WHERE fid % 7 = i), 0) AS BIGINT) AS size FROM range(0, 7) AS r(i), stats_events GROUP BY i
), walk AS (
  SELECT CAST(6 AS BIGINT) AS level, size AS want FROM seven WHERE level = 6
  UNION ALL SELECT level - 1, want // 10 FROM walk WHERE level > 1
), target AS (
  SELECT level, greatest(want, 8192) AS target FROM walk
), base AS (
  SELECT coalesce(max(level) FILTER (WHERE target <= 8192), 1) AS b FROM target
), moved AS (
  SELECT greatest(b, coalesce((SELECT min(level) FROM seven WHERE level > b AND size > 0) - 1, 6)) AS base_level FROM base
)"""


@query("SELECT level, CAST(target AS BIGINT) AS target, level = base_level AS is_base FROM target, moved", *SST, "seven")
def level_targets(spark, d):
    sizes = {r.n: r.s for r in resolve.table_stats(sst_events(spark, d)).groupBy((F.col("fid") % 7).alias("n")).agg(F.sum("bytes").alias("s")).collect()}  # seven rows
    t = planner.level_targets([sizes.get(i, 0) for i in range(7)], OPTIONS)
    return spark.createDataFrame([(i, t.size[i], i == t.base_level) for i in range(1, 7)], "level bigint, target bigint, is_base boolean")


SQL["due"] = """due AS (
  SELECT level, score, row_number() OVER (ORDER BY score DESC, level) AS place FROM (
    SELECT level, CASE WHEN level = 0 THEN CAST(count(*) AS DOUBLE) / CAST(1 AS DOUBLE) ELSE CAST(sum(bytes) - 100 * level AS DOUBLE) / CAST(8192 * (level + 1) AS DOUBLE) END AS score FROM level_tables GROUP BY level) WHERE score >= 1
)"""


def _due(spark, d):
    levels = planner.level_stats(level_tables(spark, d)).withColumns({"in_flight": F.col("level") * 100, "target": (F.col("level") + 1) * 8192})
    return planner.priorities(levels, OPTIONS).withColumn("place", F.col("place").cast("bigint"))


@query("SELECT level, score, place FROM due", *SST, "level_tables", "due")
def compact_priority(spark, d):
    return _due(spark, d)


@query("SELECT level, score, place, row_number() OVER (ORDER BY level <> 0, place) AS turn FROM due", *SST, "level_tables", "due")
def l0_first(spark, d):
    return planner.level_zero_first(_due(spark, d)).withColumn("turn", F.col("turn").cast("bigint"))


@query("SELECT fid, bytes FROM (SELECT *, count(*) OVER () AS n FROM level_tables WHERE level = 0 AND bytes < 40000 AND 110 - created >= 10 AND NOT busy) WHERE n >= 1", *SST, "level_tables")
def l0_to_l0_candidates(spark, d):
    return planner.merge_within_l0(level_tables(spark, d), Options(memtable_size=20_000, l0_merge_tables=1), 110)


@query("SELECT p.fid FROM order_tables p WHERE p.fid % 2 = 0 AND NOT EXISTS (SELECT 1 FROM order_tables b WHERE b.fid % 6 = 1 AND b.fid % 3 = p.fid % 3 AND p.min_key <= b.max_key AND p.max_key >= b.min_key)", "kv_orders", "order_tables")
def inflight_conflict(spark, d):
    t = order_tables(spark, d).select("fid", (F.col("fid") % 3).alias("level"), F.col("min_key").alias("left"), F.col("max_key").alias("right"))
    return ranges.conflicts(t.filter("fid % 2 = 0"), t.filter("fid % 6 = 1")).select("fid")


@query("""SELECT row_number() OVER (ORDER BY max_key, fid) AS split, max_key AS "right" FROM (
  SELECT *, row_number() OVER (ORDER BY max_key, fid) AS n, count(*) OVER () AS total FROM order_tables) WHERE n % greatest(3, (total + 4) // 5) = 0 OR n = total""", "kv_orders", "order_tables")
def split_points(spark, d):
    t = order_tables(spark, d)
    return ranges.split_points(t, t.count())


@query("SELECT level, fid, row_number() OVER (PARTITION BY level ORDER BY CASE WHEN level = 0 THEN fid END, min_key, fid) AS place FROM level_tables", *SST, "level_tables")
def level_sort(spark, d):
    return planner.level_order(level_tables(spark, d)).withColumn("place", F.col("place").cast("bigint"))


# Manifest


@query("SELECT fid, level FROM live_files", "changes", "live_files")
def manifest_live(spark, d):
    return manifest.live(changes(spark, d))


@query("SELECT level, count(*) FILTER (WHERE op = 'CREATE') AS creations, count(*) FILTER (WHERE op = 'DELETE') AS deletions FROM changes GROUP BY level", "changes")
def manifest_counts(spark, d):
    return manifest.counts(changes(spark, d))


@query("SELECT version, fid, op FROM (SELECT *, lag(op) OVER (PARTITION BY fid ORDER BY version) AS before FROM changes) WHERE op = before OR (op = 'DELETE' AND before IS NULL)", "changes")
def manifest_invalid(spark, d):
    return manifest.invalid(changes(spark, d))


@query("""SELECT fid, 'missing' AS problem FROM live_files WHERE fid NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 1)
UNION ALL SELECT c_custkey, 'orphan' FROM customer WHERE c_custkey % 5 <> 1 AND c_custkey NOT IN (SELECT fid FROM live_files)""", "changes", "live_files")
def manifest_reconcile(spark, d):
    listed = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("fid")).filter("fid % 5 <> 1")
    return manifest.reconcile(manifest.live(changes(spark, d)), listed)


# Codecs


def _hex(v: str) -> str:
    part = [f"CASE WHEN {{n}} > {k} THEN printf('%02X', (({v} >> {7 * k}) & 127) + CASE WHEN {{n}} > {k + 1} THEN 128 ELSE 0 END) ELSE '' END" for k in range(5)]
    return "(" + " || ".join(part).format(n=f"({_VARINT.format(v)})") + ")"


@query(f"SELECT v, {_hex('v')} AS hex, CAST({_VARINT.format('v')} AS INTEGER) AS n, v AS decoded FROM (SELECT DISTINCT (o_orderkey * 2654435761) % 4294967296 >> (o_orderkey % 32) AS v FROM orders)")
def varint_hex(spark, d):
    v = F.expr("shiftrightunsigned((o_orderkey * 2654435761L) % 4294967296L, cast(o_orderkey % 32 as int))")
    rows = spark.read.parquet(f"{d}/orders.parquet").select(v.alias("v")).distinct()
    rows = rows.withColumn("hex", codec.varint_hex(F.col("v")))
    return rows.select("v", "hex", codec.varint_length(F.col("v")).alias("n"), codec.varint_value(F.col("hex")).alias("decoded"))


@query("SELECT o_orderkey * 100 AS fid, printf('%05d.sst', o_orderkey * 100) AS sst, printf('%05d.wal', o_orderkey * 100) AS wal FROM orders")
def file_names(spark, d):
    fid = (F.col("o_orderkey") * 100).alias("fid")
    return spark.read.parquet(f"{d}/orders.parquet").select(fid).select("fid", codec.table_name(F.col("fid")).alias("sst"), codec.log_name(F.col("fid")).alias("wal"))


@query("SELECT name, CASE WHEN ok THEN fid END AS fid FROM (SELECT c_custkey AS fid, c_custkey % 4 <> 0 AS ok, CASE WHEN c_custkey % 4 = 0 THEN c_name || '.sst' ELSE printf('/data/%05d.sst', c_custkey) END AS name FROM customer)")
def parse_fid(spark, d):
    name = F.when(F.col("c_custkey") % 4 == 0, F.concat("c_name", F.lit(".sst"))).otherwise(F.concat(F.lit("/data/"), codec.table_name(F.col("c_custkey"))))
    return spark.read.parquet(f"{d}/customer.parquet").select(name.alias("name")).select("name", codec.file_id(F.col("name"), "sst").alias("fid"))


@query("SELECT n, chr(CAST(97 + v // 676 % 26 AS INTEGER)) || chr(CAST(97 + v // 26 % 26 AS INTEGER)) || chr(CAST(97 + v % 26 AS INTEGER)) AS word FROM (SELECT o_orderkey + 1 AS n, (o_orderkey + 28) % 17576 AS v FROM orders)")
def odometer_strings(spark, d):
    n = (F.col("o_orderkey") + 1).alias("n")
    return spark.read.parquet(f"{d}/orders.parquet").select(n).select("n", codec.odometer(F.col("n")).alias("word"))


# CRC-32 over the bytes of a page: a step a byte, each by eight steps a bit.
_BIT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
SQL["crc_table"] = f"""crc_bits AS (
  SELECT CAST(i AS BIGINT) AS i, 0 AS k, CAST(i AS BIGINT) AS c FROM range(0, 256) AS r(i) UNION ALL SELECT i, k + 1, {_BIT} FROM crc_bits WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_bits WHERE k = 8)"""


def _crc_sql(text: str) -> str:
    byte = f"[CAST('0x' || substring(hex(encode({text})), 2 * j + 1, 2) AS BIGINT) FOR j IN range(0, octet_length(encode({text})))]"
    return f"xor(list_reduce({byte}, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295)"


@query(f"SELECT page_id, {_crc_sql('damaged')} AS crc, {_crc_sql('url')} = {_crc_sql('damaged')} AS ok FROM (SELECT page_id, url, CASE WHEN page_id % 7 = 3 THEN reverse(url) ELSE url END AS damaged FROM pages), crc_table", "crc_table")
def crc_check(spark, d):
    """Pages with a stored checksum, some of them damaged since: the checksum of what is there, and whether it
    is the stored one."""
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.col("url").alias("content"), codec.checksum(F.col("url")).alias("stored"))
    p = p.withColumn("content", F.when(F.col("page_id") % 7 == 3, F.reverse("content")).otherwise(F.col("content")))
    return p.select("page_id", codec.checksum(F.col("content")).alias("crc"), codec.verified(F.col("content"), F.col("stored")).alias("ok"))


def _hex64(v: str) -> str:
    n = "CASE " + " ".join(f"WHEN {v} < {1 << 7 * k} THEN {k}" for k in range(1, 9)) + " ELSE 9 END"
    part = [f"CASE WHEN {n} > {k} THEN printf('%02X', (({v} >> {7 * k}) & 127) + CASE WHEN {n} > {k + 1} THEN 128 ELSE 0 END) ELSE '' END" for k in range(9)]
    return "(" + " || ".join(part) + ")"


@query(f"SELECT v, {_hex64('v')} AS hex, v AS decoded FROM (SELECT DISTINCT CAST((o_orderkey * CAST(2654435761 AS HUGEINT) * 2246822519) % 9223372036854775783 AS BIGINT) >> (o_orderkey % 63) AS v FROM orders)")
def varint64_hex(spark, d):
    v = F.expr("shiftright(cast((cast(o_orderkey as decimal(38)) * 2654435761 * 2246822519) % 9223372036854775783 as bigint), cast(o_orderkey % 63 as int))")
    rows = spark.read.parquet(f"{d}/orders.parquet").select(v.alias("v")).distinct()
    rows = rows.withColumn("hex", codec.varint_hex(F.col("v"), 64))
    return rows.select("v", "hex", codec.varint_value(F.col("hex"), 64).alias("decoded"))


@query(f"SELECT o_orderkey AS n, array_to_string([('{codec.ALPHABET}')[CAST('0x' || substring(md5(CAST(o_orderkey AS VARCHAR) || ':' || CAST(i AS VARCHAR)), 1, 8) AS BIGINT) % {len(codec.ALPHABET)} + 1] FOR i IN range(1, 9)], '') AS word FROM orders")
def random_strings(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("n"), codec.rand_str(F.col("o_orderkey"), 8).alias("word"))


@query("SELECT page_id, html AS text FROM pages")
def readable_text(spark, d):
    """Bytes to text and back: what is UTF-8 comes back whole."""
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", codec.readable(F.col("html").cast("binary")).alias("text"))


@query("SELECT fid, row_number() OVER (PARTITION BY fid ORDER BY seq) - 1 AS ord, key, val FROM sst_events", "kv_events", "sst_events")
def wal_codec_roundtrip(spark, d):
    return wal.decode(wal.encode(sst_events(spark, d)))


# The engine


def _store(spark: SparkSession) -> Store:
    return Store.open(spark, new_path(spark, "store"), OPTIONS)


def _batches(spark: SparkSession, d: str) -> list[DataFrame]:
    e = kv_events(spark, d).withColumnRenamed("seq", "ord")
    n = e.agg(F.max("ord")).first()[0] or 0
    return [e.filter((F.col("ord") >= a) & (F.col("ord") < b)) for a, b in ((0, n // 3), (n // 3, 2 * n // 3), (2 * n // 3, n + 1))]


_LIVE = "SELECT key, val FROM latest_events WHERE val <> ''"


@query(_LIVE, *EVENTS)
def store_roundtrip(spark, d):
    s = _store(spark)
    for b in _batches(spark, d):
        s.put(b)
        s.flush()
    return s.scan().select("key", "val")


@query(_LIVE, *EVENTS)
def compact_invariant(spark, d):
    s = _store(spark)
    for b in _batches(spark, d):
        s.put(b)
        s.flush()
        s.compact(force=True)
    while s.compact():
        pass
    return s.scan().select("key", "val")


@query(_LIVE, *EVENTS)
def concurrent_compaction(spark, d):
    """Several compactions in flight at a time, where they do not meet, until none is due."""
    s = _store(spark)
    for b in _batches(spark, d):
        s.put(b)
        s.flush()
    s.compact_all(workers=3)
    return s.scan().select("key", "val")


@query("SELECT a.key, l.val FROM (" + ASKED + ") a JOIN latest_events l USING (key) WHERE l.val <> ''", *EVENTS)
def get_pruned(spark, d):
    """A look-up of a whole table's keys that reads only the files which may have one of them."""
    s = _store(spark)
    s.put(kv_events(spark, d).withColumnRenamed("seq", "ord"))
    s.flush()
    return s.get(_asked(spark, d)).select("key", "val")


@query("SELECT CAST(greatest(1, n) AS BIGINT) AS version, n AS files FROM (SELECT count(*) AS n FROM range(0, 40))")
def manifest_checkpoint(spark, d):
    """A store of forty commits, opened again from its last checkpoint and the commits after it."""
    storage = manifest.Storage(spark, new_path(spark, "manifest"))
    m = manifest.Manifest(storage, every=16)
    for k in range(40):
        storage.create(f"data/{k}", "")
        m.commit([manifest.File(0, 0, f"data/{k}", "a", "b", 1, 1, k, k, 0.0)], [])
    again = manifest.Manifest(storage, every=16)
    return spark.createDataFrame([(again.now.version, len(again.now.files))], "version bigint, files bigint")


@query("SELECT CAST(count(*) AS BIGINT) AS rows, true AS ok FROM kv_events", "kv_events")
def store_verify(spark, d):
    """Every file of the log against the count and checksum that its commit states."""
    s = _store(spark)
    for b in _batches(spark, d):
        s.put(b)
    return s.verify().agg(F.sum("rows").cast("bigint").alias("rows"), F.bool_and("ok").alias("ok"))


@query("SELECT fid, row_number() OVER (PARTITION BY fid ORDER BY seq) - 1 AS ord, key, val FROM sst_events", "kv_events", "sst_events")
def wal_files(spark, d):
    """Log segments written to files, record by record, and read back."""
    folder = new_path(spark, "wal")
    wal.write_segments(sst_events(spark, d), folder).count()
    return wal.decode(wal.read_segments(spark, folder))


@query(_LIVE, *EVENTS)
def reopen(spark, d):
    s = _store(spark)
    for k, b in enumerate(_batches(spark, d)):
        s.put(b)
        if k == 1:
            s.flush()
        s = Store.open(spark, s.path, OPTIONS)
    return s.scan().select("key", "val")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream, read from a folder of part files."""
    folder = new_path(spark, "stream")
    kv_events(spark, d).withColumnRenamed("seq", "ord").repartition(4).write.parquet(folder)
    return spark.readStream.schema("key string, val string, ord bigint").option("maxFilesPerTrigger", 4).parquet(folder)


@query(_LIVE, *EVENTS)
def stream_store(spark, d):
    s = _store(spark)
    ingest.into_store(_stream(spark, d), s, new_path(spark, "stream-state")).awaitTermination()
    return Store.open(spark, s.path, OPTIONS).scan().select("key", "val")


@query("SELECT key, val, seq FROM latest_events", *EVENTS)
def stream_latest(spark, d):
    """Newest versions as streaming state, put out by ``foreachBatch``."""
    out = new_path(spark, "stream-latest")
    rows = ingest.latest_stream(_stream(spark, d).withColumnRenamed("ord", "seq"))
    q = rows.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    q.option("checkpointLocation", new_path(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("key string, val string, seq bigint").parquet(out)
