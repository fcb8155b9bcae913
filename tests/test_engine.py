import random
import time

import pytest
from pyspark.sql import functions as F

from strata.functions import codec
from strata.operators import ranges, resolve
from strata.options import Options
from strata.plans import planner
from strata.sources import manifest, wal
from strata.sources.manifest import File, Snapshot
from strata.store import Store

ENTRIES = "key string, val string, seq bigint"


def entries(spark, *rows):
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], ENTRIES)


def dump(df):
    return {r.key: r.val for r in df.collect()}


def table(fid, level, low, high, size=100, first=0, last=0):
    return File(fid, level, f"data/{fid}", low, high, 1, size, first, last, 0.0)


def test_varint_boundaries(spark):
    vs = [0, 127, 128, 16383, 16384, 2097151, 2097152, 268435455, 268435456, 4294967295]
    df = spark.createDataFrame([(v,) for v in vs], "v bigint").select("v", codec.varint_length(F.col("v")).alias("n"), codec.varint_hex(F.col("v")).alias("h"))
    got = df.select("*", codec.varint_value(F.col("h")).alias("back")).collect()
    assert [r.n for r in got] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert all(r.back == r.v and len(r.h) == 2 * r.n for r in got)


def test_varint_without_end_is_null(spark):
    assert spark.createDataFrame([("8080",)], "h string").select(codec.varint_value(F.col("h")).alias("v")).first().v is None


def test_crc_vector(spark):
    assert spark.sql("SELECT '123456789' AS s").select(codec.checksum(F.col("s")).alias("c")).first().c == 3421780262


def test_names_and_ids(spark):
    df = spark.createDataFrame([(1,), (99999,), (1234567,)], "f bigint").select("f", codec.table_name(F.col("f")).alias("n"))
    got = df.select("*", codec.file_id(F.col("n"), "sst").alias("back"), codec.file_id(F.lit("x.sst"), "sst").alias("bad")).collect()
    assert [r.n for r in got] == ["00001.sst", "99999.sst", "1234567.sst"]
    assert all(r.back == r.f and r.bad is None for r in got)


def test_byte_order_of_keys(spark):
    keys = ["a", "ab", "abc", "b", "z", "é", "鱼", "😁"]
    df = spark.createDataFrame([(k,) for k in random.Random(1).sample(keys, len(keys))], "key string")
    assert [r.key for r in df.orderBy("key").collect()] == keys


def test_log_round_trip_and_torn_tail(spark):
    e = spark.createDataFrame([(1, "k", "v" * 300, 2), (1, "鱼", "", 1), (2, "a" * 200, "😁", 3)], "fid bigint, key string, val string, seq bigint")
    back = [(r.fid, r.ord, r.key, r.val) for r in wal.decode(wal.encode(e)).orderBy("fid", "ord").collect()]
    assert back == [(1, 0, "鱼", ""), (1, 1, "k", "v" * 300), (2, 0, "a" * 200, "😁")]
    raw = bytes(wal.encode(e).filter("fid = 1").first().content)
    assert len([*wal.records(raw[:-1])]) == 1 and [*wal.records(b"")] == [] and [*wal.records(raw + b"\0\0\0")] == [*wal.records(raw)]


def test_log_files(spark, tmp_path):
    (tmp_path / "00007.wal").write_bytes(b"\x01\x01ab\x00\x00")
    (tmp_path / "other.txt").write_bytes(b"x")
    assert [(r.fid, r.key, r.val) for r in wal.decode(wal.read_segments(spark, str(tmp_path))).collect()] == [(7, "a", "b")]


def test_newest_wins_and_value_is_not_key(spark):
    e = entries(spark, ("a", "1"), ("k", "v"), ("a", "2"), ("b", "x"), ("b", ""))
    keys = spark.createDataFrame([("a",), ("k",), ("b",), ("zz",)], "key string")
    assert dump(resolve.get(e, keys)) == {"a": "2", "k": "v"}
    assert dump(resolve.get(e, keys, raw=True)) == {"a": "2", "k": "v", "b": ""}
    assert dump(resolve.get_or_null(e, keys)) == {"a": "2", "k": "v", "b": None, "zz": None}


def test_empty_inputs(spark):
    e = spark.createDataFrame([], ENTRIES)
    assert resolve.live(e).count() == 0 and resolve.scan(e, "a", "b").count() == 0
    assert resolve.floor_seek(e.select("key"), e.select(F.col("key").alias("base_key"))).count() == 0


def test_floor_seek_below_the_first_base(spark):
    probes = spark.createDataFrame([("a",), ("b",), ("m",), ("z",)], "key string")
    index = spark.createDataFrame([("b",), ("k",)], "base_key string")
    assert {r.key: r.base_key for r in resolve.floor_seek(probes, index).collect()} == {"a": None, "b": "b", "m": "k", "z": "k"}


def test_chain_stops_at_the_first_gap(spark):
    t = spark.createDataFrame([(1, "d", "f"), (2, "e", "h"), (3, "x", "y"), (4, "f", "g")], "fid bigint, min_key string, max_key string")
    assert [r.in_chain for r in ranges.chain(t).orderBy("fid").collect()] == [True, True, False, False]


@pytest.mark.parametrize("n", [3, 60])
def test_ranges_that_meet_equal_brute_force(spark, n):
    r = random.Random(n)
    words = [f"{x:03d}" for x in range(400)] + ["", "é", "鱼"]
    made = [[(i, *sorted(r.choices(words, k=2))) for i in range(k)] for k in (n, 2 * n)]
    made[0].append((n, None, "a"))
    a = spark.createDataFrame(made[0], "a bigint, left_a string, right_a string")
    b = spark.createDataFrame(made[1], "b bigint, left_b string, right_b string")
    got = sorted((x.a, x.b) for x in ranges.overlapping(a, b).collect())
    want = sorted((i, k) for i, p, q in made[0] if p is not None for k, u, v in made[1] if p <= v and q >= u)
    assert got == want
    semi = ranges.meeting(a, b, "left_a", "right_a", "left_b", "right_b", "left_semi")
    assert sorted(x.a for x in semi.collect()) == sorted({i for i, _ in want})
    assert ranges.overlapping(a, b.limit(0)).count() == 0 == ranges.overlapping(a.limit(0), b).count()
    assert "CartesianProduct" not in plan_of(ranges.overlapping(a, b)) and "NestedLoop" not in plan_of(ranges.overlapping(a, b))


def test_versions_of_a_hot_key_are_counted_over_parts(spark):
    rows = [("hot", "v", i) for i in range(500)] + [(f"k{i % 7}", "v", 1000 + i) for i in range(50)]
    e = spark.createDataFrame(rows, ENTRIES)
    got = {(r.key, r.seq): r.version for r in resolve.merged([e.filter("seq % 2 = 0"), e.filter("seq % 2 = 1")]).collect()}
    seqs = {k: sorted((s for key, _, s in rows if key == k), reverse=True) for k in {r[0] for r in rows}}
    assert got == {(k, s): i for k, ss in seqs.items() for i, s in enumerate(ss, 1)}
    assert resolve.merged([e.limit(0)]).count() == 0


def test_common_prefix(spark):
    cases = [("", ""), ("", "a"), ("a", ""), ("abc", "abc"), ("abc", "abd"), ("abc", "ab"), ("鱼😁x", "鱼😁y"), ("x", "y")]
    df = spark.createDataFrame(cases, "a string, b string").select("a", "b", codec.common_prefix(F.col("a"), F.col("b")).alias("n"))
    import os

    assert all(r.n == len(os.path.commonprefix([r.a, r.b])) for r in df.collect())


def test_varint_64_boundaries(spark):
    vs = [0, 127, 128, (1 << 35) - 1, 1 << 35, (1 << 56) - 1, 1 << 56, (1 << 63) - 1, -1, -(1 << 63)]
    df = spark.createDataFrame([(v,) for v in vs], "v bigint").select("v", codec.varint_length(F.col("v"), 64).alias("n"), codec.varint_hex(F.col("v"), 64).alias("h"))
    got = df.select("*", codec.varint_value(F.col("h"), 64).alias("back")).collect()
    assert [r.n for r in got] == [1, 1, 2, 5, 6, 8, 9, 9, 10, 10]
    assert all(r.back == r.v and len(r.h) == 2 * r.n for r in got)


def test_blocks_fill_up_as_they_are_written(spark):
    rows = [(1, f"key{i:04d}", "x" * (i % 13)) for i in range(60)] + [(2, "big", "y" * 900), (2, "bigger", ""), (3, "é", "z")]
    got = resolve.cut_blocks(spark.createDataFrame(rows, "fid bigint, key string, val string").repartition(3), 200)
    want = []
    for fid in (1, 2, 3):
        block = []
        for _, k, v in sorted(x for x in rows if x[0] == fid):
            key, val = k.encode(), v.encode()
            size = sum(4 + len(a) - s + b for a, b, s in block)
            if block and size + 4 + len(key) + len(val) + 4 * (len(block) + 1) + 16 > 200:
                want.append((fid, block))
                block = []
            base = block[0][0] if block else b""
            same = next((i for i in range(len(base)) if base[: i + 1] != key[: i + 1]), len(base))
            block.append((key, len(val), same if block else 0))
        want.append((fid, block))
    assert sorted((r.fid, r.base_key, r.n, r.len) for r in got.collect()) == [(f, b[0][0].decode(), len(b), sum(4 + len(k) - s + v for k, v, s in b)) for f, b in want]
    assert got.filter("fid = 1").agg(F.max("block")).first()[0] == len([f for f, _ in want if f == 1]) - 1


def test_log_records_of_any_bytes(spark):
    data = b"\x02\x01\xff\xfea\x01\x01kv"
    df = spark.createDataFrame([(1, bytearray(data))], "fid bigint, content binary")
    assert [(bytes(r.key), bytes(r.val)) for r in wal.decode(df, raw=True).collect()] == [(b"\xff\xfe", b"a"), (b"k", b"v")]
    assert wal.decode(df).filter("val = 'a'").count() == 1 and wal.decode(df).filter("key = 'k'").count() == 1


def test_hull_of_one_table(spark):
    t = spark.createDataFrame([(1, "d", "f")], "fid bigint, min_key string, max_key string")
    assert tuple(ranges.hull(t).first()) == ("d", "f")


def test_level_targets_of_the_worked_example():
    mib = 1 << 20
    o = Options(base_level_size=10 * mib)
    t = planner.level_targets([0, 0, 0, 0, 0, 0, 500 * mib], o)
    assert t.size[4:] == [10 * mib, 50 * mib, 500 * mib] and t.base_level == 5
    assert planner.level_targets([0] * 7, o).base_level == 6


def test_choice_takes_in_overlaps_and_skips_busy_levels():
    o = Options(num_level_zero_tables=2, base_level_size=1000)
    now = Snapshot(files=(table(1, 0, "a", "f"), table(2, 0, "e", "k"), table(3, 0, "x", "z"), table(4, 6, "b", "c"), table(5, 6, "q", "r")))
    p = planner.choose(now, o)
    assert (p.source, p.target, [f.fid for f in p.top], [f.fid for f in p.bottom]) == (0, 6, [1, 2], [4])


def test_choice_moves_down_a_table_that_overlaps_nothing():
    o = Options(base_level_size=10)
    now = Snapshot(files=(table(1, 3, "a", "b", 10_000), table(2, 4, "x", "z", 1)))
    p = planner.choose(now, o)
    assert (p.source, p.target, p.bottom) == (3, 4, ())


def test_tombstones_stay_over_deeper_tables():
    o = Options()
    plan = planner.Plan(0, 3, (table(9, 0, "a", "c", last=9),), ())
    assert planner.deeper_overlap(Snapshot(files=(plan.top[0], table(1, 5, "b", "d"))), plan, o)
    assert not planner.deeper_overlap(Snapshot(files=(plan.top[0], table(1, 5, "e", "f"))), plan, o)


def test_manifest_refuses_bad_changes():
    one = {"version": 1, "next_fid": 2, "next_seq": 1, "create": [vars(table(1, 0, "a", "b"))], "delete": []}
    s = Snapshot().apply(one)
    with pytest.raises(ValueError):
        s.apply(one | {"version": 2})
    with pytest.raises(ValueError):
        s.apply({"version": 2, "next_fid": 2, "next_seq": 1, "create": [], "delete": [7]})


def test_two_writers_conflict(spark, tmp_path):
    a, b = (Store.open(spark, str(tmp_path / "s")) for _ in range(2))
    a.put(entries(spark, ("a", "1")))
    with pytest.raises(manifest.Conflict):
        b.put(entries(spark, ("b", "1")))


def test_bad_keys_are_refused(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"))
    for key in ("", None):
        with pytest.raises(ValueError):
            s.put(spark.createDataFrame([(key, "v")], "key string, val string"))
    assert s.put(spark.createDataFrame([], "key string, val string")).version == 0 and s.flush().version == 0


def test_missing_file_is_an_error_and_old_orphans_go(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"))
    s.put(entries(spark, ("a", "1")))
    orphan = tmp_path / "s/data/orphan/part-x.parquet"
    orphan.parent.mkdir()
    orphan.write_bytes(b"x")
    s = Store.open(spark, s.path)
    assert s.vacuum() == 0 and orphan.exists() and dump(s.scan()) == {"a": "1"}
    assert s.vacuum(older_than_s=-1) >= 1 and not orphan.exists() and dump(s.scan()) == {"a": "1"}
    (tmp_path / "s" / s.now.files[0].path).unlink()
    with pytest.raises(FileNotFoundError):
        Store.open(spark, s.path)


def test_snapshots_and_vacuum(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"), Options(keep_versions=1, base_level_size=1))
    s.put(entries(spark, ("a", "1")))
    s.put(entries(spark, ("a", "2"), ("b", "x" * 2000)))
    assert dump(s.scan(version=1)) == {"a": "1"} and set(dump(s.scan())) == {"a", "b"}
    s.delete(spark.createDataFrame([("a",)], "key string"))
    s.flush()
    assert s.vacuum() > 0 and set(dump(s.scan())) == {"b"}
    while s.compact(force=True):
        pass
    assert set(dump(s.scan())) == {"b"} and s.entries().count() == 1


def test_a_writer_that_has_not_committed_keeps_its_files(spark, tmp_path):
    a = Store.open(spark, str(tmp_path / "s"))
    files = a._write(entries(spark, ("a", "1")), manifest.LOG)
    b = Store.open(spark, a.path)
    b.vacuum()
    a.manifest.commit(files, [], next_seq=9)
    assert dump(Store.open(spark, a.path).scan()) == {"a": "1"}


def test_a_commit_needs_its_files(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"))
    files = s._write(entries(spark, ("a", "1")), manifest.LOG)
    s.storage.delete(files[0].path)
    with pytest.raises(FileNotFoundError):
        s.manifest.commit(files, [])
    assert s.now.version == 0 and Store.open(spark, s.path).now.version == 0


@pytest.mark.parametrize("way", ["link", "rename"])
def test_of_many_writers_of_one_name_one_gets_it(spark, tmp_path, monkeypatch, way):
    from concurrent.futures import ThreadPoolExecutor

    if way == "rename":
        monkeypatch.setattr(manifest.Storage, "_take_name", manifest.Storage._rename)
    st = manifest.Storage(spark, str(tmp_path))
    with ThreadPoolExecutor(8) as pool:
        n = 8 if way == "link" else 1  # the local file system's rename is not one step
        won = [[*pool.map(lambda w: st.create(f"m/{k}.json", str(w)), range(n))] for k in range(5)]
    assert all(sum(x) == 1 for x in won) and not st.create("m/0.json", "late")
    assert st.list("m") == [f"{k}.json" for k in range(5)] and not [p for p in tmp_path.iterdir() if p.name != "m" and not p.name.endswith(".crc")]


def test_checkpoints_shorten_the_log(spark, tmp_path):
    m = manifest.Manifest(manifest.Storage(spark, str(tmp_path)), every=4)
    (tmp_path / "data").mkdir()
    states = [m.now]
    for k in range(1, 12):
        (tmp_path / f"data/{k}").touch()
        states.append(m.commit([table(0, 0, "a", "b").__class__(**vars(table(0, 0, "a", "b")) | {"path": f"data/{k}"})], [k - 1] if k > 1 and k % 2 else [], next_seq=k))
    again = manifest.Manifest(m.storage, every=4)
    assert again.now == m.now == states[11] and [again.at(k) for k in range(12)] == states
    assert again._from(None)[0].version == 8 and again.retained(3) == states[9:]
    assert Snapshot().apply(again.now.as_changes()) == again.now
    named = again.prune(3)
    assert named == {f"data/{k}" for k in range(1, 12)}
    last = manifest.Manifest(m.storage, every=4)
    assert last.now == states[11] and last.retained(100) == states[8:] and last._names() == ([9, 10, 11], [8])
    with pytest.raises(ValueError):
        last.at(3)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_lookup_reads_only_files_and_groups_that_may_have_the_key(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"), Options(sstable_size=20_000))
    s.put(spark.range(4000).select(F.format_string("k%06d", "id").alias("key"), F.format_string("v%d", "id").alias("val")))
    s.flush()
    assert len(s.now.files) > 2
    keys = ["k000007", "k003999", "nothing"]
    found = s.get(keys)
    assert dump(found) == {"k000007": "v7", "k003999": "v3999"}
    assert "PushedFilters: [In(key, [k000007,k003999,nothing])]" in plan_of(found)
    assert len(found.inputFiles()) == 2
    many = [f"k{k:06d}" for k in range(0, 4000, 41)]
    found = s.get(many)
    assert {*dump(found)} == {*many} and "Or(In(key" in plan_of(found)
    assert {*dump(s.get(spark.range(0, 4000, 2).select(F.format_string("k%06d", "id").alias("key"))))} == {f"k{k:06d}" for k in range(0, 4000, 2)}
    assert s.get([]).count() == 0 == s.get(["zz"]).count()


def test_a_lookup_of_many_keys_reads_only_files_that_may_have_one(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"), Options(sstable_size=20_000))
    s.put(spark.range(8000).select(F.format_string("k%06d", "id").alias("key"), F.format_string("v%d", "id").alias("val")))
    s.flush()
    asked = [*range(900), *range(7100, 8000)]  # from one end to the other, and none between
    keys = spark.createDataFrame([(f"k{k:06d}",) for k in asked] + [("k000000",), (None,), ("zz",)], "key string")
    found = s.get(keys)
    assert dump(found) == {f"k{k:06d}": f"v{k}" for k in asked} and found.count() == len(asked)
    held = {f.path.rpartition("/")[2] for f in s.now.files if f.min_key <= "k000899" or f.max_key >= "k007100"}
    assert {f.rpartition("/")[2] for f in found.inputFiles()} == held and 2 <= len(held) < len(s.now.files)
    s.delete(keys.filter("key < 'k000100'"))
    assert {*dump(s.get(keys))} == {f"k{k:06d}" for k in asked if k >= 100}
    none = spark.range(2000).select(F.format_string("z%06d", "id").alias("key"))
    assert s.get(none).count() == 0


def test_a_table_of_keys_is_looked_up_at_once(spark, tmp_path, monkeypatch):
    from strata.plans import catalogue

    spark.range(5000).select(F.col("id").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(9000).selectExpr("id AS event_id", "id % 4500 AS user_id", "if(id % 7 = 0, 'error', 'view') AS event_type", "concat('p', id) AS props").write.parquet(str(tmp_path / "events.parquet"))
    calls, get = [], Store.get
    monkeypatch.setattr(Store, "get", lambda *a, **k: calls.append(1) or get(*a, **k))
    found = dump(catalogue.get_pruned(spark, str(tmp_path)))
    assert found == {str(k): f"p{k + 4500}" for k in range(4500) if (k + 4500) % 7} and len(calls) == 1


def test_ords_of_any_type(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"))
    rows = [("a", "old", 5), ("a", "new", 900), ("b", "x", None), ("b", "y", 7)]
    s.put(spark.createDataFrame(rows, "key string, val string, ord bigint"))
    assert dump(s.scan()) == {"a": "new", "b": "y"}
    s.put(spark.createDataFrame([("a", "z", "2"), ("a", "y", "1")], "key string, val string, ord string").repartition(2))
    assert dump(s.scan()) == {"a": "z", "b": "y"}
    s.put(spark.createDataFrame([("a", "1"), ("a", "2")], "key string, val string").coalesce(1))
    assert dump(s.scan()) == {"a": "2", "b": "y"}


def test_verify_tells_what_was_changed(spark, tmp_path):
    import shutil

    s = Store.open(spark, str(tmp_path / "s"))
    assert s.verify().count() == 0
    s.put(entries(spark, ("a", "1")))
    s.put(entries(spark, ("b", "2")))
    assert [r.ok for r in s.verify().collect()] == [True, True]
    one, two = (tmp_path / "s" / f.path for f in s.now.files)
    shutil.copy(one, two)
    for crc in (tmp_path / "s").rglob(".*.crc"):
        crc.unlink()
    assert {r.path: r.ok for r in s.verify().collect()} == {s.now.files[0].path: True, s.now.files[1].path: False}


def test_plans_that_meet_are_not_in_flight_together():
    o = Options(num_level_zero_tables=1, base_level_size=10, l0_merge_tables=2)
    now = Snapshot(files=(table(1, 0, "a", "f"), table(2, 0, "e", "k"), table(3, 0, "x", "z"), table(4, 3, "b", "c", 50), table(5, 3, "q", "r", 50)))
    first = planner.choose(now, o, at=100.0)
    assert (first.source, [f.fid for f in first.top]) == (0, [1, 2])
    second = planner.choose(now, o, busy=[first], at=100.0)
    assert second.source == 3 and second.low > first.high
    within = planner.within_level_zero(now, o, [planner.Plan(0, 6, (table(3, 0, "x", "z"),), ())], 100.0)
    assert [f.fid for f in within.files] == [1, 2] and within.target == 0 and not within.meets(planner.Plan(0, 6, (table(3, 0, "e", "z"),), ()))
    assert planner.within_level_zero(now, o, [], 5.0) is None and planner.deeper_overlap(now, within, o)
    assert planner.choose(now, o, busy=[first, second], at=5.0) is None or not any(planner.choose(now, o, busy=[first, second], at=5.0).meets(b) for b in (first, second))


def test_split_points_of_the_worked_example():
    tables = [table(k, 2, f"{k}a", f"{k}z") for k in range(10)]
    assert planner.split_points(tables) == ["2z", "5z", "8z"] and planner.split_points(tables[:2]) == []
    assert len(planner.split_points([table(k, 2, f"{k:03d}a", f"{k:03d}z") for k in range(142)])) == 4


def test_compaction_in_ranges_and_within_level_zero(spark, tmp_path):
    o = Options(sstable_size=600, base_table_size=600, table_size_multiplier=1, base_level_size=1, num_level_zero_tables=50, l0_merge_age_s=0, l0_merge_tables=2)
    s = Store.open(spark, str(tmp_path / "s"), o)
    model = {}
    for k in range(4):
        new = {f"k{i:03d}": f"{k}.{i}" if i % 5 else "" for i in range(k, 200, 1 + k % 2)}
        s.put(spark.createDataFrame([*new.items()], "key string, val string"))
        s.flush()
        model |= new
        if k < 2:
            while s.now.level(0):
                assert s.compact(force=True)
    want = {k: v for k, v in model.items() if v}
    bottom = max(f.level for f in s.now.files)
    assert len(planner.split_points(s.now.level(bottom))) >= 1
    plan = planner.within_level_zero(s.now, o, [], time.time() + 1)
    files = s._write(s._merged(plan, True, s.now), 0)
    assert len(files) == 1
    s.manifest.commit(files, [f.fid for f in plan.files])
    assert dump(s.scan()) == want and len(s.now.level(0)) == 1
    while s.compact(force=True):
        pass
    assert dump(s.scan()) == want and all(s.verify().select("ok").toPandas()["ok"])
    t = s.now.level(max(f.level for f in s.now.files))
    assert len(t) > 3 and all(a.max_key < b.min_key for a, b in zip(t, t[1:]))


def test_compactors_work_until_stopped(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"), Options(sstable_size=1024, base_level_size=2048, num_level_zero_tables=1))
    with s.start_compactors(2, 0.05) as c:
        for k in range(3):
            s.put(spark.createDataFrame([(f"k{i}", f"{k}.{i}") for i in range(k, 60)], "key string, val string"))
            s.flush()
        until = time.time() + 60
        while s.now.level(0) and time.time() < until:
            time.sleep(0.1)
    assert not c.errors and not s.busy and not s.now.level(0)
    assert dump(s.scan()) == {f"k{i}": f"{min(i, 2)}.{i}" for i in range(60)}


@pytest.mark.parametrize("seed", range(2))
def test_store_equals_a_dictionary(spark, tmp_path, seed):
    """Random puts, deletes, flushes, compactions and reopenings against a plain model."""
    r, o, model = random.Random(seed), Options(sstable_size=1024, base_table_size=1024, base_level_size=2048, num_level_zero_tables=2), {}
    s = Store.open(spark, str(tmp_path / "s"), o)
    for step in range(9):
        op = r.choice(["put", "put", "put", "flush", "compact", "reopen"])
        if op == "put":
            new = [(f"k{r.randint(0, 40):02d}", r.choice(["", f"v{step}.{i}"]), i) for i in range(30)]
            s.put(spark.createDataFrame(r.sample(new, len(new)), "key string, val string, ord int"))
            model |= {k: v for k, v, _ in new}
            s.flush() if step % 3 == 0 else None
        elif op == "flush":
            s.flush()
        elif op == "compact":
            s.compact(force=True)
        else:
            s = Store.open(spark, s.path, o)
        want = {k: v for k, v in model.items() if v}
        assert dump(s.scan()) == want, (step, op)
        assert dump(s.scan("k10", "k20")) == {k: v for k, v in want.items() if "k10" <= k <= "k20"}
        for level in range(1, o.max_level_num):
            t = s.now.level(level)
            assert all(a.max_key < b.min_key for a, b in zip(t, t[1:]))


def test_bloom_shape_and_rate(spark):
    from strata.operators import bloom

    assert bloom.bits_per_key(0.01) == 10 and bloom.sizing(1000, 10) == (6, 10000) and bloom.sizing(0, 10) == (6, 64)
    keys = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("key"))
    bits, k, n = bloom.build(keys, 10)
    hits = bloom.probe(keys.unionByName(spark.range(10_000).select(F.concat(F.lit("x"), "id").alias("key"))), bits, k, n)
    got = {(r.here, r.may_contain): r["count"] for r in hits.groupBy(F.col("key").startswith("k").alias("here"), "may_contain").count().collect()}
    assert got[True, True] == 1000 and (True, False) not in got and got.get((False, True), 0) < 200


def test_production_sketch(spark):
    from strata.operators import bloom

    sketch = bloom.probe_sketch(spark.range(100).select(F.col("id").cast("string").alias("key")), 100, 0.01)
    assert all(sketch.mightContain(str(i)) for i in range(100))
