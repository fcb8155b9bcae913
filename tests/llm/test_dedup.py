import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from strata.llm import components, quality, resemblance, scratch, simhash, substring
from strata.llm import text as tx

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


# Words, windows and hashes


def test_words_windows_and_repeats():
    strings = ["", " a  bb\tccc\n", "é\x85x \x1c y", "one"]
    b = tx.Block(strings)
    s, e, before = b.words()
    assert [b.joined[x:y] for x, y in zip(s, e)] == [w for t in strings for w in WORD.findall(t)]
    assert before.tolist() == [0, 0, 3, 6, 7]
    at, text = tx.windows(before, 2)
    assert list(zip(at.tolist(), text.tolist())) == [(0, 1), (1, 1), (3, 2), (4, 2)]
    assert tx.repeated(np.array([5, 1, 5, 2])).tolist() == [True, False, True, False]
    assert tx.covered(6, np.array([1, 2]), 3).tolist() == [False, True, True, True, True, False]


def test_blocks_cut_between_rows():
    t = pa.array(["a" * 30, None, "b" * 30, "c" * 100, ""])
    assert [(k, b.texts) for k, b in tx.blocks(t, limit=50)] == [(0, ["a" * 30, ""]), (2, ["b" * 30]), (3, ["c" * 100]), (4, [""])]


# Quality rules


def base(text):
    ws = WORD.findall(text)
    win = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    n = Counter(win)
    rep = {i + j for i, w in enumerate(win) if n[w] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(rep)


def line_rule(rows):
    """Lines that each (text, host) loses, by brute force."""
    where = defaultdict(set)

    def norm(line):
        return " ".join(WORD.findall(lower(line)))

    for _, t, host in rows:
        for line in t.split("\n"):
            if norm(line):
                where[host, norm(line)].add(t)
    bad = {k for k, ts in where.items() if len(ts) > quality.MOST_DOCS}
    return lambda t, host: [x for x in t.split("\n") if (host, norm(x)) in bad]


def test_quality_equals_brute_force(docs, empty):
    rows = [(r.doc_id, r.text or "", r.source or "") for r in docs.collect()]
    removed = line_rule(rows)
    want, kept = Counter(), Counter()
    for d, t, host in rows:
        n = base(t)
        failed = n[0] < 20 or 100 * n[4] > 30 * n[0]
        gone = removed(t, host)
        left = n[0] - sum(len(WORD.findall(x)) for x in gone)
        ok = not failed and not 100 * left < quality.LEFT * n[0]
        want[d, *n, failed, ok] += 1
        if ok:
            kept[d, "\n".join(x for x in t.split("\n") if x not in gone)] += 1
    got = quality.verdicts(quality.statistics(docs)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert Counter(map(tuple, got.collect())) == want
    out = quality.cleaned(docs)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == kept
    assert sum("RESERVED" in t for _, t, _ in rows) > 2 * sum("RESERVED" in t for _, t in kept)
    assert quality.cleaned(empty).count() == 0 == quality.verdicts(quality.statistics(empty)).count()


DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def own_words(tag, n=40):
    return " ".join(f"w{tag}.{k}" for k in range(n))


def test_depleted_documents_go(spark):
    bad = "\n".join(f"menu item {k} of this site" for k in range(6))
    rows = [(i, bad + f"\nown{i}", "x", "h", 1) for i in range(10)]
    rows += [(100 + i, own_words(i) + ("\nmenu item 1 of this site" if i == 3 else ""), "x", "h", 1) for i in range(30)]
    out = {r.doc_id: r for r in quality.cleaned(spark.createDataFrame(rows, DOC)).collect()}
    assert sorted(out) == [100 + i for i in range(30)]
    assert "menu" not in out[103].text and out[103].n_chars == len(out[103].text)


def test_more_rows_of_a_host_lift_no_line_under_the_limit(spark):
    rows = [(i, own_words(i) + ("\nAll rights reserved." if i < 7 else ""), "x", "h", 1) for i in range(400)]
    out = [r.text for r in quality.cleaned(spark.createDataFrame(rows, DOC)).collect()]
    assert len(out) == 400 and not any("reserved" in t for t in out)


def test_limits_of_any_host(spark):
    """Of 10**8 documents too: the limit is the lesser of a number and a share, and one document never makes a line boilerplate."""
    cases = [(5, 10**8), (6, 10**8), (10**6, 10**8), (2, 40), (2, 400), (1, 3)]
    df = spark.createDataFrame(cases, "n bigint, host bigint")
    n, host = F.col("n"), F.col("host")
    got = df.select("n", "host", quality.above(n, host).alias("number"), quality.above(n, host, 5, 2).alias("share"), quality.above(n, host, 10**7, 2).alias("wide")).collect()
    assert {(r.n, r.host): (r.number, r.share, r.wide) for r in got} == {
        (5, 10**8): (False, False, False),
        (6, 10**8): (True, True, False),
        (10**6, 10**8): (True, True, False),
        (2, 40): (False, True, True),
        (2, 400): (False, False, False),
        (1, 3): (False, False, False),
    }


@pytest.mark.parametrize("broadcast", [100_000, 0])
@pytest.mark.parametrize("length", [31, 200, 5000])
def test_long_lines_go(spark, monkeypatch, length, broadcast):
    monkeypatch.setattr(quality, "BROADCAST_ROWS", broadcast)
    line = " ".join(f"c{k}" for k in range(length))
    rows = [(i, own_words(i, 2 * length) + "\n" + line.upper() + " ", "x", "h", 1) for i in range(9)]
    rows += [(100 + i, own_words(i, 30) + "\n" + line, "x", "h", 1) for i in range(length >= 200 and 9)]
    rows += [(200 + i, own_words(200 + i, 50) + "\n" + line, "x", "other", 1) for i in range(5)]
    rows += [rows[0], (None, rows[1][1], None, "h", None)]
    got = Counter((r.doc_id, r.text) for r in quality.cleaned(spark.createDataFrame(rows, DOC)).collect())
    want = Counter((r[0], r[1].split("\n")[0]) for r in rows if (r[0] or 0) < 100)
    assert got == want + Counter((r[0], r[1]) for r in rows if (r[0] or 0) >= 200)


def thue_morse(n, flip=False):
    return "".join("ab"[(k.bit_count() & 1) ^ flip] for k in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_whose_rolling_hashes_agree_are_told_apart(spark, n):
    """Polynomials modulo 2**64 cannot tell these two words apart, whatever their base."""
    one, two = thue_morse(n), thue_morse(n, True)
    b = tx.Block([one, two])
    s, e, _ = b.words()
    h = tx.ROLL.ranges(tx.ROLL.prefix(tx.char_values(b.cps)), s, e)
    assert one != two and h[0] == h[1]
    seven, rest = own_words("a", 7), own_words("b", 34)
    texts = [f"{rest} {one}", f"{rest} {two}", f"{one}\n{two}\n{one}\n{own_words('c', 20)}", f"{seven} {one} x {seven} {two} y {own_words('d')}"]
    texts += [f"{own_words('e' + str(k))}\n{one if k < 5 else two}" for k in range(10)]
    df = spark.createDataFrame([(i, t, "x", "h", len(t)) for i, t in enumerate(texts)], DOC)
    got = {r.doc_id: r for r in quality.statistics(df).collect()}
    assert {i: (r.n_dup_lines, r.n_repeat_words) for i, r in got.items()} == {i: (base(t)[3], base(t)[4]) for i, t in enumerate(texts)}
    assert got[2].n_dup_lines == 1 and got[3].n_repeat_words == 0
    removed = line_rule([(i, t, "h") for i, t in enumerate(texts)])
    assert {r.doc_id: r.text for r in quality.cleaned(df).collect()} == {i: "\n".join(x for x in t.split("\n") if x not in removed(t, "h")) for i, t in enumerate(texts)}
    want = {i: len(gone) for i, (_, gone) in enumerate(removals(texts))}
    assert {r.doc_id: r.n_removed for r in substring.digests(df).collect()} == want and want[0] == 0


# SimHash


def fingerprint(t, shingle=4):
    w = WORD.findall(lower(t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + shingle]).encode(), seed=42) for i in range(max(1, len(w) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(values):
    """Smallest value reachable over links of four bits or fewer, by brute force."""
    vs = sorted(set(values))
    root = {v: v for v in vs}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(vs):
        for b in vs[:i]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in vs}


def test_simhash_equals_brute_force(docs, texts, empty):
    fps = [(d, fingerprint(t)) for d, t in texts]
    root = groups([f for _, f in fps])
    least = {}
    for d, f in fps:
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == Counter((d, f, least.get(root[f])) for d, f in fps)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    out = kept.collect()
    assert sorted(root[fingerprint(r.text or "")] for r in out) == sorted(set(root.values()))
    assert all(r.doc_id == least.get(root[fingerprint(r.text or "")]) for r in out)
    assert simhash.near_duplicates(empty).count() == 0 == simhash.deduplicated(empty).count()


@pytest.mark.parametrize("crowd", [3, 512])
def test_links_lose_nothing(spark, monkeypatch, crowd):
    """Random groups within a few bits, with keys paired and with crowded keys linked by midpoints."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    r = random.Random(crowd)
    values = []
    for _ in range(12):
        c = r.getrandbits(64)
        for _ in range(12):
            v = c
            for b in r.sample(range(64), r.randint(0, 5)):
                v ^= 1 << b
            values.append(v)
    want = groups(values)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp bigint")
    edges = [(e.a % (1 << 64), e.b % (1 << 64)) for e in simhash.links(df).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    root = dict(zip(want, want))
    for _ in range(len(want)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert root == want


def shingles(t):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def resembling(texts, shingle):
    """Group of each text, its smallest place: four bits or fewer, or 5-word shingles of Jaccard 0.8 or more; by
    brute force.  And how many pairs only the second finds."""
    sets, fps = [shingles(t or "") for t in texts], [fingerprint(t or "", shingle) for t in texts]
    root, far = [*range(len(texts))], 0
    for i in range(len(texts)):
        for k in range(i):
            near = (fps[i] ^ fps[k]).bit_count() <= 4
            both = 0 if near and root[i] == root[k] else len(sets[i] & sets[k])
            like = both > 0 and both >= 0.8 * len(sets[i] | sets[k])
            far += like and not near
            if near or like:
                x, y = root[i], root[k]
                root = [min(x, y) if v in (x, y) else v for v in root] if x != y else root
    return root, far


def test_near_copies_far_apart_in_bits_fall_together(spark):
    """Groups by 5-word shingles of Jaccard 0.8 or more, and four bits, by brute force."""
    r = random.Random(5)
    texts = []
    for _ in range(25):
        ws = [f"w{r.randint(0, 9999)}" for _ in range(r.randint(60, 150))]
        texts.append(" ".join(ws))
        for n in (1, 2, 4):
            texts.append(" ".join(["new", *ws[n:-n], "end"]) if n > 1 else " ".join(w if i != len(ws) // 2 else "new" for i, w in enumerate(ws)))
    texts += [" ".join(f"c{k}" for k in range(100)) + f" own{i}" for i in range(60)] + ["", None, "one two", "ONE  two"]

    root, far = resembling(texts, 4)
    assert far > 10
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(df, 0.8).collect()}
    assert got == dict(enumerate(root))
    assert {x.doc_id for x in simhash.deduplicated(df, 0.8).collect()} == set(root)
    assert simhash.near_duplicates(df.limit(0), 0.8).count() == 0


@pytest.mark.parametrize("block", [1 << 19, 10_000])
def test_crowded_keys_lose_no_link(spark, monkeypatch, block):
    """Texts that are all alike below the limit, so that their keys are crowded, in twos that are above it; by
    brute force, in one block and in several."""
    monkeypatch.setattr(resemblance, "BLOCK", block)
    common = [f"c{k}" for k in range(404)]
    texts = []
    for k in range(120):
        texts += [" ".join([*common, f"two{k}", f"own{k}", *(f"own{k}-{side}-{i}" for i in range(49))]) for side in (0, 1)]
    texts += [texts[0]] * 5
    sets = [shingles(t) for t in texts]
    near = {frozenset((i, k)) for i in range(240) for k in range(i) if len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k])}
    assert near == {frozenset((2 * k, 2 * k + 1)) for k in range(120)}
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    roots = df.select(F.xxhash64("text").alias("text"), F.xxhash64("text").alias("root")).distinct()
    place = {r.h: texts.index(r.text) for r in df.select(F.xxhash64("text").alias("h"), "text").collect()}
    got = [frozenset((place[r.a], place[r.b])) for r in resemblance.links(df, roots, simhash._hashes, 0.8).collect()]
    assert set(got) == near


@pytest.mark.parametrize("cut", simhash.CUTS)
def test_each_pair_is_found_under_one_key(cut):
    """Pairs within four bits share a key in every cut, and the first one is what ``_first_common`` says."""
    r, masks = random.Random(1), simhash.segments(*cut)
    places = [(m, k) for m in masks for k in range(64) if m >> k & 1]
    assert len(places) < 1 << 12
    for _ in range(400):
        x = sum(1 << b for b in r.sample(range(64), r.randint(0, 6)))
        shared = [i for i, (m, k) in enumerate(places) if not x & m & ~(1 << k)]
        assert simhash._first_common(np.array([x], np.uint64), masks)[0] == (shared[0] if shared else -1)
        assert shared or x.bit_count() > 4


def test_the_cut_follows_from_the_count():
    assert [len(simhash.chosen_cut(n)) for n in (0, 10**6, 10**7, 10**8, 10**13)] == [3, 3, 10, 20, 35]


@pytest.mark.parametrize("chance", [1e-3, 1e-6, 0])
def test_every_cut_loses_nothing(spark, monkeypatch, chance):
    monkeypatch.setattr(simhash, "CHANCE", chance)
    test_links_lose_nothing(spark, monkeypatch, 512)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (200, 200)] + [(300, k) for k in range(301, 340)]
    df = spark.createDataFrame([(b, a) for a, b in edges], "a bigint, b bigint")
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100} | {k: 300 for k in range(300, 340)}
    assert components.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("common", [1, 10, 10**9])
def test_hot_keys_change_nothing(spark, monkeypatch, common):
    """Components and links with none, some and all of the keys taken for hot ones."""
    monkeypatch.setattr(scratch, "COMMON", common)
    test_components(spark)
    test_links_lose_nothing(spark, monkeypatch, 3)


def test_hot_keys(spark, monkeypatch):
    """Keys above the limit, by count; keys that share a bucket with them are not among them."""
    monkeypatch.setattr(simhash, "CROWD", 5)
    keys = [7] * 40 + [7 + simhash.BUCKETS] * 3 + [1] * 6 + [2] * 5 + [-7] * 9
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key bigint, fp bigint")
    assert sorted(r.key for r in simhash._hot_keys(df, len(keys)).collect()) == [-7, 1, 7]
    assert [r.key for r in simhash._hot_keys(df, 10_000).collect()] == [7]
    assert simhash._hot_keys(df.limit(0), 0).count() == 0


def test_joined_keeps_every_row(spark, monkeypatch):
    monkeypatch.setattr(scratch, "COMMON", 4)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 30 + [2] * 3 + [3, None])], "k bigint, v bigint")
    keyed = spark.createDataFrame([(1, "a", 30), (2, "b", 3), (4, "c", 0)], "k bigint, w string, many bigint")
    got = scratch.joined(rows, keyed, "k", 35)
    assert got.columns == ["k", "v", "w"]
    assert sorted((r.k, r.v, r.w) for r in got.collect()) == [(1, i, "a") for i in range(30)] + [(2, i, "b") for i in range(30, 33)]


# Substring dedup


def removals(rows):
    words = [WORD.findall(t) for t in rows]
    n = Counter(tuple(ws[i : i + 35]) for ws in words for i in range(len(ws) - 34))
    return [(ws, {i + j for i in range(len(ws) - 34) if n[tuple(ws[i : i + 35])] > 1 for j in range(35)}) for ws in words]


def test_slices_grow_within_bounds():
    assert [substring._slice(b) for b in (22, 30, 32, 34, 36, 47)] == [22, 22, 22, 24, 26, 26]


@pytest.mark.parametrize("chunk, least", [(1500, 22), (1500, 12), (8 << 20, 22)])
def test_substring_equals_brute_force(docs, texts, empty, monkeypatch, chunk, least):
    monkeypatch.setattr(substring, "CHUNK", chunk)
    monkeypatch.setattr(substring, "LEAST_SLICE", least)
    want, kept = Counter(), []
    for (d, _), (ws, gone) in zip(texts, removals([t for _, t in texts])):
        left = [w for i, w in enumerate(ws) if i not in gone]
        want[d, len(ws), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()] += 1
        kept.append((d, left))
    assert any(k[2] and k[2] < k[1] for k in want)
    assert Counter(map(tuple, substring.digests(docs).collect())) == want
    out = substring.dedup(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted(((r.doc_id, WORD.findall(r.text or "")) for r in rows), key=repr) == sorted(kept, key=repr)
    assert any(r.text is None for r in rows)
    assert substring.digests(empty).count() == 0 == substring.dedup(empty).count()


def test_estimates_are_never_low():
    """Tables so narrow that most cells collide only estimate more windows repeated."""
    r = random.Random(2)
    texts = pa.chunked_array([[" ".join(r.choice("abcd") for _ in range(90)) for _ in range(5)]])
    w = substring.Windows(texts, 6)
    batch = substring._sketch_entries(1, w, 9, 4)
    table = pa.Table.from_batches([batch])
    answers = []
    for s in set(table["slice"].to_pylist()):
        part = table.filter(pa.compute.equal(table["slice"], s))
        answers += substring._merge_cells(part).select(["slice", "bits"]).to_pylist()
    estimated = substring._estimated(w, answers, 9, 4)
    assert (estimated >= tx.repeated(w.h)).all() and estimated.sum() >= tx.repeated(w.h).sum() > 0


def test_text_without_words_keeps_its_lines():
    gone = np.array([False, True, True, False, False, True])
    assert substring.without("  a b\nc d  e f\n", gone) == "a\nd  e"
    assert substring.without("a b", np.array([True, True])) == ""


def test_fingerprint_column_is_signed_hex(spark):
    assert spark.createDataFrame([(-1,)], "fp bigint").select(F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("x")).first().x == "f" * 16
