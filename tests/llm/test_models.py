import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import ann, toxicity

from ..conftest import SF

LARGE = "/root/testdata/sf0.1"


# Toxicity


def score_of(sentence):
    return toxicity.Grammar({}).clause(sentence.split())


def test_clauses_not_words():
    plain, aimed, negated, quoted = map(score_of, ("what an idiot", "you are an idiot", "you are not an idiot", "she said you are an idiot"))
    assert aimed > plain > negated > 0 and aimed > quoted > 0
    assert aimed > score_of("idiot you") > plain
    assert score_of("i will kill you") > score_of("kill you") > score_of("i am going to beat you at chess") > 0
    assert score_of("i will kill you") > score_of("never will i kill you") > 0
    assert score_of("we kill the process") == score_of("") == score_of("good day to you") == 0
    assert score_of("not one of the many idiot") == plain


def interpreted(symbols):
    """The small transducers run one after the other, none composed: factor of each place."""
    factors, place = [1.0] * len(symbols), [*range(len(symbols))]
    for parts, turned in ((toxicity.FORWARD, False), (toxicity.BACKWARD, True)):
        if turned:
            symbols, place = symbols[::-1], place[::-1]
        for part in parts:
            t, state, out = part(), None, []
            state = t.start
            for k, x in enumerate(symbols):
                state, y, w = t.step(state, x)
                factors[place[k]] *= w
                out.append(y)
            symbols = out
    return factors


def test_the_grammar_is_its_transducers_one_after_the_other():
    """Random clauses of every symbol against the interpreter of the parts as they are."""
    r, g = random.Random(3), toxicity.Grammar({})
    word = {toxicity.OTHER: "table", toxicity.INSULT: "idiot", toxicity.THREAT: "kill"} | {v: k for k, v in g.context.items()}
    assert set(word) == set(toxicity.READ)
    for _ in range(500):
        symbols = r.choices(toxicity.READ, k=r.randint(0, 10))
        want = sum(g.lexical(word[x])[1] * f for x, f in zip(symbols, interpreted(symbols)))
        assert g.clause([word[x] for x in symbols]) == pytest.approx(want)


def test_features_of_odd_texts():
    g = toxicity.Grammar({"verk*": 4.0})
    assert g.features("") == g.features("nothing here") == (0.0, 0.0, 0.0)
    assert g.features("du verkobel!")[1] > 0 and g.features("xverkobel")[1] == 0


def test_held_out_split_and_quality(spark):
    docs, labels = spark.read.parquet(f"{LARGE}/documents.parquet"), spark.read.parquet(f"{LARGE}/labels.parquet")
    rows = toxicity.score(docs, toxicity.train(docs, labels)).toPandas()
    assert len(rows) == docs.count()
    assert (rows.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in rows.doc_id]).all()
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.3)).all()
    m = rows[rows.held_out].merge(labels.toPandas(), on="doc_id")
    hit = ((m.predicted == 1) & (m.toxic == 1)).sum()
    assert hit / (m.predicted == 1).sum() > 0.9 and hit / (m.toxic == 1).sum() > 0.9


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    assert toxicity.train(docs, labels) == toxicity.train(docs, flipped)


def test_toxicity_of_odd_tables(docs, empty, spark):
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1), (99999, 1)], "doc_id bigint, toxic int")
    for marks in (labels, labels.limit(0)):
        out = toxicity.score(docs, toxicity.train(docs, marks)).collect()
        assert len(out) == docs.count() and len({r.score for r in out if r.doc_id == 3}) == 1
        assert not any(r.held_out for r in out if r.doc_id is None)
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0


# Nearest neighbours


def exact(rows, queries, n):
    """Nearest by the plain definition; rows: id -> vector."""
    out = {}
    for q in queries:
        a = np.array(rows[q], float)
        s = [(-float(a @ np.array(v, float)) / np.sqrt(a @ a) / np.sqrt(np.array(v, float) @ np.array(v, float)), i) for i, v in rows.items() if i != q]
        out[q] = [i for _, i in sorted((round(x, 12), i) for x, i in s)[:n]]
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, v string, block string")


def test_recall_against_brute_force(spark):
    df = spark.read.parquet(f"{LARGE}/embeddings.parquet")
    rows = {r.vec_id: r.embedding for r in df.collect()}
    got = {}
    for r in sorted(ann.search(df, F.col("vec_id") % 50 == 0).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
        a, b = (np.array(rows[i], float) for i in (r.query_id, r.vec_id))
        assert r.score == pytest.approx(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b), abs=1e-12)
    want = exact(rows, [i for i in rows if i % 50 == 0], 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / (5 * len(want)) >= 0.9


def test_ties_copies_and_unusable_vectors(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)], 0, "x", "y") for i in range(40)]
    rows += [(100 + i, rows[0][1], 0, "x", "y") for i in range(500)]
    bad = [None, [0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [], [1.0] * 5]
    rows += [(1000 + 50 * i, v, 0, "x", "y") for i, v in enumerate(bad)] + [(None, rows[1][1], 0, "x", "y"), rows[3], rows[3]]
    rows += [rows[0], (50, rows[1][1], 0, "x", "y"), (50, rows[2][1], 0, "x", "y")]
    got = Counter((x.query_id, x["rank"], x.vec_id) for x in ann.search(vectors(spark, r.sample(rows, len(rows))), F.col("vec_id") % 50 == 0).collect())
    good = [(i, np.array(v, float)) for i, v, *_ in rows if i is not None and i < 1000]
    want = Counter()
    for k, (q, a) in enumerate(good):
        if q % 50 == 0:
            near = sorted((round(-float(a @ v) / np.sqrt((a @ a) * (v @ v)), 12), i) for n, (i, v) in enumerate(good) if n != k)
            want.update((q, rank, i) for rank, (_, i) in enumerate(near[:5], 1))
    assert got == want and got[0, 1, 0] == 2


def test_rows_of_one_id_are_rows_of_their_own(spark):
    rows = [(1, v, 0, "x", "y") for v in ([1.0, 0.0], [0.0, 1.0], [1.0, 1.0])]
    got = ann.search(vectors(spark, rows), F.col("vec_id") == 1).collect()
    assert Counter((x.query_id, x["rank"], x.vec_id) for x in got) == {(1, 1, 1): 3, (1, 2, 1): 3}


def test_the_sample_is_bounded(spark):
    df = spark.range(5000).select(F.col("id").alias("row"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    assert [len(ann.sample(df, n)) for n in (100, 5000, 9000)] == [100, 5000, 5000] and len(ann.sample(df.limit(0), 5)) == 0
    assert (ann.sample(df, 100) == ann.sample(df.repartition(7), 100)).all()


def test_no_vector_comes_to_the_driver(spark, monkeypatch):
    """The sample meets, and codebooks are fitted, in a task: the driver's memory does not hold them."""
    driver, fit = os.getpid(), ann.fit

    def elsewhere(x):
        assert os.getpid() != driver
        return fit(x)

    def refused(*args):
        raise AssertionError("vectors on the driver")

    monkeypatch.setattr(ann, "fit", elsewhere)
    monkeypatch.setattr(ann, "sample", refused)
    r = random.Random(4)
    rows = {i: [r.gauss(0, 1) for _ in range(8)] for i in range(60)}
    df = vectors(spark, [(i, v, 0, "x", "y") for i, v in rows.items()])
    got = {(x.query_id, x["rank"]): x.vec_id for x in ann.search(df, F.col("vec_id") % 50 == 0).collect()}
    assert got == {(q, k): i for q, ids in exact(rows, [0, 50], 5).items() for k, i in enumerate(ids, 1)}


def test_blocks_and_rows_do_not_grow_with_the_partitions(spark):
    """At 6 GB there are 600 partitions: a query must not meet, and be sent to, a small block of each."""
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v], 0, "x", "y") for i, v in enumerate(r.normal(size=(900, 8)))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        used = ann.usable(vectors(spark, rows))
        assert dict(used.dtypes)["v"] == "array<float>"
        blocks = ann.index(used, r.normal(size=(2, 4, 8)).astype(np.float32)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(blocks) <= ann.SPREAD
    assert sorted(i for b in blocks for i in np.frombuffer(b.ids, "<i8")) == sorted(x.row for x in used.collect())


def test_look_ups_and_a_least_score():
    r = np.random.default_rng(6)
    books, codes, q = r.normal(size=(3, 5, 7)).astype(np.float32), r.integers(0, 5, (3, 50)).astype(np.uint8), r.normal(size=(4, 7)).astype(np.float32)
    got = ann.looked_up(books, codes, q, 16)
    assert np.abs(got - q @ books[np.arange(3)[:, None], codes].sum(0).T).max() < 1e-5
    least = np.sort(got, 1)[:, -4]
    every = [[c for c in a if got[k, c] >= least[k]] for k, a in enumerate(ann.best(got, 9))]
    assert [a.tolist() for a in ann.best(got, 9, least)] == every
    least[2] = -np.inf
    assert ann.best(got, 9, least)[2].tolist() == ann.best(got, 9)[2].tolist() and ann.best(got, 9, least)[0].tolist() == every[0]


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_few_vectors(spark, n):
    rows = [(50 * i, [1.0 + i, 2.0, float(i)], 0, "x", "y") for i in range(n)]
    out = ann.search(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert len(out) == n * min(n - 1, 5) if n else not out


def test_beam_search_beats_greedy():
    x = ann._unit(np.random.default_rng(1).normal(size=(600, 16)))
    books = ann.fit(x, books=4, words=32)

    def loss(beam):
        return float(((x - books[np.arange(4), ann.encode(x, books, beam)].sum(1)) ** 2).sum())

    assert loss(8) <= loss(1) and loss(8) < 0.5 * len(x)


def test_best_prefers_first_columns_on_ties():
    s = np.array([[1, 3, 3, 2, 3], [0, 0, 0, 0, 0]], np.float32)
    assert [a.tolist() for a in ann.best(s, 2)] == [[1, 2], [0, 1]]
