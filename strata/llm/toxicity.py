"""Toxicity by a weighted finite-state grammar over clauses.

A clause is a run of words between stops.  A lexical transducer maps its words to symbols
(insult, threat, target, self, modal, negation, reported speech, contest, other) with a weight
for each insult and threat.  Small transducers over the symbols then match patterns of several
words.  From left to right: negation weakens what follows within its reach; reported speech
weakens what follows it in the clause; an insult soon after a target is aimed; a threat soon
after a self or a modal is announced.  From right to left: a threat counts only if its object, a
target, follows soon, more so if it is announced, and hardly if a contest follows ("beat you at
chess"); an insult soon before a target is aimed too.  Those of one direction are composed into one
deterministic transducer, and a clause is read once each way (a bimachine).  Its score is the sum of
the matches' weights; the weakest pattern is an insult named in a clause without a target, and a
threat without an object matches none.

The vocabulary of insults is a short seed list and what the labels teach: whole words and word
beginnings (inflected stems) that are far commoner in toxic texts, by a likelihood ratio test whose
limit follows from the number of terms tested.  A logistic model turns the clause scores of a text
into a probability.  Both are fitted on at most ``TRAIN_ROWS`` labelled rows (those with the
smallest hash of their id), each distinct text once; texts are counted where they lie, and only
the terms that pass the test and three numbers a row reach the driver.

Null text counts as empty and gets the score of a text without matches; rows without a label, or
with a null one, are scored like others; several labels of one document count as toxic if any is;
null doc_ids are not held out; equal rows get equal scores; an empty table, or no usable labels,
leaves the seed list and a fixed model.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

TRAIN_ROWS = 20_000
PREFIXES = range(4, 9)  # code points of a word beginning
LEAST_LIFT = 2.0  # log of the ratio of a term's rates
THRESHOLD = 0.3
SEED_WEIGHT, MOST_WEIGHT = 3.0, 6.0
REACH = 3  # words that a negation, a target, a self or a modal goes on for

WORD = re.compile(r"[^\W\d_]+")
STOP = re.compile(r"[.!?;:,\n]+")

# Seed words of each symbol, in the corpus' languages.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown imbecile dumb idiota imbécil estúpido basura escoria dummkopf idiotin abschaum versager wertlos idiote crétin stupide ordure minable".split()
THREATS = "kill hurt destroy murder beat stab shoot burn töten umbringen verletzen tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours u he they him her them these those people du dich dein ihr euch sie tu te toi vous ton votre usted ustedes tú ellos".split()
SELVES = "i we ich wir je nous yo nosotros".split()
MODALS = "will ll gonna going shall want must should let werde werden wird vais allons veux voy vamos quiero".split()
NEGATIONS = "not never no nobody isn aren wasn don doesn cannot nicht nie kein keine pas jamais aucun ni nunca jamás".split()
REPORTS = "said says wrote writes claimed reported quoted according called alleged sagte schrieb behauptete laut dit écrit déclaré selon dijo escribió según afirmó".split()
CONTESTS = "at im beim".split()

OTHER, INSULT, THREAT, TARGET, SELF, MODAL, NEGATION, REPORT, CONTEST = "oitgsmnrc"
AIMED, ANNOUNCED, MATCHED = "IMT"  # what the patterns put out for insults and threats
READ = OTHER + INSULT + THREAT + TARGET + SELF + MODAL + NEGATION + REPORT + CONTEST
WRITTEN = READ + AIMED + ANNOUNCED


class Transducer:
    """A deterministic weighted transducer over single symbols.  ``arcs[state, symbol]`` is
    (state, symbol put out, weight factor); a symbol without an arc passes unchanged."""

    def __init__(self, start, arcs: dict):
        self.start, self.arcs = start, arcs

    def step(self, state, symbol: str):
        return self.arcs.get((state, symbol), (state, symbol, 1.0))

    def compose(self, after: Transducer, symbols: str) -> Transducer:
        """This one, with what it puts out read by ``after``; over states that can be reached."""
        start = (self.start, after.start)
        arcs, todo, seen = {}, [start], {start}
        while todo:
            state = todo.pop()
            for s in symbols:
                one, middle, w = self.step(state[0], s)
                two, out, v = after.step(state[1], middle)
                arcs[state, s] = ((one, two), out, w * v)
                if (one, two) not in seen:
                    seen.add((one, two))
                    todo.append((one, two))
        return Transducer(start, arcs)


def _fading(marks: str, change: dict[str, tuple[str, float]]) -> Transducer:
    """One of ``marks`` holds for ``REACH`` words; what comes in that reach is changed (symbol put out, factor)."""
    arcs = {}
    for k in range(REACH + 1):
        for x in WRITTEN:
            arcs[k, x] = (REACH if x in marks else max(k - 1, 0), *(change[x] if k and x in change else (x, 1.0)))
    return Transducer(0, arcs)


def _negation() -> Transducer:
    return _fading(NEGATION, {INSULT: (INSULT, 0.3), THREAT: (THREAT, 0.3)})


def _reported() -> Transducer:
    arcs = {(k, REPORT): (1, REPORT, 1.0) for k in (0, 1)}
    arcs |= {(1, s): (1, s, 0.5) for s in (INSULT, THREAT)}
    return Transducer(0, arcs)


def _aimed() -> Transducer:
    return _fading(TARGET, {INSULT: (AIMED, 1.5)})


def _announced() -> Transducer:
    return _fading(SELF + MODAL, {THREAT: (ANNOUNCED, 1.0)})


def _contest() -> Transducer:
    """Right to left: a threat whose object stands right before a contest is a game's."""
    arcs = {("none", CONTEST): ("contest", CONTEST, 1.0), ("contest", CONTEST): ("contest", CONTEST, 1.0), ("contest", TARGET): ("object", TARGET, 1.0)}
    for x in WRITTEN:
        arcs.setdefault(("contest", x), ("none", x, 1.0))
        arcs[("object", x)] = ("none", x, 0.1 if x in (THREAT, ANNOUNCED) else 1.0)
    arcs["object", CONTEST] = ("contest", CONTEST, 1.0)
    return Transducer("none", arcs)


def _object() -> Transducer:
    """Right to left: a threat needs a target after it; an insult with one after it is aimed."""
    t = _fading(TARGET, {THREAT: (MATCHED, 0.5), ANNOUNCED: (MATCHED, 1.5), INSULT: (AIMED, 1.2)})
    for x in (THREAT, ANNOUNCED):
        t.arcs[0, x] = (0, x, 0.0)
    return t


FORWARD, BACKWARD = (_negation, _reported, _aimed, _announced), (_contest, _object)


def _composed(parts: tuple[Callable[[], Transducer], ...]) -> Transducer:
    first, *others = [p() for p in parts]
    return reduce(lambda a, b: a.compose(b, WRITTEN), others, first)


class Grammar:
    """Lexicon and composed grammar; ``weights`` has the learnt terms (``*`` ends a word beginning)."""

    def __init__(self, weights: dict[str, float]):
        self.words = {w: (INSULT, SEED_WEIGHT) for w in INSULTS} | {w: (THREAT, SEED_WEIGHT) for w in THREATS}
        self.words |= {w: (INSULT, v) for w, v in weights.items() if w[-1] != "*"}
        self.stems = {w[:-1]: v for w, v in weights.items() if w[-1] == "*"}
        marks = ((TARGET, TARGETS), (SELF, SELVES), (MODAL, MODALS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (CONTEST, CONTESTS))
        self.context = {w: s for s, ws in marks for w in ws}
        self.forward, self.backward = _composed(FORWARD), _composed(BACKWARD)
        self.finder = ahocorasick.Automaton()
        for w in {*self.words, *self.stems}:
            self.finder.add_word(w, len(w))
        self.finder.make_automaton()

    def lexical(self, word: str) -> tuple[str, float]:
        best = self.words.get(word)
        for n in PREFIXES:
            if n > len(word):
                break
            v = self.stems.get(word[:n])
            if v is not None and (best is None or v > best[1]):
                best = (INSULT, v)
        return best or (self.context.get(word, OTHER), 0.0)

    def clause(self, words: list[str]) -> float:
        """The sum of the weights of a clause's matches."""
        state, symbols, weights = self.forward.start, [], []
        for w in words:
            symbol, weight = self.lexical(w)
            state, symbol, factor = self.forward.step(state, symbol)
            symbols.append(symbol)
            weights.append(weight * factor)
        if not any(weights):
            return 0.0
        state, total = self.backward.start, 0.0
        for symbol, weight in zip(reversed(symbols), reversed(weights)):
            state, _, factor = self.backward.step(state, symbol)
            total += weight * factor
        return total

    def features(self, text: str) -> tuple[float, float, float]:
        """Of the clauses that match: log of the summed scores, the largest, and how many per log of words."""
        low = text.lower()
        if not any(e + 1 == n or not low[e - n].isalpha() for e, n in self.finder.iter(low)):
            return 0.0, 0.0, 0.0
        scores, n = [], 0
        for part in STOP.split(low):
            words = WORD.findall(part)
            n += len(words)
            s = self.clause(words)
            if s > 0:
                scores.append(s)
        if not scores:
            return 0.0, 0.0, 0.0
        return math.log1p(sum(scores)), max(scores), len(scores) / math.log(n + 2)


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic: the bounded sample of labelled rows that are not held out, each text once."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out())
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marks), "doc_id")  # TRAIN_ROWS pairs of numbers at most
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scratch.written(rows.groupBy("text").agg(F.max("toxic").alias("toxic")).repartition(n), "toxicity-train")


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other texts each word and word beginning stands, summed over a task."""
    counts: tuple[Counter, Counter] = Counter(), Counter()
    for batch in batches:
        for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
            found = set()
            for w in set(WORD.findall((text or "").lower())):
                found.add(w)
                found.update(w[:n] + "*" for n in PREFIXES if n <= len(w))
            found.add("")  # the text itself
            counts[toxic > 0].update(found)
            if len(counts[0]) + len(counts[1]) > 1 << 20:
                yield from _counted(counts)
    yield from _counted(counts)


def _counted(counts: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
    for toxic, c in enumerate(counts):
        n = pa.array(list(c.values()), pa.int64())
        zero = pa.array(np.zeros(len(c), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), *((zero, n) if toxic else (n, zero))], ["term", "other", "toxic"])
        c.clear()


def learn_terms(train: DataFrame) -> dict[str, float]:
    """Weights of the terms that set toxic texts apart."""
    counts = scratch.written(train.mapInArrow(_terms, "term string, other long, toxic long").groupBy("term").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).filter("toxic > 2"), "toxicity-terms")
    whole = counts.filter(F.col("term") == "").first()
    if whole is None or not whole.other or not whole.toxic:
        return {}
    n0, n1 = float(whole.other), float(whole.toxic)
    share = n1 / (n0 + n1)
    a, b = F.col("toxic").cast("double"), F.col("other").cast("double")
    least = 2 * math.log(max(counts.count(), 2))  # of so many terms that say nothing, about one passes
    lift = F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))
    ratio = 2 * (a * F.log(a / ((a + b) * share)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0))
    top = counts.filter((F.col("term") != "") & (lift >= LEAST_LIFT) & (ratio >= least)).select("term", lift.alias("lift"))
    rows = top.orderBy("term").collect()  # of the words of TRAIN_ROWS texts at most
    found = {r.term: min(r.lift, MOST_WEIGHT) for r in rows}
    # A longer beginning (or a word) says nothing that a beginning of it does not say as strongly.
    return {t: w for t, w in found.items() if not any(found.get(t.rstrip("*")[:n] + "*", 0.0) >= w and t != t[:n] + "*" for n in PREFIXES if n <= len(t.rstrip("*")))}


#: For want of labels: intercept and weights of the features.
UNFITTED = (-3.0, 1.0, 0.5, 0.0)


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 50) -> tuple[float, ...]:
    """Logistic regression by Newton's method, on features scaled to unit spread."""
    if not len(y) or y.min() == y.max():
        return UNFITTED
    spread = x.std(0)
    spread[spread == 0] = 1
    a = np.column_stack([np.ones(len(y)), x / spread])
    w = np.zeros(a.shape[1])
    keep = penalty * len(y) * np.diag([1e-6, *[1] * x.shape[1]]) / 100
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + keep, a.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), *(float(v) for v in w[1:] / spread))


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], tuple[float, ...]]:
    """Term weights and logistic model."""
    rows = training_rows(docs, labels)
    weights = learn_terms(rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(weights)
        for batch in batches:
            x = [g.features(t or "") for t in batch.column(0).to_pylist()]
            cols = list(zip(*x)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.float64()) for c in cols), batch.column(1)], ["a", "b", "c", "toxic"])

    found = rows.mapInArrow(features, "a double, b double, c double, toxic int").toPandas()  # at most TRAIN_ROWS
    found = found.sort_values(["a", "b", "c", "toxic"])
    return weights, fit(found[["a", "b", "c"]].to_numpy(), (found["toxic"] > 0).to_numpy(float))


def score(docs: DataFrame, model: tuple[dict[str, float], tuple[float, ...]]) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    weights, (w0, *w) = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(weights)
        for batch in batches:
            x = np.array([g.features(t.as_py() or "") for t in batch.column(2)]).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(w0 + x @ np.array(w), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op8_clause_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scratch.documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
