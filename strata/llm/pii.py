"""Personal data by base patterns and a skip-chain conditional random field.

The base patterns' spans always stand.  The field decides about what they leave: numbers in
other spellings, and addresses.  Its nodes are the units of a document that could be personal
data at all (numbers of seven or more digits, dotted numbers, units with ``@``); every other
word is "other" with certainty and only speaks as context.  Nodes of one content (same digits, same
last nine digits, same address) and shape share one variable over the whole document, however far
apart, so its prior counts once and repeats cannot outvote what is known.  Variables have potentials
from their shape, the base patterns (which are certain) and the cue words before them; those of one
content are linked to what the base patterns found of it, and neighbours in a chain where they are
first met.  Loopy message passing over both kinds of link runs until it settles, so a phone number
spelled without its plus sign is found because it stands elsewhere with it.  Links grow with the
nodes, not with their pairs.

The weights are parameters (there are no labels of personal data to learn them from); an
unlinked node without a cue is never reported by its shape alone.

Null text counts as empty (no spans); texts of any length are scanned whole, in time that grows with
their length; documents are independent of each other, so equal rows,
null ids and extra columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

KINDS = ("email", "ip", "card", "phone")
# The base patterns match what the stated ones match, but look at no character more than a few times:
# an address is found from its @, numbers from the first digit of a run, and runs are never given back.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE_DOMAIN = re.compile(r"@[A-Za-z0-9.-]++")
FIGURE = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,3}+[0-9])++")
NUMBER = re.compile(r"[0-9]+")
#: What a text with any base span or node must contain.
TRACE = r"@|\+[0-9]|[0-9][ ().-]{0,3}[0-9][ ().-]{0,3}[0-9][ ().-]{0,3}[0-9]"

CUES = {  # fixed values: words that announce each kind, in the corpus' languages
    "email": ("email", "e-mail", "mail", "courriel", "correo", "contact", "kontakt"),
    "ip": ("ip", "server", "host", "address", "adresse", "servidor", "serveur"),
    "card": ("card", "credit", "visa", "mastercard", "karte", "kreditkarte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "anruf", "téléphone", "appel", "teléfono", "móvil", "llame"),
}
_CUE = {w: k for k, name in enumerate(KINDS, 1) for w in CUES[name]}
CONTEXT = 48  # code points before a node in which cues count
BASE, NEVER = 8.0, -30.0
PRIOR = {"email": -3.0, "ip": -4.0, "card": -4.0, "phone": -3.0}
CUE, SHAPE, GROUPED, PLAIN = 2.0, 1.5, 0.5, -2.0
NEAR, CHAIN, SAME, SIMILAR = 64, 0.3, 6.0, 5.0
DAMPING, SURE = 0.3, 0.5
#: Messages have settled when none moves by more; the rounds end in any case, if they never do.
SETTLED, MOST_ROUNDS = 1e-6, 10_000


def luhn(digits: str) -> bool:
    d = [*map(int, reversed(digits))]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(NUMBER.findall(s))


def _run_start(text: str, low: int, at: int) -> int:
    """Where the run of ``LOCAL`` characters before ``at`` begins, not before ``low``."""
    step = 64
    while True:
        a = max(low, at - step)
        n = LOCAL.match(text[a:at][::-1]).end()
        if n < at - a or a == low:
            return at - n
        step *= 4


def _addresses(text: str, domain: re.Pattern) -> Iterator[tuple[int, int]]:
    """Spans of a run of ``LOCAL`` characters and a ``domain``, leftmost, without overlaps."""
    at, low = text.find("@"), 0
    while at >= 0:
        m = domain.match(text, at)
        start = _run_start(text, low, at) if m else at
        low = at + 1
        if start < at:
            low = m.end()
            yield start, low
        at = text.find("@", low)


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start."""
    out = [(0, a, b) for a, b in _addresses(text, DOMAIN)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(_octet, m.group().split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def _units(text: str) -> list[tuple[int, int]]:
    """Spans that could be personal data at all: addresses, and figures of seven or more digits outside them."""
    out = [*_addresses(text, LOOSE_DOMAIN)]
    mails, k = len(out), 0
    for m in FIGURE.finditer(text):
        while k < mails and out[k][1] <= m.start():
            k += 1
        if (k == mails or out[k][0] >= m.end()) and len(_digits(m.group())) >= 7:
            out.append(m.span())
    return sorted(out)


class Field:
    """The random field of one document.  Occurrences of one content (same address, same last nine
    digits, or same digits where there are fewer) whose shapes allow the same kinds share a variable."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        self.text = text
        found = {(a, b): k for k, a, b in base}
        spans = set(found)
        taken = sorted(spans)
        at = 0
        for a, b in _units(text):  # units that no base span touches
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            if at == len(taken) or taken[at][0] >= b:
                spans.add((a, b))
        self.nodes = sorted(spans)
        self.base = [found.get(s, -1) for s in self.nodes]
        self.variable, self.first, self.contents = [], [], []
        ids: dict[tuple, int] = {}
        unary: list[list[float]] = []
        for (a, b), kind in zip(self.nodes, self.base):
            scores = self._unary(a, b, kind)
            whole, end = self._keys(a, b)
            v = ids.setdefault((end, kind, tuple(x > NEVER / 2 for x in scores)), len(ids))
            self.first.append(v == len(unary))
            self.variable.append(v)
            if self.first[-1]:
                unary.append(scores)
                self.contents.append((end, kind, {whole}))
            else:  # the prior counts once, in the likeliest spelling and place
                unary[v] = [*map(max, unary[v], scores)]
                self.contents[v][2].add(whole)
        self.unary = np.array(unary).reshape(-1, len(KINDS) + 1)
        self.edges, self.weights = self._links()

    def _unary(self, a: int, b: int, kind: int) -> list[float]:
        if kind >= 0:
            return [-np.inf, *(BASE if k == kind else -np.inf for k in range(len(KINDS)))]
        s = self.text[a:b]
        n = len(_digits(s))
        scores = [0.0, NEVER, NEVER, NEVER, NEVER]
        if "@" in s:
            scores[1] = PRIOR["email"]
        else:
            if s.count(".") == 3 and n <= 12:
                scores[2] = PRIOR["ip"]
            if 13 <= n <= 19:
                scores[3] = PRIOR["card"] + SHAPE
            if 7 <= n <= 15:
                scores[4] = PRIOR["phone"] + (SHAPE if n >= 9 else 0) + (PLAIN if n == len(s) else GROUPED)
        before = self.text[max(0, a - CONTEXT) : a].lower()
        for w in re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", before)[-4:]:
            k = _CUE.get(w)
            if k:
                scores[k] += CUE
        return scores

    def _keys(self, a: int, b: int) -> tuple[str, str]:
        """What two spellings of one content have in common at most, and at least."""
        s = self.text[a:b]
        if "@" in s:
            return (s.lower().rstrip("."),) * 2
        d = _digits(s)
        return d, "end " + d[-9:] if len(d) >= 9 else d

    def _links(self) -> tuple[np.ndarray, np.ndarray]:
        edges: dict[tuple[int, int], float] = {}
        alike: dict[str, list[int]] = {}
        for v, (end, _, _) in enumerate(self.contents):
            alike.setdefault(end, []).append(v)
        for vs in alike.values():  # a handful at most: one for each kind and shape
            known = [v for v in vs if self.contents[v][1] >= 0]
            for v in vs:
                if self.contents[v][1] < 0:
                    for k in known or vs[:1]:
                        if k != v:
                            edges[min(k, v), max(k, v)] = SAME if self.contents[k][2] & self.contents[v][2] else SIMILAR
        for i in range(1, len(self.nodes)):
            # Only where a content is first met, so that repeats add nothing for or against it.
            if self.nodes[i][0] - self.nodes[i - 1][1] <= NEAR and all(self.first[j] or self.base[j] >= 0 for j in (i - 1, i)):
                a, b = sorted(self.variable[i - 1 : i + 1])
                if a != b:
                    edges.setdefault((a, b), CHAIN)
        return np.array([*edges], np.int64).reshape(-1, 2), np.array([*edges.values()])

    def beliefs(self) -> np.ndarray:
        """Probability of each label of each variable, by loopy sum-product until no message moves."""
        u = self.unary
        if len(self.edges):
            e, n = self.edges, len(self.edges)
            source, target = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
            back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
            bonus = np.concatenate([self.weights, self.weights])[:, None, None] * np.eye(u.shape[1])
            m = np.zeros((2 * n, u.shape[1]))
            for _ in range(MOST_ROUNDS):
                total = u.copy()
                np.add.at(total, target, m)
                x = (total[source] - m[back])[:, :, None] + bonus
                top = x.max(1)
                new = top + np.log(np.exp(x - top[:, None, :]).sum(1))
                new -= new.max(1, keepdims=True)
                new = DAMPING * m + (1 - DAMPING) * new
                moved, m = np.abs(new - m).max(), new
                if moved < SETTLED:
                    break
            u = u.copy()
            np.add.at(u, target, m)
        p = np.exp(u - u.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def added(self) -> list[tuple[int, int, int]]:
        """(kind, start, end) of the nodes that the field labels and no base pattern does."""
        out = []
        for (a, b), kind, p in zip(self.nodes, self.base, self.beliefs()[self.variable] if self.nodes else ()):
            if kind < 0 and p[0] < SURE:
                s = self.text[a:b]
                out.append((int(p[1:].argmax()), a, b - (len(s) - len(s.rstrip(".-"))) if "@" in s else b))
        return out


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, both by kind and start."""
    base = base_spans(text)
    field = Field(text, base)
    return base, sorted(base + (field.added() if len(field.nodes) > len({s[1:] for s in base}) else []))


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and all spans of every row."""
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            mask = pc.match_substring_regex(batch.column(1), TRACE).fill_null(False)
            for t in pc.if_else(mask, batch.column(1), None).to_pylist():
                if t is None:
                    rows.append((0, 0, 0, 0, none, ""))
                    continue
                base, every = spans(t)
                kinds = [s[0] for s in base]
                rows.append((*map(kinds.count, range(4)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op10_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(scratch.documents(spark, sf_dir))
