"""Byte-level BPE by a finite-state transducer, and streaming decoding.

The encoder reads a piece's bytes from left to right.  Its nondeterministic form keeps
every boundary at which the token being read may have begun: for each, the place in the
trie of tokens reached since, and the last token before it.  A token may follow another
only if the two, merged on their own, give exactly those two; with that rule each prefix
has one last token, which a transition puts out.  Sets of such boundaries are determinised
when first reached and numbered; the table of states is bounded and begins anew when full.
Tokens are emitted once all boundaries agree on them: at a piece's end, and in a long piece
whenever ``LAG`` bytes wait, of which only those of the last few tokens can stay open.

The decoder joins the tokens' bytes and follows an incremental UTF-8 state machine, so text
can be handed on as soon as its characters are complete.

Null text counts as empty (no ids; the hash of no bytes); rows are independent of each other,
so equal rows, null doc_ids and extra columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from . import text as tx
from .pieces import PieceCoder

STATES = 1 << 18
LAG = 1 << 10


def default_ranks() -> str:
    """File of the public byte-level ranks, where the package with it is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeTransducer:
    """The merges of a rank table as a transducer from bytes to ids, determinised as it is used."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = STATES, lag: int = LAG):
        self.ranks, self.most, self.lag = ranks, most_states, lag
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        self.step: dict[int, int] = {}  # trie: 256 * node + byte -> node
        self.token, self.depth = [-1], [0]
        for b, i in ranks.items():
            node = 0
            for x in b:
                nxt = self.step.get(node << 8 | x)
                if nxt is None:
                    nxt = self.step[node << 8 | x] = len(self.token)
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.token[node] = i
        self.inner = {k >> 8 for k in self.step}  # nodes that a longer token goes through
        self.pair: dict[int, bool] = {}
        self._clear()

    def _clear(self) -> None:
        # A state: for each boundary at which a token may have begun, the oldest first, one number of the
        # trie node reached since and, in its low 20 bits, one more than the last token before it.
        start = (0,)
        self.number: dict[tuple, int] = {start: 0}
        self.state: list[tuple] = [start]
        self.next: dict[int, int] = {}  # 256 * state + byte -> (state after it) << 20 | last token

    def merged(self, piece: bytes) -> list[int]:
        """Ids by carrying out the merges one by one: the definition, used on pairs of tokens."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            rank, k = min((self.ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[p] for p in parts]

    def _may_follow(self, a: int, b: int) -> bool:
        got = self.pair.get(a << 20 | b)
        if got is None:
            if len(self.pair) > 2 * self.most:
                self.pair.clear()
            got = self.pair[a << 20 | b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return got

    def _move(self, n: int, byte: int) -> int:
        """The state after ``byte`` and the last token of the prefix that ends there."""
        alive, whole = [], -1
        for bound in self.state[n]:
            last = (bound & 0xFFFFF) - 1
            to = self.step.get(bound >> 20 << 8 | byte)
            if to is None:
                continue
            if to in self.inner:
                alive.append(to << 20 | last + 1)
            t = self.token[to]
            if t >= 0 and (last < 0 or self._may_follow(last, t)):
                if whole >= 0:
                    raise ValueError("the ranks are no merge table: a prefix has two last tokens")
                whole = t
        if whole < 0:
            raise ValueError("the ranks are no merge table: a prefix has no last token")
        key = (*alive, whole + 1)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.state)
            self.state.append(key)
        move = self.next[n << 8 | byte] = to << 20 | whole
        return move

    def _back(self, lasts: list[int], at: int) -> list[int]:
        """The tokens of the first ``at`` bytes that are not emitted yet."""
        out = []
        while at:
            out.append(lasts[at - 1])
            at -= self.size[out[-1]]
        out.reverse()
        return out

    def _agreed(self, n: int, lasts: list[int]) -> list[int]:
        """The tokens on which all boundaries of state n agree; no later byte can change them."""
        chains = [self._back(lasts, len(lasts) - self.depth[bound >> 20]) for bound in self.state[n]]
        k = 0
        while all(len(c) > k and c[k] == chains[0][k] for c in chains):
            k += 1
        return chains[0][:k]

    def encode(self, piece: bytes) -> list[int]:
        if len(self.state) > self.most:
            self._clear()
        n, table = 0, self.next
        out: list[int] = []
        lasts: list[int] = []
        for byte in piece:
            move = table.get(n << 8 | byte) or self._move(n, byte)
            n = move >> 20
            lasts.append(move & 0xFFFFF)
            if len(lasts) >= self.lag:
                sure = self._agreed(n, lasts)
                out += sure
                del lasts[: sum(map(self.size.__getitem__, sure))]
        return out + self._back(lasts, len(lasts))


def _utf8_table() -> list[list[int]]:
    """Transitions of UTF-8: state 0 is between characters, 8 is an error; others await continuation bytes.
    1, 2, 3: one, two, three more; 4: after E0; 5: after ED; 6: after F0; 7: after F4."""
    table = [[8] * 256 for _ in range(9)]

    def put(state: int, low: int, high: int, to: int) -> None:
        table[state][low : high + 1] = [to] * (high + 1 - low)

    for low, high, to in ((0, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)):
        put(0, low, high, to)
    for state, low, high, to in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        put(state, low, high, to)
    return table


UTF8 = _utf8_table()
_HIGH = re.compile(rb"[\x80-\xff]+")


class StreamDecoder:
    """Ids in, text out; a character is handed on with its last byte.  What is no UTF-8 becomes U+FFFD."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.state, self.tail = bytes_of, 0, b""
        self.runs: dict[tuple[int, bytes], tuple[int, int]] = {}

    def _run(self, state: int, run: bytes) -> tuple[int, int]:
        """The state after a run of high bytes, and where in it the last character that is not complete began."""
        begin = -1 if state else 0
        for k, x in enumerate(run):
            if state in (0, 8):
                begin = k
            nxt = UTF8[state if state != 8 else 0][x]
            if nxt == 8 and state not in (0, 8):  # the byte may begin another character
                begin, nxt = k, UTF8[0][x]
            state = nxt
        return state, begin

    def raw(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def feed(self, ids: Iterable[int]) -> str:
        new = self.raw(ids)
        held = len(self.tail)
        data, state, open_at = self.tail + new, self.state, 0
        at = held
        for m in _HIGH.finditer(data, held):
            if m.start() > at:
                state = 0  # ASCII in between ends any character
            run = m.group()
            got = self.runs.get((state, run))
            if got is None:
                if len(self.runs) > 1 << 16:
                    self.runs.clear()
                got = self.runs[state, run] = self._run(state, run)
            state = got[0]
            if got[1] >= 0:
                open_at = m.start() + got[1]
            at = m.end()
        if at < len(data) and len(new):
            state = 0
        keep = open_at if state not in (0, 8) else len(data)
        self.state, self.tail = (state if keep < len(data) else 0), data[keep:]
        return data[:keep].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.tail, self.state = self.tail, b"", 0
        return rest.decode("utf-8", "replace")


@cache
def transducer(path: str) -> MergeTransducer:
    """This worker's transducer; states and pieces stay known as long as the worker lives."""
    return MergeTransducer(read_ranks(path))


@cache
def coder(path: str) -> PieceCoder:
    encode = transducer(path).encode
    return PieceCoder(lambda strings: [encode(s.encode()) for s in strings], most=1 << 19)


def encode_texts(texts: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    pc = coder(path)
    for first, block in tx.blocks(texts):
        yield first, *pc.block(block)


def encode(docs: DataFrame, *, ranks: str | None = None) -> DataFrame:
    """doc_id, ids of every document (null text: none)."""
    path = ranks or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, ids, count in encode_texts(batch.column(1), path):
                upto = np.append(0, np.cumsum(count)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(upto), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(count)), lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, *, ranks: str | None = None, step: int = 4096) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); ids are decoded ``step`` at a time.  Null ids give null."""
    path = ranks or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = transducer(path).bytes_of
        for batch in batches:
            out = []
            for ids in batch.column(1):
                ids = ids.as_py()
                if ids is None:
                    out.append(None)
                    continue
                d = StreamDecoder(table)
                out.append("".join([*(d.feed(ids[k : k + step]) for k in range(0, len(ids), step)), d.close()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


@cache
def _written_numbers(path: str) -> list[bytes]:
    return [b"%d" % i for i in range(max(transducer(path).bytes_of) + 1)]


def digests(docs: DataFrame, *, ranks: str | None = None, step: int = 1 << 16) -> DataFrame:
    """Encode and decode every document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = ranks or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, number = transducer(path).bytes_of, _written_numbers(path)
        d = StreamDecoder(table)
        for batch in batches:
            for first, ids, count in encode_texts(batch.column(1), path):
                end = np.cumsum(count)
                rows = []
                for a, b in zip((end - count).tolist(), end.tolist()):
                    own = ids[a:b].tolist()
                    spelled = hashlib.sha256(b" ".join(map(number.__getitem__, own))).hexdigest()
                    back = hashlib.sha256()
                    for k in range(0, len(own), step):
                        back.update(d.feed(own[k : k + step]).encode())
                    back.update(d.close().encode())
                    rows.append((spelled, back.hexdigest()))
                s, t = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(count)), pa.array(count), pa.array(s), pa.array(t)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(scratch.documents(spark, sf_dir))
