"""Vectorised views of text: code points, words, lines and hashes of their ranges.

Everything works on blocks of about 260,000 characters, so memory does not
depend on how many rows an Arrow batch holds; only a single longer text makes a
longer block.  Ranges (words, lines, windows) are hashed from prefix sums of a
polynomial modulo 2**64, so a window costs the same however many words it has.  Texts
can be made whose polynomials agree, so such a hash only sorts out what cannot be equal;
what is to be equal is told by ``digests`` (SHA-256) or by comparing the characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64 bits: spreads every input bit over all output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


class Roller:
    """Hashes of ranges ``[start, end)`` of an array, by prefix sums."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << int(n - 1).bit_length()
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, b, U64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.empty(len(values) + 1, U64)
        out[0] = 0
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(U64))


ROLL = Roller(0x9E3779B97F4A7C15)
ROLL2 = Roller(0xD6E8FEB86659FD93)
_LATIN = mix(np.arange(1, 1 << 16, dtype=U64))


def char_values(cps: np.ndarray) -> np.ndarray:
    """A random-looking 64-bit value for each code point."""
    if len(cps) and int(cps.max()) >= len(_LATIN):
        return mix(cps.astype(U64) + U64(1))
    return _LATIN[cps]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i]`` of all i, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def digests(data: bytes, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """SHA-256 of the ranges of ``data``, cut to 128 bits: two columns of 64 bits."""
    out = np.empty((len(starts), 2), U64)
    for k in range(0, len(starts), step):
        raw = b"".join([sha256(data[a:b]).digest() for a, b in zip(starts[k : k + step].tolist(), ends[k : k + step].tolist())])
        out[k : k + step] = np.frombuffer(raw, "<u8").reshape(-1, 4)[:, :2]
    return out


class Block:
    """Texts joined by line feeds, as code points.  ``start[i]:end[i]`` is text i."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.joined = "\n".join(texts)
        self.cps = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), "<u4")
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(length + 1) - 1
        self.start = self.end - length

    def word_mask(self) -> np.ndarray:
        c = self.cps
        return ~((c == 32) | ((c >= 9) & (c <= 13)))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and for each text the number of words before it (one more
        at the end)."""
        m = np.zeros(len(self.cps) + 2, np.int8)
        m[1:-1] = self.word_mask()
        d = np.diff(m)
        starts, ends = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
        return starts, ends, np.append(np.searchsorted(starts, self.start), len(starts))


    def spaced(self, lower: bool = False) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words in UTF-8, joined by single spaces, and where each begins and ends.  With ``lower``,
        A-Z are put in lower case."""
        raw = self.joined.encode("utf-8", "surrogatepass")
        words = (raw.lower() if lower else raw).split()
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size + 1) - 1
        return b" ".join(words), ends - size, ends


def blocks(texts: pa.Array | pa.ChunkedArray, limit: int = BLOCK) -> Iterator[tuple[int, Block]]:
    """Blocks of consecutive texts, each with the row it begins at.  Null counts as empty."""
    rows, size, first = [], 0, 0
    for i, t in enumerate(texts):
        t = t.as_py() or ""
        if rows and size + len(t) > limit:
            yield first, Block(rows)
            rows, size, first = [], 0, i
        rows.append(t)
        size += len(t) + 1
    if rows:
        yield first, Block(rows)


def windows(n_before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``width`` words that lie in one text: their first words, and their texts."""
    per = np.maximum(np.diff(n_before) - width + 1, 0)
    return ragged(n_before[:-1], per), np.repeat(np.arange(len(per)), per)


def distinct_rows(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of some columns sorted (the first column counts most), and where new values begin."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of the entries whose value occurs more than once."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Mask over n words of those in one of the windows of ``width`` that begin at ``starts``."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1) if len(starts) < 64 else d.__iadd__(np.bincount(starts, minlength=n + 1).astype(np.int32))
    stop = np.minimum(starts + width, n)
    d -= np.bincount(stop, minlength=n + 1).astype(np.int32)
    return np.cumsum(d[:-1]) > 0
