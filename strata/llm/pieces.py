"""Byte-pair encoding of whole blocks of text, one distinct piece at a time.

The rank files' pattern cuts a text into pieces that are encoded independently.
Here the cut is found with array operations on the classes of code points, and a
bounded table remembers the ids of pieces seen before, so an encoder (a library's,
or the transducer of ``bpe``) only ever sees pieces that are new to this worker.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import regex

from . import text as tx

SPACE, WHITE, LETTER, NUMBER, OTHER = range(5)
GROUP = np.array([0, 0, 1, 2, 3], np.int8)


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.int8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        found = "".join(regex.findall(pattern, every))
        out[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    out[32] = SPACE
    return out


def piece_starts(block: tx.Block) -> np.ndarray:
    """Where the pieces of a block's texts begin, and where the line feeds between the texts are."""
    c = block.cps
    n = len(c)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[c]
    group = GROUP[kind]
    start = np.ones(n, bool)
    start[1:] = group[1:] != group[:-1]
    edge = block.end[:-1]  # the line feeds that joined the texts
    begins = np.zeros(n + 1, bool)
    begins[block.start] = True
    begins[edge] = True
    begins = begins[:n]
    start |= begins
    # White space before a word: its last character goes with the word if it is a space, else alone.
    into = np.flatnonzero((group[1:] != 0) & (group[:-1] == 0) & ~begins[1:]) + 1
    start[into - 1] = True
    start[into[kind[into - 1] == SPACE]] = False
    # Contractions, where an apostrophe begins a piece.
    at = np.flatnonzero((c == 39) & start)
    if len(at):
        text_end = block.end[np.searchsorted(block.end, at, "left")]
        one = np.where(at + 1 < text_end, c[np.minimum(at + 1, n - 1)], 0)
        two = np.where(at + 2 < text_end, c[np.minimum(at + 2, n - 1)], 0)
        pair = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
        size = np.where(np.isin(one, [*map(ord, "stmd")]), 1, 0)
        for a, b in pair:
            size = np.where((one == a) & (two == b), 2, size)
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        after = at + 1 + size
        start[after[after < n]] = True
    return np.flatnonzero(start)


class PieceCoder:
    """Ids of pieces, by ``encode`` (strings to lists of ids) and a table of up to ``most`` pieces."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 1 << 20):
        self.encode, self.most = encode, most
        self.bits = (4 * most - 1).bit_length()
        self._clear()

    def _clear(self) -> None:
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.n = self.n_ids = self.n_cps = 0
        self.key = np.zeros(1 << 12, tx.U64)
        self.id_at, self.id_len, self.cp_at = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.ids = np.zeros(1 << 14, np.uint32)
        self.cps = np.zeros(1 << 15, np.uint32)

    def _fit(self, names: tuple[str, ...], n: int) -> None:
        for name in names:
            a = getattr(self, name)
            if len(a) < n:
                b = np.zeros(1 << int(n).bit_length(), a.dtype)
                b[: len(a)] = a
                setattr(self, name, b)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        mask = (1 << self.bits) - 1
        pos = (h >> tx.U64(64 - self.bits)).astype(np.int64)
        got = self.table[pos]
        todo = np.flatnonzero((got >= 0) & (self.key[got] != h))
        while len(todo):
            pos[todo] = (pos[todo] + 1) & mask
            got[todo] = self.table[pos[todo]]
            g = got[todo]
            todo = todo[(g >= 0) & (self.key[g] != h[todo])]
        return got

    def _add(self, h: np.ndarray, strings: list[str]) -> None:
        """New entries; the hashes are distinct and not in the table."""
        ids = self.encode(strings)
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for y in ids for x in y), np.uint32, int(count.sum()))
        cps = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4")
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        a, b = self.n, self.n + len(h)
        self._fit(("key", "id_at", "id_len", "cp_at"), b)
        self._fit(("ids",), self.n_ids + len(flat))
        self._fit(("cps",), self.n_cps + len(cps))
        self.key[a:b] = h
        self.id_at[a:b] = self.n_ids + np.cumsum(count) - count
        self.id_len[a:b] = count
        self.cp_at[a:b] = self.n_cps + np.cumsum(size) - size
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.cps[self.n_cps : self.n_cps + len(cps)] = cps
        self.n, self.n_ids, self.n_cps = b, self.n_ids + len(flat), self.n_cps + len(cps)
        mask = (1 << self.bits) - 1
        entry = np.arange(a, b, dtype=np.int32)
        pos = (h >> tx.U64(64 - self.bits)).astype(np.int64)
        while len(entry):
            free = self.table[pos] < 0
            self.table[pos[free]] = entry[free]
            lost = self.table[pos] != entry
            entry, pos = entry[lost], (pos[lost] + 1) & mask

    def block(self, block: tx.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, and how many each text has."""
        start = piece_starts(block)
        drop = block.end[:-1]
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(block.texts), np.int64)
        end = np.append(start[1:], len(block.cps))
        keep = np.ones(len(block.cps), bool)
        keep[drop] = False
        inside = keep[start]
        start, end = start[inside], end[inside]
        h = tx.ROLL.ranges(tx.ROLL.prefix(tx.char_values(block.cps)), start, end)
        entry = self._find(h)
        miss = np.flatnonzero(entry < 0)
        fits = True
        if len(miss):
            new, at = np.unique(h[miss], return_index=True)
            at = miss[at]
            if self.n + len(new) > self.most:
                self._clear()
                new, at = np.unique(h, return_index=True)
                fits = len(new) <= self.most
            if fits:
                s = block.joined
                self._add(new, [s[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())])
                entry = self._find(h)
        if fits:  # a piece that only shares its hash with the one in the table must not take its ids
            at = tx.ragged(self.cp_at[entry], end - start)
            fits = bool((at < len(self.cps)).all()) and np.array_equal(self.cps[at], block.cps[keep])
        if fits:
            count = self.id_len[entry]
            ids = self.ids[tx.ragged(self.id_at[entry], count)]
        else:
            s = block.joined
            lists = self.encode([s[a:b] for a, b in zip(start.tolist(), end.tolist())])
            count = np.fromiter(map(len, lists), np.int64, len(lists))
            ids = np.fromiter((x for y in lists for x in y), np.uint32, int(count.sum()))
        upto = np.append(0, np.cumsum(count))
        first = np.append(np.searchsorted(start, block.start), len(start))
        return ids, np.diff(upto[first])
