"""Token ids of documents by the tokenizers library, for packing and for token files.

``encode_blocks`` is the shared hot path.  Pieces new to a worker go to the library
many at a time, joined by line feeds (which the pattern always cuts off, and whose id
no such piece contains); white-space pieces go one by one.

A special token's string in a text gives that token's id, as the library does by itself, and the
text is cut there; with ``special=False`` it is ordinary text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from . import text as tx
from .pieces import PieceCoder

JOINED = 512


def default_tokenizer() -> str:
    """File of the public byte-level vocabulary, where the package with it is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def added(path: str) -> tuple[dict[str, int], re.Pattern | None]:
    """The vocabulary's special tokens, by their strings, and what finds them: the longest at each place."""
    tokens = {t.content: i for i, t in library(path).get_added_tokens_decoder().items() if not _plain(t)}
    strings = sorted(tokens, key=len, reverse=True)
    return tokens, re.compile("|".join(map(re.escape, strings))) if strings else None


def _plain(token) -> bool:
    if token.lstrip or token.rstrip or token.single_word:
        raise ValueError(f"{token.content!r} depends on what is next to it, which is not supported")
    return not token.content


@cache
def coder(path: str) -> PieceCoder:
    """This worker's coder for a vocabulary file; its table lives as long as the worker."""
    t = library(path)

    def plain(strings: list[str]) -> list[list[int]]:
        return [e.ids for e in t.encode_batch_fast(strings, add_special_tokens=False)]

    (feed,) = plain(["\n"])

    def encode(strings: list[str]) -> list[list[int]]:
        out: list = [None] * len(strings)
        solid = [i for i, s in enumerate(strings) if not s[-1].isspace()]
        groups = [solid[k : k + JOINED] for k in range(0, len(solid), JOINED)]
        texts = ["\n".join(map(strings.__getitem__, g)) for g in groups]
        for g, ids in zip(groups, plain(texts) if len(feed) == 1 else []):
            a = np.array(ids, np.int64)
            cuts = np.flatnonzero(a == feed[0])
            if len(cuts) == len(g) - 1:
                begin = [0, *(cuts + 1).tolist()]
                for i, x, y in zip(g, begin, [*cuts.tolist(), len(ids)]):
                    out[i] = ids[x:y]
        rest = [i for i, x in enumerate(out) if not x]
        for i, ids in zip(rest, plain([strings[i] for i in rest])):
            out[i] = ids
        return out

    return PieceCoder(encode)


def encode_blocks(texts: pa.Array, path: str, special: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each block of a column: its first row, all ids, and the number of ids of each row."""
    pc, (ids_of, finder) = coder(path), added(path)
    for first, block in tx.blocks(texts):
        if special and finder and any(s in block.joined for s in ids_of):
            yield first, *_cut_at_special(pc, block.texts, ids_of, finder)
        else:
            yield first, *pc.block(block)


def _cut_at_special(pc: PieceCoder, texts: list[str], ids_of: dict[str, int], finder: re.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """The same for texts with special tokens: what stands between them is encoded on its own."""
    parts, between, n_parts = [], [], []
    for t in texts:
        at, n = 0, len(parts)
        for m in finder.finditer(t):
            parts.append(t[at : m.start()])
            between.append(ids_of[m.group()])
            at = m.end()
        parts.append(t[at:])
        between.append(-1)
        n_parts.append(len(parts) - n)
    ids, count = pc.block(tx.Block(parts))
    mark = np.array(between, np.int64)
    out = np.insert(ids, np.cumsum(count)[mark >= 0], mark[mark >= 0].astype(np.uint32))
    upto = np.append(0, np.cumsum(count + (mark >= 0)))
    return out, np.diff(upto[np.append(0, np.cumsum(n_parts))])


def with_end(ids: np.ndarray, count: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows with ``end_id`` after each row, and the new numbers of ids."""
    more = count + 1
    out = np.empty(int(more.sum()), np.uint32)
    last = np.cumsum(more) - 1
    keep = np.ones(len(out), bool)
    keep[last] = False
    out[keep] = ids
    out[last] = end_id
    return out, more
