import hashlib
import io
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strata.llm import binary, bpe, packing, pieces, scratch, tokens
from strata.llm import text as tx

RANKS = bpe.read_ranks(bpe.default_ranks())
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
LIBRARY = Tokenizer.from_file(tokens.default_tokenizer())
MACHINE = bpe.MergeTransducer(RANKS, most_states=5000, lag=64)


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def blockwise(strings, coder):
    out = []
    for _, block in tx.blocks(pa.array(strings, pa.string()), limit=200):
        ids, count = coder.block(block)
        end = np.cumsum(count)
        out += [ids[a:b].tolist() for a, b in zip(end - count, end)]
    return out


AWKWARD = st.lists(st.sampled_from([*"abz'strevmld \t\n\r12٣ⅷé鱼😁.,!-_<|>\xa0 \x1c", "'s", "'re", "'ll", " the", "endoftext", "<|endoftext|>", "<|endoftext|><|endoftext|>"]), max_size=25).map("".join)


def column_ids(strings, **how):
    out = []
    for _, ids, count in tokens.encode_blocks(pa.array(strings, pa.string()), tokens.default_tokenizer(), **how):
        end = np.cumsum(count)
        out += [ids[a:b].tolist() for a, b in zip(end - count, end)]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(AWKWARD, max_size=8))
def test_pieces_and_ids_equal_the_library(strings):
    plain = [TIKTOKEN.encode_ordinary(s) for s in strings]
    assert blockwise(strings, tokens.coder(tokens.default_tokenizer())) == plain == column_ids(strings, special=False)
    assert column_ids(strings) == [ids_of(s) for s in strings]
    assert blockwise(strings, bpe.coder(bpe.default_ranks())) == plain
    small = pieces.PieceCoder(lambda ss: [ids_of(s) for s in ss], most=8)  # a table that is cleared again and again
    assert blockwise(strings, small) == plain


def test_strings_of_special_tokens_are_special_tokens():
    strings = ["hello <|endoftext|> there", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "x<|endoftext|", "", "<|<|endoftext|>\n\n"]
    assert column_ids(strings) == [ids_of(s) for s in strings]
    assert column_ids(strings)[0] == [31373, 220, 50256, 612]


def test_a_hash_collision_is_noticed(monkeypatch):
    monkeypatch.setattr(tx.ROLL, "ranges", lambda p, s, e: np.zeros(len(s), np.uint64))
    c = pieces.PieceCoder(lambda ss: [ids_of(s) for s in ss])
    assert blockwise(["one two three", "four"], c) == [ids_of("one two three"), ids_of("four")]


def test_every_token_encodes_to_itself():
    assert all(MACHINE.encode(b) == [i] for b, i in [*RANKS.items()][::7])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, len(RANKS) - 1), min_size=1, max_size=6))
def test_transducer_equals_merging(ids):
    piece = b"".join(MACHINE.bytes_of[i] for i in ids)
    assert MACHINE.encode(piece) == TIKTOKEN._core_bpe.encode_single_piece(piece) == MACHINE.merged(piece)


@pytest.mark.parametrize("s", ["a" * 3000, "ab" * 2000, " " * 2000, "-" * 3000, "é鱼" * 700])
def test_long_pieces(s):
    assert MACHINE.encode(s.encode()) == TIKTOKEN._core_bpe.encode_single_piece(s.encode())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, len(RANKS) - 1), st.integers(0, 255)), max_size=10), st.integers(1, 4))
def test_streaming_decoder(ids, step):
    d = bpe.StreamDecoder(MACHINE.bytes_of)
    got = "".join(d.feed(ids[k : k + step]) for k in range(0, len(ids), step)) + d.close()
    assert got == b"".join(MACHINE.bytes_of[i] for i in ids).decode("utf-8", "replace")


def test_characters_come_with_their_last_byte():
    d = bpe.StreamDecoder({k: bytes([b]) for k, b in enumerate("é鱼😁".encode())})
    assert [d.feed([k]) for k in range(9)] == ["", "é", "", "", "鱼", "", "", "", "😁"]


def test_op6_digests(docs, texts, empty):
    got = Counter(map(tuple, bpe.digests(docs).collect()))
    want = Counter()
    for d, t in texts:
        ids = TIKTOKEN.encode_ordinary(t)
        want[d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert got == want and bpe.digests(empty).count() == 0
    back = bpe.decode(bpe.encode(docs)).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 70000), max_size=40), max_size=6), st.sampled_from(["bit", "byte"]), st.integers(1, 50))
def test_token_file_round_trip(lists, kind, chunk):
    sink = io.BytesIO()
    w = binary.Writer(sink, kind, chunk)
    for k, ids in enumerate(lists):
        w.add([k if k % 3 else None], np.array(ids, np.uint32), np.array([len(ids)]))
    w.close()
    r = binary.Reader(sink, len(sink.getvalue()))
    got = [(d, [int(x) for p in parts for x in p]) for d, _, parts in r.documents()]
    assert got == [(k if k % 3 else None, ids) for k, ids in enumerate(lists)]


def test_a_damaged_file_is_refused():
    sink = io.BytesIO()
    w = binary.Writer(sink)
    w.add([1], np.arange(9, dtype=np.uint32), np.array([9]))
    w.close()
    raw = bytearray(sink.getvalue())
    raw[-30] ^= 1
    for bad in (bytes(raw), bytes(sink.getvalue()[:-3])):
        with pytest.raises(ValueError):
            binary.Reader(io.BytesIO(bad), len(bad))


def test_op4_files(docs, texts, empty, spark):
    folder = scratch.new_path(spark, "t")
    got = binary.read_tokens(binary.write_tokens(docs, folder, chunk=100), folder).collect()
    want = Counter((d, len(x), zlib.crc32(x)) for d, t in texts for x in [np.array([*ids_of(t), 0], "<u4")])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ordered = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ordered == sorted(ordered, key=lambda d: (d is not None, d or 0))
    assert binary.read_tokens(binary.write_tokens(empty, folder + "e"), folder + "e").count() == 0


def test_shortest_pack_first_uses_every_length():
    for seed in range(60):
        r = random.Random(seed)
        size = r.choice([8, 64, 2048])
        counts = Counter(r.randint(1, size) for _ in range(r.randint(1, 300)))
        got = Counter()
        for pattern, n in packing.shortest_pack_first(counts, size):
            assert n > 0 and sum(a * k for a, k in pattern) <= size
            for a, k in pattern:
                got[a] += k * n
        assert got == counts


def packs(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    return by


def test_op3_packs(docs, texts, empty):
    rows = packing.pack(docs, size=64).collect()
    want = Counter()
    for d, t in texts:
        ids = np.array([*ids_of(t), 1], "<u4")
        for a in range(0, len(ids), 64):
            part = ids[a : a + 64]
            want[d, a, len(part), zlib.crc32(part), len(ids)] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    by = packs(rows)
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r.length for r in rows) / (64 * len(by)) > 0.95
    assert packing.pack(empty).count() == 0
