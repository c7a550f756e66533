"""Byte-level BPE and packing against the libraries whose ids they must give."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
import regex  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from lodestone.llm import bpe, packing, pretokens  # noqa: E402

ODD = "ab st'reveldm  \n\t é中1२²!?.-\r\x85 \x00\x1cſİ"
RANKS = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
CODEC = bpe.Codec(bpe.PerfectHash.build(RANKS))
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(ODD), st.characters(codec="utf-8")), max_size=40), max_size=8))
def test_pretokens_are_those_of_the_pattern(texts):
    pattern = regex.compile(P.PATTERN)
    got = {a: (tokens, counts) for a, tokens, counts in pretokens.pretokens(texts, 60)}
    flat = [t for tokens, _ in got.values() for t in tokens]
    # The library's white space is the Unicode property, without the four ASCII separators.
    want = [m for t in texts for m in pattern.findall(t)]
    if not any(c in t for t in texts for c in "\x1c\x1d\x1e\x1f"):
        assert flat == want


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(ODD), st.characters(codec="utf-8")), max_size=60))
def test_encoding_is_the_library_s_and_decodes_back(text):
    ids = LIBRARY.encode_ordinary(text)
    (coded,) = CODEC.encode([text])
    assert coded == ",".join(map(str, ids)) and CODEC.decode(ids) == text.encode()


def test_perfect_hash_is_minimal_and_certain():
    table = CODEC.table
    assert len(table.keys) == len(RANKS) and sorted(table.values.tolist()) == sorted(RANKS.values())
    words = list(RANKS)[:500] + [b"not a token at all", b""]
    assert table.find(words).tolist() == [RANKS[w] for w in words[:500]] + [-1, -1]


def test_digests_and_columns(spark):
    rows = [(1, "Hello, world", "x"), (2, None, "y"), (2, "", "z"), (None, "naïve 中文  \n", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string")
    got = {(r.doc_id, r.n_tokens) for r in bpe.digests(df, P.path("byte_bpe_multi_50k.tiktoken")).collect()}
    assert got == {(d, len(LIBRARY.encode_ordinary(t or ""))) for d, t, _ in rows}
    ids = df.select(bpe.encode(df["text"], spark, P.path("byte_bpe_multi_50k.tiktoken")).alias("ids"))
    assert sorted(bytes(r[0]).decode() for r in ids.select(bpe.decode(ids["ids"], spark, P.path("byte_bpe_multi_50k.tiktoken"))).collect()) == sorted(t or "" for _, t, _ in rows)


def test_word_encoder_gives_the_library_s_ids():
    path = P.path("byte_bpe_50k.json")
    rng = random.Random(5)
    texts = ["".join(rng.choice(ODD) for _ in range(50)) for _ in range(300)] + ["", "a<|endoftext|>b", " "]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in packing.WordEncoder(path).encode(texts)] == want


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    n = (0, 3, 400, 30_000)[seed]
    lengths = rng.integers(1, 1025, n)
    counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
    fillings = packing.plan(counts, 1024)
    assert all(sum(k for k, _ in f.slots) <= 1024 and f.count > 0 for f in fillings)
    table = packing.slots_table(fillings)
    for k, c in counts.items():
        at = 0
        for r, m in sorted(table[table[:, 0] == k][:, 1:3].tolist()):
            assert r == at
            at += m
        assert at == c
    assert sum(f.count for f in fillings) <= 1.02 * -(-int(lengths.sum()) // 1024) + 10


def test_packed_pieces(spark):
    path = P.path("byte_bpe_50k.json")
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["lorem", "ipsum", "Dolor!", "中"]) for _ in range(rng.choice([0, 5, 90, 3000]))), "s") for i in range(60)] + [(None, None, "s"), (3, "again", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string").repartition(5)
    got = packing.pack(df, path).collect()
    tokenizer = Tokenizer.from_file(path)
    want = []
    for d, t, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
