"""Byte-level BPE: encoding by a two-tier lookup, and decoding.

Tier one: a minimal perfect hash over the vocabulary resolves each whole pre-token that is a token already; the slot's
bytes are compared, so that a miss is certain. Tier two: other pre-tokens are merged with a heap of candidate pairs
over a doubly linked list of byte pieces, lowest rank first, leftmost among equals. Results of both tiers are kept in
a bounded cache in each Python worker.

Null text counts as empty: no ids. Repeated rows give repeated results; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import per_text, worker_state
from lodestone.llm.pretokens import Words, pretokens

MIX = 0x9E3779B97F4A7C15


def mixed(h: np.ndarray, seed: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h ^ (seed.astype(np.uint64) * np.uint64(MIX))
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


@dataclass(frozen=True)
class PerfectHash:
    """Displacement hashing: a bucket's seed sends its keys to free slots; there are as many slots as keys."""

    seeds: np.ndarray
    keys: tuple[bytes, ...]
    values: np.ndarray

    @classmethod
    def build(cls, words: dict[bytes, int], load: int = 4) -> PerfectHash:
        names = sorted(words)
        n = len(names)
        h = hashes(names)
        buckets = max(1, n // load)
        home = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        sizes = np.bincount(home, minlength=buckets)
        ends = np.cumsum(sizes)
        seeds, slot = np.zeros(buckets, np.int64), np.zeros(n, np.int64)
        free = np.ones(n, bool)
        tries = np.arange(1, 4097, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable").tolist():
            if not sizes[b]:
                break
            own = order[ends[b] - sizes[b] : ends[b]]
            first = 0
            while True:
                at = (mixed(h[own][None, :], (tries + np.uint64(first))[: 64 if sizes[b] > 1 and not first else 4096, None]) % np.uint64(n)).astype(np.int64)
                good = free[at].all(axis=1)
                if sizes[b] > 1:
                    good &= (np.diff(np.sort(at, axis=1), axis=1) > 0).all(axis=1)
                if good.any():
                    k = int(good.argmax())
                    seeds[b], slot[own], free[at[k]] = int(tries[k]) + first, at[k], False
                    break
                first += at.shape[0]
        keys, values = [b""] * n, np.zeros(n, np.int64)
        for word, s in zip(names, slot.tolist(), strict=True):
            keys[s], values[s] = word, words[word]
        return cls(seeds, tuple(keys), values)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The value of each word, or -1."""
        if not words or not self.keys:
            return np.full(len(words), -1, np.int64)
        h = hashes(words)
        seed = self.seeds[(h % np.uint64(len(self.seeds))).astype(np.int64)]
        slot = (mixed(h, seed) % np.uint64(len(self.keys))).astype(np.int64)
        same = np.fromiter((self.keys[s] == w for s, w in zip(slot.tolist(), words, strict=True)), bool, len(words))
        return np.where(same, self.values[slot], -1)


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token that is no token itself."""
    n = len(word)
    piece = [word[i : i + 1] for i in range(n)]
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = []
    for i in range(n - 1):
        r = ranks.get(word[i : i + 2])
        if r is not None:
            heap.append((r, i, 2))
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, size = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) < 0 or len(piece[i]) + len(piece[j]) != size:
            continue  # one of the two has been merged meanwhile
        piece[i] += piece[j]
        alive[j] = False
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            r = ranks.get(piece[i] + piece[k])
            if r is not None:
                heapq.heappush(heap, (r, i, len(piece[i]) + len(piece[k])))
        h = before[i]
        if h >= 0:
            r = ranks.get(piece[h] + piece[i])
            if r is not None:
                heapq.heappush(heap, (r, h, len(piece[h]) + len(piece[i])))
    out, i = [], 0
    while i >= 0:
        out.append(ranks[piece[i]])
        i = after[i]
    return out


class Codec:
    """Encodes and decodes by a vocabulary of ranks; one lives in each Python worker."""

    CACHE = 400_000

    def __init__(self, table: PerfectHash):
        self.table = table
        self.ranks = dict(zip(table.keys, table.values.tolist(), strict=True))
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.clear()

    def clear(self) -> None:
        self.words, self.ids = Words(), []

    def learn(self, words: list[str]) -> None:
        coded = [w.encode() for w in words]
        self.ids += [str(v) if v >= 0 else ",".join(map(str, merge(raw, self.ranks))) for raw, v in zip(coded, self.table.find(coded).tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[str]:
        """The decimal ids of each text, joined by commas."""
        out = []
        for _, tokens, counts in pretokens(texts):
            if len(self.words) > self.CACHE:
                self.clear()
            which = list(map(self.words.__getitem__, tokens))
            self.learn(self.words.taken())
            ids = list(map(self.ids.__getitem__, which))
            at = 0
            for c in counts.tolist():
                out.append(",".join(ids[at : at + c]))
                at += c
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def shared_codec(spark: SparkSession, path: str):
    """A broadcast of the perfect hash: its size is that of the vocabulary file."""
    return spark.sparkContext.broadcast(PerfectHash.build(read_ranks(path)))


def worker_codec(shared) -> Codec:
    table = shared.value
    return worker_state(("codec", hash(table.keys)), lambda: Codec(table))


def encode(text: Column, spark: SparkSession, path: str) -> Column:
    """ids array<int> of a text column."""
    shared = shared_codec(spark, path)

    def run(texts: list[str | None]) -> pa.Array:
        coded = worker_codec(shared).encode([t or "" for t in texts])
        return pa.array([list(map(int, c.split(","))) if c else [] for c in coded], pa.list_(pa.int32()))

    return per_text(run, "array<int>")(text)


def decode(ids: Column, spark: SparkSession, path: str) -> Column:
    """The bytes of a column of ids."""
    shared = shared_codec(spark, path)

    def run(rows: list[list[int] | None]) -> pa.Array:
        codec = worker_codec(shared)
        return pa.array([None if r is None else codec.decode(r) for r in rows], pa.binary())

    return per_text(run, "binary")(ids)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, and the ids decoded again."""
    shared = shared_codec(docs.sparkSession, path)
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(texts: list[str | None]) -> pa.Array:
        codec, out = worker_codec(shared), []
        for a in range(0, len(texts), 200):
            for coded in codec.encode([t or "" for t in texts[a : a + 200]]):
                ids = list(map(int, coded.split(","))) if coded else []
                out.append((len(ids), hashlib.sha256(coded.encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
        return pa.StructArray.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True) if out else [[]] * 3, kind, strict=True)], fields=list(kind))

    return docs.select("doc_id", per_text(run, "struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")(F.col("text")).alias("r")).select("doc_id", "r.*")
