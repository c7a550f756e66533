"""Removal of repeated windows of words, with a count-min prefilter.

Words are runs of bytes other than ASCII white space. A word is removed if a window of ``size`` words covers it whose
word sequence also starts earlier (smaller doc_id, or the same document further left). All windows of all documents go
into the merged sketch of :mod:`lodestone.llm.exchange`; only windows estimated repeated are then grouped, by a digest of
128 bits: two polynomials over the two halves of each word's 128-bit XXH3 hash. The first occurrence of a group stays.

An empty table gives an empty table. Null text counts as empty: no words. A null doc_id counts as later than all others.
Rows that share a doc_id count as the same document; of windows at the same place in them none starts earlier. Other
columns are not looked at. Texts of any length are hashed in slices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

from lodestone.llm.exchange import Among, Layout, in_chunks, ordered, read_cells, repeated_cells, runs, unpack_sorted

#: Odd multipliers of the polynomial hashes, and their inverses modulo 2^64.
BASE, WIDE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
SLICE = 1 << 18


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(n, b, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers_to(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in POWERS or len(POWERS[base][0]) < n:
        POWERS[base] = powers(base, max(n, SLICE + 1))
    return POWERS[base]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def slices(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about SLICE bytes that end at white space."""
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        while at < end < len(text) and text[end - 1] not in b" \t\n\v\f\r":
            end -= 1
        if end == at:  # a word longer than the slice
            end = at + SLICE
            while end < len(text) and text[end] not in b" \t\n\v\f\r":
                end += 1
        yield text[at:end]
        at = end


class Words:
    """The distinct words of a chunk, numbered as they appear, with the halves of their 128-bit hashes."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.halves = np.zeros((1024, 2), np.uint64)  # with room for more; it doubles, so that a text costs what is new in it

    def __call__(self, text: bytes) -> np.ndarray:
        """The number of each word of a text."""
        number, parts = self.number, []
        for piece in slices(text):
            words, known = piece.split(), len(number)
            parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
            if fresh := len(number) - known:
                if len(number) > len(self.halves):
                    self.halves = np.concatenate([self.halves, np.zeros((max(len(self.halves), fresh), 2), np.uint64)])
                latest = b"".join(xxhash.xxh3_128_digest(w) for w in islice(reversed(number), fresh))
                self.halves[known : len(number)] = np.frombuffer(latest, np.uint64).reshape(-1, 2)[::-1]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def windows(self, ids: np.ndarray, size: int, half: int) -> np.ndarray:
        return window_hashes(self.halves[ids, half], size, (WIDE, BASE)[half])


def window_hashes(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    up, down = powers_to(base, len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[:n])


def count_cells(texts: list[bytes], size: int, lay: Layout) -> tuple[np.ndarray, np.ndarray]:
    words = Words()
    cells = [lay.cell_of(words.windows(words(t), size, 0)) for t in texts]
    every = np.sort(np.concatenate(cells)) if cells else np.zeros(0, np.uint64)
    first = np.flatnonzero(np.diff(every, prepend=np.uint64(2**63)) != 0)
    return every[first], np.diff(first, append=len(every))


class Candidates:
    """Windows of a chunk with a repeated cell: each distinct one once, in order of its first place."""

    def __init__(self, ids: list[int], texts: list[bytes], size: int, cells: np.ndarray, lay: Layout):
        self.lay = lay
        among, keys, checks, docs, places = Among(cells), [], [], [], []
        self.words: list[int] = []
        words = Words()
        for i, own in enumerate(map(words, texts)):
            self.words.append(len(own))
            h = words.windows(own, size, 0)
            hit = np.flatnonzero(among(lay.cell_of(h)) >= 0)
            if len(hit):
                keys.append(h[hit])
                checks.append(words.windows(own, size, 1)[hit])
                docs.append(np.full(len(hit), i, np.int32))
                places.append(hit.astype(np.int32))
        cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        self.key, self.check, self.doc, self.place = cat(keys, np.uint64), cat(checks, np.uint64), cat(docs, np.int32), cat(places, np.int32)
        # The first of equal windows is the first in order of document and place.
        order = np.argsort(mix(self.key + self.check))
        new = np.ones(len(order), bool)
        k, c = self.key[order], self.check[order]
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        first = np.minimum.reduceat(order, np.flatnonzero(new)) if len(order) else order
        rank = np.empty(len(first), np.int64)  # groups by first place
        rank[np.argsort(first)] = np.arange(len(first))
        self.group = rank[group] if len(order) else group
        self.first = np.sort(first)
        self.count = np.bincount(self.group, minlength=len(self.first)) if len(order) else np.zeros(0, np.int64)
        self.ids = np.array(ids, np.int64)

    def by_shard(self) -> list[tuple[int, np.ndarray]]:
        """Groups of each range of cells, in order of first place."""
        return runs(self.lay.range_of(self.lay.cell_of(self.key[self.first])))


def verdicts(chunks: DataFrame, lay: Layout, size: int) -> DataFrame:
    """(chunk, shard, range, cells, often, flags): repeated cells again, and two bits for each distinct candidate of a
    chunk and shard: whether its window occurs twice or more, and whether its first occurrence is in this chunk."""

    def send(pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(pdf) and len(found):
            chunk = int(pdf["chunk"].iloc[0])
            cells, _ = read_cells(found, lay)
            c = Candidates(*ordered(pdf)[:2], size, cells, lay)
            own = {int(r): x for r, x in zip(found["range"], found["cells"], strict=True)}
            for shard, groups in c.by_shard():
                at = c.first[groups]
                rows.append((chunk, shard, own[shard], c.key[at].tobytes(), c.check[at].tobytes(), c.ids[c.doc[at]].tobytes(), np.diff(c.place[at], prepend=0).astype(np.int32).tobytes(), (c.count[groups] > 1).tobytes()))
        return pd.DataFrame(rows, columns=["chunk", "shard", "cells", "keys", "checks", "docs", "places", "twice"])

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        get = lambda name, kind: [np.frombuffer(x, kind) for x in pdf[name]]
        keys, checks, docs, twice = get("keys", np.uint64), get("checks", np.uint64), get("docs", np.int64), get("twice", bool)
        places = [np.cumsum(x) for x in get("places", np.int32)]
        key, check, doc, place, several = map(np.concatenate, (keys, checks, docs, places, twice))
        order = np.lexsort((place, doc, check, key))
        k, c, d, p = key[order], check[order], doc[order], place[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        size_of = np.diff(start, append=len(order))
        repeated = (size_of > 1) | np.logical_or.reduceat(several[order], start)
        flags = np.empty((len(order), 2), bool)
        flags[order, 0] = repeated[group]
        flags[order, 1] = (d == d[start][group]) & (p == p[start][group])
        ends = np.cumsum([len(x) for x in keys])
        rows = [(int(chunk), int(pdf["shard"].iloc[0]), cells, np.packbits(flags[e - len(x) : e].ravel()).tobytes()) for chunk, cells, x, e in zip(pdf["chunk"], pdf["cells"], keys, ends, strict=True)]
        return pd.DataFrame(rows, columns=["chunk", "shard", "cells", "flags"])

    found = repeated_cells(chunks, lay, lambda _, texts: count_cells(texts, size, lay))
    sent = chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInPandas(send, "chunk int, shard int, cells binary, keys binary, checks binary, docs binary, places binary, twice binary")
    return sent.repartition(lay.chunks, "shard").groupBy("shard").applyInPandas(judge, "chunk int, shard int, cells binary, flags binary")


def covered(n_words: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which words lie in windows with the given starts."""
    steps = np.zeros(n_words + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + size, n_words), -1)
    return np.cumsum(steps[:-1]) > 0


def removed_words(pdf: pd.DataFrame, back: pd.DataFrame, lay: Layout, size: int):
    """For each document of a chunk in order: its bytes and which of its words go."""
    ids, texts, order = ordered(pdf)
    back = back.sort_values("shard")
    cells = [unpack_sorted(c) + lay.base_of(int(s)) for s, c in zip(back["shard"], back["cells"], strict=True)]
    c = Candidates(ids, texts, size, np.concatenate(cells) if cells else np.zeros(0, np.uint64), lay)
    gone = np.zeros(len(c.first), bool)  # windows of the group that are not its first
    stays = np.zeros(len(c.first), bool)  # its first in this chunk is the first of all
    flags = {int(s): f for s, f in zip(back["shard"], back["flags"], strict=True)}
    for shard, groups in c.by_shard():
        bits = np.unpackbits(np.frombuffer(flags[shard], np.uint8), count=2 * len(groups)).reshape(-1, 2).astype(bool)
        gone[groups], stays[groups] = bits[:, 0], bits[:, 1]
    # The windows that stay: those at the same document and place as a first that is the first of all.
    at_first = np.zeros(len(c.key), bool)
    if len(c.key):
        f = c.first[c.group]
        at_first = (c.ids[c.doc] == c.ids[c.doc[f]]) & (c.place == c.place[f])
        remove = gone[c.group] & ~(stays[c.group] & at_first)
    else:
        remove = at_first
    doc, place = c.doc[remove], c.place[remove]
    bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
    for i, text in enumerate(texts):
        yield order[i], text, covered(c.words[i], place[bounds[i] : bounds[i + 1]].astype(np.int64), size)


def remove_repeated(docs: DataFrame, size: int = 20, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space; null if not asked for) and kept_sha256."""
    chunks, lay = in_chunks(docs)

    def finish(pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for i, text, gone in removed_words(pdf, back, lay, size) if len(pdf) else ():
            words = text.split()
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if gone.any() else b" ".join(words)
            doc = pdf["doc_id"].iloc[i]
            rows.append((None if doc is None or doc != doc else int(doc), len(words), int(gone.sum()), kept.decode() if with_text else None, hashlib.sha256(kept).hexdigest()))
        out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])
        return out.astype({"doc_id": "Int64"})

    back = verdicts(chunks, lay, size)
    return chunks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(finish, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
