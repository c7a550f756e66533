"""Removal of bytes repeated from earlier documents, by merging Burrows-Wheeler transforms.

A byte is removed if a string of ``size`` bytes that covers it also starts in a document with a smaller doc_id.

1. Each window of ``size`` bytes belongs to the least hash among its ``GRAM``-byte grams; consecutive windows with the same
   least gram form a segment. Equal windows have equal least grams, so windows whose gram occurs in one document only
   cannot repeat: the merged sketches of :mod:`lodestone.llm.exchange` leave out their segments and lose no other.
2. Segments that may repeat are dealt by their gram; equal segments of a chunk once, with the least doc_id. Where a gram
   is very frequent, its windows are sent as segments of their own, dealt by their whole content.
3. For the distinct segments of a gram, suffixes of each chunk's strings are sorted apart (a shard's transform). The shards'
   transforms are then merged by iterative refinement of their interleave: each round takes the merged order of
   suffixes by h symbols to that by h + 1, by one stable pass over the transform's symbols. A suffix that is alone in its
   interval after round h shares h - 1 symbols with any other and leaves; after ``size`` rounds the intervals left
   are the repeated strings; the suffixes are not sorted again. A segment that is the only one of its gram
   is its own interval.
4. The least doc_id of each interval goes back to the chunks as one bit per window.

An empty table gives an empty table; where nothing may repeat, everything stays. Null text counts as empty. A null doc_id
counts as larger than all others; rows with equal doc_ids do not remove one another's bytes. Texts of any length are cut
in overlapping slices. Nothing crosses documents. Other columns are not looked at, and :func:`clean` keeps them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import LAST_DOC
from lodestone.llm.exchange import Among, Layout, in_chunks, ordered, read_cells, repeated_cells, runs, unpack_sorted
from lodestone.llm.substrings import BASE, mix, powers_to

GRAM = 20
LARGEST = 254 + GRAM - 1  # windows of a segment are counted in a byte
SLICE = 1 << 18
#: Suffixes that are merged at once; grams are independent of one another.
BLOCK = 100_000


def buffers(texts: list[bytes], size: int):
    """Texts joined up to SLICE bytes, longer ones cut with an overlap: (bytes, document, offset, place, length of each)."""
    part: list[tuple[int, int, int]] = []
    total = 0

    def joined():
        lengths = np.array([e - b for _, b, e in part], np.int64)
        return b"".join(texts[i][b:e] for i, b, e in part), np.array([i for i, _, _ in part], np.int64), np.array([b for _, b, _ in part], np.int64), np.cumsum(lengths) - lengths, lengths

    for i, t in enumerate(texts):
        for b in range(0, max(1, len(t) - size + 1), SLICE):
            e = min(len(t), b + SLICE + size - 1)
            if e - b < size:
                continue
            if part and total + e - b > SLICE:
                yield joined()
                part, total = [], 0
            part.append((i, b, e))
            total += e - b
    if part:
        yield joined()


class Segments:
    """All segments of a chunk: document, place in it, number of windows, gram and a hash of the content."""

    def __init__(self, texts: list[bytes], size: int, lay: Layout, among: Among | None = None, often: np.ndarray | None = None):
        parts: list[tuple[np.ndarray, ...]] = []
        most = size - GRAM + 1
        for data, docs, offsets, places, lengths in buffers(texts, size):
            raw = np.frombuffer(data, np.uint8)
            n = len(raw)
            up, down = powers_to(BASE, n + 1)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
            grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
            low, width = grams, 1
            while width * 2 <= most:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
            if most > width:
                low = np.minimum(low[: len(low) - (most - width)], low[most - width :])
            # Windows within one part; a part's last size - 1 starts are not.
            inside = np.zeros(n + 1, np.int8)
            np.add.at(inside, places, 1)
            np.add.at(inside, places + lengths - size + 1, -1)
            at = np.flatnonzero(np.cumsum(inside[: len(low)]))
            gram = low[at]
            new = np.ones(len(at), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (at[1:] != at[:-1] + 1)
            begin = np.flatnonzero(new)
            count = np.diff(begin, append=len(at))
            if count.max() > most:  # a run of one gram: pieces of at most ``most`` windows
                pieces = -(-count // most)
                which = np.repeat(np.arange(len(begin)), pieces)
                inner = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                count = np.minimum(most, count[which] - inner * most)
                begin = begin[which] + inner * most
            start, key = at[begin], gram[begin]
            if among is not None:
                found = among(lay.cell_of(key))
                start, key, count, found = (x[found >= 0] for x in (start, key, count, found))
                hot = often[found]
                if hot.any():  # each window for itself, dealt by its content
                    each = np.repeat(start[hot], count[hot])
                    step = np.arange(len(each)) - np.repeat(np.cumsum(count[hot]) - count[hot], count[hot])
                    each = each + step
                    own = mix((sums[each + size] - sums[each]) * down[each] ^ np.uint64(0x5851F42D4C957F2D))
                    start, key, count = np.concatenate([start[~hot], each]), np.concatenate([key[~hot], own]), np.concatenate([count[~hot], np.ones(len(each), np.int64)])
                    order = np.argsort(start, kind="stable")
                    start, key, count = start[order], key[order], count[order]
                content = mix((sums[start + count + size - 1] - sums[start]) * down[start])
            else:
                content = key
            part = np.searchsorted(places, start, side="right") - 1
            parts.append((docs[part], offsets[part] + start - places[part], count, key, content))
        kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
        self.doc, self.place, self.count, self.key, self.content = (np.concatenate(c).astype(k) for c, k in zip(zip(*parts, strict=True), kinds, strict=True)) if parts else (np.zeros(0, k) for k in kinds)


def count_documents(texts: list[bytes], size: int, lay: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted cells of a chunk, and in how many of its documents each occurs."""
    s = Segments(texts, size, lay)
    cells = lay.cell_of(s.key)
    both = np.sort(cells << np.uint64(24) | s.doc.astype(np.uint64))  # a chunk has fewer than 2^24 documents
    c = both[np.diff(both, prepend=~both[:1]) != 0] >> np.uint64(24)
    first = np.flatnonzero(np.diff(c, prepend=np.uint64(2**63)) != 0)
    return c[first], np.diff(first, append=len(c))


class Distinct:
    """Segments of a chunk that may repeat, and the distinct ones in order of their first place."""

    def __init__(self, texts: list[bytes], size: int, lay: Layout, cells: np.ndarray, often: np.ndarray):
        self.lay = lay
        self.all = s = Segments(texts, size, lay, Among(cells), often)
        # One sort by a mix of all three brings equal segments together; neighbours are then compared byte by byte. Should
        # hashes ever collide, a segment is only sent twice.
        order = np.argsort(mix(s.key * np.uint64(3) + s.content) + s.count.astype(np.uint64), kind="stable")
        new = np.ones(len(order), bool)
        k, c, n = s.key[order], s.content[order], s.count[order]
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (n[1:] != n[:-1])
        alike = np.flatnonzero(~new)
        doc, place, ends = s.doc[order], s.place[order], s.place[order] + n + size - 1
        for at, i, a, b, j, x, y in zip(*(v.tolist() for v in (alike, doc[alike], place[alike], ends[alike], doc[alike - 1], place[alike - 1], ends[alike - 1])), strict=True):
            new[at] = texts[i][a:b] != texts[j][x:y]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        first = np.minimum.reduceat(order, np.flatnonzero(new)) if len(order) else order
        rank = np.empty(len(first), np.int64)
        rank[np.argsort(first)] = np.arange(len(first))
        self.group, self.first = rank[group], np.sort(first)

    def by_shard(self) -> list[tuple[int, np.ndarray]]:
        return runs(self.lay.range_of(self.lay.cell_of(self.all.key[self.first])))


class Transform:
    """Burrows-Wheeler transforms of shards of strings, side by side: rows of shard 0 first, then of shard 1, ...

    Each string ends with a symbol of its own, below all others. ``symbols[row]`` precedes the row's suffix (0 at a
    string's begin), ``before[row]`` is the row of the suffix that is one symbol longer.
    """

    def __init__(self, strings: list[bytes], shard: np.ndarray):
        order = np.argsort(shard, kind="stable")
        text = np.frombuffer(b"\0".join([strings[i] for i in order]) + b"\0", np.uint8).astype(np.int64) + 1
        lengths = np.array([len(strings[i]) + 1 for i in order], np.int64)
        ends = np.cumsum(lengths)
        self.string = np.repeat(order, lengths)
        self.offset = np.arange(len(text)) - np.repeat(ends - lengths, lengths)
        text[ends - 1] = 0
        n = len(text)
        # Suffix order within each shard, by doubling; the end symbols are told apart by their strings.
        part = np.repeat(np.asarray(shard)[order].astype(np.int64), lengths)
        part = np.unique(part, return_inverse=True)[1]
        reach = next(r for r in (4, 3, 2, 1) if r == 1 or (int(part.max()) + 1) * 257**r * (n + 1) < 2**63)
        key, left = part, np.repeat(ends, lengths) - np.arange(n)
        for k in range(reach):  # the first symbols at once; none beyond a string's end
            key = key * 257 + np.where(left > k, text[np.minimum(np.arange(n) + k, n - 1)], 0)
        key = key * (n + 1)
        short = left <= reach
        key[short] += np.repeat(np.arange(len(ends)), lengths)[short]
        rank = self.ranks(key)
        while rank[1] < n:
            after = np.zeros(n, np.int64)
            after[:-reach] = rank[0][reach:]
            # Past its end a suffix is told apart already.
            after[self.offset + reach >= np.repeat(lengths, lengths)] = 0
            rank = self.ranks(rank[0] * (n + 1) + after)
            reach *= 2
        row = rank[0] - 1
        self.place = np.empty(n, np.int64)
        self.place[row] = np.arange(n)
        self.symbols, self.before = np.zeros(n, np.uint16), np.zeros(n, np.int32)
        inner = np.flatnonzero(self.offset > 0)
        self.symbols[row[inner]] = text[inner - 1]
        self.before[row[inner]] = row[inner - 1]

    @staticmethod
    def ranks(key: np.ndarray) -> tuple[np.ndarray, int]:
        order = np.argsort(key)
        k = key[order]
        out = np.empty(len(key), np.int64)
        out[order] = np.cumsum(np.concatenate(([1], (k[1:] != k[:-1]).astype(np.int64))))
        return out, int(out.max())

    def repeated(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of all shards whose suffixes share ``depth`` symbols with another, in merged order; where each interval
        of equal ones begins; and for every row the longest prefix, up to ``depth``, that it shares with any other.

        The interleave begins with the shards one after another. A round puts the rows that precede those of the last
        round in order, by one stable pass over the transform's symbols: what was in order by h symbols then is by h + 1.
        Boundaries between intervals appear where the symbols or the last intervals differ. A suffix alone in its
        interval stays alone whatever precedes it, and so leaves.
        """
        n = len(self.symbols)
        rows, block, shared = np.arange(n, dtype=np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        for h in range(1, depth + 1):
            symbol = self.symbols[rows]
            inner = np.flatnonzero(symbol)
            order = inner[np.argsort(symbol[inner], kind="stable")]
            s, b = symbol[order], block[order]
            edge = np.ones(len(order) + 1, bool)
            edge[1:-1] = (s[1:] != s[:-1]) | (b[1:] != b[:-1])
            several = ~(edge[:-1] & edge[1:])
            rows = self.before[rows[order[several]]]
            block = np.cumsum(edge[:-1], dtype=np.int32)[several]
            shared[rows] = h
        return rows, np.flatnonzero(np.diff(block, prepend=-1)), shared


def least_documents(strings: list[bytes], shard: np.ndarray, docs: np.ndarray, size: int) -> list[np.ndarray]:
    """For each string, the least document of all strings that hold each of its windows, by the repeated intervals of
    the merged transforms."""
    t = Transform(strings, shard)
    rows, begin, _ = t.repeated(size)
    by_place = docs[t.string]
    if len(rows):
        place = t.place[rows]
        by_place[place] = np.repeat(np.minimum.reduceat(docs[t.string[place]], begin), np.diff(begin, append=len(rows)))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(strings)
    for s in np.flatnonzero(t.offset == 0).tolist():
        i = int(t.string[s])
        out[i] = by_place[s : s + len(strings[i]) - size + 1]
    return out


def judge_segments(keys: np.ndarray, strings: list[bytes], chunk: np.ndarray, docs: np.ndarray, size: int, ends_of: np.ndarray) -> list[bytes]:
    """For each run of segments up to one of ``ends_of``, packed bits of its windows in order: whether they also start in
    a smaller document."""
    number: dict[bytes, int] = {}
    which = np.fromiter((number.setdefault(s, len(number)) for s in strings), np.int64, len(strings))
    distinct = list(number)
    least = np.full(len(distinct), LAST_DOC, np.int64)
    np.minimum.at(least, which, docs)
    key, shard = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    key[which[::-1]], shard[which[::-1]] = keys[::-1], chunk[::-1]
    windows = np.array([len(s) - size + 1 for s in distinct], np.int64)
    ends = np.cumsum(windows)
    best = np.repeat(least, windows)
    shared = [own for _, own in runs(key) if len(own) > 1]
    block: list[np.ndarray] = []
    total = 0
    for own in [*shared, None]:
        if block and (own is None or total > BLOCK):
            ids = np.concatenate(block)
            for i, found in zip(ids.tolist(), least_documents([distinct[i] for i in ids], shard[ids], least[ids], size), strict=True):
                best[ends[i] - windows[i] : ends[i]] = found
            block, total = [], 0
        if own is not None:
            block.append(own)
            total += int((windows[own] + size).sum())
    out = []
    for a, b in zip([0, *ends_of[:-1].tolist()], ends_of.tolist(), strict=True):
        own = which[a:b]
        counts = windows[own]
        at = np.arange(int(counts.sum())) + np.repeat((ends - windows)[own] - (np.cumsum(counts) - counts), counts)
        out.append(np.packbits(best[at] < np.repeat(docs[a:b], counts)).tobytes())
    return out


def verdicts(chunks: DataFrame, lay: Layout, size: int) -> DataFrame:
    """(chunk, shard, cells, often, bits) for each chunk: its repeated cells, and a bit for each window of its distinct
    segments, by shard in order of first place."""
    sent_as = "chunk int, shard int, cells binary, often binary, keys binary, counts binary, docs binary, text binary"

    def send(pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(pdf) and len(found):
            chunk = int(pdf["chunk"].iloc[0])
            ids, texts, _ = ordered(pdf)
            d = Distinct(texts, size, lay, *read_cells(found, lay))
            s, known = d.all, np.array(ids, np.int64)
            shards = dict(d.by_shard())
            packer = zstandard.ZstdCompressor(level=1)
            own = {int(r): (c, o) for r, c, o in zip(found["range"], found["cells"], found["often"], strict=True)}
            for shard in sorted({*shards, *own}):
                at = d.first[shards.get(shard, np.zeros(0, np.int64))]
                text = b"".join([texts[i][p : p + c + size - 1] for i, p, c in zip(s.doc[at].tolist(), s.place[at].tolist(), s.count[at].tolist(), strict=True)])
                rows.append((chunk, shard, *own.get(shard, (b"", b"")), s.key[at].astype(np.uint32).tobytes(), s.count[at].astype(np.uint8).tobytes(), known[s.doc[at]].tobytes(), packer.compress(text)))
        return pd.DataFrame(rows, columns=["chunk", "shard", "cells", "often", "keys", "counts", "docs", "text"])

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = [np.frombuffer(x, np.uint8).astype(np.int64) for x in pdf["counts"]]
        strings, unpacker = [], zstandard.ZstdDecompressor()
        for own, text in zip(counts, pdf["text"], strict=True):
            at = np.concatenate(([0], np.cumsum(own + size - 1))).tolist()
            text = unpacker.decompress(text)
            strings += [text[a:b] for a, b in zip(at, at[1:], strict=False)]
        # The lower half of a gram's hash is enough to group by: grams that share it are only merged together.
        keys, docs = (np.concatenate([np.frombuffer(x, k) for x in pdf[c]]) for c, k in (("keys", np.uint32), ("docs", np.int64)))
        chunk = np.repeat(pdf["chunk"].to_numpy(), [len(c) for c in counts])
        bits = judge_segments(keys, strings, chunk, docs, size, np.cumsum([len(c) for c in counts]))
        rows = [(int(k), int(pdf["shard"].iloc[0]), c, o, x) for k, c, o, x in zip(pdf["chunk"], pdf["cells"], pdf["often"], bits, strict=True)]
        return pd.DataFrame(rows, columns=["chunk", "shard", "cells", "often", "bits"])

    found = repeated_cells(chunks, lay, lambda _, texts: count_documents(texts, size, lay))
    sent = chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInPandas(send, sent_as)
    return sent.repartition(lay.chunks, "shard").groupBy("shard").applyInPandas(judge, "chunk int, shard int, cells binary, often binary, bits binary")


def removed_bytes(pdf: pd.DataFrame, back: pd.DataFrame, lay: Layout, size: int):
    """For each document of a chunk: the row's place, its bytes and which of them go."""
    ids, texts, order = ordered(pdf)
    back = back.sort_values("shard")
    cells = [unpack_sorted(c) + lay.base_of(int(r)) for r, c in zip(back["shard"], back["cells"], strict=True)]
    often = [np.unpackbits(np.frombuffer(o, np.uint8), count=len(c)).astype(bool) for c, o in zip(cells, back["often"], strict=True)]
    d = Distinct(texts, size, lay, np.concatenate(cells) if cells else np.zeros(0, np.uint64), np.concatenate(often) if often else np.zeros(0, bool))
    s = d.all
    counts = s.count[d.first]
    ends = np.cumsum(counts)
    bits = np.zeros(int(counts.sum()), bool)
    flags = {int(k): b for k, b in zip(back["shard"], back["bits"], strict=True)}
    for shard, groups in d.by_shard():
        own = counts[groups]
        got = np.unpackbits(np.frombuffer(flags[shard], np.uint8), count=int(own.sum())).astype(bool)
        bits[np.arange(len(got)) + np.repeat((ends - counts)[groups] - (np.cumsum(own) - own), own)] = got
    known = np.array(ids, np.int64)
    later = known[s.doc] > known[s.doc[d.first[d.group]]] if len(s.doc) else np.zeros(0, bool)
    bounds = np.searchsorted(s.doc, np.arange(len(texts) + 1))
    for i, text in enumerate(texts):
        a, b = bounds[i], bounds[i + 1]
        steps = np.zeros(len(text) + 1, np.int32)
        if b > a:
            whole = later[a:b]
            begin, count, group = s.place[a:b], s.count[a:b], d.group[a:b]
            np.add.at(steps, begin[whole], 1)
            np.add.at(steps, begin[whole] + count[whole] + size - 1, -1)
            begin, count, group = begin[~whole], count[~whole], group[~whole]
            inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            hit = bits[np.repeat((ends - counts)[group], count) + inner]
            start = (np.repeat(begin, count) + inner)[hit]
            np.add.at(steps, start, 1)
            np.add.at(steps, start + size, -1)
        yield int(order[i]), text, np.cumsum(steps[:-1]) > 0


def remove_repeated(docs: DataFrame, size: int = 50, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the remaining bytes, and the remaining text (without the
    bytes of characters that were cut in two; null if not asked for) with the hash of the text it came from. ``size`` is
    between GRAM and LARGEST."""
    if not GRAM <= size <= LARGEST:
        raise ValueError(f"size must be between {GRAM} and {LARGEST}")
    chunks, lay = in_chunks(docs)

    def finish(pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for i, text, gone in removed_bytes(pdf, back, lay, size) if len(pdf) else ():
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if gone.any() else text
            spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(gone) else 0
            doc = pdf["doc_id"].iloc[i]
            rows.append((None if doc is None or doc != doc else int(doc), len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if with_text else None, int(pdf["text_hash"].iloc[i])))
        return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "text_hash"]).astype({"doc_id": "Int64"})

    back = verdicts(chunks, lay, size)
    return chunks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, text_hash long")


def clean(docs: DataFrame, size: int = 50) -> DataFrame:
    """``docs`` with the repeated bytes gone from ``text`` and ``n_chars`` to match; all rows and columns stay. Null texts
    become empty. Rows with the same doc_id and text get the same result."""
    found = remove_repeated(docs, size).select(F.col("doc_id").alias("id"), "text_hash", "kept_text").dropDuplicates(["id", "text_hash"])
    # Texts come back from the chunks; of the documents only the other columns and a hash of the text are sent. These travel in
    # a struct, so that no name can meet another, in any case.
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    d = docs.select(F.struct(*rest).alias("row"), F.col("doc_id").alias("doc"), F.xxhash64("text").alias("hash"))
    both = d.join(found, F.col("doc").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("text_hash")))
    text = F.col("kept_text")
    return both.select(*[text.alias(c) if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns])
