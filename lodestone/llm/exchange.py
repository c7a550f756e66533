"""Repeated windows of a corpus, found in two passes over the same chunks of documents.

Documents are dealt to chunks by a hash. Pass one: each chunk makes a sketch of its windows, one count-min row of 16
times as many cells as the corpus has bytes, held sparsely as sorted cells with counts that stop at 255. Sketches
are dealt by cell range, so that a task merges one range of all chunks' sketches, and cells with a merged count of two
or more go back to the chunks that have them. Estimates are never too low: a window whose cell is not among them occurs
once. Pass two: only windows (or segments) with such a cell are sent, and grouped exactly; what becomes of them goes back
to their chunk as bits. Within a chunk equal windows are sent once, so that no group of copies meets in one task.

All steps are grouped by chunk or by range in Spark; the text itself is dealt once, by chunk, and never sent again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import LAST_DOC, release_worker_state

#: Local counts go up to this; cells that reach it over all chunks are marked.
FREQUENT = 255


@dataclass(frozen=True)
class Layout:
    """The number of chunks, of ranges of cells, and of cells as a power of two. There are more ranges than chunks, so that
    what a range gathers is smaller than a chunk."""

    chunks: int
    n: int
    bits: int

    def cell_of(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.bits)

    def range_of(self, cells: np.ndarray) -> np.ndarray:
        return ((cells * np.uint64(self.n)) >> np.uint64(self.bits)).astype(np.int64)

    def base_of(self, r: int) -> np.uint64:
        """At or below the first cell of a range."""
        return np.uint64((r << self.bits) // self.n)


def in_chunks(docs: DataFrame, chunk_bytes: int = 6 << 20, least_bytes: int = 1 << 20) -> tuple[DataFrame, Layout]:
    """doc_id, text, text_hash, chunk; and the layout, with chunks of about ``chunk_bytes`` of text; of fewer bytes where this
    keeps more tasks busy."""
    spark = docs.sparkSession
    # A document counts as 100 bytes at least, so that a chunk does not hold very many empty ones.
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 100)).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, total // chunk_bytes + 1, min(tasks, total // least_bytes + 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("chunk"))
    return rows.repartition(int(n), "chunk"), Layout(int(n), 4 * int(n), min(40, max(24, int(total).bit_length() + 4)))


def ordered(pdf: pd.DataFrame) -> tuple[list[int], list[bytes], np.ndarray]:
    """Ids (nulls as LAST_DOC), UTF-8 texts (nulls empty) in order of doc_id, then text; and the rows' own order."""
    ids = [LAST_DOC if x is None or x != x else int(x) for x in pdf["doc_id"]]
    texts = [b"" if t is None else t.encode() for t in pdf["text"]]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order], np.array(order, np.int64)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending integers as differences in 16 bits; 65535 stands for itself, to be continued."""
    if not len(values):
        return b""
    steps = np.diff(values.astype(np.int64), prepend=0)
    more, rest = steps // 65535, steps % 65535
    out = np.full(len(values) + int(more.sum()), 65535, np.uint16)
    out[np.cumsum(more + 1) - 1] = rest
    return out.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint16)
    return np.cumsum(steps.astype(np.int64))[steps != 65535].astype(np.uint64)


def runs(groups: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each group that occurs, with the places of its items in order; none for no items."""
    order = np.argsort(groups, kind="stable")
    cuts = np.flatnonzero(np.diff(groups[order], prepend=-1))
    return [(int(groups[part[0]]), part) for part in np.split(order, cuts[1:])] if len(order) else []


def by_range(cells: np.ndarray, lay: Layout) -> Iterator[tuple[int, int, int]]:
    """Ranges present in sorted cells, with the places of their first and last cell."""
    which = lay.range_of(cells)
    cuts = np.flatnonzero(np.diff(which, prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(cells)], strict=False):
        yield int(which[a]), a, b


def repeated_cells(chunks: DataFrame, lay: Layout, sketch: Callable[[list[int], list[bytes]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(chunk, cells, often): for each chunk and range its cells that are estimated repeated, packed, and one bit for
    each that says whether it is very frequent. ``sketch`` gives a chunk's distinct sorted cells and their counts."""

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        release_worker_state()
        ids, texts, _ = ordered(pdf)
        cells, counts = sketch(ids, texts)
        rows = [(int(pdf["chunk"].iloc[0]), r, pack_sorted(cells[a:b] - lay.base_of(r)), np.minimum(counts[a:b], FREQUENT).astype(np.uint8).tobytes()) for r, a, b in by_range(cells, lay)]
        return pd.DataFrame(rows, columns=["chunk", "range", "cells", "counts"])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack_sorted(x) for x in pdf["cells"]]
        total = np.concatenate(parts)
        counts = np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["counts"]]).astype(np.int64)
        order = np.argsort(total, kind="stable")
        total, counts = total[order], counts[order]
        first = np.flatnonzero(np.diff(total, prepend=np.uint64(2**63)) != 0)
        sums = np.add.reduceat(counts, first) if len(first) else counts
        again, often = total[first][sums >= 2], (sums >= FREQUENT)[sums >= 2]
        r = int(pdf["range"].iloc[0])
        rows = []
        for chunk, own in zip(pdf["chunk"], parts, strict=True):
            at = np.minimum(np.searchsorted(again, own), max(0, len(again) - 1))
            hit = again[at] == own if len(again) else np.zeros(len(own), bool)
            if hit.any():
                rows.append((int(chunk), r, pack_sorted(own[hit]), np.packbits(often[at[hit]]).tobytes()))
        return pd.DataFrame(rows, columns=["chunk", "range", "cells", "often"])

    sketches = chunks.groupBy("chunk").applyInPandas(local, "chunk int, range int, cells binary, counts binary")
    return sketches.repartition(lay.chunks, "range").groupBy("range").applyInPandas(merged, "chunk int, range int, cells binary, often binary")


def read_cells(pdf: pd.DataFrame, lay: Layout) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's repeated cells, sorted, and which are very frequent."""
    rows = sorted(zip(pdf["range"], pdf["cells"], pdf["often"], strict=True))
    cells = [unpack_sorted(c) + lay.base_of(int(r)) for r, c, _ in rows]
    often = [np.unpackbits(np.frombuffer(o, np.uint8), count=len(c)).astype(bool) for c, (_, _, o) in zip(cells, rows, strict=True)]
    return (np.concatenate(cells), np.concatenate(often)) if rows else (np.zeros(0, np.uint64), np.zeros(0, bool))


class Among:
    """Membership in a sorted array of cells, with a small bitmap that answers most noes."""

    def __init__(self, cells: np.ndarray, bits: int = 22):
        self.cells, self.mask = cells, np.uint64((1 << bits) - 1)
        self.map = np.zeros(1 << bits, bool)
        self.map[(cells & self.mask).astype(np.int64)] = True

    def __call__(self, cells: np.ndarray) -> np.ndarray:
        """Places of the given cells in the sorted array, -1 where absent."""
        out = np.full(len(cells), -1, np.int64)
        if len(self.cells):
            maybe = np.flatnonzero(self.map[(cells & self.mask).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.cells, cells[maybe]), len(self.cells) - 1)
            same = self.cells[at] == cells[maybe]
            out[maybe[same]] = at[same]
        return out
