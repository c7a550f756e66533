"""Best-fit packing of token sequences by linear grouping.

1. Every document becomes ids and an end id; only longer ones are cut into pieces of ``capacity``, of which the first
   may be shorter. Spark counts pieces by length: a histogram of at most ``capacity`` rows is all the driver sees.
2. Linear grouping: lengths above a limit (several are tried) are put, longest first, in groups of equal cardinality, and all of a group
   count as its longest. For these few sizes a configuration programme is solved by column generation (a simplex over
   configurations, priced by a knapsack), and its solution rounded down.
3. Actual documents replace the rounded sizes, longest first; whatever rounding left over, and all small pieces, go
   longest first where they fit best; new sequences open only if nothing fits.
4. The plan is a list of runs (length, first rank, count, first sequence, offset), as short as the number of distinct
   fillings, whatever the number of documents. Each piece finds its place by its length and its rank among pieces of
   that length, which partial counts by task give without gathering a length in one task.

Null text counts as empty: one piece, the end id. Rows with a null doc_id and repeated rows are packed like others.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, slices, worker_state
from lodestone.llm.pretokens import Words, pretokens

#: Characters of texts that are encoded at a time; a longer text stands alone.
SLICE = 1 << 20


class WordEncoder:
    """Ids by a byte-level vocabulary of the ``tokenizers`` library, looked up once per distinct pre-token.

    Merges never cross pre-tokens, so that a text's ids are those of its pre-tokens. Texts that hold one of the
    vocabulary's special strings are encoded whole.
    """

    #: Bytes of words and ids, with what Python adds to each, that a worker remembers; beyond that it starts anew, which costs
    #: time only.
    CACHE_BYTES = 64 << 20

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)  # ids of tokens that begin with a space
        self.begins[[i for t, i in vocabulary.items() if t[0] == "\u0120"]] = True
        self.clear()

    def clear(self) -> None:
        self.words = Words()
        self.sizes, self.starts = np.zeros(1 << 17, np.int32), np.zeros(1 << 17, np.int64)
        self.flat, self.used = np.zeros(1 << 19, np.uint32), 0
        self.held = 0

    def learn(self, words: list[str]) -> None:
        """Ids of new words. Those of a space and letters are encoded many at a time: the space tells them apart."""
        many = np.array([w[0] == " " and w[1:].isalpha() for w in words], bool)
        some = [w for w, m in zip(words, many.tolist(), strict=True) if m]
        texts = ["".join(some[i : i + 500]) for i in range(0, len(some), 500)]
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        one = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        one_sizes = np.diff(np.flatnonzero(self.begins[one]), append=len(one))
        rest = [e.ids for e in self.tokenizer.encode_batch_fast([w for w, m in zip(words, many.tolist(), strict=True) if not m], add_special_tokens=False)]
        sizes = np.concatenate([one_sizes, np.fromiter(map(len, rest), np.int64, len(rest))]).astype(np.int32)
        ids = np.concatenate([one, np.fromiter(chain.from_iterable(rest), np.uint32)])
        starts = self.used + np.cumsum(sizes, dtype=np.int64) - sizes
        b = len(self.words)
        numbers = np.arange(b - len(words), b)
        numbers = np.concatenate([numbers[many], numbers[~many]])
        while b > len(self.sizes):
            self.sizes, self.starts = np.concatenate([self.sizes, np.zeros_like(self.sizes)]), np.concatenate([self.starts, np.zeros_like(self.starts)])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.sizes[numbers], self.starts[numbers] = sizes, starts
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.held += sum(map(len, words)) + 120 * len(words) + 4 * len(ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        odd = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        for _, tokens, counts in pretokens(["" if i in odd else t for i, t in enumerate(texts)]):
            if self.held > self.CACHE_BYTES:
                self.clear()
            which = np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens))
            if self.words.new:
                self.learn(self.words.taken())
            sizes = self.sizes[which].astype(np.int64)
            ends = np.cumsum(sizes)
            ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[which] - (ends - sizes), sizes)]
            at = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
            out += [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for i in odd:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out


def encoder(path: str) -> WordEncoder:
    return worker_state(("encoder", path), lambda: WordEncoder(path))


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the task's number and rank by length in it."""

    def run(batches):
        task, seen, coder = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(path)
        for b in batches:
            texts, docs_of = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            for a, e in slices([len(t or "") + 200 for t in texts], SLICE):
                rows = []
                for doc, ids in zip(docs_of[a:e], coder.encode([t or "" for t in texts[a:e]]), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    head = len(ids) % capacity or capacity
                    cuts = [0, *range(head, len(ids) + 1, capacity)]
                    for k, (s, t) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append((doc, k, s, t - s, zlib.crc32(ids[s:t].tobytes()), task, int(seen[t - s])))
                        seen[t - s] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()], strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "local_rank"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local_rank long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def simplex_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used, for few sizes: a linear programme by column generation."""
    n = len(sizes)
    basis = np.diag(np.maximum(1, capacity // sizes).astype(float))  # columns: how many of each size
    inverse = np.diag(1 / np.diag(basis))
    level = inverse @ demand
    for _ in range(rounds):
        dual = inverse.sum(axis=0)
        # Unbounded knapsack: the most valuable configuration at each fill.
        value, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(sizes.min()), capacity + 1):
            fits = sizes <= c
            gain = np.where(fits, value[np.maximum(c - sizes, 0)] + dual, -1)
            k = int(gain.argmax())
            if gain[k] > value[c - 1] + 1e-12:
                value[c], pick[c] = gain[k], k
            else:
                value[c] = value[c - 1]
        if value[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(n), capacity
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                column[pick[c]] += 1
                c -= int(sizes[pick[c]])
        way = inverse @ column
        ratio = np.where(way > 1e-9, level / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        level = np.maximum(level - step * way, 0)
        level[out] = step
        pivot = inverse[out] / way[out]
        inverse -= np.outer(way, pivot)
        inverse[out] = pivot
        basis[:, out] = column
    return [(basis[:, k], float(level[k])) for k in range(n) if level[k] > 1e-9]


@dataclass
class Filling:
    """``count`` sequences filled alike: slots (length, rank of its document in the first of them)."""

    slots: list[tuple[int, int]]
    count: int
    used: int = 0

    def split(self, count: int) -> Filling:
        """Takes the first ``count`` of the sequences away as a filling of their own."""
        taken = Filling(list(self.slots), count, self.used)
        self.slots = [(n, r + count) for n, r in self.slots]
        self.count -= count
        return taken


@dataclass
class Planner:
    capacity: int
    counts: dict[int, int]
    done: dict[int, int] = field(default_factory=Counter)

    def take(self, length: int, count: int) -> int:
        """The first rank of ``count`` documents of a length."""
        self.done[length] += count
        return self.done[length] - count

    def substitute(self, groups: list[list[list[int]]], patterns: list[tuple[np.ndarray, float]]) -> list[Filling]:
        """Fills configurations with actual lengths of each group, longest first. groups: [length, left] by group."""
        out = []
        for column, level in patterns:
            left = int(level + 1e-9)
            wanted = [g for g, k in enumerate(column) for _ in range(int(k))]
            while left > 0:
                run, lengths, spent = left, [], Counter()
                for g in wanted:  # as many sequences as each slot's current length lasts for
                    while groups[g] and groups[g][0][1] == 0:
                        groups[g].pop(0)
                    k = next((i for i, (n, c) in enumerate(groups[g]) if c > spent[g, i]), None) if groups[g] else None
                    if k is None:
                        continue
                    spent[g, k] += 1
                    lengths.append((g, k))
                if not lengths:
                    break
                for (g, k), times in spent.items():
                    run = min(run, groups[g][k][1] // times)
                filling = Filling([], run)
                for g, k in lengths:
                    n = groups[g][k][0]
                    groups[g][k][1] -= run
                    filling.slots.append((n, self.take(n, run)))
                    filling.used += n
                out.append(filling)
                left -= run
        return out

    def best_fit(self, open_: list[Filling], rest: list[tuple[int, int]]) -> list[Filling]:
        """Adds ``rest`` (length, count), longest first, each where least room stays."""
        by_room: dict[int, list[Filling]] = {}
        rooms: list[int] = []

        def put(f: Filling) -> None:
            room = self.capacity - f.used
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append(f)

        for f in open_:
            put(f)
        for length, count in sorted(rest, reverse=True):
            while count:
                at = bisect_left(rooms, length)
                if at == len(rooms):
                    fit = self.capacity // length
                    if whole := count // fit:
                        f = Filling([], whole)
                        for _ in range(fit):
                            f.slots.append((length, self.take(length, whole)))
                        f.used = fit * length
                        put(f)
                        count -= whole * fit
                    if count:
                        f = Filling([], 1)
                        for _ in range(count):
                            f.slots.append((length, self.take(length, 1)))
                        f.used = count * length
                        put(f)
                        count = 0
                    continue
                room = rooms[at]
                f = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
                each = min(room // length, max(1, count // f.count)) if f.count <= count else 1
                taken = f if f.count <= count else f.split(count)
                if taken is not f:
                    put(f)
                for _ in range(each):
                    taken.slots.append((length, self.take(length, taken.count)))
                taken.used += each * length
                count -= each * taken.count
                put(taken)
        return [f for fs in by_room.values() for f in fs]


def plan(counts: dict[int, int], capacity: int, groups: int = 48, smalls: tuple[float, ...] = (0.25, 0.34, 0.5)) -> list[Filling]:
    """Fillings for a histogram of lengths: those of the limit for small pieces that needs the fewest sequences."""
    return min((plan_for(counts, capacity, groups, s) for s in smalls), key=lambda fillings: sum(f.count for f in fillings))


def plan_for(counts: dict[int, int], capacity: int, groups: int, small: float) -> list[Filling]:
    """Their number is bounded by the groups and lengths, not by the counts."""
    planner = Planner(capacity, counts)
    full = [Filling([(capacity, planner.take(capacity, counts[capacity]))], counts[capacity], capacity)] if counts.get(capacity) else []
    large = sorted(((n, c) for n, c in counts.items() if small * capacity < n < capacity and c), reverse=True)
    total = sum(c for _, c in large)
    fillings: list[Filling] = []
    parts: list[list[list[int]]] = []
    if total:
        share = total / min(groups, total)
        seen = 0
        for n, c in large:  # a length is split where a group ends
            while c:
                g = int(seen / share + 1e-9)
                fit = max(1, min(c, int(np.ceil((g + 1) * share - 1e-9)) - seen))
                if len(parts) <= g:
                    parts += [[] for _ in range(g + 1 - len(parts))]
                parts[g].append([n, fit])
                seen += fit
                c -= fit
        merged: dict[int, list[list[int]]] = {}
        for p in parts:  # groups whose longest is the same are one size
            if p:
                merged.setdefault(p[0][0], []).extend(p)
        sizes = np.array(list(merged))
        parts = list(merged.values())
        demand = np.array([sum(c for _, c in p) for p in parts], float)
        fillings = planner.substitute(parts, simplex_patterns(sizes, demand, capacity))
    rest = Counter({n: c for n, c in counts.items() if n <= small * capacity and n < capacity})
    for p in parts:
        for n, c in p:
            rest[n] += c
    return full + planner.best_fit(fillings, [(n, c) for n, c in rest.items() if c])


def slots_table(fillings: list[Filling]) -> np.ndarray:
    """Runs sorted by (length, first rank): length, rank, count, first sequence, offset."""
    out, sequence = [], 0
    for f in fillings:
        offset = 0
        for n, r in f.slots:
            out.append((n, r, f.count, sequence, offset))
            offset += n
        sequence += f.count
    table = np.array(out, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, groups: int = 48) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    spark = docs.sparkSession
    cut_pieces = cut(pieces(docs, path, capacity, end_id))
    partial = cut_pieces.groupBy("length", "task").count()
    before = partial.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = cut(before.groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("length", "before"))).alias("before"), F.map_from_entries(F.collect_list(F.struct("length", "count"))).alias("n")))
    counts = {r[0]: r[1] for r in before.select(F.explode("n")).groupBy("key").agg(F.sum("value")).collect()}  # at most ``capacity`` rows
    table = slots_table(plan(counts, capacity, groups))
    shared = spark.sparkContext.broadcast(table)

    def place(batches):
        runs = shared.value
        wide = np.int64(1) << np.int64(40)
        keys = runs[:, 0] * wide + runs[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(keys, length * wide + rank, side="right") - 1
            sequence = runs[at, 3] + rank - runs[at, 1]
            kept = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(runs[at, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut_pieces.join(before.select("task", "before"), "task").withColumn("rank", F.col("local_rank") + F.col("before")[F.col("length")])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
