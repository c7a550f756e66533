"""Divergence of a language's sources by the terms they use.

Texts are split once: each task writes, for a language and a few thousand documents at a time, its distinct terms and for each
term the documents that hold it (postings, as arrays of numbers). Which terms a language keeps (those in ``least`` of its
documents) is then found by refining prefixes, as an iceberg query: a pass counts, for each prefix of a few bytes, the distinct
documents that hold it; prefixes in too few are discarded, since no term can be in more documents than its prefix; the next
pass extends only what is left. A term that ends within a level's length is counted there as a whole. Survivors go to the next
pass as a bitmap of fixed size with a bit for the hash of each, so nothing sent to tasks grows with the vocabulary: a prefix
that shares a survivor's bit costs rows in the next count, never a result, since the last pass counts the documents of whole
terms exactly. Tasks add up before rows are sent.

Then each group of a language and a source gets its counts of the kept terms, in blocks of terms: a block holds all sources'
counts of some terms, and gives each ordered pair of sources its part of the sum, and each source its best terms.

Null texts, languages and sources count as ''. Every row is a document: repeated rows, or rows that share a doc_id, count each. A
language with one source has no pairs; without kept terms pairs have value 0 and there are no term rows. An empty table gives
an empty table; other columns are not looked at. Texts of any length are split whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import stored

#: Letters are those of ASCII and all that is not ASCII; only A to Z are folded. Others become spaces.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Ends a whole term among prefixes: no term holds it.
END = b" "
#: Postings, terms and bytes of terms that a task holds before it writes them, and documents of a language in one row.
POSTINGS, TERMS, TERM_BYTES, DOCS = 2_000_000, 400_000, 24 << 20, 65_535
SCALE = 10**9


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


@dataclass
class Sieve:
    """What the passes so far leave: byte lengths of their prefixes, and the survivors' bits of each."""

    lengths: tuple[int, ...] = ()
    bitmaps: tuple[bytes, ...] = ()
    bits: int = 26
    seeds: dict[str, int] = field(default_factory=dict)

    def key(self, term: bytes, level: int) -> bytes:
        n = self.lengths[level]
        return term[:n] if len(term) > n else term + END

    def passes(self, lang: str, term: bytes) -> bool:
        """Whether the longest counted prefix of a term may have survived. Shorter ones did if it did."""
        if not self.lengths:
            return True
        level = next((i for i, n in enumerate(self.lengths) if len(term) <= n), len(self.lengths) - 1)
        if (seed := self.seeds.get(lang)) is None:
            if len(self.seeds) > 10_000:
                self.seeds.clear()
            seed = self.seeds[lang] = xxhash.xxh64_intdigest(lang.encode(), seed=42)
        at = xxhash.xxh64_intdigest(self.key(term, level), seed=seed) & ((1 << self.bits) - 1)
        return bool(self.bitmaps[level][at >> 3] >> (at & 7) & 1)


class Numbers(dict):
    """Terms by number, in order of appearance."""

    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


class Shelf:
    """A language's postings in a task, until they are written."""

    def __init__(self):
        self.numbers, self.sources, self.bytes, self.held = Numbers(), {}, 0, 0
        self.of_doc: list[int] = []  # source of each document
        self.ids: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, source: str, words: list[bytes]) -> None:
        known = len(self.numbers)
        ids = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        if len(self.numbers) > known:
            self.bytes += sum(map(len, islice(reversed(self.numbers), len(self.numbers) - known)))
        ids.sort()
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        self.of_doc.append(self.sources.setdefault(source, len(self.sources)))
        self.ids.append(ids[first])
        self.counts.append(np.diff(first, append=len(ids)).astype(np.uint32))
        self.held += len(first)

    def row(self, lang: str) -> dict[str, object]:
        ids, doc = np.concatenate(self.ids), np.repeat(np.arange(len(self.ids), dtype=np.uint16), [len(x) for x in self.ids])
        order = np.argsort(ids, kind="stable")
        return {
            "lang": lang,
            "sources": list(self.sources),
            "of_doc": np.array(self.of_doc, np.int32).tobytes(),
            "terms": END.join(self.numbers),
            "docs_of": np.bincount(ids, minlength=len(self.numbers)).astype(np.int32).tobytes(),
            "docs": doc[order].tobytes(),
            "counts": np.concatenate(self.counts)[order].tobytes(),
        }


SHELF = pa.schema([("lang", pa.string()), ("sources", pa.list_(pa.string())), *((c, pa.binary()) for c in ("of_doc", "terms", "docs_of", "docs", "counts"))])


def postings(docs: DataFrame) -> DataFrame:
    """lang; sources: names; of_doc: place of each document's source; terms, joined by a space; docs_of: of each term, how many
    documents hold it; docs: these, term by term; counts: how often each holds it. As a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelves: dict[str, Shelf] = {}
        held = terms = size = 0
        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = shelves.setdefault(lang, Shelf())
                before = own.held, len(own.numbers), own.bytes
                own.add(source, words_of(text))
                held, terms, size = held + own.held - before[0], terms + len(own.numbers) - before[1], size + own.bytes - before[2]
                if held > POSTINGS or terms > TERMS or size > TERM_BYTES or len(own.of_doc) >= DOCS:
                    for k, x in shelves.items():
                        yield pa.RecordBatch.from_pylist([x.row(k)], SHELF)
                    shelves.clear()
                    held = terms = size = 0
        for k, x in shelves.items():
            yield pa.RecordBatch.from_pylist([x.row(k)], SHELF)

    return stored(docs.mapInArrow(run, "lang string, sources array<string>, of_doc binary, terms binary, docs_of binary, docs binary, counts binary"))


def shelf_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str], np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for i in range(b.num_rows):
            r = {c: b.column(c)[i].as_py() for c in b.schema.names}
            get = lambda c, kind: np.frombuffer(r[c], kind)  # noqa: E731, B023
            yield r["lang"], r["sources"], get("of_doc", np.int32), r["terms"].split(), get("docs_of", np.int32), get("docs", np.uint16), get("counts", np.uint32)


def distinct_docs(key_of: np.ndarray, n_keys: int, docs_of: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """How many documents hold terms of each key; terms with key -1 have none."""
    terms_of = np.bincount(key_of[key_of >= 0], minlength=n_keys)
    alone = key_of >= 0
    alone[alone] = terms_of[key_of[alone]] == 1
    out = np.zeros(n_keys, np.int64)
    out[key_of[alone]] = docs_of[alone]
    shared = np.repeat(np.where(alone, -1, key_of), docs_of)
    pairs = np.sort((shared[shared >= 0].astype(np.int64) << 16) | docs[shared >= 0])
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:] != pairs[:-1]
    return out + np.bincount(pairs[new] >> 16, minlength=n_keys)


def prefix_counts(shelves: DataFrame, sieve: Sieve, length: int) -> DataFrame:
    """lang, key, docs: of prefixes of ``length`` bytes of terms that ``sieve`` passes and that go on beyond its last length, how
    many documents hold them; several rows for a key, each of some documents."""
    shared, before = shelves.sparkSession.sparkContext.broadcast(sieve), sieve.lengths[-1] if sieve.lengths else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = shared.value
        for lang, _, _, terms, docs_of, docs, _ in shelf_rows(batches):
            keys = Numbers()
            key_of = np.fromiter((keys[t[:length] if len(t) > length else t + END] if len(t) > before and sieve.passes(lang, t) else -1 for t in terms), np.int64, len(terms))
            if keys:
                n = distinct_docs(key_of, len(keys), docs_of, docs)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys), pa.string()), "key": pa.array(list(keys), pa.binary()), "docs": pa.array(n, pa.int64())})

    return shelves.mapInArrow(run, "lang string, key binary, docs long")


def bitmap(survivors: DataFrame, bits: int) -> bytes:
    """A bit for the hash of each (lang, key), made where the rows are: at most 2^bits bits reach the driver."""
    at = F.xxhash64("lang", "key").bitwiseAND(F.lit((1 << bits) - 1))
    parts = survivors.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("part")).agg(F.expr("bitmap_construct_agg(at & 32767)").alias("set"))
    out = bytearray(1 << (bits - 3))
    for part, own in parts.collect():
        out[part * 4096 : part * 4096 + min(4096, len(out))] = own[: len(out)]
    return bytes(out)


def refine(shelves: DataFrame, least: int, lengths: tuple[int, ...], bits: int) -> Sieve:
    """One pass over the postings for each length."""
    sieve = Sieve(bits=bits)
    for n in lengths:
        counts = prefix_counts(shelves, sieve, n).groupBy("lang", "key").agg(F.sum("docs").alias("docs"))
        sieve = Sieve((*sieve.lengths, n), (*sieve.bitmaps, bitmap(counts.filter(F.col("docs") >= least), bits)), bits)
    return sieve


GROUP = pa.list_(pa.struct([("source", pa.string()), ("docs", pa.int64()), ("count", pa.int64())]))


def term_counts(shelves: DataFrame, sieve: Sieve) -> DataFrame:
    """lang, term, groups: array<struct<source, docs, count>>, of terms that the sieve passes; several rows for a term, each of
    some documents."""
    shared = shelves.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = shared.value
        for lang, sources, of_doc, terms, docs_of, docs, counts in shelf_rows(batches):
            stays = np.fromiter((sieve.passes(lang, t) for t in terms), bool, len(terms))
            if not stays.any():
                continue
            names = [t.decode() for t, s in zip(terms, stays.tolist(), strict=True) if s]
            number = np.where(stays, np.cumsum(stays) - 1, -1)
            term = np.repeat(number, docs_of)
            held = term >= 0
            cell = term[held].astype(np.int64) * len(sources) + of_doc[docs[held]]
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            n = np.add.reduceat(counts[held][order].astype(np.int64), first)
            of, source = np.divmod(cell[first], len(sources))
            values = pa.StructArray.from_arrays([pa.array(sources, pa.string()).take(pa.array(source)), pa.array(np.diff(first, append=len(cell)), pa.int64()), pa.array(n)], fields=list(GROUP.value_type))
            ends = np.searchsorted(of, np.arange(len(names) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), pa.array(names, pa.string()), pa.ListArray.from_arrays(pa.array(ends), values)], ["lang", "term", "groups"])

    return shelves.mapInArrow(run, "lang string, term string, groups array<struct<source: string, docs: long, count: long>>")


def kept_terms(docs: DataFrame, least: int = 3, lengths: tuple[int, ...] = (3, 6, 12), bits: int = 26) -> DataFrame:
    """lang, source, term, count, one: of terms in at least ``least`` documents of the language, with the count of occurrences
    in each source that has any; ``one`` is 1 in one row of each term of a language, else 0. As a table in the shared folder."""
    shelves = postings(docs)
    # Tasks have added up already: one exchange by language and term serves the sums and the window.
    counts = term_counts(shelves, refine(shelves, least, lengths, bits)).repartition("lang", "term").select("lang", "term", F.inline("groups"))
    by_source = counts.groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("count").alias("count"))
    term = Window.partitionBy("lang", "term")
    found = by_source.select("lang", "source", "term", "count", F.sum("docs").over(term).alias("docs"), (F.col("source") == F.min("source").over(term)).cast("int").alias("one"))
    return stored(found.filter(F.col("docs") >= least).drop("docs"))


def shares(counts: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (n + v)), exact."""
    whole = np.asarray(n)[:, None] + v
    if len(whole) and int(whole.max()) >= 2**63 // SCALE:  # counts are no larger than their sum
        return (1 + SCALE * (counts.astype(object) + 1) // whole.astype(object)).astype(np.int64)
    return 1 + SCALE * (counts + 1) // whole


def best(values: np.ndarray, names: list[bytes], most: int) -> list[int]:
    """Places of the largest values, ties in byte order of the names."""
    few = np.arange(len(values)) if len(values) <= most else np.flatnonzero(values >= np.partition(values, -most)[-most])
    return sorted(few.tolist(), key=lambda i: (-int(values[i]), names[i]))[:most]


def block_rows(counts: pd.DataFrame, groups: pd.DataFrame, most: int) -> pd.DataFrame:
    """Of one language's block of terms: each pair's part of the sum, and each source's best terms of the block."""
    groups = groups.sort_values("source")
    lang, v = groups["lang"].iloc[0], int(groups["v"].iloc[0])
    sources = groups["source"].tolist()
    n = groups["n"].to_numpy(np.int64)
    row = {s: i for i, s in enumerate(sources)}
    term, terms = pd.factorize(counts["term"])
    count = np.zeros((len(sources), len(terms)), np.int64)
    count[counts["source"].map(row).to_numpy(np.int64), term] = counts["count"].to_numpy(np.int64)
    names = [t.encode() for t in terms]
    p = shares(count, n, v)
    every = shares(count.sum(axis=0)[None, :], n.sum()[None], v)[0]
    out = []
    for i, source in enumerate(sources):
        sums = ((p[i] - p) ** 2 // p).sum(axis=1)
        out += [(lang, source, "pair", other, int(sums[j])) for j, other in enumerate(sources) if j != i]
        over = np.flatnonzero((count[i] > 0) & (p[i] > every))
        values = (p[i][over] - every[over]) ** 2 // every[over]
        out += [(lang, source, "term", terms[over[k]], int(values[k])) for k in best(values, [names[o] for o in over], most)]
    return pd.DataFrame(out, columns=["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, least: int = 3, most_terms: int = 200, block: int = 2048, lengths: tuple[int, ...] = (3, 6, 12), bits: int = 26) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank. ``block`` is about the number of terms that a task compares at
    once; ``bits`` sets the size of the bitmaps (2^26 bits are 8 MB)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(empty("lang"), empty("source"), "text")
    kept = kept_terms(docs, least, lengths, bits)
    known = kept.groupBy("lang").agg(F.sum("one").alias("v"))
    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(known, "lang", "left").select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "v")))
    last = F.expr(f"v div {block}")
    dealt = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    blocks = kept.join(known, "lang").select("lang", "source", "term", "count", F.pmod(F.xxhash64("term"), last + 1).alias("block"))
    parts = blocks.groupBy("lang", "block").cogroup(dealt.groupBy("lang", "block")).applyInPandas(lambda a, b: block_rows(a, b, most_terms), "lang string, source string, part string, item string, value long")
    sums = stored(parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")))
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    # Apart, so that only the best terms of a task are sent.
    return ranked.filter("part = 'pair'").unionByName(ranked.filter((F.col("part") == "term") & (F.col("rank") <= most_terms)))
