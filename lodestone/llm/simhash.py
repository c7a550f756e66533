"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints take the majority of each bit over XXH64 (seed 42) of all 3-word shingles. Equal fingerprints are one
class, represented by its smallest doc_id. Classes link at ``threshold`` or fewer differing bits. To find the links,
bits are put in groups (correlated bits together); group i gets its own threshold t_i with sum(t_i) = threshold -
groups + 1, where -1 skips the group. Two fingerprints within the threshold then agree within t_i in at least one
group. For each fingerprint, dynamic programming picks the thresholds with the fewest estimated candidates; only the
probing side enumerates variants, the indexed side sends one key per group. Candidates are verified by popcount.

An empty table gives an empty table. Null text counts as empty: its fingerprint is zero, and it links like any other.
A null doc_id is left out of component minima; a component without any doc_id has a null component_id. Repeated rows are
members of the same class. Other columns are not looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, per_text

BITS = 64
#: A key's rows are dealt to so many tasks where they are joined with one row for each key.
SALTS = 64


def shingle_hashes(text: str | None, size: int = 3) -> np.ndarray:
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII white-space bytes only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: -size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64)


def fingerprint_value(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 8192):
        part = hashes[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = counts * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, size: int = 3) -> Column:
    """The 64-bit fingerprint as a (signed) long."""

    def run(texts: list[str | None]) -> pa.Array:
        values = np.array([fingerprint_value(shingle_hashes(t, size)) for t in texts], np.uint64)
        return pa.array(values.view(np.int64))

    return per_text(run, "long")(text)


def group_bits(sample: np.ndarray, groups: int) -> list[list[int]]:
    """Bits in ``groups`` groups of nearly equal size, correlated bits together, so that groups differ in how
    selective they are and thresholds can make use of it."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    centred = bits - bits.mean(axis=0) if len(bits) else np.zeros((1, BITS))
    spread = np.sqrt((centred**2).sum(axis=0)) + 1e-9
    likeness = np.abs(centred.T @ centred) / np.outer(spread, spread)
    np.fill_diagonal(likeness, 0)
    left, out = list(range(BITS)), []
    for g in range(groups):
        size = len(left) // (groups - g)
        own = [max(left, key=lambda b: (likeness[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < size:
            best = max(left, key=lambda b: (likeness[b, own].mean(), -b))
            own.append(best)
            left.remove(best)
        out.append(sorted(own))
    return out


def project(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of a group, packed."""
    out = np.zeros(len(values), np.uint64)
    for i, b in enumerate(bits):
        out |= ((values >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def flips(width: int, most: int) -> np.ndarray:
    """Masks of up to ``most`` flipped bits among ``width``."""
    return np.array([sum(1 << b for b in c) for d in range(most + 1) for c in combinations(range(width), d)], np.uint64)


class Estimator:
    """Candidate counts by group and threshold, from the sampled values of each group.

    A value's neighbours are estimated by the sample itself: the share of sampled values within t bits, with one
    half of an observation spread over the ball of that radius for what a sample cannot see.
    """

    def __init__(self, sample: np.ndarray, groups: list[list[int]], threshold: int, rows: int = 1_000_000):
        self.groups, self.threshold, self.rows = groups, threshold, rows
        self.values = [np.unique(project(sample, g), return_counts=True) for g in groups]
        self.total = max(1, len(sample))

    def counts(self, values: np.ndarray) -> np.ndarray:
        """Estimated rows, candidates and probes: value x group x threshold (-1 to threshold)."""
        out = np.zeros((len(values), len(self.groups), self.threshold + 2))
        for g, bits in enumerate(self.groups):
            own, (known, seen) = project(values, bits), self.values[g]
            for t in range(self.threshold + 1):
                masks = flips(len(bits), t)
                found = np.full(len(values), 0.5 * len(masks) / 2.0 ** len(bits))
                for m in masks if len(known) else []:
                    at = np.minimum(np.searchsorted(known, own ^ m), len(known) - 1)
                    found += np.where(known[at] == (own ^ m), seen[at], 0) / self.total
                out[:, g, t + 1] = found * self.rows + len(masks)  # a probe is a row, whatever it finds
        return out

    def allocate(self, values: np.ndarray) -> np.ndarray:
        """Thresholds by value and group, with the least sum of estimated candidates."""
        cost, need = self.counts(values), self.threshold + 1  # in units of t_i + 1
        best = np.full((len(values), need + 1), np.inf)
        best[:, 0] = 0
        picks = np.zeros((len(self.groups), len(values), need + 1), np.int64)
        for g in range(len(self.groups)):
            new = np.full_like(best, np.inf)
            for total in range(need + 1):
                options = np.stack([best[:, total - u] + cost[:, g, u] for u in range(total + 1)])
                picks[g, :, total] = options.argmin(axis=0)
                new[:, total] = options.min(axis=0)
            best = new
        out = np.zeros((len(values), len(self.groups)), np.int64)
        left = np.full(len(values), need)
        for g in reversed(range(len(self.groups))):
            used = picks[g, np.arange(len(values)), left]
            out[:, g], left = used - 1, left - used
        return out


def choose_groups(sample: np.ndarray, threshold: int, rows: int, most: int = 4) -> Estimator:
    """The number of groups with the fewest estimated rows: few wide groups need many probes but keep buckets small when
    there are very many fingerprints, more and narrower ones need a single probe each."""
    tried = []
    for groups in range(2, most + 1):
        e = Estimator(sample, group_bits(sample, groups), threshold, rows)
        part = sample[:2000]
        thresholds = e.allocate(part)
        cost = np.take_along_axis(e.counts(part), thresholds[:, :, None] + 1, axis=2).sum() / max(1, len(part)) + groups
        tried.append((float(cost), groups, e))
    return min(tried, key=lambda x: x[:2])[2]


def links(classes: DataFrame, threshold: int = 2, groups: int | None = None, sample_rows: int = 20_000, most: int = 200) -> DataFrame:
    """Pairs (a < b) of different fingerprints in column ``fp`` that differ in at most ``threshold`` bits: all of them, but
    among the fingerprints of a very full bucket (more than ``most``) only as many as keep connected what is connected.

    ``sample_rows`` bounds the sample from which bits are grouped and candidates estimated; with the number of
    fingerprints it also decides the number of groups where none is given. All of this is about cost only, since every
    allocation is complete.
    """
    spark = classes.sparkSession
    sample = np.array([r[0] for r in classes.select("fp").orderBy(F.xxhash64("fp")).limit(sample_rows).collect()], np.int64).view(np.uint64)
    rows = classes.count()
    estimator = choose_groups(sample, threshold, rows) if groups is None else Estimator(sample, group_bits(sample, groups), threshold, rows)
    parts = estimator.groups
    shared = spark.sparkContext.broadcast(estimator)

    def index(batches):
        for b in batches:
            values = b.column("fp").to_numpy().view(np.uint64)
            for g, bits in enumerate(parts):
                yield pa.record_batch({"g": pa.array(np.full(len(values), g, np.int32)), "key": pa.array(project(values, bits).view(np.int64)), "fp": b.column("fp")})

    def probe(batches):
        masks = {}
        for b in batches:
            values = b.column("fp").to_numpy().view(np.uint64)
            for i in range(0, len(values), 4096):
                part = values[i : i + 4096]
                thresholds = shared.value.allocate(part)
                for g, bits in enumerate(parts):
                    for t in range(threshold + 1):
                        own = part[thresholds[:, g] == t]
                        if len(own):
                            m = masks.setdefault((g, t), flips(len(bits), t))
                            keys = (project(own, bits)[:, None] ^ m[None, :]).ravel()
                            yield pa.record_batch({"g": pa.array(np.full(len(keys), g, np.int32)), "key": pa.array(keys.view(np.int64)), "fp": pa.array(np.repeat(own, len(m)).view(np.int64))})

    schema = "g int, key long, fp long"
    left = classes.select("fp").mapInArrow(probe, schema)
    right = classes.select("fp").mapInArrow(index, schema).withColumnRenamed("fp", "other")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= threshold
    full = cut(right.groupBy("g", "key").count().filter(F.col("count") > most).drop("count"))
    crowded = full.limit(1).count() > 0
    if crowded:
        # Whoever probes a full bucket and whoever is in one meet by shared variants instead.
        met = left.join(full, ["g", "key"], "left_semi").select("fp").union(right.join(full, ["g", "key"], "left_semi").select("other")).distinct()
        left, right = (side.join(full, ["g", "key"], "left_anti") for side in (left, right))
    found = left.join(right, ["g", "key"]).filter((F.col("fp") != F.col("other")) & near)
    pairs = found.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    return (pairs.union(by_variants(met, threshold)) if crowded else pairs).distinct()


def by_variants(prints: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a < b) that connect all of ``prints`` that differ in at most ``threshold`` bits, without any bucket that could
    fill up: two fingerprints within the threshold share a variant with about half of it flipped on either side, and what
    shares a variant lies within the threshold or within that many bits of the least, which stands for the rest.

    For an odd threshold only one side may flip the larger half, so that each pair in a bucket is checked."""
    low, high = threshold // 2, -(-threshold // 2)

    def variants(batches):
        for b in batches:
            values = b.column("fp").to_numpy().view(np.uint64)
            for side, t in ((0, low), (1, high)) if low < high else ((0, low),):
                masks = flips(BITS, t)
                for i in range(0, len(values), 1024):
                    part = values[i : i + 1024]
                    keys = (part[:, None] ^ masks[None, :]).ravel()
                    yield pa.record_batch({"variant": pa.array(keys.view(np.int64)), "side": pa.array(np.full(len(keys), side, np.int32)), "fp": pa.array(np.repeat(part, len(masks)).view(np.int64))})

    rows = prints.select("fp").mapInArrow(variants, "variant long, side int, fp long")
    # All of side 0 are within 2 * low bits of one another, and those of side 1 within the threshold of any of side 0.
    least = rows.filter("side = 0").groupBy("variant").agg(F.min("fp").alias("least"))
    return rows.join(least, "variant").filter("fp <> least").select(F.least("fp", "least").alias("a"), F.greatest("fp", "least").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(fp, label): for each end of an edge (a, b), the smallest end that is reachable.

    Each round takes the smallest label among neighbours and then that label's own label, so that the number of rounds
    grows with the logarithm of a chain's length.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))))
    state = cut(both.groupBy(F.col("a").alias("fp")).agg(F.min("b").alias("label")).select("fp", F.least("fp", "label").alias("label")))
    for _ in range(rounds):
        told = both.join(state.select(F.col("fp").alias("b"), "label"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("label").alias("seen"))
        near = state.join(told, "fp").select("fp", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jump = near.select(F.col("fp").alias("label"), F.col("label").alias("further"))
        new = cut(near.join(jump, "label").select("fp", "old", F.least("label", "further").alias("label")))
        changed = new.filter("label <> old").limit(1).count()
        state = new.drop("old")
        if not changed:
            return state
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def dealt(rows: DataFrame, key: str, named: DataFrame, by: str) -> DataFrame:
    """``rows`` joined with ``named`` (one row a key), where a key may hold a large share of the rows: they are dealt by the key
    and a salt from column ``by``, and ``named`` is repeated only for the salts that a key has."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    present = salted.select(key, "_salt").distinct().join(named, key)
    return salted.join(present, [key, "_salt"]).drop("_salt")


def near_duplicates(docs: DataFrame, threshold: int = 2, groups: int | None = None, size: int = 3) -> DataFrame:
    """doc_id, fp (long), component_id for every row of ``docs``."""
    prints = cut(docs.select("doc_id", fingerprint(F.col("text"), size).alias("fp")))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(links(classes, threshold, groups))
    labelled = cut(classes.join(labels, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label")))
    firsts = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    named = labelled.join(firsts, "label").select("fp", "component_id")
    return dealt(prints, "fp", named, "doc_id").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
