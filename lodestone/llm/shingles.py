"""Near-duplicates by exact similarity of shingle sets: documents link at a Jaccard similarity of 0.8 of their 5-word shingles.

The candidates of operator 7 (fingerprints of the same shingles at two or fewer differing bits, by the generalised
pigeonhole principle) are verified first, each class against one of those that it is linked with. SimHash alone can't give right results here: two sets with a similarity of 0.8
differ in ten of 64 bits on average, too many for any pigeonhole allocation to be selective. So further candidates come
from ``BANDS`` bands of ``ROWS`` minima each: a pair at exactly 0.8 shares no band with a probability of 7e-6, a more
similar one with less.

Every candidate pair that can still change a group is verified on the texts, unless its parity sketches prove that it is
less similar: bit i of a sketch is the parity of the shingles whose hash ends in i, so that two sketches never differ in more
bits than the sets in elements, and sets with a similarity of 0.8 differ in at most a ninth of the sum of their sizes. A
sketch has at least four bits a shingle; the longer one of two is folded.

First each class is compared with one that is the least of most of its bands (or of its linked fingerprints). What then lies
in one group needs no further comparison. In bands that hold several groups, members outside the most frequent group meet all
members of other groups in blocks, where sketches are compared and only each member's nearest become rows. These are verified,
groups are joined, and what is left meets again with ``FURTHER`` times as many, until a round has left no pair out. So a large
group costs rows in proportion to its size, however many of its pairs are similar; only pairs that the sketches take for
similar and that are not (with similarities between 0.79 and 0.8 for the most part) must all be seen.

Documents with equal shingle sets are one class. A text of at most five words is one shingle; null text is as empty. An
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import LAST_DOC, cut, per_text, stored
from lodestone.llm.simhash import components, dealt, fingerprint_value, links, shingle_hashes

SIZE, SIMILARITY = 5, 0.8
BANDS, ROWS = 30, 5
_random = np.random.default_rng(11)
#: Least bits of a parity sketch, and how many members of a band outside its most frequent group meet how many of the band.
SKETCH, BLOCK = 1024, 1000
#: How many of a member's nearest are tried in the first round, and how many times as many in each further one.
NEAREST, FURTHER = 2, 16
FLIP = _random.integers(0, 2**64, BANDS * ROWS, np.uint64)
FACTOR = _random.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, SIZE))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A (signed) hash of each band's minima; none without a shingle."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[i : i + 1024, None] ^ FLIP) * FACTOR).min(axis=0), out=least)
    bands = least.astype("<u8").reshape(BANDS, ROWS)
    keys = [xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(bands)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def sketch(hashes: np.ndarray) -> list[int]:
    """The parity sketch of a set as (signed) longs: the least power of two of bits with four a shingle."""
    size = max(SKETCH, 1 << (4 * len(hashes) - 1).bit_length() if len(hashes) else 0)
    odd = np.bincount((hashes % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def may_be_similar(size: Column, bits: Column, other_size: Column, other_bits: Column) -> Column:
    """False only where sizes and sketches prove a similarity below ``SIMILARITY``."""
    words = F.least(F.size(bits), F.size(other_bits))  # sets of similar sizes have sketches of one length or of twice that
    xor = lambda x, y: x.bitwiseXOR(y)
    own, other = (F.when(F.size(b) > words, F.zip_with(F.slice(b, 1, words), F.slice(b, words + 1, words), xor)).otherwise(b) for b in (bits, other_bits))
    apart = F.aggregate(F.zip_with(own, other, xor), F.lit(0), lambda n, x: n + F.bit_count(x))
    sizes = F.least(size, other_size) + 1e-6 >= F.greatest(size, other_size) * SIMILARITY
    return sizes & (apart * (1 + SIMILARITY) <= (size + other_size) * (1 - SIMILARITY) + 1e-6)


def classed(text: Column) -> Column:
    """struct<fp, print, size, bits, bands>: the hash of the shingle set, its SimHash fingerprint, its size, its parity sketch and
    its band keys."""

    def run(texts: list[str | None]) -> pa.Array:
        fps, prints, sizes, bits, bands = [], [], [], [], []
        for t in texts:
            hashes = shingle_set(t)
            fps.append(xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), 42))
            prints.append(fingerprint_value(hashes))
            sizes.append(len(hashes))
            bits.append(sketch(hashes))
            bands.append(band_keys(hashes))
        both = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, prints)]
        longs = pa.list_(pa.int64())
        return pa.StructArray.from_arrays([*both, pa.array(sizes, pa.int64()), pa.array(bits, longs), pa.array(bands, longs)], ["fp", "print", "size", "bits", "bands"])

    return per_text(run, "struct<fp: long, print: long, size: long, bits: array<long>, bands: array<long>>")(text)


def possible(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (a, b) of classes (fp, size, bits) that their sketches do not rule out."""
    found = pairs.join(texts.select(F.col("fp").alias("b"), F.col("size").alias("n"), F.col("bits").alias("other")), "b")
    found = dealt(found, "a", texts.select(F.col("fp").alias("a"), "size", "bits"), "b")
    return found.filter(may_be_similar(F.col("size"), F.col("bits"), F.col("n"), F.col("other"))).select("a", "b")


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose texts (fp, text) are similar."""
    found = pairs.join(texts.select(F.col("fp").alias("b"), F.col("text").alias("other")), "b")
    found = dealt(found, "a", texts.select(F.col("fp").alias("a"), "text"), "b").select("a", "b", "text", "other")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            keep = []
            for a, text, other in zip(batch.column("a").to_pylist(), batch.column("text"), batch.column("other"), strict=True):
                if last is None or a != last:
                    last, own = a, shingle_set(text.as_py())
                theirs = shingle_set(other.as_py())
                both = len(np.intersect1d(own, theirs, assume_unique=True))
                keep.append(both / max(1, len(own) + len(theirs) - both) >= SIMILARITY)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return cut(found.mapInArrow(verify, "a long, b long"))


def linked_prints(classes: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of classes (fp, print): those with one fingerprint against the least of them, and the least of
    each fingerprint against that of the smallest one that operator 7 links it with. So each class gives two pairs at most."""
    least = cut(classes.groupBy("print").agg(F.min("fp").alias("least")))
    same = dealt(classes.select("fp", "print"), "print", least, "fp").filter("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    near = links(least.select(F.col("print").alias("fp"))).groupBy("b").agg(F.min("a").alias("a"))
    ends = near.join(least.select(F.col("print").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("print").alias("b"), F.col("least").alias("y")), "b")
    return same.union(ends.select(F.least("x", "y"), F.greatest("x", "y")))


def nearest(rows: pa.Table, most: int) -> pa.Table:
    """a, b, more: for each row with ``few`` those ``most`` other rows of its band and of other labels that have the nearest
    sketches, of all that may be similar; whether there are more. Rows: band, few, fp, label, size, bits."""
    band, few, fp, label, size = (rows[c].to_numpy() for c in ("band", "few", "fp", "label", "size"))
    words = pc.list_value_length(rows["bits"]).to_numpy()
    flat, starts = pc.list_flatten(rows["bits"]).to_numpy().view(np.uint64), np.cumsum(words) - words

    def sketches(at: np.ndarray, width: int) -> np.ndarray:
        own = flat[starts[at][:, None] + np.arange(words[at[0]])]
        return own if own.shape[1] == width else own[:, :width] ^ own[:, width:]

    ends, near = [np.zeros((2, 0), np.int64)], [np.zeros(0, np.int64)]
    order = np.argsort(band, kind="stable")
    for members in np.split(order, np.flatnonzero(np.diff(band[order])) + 1):
        probes, others = members[few[members]], members[~few[members]]
        for width in np.unique(words[probes]):
            for theirs in (width // 2, width, width * 2):  # further lengths are of sets whose sizes are too different
                own, met = probes[words[probes] == width], others[words[others] == theirs]
                step = 4_000_000 // max(1, len(met))
                for i in range(0, len(own) if len(met) else 0, max(1, step)):
                    part = own[i : i + max(1, step)]
                    x, y = (sketches(at, min(width, theirs)) for at in (part, met))
                    apart = np.zeros((len(part), len(met)), np.int32)
                    for w in range(x.shape[1]):
                        apart += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
                    may = apart * (1 + SIMILARITY) <= (size[part][:, None] + size[met][None, :]) * (1 - SIMILARITY) + 1e-6
                    p, q = np.nonzero(may & (label[part][:, None] != label[met][None, :]))
                    ends.append(np.stack((part[p], met[q])))
                    near.append(apart[p, q])
    (own, met), near = np.concatenate(ends, axis=1), np.concatenate(near)
    order = np.lexsort((fp[met], near, own))
    own, met = own[order], met[order]
    _, first, counts = np.unique(own, return_index=True, return_counts=True)
    keep = np.arange(len(own)) - np.repeat(first, counts) < most
    x, y, more = fp[own][keep], fp[met][keep], np.repeat(counts > most, counts)[keep]
    return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y), "more": more})


def candidates(shared: DataFrame, labels: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """a, b, more: what members of bands (band, fp) with several labels try next. Bands with more than ``BLOCK`` members meet in
    blocks, smaller ones are dealt."""
    grouped = shared.select("band", "fp").join(labels.hint("merge"), "fp")  # no broadcasts: each round's would stay with the driver
    sizes = grouped.groupBy("band", "label").agg(F.count("*").alias("n"))
    blocks = lambda n: F.ceil(n / BLOCK)
    bands = sizes.groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("most"), blocks(F.sum("n") - F.max("n")).alias("probes"), blocks(F.sum("n")).alias("others"), F.count("*").alias("groups"))
    mixed = cut(grouped.join(bands.filter("groups > 1").drop("groups").hint("merge"), "band").join(texts.select("fp", "size", "bits").hint("merge"), "fp"))
    deals = max(int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions")), mixed.count() // 5000)
    deal = F.when(F.col("others") > 1, F.col("band")).otherwise(F.pmod(F.xxhash64("band"), F.lit(deals)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("fp"), F.col(n))
    columns = [deal.alias("deal"), "band", "fp", "label", "size", "bits"]
    few = mixed.filter("label <> most").select(*columns, F.lit(True).alias("few"), own("probes").alias("i"), every("others").alias("j"))
    all_ = mixed.select(*columns, F.lit(False).alias("few"), every("probes").alias("i"), own("others").alias("j"))

    def run(rows: pa.Table) -> pa.Table:
        return nearest(rows, most)

    return cut(few.union(all_).groupBy("deal", "i", "j").applyInArrow(run, "a long, b long, more boolean").groupBy("a", "b").agg(F.max("more").alias("more")))


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (fp, label: the least of its group), where groups are one that edges (a, b) link."""
    ends = dealt(edges, "a", labels.select(F.col("fp").alias("a"), F.col("label").alias("x")).hint("merge"), "b").join(labels.select(F.col("fp").alias("b"), F.col("label").alias("y")).hint("merge"), "b")
    links_ = cut(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if links_.isEmpty():
        return labels
    names = labels.select("label").distinct().join(components(links_).select(F.col("fp").alias("label"), F.col("label").alias("new")), "label", "left")
    return cut(dealt(labels, "label", names, "fp").select("fp", F.coalesce("new", "label").alias("label")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), label: equal for the rows of one group."""
    known = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))  # texts are found again by their hash, not stored
    rows = stored(known.select("doc_id", "h", classed(F.col("text")).alias("c")).select("doc_id", "h", "c.*"))
    classes = cut(rows.groupBy("fp").agg(F.min("h").alias("h"), F.min("print").alias("print")))
    banded = rows.groupBy("fp").agg(F.first("bands").alias("bands")).select(F.explode("bands").alias("band"), "fp")
    least = banded.groupBy("band").agg(F.min("fp").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = cut(banded.join(least, "band"))
    often = shared.filter("fp <> least").groupBy("fp", "least").agg(F.count("*").alias("n")).groupBy("fp").agg(F.max_by("least", F.struct("n", "least")).alias("least"))
    tried = cut(often.select(F.col("least").alias("a"), F.col("fp").alias("b")).union(linked_prints(classes)).distinct())
    if tried.isEmpty():  # no two classes share a band or a near fingerprint
        return rows.select("doc_id", "h", F.col("fp").alias("label"))

    some = shared.select("fp").union(tried.select("a")).union(tried.select("b")).distinct()
    needed = rows.join(some, "fp", "left_semi").groupBy("fp").agg(F.min("h").alias("h"), F.first("size").alias("size"), F.first("bits").alias("bits"))
    texts = stored(dealt(known, "h", needed, "doc_id").groupBy("fp").agg(*(F.first(c).alias(c) for c in ("text", "size", "bits"))))
    edges = similar(cut(possible(tried, texts)), texts)
    labels = cut(texts.select("fp").join(components(edges).hint("merge"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label")))
    most, more = NEAREST, True
    while more:  # a round that leaves no pair out is the last one
        pairs = candidates(shared, labels, texts, most)
        new = cut(pairs.select("a", "b").join(tried.hint("merge"), ["a", "b"], "left_anti"))
        if not new.isEmpty():
            labels, tried = joined(labels, similar(new, texts)), tried.union(new)
        most, more = most * FURTHER, not pairs.filter("more").isEmpty()

    named = classes.select("fp").join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))
    return dealt(rows.select("doc_id", "h", "fp"), "fp", named, "doc_id").select("doc_id", "h", "label")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: that with the smallest doc_id (rows without one come last), of several texts under
    that doc_id the one with the least hash, of equal rows any one. Other columns stay, whatever their names."""
    order = F.struct(F.coalesce("doc_id", F.lit(LAST_DOC)).alias("id"), F.col("h").alias("hash"))
    first = near_duplicates(docs).groupBy("label").agg(F.min(order).alias("first")).select("first.*")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce("doc_id", F.lit(LAST_DOC)).alias("id"), F.xxhash64("text").alias("hash"))
    one = keyed.join(first, ["id", "hash"], "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("id", "hash").orderBy("id", "hash")))
    return one.filter("nth = 1").select("row.*")
