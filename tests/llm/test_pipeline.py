"""The pipeline's stages on a small fixture: each works on what is left, and its decisions take effect."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from lodestone.llm import shingles
from pyspark.sql import functions as F


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    prose = lambda n: ". ".join(" ".join("".join(rng.choices(["the", "ing", "er", "on", "sh", "an", "re"], k=rng.randrange(1, 4))) for _ in range(12)) for _ in range(n))
    shared = prose(2)
    rows = [(i, prose(8) + (" " + shared if i % 4 == 0 else ""), "en", "s", 0) for i in range(30)]
    rows += [(40, rows[5][1], "en", "s", 0), (41, "too short", "en", "s", 0), (42, None, None, None, None), (43, prose(8) + " mail bob.1@mail.example.com now", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    good = {r.doc_id for r in seen["quality_rules"]}
    assert good == {*range(30), 40, 43}
    assert {r.doc_id for r in seen["simhash_near_dedup"]} == good - {40}
    texts = {r.doc_id: r.text for r in seen["suffix_array_dedup"]}
    assert shared in texts[0] and not any(shared in texts[i] for i in (4, 8, 12)) and all(r.n_chars == len(r.text) for r in seen["suffix_array_dedup"])
    assert "<email>" in {r.doc_id: r.text for r in seen["personal_data"]}[43]
    assert {r.doc_id for r in seen["best_fit_packing"]} == good - {40}
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, again)) == sorted(map(key, seen["best_fit_packing"]))


def test_sketches_rule_out_no_similar_sets(spark):
    rng = np.random.default_rng(3)
    rows = []
    for size in (1, 5, 9, 60, 400, 3000):
        for wanted in (0.5, 0.7, 0.79, 0.8, 0.81, 0.9, 1.0):
            both = max(1, round(wanted * size))
            pool = rng.integers(0, 2**64, 2 * size, np.uint64)
            x, y = np.unique(pool[:size]), np.unique(np.concatenate((pool[:both], pool[size : size + (size - both) // 2])))
            likeness = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            rows.append((size, likeness, len(x), shingles.sketch(x), len(y), shingles.sketch(y)))
    df = spark.createDataFrame(rows, "size int, likeness double, n long, a array<long>, m long, b array<long>")
    got = df.select("size", "likeness", shingles.may_be_similar(F.col("n"), F.col("a"), F.col("m"), F.col("b")).alias("may")).collect()
    assert all(r.may for r in got if r.likeness >= 0.8) and sum(r.likeness >= 0.8 for r in got) > 12
    assert not any(r.may for r in got if r.likeness < 0.71 and 60 <= r["size"] <= 400)


@pytest.mark.parametrize("block", [1000, 2])
def test_edited_copies_leave(spark, monkeypatch, block):
    monkeypatch.setattr(shingles, "BLOCK", block)
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    texts = [rng.choices(words, k=rng.randrange(150, 400)) for _ in range(40)]
    for share in (0, 0.01, 0.02, 0.03, 0.05):  # 0: a single word; most of the last ones are not similar enough
        for i in range(40):
            copy = list(texts[i])
            for at in rng.sample(range(len(copy)), max(1, int(share * len(copy)))):
                copy[at] = "changed"
            texts.append(copy)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(None, "a b c"), (900, "A b  c"), (901, "a b c"), (902, "a b d"), (903, None), (904, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect() if r.doc_id is not None)
    assert len(set(label)) < 120 and got == sorted({*label, 900, 902, 903})


@pytest.mark.parametrize("block", [1000, 60])
def test_large_groups_try_few_pairs(spark, monkeypatch, block):
    """Copies that are all alike, where the least member of each band is one with too many edits, so that it links none of them."""
    monkeypatch.setattr(shingles, "BLOCK", block)
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    base = rng.choices(words, k=150)

    def edited(n):
        copy = list(base)
        for at in rng.sample(range(len(copy)), n):
            copy[at] = rng.choice(words)
        return " ".join(copy)

    order = lambda t: np.uint64(xxhash.xxh64_intdigest(shingles.shingle_set(t).tobytes(), 42)).astype(np.int64)
    texts = sorted({edited(4) for _ in range(2000)}, key=order)[:60]
    texts += [t for t in {edited(1) for _ in range(300)} if order(t) > order(texts[-1])]
    sets = [shingles.shingle_set(t) for t in texts]
    label = np.arange(len(texts))
    links = 0
    for a in range(len(texts)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                links += 1
                label[label == max(label[a], label[b])] = min(label[a], label[b])
    tried, verify = [], shingles.similar

    def counted(pairs, texts):
        tried.append(pairs.count())
        return verify(pairs, texts)

    monkeypatch.setattr(shingles, "similar", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.keep_first(docs).collect()) == sorted(set(label.tolist()))
    assert links > 30_000 and sum(tried) < 20 * len(texts)


def test_sketches_of_long_texts(spark):
    """Sketches grow with the sets, so that those of long texts tell 0.7 from 0.8 too, also where one is twice as long."""
    rng = np.random.default_rng(5)
    rows = []
    for size, other in ((5000, 5000), (4097, 4000), (4096, 4200), (20000, 20000), (5000, 900)):
        for wanted in (0.7, 0.801):
            both = int(wanted * (size + other) / (1 + wanted))
            pool = np.unique(rng.integers(0, 2**64, size + other, np.uint64))
            pool = rng.permutation(pool)
            x = pool[:size]
            y = np.concatenate((pool[: min(both, other)], pool[size : size + max(0, other - both)]))
            likeness = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            rows.append((likeness, len(x), shingles.sketch(np.unique(x)), len(y), shingles.sketch(np.unique(y))))
    df = spark.createDataFrame(rows, "likeness double, n long, a array<long>, m long, b array<long>")
    may = shingles.may_be_similar
    got = df.select("likeness", may(F.col("n"), F.col("a"), F.col("m"), F.col("b")).alias("may"), may(F.col("m"), F.col("b"), F.col("n"), F.col("a")).alias("turned"))
    for r in got.collect():
        assert r.may == r.turned and (r.may if r.likeness >= 0.8 else not r.may)
    flat = [(0, i == 0, i, i, len_, bits) for _, n, a, m, b in rows for i, (len_, bits) in enumerate(((n, a), (m, b)))]
    for at in range(0, len(flat), 2):
        t = pa.table({c: [r[i] for r in flat[at : at + 2]] for i, c in enumerate(("band", "few", "fp", "label", "size", "bits"))})
        assert len(shingles.nearest(t, 1)) == (rows[at // 2][0] >= 0.8)
