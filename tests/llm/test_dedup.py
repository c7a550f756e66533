"""Substring, suffix and SimHash operators against brute force, with nulls, ties, repeated rows and extra columns."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash

from lodestone.llm import exchange, shingles, simhash, substrings, suffixes
from lodestone.llm.common import LAST_DOC

SCHEMA = "doc_id long, text string"


def words_removed(rows, size):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    ids = [LAST_DOC if d is None else d for d, _ in rows]
    first = {}
    for d, w in zip(ids, words):
        for p in range(len(w) - size + 1):
            key = tuple(w[p : p + size])
            first[key] = min(first.get(key, (d, p)), (d, p))
    out = []
    for (doc, _), d, w in zip(rows, ids, words):
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < (d, p):
                gone[p : p + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def bytes_removed(rows, size):
    first = {}
    for d, t in rows:
        d, b = LAST_DOC if d is None else d, (t or "").encode()
        for p in range(len(b) - size + 1):
            first[b[p : p + size]] = min(first.get(b[p : p + size], d), d)
    out = []
    for doc, t in rows:
        d, b = LAST_DOC if doc is None else doc, (t or "").encode()
        gone = [0] * len(b)
        for p in range(len(b) - size + 1):
            if first[b[p : p + size]] < d:
                gone[p : p + size] = [1] * size
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture
def small_chunks(monkeypatch):
    for module in (substrings, suffixes):
        monkeypatch.setattr(module, "in_chunks", lambda docs, f=exchange.in_chunks: f(docs, 4000, 3000))


def test_repeated_windows_of_words(spark, small_chunks):
    rng = random.Random(2)
    voc = ["a", "b", "é", "d"]
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choice(voc) for _ in range(rng.randrange(60)))) for i in range(60)]
    rows += [(7, "a b a b a b a b a b"), (70, None), (71, ""), (72, " \n "), (None, rows[3][1]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in substrings.remove_repeated(df, 5).drop("kept_text").collect()), key=str)
    assert got == words_removed(rows, 5)


@pytest.mark.parametrize(("size", "frequent"), [(24, 255), (50, 255), (50, 3)])
def test_repeated_bytes(spark, small_chunks, monkeypatch, size, frequent):
    monkeypatch.setattr(exchange, "FREQUENT", frequent)
    rng = random.Random(size + frequent)
    source = ["".join(rng.choice("abé d") for _ in range(200)) for _ in range(6)] + ["xy" * 150, "All rights reserved. " * 9]
    rows = []
    for i in range(100):
        parts = [s[a : a + rng.randrange(140)] for s in rng.choices(source, k=rng.randrange(8)) for a in [rng.randrange(len(s))]]
        rows.append((i, "".join(parts)))
    rows += [(3, rows[9][1]), (None, rows[9][1]), (None, source[0]), (200, None), (201, ""), (202, source[0] * 3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = sorted((tuple(r) for r in suffixes.remove_repeated(df, size, False).drop("kept_text", "text_hash").collect()), key=str)
    assert got == bytes_removed(rows, size)


def test_merged_transforms_find_every_repeated_string():
    rng = random.Random(4)
    for _ in range(150):
        strings = ["".join(rng.choice("ab\0c"[: rng.choice([2, 4])]) for _ in range(rng.randrange(1, 30))).encode() for _ in range(rng.randrange(1, 12))]
        t = suffixes.Transform(strings, np.array([rng.randrange(3) for _ in strings]))
        depth = rng.choice([2, 5, 9])
        rows, begin, shared = t.repeated(depth)
        count = Counter(s[i : i + depth] for s in strings for i in range(len(s) - depth + 1))
        got = [strings[t.string[p]][t.offset[p] :][:depth] for p in t.place[rows]]
        assert got == sorted(k for k, v in count.items() if v > 1 for _ in range(v))
        assert begin.tolist() == [i for i in range(len(got)) if i == 0 or got[i] != got[i - 1]]
        assert (shared[rows] == depth).all()


def test_cleaned_documents_keep_columns(spark):
    text = "0123456789" * 8 + "é" * 10
    rows = [(1, text, "en", 90, "x"), (2, "head " + text, "en", 95, "y"), (2, "head " + text, "en", 95, "y"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, text_hash string")
    got = sorted((tuple(r) for r in suffixes.clean(df).collect()), key=str)
    assert got == sorted([(1, text, "en", 90, "x"), (2, "head ", "en", 5, "y"), (2, "head ", "en", 5, "y"), (None, "", None, 0, None)], key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert suffixes.remove_repeated(none).count() == substrings.remove_repeated(none).count() == simhash.near_duplicates(none).count() == 0


def test_sketches_survive_packing():
    rng = np.random.default_rng(1)
    for top in (300, 70_000, 2**38):
        values = np.unique(rng.integers(0, top, 500).astype(np.uint64))
        assert (exchange.unpack_sorted(exchange.pack_sorted(values)) == values).all()


def fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def test_simhash_groups(spark):
    rng = random.Random(6)
    voc = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(150):
        if rows and rng.random() < 0.5:
            w = rng.choice(rows)[1].split(" ")
            if rng.random() < 0.7:
                w[rng.randrange(len(w))] = rng.choice(voc)
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, " ".join(rng.choice(voc) for _ in range(rng.choice([1, 2, 3, 120])))))
    rows += [(200, None), (201, ""), (202, "É ÀB c"), (5, rows[5][1]), (None, rows[0][1]), (None, "alone in here really")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("doc_id", simhash.hex_fingerprint("fp"), "component_id").collect()
    prints = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 2:
                    group[i] = group[j] = min(group[i], group[j])
    least = {}
    for g, (d, _) in zip(group, rows):
        least[g] = min([x for x in (least.get(g), d) if x is not None], default=None)
    want = [(d, f"{p:016x}", least[g]) for (d, _), p, g in zip(rows, prints, group)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_allocations_are_complete():
    rng = np.random.default_rng(3)
    sample = rng.integers(0, 2**63, 500).astype(np.uint64)
    for groups in (2, 3, 4):
        parts = simhash.group_bits(sample, groups)
        assert sorted(b for p in parts for b in p) == list(range(64))
        thresholds = simhash.Estimator(sample, parts, 2).allocate(sample)
        assert (thresholds.sum(axis=1) == 2 - groups + 1).all() and thresholds.min() >= -1
        for f, t in zip(sample[:50], thresholds):
            for _ in range(20):
                other = f ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64)))
                near = [int(simhash.project(np.array([f ^ other]), p)[0]).bit_count() <= x for p, x in zip(parts, t)]
                assert any(near)


def test_many_fingerprints_get_wide_groups():
    sample = np.random.default_rng(5).integers(0, 2**63, 3000).astype(np.uint64)
    assert len(simhash.choose_groups(sample, 2, 100_000).groups) == 3 and len(simhash.choose_groups(sample, 2, 10**10).groups) == 2


def flipped(fp, *bits):
    value = fp
    for b in bits:
        value ^= 1 << b
    return value - 2**64 if value >= 2**63 else value


def connected(values, threshold):
    group = list(range(len(values)))
    for i, a in enumerate(values):
        for j, b in enumerate(values[:i]):
            if ((a ^ b) & (2**64 - 1)).bit_count() <= threshold:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted(sorted(v for v, g in zip(values, group) if g == x) for x in set(group))


@pytest.mark.parametrize(("threshold", "most"), [(2, 1000), (2, 3), (3, 2), (1, 1)])
def test_links_connect_dense_clusters(spark, threshold, most):
    rng = random.Random(threshold + most)
    centres = [rng.getrandbits(64) for _ in range(4)]
    values = sorted({flipped(c, *rng.sample(range(64), rng.randrange(5))) for c in centres for _ in range(60)} | {rng.getrandbits(63) for _ in range(20)})
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    pairs = simhash.links(df, threshold, most=most).collect()
    assert all(a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= threshold for a, b in pairs) and len(set(pairs)) == len(pairs)
    labels = {r.fp: r.label for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    got = {}
    for v in values:
        got.setdefault(labels.get(v, v), []).append(v)
    assert sorted(map(sorted, got.values())) == connected(values, threshold)


def test_groups_without_ids_stay_apart(spark):
    """Linked classes of which several have no doc_id: edges 10-11 and 20-21, where 10, 20 and 21 have none."""
    rng = random.Random(2)
    a, b = (" ".join("".join(rng.choices("abcdef", k=6)) for _ in range(400)) for _ in range(2))
    rows = [(None, a), (1, a + " tail"), (None, b), (None, b + " tail"), (None, b), (2, None), (None, "")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    prints = [fingerprint(t) for _, t in rows]
    assert (prints[0] ^ prints[1]).bit_count() <= 2 >= (prints[2] ^ prints[3]).bit_count() and len(set(prints[:4])) == 4
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 0), (0, 0), (0, 1), (0, 2), (1, 1), (2, 2)]


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d e f", "k"), (1, "a b c d e f", "l"), (2, "x y z q r s", "m"), (None, "a b c d e f", "n"), (5, "a b c d e f", "o"), (5, "p q r s t u v", "p"), (6, "u v w", "q"), (6, "u v w", "q"), (None, "alone here", "r"), (None, "alone here", "r")]
    got = shingles.keep_first(spark.createDataFrame(rows, "doc_id long, text string, label string")).collect()
    assert sorted((r.doc_id or 0, r.text, r.label) for r in got) == [(0, "alone here", "r"), (1, "a b c d e f", "l"), (2, "x y z q r s", "m"), (5, "p q r s t u v", "p"), (6, "u v w", "q")]


def unlike(n, words):
    rng = random.Random(n)
    return [(i, " ".join("".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(words))) for i in range(n)]


@pytest.mark.parametrize("rows", [unlike(2, 9), unlike(3, 300), [(1, ""), (2, None), (None, "")], [*unlike(8, 300), (90, unlike(8, 300)[0][1])]])
def test_tables_and_chunks_without_a_repeated_passage(spark, small_chunks, rows):
    """Nothing repeats, there are only empty texts, or all chunks but one or two are clean."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted((tuple(r) for r in substrings.remove_repeated(df).drop("kept_text").collect()), key=str) == words_removed(rows, 20)
    assert sorted((tuple(r) for r in suffixes.remove_repeated(df).drop("kept_text", "text_hash").collect()), key=str) == bytes_removed(rows, 50)
    assert suffixes.clean(df).count() == len(rows)


def test_words_whose_polynomials_collide_stay(spark):
    def thue_morse(n):
        return "".join("ab"[bin(i).count("1") & 1] for i in range(n))

    a = thue_morse(1024)
    rows = [(1, " ".join(["w"] * 19 + [a])), (2, " ".join(["w"] * 19 + [a.translate(str.maketrans("ab", "ba"))]))]
    got = sorted((tuple(r) for r in substrings.remove_repeated(spark.createDataFrame(rows, SCHEMA)).drop("kept_text").collect()), key=str)
    assert got == words_removed(rows, 20) and all(r[2] == 0 for r in got)


def test_texts_beyond_two_slices(spark, monkeypatch):
    for module in (substrings, suffixes):
        monkeypatch.setattr(module, "SLICE", 1000)
    rng = random.Random(8)
    base = "".join(rng.choices("abcdefgh \n", k=4000))
    rows = [(1, base), (2, "x" * 3000 + " " + base[100:2600]), (3, base[990:1040] + "y " + base), (4, "z " * 900 + base[1970:2030])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r) for r in substrings.remove_repeated(df).drop("kept_text").collect()), key=str) == words_removed(rows, 20)
    assert sorted((tuple(r) for r in suffixes.remove_repeated(df).drop("kept_text", "text_hash").collect()), key=str) == bytes_removed(rows, 50)


def test_suffix_sizes_are_checked_and_names_may_clash(spark):
    df = spark.createDataFrame([(1, "a" * 80, 7), (2, "b" + "a" * 80, 8)], "doc_id long, text string, _hash int")
    for size in (19, 274):
        with pytest.raises(ValueError, match="size"):
            suffixes.remove_repeated(df, size)
    assert sorted((r.doc_id, r.text, r._hash) for r in suffixes.clean(df).collect()) == [(1, "a" * 80, 7), (2, "b", 8)]


def test_words_cost_what_is_new():
    def seconds(n):
        texts = [" ".join(f"w{i}x{k}" for k in range(8)).encode() for i in range(n)]
        words, began = substrings.Words(), time.process_time()
        numbers = [words(t).tolist() for t in texts]
        took = time.process_time() - began
        assert numbers == [list(range(8 * i, 8 * i + 8)) for i in range(n)] and len(words.number) == 8 * n
        for i in (0, 1, n // 2, n - 1):
            assert words.halves[8 * i].tobytes() == xxhash.xxh3_128_digest(f"w{i}x0".encode())
        return took / n

    few = min(seconds(2_000) for _ in range(3))
    assert seconds(20_000) < 4 * few


def test_clean_keeps_columns_of_any_name(spark):
    passage = "this passage is longer than fifty bytes and stands in two documents"
    rows = [(1, passage, 7, "k", 1), (2, "before " + passage, 8, "l", 2), (None, passage, 9, "m", 3), (2, "before " + passage, 10, "n", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _HASH int, Kept_Text string, Row int").repartition(2)
    got = suffixes.clean(docs)
    assert got.columns == docs.columns
    assert sorted((r["_HASH"], r["Kept_Text"], r["Row"], r.doc_id, r.text) for r in got.collect()) == [(7, "k", 1, 1, passage), (8, "l", 2, 2, "before "), (9, "m", 3, None, ""), (10, "n", 4, 2, "before ")]
    assert suffixes.clean(docs.limit(0)).collect() == [] and shingles.keep_first(docs.limit(0)).collect() == []


def test_a_third_of_equal_texts(spark):
    rng = random.Random(8)
    prose = lambda: " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(60))
    same = prose()
    rows = [(i, same if i % 3 == 0 else prose(), i) for i in range(300)] + [(1000, same + " more", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(5)
    assert sorted(r.doc_id for r in shingles.keep_first(docs).collect()) == sorted({0, *(i for i in range(300) if i % 3)})
