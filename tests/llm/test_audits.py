"""Whitening against exact eigenvectors, the discriminant on held-out rows, divergence against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from lodestone.llm import discriminant, divergence, whitening

NAN, INF = float("nan"), float("inf")


def vectors(spark, rows, kind="array<float>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}, X string, n string").repartition(3)


def spread(seed, n, d, scale=0.3):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) * np.linspace(1, 0.3, d) * scale).astype(np.float32)


def exact(found):
    """Components by the definition, of distinct vectors of whole numbers."""
    x = np.array(sorted(set(found)), float)
    c = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(c.T @ c / len(x))
    return values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("n, d, kind", [(400, 64, "array<float>"), (90, 6, "array<double>"), (300, 3, "array<float>")])
def test_whitening_is_exact(spark, n, d, kind):
    a = spread(n, n, d)
    rows = [(i, [float(v) for v in a[i]], "a", "b") for i in range(n)]
    rows += [(i, rows[5][1], "a", "b") for i in (n, n, None)]  # copies count in the result, once in the fit
    bad = [(900, None), (901, [NAN] * d), (902, [INF] + [0.0] * (d - 1)), (903, [None] + [0.0] * (d - 1)), (904, []), (905, [0.5] * (d + 1))]
    got = whitening.whiten(vectors(spark, rows + [(i, v, "x", "y") for i, v in bad], kind)).collect()
    k = min(4, d)
    assert got[0].asDict().keys() == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    x = {i: tuple(int(np.floor(256 * v)) for v in row) for i, row, _, _ in rows}
    values, vectors_ = exact(x.values())
    distinct = set(x.values())
    sums = [sum(v[j] for v in distinct) for j in range(d)]
    assert len(got) == k * len(rows) and {r.n for r in got} == {len(distinct)} == {n}
    by = defaultdict(list)
    for r in got:
        by[r.component].append(r)
        assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x[r.vec_id], sums)) and 0 <= r.identity_error < 1e-9
    assert sorted(by) == list(range(1, k + 1))
    for j, found in by.items():
        want = {i: (np.array(v) - np.array(sums) / n) @ vectors_[:, j - 1] / np.sqrt(values[j - 1]) for i, v in x.items()}
        sign = np.sign(sum(r.whitened * want[r.vec_id] for r in found))
        assert all(abs(sign * r.whitened - want[r.vec_id]) < 1e-8 for r in found)
        assert all(abs(r.explained / (values[j - 1] / values.sum()) - 1) < 1e-9 for r in found)


def test_whitening_of_little(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == [] and whitening.whiten(vectors(spark, [(1, None, "", ""), (2, [NAN], "", "")])).collect() == []
    one = whitening.whiten(vectors(spark, [(1, [0.5, 0.25], "", ""), (None, [0.5, 0.25], "", "")])).collect()
    assert len(one) == 4 and all(r.whitened is None and r.n == 1 and r.deviation == 0 and r.identity_error is None and r.explained == 0 for r in one)
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 0.0], "", "") for i in range(9)])).collect()
    assert {r.component for r in line if r.whitened is not None} == {1} and max(r.identity_error for r in line) < 1e-12
    wide = whitening.whiten(vectors(spark, [(i, [1e30 * (-1) ** i, float(i)], "", "") for i in range(4)])).collect()
    assert len(wide) == 8 and all(r.deviation is None for r in wide)


def test_filter_meets_wide_and_flat_spectra():
    rng = np.random.default_rng(5)
    for spectrum in (np.ones(90), np.r_[np.full(6, 7.0), np.ones(84)], np.logspace(6, -6, 90), np.r_[5.0, 4.0, np.zeros(88)], np.linspace(2, 1, 90)):
        q = np.linalg.qr(rng.standard_normal((90, 90)))[0]
        v = (q * spectrum) @ q.T
        values, vectors_, residuals = whitening.eigenvectors(lambda x: v @ x, 90, 4, block=20)
        assert np.allclose(values, np.sort(spectrum)[::-1][:4], rtol=1e-10, atol=1e-10 * spectrum.max()) and residuals.max() <= 1e-11 * spectrum.max()
        assert np.abs(vectors_.T @ vectors_ - np.eye(4)).max() < 1e-12


def test_large_values_stay_exact(spark):
    rows = [(i, [(-1) ** i * 2.0**30 + i, float(i)], "", "") for i in range(50)]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(vectors(spark, rows, "array<double>")).collect()}
    x = [[int(256 * v) for v in r[1]] for r in rows]
    sums = [sum(v[j] for v in x) for j in range(2)]
    assert all(got[i, 1].deviation == (d if (d := sum((50 * a - s) ** 2 for a, s in zip(x[i], sums))) < 2**63 else None) for i in range(50))


def prose(rng, n, bad=None):
    words = ["".join(rng.choices(["the", "ing", "er", "on", "st", "ar", "li"], k=rng.randrange(1, 4))) for _ in range(n)]
    if bad == "symbols":
        words = [w + rng.choice(["###", "&&&", "%%%"]) for w in words]
    elif bad == "shouts":
        words = [w.upper() + "!!" for w in words]
    elif bad == "stutter":
        words = [w for w in words[: n // 20 + 1] for _ in range(20)]
    return " ".join(words).capitalize() + "."


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.choice([8, 40, 300]), kind), kind is None) for i in range(1200) for kind in [rng.choice([None] * 5 + ["symbols", "shouts", "stutter"])]]
    extra = [(None, "The ingon.", True), (5000, None, True), (5001, "", False), (5002, "x" * 300_000 + " ###", False), (3, rows[3][1], rows[3][2])]
    docs = spark.createDataFrame([(i, t, "en", 1, "s") for i, t, _ in rows + extra], "doc_id long, text string, lang string, X int, label string").repartition(3)
    labels = spark.createDataFrame([(i, int(g), 0, "z") for i, _, g in rows] + [(None, 1, 0, "z"), (7, None, 0, "z"), (8, 2, 1, "z"), (99999, 0, 0, "z")], "doc_id long, quality int, toxic int, x string")
    return rows + extra, docs, labels, discriminant.classify(docs, labels).collect()


def test_quality_on_held_out_rows(judged):
    rows, _, _, got = judged
    assert len(got) == len(rows) and sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _, _ in rows)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {i: g for i, _, g in rows[:1200]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 150 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_discriminant_is_the_textbook_one(judged, spark):
    rows, docs, labels, got = judged
    x = np.array([discriminant.statistics(t) for _, t, _ in rows])
    label = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1) and r.doc_id is not None}
    learn = [k for k, (i, _, _) in enumerate(rows) if i in label and zlib.crc32(str(i).encode()) % 5]
    y = np.array([label[rows[k][0]] for k in learn])
    z = (x - x[learn].mean(axis=0)) / np.maximum(x[learn].std(axis=0), 1e-6)
    density = []
    for c in (0, 1):
        a = z[learn][y == c]
        m, n, p = a.mean(axis=0), len(a), z.shape[1]
        s = (a - m).T @ (a - m) / n
        noise = sum(((np.outer(r - m, r - m) - s) ** 2).sum() for r in a) / n**2
        target = np.trace(s) / p * np.eye(p)
        share = min(1.0, noise / ((s - target) ** 2).sum())
        s = (1 - share) * s + share * target + 1e-4 * np.eye(p)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(s), z - m) - 0.5 * np.linalg.slogdet(s)[1])
    want = density[1] - density[0] + np.log((y == 1).sum() / (y == 0).sum())
    found = {}
    for r in got:
        found.setdefault(r.doc_id, r.log_odds)
    assert all(np.isclose(found[i], w, rtol=1e-6, atol=1e-6) for (i, _, _), w in zip(rows, want))


def test_quality_without_both_kinds(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    ones = spark.createDataFrame([(2, 1), (3, 1), (4, 1), (1, 1)], "doc_id long, quality int")
    assert {r.score for r in discriminant.classify(docs, ones).collect()} <= {0.5, 2 / 3, 3 / 4} and {r.predicted for r in discriminant.classify(docs, ones).collect()} == {1}
    assert {round(r.score, 9) for r in discriminant.classify(docs, ones.limit(0)).collect()} == {0.5}
    assert discriminant.classify(docs.limit(0), ones).collect() == []


def brute(rows, least=3):
    """The audit by its definition, in whole numbers and fractions."""
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {w[0] for w in words}:
        own = [w for w in words if w[0] == lang]
        df = Counter(t for _, _, ts in own for t in set(ts))
        kept = sorted(t for t, n in df.items() if n >= least)
        tf = defaultdict(Counter)
        for _, source, ts in own:
            tf[source].update(t for t in ts if df[t] >= least)
        share = lambda c: {t: 1 + int(Fraction(10**9 * (c[t] + 1), c.total() + len(kept))) for t in kept}
        p, every = {s: share(c) for s, c in tf.items()}, share(sum(tf.values(), Counter()))
        for s in p:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in p if o != s]
            terms = [(t, (p[s][t] - every[t]) ** 2 // every[t]) for t in kept if tf[s][t] and p[s][t] > every[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, 200)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items)]
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abcÀéßжд𝒳zZQ", k=rng.choice([1, 1, 2, 3, 4, 6, 7, 12, 13, 20]))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(pool) + rng.choice([" ", "\n", "_1", "  ", "!", " "]) for _ in range(rng.choice([0, 3, 30])))
        rows.append((i, text, rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "ж", None])))
    return rows + [(1, None, "en", "only here"), (2, "", "solo", "x"), (2, "x" * 200_000 + " y", "en", "a"), *rows[:2], *rows[:2]]


@pytest.mark.parametrize("settings", [{}, {"lengths": (1, 2), "bits": 16, "block": 16}, {"lengths": (), "block": 3}])
def test_divergence_by_brute_force(spark, settings):
    rows = corpus(6, 150)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, value int, N string").repartition(3)
    assert sorted(map(tuple, divergence.audit(df, **settings).collect())) == brute(rows)


def test_divergence_of_little(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert divergence.audit(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "a b", "en", "x"), (2, "c", "en", "y"), (3, None, "en", None)]
    got = sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, schema)).collect()))
    assert got == brute(rows) and {r[4] for r in got} == {0} and len(got) == 6


def test_sieve_discards_prefixes_level_by_level(spark):
    rows = [(i, t, "en", "a") for i, t in enumerate(["abcdef abcx", "abcdef", "abcdefgh", "abq", "xyz", "xyz xyz", "q"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").select("lang", "source", "text")
    shelves = divergence.postings(docs)
    first = divergence.refine(shelves, 3, (2,), 26)
    assert first.passes("en", b"abcdef") and not first.passes("en", b"xyz") and not first.passes("fr", b"abcdef")
    second = divergence.prefix_counts(shelves, first, 6).groupBy("key").sum("docs").collect()
    assert {bytes(k): n for k, n in second} == {b"abcdef ": 2, b"abcdef": 1, b"abcx ": 1, b"abq ": 1}
    # Whole terms of a level's length and longer ones count apart: three documents with either are no term.
    assert divergence.kept_terms(docs).collect() == []


@pytest.mark.parametrize("bound", ["POSTINGS", "TERMS", "TERM_BYTES", "DOCS"])
def test_tasks_write_what_they_hold(spark, monkeypatch, bound):
    rows = corpus(7, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(1).select("lang", "source", "text").na.fill("")
    monkeypatch.setattr(divergence, bound, 50)
    shelves = divergence.postings(docs)
    assert shelves.count() > 5
    want = defaultdict(lambda: (0, 0))
    for _, text, lang, source in rows:
        for t, n in Counter(divergence.words_of(text)).items():
            k = (lang or "", source or "", t.decode())
            want[k] = (want[k][0] + 1, want[k][1] + n)
    got = defaultdict(lambda: (0, 0))
    for r in divergence.term_counts(shelves, divergence.Sieve()).collect():
        for g in r.groups:
            k = (r.lang, g.source, r.term)
            got[k] = (got[k][0] + g.docs, got[k][1] + g["count"])
    assert got == want


def test_distinct_documents_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        docs_of = rng.integers(1, 6, 20).astype(np.int32)
        docs = np.concatenate([rng.choice(9, n, replace=False) for n in docs_of]).astype(np.uint16)
        key_of = rng.integers(-1, 7, 20)
        ends = np.cumsum(docs_of)
        want = [len({int(x) for t in np.flatnonzero(key_of == k) for x in docs[ends[t] - docs_of[t] : ends[t]]}) for k in range(7)]
        assert divergence.distinct_docs(key_of, 7, docs_of, docs).tolist() == want


def test_shares_are_exact_for_large_counts():
    counts = np.array([[10**12, 0, 5]])
    assert divergence.shares(counts, counts.sum(axis=1), 3).tolist() == [[1 + 10**9 * (c + 1) // (10**12 + 5 + 3) for c in counts[0].tolist()]]
