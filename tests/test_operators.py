"""Retrieval, fusion, graph, citation, evaluation, governance and maintenance operators on small tables."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestone.operators import citations, evaluation, governance, graph, ingest, maintenance, ranking, retrieval, routing
from lodestone.operators.components import components, dealt, star_edges


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "alpha", "cat cat dog"), (2, "beta", "dog"), (3, "cat", "bird")], "document_id long, title string, content string")
    asked = spark.createDataFrame([(1, "Cat cat?"), (2, "unknown")], "query_id long, question string")
    got = {(r.query_id, r.document_id): r.raw_score for r in retrieval.bm25(asked, docs).collect()}
    idf, mean = math.log(1 + (3 - 2 + 0.5) / 2.5), 5 / 3
    want = {(1, d): round(2 * idf * w * 2.5 / (w + 1.5 * (0.25 + 0.75 * n / mean)), 9) for d, w, n in ((1, 2, 3), (3, 0.5, 1))}
    assert got == pytest.approx(want)


def test_nearest_vectors(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 8))
    vectors[7] = vectors[9]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(999, [0.0] * 8)], "document_id long, embedding array<double>").repartition(5)
    asked = df.filter("document_id % 50 = 9").withColumnRenamed("document_id", "query_id")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for block in (64 << 20, 150):  # a single set, and sets of about two questions
        got = {}
        for r in retrieval.knn_exact(asked, df, 4, block).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.document_id))
        for q, found in got.items():
            scores = np.round(unit @ unit[q], 6)
            assert [d for _, d in sorted(found)] == sorted(range(300), key=lambda i: (-scores[i], i))[:4]
        assert len(got) == 6


def test_incremental_embedding(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, t string")
    model = lambda xs: np.array([[float(len(x)), ord(x[0])] for x in xs])
    first = retrieval.embed_incremental(texts.filter("k < 3"), spark.createDataFrame([], "k long, content_sha string, model string"), "k", "t", model, "m1").select("k", "content_sha", "model")
    changed = texts.withColumn("t", F.when(F.col("k") == 2, "z").otherwise(F.col("t")))
    assert sorted(r.k for r in retrieval.embed_incremental(changed, first, "k", "t", model, "m1").collect()) == [2, 3]
    with pytest.raises(ValueError):
        retrieval.embed_incremental(texts, first, "k", "t", model, "m2")


def evidence(spark, rows):
    return spark.createDataFrame([(1, d, m, r, 0.5, 0.5) for d, m, r in rows], "query_id long, document_id long, mode string, rank long, raw_score double, normalized_score double")


def test_reciprocal_ranks(spark):
    rows = ranking.canonical_key(evidence(spark, [(1, "vector", 1), (1, "lexical", 1), (1, "sentence_window", 1), (2, "vector", 2), (2, "vector", 3), (3, "lexical", 2)]), "w")
    got = {r.document_id: r for r in ranking.fuse(rows).collect()}
    assert got[1].score == pytest.approx(3 / 61) and got[2].score == pytest.approx(1 / 62) and [got[d]["rank"] for d in (1, 2, 3)] == [1, 2, 3]
    weighted = {r.document_id: r.score for r in ranking.fuse(rows.filter("mode <> 'sentence_window'"), {"vector": 0.8, "lexical": 0.2}).collect()}
    assert weighted[1] == pytest.approx(1 / 61) and weighted[2] == pytest.approx(0.8 / 62)
    with pytest.raises(ValueError):
        ranking.fusion_candidates({"vector": rows})


def test_source_diversity_equals_two_passes(spark):
    rng = random.Random(5)
    rows = [(q, d, f"s{rng.randrange(3)}", round(rng.random(), 2), d, 0.1) for q in range(60) for d in range(rng.randrange(1, 14))]
    df = spark.createDataFrame(rows, "query_id long, document_id long, source string, score double, fused_rank long, fused_score double")
    got = {}
    for r in ranking.rerank(df, 5, 2).collect():
        got.setdefault(r.query_id, []).append((r.final_rank, r.document_id))
    for q in range(60):
        own = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[4]))
        chosen, used = [], {}
        for r in own:
            if used.get(r[2], 0) < 2 and len(chosen) < 5:
                chosen.append(r)
                used[r[2]] = used.get(r[2], 0) + 1
        chosen += [r for r in own if r not in chosen][: 5 - len(chosen)]
        assert [d for _, d in sorted(got[q])] == [r[1] for r in chosen]


def test_routing(spark):
    asked = ["What is the total revenue by region?", "Who manages the payments team?", "Show the surrounding text", "Find HR-402", "Give the context around the total by region", "hello there", "What does SLA mean?"]
    df = spark.createDataFrame(list(enumerate(asked)), "query_id long, question string")
    db = spark.createDataFrame([("d1",)], "source_id string")
    got = {r.query_id: (r.intent, r.reason) for r in routing.route(df, db).collect()}
    assert got == {0: ("sql", None), 1: ("graph", None), 2: ("sentence_window", None), 3: ("lexical", None), 4: ("default", "mixed_or_ambiguous_intent"), 5: ("default", "confidence_below_threshold"), 6: ("lexical", None)}
    assert routing.route(df, None).filter("query_id = 0").first().reason == "no_ready_database_source"
    two = spark.createDataFrame([("w", "a", "ready", "database"), ("w", "b", "ready", "database")], "workspace_id string, source_id string, status string, source_type string")
    with pytest.raises(PySparkException):
        routing.select_database(two).collect()


def test_entities_are_merged_transitively(spark):
    rows = [(1, "ORG", "Acme Inc", ["A"], 1, 0, 1), (2, "ORG", "ACME Incorporated", ["B"], 2, 0, 1), (3, "ORG", "Beta", ["b"], 3, 0, 1), (4, "LOC", "Beta", [], 4, 0, 1)]
    m = spark.createDataFrame(rows, "mention_id long, entity_type string, name string, aliases array<string>, document_id long, begin long, end long")
    found = {r.mention_id: r.component for r in graph.resolve_entities(m).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4}
    entities, of = graph.canonicalize(m, graph.resolve_entities(m), "w")
    names = {r.canonical_name: r.aliases for r in entities.filter("entity_type = 'ORG'").collect()}
    assert names == {"Beta": ["A", "Acme Inc", "ACME Incorporated", "B", "b"]}
    assert of.count() == 4


def test_long_chains_settle(spark):
    rows = [(i, "ORG", f"n{i}", [f"n{i + 1}"], i, 0, 1) for i in range(40)]
    m = spark.createDataFrame(rows, "mention_id long, entity_type string, name string, aliases array<string>, document_id long, begin long, end long")
    assert graph.resolve_entities(m).select("component").distinct().collect()[0][0] == 0


def test_paths_are_simple(spark):
    edge = lambda a, p, b: (f"{a}{b}", a, p, b, 0.8, [(1, 0, 1, "s")])
    rel = spark.createDataFrame([edge("a", "OWNS", "b"), edge("b", "PART_OF", "c"), edge("c", "OWNS", "a")], "relationship_id string, subject string, predicate string, object string, confidence double, supports array<struct<document_id: long, begin: long, end: long, source_id: string>>")
    ent = spark.createDataFrame([(x, x.upper() + "x", x + "x", []) for x in "abc"], "entity_id string, canonical_name string, normalized_name string, aliases array<string>")
    asked = spark.createDataFrame([(1, "who owns ax")], "query_id long, question string")
    paths = graph.walk_paths(graph.find_anchors(asked, ent), rel)
    assert sorted(">".join(r.nodes) for r in paths.collect()) == ["a>b", "a>b>c", "a>c", "a>c>b"]
    scored = graph.score_paths(paths, asked)
    best = graph.retrieve_graph(scored)
    assert best.filter("rank = 1").first().score == pytest.approx(0.3 / 3 + 0.25 + 0.25 * 0.8 + 0.1 * 0.5 + 0.1)
    text = {r.text for r in graph.render_paths(best, rel, ent).collect()}
    assert "Ax — OWNS → Bx — PART_OF → Cx" in text and "Ax ← OWNS — Cx" in text
    assert graph.walk_paths(graph.find_anchors(asked, ent), rel, 2, ["other"]).count() == 0


def test_citations(spark):
    rows = [(1, 1, "s", "page 1", "Same  text"), (1, 2, "s", "page 2", "Same text"), (1, 3, "s", "page 1", "same TEXT"), (2, 1, "s", "page 1", "x [S9] y\n\nsecond [S")]
    cited = citations.assign_citations(spark.createDataFrame(rows, "query_id long, position long, source_id string, display string, content string"))
    assert [r.citation_id for r in cited.filter("query_id = 1").orderBy("position").collect()] == ["S1", "S2", "S1"]
    asked = spark.createDataFrame([(1, "q"), (2, "q"), (3, "q")], "query_id long, question string")
    answers = {r.query_id: (r.answer, r.insufficient) for r in citations.extractive_answer(asked, cited).collect()}
    assert answers[2] == ("x ［S9］ y [S1]\n\nsecond ［S [S1]", False) and answers[3] == (citations.INSUFFICIENT, True)
    texts = ["Fine [S1].", "Good. [S1] [S2]\n\nAlso. [S2]", "No marker", "Odd [S01]", "In [S1] the middle", "Other [S7]", "[S1]", "  "]
    df = spark.createDataFrame([(i, t, ["S1", "S2"]) for i, t in enumerate(texts)], "answer_id long, answer string, known array<string>")
    got = {r.answer_id: r for r in citations.validate_citations(df).collect()}
    assert [got[i].status for i in range(8)] == ["misplaced", "ok", "uncited", "malformed", "misplaced", "unknown", "empty", "no_segments"]
    assert [(s.text, s.citation_ids) for s in got[1].segments] == [("Good.", ["S1", "S2"]), ("Also.", ["S2"])]


def test_metrics_and_gates(spark):
    case = "case_id long, intent string, insufficient boolean, specialized boolean, sql_safe_required boolean, expected array<struct<label: string, source_type: string, relevance: int, facts: array<string>>>, required array<string>, contradictions array<string>, retrievers array<string>"
    seen = "case_id long, retrieved array<string>, cited array<string>, segments array<struct<text: string, labels: array<string>>>, intent string, retrievers array<string>, insufficient boolean, safe_sql boolean, error string, latency double, cost double, judge boolean"
    cases = spark.createDataFrame([(1, "lexical", False, True, True, [("a", "pdf", 3, ["A is b"]), ("b", "csv", 1, ["c"])], ["a IS b"], ["wrong"], ["v"]), (2, "default", True, False, False, [], [], [], ["v"])], case)
    observed = spark.createDataFrame([(1, ["x", "a"], ["a"], [("A is  b.", ["a"])], "lexical", ["v"], False, True, None, 1.0, 0.1, True), (2, [], [], [], "default", ["v"], True, None, None, 3.0, None, None)], seen)
    got = {r.case_id: r for r in evaluation.score_cases(cases, observed).collect()}
    dcg = 7 / math.log2(3)
    assert (got[1].recall, got[1].precision, got[1].hit, got[1].mrr) == (0.5, 0.5, 1.0, 0.5) and got[1].ndcg == pytest.approx(dcg / (7 + 1 / math.log2(3)))
    assert (got[1].citation_accuracy, got[1].faithfulness, got[1].answer_relevance, got[1].route_accuracy, got[1].sql_safety) == (1, 1, 1, 1, 1)
    assert (got[2].recall, got[2].faithfulness, got[2].citation_accuracy) == (1, 1, 1) and got[2].sql_safety is None
    failed = evaluation.score_cases(cases, observed.withColumn("error", F.lit("timeout"))).agg(F.max("recall"), F.max("route_accuracy"), F.max("sql_safety")).first()
    assert tuple(failed) == (0, 0, 0)
    slices = {r.slice: r for r in evaluation.score_slices(cases, observed).collect()}
    assert slices["source:csv"].recall == 0 and slices["source:pdf"].recall == 1 and slices["intent:default"].cases == 1
    whole = evaluation.summarize(evaluation.score_cases(cases, observed).withColumn("slice", F.lit("all")), "slice")
    same = evaluation.deployment_gates(whole, whole)
    assert evaluation.compare_reports(same, "h", "h").first().passed
    slower = whole.withColumn("median_latency", F.col("median_latency") * 1.2)
    assert {r.gate for r in evaluation.deployment_gates(slower, whole).filter("not passed").collect()} == {"latency_ratio"}
    assert evaluation.deployment_gates(whole.filter("slice = 'none'"), whole).first().gate == "slice_present"
    with pytest.raises(ValueError):
        evaluation.compare_reports(same, "h", "other")
    assert evaluation.benchmark_hash(cases).first()[0] == evaluation.benchmark_hash(cases.repartition(3)).first()[0]


def test_audit_chain_shows_any_change(spark):
    rows = [(f"o{i % 3}", i, str(i), "act", '{"k":%d}' % i, f"2024-01-{i % 28 + 1:02d}T00:00:00") for i in range(90)]
    chain = governance.append_audit_chain(spark.createDataFrame(rows, "org_id string, event_id long, actor string, action string, metadata string, created_at string")).cache()
    assert all(r.ok and r.pruned_through is None for r in governance.verify_audit_chain(chain).collect())
    for column, value in (("actor", "x"), ("action", "x"), ("metadata", "{}"), ("created_at", "2024"), ("hash", "0")):
        bad = chain.withColumn(column, F.when((F.col("org_id") == "o1") & (F.col("sequence") == 7), value).otherwise(F.col(column)))
        broken = {r.org_id: r.first_broken for r in governance.verify_audit_chain(bad).collect()}
        assert broken == {"o0": None, "o1": 7, "o2": None}
    assert governance.verify_audit_chain(chain.filter("sequence <> 5")).filter("not ok").count() == 3
    pruned = governance.purge_audit_prefix(chain, F.lit("2024-01-10"))
    assert all(r.ok and r.pruned_through for r in governance.verify_audit_chain(pruned).collect())


def test_clearance_scrubbing_and_rates(spark):
    assert [r[0] for r in governance.visible(spark.createDataFrame([("public",), ("restricted",), ("odd",)], "classification string"), "internal").collect()] == ["public"]
    meta = '{"a": true, "b": 3, "c": "' + "x" * 300 + '", "d": [1, "' + "y" * 90 + '"], "e": {"f": 1}, "g": 1.5}'
    got = spark.createDataFrame([(meta,)], "m string").select(governance.scrub_metadata(F.col("m")).alias("m")).first().m
    assert got == {"a": "true", "b": "3", "c": "x" * 256, "d": '["1","' + "y" * 64 + '"]'}
    events = spark.createDataFrame([("k", f"2024-01-01 00:00:{s:02d}", s) for s in (1, 2, 59)] + [("k", "2024-01-01 00:01:00", 60)], "key string, t string, event_id long").withColumn("ts", F.col("t").cast("timestamp"))
    assert [(r["count"], r.rejected, r.retry_after) for r in governance.rate_verdicts(events, 2).orderBy("event_id").collect()] == [(1, False, None), (2, False, None), (3, True, 1), (1, False, None)]


def test_lifecycles_and_checkpoints(spark):
    log = spark.createDataFrame([(1, i, s) for i, s in enumerate(["registered", "indexing", "ready", "indexing"])] + [(2, 0, "ready")], "source_id long, place long, status string")
    assert sorted((r.source_id, r.place) for r in maintenance.invalid_transitions(log).collect()) == [(1, 3), (2, 0)]
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, checksum string")
    left, conflict = maintenance.resume(items, spark.createDataFrame([(1, "a"), (2, "x")], "k long, checksum string"), "k")
    assert [r.k for r in left.collect()] == [3] and [(r.k, r.now, r.then) for r in conflict.collect()] == [(2, "b", "x")]


def test_crawl_is_breadth_first(spark):
    links = spark.createDataFrame([(0, 2), (0, 1), (1, 3), (2, 3), (3, 0), (3, 4)], "src long, dst long")
    got = ingest.crawl_order(links, spark.createDataFrame([(0,)], "node long"), 4).orderBy("place").collect()
    assert [(r.node, r.depth) for r in got] == [(0, 0), (1, 1), (2, 1), (3, 2)]


def test_sentence_window_retrieval(spark):
    docs = spark.createDataFrame([(1, "Apples are red. Pears are green. Plums are blue. Figs are brown."), (2, "Nothing here at all.")], "document_id long, content string")
    vectors = retrieval.sentences(docs).select("sentence_id", retrieval.hashed_vector(F.col("text")).alias("embedding"))
    asked = spark.createDataFrame([(1, "pears are green")], "query_id long, question string")
    found = retrieval.retrieve_sentence_window(asked.select("query_id", retrieval.hashed_vector(F.col("question")).alias("embedding")), vectors, docs, 2, radius=1)
    best = found.filter("rank = 1").first()
    assert best.window == "Apples are red. Pears are green. Plums are blue." and (best["first"], best["last"]) == (0, 2)


def test_files_reports_and_graph_snapshots(spark, tmp_path):
    from lodestone.sources import files

    folder = tmp_path / "in"
    folder.mkdir()
    for name, data in (("a.pdf", b"%PDF-1.7 x"), ("b.pdf", b"nope"), ("c.pdf", b""), ("d.txt", b"%PDF-"), ("e.pdf", b"%PDF-" + b"x" * 99)):
        (folder / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r.status for r in files.file_inventory(spark, str(folder), "pdf", 50).collect()}
    assert got == {"a.pdf": "kept", "b.pdf": "magic", "d.txt": "extension", "e.pdf": "too_large"}
    rows = spark.createDataFrame([(1, [("secret", ["a"])])], "case_id long, segments array<struct<text: string, labels: array<string>>>")
    root = str(tmp_path / "reports")
    path = files.write_report(rows, {"benchmark": "h"}, root, "20240101", "base")
    assert "secret" not in spark.read.text(path).first()[0]
    with pytest.raises(PySparkException):
        files.write_report(rows, {"benchmark": "h"}, root, "20240101", "base")
    broken = tmp_path / "reports" / "20240102-bad-0"
    broken.mkdir()
    (broken / "part.json").write_text("{oops\n")
    got = [tuple(r) for r in files.read_reports(spark, root, "case_id long, benchmark string").collect()]
    assert got == [("20240102-bad-0", 1, 1), (path.rsplit("/", 1)[1], 1, 0)]
    docs = spark.createDataFrame([("w", "s", 1, "x"), ("w", "t", 2, "y"), ("v", "s", 3, "z")], "workspace_id string, source_id string, document_id long, content string")
    files.write_documents(docs, str(tmp_path / "docs"))
    assert [r.document_id for r in files.read_documents(spark, str(tmp_path / "docs"), "w", "s").collect()] == [1]
    ent, rel = spark.createDataFrame([("a",)], "entity_id string"), spark.createDataFrame([("r",)], "relationship_id string")
    files.write_graph(ent, rel, graph.graph_manifest(ent, rel), str(tmp_path / "graph"))
    e, r, m = files.read_graph(spark, str(tmp_path / "graph"))
    assert graph.graph_manifest(e, r).first() == m.first()


def test_long_names_are_anchors_and_repeated_mentions_stay_single(spark):
    name = "the very long and winding name of one great old house"
    entities = spark.createDataFrame([("e1", name, ["short"]), ("e2", "house", [])], "entity_id string, normalized_name string, aliases array<string>")
    asked = spark.createDataFrame([(1, f"Who owns {name}?"), (2, "nothing here")], "query_id long, question string")
    assert sorted((r.query_id, r.entity_id) for r in graph.find_anchors(asked, entities).collect()) == [(1, "e1"), (1, "e2")]
    rows = [(1, "A", "x", ["y"]), (1, "A", "x", ["y"]), (2, "A", "y", []), (3, "A", "z", [])]
    m = spark.createDataFrame(rows, "mention_id long, entity_type string, name string, aliases array<string>")
    assert sorted((r.mention_id, r.component) for r in graph.resolve_entities(m).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_crawls_go_as_deep_as_the_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(51)], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "node long")
    assert sorted((r.node, r.depth, r.place) for r in ingest.crawl_order(links, seeds, 1000).collect()) == [(i, i, i + 1) for i in range(52)]


def test_allow_lists_of_any_length(spark):
    pages = spark.createDataFrame([("https://a.b.example/x",), ("https://h12345.test/",), ("https://no.where/",)], "url string")
    listed = spark.range(12_000).selectExpr("concat('*.h', id, '.test') AS pattern").union(spark.createDataFrame([(" *.B.example ",)], "pattern string"))
    assert sorted(r.url for r in ingest.allowed_pages(pages, listed).collect()) == ["https://a.b.example/x"]
    assert [r.url for r in ingest.allowed_pages(pages, listed.union(spark.createDataFrame([("h12345.test",)], "pattern string"))).orderBy("url").collect()] == ["https://a.b.example/x", "https://h12345.test/"]
    assert ingest.allowed_pages(pages, listed.limit(0)).count() == 3


def test_documents_that_hold_a_question(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, None, " ".join(rng.choices(words, k=30)) + ("x" if i % 2 else "")) for i in range(200)] + [(900, "t", None), (901, None, "")]
    asked = [(i, docs[i][2][rng.randrange(20) : 60]) for i in range(20)]
    got = sorted(map(tuple, retrieval.containing(spark.createDataFrame(asked, "query_id long, question string"), spark.createDataFrame(docs, "document_id long, title string, content string")).collect()))
    assert got == sorted((q, d) for q, t in asked for d, _, c in docs if c and t in c)


def test_hashed_vectors(spark):
    texts = ["b a A a", "", None, "only"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").repartition(2).select("k", retrieval.hashed_vector(F.col("t"), 16).alias("v")).collect()
    got = {r.k: r.v for r in rows}
    bucket = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 16
    want = np.zeros(16)
    for t in ("b", "a", "a", "a"):
        want[bucket(t)] += 1
    assert got[0] == pytest.approx((want / np.linalg.norm(want)).tolist()) and got[1] == got[2] == [0.0] * 16 and sum(got[3]) == 1


def test_audit_chains_of_any_text_verify(spark):
    schema = "org_id string, event_id long, actor string, action string, metadata string, created_at string"
    rows = [("o", 1, "é", 'say "hi" \\ \n', '{"k": 1, "a": "ü"}', "2024-01-01"), ("o", 2, None, "x", None, "2024-01-02"), ("p", 1, "中", "y", '{"b":2,"a":1}', "2024-01-03")]
    chain = governance.append_audit_chain(spark.createDataFrame(rows, schema)).cache()
    assert [r.ok for r in governance.verify_audit_chain(chain).collect()] == [True, True]
    for bad in ("no json", '{"k": 2, "a": "ü"}'):
        broken = chain.withColumn("metadata", F.when((F.col("org_id") == "o") & (F.col("sequence") == 1), bad).otherwise(F.col("metadata")))
        assert {r.org_id: r.first_broken for r in governance.verify_audit_chain(broken).collect()} == {"o": 1, "p": None}


def test_components_of_stars_chains_and_hot_groups(spark):
    """A group that most members are in, a chain that runs through small groups, repeats and loners; without edges nothing."""
    hot = [("hot", i) for i in range(3000)] * 2
    chain = [(f"c{i}", 10_000 + i + d) for i in range(40) for d in (0, 1)]
    members = spark.createDataFrame([*hot, *chain, ("one", 99_999)], "g string, m long")
    edges = star_edges(members, ["g"], "m")
    assert edges.count() < 3000 + 2 * len(chain)
    assert edges.groupBy("b").count().agg({"count": "max"}).first()[0] < 150, "no hub has a whole hot group"
    found = {r.node: r.label for r in components(edges).collect()}
    assert found == {**dict.fromkeys(range(3000), 0), **dict.fromkeys(range(10_000, 10_041), 10_000)}
    assert components(edges.limit(0)).count() == 0
    rows = spark.createDataFrame([(None, 1), (5, 2), (5, 3), (6, 4)], "k int, v int")
    names = spark.createDataFrame([(5, "five")], "k int, name string")
    assert sorted(tuple(r) for r in dealt(rows, "k", names, "v").select("k", "v", "name").collect()) == [(5, 2, "five"), (5, 3, "five")]


def test_paths_without_support_are_left_out(spark):
    schema = "relationship_id string, subject string, predicate string, object string, confidence double, supports array<struct<source_id:string>>"
    edges = spark.createDataFrame([("r1", "a", "OWNS", "b", 0.5, [("s",)]), ("r2", "b", "PART_OF", "c", 1.0, []), ("r3", "a", "OWNS", "d", 0.9, [])], schema)
    anchors = spark.createDataFrame([(1, "a", 1.0)], "query_id int, entity_id string, quality double")
    asked = spark.createDataFrame([(1, "who owns b")], "query_id int, question string")
    scored = graph.score_paths(graph.walk_paths(anchors, edges), asked)
    assert {r.path_id: (r.score, r.supported) for r in scored.collect()} == {
        "r1": (round(0.3 + 0.25 + 0.125 + 0.05 + 0.1, 9), True), "r1>r2": (round(0.3 + 0.25 + 0.1875 + 0.025 + 0.09, 9), True), "r3": (round(0.3 + 0.25 + 0.225 + 0.1, 9), False),
    }
    assert [(r.path_id, r["rank"]) for r in graph.retrieve_graph(scored).orderBy("rank").collect()] == [("r1>r2", 1), ("r1", 2)]


def test_best_of_blocks_with_many_ties():
    rng = np.random.default_rng(7)
    k, n = 5, 1000
    scores = np.round(rng.normal(size=(40, n)), 1)
    scores[3] = 0.5  # all equal
    names = rng.permutation(n)
    best, docs = np.full((40, k), -np.inf), np.full((40, k), 2**63 - 1, np.int64)
    for at in range(0, n, 130):
        retrieval.keep_best(best, docs, scores[:, at : at + 130], names[at : at + 130])
    for r in range(40):
        want = sorted(zip(-scores[r], names, strict=True))[:k]
        assert list(zip(-best[r], docs[r], strict=True)) == want
    few, held = np.full((1, k), -np.inf), np.full((1, k), 2**63 - 1, np.int64)
    retrieval.keep_best(few, held, np.array([[0.1, 0.3]]), np.array([8, 9]))
    assert few[0, :2].tolist() == [0.3, 0.1] and held[0, :2].tolist() == [9, 8] and not np.isfinite(few[0, 2:]).any()
