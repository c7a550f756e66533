"""Queries over citations, answers and evaluation; and the hybrid search that strings the operators together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.checkpoints import cut
from lodestone.functions.text import excerpt
from lodestone.operators import answers, citations, evaluation, graph, retrieval
from lodestone.plans.graph import GRAPH_QUESTIONS, graph_of
from lodestone.plans.graph import SCORED as GRAPH_SCORED
from lodestone.plans.registry import query, table
from lodestone.plans.retrieval import ASKED_VECTORS, CANDIDATES, HASHED, RERANKED, RRF, TOKENS, asked_vectors, doc_vectors, facts, fused, lexical, pool, reranked
from lodestone.plans.routing import ROUTE_QUESTIONS, ROUTED
from lodestone.plans.structured import session as governed
from lodestone.plans.views import DOCS_NORM, QUESTIONS, docs_norm, questions

FLAT = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
EXCERPT = f"CASE WHEN length({FLAT.format('content')}) <= 1200 THEN {FLAT.format('content')} ELSE rtrim(substr({FLAT.format('content')}, 1, 1199)) || '…' END"
PLACES = """CASE source_type WHEN 'docx' THEN 'paragraph ' || (document_id % 90 + 1) WHEN 'pdf' THEN 'page ' || (document_id % 40 + 1) WHEN 'website' THEN 'https://example.com/' || document_id
WHEN 'csv' THEN 'row ' || document_id ELSE 'table documents' || CASE WHEN document_id % 2 = 0 THEN ', record ' || document_id ELSE ', query abcdef012345' END END"""
CITED = f"""{RERANKED}, placed AS (SELECT r.query_id, r.final_rank AS position, document_id, d.source_id, {PLACES} AS display, d.content, {EXCERPT} AS excerpt FROM reranked r JOIN docs_norm d USING (document_id)),
firsts AS (SELECT *, min(position) OVER (PARTITION BY query_id, source_id, display, lower(excerpt)) AS f FROM placed),
cited AS (SELECT *, 'S' || dense_rank() OVER (PARTITION BY query_id ORDER BY f) AS citation_id FROM firsts)"""


def placed(docs: DataFrame) -> DataFrame:
    """Documents with the places that citations need, by type."""
    d, kind, even = F.col("document_id"), F.col("source_type"), F.col("document_id") % 2 == 0
    row = F.when(kind == "docx", (d % 90 + 1).cast("string")).when(kind == "csv", d.cast("string")).when((kind == "database") & even, d.cast("string"))
    columns = {
        "page_number": F.when(kind == "pdf", d % 40 + 1), "row_id": row, "source_uri": F.when(kind == "website", F.concat(F.lit("https://example.com/"), d)), "table_name": F.when(kind == "database", "documents"),
        "query_fingerprint": F.when((kind == "database") & ~even, "abcdef0123456789"),
    }
    return citations.typed_locator(docs.withColumns(columns))


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    top, held = pool(spark, sf_dir)
    docs = placed(held).select("document_id", "source_id", "display", "content")
    found = reranked(spark, sf_dir, (top, held)).select("query_id", "document_id", F.col("final_rank").alias("position"))
    return citations.assign_citations(found.join(docs, "document_id"))


@query(f"WITH {CITED} SELECT query_id, position, document_id, citation_id, display, excerpt FROM cited")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and vector evidence, fused, re-ranked with source diversity and cited: the flagship."""
    return cited(spark, sf_dir).select("query_id", "position", "document_id", "citation_id", "display", "excerpt")


@query(f"WITH {DOCS_NORM} SELECT document_id, {EXCERPT} AS excerpt FROM docs_norm")
def bounded_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_norm(spark, sf_dir).select("document_id", excerpt(F.col("content")).alias("excerpt"))


@query(f"WITH {DOCS_NORM} SELECT document_id, source_type, {PLACES} AS display FROM docs_norm")
def typed_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(docs_norm(spark, sf_dir)).select("document_id", "source_type", "display")


NEUTRAL = "regexp_replace(regexp_replace(content, '\\[(S[^\\]\\n]*)\\]', '［\\1］', 'g'), '\\[(S[^\\]\\n]*)', '［\\1', 'g')"


@query(f"""WITH {CITED}, paragraphs AS (SELECT query_id, position, citation_id, unnest(regexp_split_to_array({NEUTRAL}, '\\n\\s*\\n')) AS p, generate_subscripts(regexp_split_to_array({NEUTRAL}, '\\n\\s*\\n'), 1) AS i FROM cited WHERE position <= 3),
answers AS (SELECT query_id, string_agg(regexp_replace(p, '^\\s+|\\s+$', '', 'g') || ' [' || citation_id || ']', chr(10) || chr(10) ORDER BY position, i) AS answer FROM paragraphs WHERE trim(regexp_replace(p, '\\s+', ' ', 'g')) <> '' GROUP BY 1)
SELECT q.query_id, coalesce(answer, '{citations.INSUFFICIENT}') AS answer, answer IS NULL AS insufficient FROM questions q LEFT JOIN answers a ON q.query_id = a.query_id""")
def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.extractive_answer(questions(spark, sf_dir), cited(spark, sf_dir))


@query(f"WITH {CITED}, lines AS (SELECT query_id, string_agg('[' || citation_id || '] ' || excerpt, chr(10) ORDER BY position) AS evidence FROM cited GROUP BY 1) SELECT q.query_id, 'Use only the evidence.' || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || 'Evidence:' || chr(10) || coalesce(evidence, 'none') AS prompt FROM questions q LEFT JOIN lines l ON q.query_id = l.query_id")
def grounded_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.grounded_prompt(questions(spark, sf_dir), cited(spark, sf_dir), "Use only the evidence.")


#: Answers made from turns of conversations: one good, the others wrong in one way each.
ANSWERS = """answers AS (SELECT conv_id * 1000 + turn AS answer_id, (conv_id + turn) % 7 AS kind, regexp_replace(text, '[\\[\\]]', '', 'g') AS body FROM conversations WHERE length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) > 0)"""


@query(f"""WITH {ANSWERS} SELECT answer_id, CASE kind WHEN 1 THEN 'malformed' WHEN 2 THEN 'misplaced' WHEN 3 THEN 'unknown' WHEN 4 THEN 'uncited' WHEN 5 THEN 'empty' ELSE 'ok' END AS status FROM answers""")
def validate_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    flat, kind = F.regexp_replace(F.regexp_replace("text", r"[\[\]]", ""), r"\n\s*\n", " "), (F.col("conv_id") + F.col("turn")) % 7
    body = F.trim(F.regexp_replace(flat, r"\s+", " "))
    answer = (
        F.when(kind == 1, F.concat(body, F.lit(" [S01]"))).when(kind == 2, F.concat(F.lit("See [S1] "), body, F.lit(" ok"))).when(kind == 3, F.concat(body, F.lit(" [S9]"))).when(kind == 4, body)
        .when(kind == 5, F.lit("[S1]")).when(kind == 6, F.concat(body, F.lit(" [S1] [S2]\n\n"), body, F.lit(" [S2]"))).otherwise(F.concat(body, F.lit(" [S1]")))
    )
    rows = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), answer.alias("answer"), F.array(F.lit("S1"), F.lit("S2")).alias("known"))
    return citations.validate_citations(rows).select("answer_id", "status")


#: Relevant documents are all that hold the question's words as they are. Every fifth question is held to have none.
CASES = f"""{RRF.replace("{k}", "5")}, expected AS (SELECT query_id, document_id, CASE WHEN document_id % 2 = 0 THEN 3 ELSE 2 END AS relevance FROM docs_norm JOIN questions ON contains(content, question) WHERE query_id % 5 <> 0), has AS (SELECT query_id, count(*) AS n FROM expected GROUP BY 1)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = docs_norm(spark, sf_dir), questions(spark, sf_dir)
    held = retrieval.containing(asked.filter("query_id % 5 <> 0"), docs)
    found = held.join(docs.select("document_id", "source_type"), "document_id").join(asked, "query_id")
    item = F.struct(F.concat(F.lit("d"), "document_id").alias("label"), "source_type", F.when(F.col("document_id") % 2 == 0, 3).otherwise(2).alias("relevance"), F.array("question").alias("facts"))
    one = found.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("expected"))
    none = F.array().cast("array<struct<label: string, source_type: string, relevance: int, facts: array<string>>>")
    return asked.join(one, "query_id", "left").select(
        F.col("query_id").alias("case_id"), "question", F.coalesce("expected", none).alias("expected"), F.col("expected").isNull().alias("insufficient"), F.when(F.col("query_id") % 2 == 0, "lexical").otherwise("default").alias("intent"),
        (F.col("query_id") % 2 == 0).alias("specialized"), (F.col("query_id") % 4 == 0).alias("sql_safe_required"), F.when(F.col("expected").isNull(), F.array().cast("array<string>")).otherwise(F.array("question")).alias("required"),
        F.array(F.lit("never said")).alias("contradictions"), F.array(F.lit("vector"), F.lit("lexical")).alias("retrievers"),
    )


def observations(cases: DataFrame, found: DataFrame, slow: float = 1.0) -> DataFrame:
    """What a run answered to ``cases``: from fused evidence ``found``."""
    top = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("d"), "document_id").alias("label")))).alias("r"))
    rows = cases.select("case_id", "question", "expected").join(top, F.col("case_id") == F.col("query_id"), "left")
    labels = F.coalesce(F.transform("r", lambda x: x["label"]), F.array().cast("array<string>"))
    first = F.slice(F.transform("expected", lambda e: e["label"]), 1, 1)
    segment = F.array(F.struct(F.concat("question", F.lit(".")).alias("text"), first.alias("labels")))
    none = F.array().cast("array<struct<text: string, labels: array<string>>>")
    return rows.select(
        "case_id", labels.alias("retrieved"), first.alias("cited"), F.when(F.size(first) > 0, segment).otherwise(none).alias("segments"), F.when(F.col("case_id") % 3 == 0, "default").otherwise("lexical").alias("intent"),
        F.array(F.lit("vector"), F.lit("lexical")).alias("retrievers"), (F.size(first) == 0).alias("insufficient"), (F.col("case_id") % 8 == 0).alias("safe_sql"), F.when(F.col("case_id") % 11 == 0, "timeout").alias("error"),
        (slow * (F.col("case_id") % 13 + 1) / 10).alias("latency"), (F.col("case_id") % 7 / 100).alias("cost"), F.when(F.col("case_id") % 2 == 0, True).alias("judge"),
    )


SCORES = f"""{CASES}, retrieved AS (SELECT query_id, document_id, rank FROM top),
joined AS (SELECT r.query_id, r.rank, e.relevance FROM retrieved r LEFT JOIN expected e ON r.query_id = e.query_id AND r.document_id = e.document_id),
seen AS (SELECT query_id, count(*) AS n, count(relevance) AS hits, min(rank) FILTER (relevance IS NOT NULL) AS first, sum(CASE WHEN relevance IS NULL THEN 0 ELSE (2 ** relevance - 1) / log2(rank + 1) END) AS dcg FROM joined GROUP BY 1),
ideal AS (SELECT query_id, sum((2 ** relevance - 1) / log2(i + 1)) AS idcg FROM (SELECT query_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, document_id) AS i FROM expected) WHERE i <= 5 GROUP BY 1),
firsts AS (SELECT query_id, first(document_id ORDER BY 'd' || document_id) AS doc FROM expected GROUP BY 1),
scores AS (SELECT q.query_id AS case_id, question, q.query_id % 11 = 0 AS failed, h.n IS NULL AS none, coalesce(s.n, 0) AS n, coalesce(s.hits, 0) AS hits, s.first, s.dcg, i.idcg, h.n AS wanted, EXISTS (SELECT 1 FROM retrieved r JOIN firsts f ON r.query_id = f.query_id AND r.document_id = f.doc WHERE r.query_id = q.query_id) AS cited_ok
FROM questions q LEFT JOIN has h ON h.query_id = q.query_id LEFT JOIN seen s ON s.query_id = q.query_id LEFT JOIN ideal i ON i.query_id = q.query_id),
metrics AS (SELECT case_id, CASE WHEN failed THEN 0 WHEN none THEN CASE WHEN n = 0 THEN 1 ELSE 0 END ELSE hits / wanted END::DOUBLE AS recall,
CASE WHEN failed THEN 0 WHEN none THEN CASE WHEN n = 0 THEN 1 ELSE 0 END WHEN n = 0 THEN 0 ELSE hits / n END::DOUBLE AS "precision", CASE WHEN failed THEN 0 WHEN none THEN CASE WHEN n = 0 THEN 1 ELSE 0 END WHEN hits > 0 THEN 1 ELSE 0 END::DOUBLE AS hit,
CASE WHEN failed THEN 0 WHEN none THEN CASE WHEN n = 0 THEN 1 ELSE 0 END WHEN first IS NULL THEN 0 ELSE 1 / first END::DOUBLE AS mrr, CASE WHEN failed THEN 0 WHEN none THEN CASE WHEN n = 0 THEN 1 ELSE 0 END ELSE dcg / idcg END::DOUBLE AS ndcg,
CASE WHEN failed THEN 0 WHEN none OR cited_ok THEN 1 ELSE 0 END::DOUBLE AS citation_accuracy, CASE WHEN failed THEN 0 WHEN none OR NOT regexp_matches(question, '[.!?]') THEN 1 ELSE 0 END::DOUBLE AS faithfulness, CASE WHEN failed THEN 0 ELSE 1 END::DOUBLE AS answer_relevance,
CASE WHEN failed THEN 0 WHEN (case_id % 3 = 0) <> (case_id % 2 = 0) THEN 1 ELSE 0 END::DOUBLE AS route_accuracy, CASE WHEN case_id % 4 <> 0 THEN NULL WHEN failed THEN 0 WHEN case_id % 8 = 0 THEN 1 ELSE 0 END::DOUBLE AS sql_safety, (case_id % 13 + 1) / 10.0::DOUBLE AS latency, case_id % 7 / 100.0::DOUBLE AS cost, none FROM scores)"""
ROUNDED = ("recall", "precision", "hit", "mrr", "ndcg", "citation_accuracy", "faithfulness", "answer_relevance", "route_accuracy", "sql_safety")
MEANS = ", ".join(f'round(avg("{m}"), 6) AS "{m}"' for m in ROUNDED[:-1]) + ", round(coalesce(avg(sql_safety), 1), 6) AS sql_safety"
WHOLE = f"SELECT 'all' AS slice, count(*) AS cases, {MEANS}, round(median(latency), 6) AS median_latency, round(quantile_disc(latency, 0.95), 6) AS p95_latency, round(avg(cost), 6) AS mean_cost"


@query(f"WITH {SCORES} SELECT case_id, " + ", ".join(f'round("{m}", 6) AS "{m}"' for m in ROUNDED) + " FROM metrics")
def score_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cut(cases(spark, sf_dir))
    found = evaluation.score_cases(c, observations(c, fused(spark, sf_dir)))
    return found.select("case_id", *[F.round(m, 6).alias(m) for m in ROUNDED])


@query(f"""WITH {SCORES}, keyed AS (SELECT *, unnest(['intent:' || CASE WHEN case_id % 2 = 0 THEN 'lexical' ELSE 'default' END, 'answerability:' || CASE WHEN none THEN 'insufficient' ELSE 'answerable' END, 'route:' || CASE WHEN case_id % 2 = 0 THEN 'specialized' ELSE 'default' END]) AS slice FROM metrics)
{WHOLE.replace("'all' AS slice", "slice")} FROM keyed GROUP BY slice UNION ALL {WHOLE} FROM metrics""")
def score_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cut(cases(spark, sf_dir))
    o = cut(observations(c, fused(spark, sf_dir)))
    both = evaluation.score_slices(c, o).filter("slice NOT LIKE 'source:%'").unionByName(evaluation.summarize(evaluation.score_cases(c, o).withColumn("slice", F.lit("all")), "slice"))
    return both.select("slice", "cases", *[F.round(m, 6).alias(m) for m in (*ROUNDED, "median_latency", "p95_latency", "mean_cost")])


#: Both runs give the same answers, so that losses are 0 in every slice; the candidate is 5 % slower.
GATES = f"""{SCORES}, slices AS (SELECT unnest(['all', 'intent:' || CASE WHEN case_id % 2 = 0 THEN 'lexical' ELSE 'default' END, 'answerability:' || CASE WHEN none THEN 'insufficient' ELSE 'answerable' END, 'route:' || CASE WHEN case_id % 2 = 0 THEN 'specialized' ELSE 'default' END]) AS slice FROM metrics
UNION SELECT 'source:' || source_type FROM expected JOIN docs_norm USING (document_id)), named AS (SELECT DISTINCT slice FROM slices),
gates AS (SELECT slice, gate, observed, true AS passed FROM named, (VALUES ('recall_loss', 0.0), ('mrr_loss', 0.0), ('latency_ratio', 1.05)) g(gate, observed)
UNION ALL SELECT 'all', gate, value, value = 1.0 FROM (SELECT unnest(['citation_accuracy', 'faithfulness', 'sql_safety']) AS gate, unnest([avg(citation_accuracy), avg(faithfulness), coalesce(avg(sql_safety), 1)]) AS value FROM metrics))"""


def gates_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, found = cut(cases(spark, sf_dir)), cut(fused(spark, sf_dir))

    def report(slow: float) -> DataFrame:
        o = cut(observations(c, found, slow))
        whole = evaluation.summarize(evaluation.score_cases(c, o).withColumn("slice", F.lit("all")), "slice")
        return evaluation.score_slices(c, o).unionByName(whole)

    return evaluation.deployment_gates(report(1.05), report(1.0))


@query(f"WITH {GATES} SELECT slice, gate, round(observed, 6)::DOUBLE AS observed, passed FROM gates")
def deployment_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates_of(spark, sf_dir).withColumn("observed", F.round("observed", 6))


@query(f"WITH {GATES} SELECT bool_and(passed) AS passed, count(*) AS gates, count(*) FILTER (NOT passed) AS failed FROM gates")
def compare_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = evaluation.benchmark_hash(questions(spark, sf_dir).withColumnRenamed("query_id", "case_id")).first()[0]
    return evaluation.compare_reports(gates_of(spark, sf_dir), known, known)


@query("SELECT round(median(value), 6) AS median_latency, round(quantile_disc(value, 0.95), 6) AS p95_latency, round(avg(value), 6) AS mean_cost FROM events")
def latency_cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.latency_cost_summary(table(spark, sf_dir, "events"), "value", "value")
    return found.select(*[F.round(c, 6).alias(c) for c in ("median_latency", "p95_latency", "mean_cost")])


@query(f"""WITH {CASES}, runs AS (SELECT 'lexical' AS strategy, query_id, document_id, rank FROM lex WHERE rank <= 5 UNION ALL SELECT 'vector', query_id, document_id, rank FROM vec WHERE rank <= 5 UNION ALL SELECT 'fused', query_id, document_id, rank FROM top),
firsts AS (SELECT strategy, r.query_id, min(CASE WHEN e.document_id IS NOT NULL THEN rank END) AS first FROM runs r LEFT JOIN expected e ON r.query_id = e.query_id AND r.document_id = e.document_id GROUP BY 1, 2)
SELECT strategy, count(*) AS questions, round(avg(CASE WHEN first IS NULL THEN 0 ELSE 1 END), 6) AS hit, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM firsts GROUP BY 1""")
def compare_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = cases(spark, sf_dir).select(F.col("case_id").alias("query_id"), F.explode("expected").alias("e")).select("query_id", F.substring("e.label", 2, 20).cast("long").alias("document_id"))
    known = facts(spark, sf_dir)
    vector = retrieval.retrieve_vector(retrieval.knn_exact(asked_vectors(spark, sf_dir), known.select("document_id", "embedding"), 5))
    runs = {"lexical": retrieval.retrieve_lexical(lexical(spark, sf_dir, known), 5), "vector": vector, "fused": fused(spark, sf_dir)}
    ranked = None
    for name, found in runs.items():
        part = found.select(F.lit(name).alias("strategy"), "query_id", "document_id", "rank")
        ranked = part if ranked is None else ranked.unionByName(part)
    return evaluation.compare_retrieval(ranked, truth).withColumn("hit", F.round("hit", 6)).withColumn("mrr", F.round("mrr", 6))


@query(f"""WITH {CASES}, seen AS (SELECT DISTINCT source_type FROM expected JOIN docs_norm USING (document_id)), asked AS (SELECT DISTINCT CASE WHEN query_id % 2 = 0 THEN 'lexical' ELSE 'default' END AS intent FROM questions)
SELECT 'missing_source_type' AS rule, t AS detail FROM (VALUES ('pdf'), ('docx'), ('website'), ('csv'), ('database')) v(t) WHERE t NOT IN (SELECT source_type FROM seen)
UNION ALL SELECT 'missing_intent', t FROM (VALUES ('lexical'), ('default'), ('graph')) v(t) WHERE t NOT IN (SELECT intent FROM asked) UNION ALL SELECT 'case_count', count(*)::VARCHAR FROM questions HAVING count(*) NOT BETWEEN 30 AND 50""")
def benchmark_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.benchmark_violations(cases(spark, sf_dir), ["pdf", "docx", "website", "csv", "database"], ["lexical", "default", "graph"])


#: Benchmark passages asked in four ways, and one question for each nation: every plan occurs.
BATCH = """rq AS (SELECT item_id AS query_id, CASE item_id % 4 WHEN 1 THEN 'Find the exact reference AB-' || (100 + item_id) || ': ' || words WHEN 2 THEN 'Show the surrounding text for ' || words WHEN 3 THEN 'How many orders by region?' ELSE words END AS question
  FROM (SELECT item_id, array_to_string(string_split(text, ' ')[1:12], ' ') AS words FROM benchmark)
UNION ALL SELECT 1000000 + n_nationkey, 'Who manages suppliers connected to ' || n_name || '?' FROM nation)"""


def batch_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, words = F.col("query_id") % 4, F.col("question")
    asked = F.when(k == 1, F.concat(F.lit("Find the exact reference AB-"), F.col("query_id") + 100, F.lit(": "), words)).when(k == 2, F.concat(F.lit("Show the surrounding text for "), words)).when(k == 3, "How many orders by region?").otherwise(words)
    nations = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1_000_000).cast("long").alias("query_id"), F.concat(F.lit("Who manages suppliers connected to "), "n_name", F.lit("?")).alias("question"))
    return questions(spark, sf_dir).select("query_id", asked.alias("question")).unionByName(nations)


ORDERS_BY_REGION = "SELECT r_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"


def five_retrievers(spark: SparkSession, sf_dir: str, depth: int = 15) -> dict[str, answers.Retriever | None]:
    docs = docs_norm(spark, sf_dir)
    vectors = lambda asked: asked.select("query_id", retrieval.hashed_vector(F.col("question")).alias("embedding"))

    def windows(asked: DataFrame) -> DataFrame:
        parts = docs.select("document_id", F.posexplode(retrieval.lines(F.col("content"))).alias("position", "s"))
        own = parts.select((F.col("document_id") * retrieval.PLACES + F.col("position")).alias("sentence_id"), retrieval.hashed_vector(F.col("s.text")).alias("embedding"))
        return retrieval.retrieve_sentence_window(vectors(asked), own, docs.select("document_id", "content"), depth, split=retrieval.lines)

    def paths(asked: DataFrame) -> DataFrame:
        entities, edges = graph_of(spark, sf_dir)
        scored = graph.score_paths(graph.walk_paths(graph.find_anchors(asked, entities), edges), asked)
        return graph.retrieve_graph(scored, depth).select("query_id", "path", F.col("score").alias("raw_score"), F.col("score").alias("normalized_score"), "rank")

    return {
        "vector": lambda asked: retrieval.retrieve_vector(retrieval.knn_exact(vectors(asked), doc_vectors(spark, sf_dir), depth)),
        "sentence_window": windows,
        "lexical": lambda asked: retrieval.retrieve_lexical(retrieval.bm25(asked, docs).drop("terms"), depth),
        "graph": paths,
        "sql": answers.database_retriever(governed(spark, sf_dir), {"orders by region": (ORDERS_BY_REGION, ["r_name"])}),
    }


LINE_VECTORS = HASHED.format(name="sv", key="key", tokens=TOKENS.format("text"), source="(SELECT document_id * 4194304 + position AS key, text FROM l)")
WINDOWS = f"""{DOCS_NORM}, {QUESTIONS}, {ASKED_VECTORS}, l AS (SELECT document_id, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS position FROM docs_norm),
sizes AS (SELECT document_id, len(string_split(content, chr(10))) AS n FROM docs_norm), {LINE_VECTORS},
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, key) AS nth FROM (SELECT q.key AS query_id, s.key, round(sum(q.weight * s.weight), 6) AS raw_score FROM qv q JOIN sv s USING (dim) GROUP BY 1, 2)),
placed AS (SELECT query_id, nth, n.key // 4194304 AS document_id, greatest(n.key % 4194304 - 2, 0) AS first, least(n.key % 4194304 + 2, z.n - 1) AS last FROM near n JOIN sizes z ON z.document_id = n.key // 4194304 WHERE nth <= 75)
SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY min(nth)) AS rank FROM placed GROUP BY query_id, document_id, first, last"""
ASKED = "questions AS (SELECT query_id, question FROM rq)"


@query(f"""WITH RECURSIVE {BATCH}, plans AS (WITH {ROUTED.replace(ROUTE_QUESTIONS + ", ", "", 1)} SELECT query_id, confidence, intent, reason FROM routed),
modes AS (SELECT *, CASE intent WHEN 'sql' THEN ['sql'] WHEN 'graph' THEN ['graph', 'vector'] WHEN 'sentence_window' THEN ['sentence_window', 'vector'] WHEN 'lexical' THEN ['lexical', 'vector'] ELSE ['vector', 'sentence_window', 'lexical'] END AS retrievers FROM plans),
texts AS (WITH {CANDIDATES.replace(QUESTIONS, ASKED)} SELECT query_id, document_id, rank, mode FROM candidates), windows AS (WITH {WINDOWS.replace(QUESTIONS, ASKED)}),
walked AS (WITH RECURSIVE {GRAPH_SCORED.replace(GRAPH_QUESTIONS, "gq AS (SELECT query_id, question FROM rq WHERE query_id >= 1000000)").replace("rank <= 5", "rank <= 15")} SELECT query_id, path_id, rank FROM top),
every AS (SELECT query_id, document_id, 'ws:document:' || document_id AS key, rank, mode FROM texts UNION ALL SELECT query_id, document_id, 'ws:document:' || document_id, rank, 'sentence_window' FROM windows WHERE rank <= 15
  UNION ALL SELECT query_id, NULL, 'ws:graph:' || path_id, rank, 'graph' FROM walked),
own AS (SELECT query_id, key, mode, min(document_id) AS document_id, min(rank) AS rank FROM every JOIN modes USING (query_id) WHERE list_contains(retrievers, mode) GROUP BY 1, 2, 3),
fused AS (SELECT query_id, key, min(document_id) AS document_id, round(sum(round(1.0::DOUBLE / (60 + rank), 12)), 9) AS score, min(rank) AS best FROM own GROUP BY 1, 2),
found AS (SELECT query_id, key, document_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, key) AS rank FROM fused),
counted AS ({ORDERS_BY_REGION}), listed AS (SELECT 'ws:row:{{"n":"' || n || '","r_name":"' || r_name || '"}}' AS key, row_number() OVER (ORDER BY r_name) AS rank FROM counted),
evidence AS (SELECT query_id, key, document_id, score, rank FROM found WHERE rank <= 5 UNION ALL SELECT query_id, key, NULL, 1.0, rank FROM listed, modes WHERE intent = 'sql' AND rank <= 5)
SELECT m.query_id, intent, round(confidence, 6) AS confidence, reason, array_to_string(retrievers, ',') AS retrievers, rank, key, document_id, score FROM modes m LEFT JOIN evidence e ON e.query_id = m.query_id""")
def answer_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question under its plan, all five of which occur, with its trace."""
    database = spark.createDataFrame([("orders_db",)], "source_id string")
    found = answers.answer_batch(batch_questions(spark, sf_dir), five_retrievers(spark, sf_dir), database)
    return found.select("query_id", "intent", F.round("confidence", 6).alias("confidence"), "reason", F.array_join("retrievers", ",").alias("retrievers"), "rank", "key", "document_id", "score")
