"""Queries over evaluation reports and comparisons of graph, re-ranking and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.checkpoints import cut, fresh_folder
from lodestone.operators import citations, evaluation, graph, ranking, retrieval, routing
from lodestone.plans.answers import CITED, PLACES, cases, cited, observations, placed
from lodestone.plans.graph import EDGES, SCORED, graph_of, top_paths
from lodestone.plans.graph import questions as graph_questions
from lodestone.plans.registry import query, table
from lodestone.plans.retrieval import RERANKED, fused, reranked
from lodestone.plans.routing import ROUTED, route_questions
from lodestone.plans.views import docs_norm, questions
from lodestone.sources import files


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cases(spark, sf_dir).select(F.col("case_id").alias("query_id"), F.explode("expected").alias("e"))
    return found.select("query_id", F.substring("e.label", 2, 20).cast("long").alias("document_id"), F.col("e.relevance").alias("grade"))


EXPECTED = "expected AS (SELECT query_id, document_id, CASE WHEN document_id % 2 = 0 THEN 3 ELSE 2 END AS grade FROM docs_norm JOIN questions ON contains(content, question) WHERE query_id % 5 <> 0)"


@query(f"""WITH {CITED}, {EXPECTED}, places AS (SELECT document_id, source_type, {PLACES} AS display FROM docs_norm), wanted AS (SELECT query_id, 'd' || document_id AS label, source_type, display FROM expected JOIN places USING (document_id)),
used AS (SELECT query_id, position, p.source_type, c.display FROM cited c JOIN places p USING (document_id)), hits AS (SELECT query_id, label, min(position) AS p FROM used JOIN wanted USING (query_id, source_type, display) GROUP BY 1, 2)
SELECT w.query_id AS case_id, coalesce(string_agg(label, ',' ORDER BY p, label), '') AS labels FROM (SELECT DISTINCT query_id FROM wanted) w LEFT JOIN hits h ON h.query_id = w.query_id GROUP BY 1""")
def label_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = placed(docs_norm(spark, sf_dir)).select(F.col("document_id"), "source_type", "display")
    wanted = truth(spark, sf_dir).join(places, "document_id").groupBy(F.col("query_id").alias("case_id")).agg(F.collect_list(F.struct(F.concat(F.lit("d"), "document_id").alias("label"), "source_type", "display")).alias("expected"))
    used = cited(spark, sf_dir).join(places.select("document_id", "source_type"), "document_id").select(F.col("query_id").alias("case_id"), "position", "source_type", "display")
    return evaluation.label_observations(used, wanted).select("case_id", F.array_join("labels", ",").alias("labels"))


@query(f"""WITH RECURSIVE {SCORED}, st AS (SELECT DISTINCT query_id, path_id, unnest(path) AS relationship_id FROM top WHERE rank = 1),
places AS (SELECT DISTINCT s.entity_id AS subject, predicate, o.entity_id AS object, document_id, source_id FROM relations r JOIN of_m s ON r.subject = s.mention_id JOIN of_m o ON r.object = o.mention_id),
merged AS (SELECT subject, predicate, object, document_id, max(source_id) AS source_id FROM places GROUP BY 1, 2, 3, 4),
sup AS (SELECT st.query_id, relationship_id, document_id, row_number() OVER (PARTITION BY st.query_id, st.path_id ORDER BY confidence DESC, relationship_id, source_id, document_id) AS place FROM st JOIN relationships USING (relationship_id) JOIN merged USING (subject, predicate, object)),
firsts AS (SELECT *, min(place) OVER (PARTITION BY query_id, document_id) AS f FROM sup), cited AS (SELECT *, 'S' || dense_rank() OVER (PARTITION BY query_id ORDER BY f) AS id FROM firsts)
SELECT query_id, relationship_id, string_agg(id, ',' ORDER BY p) AS citation_ids FROM (SELECT query_id, relationship_id, id, min(place) AS p FROM cited GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def edge_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    best, _, edges, _ = top_paths(spark, sf_dir)
    supports = graph.path_supports(best.filter("rank = 1"), edges)
    rows = supports.select("query_id", "relationship_id", F.col("place").alias("position"), F.lit("graph").alias("source_id"), F.concat(F.lit("row "), "document_id").alias("display"), F.concat(F.lit("support "), "document_id").alias("content"))
    found = citations.edge_citations(citations.assign_citations(rows))
    return found.select("query_id", F.explode("citations").alias("relationship_id", "ids")).select("query_id", "relationship_id", F.array_join("ids", ",").alias("citation_ids"))


@query()
def compare_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    best, scored, edges, _ = top_paths(spark, sf_dir)
    wanted = scored.filter(F.size("path") == 1).groupBy("query_id").agg(F.max_by("nodes", F.struct("score", "path_id")).alias("nodes")).join(graph_questions(spark, sf_dir).select("query_id"), "query_id")
    return evaluation.compare_graph(best, wanted, graph.path_supports(best, edges))


@query(f"""WITH {RERANKED}, {EXPECTED}, runs AS (SELECT 'fused' AS strategy, t.query_id, t.document_id, d.source_id AS source, rank FROM top t JOIN docs_norm d USING (document_id) WHERE rank <= 5 UNION ALL SELECT 'reranked', query_id, document_id, source, final_rank FROM reranked),
graded AS (SELECT r.*, coalesce(grade, 0) AS g FROM runs r LEFT JOIN expected e ON e.query_id = r.query_id AND e.document_id = r.document_id),
best AS (SELECT query_id, sum((2 ** grade - 1) / log2(i + 1)) AS ideal FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, document_id) AS i FROM expected) WHERE i <= 5 GROUP BY 1),
one AS (SELECT strategy, query_id, sum((2 ** g - 1) / log2(rank + 1)) AS dcg, min(rank) FILTER (g > 0) AS first, count(DISTINCT source) FILTER (g > 0) AS sources FROM graded GROUP BY 1, 2)
SELECT strategy, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(coalesce(dcg / ideal, 0)), 6) AS ndcg, round(avg(sources), 6) AS sources FROM one LEFT JOIN best USING (query_id) GROUP BY 1""")
def compare_reranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = docs_norm(spark, sf_dir).select("document_id", F.col("source_id").alias("source"))
    plain = fused(spark, sf_dir).join(sources, "document_id").select(F.lit("fused").alias("strategy"), "query_id", "document_id", "source", "rank")
    again = reranked(spark, sf_dir).select(F.lit("reranked").alias("strategy"), "query_id", "document_id", "source", F.col("final_rank").alias("rank"))
    found = evaluation.compare_reranking(plain.unionByName(again), truth(spark, sf_dir))
    return found.select("strategy", *[F.round(c, 6).alias(c) for c in ("mrr", "ndcg", "sources")])


@query(f"""WITH {ROUTED}, w AS (SELECT query_id, intent, CASE WHEN query_id < 0 THEN intent ELSE 'default' END AS wanted, (abs(query_id) % 7 + 1) / 10.0::DOUBLE AS latency, (abs(query_id) % 11 + 3) / 10.0::DOUBLE AS default_latency FROM routed)
SELECT round(avg(CASE WHEN intent = wanted THEN 1 ELSE 0 END), 6) AS plan_accuracy, round(median(default_latency - latency) FILTER (intent <> 'default'), 6) AS median_saved, count(*) AS questions FROM w""")
def compare_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = spark.createDataFrame([("db",)], "source_id string")
    size = F.abs("query_id")
    found = routing.route(route_questions(spark, sf_dir), one).select("query_id", "intent", ((size % 7 + 1) / 10).alias("latency"), ((size % 11 + 3) / 10).alias("default_latency"))
    wanted = found.select("query_id", F.when(F.col("query_id") < 0, F.col("intent")).otherwise("default").alias("wanted"))
    out = evaluation.compare_routing(found, wanted)
    return out.select(F.round("plan_accuracy", 6).alias("plan_accuracy"), F.round("median_saved", 6).alias("median_saved"), "questions")


@query()
def graph_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, edges, entities = top_paths(spark, sf_dir)
    return graph.graph_manifest(entities, edges)



def overlap(pairs: list[tuple[str, str]]) -> list[float]:
    """A model of pairs of question and passage: the share of the question's distinct tokens that the passage has."""
    tokens = lambda text: set(retrieval.WORDS.findall(retrieval.folded(text)))
    return [len(a & tokens(p)) / len(a) if (a := tokens(q)) else 0.0 for q, p in pairs]


@query(f"WITH {RERANKED} SELECT query_id, document_id, score FROM pairs")
def score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of all questions, each pair scored by a model that is plugged in."""
    found = fused(spark, sf_dir, k=15).select("query_id", "document_id")
    pairs = found.join(questions(spark, sf_dir), "query_id").join(docs_norm(spark, sf_dir).select("document_id", F.col("content").alias("passage")), "document_id")
    return ranking.score_pairs(pairs, overlap).withColumn("score", F.round("score", 9))


@query("""SELECT sha256(string_agg(to_json({'case_id': item_id, 'intent': CASE WHEN item_id % 2 = 0 THEN 'lexical' ELSE 'default' END, 'question': text}), chr(10) ORDER BY item_id)) AS hash FROM benchmark""")
def benchmark_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    intent = F.when(F.col("item_id") % 2 == 0, "lexical").otherwise("default")
    return evaluation.benchmark_hash(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("question"), intent.alias("intent")))


def run_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cases, and what a run answered to them."""
    c = cut(cases(spark, sf_dir))
    return c, cut(observations(c, fused(spark, sf_dir)))


@query("""WITH q AS (SELECT count(*) AS n FROM benchmark) SELECT stamp AS report, n AS rows, 0 AS broken, true AS hidden FROM q, (VALUES ('20240101-base'), ('20240102-next')) t(stamp) UNION ALL SELECT '20240103-torn', 1, 1, false""")
def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reports written, a third with a torn line; all listed, and whether a sound report holds no answer's text."""
    root = fresh_folder(spark)
    _, seen = run_of(spark, sf_dir)
    for stamp, config in (("20240101", "base"), ("20240102", "next")):
        files.write_report(seen, {"benchmark": "b"}, root, stamp, config)
    spark.createDataFrame([('{"case_id": 1, "segm',)], "value string").coalesce(1).write.text(f"{root}/20240103-torn-000000000000")
    schema = "case_id long, benchmark string, segments array<struct<text: string, labels: array<string>>>"
    found = files.read_reports(spark, root, schema).withColumn("report", F.regexp_replace("report", "-[0-9a-f]{12}$", ""))
    texts = spark.read.schema(schema).option("recursiveFileLookup", "true").json(root).select(F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2), "-[0-9a-f]{12}$", "").alias("report"), F.forall("segments", lambda s: s["text"] == "[redacted]").alias("hidden"))
    hidden = texts.groupBy("report").agg(F.coalesce(F.bool_and("hidden"), F.lit(False)).alias("hidden"))
    return found.join(hidden, "report", "left").select("report", "rows", "broken", "hidden")


@query(f"""WITH RECURSIVE {EDGES} SELECT 'entity' AS part, entity_id AS id, canonical_name AS name, n_mentions AS n FROM entities UNION ALL SELECT 'relationship', relationship_id, predicate, n_supports FROM relationships""")
def graph_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph written as a snapshot and read again; an error if what is read is not what its manifest says."""
    root = f"{fresh_folder(spark)}/graph"
    entities, edges = graph_of(spark, sf_dir)
    files.write_graph(entities, edges, graph.graph_manifest(entities, edges), root)
    e, r, manifest = files.read_graph(spark, root)
    if graph.graph_manifest(e, r).first() != manifest.first():
        raise ValueError("the snapshot is not what its manifest says")
    nodes = e.select(F.lit("entity").alias("part"), F.col("entity_id").alias("id"), F.col("canonical_name").alias("name"), F.size("mentions").cast("long").alias("n"))
    return nodes.unionByName(r.select(F.lit("relationship").alias("part"), F.col("relationship_id").alias("id"), F.col("predicate").alias("name"), F.size("supports").cast("long").alias("n")))
