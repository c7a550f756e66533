"""Queries over routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import routing
from lodestone.plans.registry import query, table

# Questions that go to each plan.
ASKED = (
    "What is the total revenue by region?", "Which region has the highest churn?", "How many orders were placed this month?", "Who manages the payments team?",
    "Which team is responsible for billing?", "Show the surrounding text for the refund clause.", "Find policy HR-402 please", "What does SLA mean here?",
    "List open tickets older than thirty days", "Who owns the code reference?", "Explain the paragraph about renewals", "Tell me about onboarding",
)
TURNS = "SELECT conv_id * 1000 + turn AS query_id, text AS question FROM conversations WHERE role = 'user'"
ROUTE_QUESTIONS = f"rq AS ({TURNS} UNION ALL SELECT " + " UNION ALL SELECT ".join(f"-{i}, '{q}'" for i, q in enumerate(ASKED, 1)) + ")"


#: Unicode word boundaries, spelled out.
ACRONYM_SQL = "(^|[^\\p{L}\\p{N}_])([A-Z]{2,6})($|[^\\p{L}\\p{N}_])"


def _hit(rule: str, intent: str, score: float, pattern: str, text: str, unless: str = "") -> str:
    return f"SELECT query_id, '{rule}' AS rule, '{intent}' AS intent, {score}::DOUBLE AS score, regexp_extract({text}, '{pattern}') AS text FROM flat WHERE regexp_matches({text}, '{pattern}'){unless}"


FLAT = f"{ROUTE_QUESTIONS}, flat AS (SELECT query_id, trim(regexp_replace(question, '\\s+', ' ', 'g')) AS question FROM rq)"
MATCHES = f"{FLAT}, matches AS (" + " UNION ALL ".join(
    [_hit(*r, "lower(question)") for r in routing.RULES]
    + [_hit("lexical_identifier", "lexical", routing.IDENTIFIER_SCORE, routing.IDENTIFIER, "question")]
    + [_hit("lexical_acronym", "lexical", routing.ACRONYM_SCORE, ACRONYM_SQL, "question", f" AND NOT regexp_matches(question, '{routing.IDENTIFIER}')").replace(f"'{ACRONYM_SQL}') AS text", f"'{ACRONYM_SQL}', 2) AS text")]
) + ")"
ORDER = "CASE rule " + " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate([*[x[0] for x in routing.RULES], "lexical_identifier", "lexical_acronym"])) + " END"
#: Sums of doubles in the order of the rules, as the sequence of additions decides about margins.
SCORES = f"""{MATCHES}, ordered AS (SELECT query_id, intent, list(score ORDER BY {ORDER}) AS parts FROM matches GROUP BY 1, 2),
scores AS (SELECT query_id, intent, least(1.0::DOUBLE, parts[1] + coalesce(parts[2], 0::DOUBLE) + coalesce(parts[3], 0::DOUBLE) + coalesce(parts[4], 0::DOUBLE)) AS score FROM ordered),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, intent) AS nth FROM scores),
best AS (SELECT f.query_id, coalesce(a.score, 0) AS confidence, coalesce(b.score, 0) AS runner_up, a.intent AS winner FROM flat f LEFT JOIN ranked a ON f.query_id = a.query_id AND a.nth = 1 LEFT JOIN ranked b ON f.query_id = b.query_id AND b.nth = 2)"""
ROUTED = f"""{SCORES}, routed AS (SELECT query_id, confidence, CASE WHEN confidence < 0.70::DOUBLE THEN 'confidence_below_threshold' WHEN confidence - runner_up < 0.15::DOUBLE THEN 'mixed_or_ambiguous_intent' END AS reason,
CASE WHEN confidence < 0.70::DOUBLE OR confidence - runner_up < 0.15::DOUBLE THEN 'default' ELSE winner END AS intent FROM best)"""


def route_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question"))
    return turns.unionByName(spark.createDataFrame([(-i, q) for i, q in enumerate(ASKED, 1)], "query_id long, question string"))


@query(f"WITH {MATCHES} SELECT query_id, rule, intent, score, text FROM matches")
def match_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = route_questions(spark, sf_dir).select("query_id", F.explode(routing.match_rules(F.col("question"))).alias("m"))
    return found.select("query_id", "m.*")


@query(f"WITH {SCORES} SELECT query_id, intent, round(score, 6) AS score, nth AS place FROM ranked")
def score_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = route_questions(spark, sf_dir).select("query_id", F.posexplode(routing.score_intents(routing.match_rules(F.col("question")))).alias("p", "s"))
    return found.select("query_id", F.col("s.intent").alias("intent"), F.round(-F.col("s.minus"), 6).alias("score"), (F.col("p") + 1).cast("long").alias("place"))


@query(f"WITH {ROUTED} SELECT query_id, round(confidence, 6) AS confidence, intent, reason FROM routed")
def route_with_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = spark.createDataFrame([("db",)], "source_id string")
    return routing.route(route_questions(spark, sf_dir), one).select("query_id", F.round("confidence", 6).alias("confidence"), "intent", "reason")


@query(f"""WITH {ROUTED}, p AS (SELECT query_id, CASE WHEN intent = 'sql' THEN 'no_ready_database_source' WHEN intent = 'graph' THEN 'retriever_unavailable:graph' ELSE reason END AS reason, CASE WHEN intent IN ('sql', 'graph') THEN 'default' ELSE intent END AS intent FROM routed)
SELECT query_id, intent, reason, CASE intent WHEN 'lexical' THEN 'lexical,vector' WHEN 'sentence_window' THEN 'sentence_window,vector' ELSE 'vector,sentence_window,lexical' END AS retrievers FROM p""")
def select_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = routing.route(route_questions(spark, sf_dir), None, ("vector", "sentence_window", "lexical", "sql"))
    return found.select("query_id", "intent", "reason", F.array_join("retrievers", ",").alias("retrievers"))


REGISTRY = """registry AS (SELECT source AS source_id, lang AS workspace_id, CASE WHEN source = 'src4' THEN 'database' ELSE 'pdf' END AS source_type, CASE WHEN min(doc_id) % 5 = 0 THEN 'failed' ELSE 'ready' END AS status FROM documents GROUP BY 1, 2)"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("source_id"), F.col("lang").alias("workspace_id")).agg(F.min("doc_id").alias("first"))
    kind = F.when(F.col("source_id") == "src4", "database").otherwise("pdf")
    return found.select("source_id", "workspace_id", kind.alias("source_type"), F.when(F.col("first") % 5 == 0, "failed").otherwise("ready").alias("status"))


@query(f"WITH {REGISTRY} SELECT workspace_id, min(source_id) AS source_id FROM registry WHERE status = 'ready' AND source_type = 'database' GROUP BY 1")
def select_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.select_database(registry(spark, sf_dir))


@query(f"WITH {REGISTRY} SELECT doc_id, source FROM documents WHERE source IN (SELECT source_id FROM registry WHERE status = 'ready' AND workspace_id = 'en') AND source IN ('src1', 'src2', 'src3', 'src4', 'src6') AND source NOT IN ('src2')")
def retrieval_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = registry(spark, sf_dir).filter("status = 'ready' AND workspace_id = 'en'")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "source_id string")
    scope = routing.retrieval_scope(known, ids("src1", "src3", "src4", "src5", "src6"), ids("src1", "src2", "src3", "src4", "src6"))
    return table(spark, sf_dir, "documents").join(scope.select(F.col("source_id").alias("source")), "source", "left_semi").select("doc_id", "source")
