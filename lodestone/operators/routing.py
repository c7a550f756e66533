"""Routing of questions to retrieval plans by weighted patterns, as columns over a questions table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import collapse_whitespace

# Rule, intent, score and pattern on the lower-case question.
RULES = (
    ("sql_aggregate", "sql", 0.70, r"\b(total|sum|average|avg|count|how many|maximum|minimum|highest|lowest)\b"),
    ("sql_grouping", "sql", 0.60, r"\b(compare|group(?:ed)?|breakdown|trend)\b|\bby\s+\w+"),
    ("sql_filter", "sql", 0.65, r"\b(list|open|older than|newer than|before|after|between|where)\b"),
    ("sql_metric", "sql", 0.15, r"\b(revenue|sales|churn|tickets?|orders?|customers?|employees?|amount|price|cost)\b"),
    ("graph_relationship", "graph", 0.85, r"\b(owns?|manages?|reports? to|responsible for|depends? on|connected to|governs?|relationship between)\b"),
    ("graph_subject", "graph", 0.10, r"\b(who|which person|which team|which department)\b"),
    ("window_context", "sentence_window", 0.90, r"\b(surrounding (?:text|context|passage)|paragraph around|context around|before and after|nearby paragraph|explain the paragraph)\b"),
    ("lexical_exact", "lexical", 0.55, r"\b(exact|identifier|reference|policy number|ticket number|code)\b"),
)
IDENTIFIER, IDENTIFIER_SCORE = r"\b[A-Za-z]{2,}[\-_]\d{2,}[A-Za-z0-9\-_]*\b", 0.85
ACRONYM, ACRONYM_SCORE = r"\b[A-Z]{2,6}\b", 0.75
# The retrievers of each intent.
PLANS = {
    "sql": ("sql",),
    "graph": ("graph", "vector"),
    "sentence_window": ("sentence_window", "vector"),
    "lexical": ("lexical", "vector"),
    "default": ("vector", "sentence_window", "lexical"),
}


def match_rules(question: Column) -> Column:
    """array<struct<rule, intent, score, text>> in the order of the rules; the identifier rule, or else that of acronyms,
    looks at the question's own case."""
    flat = collapse_whitespace(question)

    def hit(rule: str, intent: str, score: float, pattern: str, text: Column, unless: str | None = None) -> Column:
        found = text.rlike("(?U)" + pattern)
        found = found if unless is None else found & ~text.rlike("(?U)" + unless)
        matched = F.regexp_extract(text, "(?U)" + pattern, 0)
        return F.when(found, F.struct(F.lit(rule).alias("rule"), F.lit(intent).alias("intent"), F.lit(score).alias("score"), matched.alias("text")))

    rules = [hit(*r, F.lower(flat)) for r in RULES]
    rules.append(hit("lexical_identifier", "lexical", IDENTIFIER_SCORE, IDENTIFIER, flat))
    rules.append(hit("lexical_acronym", "lexical", ACRONYM_SCORE, ACRONYM, flat, IDENTIFIER))
    return F.array_compact(F.array(*rules))


def score_intents(matches: Column) -> Column:
    """array<struct<minus, intent>> of intents that matched, best first: sums up to 1, added in the order of the rules."""

    def total(intent: str) -> Column:
        own = F.filter(matches, lambda m: m["intent"] == intent)
        summed = F.aggregate(own, F.lit(0.0), lambda a, m: F.least(F.lit(1.0), a + m["score"]))
        return F.when(F.size(own) > 0, F.struct((-summed).alias("minus"), F.lit(intent).alias("intent")))

    return F.array_sort(F.array_compact(F.array(*[total(i) for i in ("graph", "lexical", "sentence_window", "sql")])))


def route(questions: DataFrame, database: DataFrame | None = None, available: tuple[str, ...] = ("vector", "sentence_window", "lexical", "graph", "sql"), threshold: float = 0.70, margin: float = 0.15) -> DataFrame:
    """questions (query_id, question, ...) with matches, confidence, intent, retrievers, source and fallback reason.

    ``database`` (source_id, n) is the one row of :func:`select_database`; without a ready database an SQL question
    falls back to the default plan, as does any whose plan needs a retriever that is not available.
    """
    q = questions.withColumn("matches", match_rules(F.col("question"))).withColumn("ranked", score_intents(F.col("matches")))
    first, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    confidence, runner_up = F.coalesce(-first["minus"], F.lit(0.0)), F.coalesce(-second["minus"], F.lit(0.0))
    low, mixed = confidence < threshold, confidence - runner_up < margin
    q = q.withColumn("confidence", confidence).withColumn("reason", F.when(low, "confidence_below_threshold").when(mixed, "mixed_or_ambiguous_intent"))
    q = q.withColumn("intent", F.when(low | mixed, "default").otherwise(first["intent"]))
    if database is None:
        q = q.withColumn("database", F.lit(None).cast("string"))
    else:
        q = q.join(F.broadcast(database.select(F.col("source_id").alias("database"))), F.lit(True), "left")
    none = (F.col("intent") == "sql") & F.col("database").isNull()
    q = q.withColumn("reason", F.when(none, "no_ready_database_source").otherwise(F.col("reason"))).withColumn("intent", F.when(none, "default").otherwise(F.col("intent")))
    plans = F.create_map(*[x for k, v in PLANS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    missing = F.array_sort(F.array_except(plans[F.col("intent")], F.array(*map(F.lit, available))))
    q = q.withColumn("missing", missing)
    lacks = F.size("missing") > 0
    q = q.withColumn("reason", F.when(lacks, F.concat(F.lit("retriever_unavailable:"), F.array_join("missing", ","))).otherwise(F.col("reason"))).withColumn("intent", F.when(lacks, "default").otherwise(F.col("intent")))
    q = q.withColumn("retrievers", plans[F.col("intent")]).withColumn("database", F.when(F.col("intent") == "sql", F.col("database")))
    return q.drop("ranked", "missing")


def select_database(sources: DataFrame, requested: list[str] | None = None) -> DataFrame:
    """workspace_id, source_id of the one ready database in scope, by workspace; more than one fails the query."""
    ready = sources.filter("status = 'ready' AND source_type = 'database'")
    if requested:
        ready = ready.filter(F.col("source_id").isin(requested))
    one = ready.groupBy("workspace_id").agg(F.count("*").alias("n"), F.min("source_id").alias("source_id"))
    return one.withColumn("_one", F.assert_true(F.col("n") == 1, "automatic routing needs one database source")).filter(F.col("_one").isNull()).drop("_one", "n")


def retrieval_scope(registered: DataFrame, visible: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Registered sources that are visible, and requested where any are."""
    out = registered.join(visible, "source_id", "left_semi")
    return out if requested is None else out.join(requested, "source_id", "left_semi")
