"""A table of questions answered under their plans: each retriever runs once, on the questions whose plan has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.checkpoints import cut
from lodestone.operators import ranking, routing
from lodestone.operators.structured import Governed, governed_query, rows_to_evidence

#: From questions (query_id, question) to evidence: query_id, document_id or path, raw_score, normalized_score, rank.
Retriever = Callable[[DataFrame], DataFrame]


def planned(questions: DataFrame, retrievers: dict[str, Retriever | None], database: DataFrame | None = None) -> DataFrame:
    """query_id, question, and the trace: intent, confidence, reason, retrievers, database. ``retrievers`` that are None are set up
    but have nothing to read: a plan with the graph among them falls back to the default plan."""
    routed = routing.route(questions, database, tuple(retrievers))
    lost = F.lit("graph" in retrievers and retrievers["graph"] is None) & (F.col("intent") == "graph")
    default = F.array(*map(F.lit, routing.PLANS["default"]))
    return routed.select(
        "query_id", "question", F.when(lost, "default").otherwise(F.col("intent")).alias("intent"), "confidence", F.when(lost, "graph_index_unavailable").otherwise(F.col("reason")).alias("reason"),
        F.when(lost, default).otherwise(F.col("retrievers")).alias("retrievers"), "database",
    )


def answer_batch(questions: DataFrame, retrievers: dict[str, Retriever | None], database: DataFrame | None = None, k: int = 5, workspace: str = "ws") -> DataFrame:
    """query_id, intent, confidence, reason, retrievers; rank, key, document_id, score of its evidence. Each question has the evidence
    of its own plan: rows of the database as they come, of all other plans the k best by reciprocal ranks over the plan's
    retrievers. A question without evidence has one row, with nulls."""
    plans = cut(planned(questions, retrievers, database))
    found = {}
    for mode, retrieve in retrievers.items():
        if retrieve is not None:
            found[mode] = retrieve(plans.filter(F.array_contains("retrievers", mode)).select("query_id", "question"))
    rows = found.pop("sql", None)
    fused = ranking.fuse(ranking.canonical_key(ranking.fusion_candidates(found, k), workspace), k=k)
    evidence = fused.select("query_id", "rank", "key", "document_id", "score")
    if rows is not None:
        own = F.concat(F.lit(f"{workspace}:row:"), F.col("content"))
        evidence = evidence.unionByName(rows.filter(F.col("rank") <= k).select("query_id", "rank", own.alias("key"), F.lit(None).cast("long").alias("document_id"), F.col("raw_score").alias("score")))
    return plans.drop("question", "database").join(evidence, "query_id", "left")


def database_retriever(own: Governed, statements: dict[str, tuple[str, list[str]]], most_rows: int = 20) -> Retriever:
    """Questions that match a pattern get the first rows of its statement, in the order of the given columns. A statement runs
    once, however many questions match; its rows, at most ``most_rows``, are small enough to be sent to all tasks."""

    def retrieve(asked: DataFrame) -> DataFrame:
        out = None
        for pattern, (statement, order) in statements.items():
            rows = rows_to_evidence(governed_query(own, statement), order, most_rows)
            numbered = asked.sparkSession.createDataFrame([(i, r.content, r.raw_score) for i, r in enumerate(rows.collect(), 1)], "rank long, content string, raw_score double")
            part = asked.filter(F.lower("question").rlike(pattern)).select("query_id").join(F.broadcast(numbered), F.lit(True))
            out = part if out is None else out.unionByName(part)
        return out.withColumn("normalized_score", F.col("raw_score"))

    return retrieve
