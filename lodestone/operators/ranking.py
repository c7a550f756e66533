"""Fusion of ranked evidence by reciprocal ranks, and re-ranking with source diversity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import URL_NAMESPACE, tokenize, uuid5

# Weights and order of retrieval modes.
WEIGHTS = {"vector": 0.40, "sentence_window": 0.25, "graph": 0.25, "lexical": 0.10}


def fusion_candidates(by_mode: dict[str, DataFrame], k: int = 5, multiplier: int = 3, most: int = 20) -> DataFrame:
    """Evidence of at least two modes, each to its own depth, with a literal mode. Evidence names a document, or a path of the
    graph."""
    if len(by_mode) < 2:
        raise ValueError("fusion needs two modes")
    depth = min(most, k * multiplier)
    out = None
    for mode, found in by_mode.items():
        named = ["query_id", *[c for c in ("document_id", "path") if c in found.columns], "raw_score", "normalized_score", "rank"]
        part = found.filter(F.col("rank") <= depth).select(*named, F.lit(mode).alias("mode"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def canonical_key(candidates: DataFrame, workspace: str) -> DataFrame:
    """What makes candidates of different modes the same: the document, or the ordered relationships of a graph path."""
    path = F.array_join("path", ">") if "path" in candidates.columns else F.lit(None).cast("string")
    graph = F.concat(F.lit(f"{workspace}:graph:"), path)
    return candidates.withColumn("key", F.when(F.col("mode") == "graph", graph).otherwise(F.concat(F.lit(f"{workspace}:document:"), F.col("document_id"))))


def best_rank_per_mode(candidates: DataFrame) -> DataFrame:
    """One row of each (query, key, mode): that with the lowest rank."""
    rest = [c for c in candidates.columns if c not in ("query_id", "key", "mode")]
    one = candidates.groupBy("query_id", "key", "mode").agg(F.min_by(F.struct(*rest), F.struct("rank", "document_id")).alias("r"))
    return one.select("query_id", "key", "mode", "r.*")


def effective_weights(candidates: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """With a ``weight``: 1 for plain reciprocal ranks, else the mode's share among the query's active modes."""
    if weights is None:
        return candidates.withColumn("weight", F.lit(1.0))
    table = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])
    named = candidates.withColumn("w", F.coalesce(table[F.col("mode")], F.lit(0.0)))
    active = named.select("query_id", "mode", "w").distinct().groupBy("query_id").agg(F.sum("w").alias("total"))
    return named.join(active, "query_id").withColumn("weight", F.col("w") / F.col("total")).drop("w", "total")


def fuse(candidates: DataFrame, weights: dict[str, float] | None = None, rrf_k: int = 60, k: int = 5) -> DataFrame:
    """query_id, key, evidence_id, document_id, score, normalized_score, rank, contributions. Candidates have a key."""
    one = effective_weights(best_rank_per_mode(candidates), weights)
    one = one.withColumn("contribution", F.round(F.col("weight") / (rrf_k + F.col("rank")), 12))
    parts = F.array_sort(F.collect_list(F.struct("mode", "rank", "document_id", "raw_score", "normalized_score", "weight", "contribution")))
    first = F.min_by("document_id", F.struct((F.col("mode") != "sentence_window").cast("int"), "rank", "document_id"))
    fused = one.groupBy("query_id", "key").agg(F.round(F.sum("contribution"), 9).alias("score"), F.min("rank").alias("best_rank"), first.alias("document_id"), parts.alias("contributions"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "best_rank", "key")
    top = fused.filter("score > 0").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
    return top.withColumn("normalized_score", F.col("score") / F.max("score").over(Window.partitionBy("query_id"))).withColumn("evidence_id", uuid5(URL_NAMESPACE, F.col("key")))


def overlap_score(pairs: DataFrame) -> DataFrame:
    """pairs (question, passage, ...) with ``score``: the share of the question's distinct tokens that the passage has."""
    asked, has = F.array_distinct(tokenize(F.col("question"))), tokenize(F.col("passage"))
    return pairs.withColumn("score", F.coalesce(F.size(F.array_intersect(asked, has)) / F.size(asked), F.lit(0.0)))


def score_pairs(pairs: DataFrame, scorer: Callable[[list[tuple[str, str]]], list[float]], batch: int = 64) -> DataFrame:
    """pairs (query_id, document_id, question, passage) with a model's score each, in batches; not finite fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked, passages = b.column("question").to_pylist(), b.column("passage").to_pylist()
            scores: list[float] = []
            for i in range(0, len(asked), batch):
                part = [float(x) for x in scorer(list(zip(asked[i : i + batch], passages[i : i + batch], strict=True)))]
                if any(x != x or abs(x) == float("inf") for x in part):
                    raise ValueError("a score is not finite")
                scores += part
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("document_id"), pa.array(scores, pa.float64())], ["query_id", "document_id", "score"])

    return pairs.select("query_id", "document_id", "question", "passage").mapInArrow(run, "query_id long, document_id long, score double")


def rerank(scored: DataFrame, k: int = 5, per_source: int = 2) -> DataFrame:
    """Candidates (query_id, document_id, source, score, fused_rank, fused_score) in their final order.

    Order is by score, then fused rank. The first pass takes up to ``per_source`` of each source, the second fills up
    from the rest; both are one window, by whether a candidate is within its source's share. Scores are normalized
    over all candidates of a query, to 1 where all are equal.
    """
    query = Window.partitionBy("query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "fused_rank", "document_id")
    low, high = F.min("score").over(query), F.max("score").over(query)
    out = scored.withColumn("score", F.round("score", 9)).withColumn("score_rank", F.row_number().over(order).cast("long"))
    out = out.withColumn("normalized_score", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))
    share = F.row_number().over(Window.partitionBy("query_id", "source").orderBy("score_rank")) <= per_source
    final = Window.partitionBy("query_id").orderBy(F.desc("within"), "score_rank")
    out = out.withColumn("within", share).withColumn("final_rank", F.row_number().over(final).cast("long"))
    provenance = F.struct("fused_rank", "fused_score", F.col("score").alias("raw"), F.col("normalized_score").alias("normalized"), "final_rank")
    return out.filter(F.col("final_rank") <= k).withColumn("provenance", provenance)
