"""Queries over retrieval, fusion and re-ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.checkpoints import cut
from lodestone.functions.text import tokenize
from lodestone.operators import ranking, retrieval
from lodestone.plans.registry import query, table
from lodestone.plans.views import DOCS_NORM, QUESTIONS, docs_norm, questions

TOKENS = "regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+(?:[-_][\\p{{L}}\\p{{N}}]+)*')"
CONTENT, TITLE, ASKED = TOKENS.format("content"), TOKENS.format("title"), TOKENS.format("question")
POSTINGS = f"""{DOCS_NORM},
body AS (SELECT document_id, term, count(*) AS tf FROM (SELECT document_id, unnest({CONTENT}) AS term FROM docs_norm) GROUP BY 1, 2),
heads AS (SELECT document_id, term, count(*) AS title_tf FROM (SELECT document_id, unnest({TITLE}) AS term FROM docs_norm) GROUP BY 1, 2),
posts AS (SELECT document_id, term, coalesce(tf, 0) AS tf, coalesce(title_tf, 0) AS title_tf FROM body FULL JOIN heads USING (document_id, term)),
stats AS (SELECT document_id, greatest(len({CONTENT}), 1) AS length FROM docs_norm)"""
BM25 = f"""{POSTINGS}, {QUESTIONS},
terms AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({ASKED}) AS term FROM questions) GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY 1), corpus AS (SELECT count(*) AS n, avg(length) AS mean FROM stats),
scored AS (SELECT query_id, document_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf + 0.5 * title_tf) * 2.5 / ((tf + 0.5 * title_tf) + 1.5 * (0.25 + 0.75 * length / mean))), 9) AS raw_score
  FROM terms JOIN posts USING (term) JOIN dfs USING (term) JOIN stats USING (document_id), corpus GROUP BY 1, 2)"""
LEXICAL = f"""{BM25}, lex AS (SELECT *, raw_score / max(raw_score) OVER (PARTITION BY query_id) AS normalized_score FROM
  (SELECT query_id, document_id, raw_score, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, document_id) AS rank FROM scored WHERE raw_score > 0) WHERE rank <= 15)"""
HASHED = """{name}_n AS (SELECT key, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 64 AS dim, count(*) AS n FROM (SELECT {key} AS key, unnest({tokens}) AS term FROM {source}) GROUP BY 1, 2),
{name} AS (SELECT key, dim, n / sqrt(sum(n * n) OVER (PARTITION BY key)) AS weight FROM {name}_n)"""
DOC_VECTORS = HASHED.format(name="dv", key="document_id", tokens=CONTENT, source="docs_norm")
ASKED_VECTORS = HASHED.format(name="qv", key="query_id", tokens=ASKED, source="questions")
VECTOR = f"""{DOC_VECTORS}, {ASKED_VECTORS},
sims AS (SELECT q.key AS query_id, d.key AS document_id, round(sum(q.weight * d.weight), 6) AS raw_score FROM qv q JOIN dv d USING (dim) GROUP BY 1, 2),
vec AS (SELECT query_id, document_id, raw_score, (raw_score + 1) / 2 AS normalized_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, document_id) AS rank FROM sims) WHERE rank <= 15)"""
CANDIDATES = f"""{LEXICAL}, {VECTOR},
candidates AS (SELECT query_id, document_id, raw_score, normalized_score, rank, 'lexical' AS mode FROM lex UNION ALL SELECT query_id, document_id, raw_score, normalized_score, rank, 'vector' FROM vec)"""


def fused_sql(weight: str) -> str:
    return f"""{CANDIDATES}, parts AS (SELECT *, 'ws:document:' || document_id AS key, round({weight} / (60 + rank), 12) AS contribution FROM candidates),
fused AS (SELECT query_id, key, document_id, round(sum(contribution), 9) AS score, min(rank) AS best_rank, string_agg(mode || ':' || rank, ',' ORDER BY mode) AS contributions FROM parts GROUP BY 1, 2, 3),
top AS (SELECT *, score / max(score) OVER (PARTITION BY query_id) AS normalized_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, key) AS rank FROM fused WHERE score > 0) WHERE rank <= {{k}})"""


RRF, WEIGHTED = fused_sql("1.0"), fused_sql("(CASE mode WHEN 'lexical' THEN 0.1::DOUBLE ELSE 0.4::DOUBLE END / (0.1::DOUBLE + 0.4::DOUBLE))")
RERANKED = f"""{RRF.replace("{k}", "15")}, pairs AS (SELECT t.query_id, t.document_id, d.source_id AS source, t.rank AS fused_rank, t.score AS fused_score,
  round(coalesce(len(list_intersect(list_distinct({ASKED}), {CONTENT})) / len(list_distinct({ASKED})), 0), 9) AS score FROM top t JOIN questions q USING (query_id) JOIN docs_norm d USING (document_id)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_rank, document_id) AS score_rank,
  CASE WHEN min(score) OVER (PARTITION BY query_id) = max(score) OVER (PARTITION BY query_id) THEN 1.0 ELSE (score - min(score) OVER (PARTITION BY query_id)) / (max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id)) END AS normalized_score FROM pairs),
within AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score_rank) <= 2 AS inside FROM ordered),
reranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY inside DESC, score_rank) AS final_rank FROM within) WHERE final_rank <= 5)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one reading of all documents gives to lexical and vector retrieval for the questions."""
    return cut(retrieval.analysed(docs_norm(spark, sf_dir), retrieval.question_terms(questions(spark, sf_dir))))


def lexical(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    return retrieval.bm25_of(questions(spark, sf_dir), known or facts(spark, sf_dir)).drop("terms")


def doc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_norm(spark, sf_dir).select("document_id", retrieval.hashed_vector(F.col("content")).alias("embedding"))


def asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("query_id", retrieval.hashed_vector(F.col("question")).alias("embedding"))


def vector(spark: SparkSession, sf_dir: str, k: int = 15, known: DataFrame | None = None) -> DataFrame:
    own = doc_vectors(spark, sf_dir) if known is None else known.select("document_id", "embedding")
    return retrieval.retrieve_vector(retrieval.knn_exact(asked_vectors(spark, sf_dir), own, k))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = facts(spark, sf_dir)
    return ranking.fusion_candidates({"lexical": retrieval.retrieve_lexical(lexical(spark, sf_dir, known), 15), "vector": vector(spark, sf_dir, 15, known)})


def fused(spark: SparkSession, sf_dir: str, weights: dict[str, float] | None = None, k: int = 5) -> DataFrame:
    return ranking.fuse(ranking.canonical_key(candidates(spark, sf_dir), "ws"), weights, k=k)


def pool(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The candidates of all questions for re-ranking, and their documents."""
    top = cut(fused(spark, sf_dir, k=15).select("query_id", "document_id", F.col("rank").alias("fused_rank"), F.col("score").alias("fused_score")))
    return top, retrieval.held(docs_norm(spark, sf_dir), top)


def reranked(spark: SparkSession, sf_dir: str, of: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    top, docs = of or pool(spark, sf_dir)
    pairs = top.join(questions(spark, sf_dir), "query_id").join(docs.select("document_id", F.col("source_id").alias("source"), F.col("content").alias("passage")), "document_id")
    return ranking.rerank(ranking.overlap_score(pairs).drop("passage", "question"))


@query(f"WITH {DOCS_NORM} SELECT document_id, array_to_string({CONTENT}, ' ') AS tokens FROM docs_norm")
def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_norm(spark, sf_dir).select("document_id", F.array_join(tokenize(F.col("content")), " ").alias("tokens"))


@query(f"WITH {POSTINGS} SELECT document_id, term, tf, title_tf FROM posts")
def lexical_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.postings(docs_norm(spark, sf_dir))


@query(f"WITH {POSTINGS} SELECT document_id, length, count(*) OVER () AS corpus, round(avg(length) OVER (), 6) AS mean FROM stats")
def lexical_doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = retrieval.doc_stats(docs_norm(spark, sf_dir))
    return stats.join(F.broadcast(stats.agg(F.count("*").alias("corpus"), F.round(F.avg("length"), 6).alias("mean"))), F.lit(True))


@query(f"WITH {POSTINGS} SELECT term, count(*) AS df FROM posts GROUP BY term")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.document_frequency(retrieval.postings(docs_norm(spark, sf_dir)))


@query(f"WITH {BM25} SELECT query_id, document_id, raw_score FROM scored")
def bm25_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical(spark, sf_dir)


@query(f"""WITH {BM25}, own AS (SELECT query_id, document_id, raw_score, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, document_id) AS rank FROM scored
JOIN docs_norm USING (document_id) WHERE source_id IN ('src1', 'src2', 'src3', 'src4', 'src5') AND raw_score > 0)
SELECT query_id, document_id, rank, raw_score, round(raw_score / max(raw_score) OVER (PARTITION BY query_id), 6) AS normalized_score FROM own WHERE rank <= 5""")
def retrieve_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = docs_norm(spark, sf_dir).filter(F.col("source_id").isin("src1", "src2", "src3", "src4", "src5")).select("document_id")
    found = retrieval.retrieve_lexical(lexical(spark, sf_dir), 5, allowed)
    return found.select("query_id", "document_id", "rank", "raw_score", F.round("normalized_score", 6).alias("normalized_score"))


@query("SELECT count(*) AS vectors, count(*) FILTER (len(embedding) <> 64 OR NOT list_bool_and([isfinite(x) for x in embedding])) AS invalid FROM embeddings")
def validate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    bad = retrieval.invalid_vectors(vectors, 64).agg(F.count("*").alias("invalid"))
    return vectors.agg(F.count("*").alias("vectors")).join(F.broadcast(bad), F.lit(True))


UNIT = "[x::DOUBLE / sqrt(list_sum([y::DOUBLE * y::DOUBLE for y in embedding])) for x in embedding]"


@query(f"SELECT vec_id, array_to_string([CAST(round(x * 100000) AS BIGINT) for x in {UNIT}], ',') AS unit FROM embeddings")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = retrieval.l2_normalize(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(unit, lambda x: F.round(x * 100000).cast("long").cast("string")), ",").alias("unit"))


KNN = f"""u AS (SELECT vec_id, {UNIT} AS e, embedding FROM embeddings),
sims AS (SELECT q.vec_id AS query_id, d.vec_id AS document_id, round(list_dot_product(q.e, d.e), 6) AS raw_score FROM u q, u d WHERE q.vec_id % 20 = 0 {{where}}),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, document_id) AS rank FROM sims)"""


def asked_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def all_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), "embedding")


@query(f"WITH {KNN.replace('{where}', '')} SELECT query_id, document_id, raw_score, rank FROM near WHERE rank <= 10")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.knn_exact(asked_embeddings(spark, sf_dir), all_embeddings(spark, sf_dir), 10)


FILTERED = KNN.replace("{where}", "AND d.vec_id IN (SELECT doc_id FROM documents WHERE source IN ('src1', 'src2', 'src3'))")


@query(f"WITH {FILTERED} SELECT query_id, document_id, raw_score, rank FROM near WHERE rank <= 10")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").filter(F.col("source").isin("src1", "src2", "src3")).select(F.col("doc_id").alias("document_id"))
    return retrieval.knn_exact(asked_embeddings(spark, sf_dir), all_embeddings(spark, sf_dir).join(own, "document_id", "left_semi"), 10)


@query(f"WITH {KNN.replace('{where}', '')} SELECT query_id, document_id, rank, raw_score, round((raw_score + 1) / 2, 6) AS normalized_score FROM near WHERE rank <= 10 AND raw_score >= 0.2")
def retrieve_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.retrieve_vector(retrieval.knn_exact(asked_embeddings(spark, sf_dir), all_embeddings(spark, sf_dir), 10), 0.2)
    return found.withColumn("normalized_score", F.round("normalized_score", 6))


@query(f"WITH {DOCS_NORM}, {DOC_VECTORS} SELECT key AS document_id, dim, round(weight, 6) AS weight FROM dv")
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = doc_vectors(spark, sf_dir).select("document_id", F.posexplode("embedding").alias("dim", "weight"))
    return found.select("document_id", F.col("dim").cast("long").alias("dim"), F.round("weight", 6).alias("weight")).filter("weight > 0")


@query("""WITH l AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position FROM documents)
SELECT document_id, position, array_to_string(list(text) OVER w, ' ') AS "window", min(position) OVER w AS first, max(position) OVER w AS last FROM l WINDOW w AS (PARTITION BY document_id ORDER BY position ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def sentence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("position", "text"))
    lines = lines.withColumn("position", F.col("position").cast("long"))
    return retrieval.windows(lines).select("document_id", "position", "window", "first", "last")


@query()
def retrieve_sentence_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_norm(spark, sf_dir).select("document_id", "content")
    vectors = retrieval.sentences(docs).select("sentence_id", retrieval.hashed_vector(F.col("text")).alias("embedding"))
    return retrieval.retrieve_sentence_window(asked_vectors(spark, sf_dir), vectors, docs)


@query(f"WITH {CANDIDATES} SELECT query_id, document_id, mode, rank, raw_score, 'ws:document:' || document_id AS key FROM candidates")
def fusion_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.canonical_key(candidates(spark, sf_dir), "ws")
    return found.select("query_id", "document_id", "mode", "rank", "raw_score", "key")


@query(f"WITH {CANDIDATES} SELECT query_id, 'd' || document_id % 50 AS key, mode, min(rank) AS rank, arg_min(document_id, rank) AS document_id FROM candidates GROUP BY 1, 2, 3")
def best_rank_per_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = candidates(spark, sf_dir).withColumn("key", F.concat(F.lit("d"), F.col("document_id") % 50))
    return ranking.best_rank_per_mode(keyed).select("query_id", "key", "mode", "rank", "document_id")


FUSED_COLUMNS = "query_id, document_id, rank, round(score, 9) AS score, round(normalized_score, 6) AS normalized_score, contributions"


def fused_columns(found: DataFrame) -> DataFrame:
    parts = F.array_join(F.transform("contributions", lambda c: F.concat(c["mode"], F.lit(":"), c["rank"])), ",")
    return found.select("query_id", "document_id", "rank", "score", F.round("normalized_score", 6).alias("normalized_score"), parts.alias("contributions"))


@query(f"WITH {RRF.replace("{k}", "5")} SELECT {FUSED_COLUMNS} FROM top")
def fuse_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused_columns(fused(spark, sf_dir))


@query(f"WITH {WEIGHTED.replace("{k}", "5")} SELECT {FUSED_COLUMNS} FROM top")
def fuse_weighted_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused_columns(fused(spark, sf_dir, ranking.WEIGHTS))


@query(f"""WITH {RRF.replace("{k}", "5")}, h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(key)) AS d FROM top)
SELECT query_id, key, best_rank, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab', CAST((strpos('0123456789abcdef', substr(d, 17, 1)) - 1) % 4 + 1 AS BIGINT), 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS evidence_id FROM h""")
def fusion_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).select("query_id", "key", "best_rank", "evidence_id")


@query(f"WITH {RERANKED} SELECT query_id, document_id, source, fused_rank, score_rank, final_rank, score, round(normalized_score, 6) AS normalized_score, fused_score FROM reranked")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reranked(spark, sf_dir).select("query_id", "document_id", "source", "fused_rank", "score_rank", "final_rank", "score", F.round("normalized_score", 6).alias("normalized_score"), "fused_score")
