"""Retrieval over a questions table and a corpus table: lexical, vector and sentence-window evidence.

Evidence has query_id, document_id, raw_score, normalized_score and rank. Scores are rounded before they order anything,
so that the order of summation cannot decide ties; ties go to the smaller document id.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.checkpoints import cut
from lodestone.functions.text import folded, split_sentences, tokenize

DIGITS = 9
#: Tokens of folded text, as ``tokenize`` finds them.
WORDS = re.compile(r"[^\W_]+(?:[-_][^\W_]+)*")
#: A sentence's id is its document's, times this, plus its place.
PLACES = 1 << 22


def tokens(docs: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(document_id, length, term, in_body) for each token of documents (document_id, title, content); only terms of ``asked``
    (term), where it is given, get as far as the first exchange. ``length`` counts body tokens, 1 at least."""
    body, title = tokenize(F.col("content")), tokenize(F.coalesce("title", F.lit("")))
    mark = lambda flag: lambda t: F.struct(t.alias("term"), F.lit(flag).alias("in_body"))
    both = F.concat(F.transform(F.coalesce("body", F.array().cast("array<string>")), mark(True)), F.transform(title, mark(False)))
    rows = docs.select("document_id", "title", body.alias("body")).select("document_id", F.greatest(F.size("body"), F.lit(1)).cast("long").alias("length"), F.explode(both).alias("t")).select("document_id", "length", "t.*")
    return rows if asked is None else rows.join(asked, "term", "left_semi")


def counted(rows: DataFrame) -> DataFrame:
    """(document_id, term, length, tf, title_tf) of :func:`tokens`, by one grouping."""
    return rows.groupBy("document_id", "term").agg(F.max("length").alias("length"), F.count_if("in_body").alias("tf"), F.count_if(~F.col("in_body")).alias("title_tf"))


def postings(docs: DataFrame) -> DataFrame:
    """(document_id, term, tf, title_tf) of documents (document_id, title, content)."""
    return counted(tokens(docs)).drop("length")


def doc_stats(docs: DataFrame) -> DataFrame:
    """(document_id, length): body tokens, at least 1."""
    return docs.select("document_id", F.greatest(F.size(tokenize(F.col("content"))), F.lit(1)).cast("long").alias("length"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def question_terms(questions: DataFrame) -> DataFrame:
    """(query_id, term, times)."""
    return questions.select("query_id", F.explode(tokenize(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


#: What one reading of a document gives to all that retrieve.
ANALYSED = pa.struct([("length", pa.int64()), ("posts", pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64()), ("title_tf", pa.int64())]))), ("embedding", pa.list_(pa.float64()))])
BUCKETS = 64


@cache
def bucket(token: str) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % BUCKETS


def analysed(docs: DataFrame, asked: DataFrame | None = None, most_terms: int = 1_000_000) -> DataFrame:
    """(document_id, length, posts, embedding) of documents (document_id, title, content): each text is folded and cut into tokens
    once, for its length, its counted terms and its hashed vector. Of the terms only those of ``asked`` (term) leave the scan, if
    they are at most ``most_terms``: a set of that size is sent to the tasks; otherwise all leave it."""
    wanted = None
    if asked is not None:
        found = [r[0] for r in asked.select("term").distinct().limit(most_terms + 1).collect()]
        wanted = frozenset(found) if len(found) <= most_terms else None
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def one(title: str | None, content: str | None) -> dict[str, object]:
        body, head = Counter(WORDS.findall(folded(content or ""))), Counter(WORDS.findall(folded(title or "")))
        if bucket.cache_info().currsize > 500_000:
            bucket.cache_clear()
        vector = np.zeros(BUCKETS)
        for t, n in body.items():
            vector[bucket(t)] += n
        terms = {**body, **head}.keys() if shared.value is None else shared.value & ({**body, **head}.keys() if head else body.keys())
        posts = [{"term": t, "tf": body[t], "title_tf": head[t]} for t in terms]
        return {"length": max(1, body.total()), "posts": posts, "embedding": vector / max(np.sqrt((vector**2).sum()), 1e-300)}

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for titles, contents in batches:
            yield pa.array([one(t, c) for t, c in zip(titles.to_pylist(), contents.to_pylist(), strict=True)], ANALYSED)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    facts = F.arrow_udf(run, "struct<length: long, posts: array<struct<term: string, tf: long, title_tf: long>>, embedding: array<double>>")(F.col("title"), F.col("content"))
    return docs.select("document_id", facts.alias("a")).select("document_id", "a.*")


def bm25(questions: DataFrame, docs: DataFrame, k1: float = 1.5, b: float = 0.75, boost: float = 0.5) -> DataFrame:
    """:func:`bm25_of` documents (document_id, title, content) that nothing else has analysed."""
    return bm25_of(questions, cut(analysed(docs, question_terms(questions)).drop("embedding")), k1, b, boost)


def bm25_of(questions: DataFrame, facts: DataFrame, k1: float = 1.5, b: float = 0.75, boost: float = 0.5) -> DataFrame:
    """(query_id, document_id, raw_score, terms) for every pair that shares a term, and how many different ones; question terms
    count as often as they occur. ``facts`` come from :func:`analysed`; lengths are averaged over all of them."""
    terms = question_terms(questions)
    corpus = facts.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))  # one row
    asked = facts.select("document_id", "length", F.inline("posts")).join(terms.select("term").distinct(), "term", "left_semi")
    df = document_frequency(asked)
    w = F.col("tf") + boost * F.col("title_tf")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = F.col("times") * idf * w * (k1 + 1) / (w + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    pairs = asked.join(df.join(terms, "term"), "term").join(F.broadcast(corpus), F.lit(True))
    return pairs.groupBy("query_id", "document_id").agg(F.round(F.sum(score), DIGITS).alias("raw_score"), F.count("*").alias("terms"))


def held(docs: DataFrame, ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The documents of ``ids`` (document_id), as files of their own. Up to ``most`` ids are sent to the scan, so that only their
    documents leave it; more are joined."""
    few = cut(ids.select("document_id").distinct())
    return cut(docs.join(F.broadcast(few) if few.count() <= most else few, "document_id", "left_semi"))


def containing(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, document_id) for every document whose content holds the question as it is. All tokens but the first and
    the last stand in such a document as they are; documents with all of them are compared. Questions need three tokens."""
    all_ = tokenize(F.col("question"))
    inner = questions.select("query_id", F.array_distinct(F.slice(all_, 2, F.greatest(F.size(all_) - 2, F.lit(0)))).alias("inner")).filter(F.size("inner") > 0)
    terms = inner.select("query_id", F.size("inner").alias("wanted"), F.explode("inner").alias("term"))
    held = counted(tokens(docs, terms.select("term").distinct())).filter("tf > 0")
    found = held.join(terms, "term").groupBy("query_id", "document_id", "wanted").count().filter("count = wanted").select("query_id", "document_id")
    both = found.join(docs.select("document_id", "content"), "document_id").join(questions.select("query_id", "question"), "query_id")
    return both.filter(F.contains("content", F.col("question"))).select("query_id", "document_id")


def top_k(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("raw_score"), "document_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def retrieve_lexical(scored: DataFrame, k: int = 5, allowed: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """The best documents of each question by :func:`bm25`, from the ``allowed`` documents (document_id) only;
    normalized by each question's best score."""
    if allowed is not None:
        scored = scored.join(allowed, "document_id", "left_semi")
    best = top_k(scored.filter((F.col("raw_score") > 0) & (F.col("raw_score") >= least)), k)
    return best.withColumn("normalized_score", F.col("raw_score") / F.max("raw_score").over(Window.partitionBy("query_id")))


def hashed_vector(text: Column, size: int = 64) -> Column:
    """array<double>: a text's token counts by hash bucket, of unit length (all 0 without a token). The default model of
    :func:`embed`; within a batch each different token is hashed once, and counts are one pass over the tokens."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            lists = lists.fill_null([])
            coded = lists.flatten().dictionary_encode()
            of = np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % size for t in coded.dictionary.to_pylist()], np.int64)
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            cells = row * size + of[coded.indices.to_numpy()] if len(row) else row
            counts = np.bincount(cells, minlength=len(lists) * size).reshape(-1, size).astype(float)
            unit = counts / np.maximum(np.sqrt((counts**2).sum(axis=1, keepdims=True)), 1e-300)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * size, pa.int32()), pa.array(unit.ravel()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<double>")(tokenize(text))


def hashed_model(texts: list[str]) -> np.ndarray:
    """The vectors of :func:`hashed_vector` as a model for :func:`embed`: tokens of folded text, counted by hash bucket."""
    out = np.zeros((len(texts), 64))
    for row, text in zip(out, texts, strict=True):
        for token, n in Counter(WORDS.findall(folded(text))).items():
            row[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % 64] += n
    return out / np.maximum(np.sqrt((out**2).sum(axis=1, keepdims=True)), 1e-300)


def embed(texts: DataFrame, key: str, text: str, model: Callable[[list[str]], np.ndarray], prefix: str = "", batch: int = 256) -> DataFrame:
    """(key, embedding) by a model that maps a list of texts to a matrix; texts reach it in batches."""
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                rows = np.asarray(model([prefix + (t or "") for t in part.column("text").to_pylist()]), float)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(rows.tolist(), pa.list_(pa.float64()))], [key, "embedding"])

    return texts.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, embedding array<double>")


def embed_incremental(texts: DataFrame, done: DataFrame, key: str, text: str, model: Callable[[list[str]], np.ndarray], name: str) -> DataFrame:
    """(key, content_sha, model, embedding) of the texts that ``done`` has not, by key and content; ``done`` of another
    model fails the query. A key may have several contents."""
    if done.filter(F.col("model") != name).limit(1).count():
        raise ValueError("checkpoint belongs to another model")
    keyed = texts.select(F.struct(F.col(key), F.sha2(F.coalesce(text, F.lit("")), 256).alias("content_sha")).alias("own"), F.col(text).alias("text"))
    known = done.select(F.struct(F.col(key), "content_sha").alias("own"))
    found = embed(keyed.join(known, "own", "left_anti"), "own", "text", model)
    return found.select("own.*", F.lit(name).alias("model"), "embedding")


def invalid_vectors(vectors: DataFrame, size: int) -> DataFrame:
    """Rows whose vector is null, of another size or not finite."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(e.isNull() | (F.size(e) != size) | ~finite)


def l2_normalize(embedding: Column) -> Column:
    """The unit vector; null for a vector of norm zero."""
    wide = F.transform(embedding, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    # Within a lambda the norm would be computed for each element: bound as an element itself, it is computed once.
    return F.get(F.transform(F.array(norm), lambda n: F.when(n > 0, F.transform(wide, lambda x: x / n))), F.lit(0))


def knn_exact(queries: DataFrame, vectors: DataFrame, k: int, query_bytes: int = 64 << 20, digits: int = 6) -> DataFrame:
    """(query_id, document_id, raw_score, rank): the inner product of unit vectors over all of ``vectors``.

    Queries (query_id, embedding) reach the tasks in sets of at most about ``query_bytes``, which bounds what is broadcast;
    each scan of the vectors (document_id, embedding) serves a whole set, block by block. A task keeps its best k for each
    query until its end, and a window keeps the best of all tasks. All vectors have one size; those without a length, or with
    a null, are left out."""
    spark = queries.sparkSession
    asked, corpus = queries.select("query_id", "embedding").filter("embedding is not null"), vectors.select("document_id", "embedding").filter("embedding is not null")
    schema = "query_id long, document_id long, raw_score double"
    total = asked.agg(F.coalesce(F.sum(F.size("embedding") + 1), F.lit(0)) * 8).first()[0]
    sets = max(1, -(-total // query_bytes))
    found = None
    for i in range(sets):
        own = (asked if sets == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(sets)) == i)).toArrow()
        ids, q = unit_rows(own.column("query_id").to_numpy(), own.column("embedding").combine_chunks())
        part = top_k(corpus.mapInArrow(nearest_in_task(spark.sparkContext.broadcast((ids, q)), k, digits), schema), k)
        found = part if found is None else found.unionByName(part)
    return found


def unit_rows(ids: np.ndarray, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of one size as the rows of a matrix, of unit length, and their ids; those without a length are left out."""
    sizes = np.unique(np.diff(lists.offsets.to_numpy()))
    if len(sizes) > 1:
        raise ValueError("vectors differ in size")
    rows = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), int(sizes[0]) if len(sizes) else 0)
    norms = np.sqrt((rows**2).sum(axis=1))
    real = np.isfinite(norms) & (norms > 0)
    return ids[real], rows[real] / norms[real, None]


def keep_best(best: np.ndarray, docs: np.ndarray, new: np.ndarray, own: np.ndarray) -> None:
    """Puts those of ``new`` (scores of all rows with the documents ``own``) into ``best`` and ``docs`` that are among a row's best
    k, the smaller document first where scores are equal. Only what reaches a row's k-th best so far is sorted, and where that
    is much, as in the first block, only what reaches the block's own k-th best."""
    k, floor = best.shape[1], best[:, -1:]
    reached = new >= floor
    if new.shape[1] > k and np.count_nonzero(reached) > 4 * k * len(new):
        reached = new >= np.maximum(floor, np.partition(new, -k, axis=1)[:, -k:][:, :1])
    row, column = np.nonzero(reached)
    if not len(row):
        return
    touched = np.unique(row)
    rows = np.concatenate([np.repeat(touched, k), row])
    scores = np.concatenate([best[touched].ravel(), new[row, column]])
    names = np.concatenate([docs[touched].ravel(), own[column]])
    order = np.lexsort((names, -scores, rows))
    first = order[np.searchsorted(rows[order], touched)[:, None] + np.arange(k)]
    best[touched], docs[touched] = scores[first], names[first]


def nearest_in_task(shared: Broadcast, k: int, digits: int, block: int = 2048) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        best = np.full((len(ids), k), -np.inf)  # scores and documents of the best so far, the smaller document first
        docs = np.full((len(ids), k), 2**63 - 1, np.int64)
        for b in batches:
            own_docs, d = unit_rows(b.column("document_id").to_numpy(zero_copy_only=False), b.column("embedding"))
            for at in range(0, len(own_docs) if len(ids) else 0, block):
                for low in range(0, len(ids), block):
                    rows = slice(low, low + block)
                    new = np.round(q[rows] @ d[at : at + block].T, digits)
                    keep_best(best[rows], docs[rows], new, own_docs[at : at + block])
        real = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)[real.ravel()]), pa.array(docs[real]), pa.array(best[real])], ["query_id", "document_id", "raw_score"])

    return nearest


def retrieve_vector(neighbours: DataFrame, least: float = -1.0) -> DataFrame:
    """Scores clamped to [-1, 1], those below ``least`` left out, normalized to [0, 1]."""
    clamped = neighbours.withColumn("raw_score", F.least(F.greatest("raw_score", F.lit(-1.0)), F.lit(1.0)))
    return clamped.filter(F.col("raw_score") >= least).withColumn("normalized_score", (F.col("raw_score") + 1) / 2)


def windows(sentences: DataFrame, radius: int = 2) -> DataFrame:
    """Sentences (document_id, position, text, ...) with the text from ``radius`` before to ``radius`` after."""
    frame = Window.partitionBy("document_id").orderBy("position").rowsBetween(-radius, radius)
    return sentences.withColumn("window", F.array_join(F.collect_list("text").over(frame), " ")).withColumn("first", F.min("position").over(frame)).withColumn("last", F.max("position").over(frame))


def lines(text: Column) -> Column:
    """array<struct<text>>: the lines of a text, where these stand for sentences."""
    return F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("text")))


def sentences(docs: DataFrame) -> DataFrame:
    """(sentence_id, document_id, position, text, begin, end) of documents (document_id, content)."""
    found = docs.select("document_id", F.posexplode(split_sentences(F.col("content"))).alias("position", "s"))
    return found.select((F.col("document_id") * PLACES + F.col("position")).alias("sentence_id"), "document_id", F.col("position").cast("long").alias("position"), F.col("s.text").alias("text"), F.col("s.begin").alias("begin"), F.col("s.end").alias("end"))


def sentence_windows(docs: DataFrame, radius: int = 2) -> DataFrame:
    """Sentence windows of documents (document_id, content)."""
    return windows(sentences(docs).drop("sentence_id"), radius)


def retrieve_sentence_window(queries: DataFrame, vectors: DataFrame, docs: DataFrame, k: int = 5, least: float = -1.0, radius: int = 2, split: Callable[[Column], Column] = split_sentences) -> DataFrame:
    """The best k windows of each query: 5k nearest sentences, those below ``least`` left out, each replaced by its
    window, one of each (document, window), in order of similarity. ``vectors`` (sentence_id, embedding) are those of
    :func:`sentences` of ``docs`` (document_id, content), or of the parts that ``split`` gives; windows are made for the hits
    only."""
    near = knn_exact(queries, vectors.select(F.col("sentence_id").alias("document_id"), "embedding"), 5 * k).filter(F.col("raw_score") >= least)
    hits = near.select("query_id", "raw_score", F.col("document_id").alias("sentence_id"), F.col("rank").alias("sentence_rank"), F.floor(F.col("document_id") / PLACES).alias("document_id"), (F.col("document_id") % PLACES).alias("position"))
    held = docs.join(hits.select("document_id").distinct(), "document_id", "left_semi").select("document_id", F.transform(split(F.col("content")), lambda s: s["text"]).alias("texts"))
    placed = hits.join(held, "document_id").withColumn("first", F.greatest(F.col("position") - radius, F.lit(0))).withColumn("last", F.least(F.col("position") + radius, F.size("texts") - 1).cast("long"))
    window = F.array_join(F.slice("texts", (F.col("first") + 1).cast("int"), (F.col("last") - F.col("first") + 1).cast("int")), " ")
    same = Window.partitionBy("query_id", "document_id", "first", "last").orderBy("sentence_rank")
    one = placed.withColumn("window", window).drop("texts").withColumn("nth", F.row_number().over(same)).filter("nth = 1")
    order = Window.partitionBy("query_id").orderBy("sentence_rank")
    best = one.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
    return best.select("query_id", "document_id", "sentence_id", "raw_score", ((F.col("raw_score") + 1) / 2).alias("normalized_score"), "rank", "first", "last", "window")
