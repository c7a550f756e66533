"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is logistic in all its features: its words and the beginnings of its
words, hashed to ``WIDTH`` places. The document's score is the leaky noisy-or of its sentences' scores: at least one
offends, or the label came about otherwise (the leak, which also is the score of a text without sentences). Only document
labels are learned from: the gradient of the noisy-or tells which sentences a toxic label came from. Each weight is
shrunk by its own penalty, ``penalty`` standard errors of its gradient if labels had nothing to do with it; so few labels
give few and small weights, and no feature is chosen beforehand. Sentences with a score of at least one half are reported
as offending.

Null and empty texts have the leak as score. Rows of ``labels`` without a toxic value, or of unknown documents, are not
learned from; without labels of both kinds every score is 0. Repeated rows count as often as they occur. An empty table
gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import per_text
from lodestone.llm.langid import held_out

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
STEMS = (4, 5, 6, 7)
WIDTH = 1 << 20


def places(word: str) -> tuple[int, ...]:
    """The places of a lower-case word and of its beginnings."""
    return tuple(zlib.crc32(x.encode()) % WIDTH for x in (word, *(f"{word[:k]}~" for k in STEMS if len(word) > k)))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # by place
    bias: float
    leak: float

    def of_word(self, word: str) -> tuple[int, ...]:
        """The word's places that have a weight."""
        return tuple(p for p in places(word) if self.weights[p])


NOTHING = Model(np.zeros(WIDTH, np.float32), -30.0, 0.0)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def bag(text: str, most: int) -> bytes:
    """A document's sentences, each the sorted distinct places of its words and -1: those with the least hashes up to
    ``most`` numbers, so that very long texts are learned from all over their length."""
    sentences, total = [], 0
    for s in SENTENCE.findall(text.lower()):
        own = sorted({p for w in WORD.findall(s) for p in places(w)})
        if own:
            sentences.append(np.array([*own, -1], np.int32))
            total += len(own) + 1
    if total > most:
        sentences.sort(key=lambda a: zlib.crc32(a.tobytes()))
        sizes = np.cumsum([len(a) for a in sentences])
        sentences = sentences[: max(1, int(np.searchsorted(sizes, most, side="right")))]
    return np.concatenate(sentences)[: 4 * most].tobytes() if sentences else b""


def fit(bags: list[bytes], labels: list[int], prior: float | None = None, penalty: float = 4.0, dropped: float = 0.5, rounds: int = 200, rate: float = 0.1, seed: int = 3) -> Model:
    """Penalised leaky noisy-or likelihood of document labels by gradient steps (Adam). ``prior`` is the share of label 1
    that scores shall reflect, where it differs from that of the sample. The leak is held at a twentieth of it for the first
    half of the rounds, so that it explains only what sentences can't."""
    y = np.array(labels, float)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return NOTHING
    prior = share if prior is None else prior
    numbers = [np.frombuffer(b, np.int32) for b in bags]
    every = np.concatenate(numbers)
    bag_of = np.repeat(np.arange(len(bags), dtype=np.int32), [len(x) for x in numbers])
    del numbers
    mark = every >= 0
    sentence = (np.cumsum(~mark, dtype=np.int32) - ~mark)[mark]
    doc = bag_of[~mark]  # of each sentence
    known, feature = np.unique(every[mark], return_inverse=True)
    feature = feature.astype(np.int32)
    del every
    n_sent, n_doc, n = len(doc), len(bags), len(known)
    # What is seen in one document only tells nothing of others; what no toxic document holds is left to the bias.
    pairs = np.unique(feature.astype(np.int64) * n_doc + bag_of[mark])
    held = (np.bincount(pairs // n_doc, minlength=n) > 1) & (np.bincount(pairs // n_doc, y[pairs % n_doc], n) > 0)
    use = held[feature]
    number = np.cumsum(held, dtype=np.int32) - 1
    del pairs
    known, feature, sentence = known[held], number[feature[use]], sentence[use]
    n = len(known)
    if not n:
        return NOTHING
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share)) / n_doc
    # A feature's sentences side by side, and a sentence's features: sums over either are sums over runs.
    by_feature = np.argsort(feature, kind="stable")
    sentences_of, feature_at = sentence[by_feature], np.searchsorted(feature[by_feature], np.arange(n))
    filled, sentence_at = np.unique(sentence, return_index=True)
    # Standard errors of the gradient at zero weights, if labels came by chance.
    per_doc = np.maximum(np.bincount(doc, minlength=n_doc), 1)
    cells, of = np.unique(feature.astype(np.int64) * n_doc + doc[sentence], return_inverse=True)
    part = np.bincount(of) / per_doc[cells % n_doc]
    del of
    scale = np.sqrt(np.bincount(cells // n_doc, part**2, n) * np.mean(weight**2 * (y - prior) ** 2))
    theta = np.concatenate([np.zeros(n), [np.log(prior / per_doc.mean())], [np.log(prior / 20 / (1 - prior / 20))]])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    rng = np.random.default_rng(seed)
    for step in range(1, rounds + 1):
        # Each step goes without some of the features, so that those which occur together all have to carry weight.
        seen = rng.random(n) >= dropped
        z = np.full(n_sent, theta[n])
        z[filled] += np.add.reduceat((theta[:n] * seen)[feature], sentence_at)
        p = sigmoid(z)
        leak = sigmoid(theta[n + 1])
        none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), n_doc) + np.log1p(-leak)
        # Of the loss by log(1 - p_s): for label 0 it is -1, for label 1 the odds of no sentence.
        pull = np.where(y == 1, np.exp(none) / np.maximum(-np.expm1(none), 1e-9), -1.0) * weight
        of_z = -pull[doc] * p
        smooth = penalty * scale * theta[:n] / np.sqrt(theta[:n] ** 2 + 1e-4)
        grad = np.concatenate([(np.add.reduceat(of_z[sentences_of], feature_at) + smooth) * seen, [of_z.sum(), -(pull * leak).sum() * (2 * step > rounds)]])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta -= rate * (1 - step / (rounds + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    weights = np.zeros(WIDTH, np.float32)
    weights[known] = np.where(np.abs(theta[:n]) > 0.05, theta[:n], 0)
    return Model(weights, float(theta[n]), float(sigmoid(theta[n + 1])))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, most: int = 2500) -> Model:
    """Learns from about ``sample_rows`` labelled rows, chosen by a hash of doc_id, up to three eighths of them toxic, and of
    each from at most about ``most`` numbers (see :func:`bag`), which bounds what the driver holds to 4 * sample_rows * most
    bytes. Texts themselves never reach the driver."""
    known = labels.filter("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("label"))
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if not counts.get(1) or not counts.get(0):
        return NOTHING
    toxic = min(counts[1], sample_rows * 3 // 8)
    share = {1: toxic / counts[1], 0: min(1.0, (sample_rows - toxic) / counts[0])}
    limit = F.when(F.col("label") == 1, int(share[1] * 1_000_000)).otherwise(int(share[0] * 1_000_000))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < limit).limit(2 * sample_rows)  # bounded, so it can be broadcast
    in_bags = per_text(lambda texts: pa.array([bag(t or "", most) for t in texts], pa.binary()), "binary")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(in_bags(F.col("text")).alias("bag"), "label", "doc_id").limit(2 * sample_rows).collect()
    rows = sorted(((r[2], bytes(r[0]), r[1]) for r in rows if len(r[0])))
    return fit([r[1] for r in rows], [r[2] for r in rows], counts[1] / (counts[0] + counts[1]))


KIND = pa.struct([("score", pa.float64()), ("offending", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))])


def score(text: Column, model: Model, spark) -> Column:
    """struct<score, offending: array<struct<begin, end, score>>>; places are code points of the text."""
    shared = spark.sparkContext.broadcast(model)

    def run(texts: list[str | None]) -> pa.Array:
        model, known = shared.value, {}
        plain = float(sigmoid(model.bias))

        def found(word: str) -> tuple[int, ...]:
            if (hit := known.get(word)) is None:
                if len(known) > 300_000:
                    known.clear()
                hit = known[word] = model.of_word(word)
            return hit

        out = []
        for t in texts:
            t = t or ""
            hits = {w: f for w in set(WORD.findall(t)) if (f := found(w.lower()))}
            none, spans = np.log1p(-model.leak), []
            if not hits:
                none += len(SENTENCE.findall(t)) * np.log1p(-plain)
            for s in SENTENCE.finditer(t) if hits else ():
                own = {m for w in WORD.findall(s[0]) if w in hits for m in hits[w]}
                p = float(sigmoid(model.bias + sum(float(model.weights[m]) for m in sorted(own)))) if own else plain
                none += np.log1p(-min(p, 1 - 1e-9))
                if p >= 0.5:
                    spans.append({"begin": s.start(), "end": s.end(), "score": round(p, 6)})
            out.append({"score": min(1.0, max(0.0, round(float(-np.expm1(none)), 6))), "offending": spans})
        return pa.array(out, KIND)

    return per_text(run, "struct<score: double, offending: array<struct<begin: long, end: long, score: double>>>")(text)


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted, offending; labels of held-out rows are not learned from."""
    model = train(docs, labels.filter(~held_out(F.col("doc_id"))), sample_rows)
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model, docs.sparkSession).alias("r"))
    return found.select("doc_id", "held_out", F.col("r.score").alias("score"), (F.col("r.score") >= 0.5).cast("int").alias("predicted"), F.col("r.offending").alias("offending"))
