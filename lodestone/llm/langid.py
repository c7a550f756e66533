"""Language identification with a string kernel.

Texts are compared by the presence of character n-grams of one to three characters (a blended spectrum, normalised).
A bounded sample of labelled texts gives Nyström landmarks; one-versus-rest kernel ridge regression learns a score per
language in the landmarks' feature space. n-grams are hashed to ``WIDTH`` bits of presence. Since a score is linear in a
text's kernel values, and those are linear in its presence vector, both products are folded into one matrix, and
batches of presence vectors are scored by one matrix product.

``lang_pred`` is ``und`` with score 0 if a text is null or has no letter. Rows without a lang, and null texts, are not
learned from. If nothing can be learned, all is ``und``. Repeated rows give repeated results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import per_text
from lodestone.llm.pretokens import LETTER, classes

WIDTH = 1 << 14
UNKNOWN = "und"


def presence(text: str) -> np.ndarray | None:
    """Hashed places of all n-grams that occur; None without a letter. Case and everything but letters are folded."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = classes()[points] == LETTER
    if not letter.any():
        return None
    a = np.where(letter, points, np.uint32(32)).astype(np.uint32)
    out = np.zeros(WIDTH, np.uint8)
    h = a * np.uint32(0x9E3779B1)
    out[h >> np.uint32(18)] = 1
    if len(a) > 1:
        h2 = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + a[1:] * np.uint32(0xC2B2AE3D)
        out[(h2 * np.uint32(0x27D4EB2F)) >> np.uint32(18)] = 1
        if len(a) > 2:
            h3 = (h2[:-1] ^ (h2[:-1] >> np.uint32(13))) * np.uint32(0x165667B1) + a[2:] * np.uint32(0x9E3779B1)
            out[(h3 * np.uint32(0x85EBCA77)) >> np.uint32(18)] = 1
    return out


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # WIDTH x languages
    bias: np.ndarray

    def score(self, bits: np.ndarray) -> np.ndarray:
        x = bits.astype(np.float32)
        return (x @ self.weights) / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1)) + self.bias


def fit(bits: np.ndarray, langs: list[str], landmarks: int = 256, ridge: float = 1e-2, seed: int = 7) -> Model:
    """Landmarks are spread over the languages; the labels' weights balance rare languages."""
    names = tuple(sorted(set(langs)))
    y = np.array([names.index(x) for x in langs])
    x = bits.astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    order = np.random.default_rng(seed).permutation(len(x))
    rank = np.zeros(len(x), np.int64)  # the how-manieth of its language
    seen = np.zeros(len(names), np.int64)
    for i in order:
        rank[i] = seen[y[i]]
        seen[y[i]] += 1
    chosen = np.lexsort((y, rank))[:landmarks]
    marks = x[chosen]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    phi = (x @ marks.T).astype(np.float64) @ whiten
    weight = (len(y) / (len(names) * np.bincount(y, minlength=len(names))))[y]
    target = np.eye(len(names))[y]
    mean_phi, mean_y = np.average(phi, axis=0, weights=weight), np.average(target, axis=0, weights=weight)
    centred = (phi - mean_phi) * weight[:, None]
    gram = centred.T @ (phi - mean_phi) + ridge * len(x) * np.eye(phi.shape[1]) * np.mean(np.diag(phi.T @ phi) / len(x))
    w = np.linalg.solve(gram, centred.T @ (target - mean_y))
    return Model(names, (marks.T.astype(np.float64) @ (whiten @ w)).astype(np.float32), (mean_y - mean_phi @ w).astype(np.float32))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows without an id are held out: they can't be told from others, so nothing is learned from them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def bits_of(text: Column) -> Column:
    """Packed presence bits of a text; null if it has no letter."""

    def run(texts: list[str | None]) -> pa.Array:
        found = [None if t is None else presence(t) for t in texts]
        return pa.array([None if f is None else np.packbits(f).tobytes() for f in found], pa.binary())

    return per_text(run, "binary")(text)


def train(docs: DataFrame, sample_rows: int = 3000, landmarks: int = 256, ridge: float = 1e-2) -> Model | None:
    """Learns from at most about ``sample_rows`` different texts with a letter of ``docs`` (text, lang), the same number
    from each language: those with the least hashes. A text counts once in its language, however many rows hold it."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("h"))
    counts = {r[0]: max(1, r[1]) for r in known.groupBy("lang").agg(F.approx_count_distinct("h", 0.02)).collect()}
    if not counts:
        return None
    want = math.ceil(sample_rows / len(counts))
    # Twice and some more than wanted pass the threshold, so that the least hashes of each language are among them.
    share = {k: min(1.0, (2 * want + 20) / n) for k, n in counts.items()}
    limit = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, int(v * 2**53))])
    some = known.filter(F.shiftrightunsigned("h", 11) <= limit[F.col("lang")]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    some = some.select("lang", "h", bits_of(F.col("text")).alias("bits"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("bits").isNull(), "h"))
    rows = some.select("bits", "lang", place.alias("place")).filter(F.col("place") <= want).collect()
    rows = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1], bytes(r[0])))
    if not rows:
        return None
    bits = np.unpackbits(np.frombuffer(b"".join(bytes(r[0]) for r in rows), np.uint8).reshape(len(rows), -1), axis=1)
    return fit(bits, [r[1] for r in rows], landmarks, ridge)


def predict(text: Column, model: Model | None, spark) -> Column:
    """struct<lang_pred, score> of a text column."""
    shared = spark.sparkContext.broadcast(model)

    def run(texts: list[str | None]) -> pa.Array:
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for a in range(0, len(texts), 64):
            found = [(i, p) for i, t in enumerate(texts[a : a + 64], a) if t and (p := presence(t)) is not None]
            if found and shared.value is not None:
                margin = shared.value.score(np.stack([p for _, p in found]))
                for (i, _), m in zip(found, margin, strict=True):
                    langs[i], scores[i] = shared.value.languages[int(m.argmax())], min(1.0, max(0.0, float(m.max())))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.round(scores, 6))], ["lang_pred", "score"])

    return per_text(run, "struct<lang_pred: string, score: double>")(text)


def identify(docs: DataFrame, sample_rows: int = 3000) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows of ``docs`` that are not held out."""
    model = train(docs.filter(~held_out(F.col("doc_id"))), sample_rows)
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text"), model, docs.sparkSession).alias("r"))
    return found.select("doc_id", "held_out", "r.*")
