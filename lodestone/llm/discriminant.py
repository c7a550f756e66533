"""Document quality by regularised quadratic discriminant analysis.

A text becomes a few statistics: its length, and shares (of symbols, capitals, repeated words and the like) as empirical log
odds, in which a class is about normal and a share of few words counts as uncertain. Each class has a mean and a covariance;
the covariance is shrunk towards a multiple of the identity by the intensity that Ledoit and Wolf's formula gives for it. All
of these are sums over all labelled rows, taken where the rows are; no row reaches the driver. A text's score is the posterior
probability of class 1 from the difference of log densities, whose Mahalanobis distances are products with the inverses of
Cholesky factors, computed once and kept in the model.

Null and empty texts have statistics of nothing and are scored as any other text. Rows of ``labels`` without a quality of 0 or
1, or of unknown documents, are not learned from; nor are rows without doc_id, which count as held out. Repeated rows count
as often as they occur. Without labels of both kinds every score is the share of label 1, each kind counted once more. An
empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import matrix, per_text, stored, summed
from lodestone.llm.langid import held_out

#: Kinds of bytes.
SPACE, DIGIT, UPPER, LOWER, WIDE, STOP, CALL, SYMBOL = range(8)


def kind_of(byte: int) -> int:
    c = chr(byte)
    if byte <= 32:
        return SPACE
    if byte >= 128:
        return WIDE
    if c.isdigit():
        return DIGIT
    if c.isalpha():
        return UPPER if c.isupper() else LOWER
    return CALL if c == "!" else STOP if c in ".,;:'\"()-?" else SYMBOL


KINDS = bytes(kind_of(b) for b in range(256))
STATISTICS = ("words", "word_bytes", "symbols", "calls", "stops", "digits", "capitals", "known_words", "stutter", "known_pairs", "equal_lines", "lines")


def odds(part: float, whole: float) -> float:
    return float(np.log(part + 0.5) - np.log(max(whole - part, 0) + 0.5))


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), len(raw)
    kinds = np.bincount(np.frombuffer(raw.translate(KINDS), np.uint8), minlength=8).tolist()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = ids[:-1] * max(1, len(number)) + ids[1:]
    stutter = int((ids[1:] == ids[:-1]).sum())
    after = max(n - 1, 0)
    return [
        float(np.log1p(n)),
        float(np.log1p(size) - np.log1p(n)),
        odds(kinds[SYMBOL], size),
        odds(kinds[CALL], size),
        odds(kinds[STOP], size),
        odds(kinds[DIGIT], size),
        odds(kinds[UPPER], kinds[UPPER] + kinds[LOWER] + kinds[WIDE]),
        odds(n - len(number), n),
        odds(stutter, after),
        odds(after - len(np.unique(pairs)), after),
        odds(len(lines) - len(Counter(lines)), len(lines)),
        odds(len(lines), n),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text, as a table in the shared folder: texts are read once."""
    of = per_text(lambda texts: pa.array([statistics(t) for t in texts], pa.list_(pa.float64())), "array<double>")
    return stored(docs.select("doc_id", of(F.col("text")).alias("x")))


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray  # class x statistic
    factors: np.ndarray  # class: inverse of the Cholesky factor
    prior: float  # log odds of class 1
    shrinkage: tuple[float, float]
    both: bool = True

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Of class 1, for rows of statistics."""
        if not self.both:
            return np.full(len(x), self.prior)
        z = (x - self.centre) / self.scale
        density = [-0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) + np.log(np.diag(f)).sum() for m, f in zip(self.means, self.factors, strict=True)]
        return density[1] - density[0] + self.prior


def shrunk(covariance: np.ndarray, fourth: float, n: float) -> tuple[np.ndarray, float]:
    """A covariance between itself and a multiple of the identity; ``fourth`` is the sum of fourth powers of the rows' norms."""
    p = len(covariance)
    target = np.trace(covariance) / p * np.eye(p)
    distance = ((covariance - target) ** 2).sum()
    noise = max(0.0, fourth / n**2 - (covariance**2).sum() / n)
    share = min(1.0, noise / distance) if distance > 0 else 1.0
    # Never singular: statistics that do not vary in a class keep a little of the common variance of 1.
    return (1 - share) * covariance + share * target + 1e-4 * np.eye(p), share


def fit(labelled: DataFrame, p: int = len(STATISTICS)) -> Model:
    """From rows (x, label) by two passes of sums."""

    def rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return matrix(batch.column("x")), batch.column("label").to_numpy(zero_copy_only=False)

    def first(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((2, 1 + 2 * p))
        for b in batches:
            if b.num_rows:
                x, y = rows(b)
                for k in (0, 1):
                    out[k] += np.concatenate([[(y == k).sum()], x[y == k].sum(axis=0), (x[y == k] ** 2).sum(axis=0)])
        return out.ravel()

    sums = summed(labelled, first).reshape(2, -1)
    n = sums[:, 0]
    if not n.min():
        return Model(np.zeros(p), np.ones(p), np.zeros((2, p)), np.zeros((2, p, p)), float(np.log((n[1] + 1) / (n[0] + 1))), (1.0, 1.0), False)
    centre = sums[:, 1 : p + 1].sum(axis=0) / n.sum()
    scale = np.sqrt(np.maximum(sums[:, p + 1 :].sum(axis=0) / n.sum() - centre**2, 1e-12))
    means = (sums[:, 1 : p + 1] / n[:, None] - centre) / scale
    shared = labelled.sparkSession.sparkContext.broadcast((centre, scale, means))

    def second(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        centre, scale, means = shared.value
        out = np.zeros((2, p * p + 1))
        for b in batches:
            if b.num_rows:
                x, y = rows(b)
                for k in (0, 1):
                    c = (x[y == k] - centre) / scale - means[k]
                    out[k] += np.concatenate([(c.T @ c).ravel(), [((c**2).sum(axis=1) ** 2).sum()]])
        return out.ravel()

    sums = summed(labelled, second).reshape(2, -1)
    found = [shrunk(sums[k, :-1].reshape(p, p) / n[k], sums[k, -1], n[k]) for k in (0, 1)]
    factors = np.stack([np.linalg.inv(np.linalg.cholesky(c)) for c, _ in found])
    return Model(centre, scale, means, factors, float(np.log(n[1] / n[0])), (found[0][1], found[1][1]))


def train(known: DataFrame, labels: DataFrame) -> Model:
    """``known`` comes from :func:`with_statistics`."""
    wanted = labels.filter("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("label"))
    return fit(stored(known.join(wanted, "doc_id").select("x", "label")))


def log_odds(x: Column, model: Model, spark) -> Column:
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(shared.value.log_odds(matrix(column)) if len(column) else [], pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(x)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, log_odds; labels of held-out rows are not learned from."""
    known = with_statistics(docs)
    model = train(known, labels.filter(~held_out(F.col("doc_id"))))
    found = known.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), log_odds(F.col("x"), model, docs.sparkSession).alias("log_odds"))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("log_odds")))
    return found.select("doc_id", "held_out", score.alias("score"), (score >= threshold).cast("int").alias("predicted"), "log_odds")
