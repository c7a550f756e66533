"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries become whole numbers x = floor(256 * c). The covariance V belongs to the fit list: each distinct x vector once. It
is never formed: a pass over the fit list gives V Q for a block Q of vectors, centred before multiplying, as a sum of what
each task has. A cycle puts Q through a Chebyshev polynomial in V that stays small on [0, least Ritz value] and grows fast
above, makes the columns orthonormal (QR) and solves the small problem Q'VQ (Rayleigh-Ritz). Cycles go on until residuals
certify the components: each is small against the distance of its eigenvalue from the next, or as small as double precision
allows. If that does not come about, the block grows; a block of all dimensions is solved by Rayleigh-Ritz at once.

Rows are left out whose vector is null, empty, or holds null or non-finite entries, or has another length than most (of
lengths that are equally common, the least counts). Entries beyond the range of long stop at its ends. Repeated rows and
null ids stay; the fit list takes equal vectors once. Components with no variance (fewer distinct vectors than dimensions, for
one) have null for ``whitened``; so has all where there is one distinct vector, and ``identity_error`` is null. A ``deviation``
beyond long is null. Of equal eigenvalues any orthonormal vectors may be found. An empty table gives an empty table; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import matrix, stored, summed

LONG = 2**63 - 1


def whole_numbers(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows with a sound vector, which becomes ``array<long>``."""
    sound = F.forall(F.col(vector).cast("array<double>"), lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    return rows.filter((F.size(vector) > 0) & sound).withColumn(vector, F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(F.lit(256.0) * c)))


@dataclass(frozen=True)
class Moments:
    """Of the fit list, exact."""

    n: int
    sums: tuple[int, ...]
    squares: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])

    @property
    def trace(self) -> float:
        """Of the covariance."""
        return float(Fraction(self.n * self.squares - sum(s * s for s in self.sums), self.n * self.n))


def moments(fit: DataFrame, d: int) -> Moments:
    """``fit`` has one column, arrays of ``d`` whole numbers. Tasks add up in integers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, [0] * d, 0
        for b in batches:
            x = matrix(b.column(0), np.int64)
            if not len(x):
                continue
            most = max(-int(x.min()), int(x.max()))
            wide = x if most * most * x.size < LONG else x.astype(object)
            n, squares = n + len(x), squares + int((wide * wide).sum())
            sums = [a + int(s) for a, s in zip(sums, wide.sum(axis=0), strict=True)]
        if n:
            values = [n, *sums, squares]
            # In two parts, since a sum of squares may have more digits than a decimal.
            high, low = zip(*(divmod(v, 10**18) for v in values), strict=True)
            yield pa.RecordBatch.from_pydict({"place": pa.array(range(d + 2), pa.int32()), "high": pa.array(map(str, high), pa.string()), "low": pa.array(map(str, low), pa.string())})

    parts = fit.mapInArrow(run, "place int, high string, low string").groupBy("place")
    found = {r[0]: int(r[1]) * 10**18 + int(r[2]) for r in parts.agg(*[F.sum(F.col(c).cast("decimal(38,0)")) for c in ("high", "low")]).collect()}
    return Moments(found.get(0, 0), tuple(found.get(i + 1, 0) for i in range(d)), found.get(d + 1, 0))


def covariance_times(fit: DataFrame, mean: np.ndarray, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """Q -> V Q by one pass over the fit list."""

    def times(q: np.ndarray) -> np.ndarray:
        shared = fit.sparkSession.sparkContext.broadcast((mean, q))

        def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            mean, q = shared.value
            out = np.zeros(q.shape)
            for b in batches:
                if b.num_rows:
                    c = matrix(b.column(0)) - mean
                    out += c.T @ (c @ q)
            return out.ravel()

        out = summed(fit, part).reshape(q.shape) / n
        shared.destroy()
        return out

    return times


def filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, high: float, top: float, degree: int) -> np.ndarray:
    """Columns of Q through the Chebyshev polynomial of a degree, small on [0, high] and about 1 at ``top``."""
    half = high / 2
    first = rate = half / (top - half)
    before, now = q, (vq - half * q) * (rate / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - rate)
        before, now = now, (times(now) - half * now) * (2 * following / half) - rate * following * before
        rate = following
    return now


def eigenvectors(times: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, block: int = 40, most_degree: int = 10, cycles: int = 40, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, unit eigenvectors as columns, and their residuals."""
    m, rng = min(d, max(block, 2 * wanted)), np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((d, m)))[0]
    eps, last, idle, cycle = np.finfo(float).eps, np.inf, 0, 0
    while True:
        vq = times(q)
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        residuals = np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0)
        top = max(values[0], 0.0)
        gaps = np.array([min([abs(values[j] - v) for i, v in enumerate(values[: wanted + 1]) if i != j], default=top) for j in range(wanted)])
        idle = 0 if residuals.max() < last / 2 else idle + 1
        last = min(last, residuals.max())
        # Certified: small against the gaps; or at the limit of double precision, where another cycle gains nothing.
        if m == d or top == 0 or (residuals <= np.maximum(1e-13 * gaps, 2 * eps * top)).all() or (idle >= 2 and residuals.max() <= 1e-12 * top):
            break
        cycle += 1
        if cycle % cycles == 0:
            m = min(d, 2 * m)
            q = np.linalg.qr(np.hstack([q, rng.standard_normal((d, m - q.shape[1]))]))[0]
            continue
        high = max(values[m - 1], d * eps * top)
        # A degree at which the first wanted component does not drown the last one.
        spread = np.arccosh(max(1.0, 2 * top / high - 1)) - np.arccosh(max(1.0, 2 * values[wanted - 1] / high - 1))
        degree = int(np.clip(16 / max(spread, 1e-3), 2, most_degree))
        q = filtered(times, q, vq, high, top, degree)
        q = np.linalg.qr(q / np.maximum(np.linalg.norm(q, axis=0), np.finfo(float).tiny))[0]
    vectors = q[:, :wanted]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(wanted)])
    return values[:wanted], vectors * np.where(sign == 0, 1, sign), residuals


@dataclass(frozen=True)
class Whitening:
    moments: Moments
    values: np.ndarray
    vectors: np.ndarray  # dimensions x components
    residuals: np.ndarray
    identity_error: float | None

    @property
    def sound(self) -> np.ndarray:
        """Which components have variance."""
        return self.values > 16 * len(self.vectors) * np.finfo(float).eps * max(self.values[0], 0.0)

    @property
    def factors(self) -> np.ndarray:
        return self.vectors / np.sqrt(np.where(self.sound, self.values, np.inf))


def fit(rows: DataFrame, vector: str = "embedding", components: int = 4, block: int = 40) -> Whitening | None:
    """None if no row has a sound vector. ``rows`` come from :func:`whole_numbers`."""
    lengths = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return None
    d = lengths[0]
    listed = stored(rows.filter(F.size(vector) == d).select(vector).distinct())
    found = moments(listed, d)
    values, vectors, residuals = eigenvectors(covariance_times(listed, found.mean, found.n), d, min(components, d), block)
    model = Whitening(found, values, vectors, residuals, None)
    return Whitening(found, values, vectors, residuals, identity_error(listed, model))


def identity_error(listed: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, of components with variance."""
    good = np.flatnonzero(model.sound)
    if not len(good):
        return None
    shared = listed.sparkSession.sparkContext.broadcast((model.moments.mean, model.factors[:, good]))

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        mean, factors = shared.value
        k = factors.shape[1]
        sums, squares = np.zeros(k), np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                w = (matrix(b.column(0)) - mean) @ factors
                sums, squares = sums + w.sum(axis=0), squares + w.T @ w
        return np.concatenate([sums, squares.ravel()])

    total = summed(listed, part) / model.moments.n
    k = len(good)
    return float(np.abs(total[k:].reshape(k, k) - np.outer(total[:k], total[:k]) - np.eye(k)).max())


RESULT = pa.list_(pa.struct([("component", pa.int32()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64())]))


def projected(x: Column, model: Whitening, spark) -> Column:
    """array<struct<component, deviation, whitened, explained>> of a vector of whole numbers."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        n, sums, k = model.moments.n, model.moments.sums, len(model.values)
        mean, factors, sound = model.moments.mean, model.factors, model.sound
        explained = model.values / model.moments.trace if model.moments.trace else np.zeros(k)
        for column in batches:
            a = matrix(column, np.int64)
            rows = len(column)
            if not rows:
                yield pa.array([], RESULT)
                continue
            most = n * max(-int(a.min()), int(a.max())) + max(map(abs, sums))
            kind = np.int64 if most * most * a.shape[1] < LONG else object
            off = n * a.astype(kind) - np.array(sums, kind)
            deviation = [int(v) if v <= LONG else None for v in (off * off).sum(axis=1)]
            white = (a - mean) @ factors
            items = pa.StructArray.from_arrays(
                [
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array([v for v in deviation for _ in range(k)], pa.int64()),
                    pa.array(white.ravel(), pa.float64(), mask=np.tile(~sound, rows)),
                    pa.array(np.tile(explained, rows), pa.float64()),
                ],
                fields=list(RESULT.value_type),
            )
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, (rows + 1) * k, k, dtype=np.int32)), items)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<struct<component: int, deviation: long, whitened: double, explained: double>>")(x)


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """The key, component, n, deviation, whitened, explained and identity_error: a row for each sound row and component."""
    sound = whole_numbers(rows.select(key, vector), vector)
    model = fit(sound, vector, components)
    spark = rows.sparkSession
    if model is None:
        kind = rows.select(key).schema[0].dataType.simpleString()
        return spark.createDataFrame([], f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    found = sound.filter(F.size(vector) == len(model.vectors)).select(key, F.inline(projected(F.col(vector), model, spark)))
    return found.select(key, "component", F.lit(model.moments.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(model.identity_error).cast("double").alias("identity_error"))
