"""What the operators of this subpackage share: reading, stable chunks, lineage cuts and Arrow helpers."""

from __future__ import annotations

import ctypes
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from lodestone.checkpoints import cut, shared_folder  # noqa: F401 - cut is part of what operators share
from lodestone.plans.registry import spread

#: Larger than every doc_id: stands for a null doc_id where documents are put in order.
LAST_DOC = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is stored; documents in few splits are dealt to all cores."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name == "documents" else found


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def per_text(fn: Callable[[list[str | None]], pa.Array], returns: DataType | str) -> Callable[[Column], Column]:
    """A column function from whole texts (None stays None) to one value each, in Arrow batches."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield fn(texts.to_pylist())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returns)


#: What a Python worker keeps between tasks: of one operator at a time, since workers live longer than stages.
STATE: dict[object, object] = {}


def worker_state(key: object, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept in this worker until another operator needs room."""
    if key not in STATE:
        release_worker_state()
        STATE[key] = make()
    return STATE[key]


def release_worker_state() -> None:
    """Also hands back what Arrow, and where it can be asked the C library, keep of earlier batches."""
    STATE.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items whose sizes add up to about ``most``; a larger item stands alone."""
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def summed(rows: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray], few: int = 256) -> np.ndarray:
    """The sum over all tasks of what ``part`` makes of a task's Arrow batches: an array of doubles of one size. Arrays are
    added up in groups until at most ``few`` are left for the driver, in order of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int64()), "sums": pa.array([part(batches).astype(np.float64).tobytes()], pa.binary())})

    def add(found: list[tuple[int, bytes]]) -> bytes:
        return np.sum([np.frombuffer(x, np.float64) for _, x in sorted(found)], axis=0).tobytes()

    def group(t: pa.Table) -> pa.Table:
        found = list(zip(t["at"].to_pylist(), t["sums"].to_pylist(), strict=True))
        return pa.table({"at": pa.array([min(found)[0]], pa.int64()), "sums": pa.array([add(found)], pa.binary())})

    out, left = rows.mapInArrow(run, "at long, sums binary"), rows.rdd.getNumPartitions()
    while left > few:
        left = math.isqrt(left) + 1
        out = out.groupBy(F.pmod("at", F.lit(left))).applyInArrow(group, "at long, sums binary")
    found = [(r[0], bytes(r[1])) for r in out.collect()]
    return np.frombuffer(add(found), np.float64)


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """A column of arrays of one length as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind, copy=False) if len(flat) else np.zeros((0, 0), kind)
