"""Generations of a workspace's representations, published by a log that only grows.

A commit is a file ``<number>.json`` in the workspace's log, made whole under another name and put in place only where no file of
that number is: of two publishers at once one finds the number taken. It names the parts of each representation with their row
counts and checksums; parts are never written again. A ``replace`` commit begins anew, an ``append`` commit adds to what there
is. What is active is the last ``replace`` and all that follows: a reader lists the log once and so sees the old or the new
state, whole. Workspaces have logs of their own.

A commit's key (a generation, or a batch of a stream) counts once: publishing it again changes nothing and returns the number it
had. Files of attempts that lost or broke off are never named by a commit, so never read.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "number long, key string, mode string, model string, parts array<struct<kind: string, path: string, row_count: long, checksum: string>>"


class PublishConflict(RuntimeError):
    """Another publisher has replaced the state that this one started from."""


@dataclass(frozen=True)
class Part:
    kind: str
    path: str
    row_count: int
    checksum: str


@dataclass(frozen=True)
class Commit:
    number: int
    key: str
    mode: str
    model: str
    parts: tuple[Part, ...]


def log_folder(root: str, workspace: str) -> str:
    return f"{root}/log/workspace_id={quote(workspace, safe='')}"


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Puts a file in place with its whole text if there is none; whether it did. A rename onto a file fails in the file systems
    of clusters; on a local disk it would replace, so a link is made there."""
    fs_classes = spark._jvm.org.apache.hadoop.fs
    target = fs_classes.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    draft = fs_classes.Path(target.getParent(), f".{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() != "file":
            return fs.rename(draft, target)
        os.link(draft.toUri().getPath(), target.toUri().getPath())
        return True
    except FileExistsError:
        return False
    finally:
        fs.delete(draft, False)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def commits(spark: SparkSession, root: str, workspace: str) -> list[Commit]:
    """The workspace's commits from the last ``replace`` on, in order. Each is a few hundred bytes; :func:`compact` makes one of
    many."""
    folder = log_folder(root, workspace)
    if not exists(spark, folder):
        return []
    log = spark.read.schema(RECORD).json(folder)
    base = log.agg(F.coalesce(F.max(F.when(F.col("mode") == "replace", F.col("number"))), F.lit(0)).alias("base"))
    rows = log.join(F.broadcast(base), F.col("number") >= F.col("base")).drop("base").collect()  # one row is broadcast
    return [Commit(r.number, r.key, r.mode, r.model, tuple(Part(*p) for p in r.parts)) for r in sorted(rows, key=lambda r: r.number)]


def committed(spark: SparkSession, root: str, workspace: str, key: str) -> int | None:
    """The number under which a key was committed, at any time."""
    folder = log_folder(root, workspace)
    if not exists(spark, folder):
        return None
    found = spark.read.schema(RECORD).json(folder).filter(F.col("key") == key).select("number").first()
    return None if found is None else found[0]


def checksum(df: DataFrame) -> DataFrame:
    """One row: count, and an order-free hash of all rows."""
    return df.agg(F.count("*").alias("row_count"), F.coalesce(F.sum(F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")).cast("string"), F.lit("0")).alias("checksum"))


def publish(representations: dict[str, DataFrame], root: str, workspace: str, key: str, model: str, mode: str = "replace") -> int:
    """Writes all representations, then commits them; the commit's number. An ``append`` that finds its number taken takes the
    next one; a ``replace`` raises :class:`PublishConflict`, since it was made without knowing what came in between."""
    spark = next(iter(representations.values())).sparkSession
    known = commits(spark, root, workspace)
    if (number := committed(spark, root, workspace, key)) is not None:
        return number
    parts = [written(spark, df, root, workspace, kind) for kind, df in representations.items()]
    return commit(spark, root, workspace, key, model, mode, parts, known[-1].number + 1 if known else 1)


def written(spark: SparkSession, df: DataFrame, root: str, workspace: str, kind: str) -> Part:
    """``df`` as a part that no commit names yet."""
    path = f"{root}/{kind}/workspace_id={quote(workspace, safe='')}/part={uuid.uuid4().hex}"
    df.write.parquet(path)
    return Part(kind, path, *checksum(spark.read.parquet(path)).first())


def commit(spark: SparkSession, root: str, workspace: str, key: str, model: str, mode: str, parts: list[Part], number: int) -> int:
    folder = spark._jvm.org.apache.hadoop.fs.Path(log_folder(root, workspace))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    while True:
        record = {"number": number, "key": key, "mode": mode, "model": model, "parts": [asdict(p) for p in parts]}
        if create_once(spark, f"{log_folder(root, workspace)}/{number:012d}.json", json.dumps(record)):
            return number
        if (other := committed(spark, root, workspace, key)) is not None:
            return other
        if mode == "replace":
            raise PublishConflict(f"commit {number} of {workspace} was made by another publisher")
        number += 1


def rewrite(spark: SparkSession, root: str, workspace: str, kind: str, kept: Callable[[DataFrame], DataFrame], key: str) -> tuple[int, int]:
    """A ``replace`` commit in which parts of ``kind`` hold only the rows that ``kept`` leaves of them: its number, and how many rows
    are gone. Parts that lose nothing are named again as they are; only the others are written anew. Readers of the old state
    keep its files."""
    found = commits(spark, root, workspace)
    if (number := committed(spark, root, workspace, key)) is not None:
        return number, 0
    if not found:
        raise LookupError(f"no active generation in {workspace}")
    parts, gone = [], 0
    for p in (p for c in found for p in c.parts):
        rest = kept(spark.read.parquet(p.path)) if p.kind == kind else None
        left = p.row_count if rest is None else rest.count()
        gone += p.row_count - left
        if left == p.row_count:
            parts.append(p)
        elif left:
            parts.append(written(spark, rest, root, workspace, kind))
    return commit(spark, root, workspace, key, found[-1].model, "replace", parts, found[-1].number + 1), gone


def active(spark: SparkSession, root: str, kind: str, workspace: str) -> DataFrame:
    """All active parts of a representation. An error if there is none, or if commits were made by different models."""
    found = commits(spark, root, workspace)
    paths = [p.path for c in found for p in c.parts if p.kind == kind]
    if not paths:
        raise LookupError(f"no active generation of {kind} in {workspace}")
    if len({c.model for c in found}) > 1:
        raise ValueError(f"active parts of {workspace} are of different models")
    return spark.read.parquet(*paths)


def verify(spark: SparkSession, root: str, workspace: str, model: str) -> DataFrame:
    """(number, kind, ok) of the active parts against their commits."""
    checks = None
    for c in commits(spark, root, workspace):
        for p in c.parts:
            now = checksum(spark.read.parquet(p.path))
            ok = (F.col("row_count") == p.row_count) & (F.col("checksum") == p.checksum) & F.lit(c.model == model)
            one = now.select(F.lit(c.number).cast("long").alias("number"), F.lit(p.kind).alias("kind"), ok.alias("ok"))
            checks = one if checks is None else checks.unionByName(one)
    if checks is None:
        raise LookupError(f"no active generation in {workspace}")
    return checks


def compact(spark: SparkSession, root: str, workspace: str, key: str) -> int:
    """One ``replace`` commit with all that is active."""
    found = commits(spark, root, workspace)
    kinds = dict.fromkeys(p.kind for c in found for p in c.parts)
    return publish({k: active(spark, root, k, workspace) for k in kinds}, root, workspace, key, found[-1].model)
