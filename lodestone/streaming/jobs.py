"""Structured Streaming jobs: safety on arrival, counters, rate windows, deliveries once, audit chains, ingestion."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import chunk_text, collapse_whitespace, injection_labels, redact
from lodestone.operators.governance import CHAIN, HEADS, append_audit_chain, chain_heads
from lodestone.operators.retrieval import embed_incremental
from lodestone.sources.generations import active, commits, publish


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream; new files of the table arrive as new rows."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parquet*")


def with_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a time zone."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def safety(rows: DataFrame, text: str = "text") -> DataFrame:
    """Stateless: labels of hidden instructions and the redacted text."""
    return rows.withColumn("labels", injection_labels(F.col(text))).withColumn(text, redact(F.col(text)))


def counts(events: DataFrame) -> DataFrame:
    """Counters by workspace and day, for update mode."""
    return events.groupBy("workspace_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def rate_windows(events: DataFrame, limit: int, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Counts of keys in fixed windows, and whether they went over their limit; rows later than the watermark are dropped. In append
    mode a window is written once the watermark has passed it, in update mode as soon as it has rows."""
    seen = with_time(events).withWatermark("ts", late)
    one = seen.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "key").agg(F.count("*").alias("n"))
    return one.select("key", F.col("w.start").alias("window_start"), "n", (F.col("n") > limit).alias("exceeded"))


def deliveries_once(deliveries: DataFrame, late: str = "1 hour") -> DataFrame:
    return with_time(deliveries).withWatermark("ts", late).dropDuplicatesWithinWatermark(["job", "step"])


@dataclass(frozen=True)
class AuditChain:
    """A stream of events (org_id, event_id, actor, action, metadata, created_at) that :func:`drain` links to chains."""

    events: DataFrame


def audit_chain(events: DataFrame) -> AuditChain:
    """Events linked to their org's chain as they arrive; what is kept of a chain is the last sequence and hash. Within a batch events
    are taken in order of event_id, which is no work for a group's function: a stream has no sort, and an org's events need not fit
    into memory. So each batch is sorted and linked as a table is."""
    return AuditChain(events)


def drain(stream: DataFrame | AuditChain, folder: str) -> DataFrame:
    """Runs an append stream over all files there are, into a Parquet table, and reads it."""
    if isinstance(stream, AuditChain):
        return drain_chain(stream.events, folder)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/table")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")


def drain_chain(events: DataFrame, folder: str) -> DataFrame:
    """:func:`drain` of an audit chain. Batches are written under their number and go on from the last links as of the batch before,
    which stay until the next batch is done: a repeated batch replaces itself by the same links."""
    spark, names = events.sparkSession, [c.split()[0] for c in CHAIN.split(", ")]

    def put(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        heads = session.read.schema(HEADS).parquet(f"{folder}/heads/{(number - 1) % 2}") if number else None
        append_audit_chain(batch, heads).write.mode("overwrite").parquet(f"{folder}/table/batch={number}")
        new = session.read.schema(CHAIN).parquet(f"{folder}/table/batch={number}").select("org_id", "sequence", "hash")
        chain_heads(new if heads is None else new.unionByName(heads)).write.mode("overwrite").parquet(f"{folder}/heads/{number % 2}")

    events.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    try:
        return spark.read.schema(CHAIN).parquet(f"{folder}/table").select(*names)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CHAIN)  # no batch has come


def drain_updates(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Runs an update stream over all files there are; the last value of each key counts. Batches are written under their
    id, so that a repeated batch replaces itself."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{folder}/table")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rest])


def ingest(documents: DataFrame, root: str, workspace: str, checkpoint: str, name: str = "ingest") -> None:
    """Parses, flags and chunks arriving documents (doc_id, source, text). Each batch adds its documents and chunks to what is
    active in the workspace, under the stream's ``name`` and its number: a batch that is run again adds nothing."""
    def put(batch: DataFrame, number: int) -> None:
        safe = safety(batch.select("doc_id", "source", "text")).withColumn("labels", F.array_join("labels", ","))
        chunks = safe.select("doc_id", "source", F.posexplode(chunk_text(collapse_whitespace("text"))).alias("part", "chunk"))
        publish({"documents": safe, "chunks": chunks}, root, workspace, f"{name}:{number}", "none", mode="append")

    documents.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def embed_arriving(texts: DataFrame, root: str, workspace: str, checkpoint: str, key: str, model: Callable[[list[str]], np.ndarray], name: str, stream: str = "embed") -> None:
    """Vectors of arriving texts (``key``, text), as table ``vectors`` (``key``, content_sha, model, embedding) of the workspace.
    Texts that the table has by key and content are not computed again, be it by a restarted job or another stream; a table of
    another model is an error before anything is computed."""
    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = commits(spark, root, workspace)
        done = active(spark, root, "vectors", workspace) if known else spark.createDataFrame([], f"`{key}` {dict(batch.dtypes)[key]}, content_sha string, model string")
        if known and known[-1].model != name:
            raise ValueError(f"vectors of {workspace} are of model {known[-1].model}")
        found = embed_incremental(batch.dropDuplicates([key, "text"]), done, key, "text", model, name)
        publish({"vectors": found}, root, workspace, f"{stream}:{number}", name, mode="append")

    texts.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
