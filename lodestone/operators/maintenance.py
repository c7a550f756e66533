"""Maintenance: lifecycles, publishing gates, inventories, reconciliation and checkpoints. Generations are in ``sources.generations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Where a source may go from each status.
TRANSITIONS = {"registered": ("indexing", "failed"), "indexing": ("ready", "failed"), "ready": ("failed",), "failed": ("indexing",)}


def invalid_transitions(log: DataFrame) -> DataFrame:
    """Rows of a status log (source_id, place, status) that may not follow the one before."""
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    before = F.lag("status").over(Window.partitionBy("source_id").orderBy("place"))
    rows = log.withColumn("before", before)
    first = F.col("before").isNull() & (F.col("status") != "registered")
    return rows.filter(first | (F.col("before").isNotNull() & ~F.coalesce(F.array_contains(allowed[F.col("before")], F.col("status")), F.lit(False))))


def publishable(operations: DataFrame, required: list[str]) -> DataFrame:
    """(operation, missing, ready): whether all required stores of an operation (operation, store) are prepared."""
    one = operations.groupBy("operation").agg(F.collect_set("store").alias("prepared"))
    return one.select("operation", F.array_sort(F.array_except(F.array(*map(F.lit, required)), "prepared")).alias("missing")).withColumn("ready", F.size("missing") == 0)


def inventory(documents: DataFrame, generations: DataFrame) -> DataFrame:
    """By workspace: sources, documents and active generations."""
    docs = documents.groupBy("workspace_id").agg(F.countDistinct("source_id").alias("sources"), F.count("*").alias("documents"))
    gens = generations.groupBy("workspace_id").agg(F.count("*").alias("generations"))
    return docs.join(gens, "workspace_id", "left").withColumn("generations", F.coalesce("generations", F.lit(0)))


def reconcile(left: DataFrame, right: DataFrame, key: str, content: list[str]) -> DataFrame:
    """(key, status) of what differs between two copies: missing on either side, or another checksum. Texts are hashed
    before the join, so only keys and hashes are sent."""
    sha = lambda df, name: df.select(key, F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in content]), 256).alias(name))
    both = sha(left, "l").join(sha(right, "r"), key, "full_outer")
    status = F.when(F.col("r").isNull(), "missing_right").when(F.col("l").isNull(), "missing_left").when(F.col("l") != F.col("r"), "differs")
    return both.select(key, status.alias("status")).filter("status is not null")


def resume(items: DataFrame, done: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What is left to do of items (key, checksum), and what is done under another checksum, which is an error."""
    left = items.join(done.select(key), key, "left_anti")
    conflict = items.alias("i").join(done.alias("d"), key).filter(F.col("i.checksum") != F.col("d.checksum")).select(key, F.col("i.checksum").alias("now"), F.col("d.checksum").alias("then"))
    return left, conflict


def idempotent_steps(deliveries: DataFrame) -> DataFrame:
    """One row of each (job, step), the first delivered."""
    return deliveries.groupBy("job", "step").agg(F.min_by(F.struct(*[c for c in deliveries.columns if c not in ("job", "step")]), "delivery").alias("r")).select("job", "step", "r.*")
