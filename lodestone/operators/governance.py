"""Governance: clearance, audit chains, retention, counters and rate windows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.checkpoints import cut
from lodestone.sources import generations

# Labels in order of clearance, the first link of a chain, the least days that audit events stay.
LABELS = ("public", "internal", "confidential", "restricted")
GENESIS, AUDIT_FLOOR_DAYS = "genesis", 30


def label_rank(label: Column) -> Column:
    table = F.create_map(*[x for i, name in enumerate(LABELS) for x in (F.lit(name), F.lit(i))])
    return table[label]


def visible(rows: DataFrame, clearance: str, label: str = "classification") -> DataFrame:
    """Rows whose label is at or below a clearance; rows with an unknown label are hidden."""
    return rows.filter(label_rank(F.col(label)) <= LABELS.index(clearance))


def effective_clearance(role: Column, clearance: Column) -> Column:
    return F.when(role.isin("owner", "admin"), "restricted").otherwise(F.coalesce(clearance, F.lit("public")))


def canonical(org: str, sequence: int, actor: str | None, action: str, metadata: str | None, created: str, before: str) -> str:
    """The JSON that is hashed: sorted keys, no spaces, ASCII only."""
    event = {
        "org_id": org, "sequence": sequence, "workspace_id": None, "actor_user_id": actor, "action": action, "target_type": None, "target_id": None, "ip": None,
        "metadata": json.loads(metadata) if metadata else {}, "created_at": created, "prev_hash": before,
    }
    return json.dumps(event, sort_keys=True, separators=(",", ":"))


def link(org: str, sequence: int, actor: str | None, action: str, metadata: str | None, created: str, before: str) -> str:
    return hashlib.sha256(canonical(org, sequence, actor, action, metadata, created, before).encode()).hexdigest()


CHAIN = "org_id string, sequence long, actor string, action string, metadata string, created_at string, prev_hash string, hash string"
HEADS = "org_id string, sequence long, hash string"


def append_audit_chain(events: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Events (org_id, event_id, actor, action, metadata, created_at) with sequence, prev_hash and hash, by org in order of
    event_id; where ``heads`` (:func:`chain_heads`) has an org's last link, its chain goes on from there. A chain is sequential in
    its org; its rows stream through one task in order, and only the last link is held."""

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        org, sequence, before = None, 0, GENESIS
        for b in batches:
            rows = []
            for e in b.itertuples(index=False):
                if e.org_id != org:
                    org, sequence, before = e.org_id, 0, GENESIS
                if e.hash is not None:
                    sequence, before = e.sequence, e.hash
                    continue
                sequence += 1
                own = link(org, sequence, e.actor, e.action, e.metadata, e.created_at, before)
                rows.append((org, sequence, e.actor, e.action, e.metadata, e.created_at, before, own))
                before = own
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHAIN.split(", ")])

    placed = events.select("org_id", "event_id", "actor", "action", "metadata", "created_at", F.lit(0).cast("long").alias("sequence"), F.lit(None).cast("string").alias("hash"))
    if heads is not None:
        placed = placed.unionByName(heads, allowMissingColumns=True)
    # An org's last link comes before its events.
    return placed.repartition("org_id").sortWithinPartitions("org_id", F.col("hash").isNull(), "event_id").mapInPandas(chain, CHAIN)


def chain_heads(links: DataFrame) -> DataFrame:
    """(org_id, sequence, hash): each org's last link."""
    return links.groupBy("org_id").agg(F.max("sequence").alias("sequence"), F.max_by("hash", "sequence").alias("hash"))


def row_hash() -> Column:
    """The hash that a stored row should have, by the function that chains are made with, in Arrow batches: so the text that is
    hashed is escaped alike. Null where metadata is no JSON."""

    def own(org: str, sequence: int, actor: str | None, action: str, metadata: str | None, created: str, before: str) -> str | None:
        try:
            return link(org, sequence, actor, action, metadata, created, before)
        except ValueError:
            return None

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            yield pa.array([own(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], pa.string())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(*(F.col(c) for c in ("org_id", "sequence", "actor", "action", "metadata", "created_at", "prev_hash")))


def verify_audit_chain(chain: DataFrame) -> DataFrame:
    """(org_id, ok, first_broken, pruned_through): gaps, wrong links and wrong hashes, all found in parallel; the oldest
    events may be gone."""
    order = Window.partitionBy("org_id").orderBy("sequence")
    first = F.min("sequence").over(Window.partitionBy("org_id"))
    last_hash, last = F.lag("hash").over(order), F.lag("sequence").over(order)
    is_first = F.col("sequence") == first
    linked = F.when(is_first, (first > 1) | (F.col("prev_hash") == GENESIS)).otherwise((F.col("sequence") == last + 1) & (F.col("prev_hash") == last_hash))
    hashed = chain.withColumn("_own", row_hash())
    marked = hashed.withColumn("_bad", ~F.coalesce(linked & (F.col("_own") == F.col("hash")), F.lit(False)))
    out = marked.groupBy("org_id").agg(F.min(F.when(F.col("_bad"), F.col("sequence"))).alias("first_broken"), F.min("sequence").alias("_first"))
    return out.select("org_id", F.col("first_broken").isNull().alias("ok"), "first_broken", F.when(F.col("_first") > 1, F.col("_first") - 1).alias("pruned_through"))


def read_audit_page(chain: DataFrame, org: str, before: int | None = None, limit: int = 50) -> DataFrame:
    """Newest first, below a cursor, at most 200."""
    rows = chain.filter(F.col("org_id") == org)
    rows = rows if before is None else rows.filter(F.col("sequence") < before)
    return rows.orderBy(F.desc("sequence")).limit(max(1, min(200, limit)))


def purge_audit_prefix(chain: DataFrame, cutoff: Column) -> DataFrame:
    """``chain`` without the oldest unbroken run of events before ``cutoff`` in each org."""
    keep_from = chain.groupBy("org_id").agg(F.min(F.when(F.col("created_at") >= cutoff, F.col("sequence"))).alias("_from"))
    return chain.join(keep_from, "org_id").filter(F.col("_from").isNotNull() & (F.col("sequence") >= F.col("_from"))).drop("_from")


def scrub_metadata(metadata: Column) -> Column:
    """A JSON object's booleans, integers, strings up to 256 characters and lists up to 20 of up to 64, as map<string,string>."""
    entries = F.map_entries(F.from_json(metadata, "map<string,string>"))

    def short(e: Column) -> Column:
        raw = e["value"]
        items = F.slice(F.from_json(raw, "array<string>"), 1, 20)
        as_list = F.to_json(F.transform(items, lambda x: F.substring(x, 1, 64)))
        value = F.when(raw.rlike(r"^\s*\[") & items.isNotNull(), as_list).when(raw.rlike(r"^\s*\{") | raw.rlike(r"^[+-]?\d+\.\d+([eE][+-]?\d+)?$"), None).otherwise(F.substring(raw, 1, 256))
        return F.struct(e["key"].alias("key"), value.alias("value"))

    return F.map_from_entries(F.filter(F.transform(entries, short), lambda e: e["value"].isNotNull()))


def count_queries(events: DataFrame) -> DataFrame:
    """(workspace_id, day, n)."""
    return events.groupBy("workspace_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def purge_query_counts(counts: DataFrame, cutoff: str) -> DataFrame:
    return counts.filter(F.col("day") >= F.lit(cutoff).cast("date"))


def apply_retention(policies: DataFrame, chain: DataFrame, counts: DataFrame, sources: DataFrame, now: str) -> DataFrame:
    """By policy (workspace_id, org_id, audit_days, query_log_days, source_data_days): how many audit events of the oldest
    unbroken run, counters and sources are past their time. Nothing is deleted: this is the report of :func:`purge_aged`."""
    moment = F.lit(now).cast("timestamp")
    ago = lambda c: F.make_dt_interval(F.col(c))
    p = policies.withColumn("audit_cut", F.date_format(moment - F.make_dt_interval(F.greatest("audit_days", F.lit(AUDIT_FLOOR_DAYS))), "yyyy-MM-dd'T'HH:mm:ss"))
    p = p.withColumn("day_cut", F.to_date(moment - ago("query_log_days"))).withColumn("source_cut", moment - ago("source_data_days"))
    aged = chain.join(p.select("workspace_id", "org_id", "audit_cut"), "org_id").filter("audit_cut is not null")
    first = aged.groupBy("workspace_id").agg(F.min(F.when(F.col("created_at") >= F.col("audit_cut"), F.col("sequence"))).alias("_from"))
    audit = aged.join(first, "workspace_id").filter(F.col("_from").isNull() | (F.col("sequence") < F.col("_from"))).groupBy("workspace_id").agg(F.count("*").alias("audit_events"))
    old = counts.join(p.select("workspace_id", "day_cut"), "workspace_id").filter("day < day_cut").groupBy("workspace_id").agg(F.count("*").alias("counters"))
    gone = sources.join(p.select("workspace_id", "source_cut"), "workspace_id").filter("updated_at < source_cut").groupBy("workspace_id").agg(F.array_sort(F.collect_list("source_id")).alias("sources"))
    out = policies.filter("audit_days is not null or query_log_days is not null or source_data_days is not null").select("workspace_id").join(audit, "workspace_id", "left").join(old, "workspace_id", "left").join(gone, "workspace_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("workspace_id", zero("audit_events"), zero("counters"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))


def purge_aged(spark: SparkSession, root: str, workspace: str, policies: DataFrame, now: str, key: str) -> tuple[int, int]:
    """Purges what :func:`apply_retention` reports of audit chains (``audit`` in the workspace's generations) and counters
    (``counters``): only the parts that hold aged rows are written anew. How many rows of either are gone. What is left of a
    chain still verifies: its first row has the hash of the last one that went."""
    p = policies.select("workspace_id", "org_id", "audit_days", "query_log_days")
    chain = generations.active(spark, root, "audit", workspace)
    cut_off = F.date_format(F.lit(now).cast("timestamp") - F.make_dt_interval(F.greatest("audit_days", F.lit(AUDIT_FLOOR_DAYS))), "yyyy-MM-dd'T'HH:mm:ss")
    due = p.filter("audit_days is not null").select("org_id", cut_off.alias("cut"))
    # Of each org the first row that stays, of its oldest unbroken run; none where all go.
    firsts = cut(chain.join(due, "org_id").groupBy("org_id").agg(F.coalesce(F.min(F.when(F.col("created_at") >= F.col("cut"), F.col("sequence"))), F.lit(2**63 - 1)).alias("first")))
    _, audit = generations.rewrite(spark, root, workspace, "audit", lambda part: part.join(firsts, "org_id", "left").filter("first is null or sequence >= first").select(*part.columns), f"{key}:audit")
    days = cut(p.filter("query_log_days is not null").select("workspace_id", F.to_date(F.lit(now).cast("timestamp") - F.make_dt_interval(F.col("query_log_days"))).alias("first")))
    _, counters = generations.rewrite(spark, root, workspace, "counters", lambda part: part.join(days, "workspace_id", "left").filter("first is null or day >= first").select(*part.columns), f"{key}:counters")
    return audit, counters


def rate_verdicts(events: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """events (key, ts, event_id, ...) with the count in the key's fixed window so far, whether it is rejected, and after
    how many seconds to retry."""
    now = F.unix_timestamp("ts")
    window = F.floor(now / seconds)
    order = Window.partitionBy("key", "window").orderBy("ts", "event_id")
    out = events.withColumn("window", window).withColumn("count", F.row_number().over(order).cast("long"))
    return out.withColumn("rejected", F.col("count") > limit).withColumn("retry_after", F.when(F.col("rejected"), F.greatest((F.col("window") + 1) * seconds - now, F.lit(1))))
