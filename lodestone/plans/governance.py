"""Queries over governance, maintenance and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.checkpoints import cut, shared_folder
from lodestone.functions.text import BEARER, EMAIL, INJECTION, SECRET
from lodestone.operators import governance, maintenance
from lodestone.operators.retrieval import hashed_model
from lodestone.plans.ingestion import FLAT, chunk_sql
from lodestone.plans.registry import query, table
from lodestone.plans.retrieval import TOKENS
from lodestone.plans.views import DOCS_NORM, docs_norm
from lodestone.sources import generations
from lodestone.streaming import jobs

LABELLED = """labelled AS (SELECT source, CASE CAST(substr(source, 4) AS INT) % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'confidential' ELSE 'restricted' END AS classification, doc_id FROM documents)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.get(F.array(*map(F.lit, governance.LABELS)), F.substring("source", 4, 3).cast("int") % 4)
    return table(spark, sf_dir, "documents").select("source", label.alias("classification"), "doc_id")


@query(f"WITH {LABELLED} SELECT doc_id, source, classification FROM labelled WHERE classification IN ('public', 'internal')")
def classification_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.visible(labelled(spark, sf_dir), "internal").select("doc_id", "source", "classification")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 < 2 THEN 'restricted' WHEN c_custkey % 7 = 0 THEN 'public' ELSE 'confidential' END AS clearance FROM customer")
def effective_clearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.get(F.array(*map(F.lit, ("owner", "admin", "member", "viewer", "member"))), (F.col("c_custkey") % 5).cast("int"))
    own = F.when(F.col("c_custkey") % 7 != 0, "confidential")
    return table(spark, sf_dir, "customer").select("c_custkey", governance.effective_clearance(role, own).alias("clearance"))


def audit_events(events: DataFrame) -> DataFrame:
    created = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    metadata = F.regexp_replace("props", r"\s+", "")
    return events.select(F.concat(F.lit("org"), F.col("user_id") % 10).alias("org_id"), "event_id", F.col("user_id").cast("string").alias("actor"), F.col("event_type").alias("action"), metadata.alias("metadata"), created.alias("created_at"))


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.append_audit_chain(audit_events(table(spark, sf_dir, "events")))


@query()
def append_audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain(spark, sf_dir)


NUMBERED = "numbered AS (SELECT 'org' || (user_id % 10) AS org_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS sequence FROM events)"


@query(f"""WITH {NUMBERED} SELECT org_id, org_id NOT IN ('org1', 'org2') AS ok, CASE org_id WHEN 'org1' THEN 5 WHEN 'org2' THEN 8 END AS first_broken, CASE WHEN org_id = 'org3' THEN 4 END AS pruned_through FROM (SELECT DISTINCT org_id FROM numbered)""")
def verify_audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Org 1 has an altered row, org 2 lacks row 7, org 3 has lost its first four."""
    rows = chain(spark, sf_dir).withColumn("action", F.when((F.col("org_id") == "org1") & (F.col("sequence") == 5), "forged").otherwise(F.col("action")))
    rows = rows.filter(~((F.col("org_id") == "org2") & (F.col("sequence") == 7)) & ~((F.col("org_id") == "org3") & (F.col("sequence") < 5)))
    return governance.verify_audit_chain(rows)


@query(f"WITH {NUMBERED} SELECT sequence, event_type AS action FROM numbered WHERE org_id = 'org4' AND sequence < 60 ORDER BY sequence DESC LIMIT 25")
def read_audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.read_audit_page(chain(spark, sf_dir), "org4", 60, 25).select("sequence", "action")


@query(f"""WITH {NUMBERED}, f AS (SELECT org_id, min(sequence) AS s FROM numbered WHERE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') >= '2024-01-10' GROUP BY 1) SELECT n.org_id, count(*) AS kept, min(sequence) AS first FROM numbered n JOIN f ON n.org_id = f.org_id WHERE sequence >= s GROUP BY 1""")
def purge_audit_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.purge_audit_prefix(chain(spark, sf_dir), F.lit("2024-01-10")).groupBy("org_id").agg(F.count("*").alias("kept"), F.min("sequence").alias("first"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def scrub_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", governance.scrub_metadata(F.col("props"))["k"].alias("k"))


def by_workspace(events: DataFrame) -> DataFrame:
    return events.withColumn("workspace_id", F.concat(F.lit("w"), F.col("user_id") % 8))


COUNTS = "counts AS (SELECT 'w' || (user_id % 8) AS workspace_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)"


@query(f"WITH {COUNTS} SELECT workspace_id, day, n FROM counts")
def count_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.count_queries(by_workspace(table(spark, sf_dir, "events")))


@query(f"WITH {COUNTS} SELECT workspace_id, day, n FROM counts WHERE day >= DATE '2024-01-15'")
def purge_query_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.purge_query_counts(governance.count_queries(by_workspace(table(spark, sf_dir, "events"))), "2024-01-15")


def policies_of(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(8).select(F.concat(F.lit("w"), i).alias("workspace_id"), F.concat(F.lit("org"), i).alias("org_id"), F.when(i % 2 == 0, 10).otherwise(45).alias("audit_days"), F.when(i % 3 == 0, 35).alias("query_log_days"), F.when(i % 4 == 0, 9).alias("source_data_days"))


@query(f"""WITH {NUMBERED}, {COUNTS}, p AS (SELECT i AS k, 'w' || i AS workspace_id, 'org' || i AS org_id, CASE WHEN i % 2 = 0 THEN 10 ELSE 45 END AS audit_days, CASE WHEN i % 3 = 0 THEN 35 END AS query_log_days FROM range(8) t(i)),
cut AS (SELECT *, strftime(TIMESTAMP '2024-02-15 00:00:00' - to_days(greatest(audit_days, 30)::INT), '%Y-%m-%dT%H:%M:%S') AS c FROM p), f AS (SELECT org_id, min(sequence) FILTER (strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') >= c) AS s FROM numbered JOIN cut USING (org_id) GROUP BY 1),
a AS (SELECT workspace_id, count(*) AS n FROM numbered JOIN f USING (org_id) JOIN p USING (org_id) WHERE s IS NULL OR sequence < s GROUP BY 1), q AS (SELECT workspace_id, count(*) AS n FROM counts JOIN p USING (workspace_id) WHERE day < CAST(TIMESTAMP '2024-02-15 00:00:00' - to_days(query_log_days::INT) AS DATE) GROUP BY 1),
s AS (SELECT 'w' || (doc_id % 8) AS workspace_id, source, max(TIMESTAMP '2024-01-01 00:00:00' + to_days((doc_id % 40)::INT)) AS updated FROM documents GROUP BY 1, 2),
g AS (SELECT workspace_id, string_agg(source, ',' ORDER BY source) AS sources FROM s JOIN p USING (workspace_id) WHERE k % 4 = 0 AND updated < TIMESTAMP '2024-02-15 00:00:00' - to_days(9) GROUP BY 1)
SELECT p.workspace_id, coalesce(a.n, 0) AS audit_events, coalesce(q.n, 0) AS counters, coalesce(sources, '') AS sources FROM p LEFT JOIN a USING (workspace_id) LEFT JOIN q USING (workspace_id) LEFT JOIN g USING (workspace_id)""")
def apply_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = policies_of(spark)
    updated = F.timestamp_add("DAY", (F.col("doc_id") % 40).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("w"), F.col("doc_id") % 8).alias("workspace_id"), F.col("source").alias("source_id"), updated.alias("updated_at"))
    sources = docs.groupBy("workspace_id", "source_id").agg(F.max("updated_at").alias("updated_at"))
    counts = governance.count_queries(by_workspace(table(spark, sf_dir, "events")))
    return governance.apply_retention(policies, chain(spark, sf_dir), counts, sources, "2024-02-15 00:00:00").withColumn("sources", F.array_join("sources", ","))


@query(f"""WITH {NUMBERED}, {COUNTS}, p AS (SELECT 'w' || i AS workspace_id, 'org' || i AS org_id, CASE WHEN i % 2 = 0 THEN 10 ELSE 45 END AS audit_days, CASE WHEN i % 3 = 0 THEN 35 END AS query_log_days FROM range(8) t(i)),
cut AS (SELECT *, strftime(TIMESTAMP '2024-02-15 00:00:00' - to_days(greatest(audit_days, 30)::INT), '%Y-%m-%dT%H:%M:%S') AS c FROM p), f AS (SELECT org_id, min(sequence) FILTER (strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') >= c) AS s FROM numbered JOIN cut USING (org_id) GROUP BY 1)
SELECT n.org_id AS name, count(*) AS kept, min(sequence) AS first, true AS sound FROM numbered n LEFT JOIN f ON f.org_id = n.org_id WHERE f.org_id IS NULL OR sequence >= s GROUP BY 1
UNION ALL SELECT k.workspace_id, count(*), NULL, true FROM counts k LEFT JOIN p ON p.workspace_id = k.workspace_id WHERE query_log_days IS NULL OR day >= CAST(TIMESTAMP '2024-02-15 00:00:00' - to_days(query_log_days::INT) AS DATE) GROUP BY 1""")
def purge_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit chains, stored in parts by time, and counters, after a purge by policy: what is left of each, and whether it is sound:
    chains verify, and as many rows went as the report had said."""
    root, now = folder(spark), "2024-02-15 00:00:00"
    events, counts = cut(chain(spark, sf_dir)), cut(governance.count_queries(by_workspace(table(spark, sf_dir, "events"))))
    for since, until in (("", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "9")):
        generations.publish({"audit": events.filter((F.col("created_at") >= since) & (F.col("created_at") < until))}, root, "w", f"audit {since}", "none", "append")
    generations.publish({"counters": counts}, root, "w", "counters", "none", "append")
    none = spark.createDataFrame([], "workspace_id string, source_id string, updated_at timestamp")
    said = governance.apply_retention(policies_of(spark), events, counts, none, now).agg(F.sum("audit_events"), F.sum("counters")).first()
    as_said = governance.purge_aged(spark, root, "w", policies_of(spark), now, "purge 1") == tuple(said)
    left = generations.active(spark, root, "audit", "w")
    chains = left.groupBy("org_id").agg(F.count("*").alias("kept"), F.min("sequence").alias("first")).join(governance.verify_audit_chain(left), "org_id")
    days = generations.active(spark, root, "counters", "w").groupBy("workspace_id").agg(F.count("*").alias("kept"))
    both = chains.select(F.col("org_id").alias("name"), "kept", "first", "ok").unionByName(days.select(F.col("workspace_id").alias("name"), "kept", F.lit(None).cast("long").alias("first"), F.lit(True).alias("ok")))
    return both.select("name", "kept", "first", (F.col("ok") & F.lit(as_said)).alias("sound"))


BURST = "burst AS (SELECT event_id, user_id % 20 AS key, epoch(date_trunc('hour', ts))::BIGINT + event_id % 50 AS s FROM events)"


def burst(events: DataFrame) -> DataFrame:
    s = F.unix_timestamp(F.date_trunc("hour", F.col("ts").cast("timestamp"))) + F.col("event_id") % 50
    return events.select("event_id", (F.col("user_id") % 20).alias("key"), F.timestamp_seconds(s).alias("ts"))


@query(f"""WITH {BURST}, c AS (SELECT event_id, key, s, s // 60 AS w, row_number() OVER (PARTITION BY key, s // 60 ORDER BY s, event_id) AS n FROM burst)
SELECT event_id, n AS "count", n > 2 AS rejected, CASE WHEN n > 2 THEN greatest((w + 1) * 60 - s, 1) END AS retry_after FROM c""")
def rate_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.rate_verdicts(burst(table(spark, sf_dir, "events")), 2).select("event_id", "count", "rejected", "retry_after")


@query(f"""WITH {BURST}, c AS (SELECT event_id, key, s, s // 900 AS w, row_number() OVER (PARTITION BY key, s // 900 ORDER BY s, event_id) AS n FROM burst)
SELECT event_id, n AS "count", n > 10 AS rejected, CASE WHEN n > 10 THEN greatest((w + 1) * 900 - s, 1) END AS retry_after FROM c""")
def login_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.rate_verdicts(burst(table(spark, sf_dir, "events")), 10, 900).select("event_id", "count", "rejected", "retry_after")


STATUS = "log AS (SELECT user_id AS source_id, event_id AS place, CASE event_type WHEN 'view' THEN 'registered' WHEN 'signup' THEN 'indexing' WHEN 'click' THEN 'ready' ELSE 'failed' END AS status FROM events)"


@query(f"""WITH {STATUS}, l AS (SELECT *, lag(status) OVER (PARTITION BY source_id ORDER BY place) AS b FROM log) SELECT source_id, place, status, b AS "before" FROM l
WHERE (b IS NULL AND status <> 'registered') OR (b IS NOT NULL AND (b || '>' || status) NOT IN ('registered>indexing', 'registered>failed', 'indexing>ready', 'indexing>failed', 'ready>failed', 'failed>indexing'))""")
def check_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*map(F.lit, ("view", "registered", "signup", "indexing", "click", "ready", "error", "failed", "purchase", "failed")))
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("place"), kinds[F.col("event_type")].alias("status"))
    return maintenance.invalid_transitions(log)


@query("""WITH o AS (SELECT user_id AS operation, list(DISTINCT event_type) AS s FROM events GROUP BY 1) SELECT operation, array_to_string([x for x in ['click', 'error', 'view'] if NOT list_contains(s, x)], ',') AS missing, list_has_all(s, ['click', 'error', 'view']) AS ready FROM o""")
def publish_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = table(spark, sf_dir, "events").select(F.col("user_id").alias("operation"), F.col("event_type").alias("store"))
    return maintenance.publishable(prepared, ["view", "click", "error"]).withColumn("missing", F.array_join("missing", ","))


@query(f"WITH {DOCS_NORM} SELECT workspace_id, count(DISTINCT source_id) AS sources, count(*) AS documents, CASE workspace_id WHEN 'en' THEN 2 WHEN 'de' THEN 1 ELSE 0 END AS generations FROM docs_norm GROUP BY 1")
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = spark.createDataFrame([("en", "vector"), ("en", "lexical"), ("de", "vector")], "workspace_id string, kind string")
    return maintenance.inventory(docs_norm(spark, sf_dir), active)


@query("SELECT doc_id, CASE WHEN doc_id % 50 = 1 THEN 'missing_right' WHEN doc_id % 50 = 2 THEN 'differs' END AS status FROM documents WHERE doc_id % 50 IN (1, 2) UNION ALL SELECT doc_id + 1000000000, 'missing_left' FROM documents WHERE doc_id % 50 = 3")
def reconcile_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    copy = docs.filter("doc_id % 50 <> 1").withColumn("text", F.when(F.col("doc_id") % 50 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    copy = copy.unionByName(docs.filter("doc_id % 50 = 3").withColumn("doc_id", F.col("doc_id") + 1_000_000_000))
    return maintenance.reconcile(docs, copy, "doc_id", ["source", "text"])


@query("SELECT doc_id, 'pending' AS status FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'conflict' FROM documents WHERE doc_id % 30 = 1")
def resume_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"))
    done = items.filter("doc_id % 3 <> 0").withColumn("checksum", F.when(F.col("doc_id") % 30 == 1, "other").otherwise(F.col("checksum")))
    left, conflict = maintenance.resume(items, done, "doc_id")
    return left.select("doc_id", F.lit("pending").alias("status")).unionByName(conflict.select("doc_id", F.lit("conflict").alias("status")))


@query("SELECT user_id AS job, event_type AS step, min(event_id) AS delivery FROM events GROUP BY 1, 2")
def idempotent_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("step"), F.col("event_id").alias("delivery"))
    return maintenance.idempotent_steps(events.unionByName(events))


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


MASKED = f"regexp_replace(regexp_replace(regexp_replace(text, '{BEARER}', 'bearer [redacted]', 'g'), '{EMAIL}', '[redacted]', 'g'), '{SECRET}', '\\1\\2[redacted]', 'g')"
#: Long opaque strings one after another, but for those that look like ids or hashes.
SAFE = f"""masked AS (SELECT doc_id, source, {MASKED} AS t FROM documents), opaque AS (SELECT *, list_filter(list_distinct(regexp_extract_all(t, '[A-Za-z0-9_-]{{32,}}')),
  lambda x: NOT regexp_full_match(x, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}|[0-9a-fA-F]{{32,64}}')) AS xs FROM masked),
safe AS (SELECT doc_id, source, list_reduce(list_prepend(t, xs), lambda a, x: replace(a, x, '[redacted]')) AS text FROM opaque)"""
LABELS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{label}' END" for label, p in sorted(INJECTION.items())) + "], lambda x: x IS NOT NULL), ',')"


@query(f"""WITH documents AS (SELECT conv_id * 1000 + turn AS doc_id, CAST(NULL AS VARCHAR) AS source, text FROM conversations), {SAFE}, labelled AS (SELECT doc_id, {LABELS} AS labels FROM documents)
SELECT doc_id // 1000 AS conv_id, doc_id % 1000 AS turn, s.text, labels FROM safe s JOIN labelled l USING (doc_id)""")
def stream_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jobs.safety(jobs.read_stream(spark, sf_dir, "conversations")).select("conv_id", "turn", "text", F.array_join("labels", ",").alias("labels"))
    return jobs.drain(found, folder(spark))


@query(f"WITH {COUNTS} SELECT workspace_id, day, n FROM counts")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.drain_updates(jobs.counts(by_workspace(jobs.read_stream(spark, sf_dir, "events"))), folder(spark), ["workspace_id", "day"])


@query("SELECT user_id AS job, event_type AS step FROM events GROUP BY 1, 2")
def stream_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = jobs.read_stream(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("step"), "ts")
    return jobs.drain(jobs.deliveries_once(events, "400 days"), folder(spark)).select("job", "step")


@query(f"WITH {BURST} SELECT key, make_timestamp((s // 60) * 60000000) AS window_start, count(*) AS n, count(*) > 2 AS exceeded FROM burst GROUP BY 1, 2")
def stream_rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.drain_updates(jobs.rate_windows(burst(jobs.read_stream(spark, sf_dir, "events")), 2), folder(spark), ["key", "window_start"])


@query(f"WITH {NUMBERED} SELECT org_id, true AS ok, CAST(NULL AS BIGINT) AS first_broken, CAST(NULL AS BIGINT) AS pruned_through FROM numbered GROUP BY 1")
def stream_audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.verify_audit_chain(jobs.drain(jobs.audit_chain(audit_events(jobs.read_stream(spark, sf_dir, "events"))), folder(spark)))


def in_three(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """``docs`` as three files by doc_id, and these as a stream of three batches."""
    for i in range(3):
        docs.filter(F.pmod("doc_id", F.lit(3)) == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(f"""WITH RECURSIVE {SAFE}, flat AS (SELECT doc_id AS key1, 0 AS key2, 0 AS key3, {FLAT.format('text')} AS text FROM safe), {chunk_sql('c', 'flat')},
chunks AS (SELECT key1 AS doc_id, n AS part, trim(substr(text, s + 1, e - s)) AS chunk FROM c WHERE trim(substr(text, s + 1, e - s)) <> '')
SELECT s.doc_id, s.source, s.text, count(part) AS chunks, md5(coalesce(string_agg(chunk, chr(10) ORDER BY part), '')) AS chunk_md5, true AS verified, 3 AS commits FROM safe s LEFT JOIN chunks k ON k.doc_id = s.doc_id GROUP BY ALL""")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches; then all three again, as by a job that has lost its checkpoint, which changes nothing."""
    root = folder(spark)
    docs = in_three(spark, table(spark, sf_dir, "documents").select("doc_id", "source", "text"), f"{root}/in")
    for attempt in ("first", "again"):
        jobs.ingest(docs, root, "w", f"{root}/checkpoint-{attempt}")
    sound = generations.verify(spark, root, "w", "none").agg(F.bool_and("ok").alias("verified"), F.max("number").cast("int").alias("commits"))
    chunks = generations.active(spark, root, "chunks", "w").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "chunk"))).alias("c"))
    texts = generations.active(spark, root, "documents", "w").select("doc_id", "source", "text").join(chunks, "doc_id", "left")
    joined = F.array_join(F.transform("c", lambda x: x["chunk"]), "\n")
    facts = texts.select("doc_id", "source", "text", F.coalesce(F.size("c"), F.lit(0)).cast("long").alias("chunks"), F.md5(F.coalesce(joined, F.lit(""))).alias("chunk_md5"))
    return facts.join(F.broadcast(sound), F.lit(True))  # one row


@query(f"""WITH now AS (SELECT doc_id, text, CASE WHEN doc_id % 7 = 0 THEN 'second' ELSE 'first' END AS run FROM documents),
counts AS (SELECT doc_id, run, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 64 AS dim, count(*) AS n FROM (SELECT doc_id, run, unnest({TOKENS.format('text')}) AS term FROM now) GROUP BY ALL)
SELECT doc_id, run, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM counts""")
def embed_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all texts as they were (those of every seventh document had other words), then of all as they are: the second
    run computes what has changed. Given is each current text's vector and the run that computed it."""
    root, docs = folder(spark), table(spark, sf_dir, "documents").select("doc_id", "text")
    before = docs.withColumn("text", F.when(F.pmod("doc_id", F.lit(7)) == 0, F.concat("text", F.lit(" as it was"))).otherwise(F.col("text")))
    for run, texts in (("first", before), ("second", docs)):
        texts.write.parquet(f"{root}/{run}")
        arriving = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/{run}")
        jobs.embed_arriving(arriving, root, "w", f"{root}/checkpoint-{run}", "doc_id", hashed_model, "hashed-64", run)
    of_run = None
    for c in generations.commits(spark, root, "w"):
        part = spark.read.parquet(*[p.path for p in c.parts]).select("doc_id", "content_sha", "embedding", F.lit(c.key.split(":")[0]).alias("run"))
        of_run = part if of_run is None else of_run.unionByName(part)
    now = docs.select("doc_id", F.sha2("text", 256).alias("content_sha"))
    found = of_run.join(now, ["doc_id", "content_sha"]).select("doc_id", "run", F.posexplode("embedding").alias("dim", "weight"))
    return found.filter("weight > 0").select("doc_id", "run", F.col("dim").cast("long").alias("dim"), F.round("weight", 6).alias("weight"))
