"""Streams: late rows, repeated deliveries, chains over several batches, generations."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.operators import governance
from lodestone.plans.governance import burst
from lodestone.streaming import jobs


def write(spark, rows, schema, path):
    df = spark.createDataFrame(rows, schema)
    df = df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def test_late_rows_leave_windows_and_deliveries_count_once(spark, tmp_path):
    path = f"{tmp_path}/e.parquet"
    schema = write(spark, [("a", "2024-01-01 00:00:01"), ("a", "2024-01-01 00:00:02"), ("a", "2024-01-01 00:00:50")], "key string, ts string", path)
    source = lambda: spark.readStream.schema(schema).parquet(path)
    folder = f"{tmp_path}/out"
    jobs.drain(jobs.rate_windows(source(), 2), folder)
    write(spark, [("a", "2024-01-01 02:00:00"), ("b", "2024-01-01 02:00:00")], "key string, ts string", path)
    jobs.drain(jobs.rate_windows(source(), 2), folder)
    write(spark, [("a", "2024-01-01 00:00:03"), ("a", "2024-01-01 04:00:00")], "key string, ts string", path)
    got = jobs.drain(jobs.rate_windows(source(), 2), folder).collect()
    first = [r for r in got if r.key == "a" and r.window_start.hour == 0 and r.window_start.minute == 0]
    assert [(r.n, r.exceeded) for r in first] == [(3, True)]


def test_deliveries(spark, tmp_path):
    path = f"{tmp_path}/d.parquet"
    rows = [("j", "s", "2024-01-01 00:00:00"), ("j", "s", "2024-01-01 00:00:01"), ("j", "t", "2024-01-01 00:00:01")]
    schema = write(spark, rows, "job string, step string, ts string", path)
    source = lambda: jobs.deliveries_once(spark.readStream.schema(schema).parquet(path))
    jobs.drain(source(), f"{tmp_path}/out")
    write(spark, rows[:1], "job string, step string, ts string", path)
    assert jobs.drain(source(), f"{tmp_path}/out").count() == 2


def test_chain_goes_on_over_batches(spark, tmp_path):
    path, kind = f"{tmp_path}/a.parquet", "org_id string, event_id long, actor string, action string, metadata string, created_at string"
    for start in (0, 10):
        schema = write(spark, [(f"o{i % 2}", i, "u", "act", '{"k":1}', "2024-01-01T00:00:00") for i in range(start, start + 10)], kind, path)
        chain = jobs.drain(jobs.audit_chain(spark.readStream.schema(schema).parquet(path)), f"{tmp_path}/out")
    assert chain.count() == 20 and all(r.ok for r in governance.verify_audit_chain(chain).collect())


KIND = "org_id string, event_id long, actor string, action string, metadata string, created_at string"


def test_chain_is_that_of_one_table_whatever_the_batches(spark, tmp_path):
    """Orgs that are not in each batch, no org, no actor, batches that are repeated, and none."""
    path, folder = f"{tmp_path}/a.parquet", f"{tmp_path}/out"
    rows = [(None if i % 5 == 4 else f"o{i % 5}", 99 - i if i < 20 else i + 99, None if i % 3 else "ü", "act", None if i % 4 else '{"k":1}', f"2024-01-01T00:00:{i % 60:02d}") for i in range(90)]
    parts = [[r for r in rows[:30] if r[0] != "o3"], [r for r in rows[30:60] if r[0] not in ("o1", None)], rows[60:75], rows[75:]]
    schema = spark.createDataFrame([], KIND).schema
    (tmp_path / "a.parquet").mkdir()
    drained = lambda: jobs.drain(jobs.audit_chain(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)), folder)
    assert drained().count() == 0
    for i, part in enumerate(parts):
        write(spark, part, KIND, path)
        chain = drained()
        if i % 2:
            # As if the job had ended before the batch was committed.
            before = sorted(map(tuple, chain.collect()), key=repr)
            os.remove(f"{folder}/checkpoint/commits/{i}")
            os.remove(f"{folder}/checkpoint/commits/.{i}.crc")
            chain = drained()
            assert sorted(map(tuple, chain.collect()), key=repr) == before
    seen, links = set(), chain.collect()
    assert chain.columns == [c.split()[0] for c in governance.CHAIN.split(", ")] and len(links) == sum(map(len, parts))
    for org in (None, "o0", "o1", "o2", "o3"):
        last, own = governance.GENESIS, sorted((r for r in links if r.org_id == org), key=lambda r: r.sequence)
        want = [r for part in parts for r in sorted((r for r in part if r[0] == org), key=lambda r: r[1])]
        assert [(r.org_id, r.actor, r.action, r.metadata, r.created_at) for r in own] == [(r[0], *r[2:]) for r in want]
        for i, r in enumerate(own):
            assert (r.sequence, r.prev_hash) == (i + 1, last)
            last = governance.link(*r[:-2], last)
            assert r.hash == last and last not in seen
            seen.add(last)
    assert all(r.ok for r in governance.verify_audit_chain(chain).collect())


def peaks(spark):
    """Most MB that each of Spark's Python workers has held so far."""
    found, parents = {}, {}
    for p in Path("/proc").glob("[0-9]*"):
        try:
            facts = dict(x.split(":", 1) for x in (p / "status").read_text().splitlines())
        except OSError:
            continue
        parents[p.name] = facts["PPid"].strip()
        found[p.name] = int(facts.get("VmHWM", "0").split()[0]) / 1024
    own, jvm = set(), str(spark.sparkContext._gateway.proc.pid)
    while new := {k for k, v in parents.items() if v in own | {jvm}} - own:
        own |= new
    return {k: found[k] for k in own if "pyspark" in Path(f"/proc/{k}/cmdline").read_text()}


@pytest.mark.skipif(not Path("/proc/self/status").exists(), reason="no /proc")
def test_chain_of_many_events_is_not_held(spark, tmp_path):
    path, n = f"{tmp_path}/a.parquet", 250_000
    spark.range(n).selectExpr("'o' AS org_id", "id AS event_id", "'u' AS actor", "'act' AS action", "concat('{\"k\":', id, '}') AS metadata", "'2024-01-01T00:00:00' AS created_at").write.parquet(path)
    before = peaks(spark)
    chain = jobs.drain(jobs.audit_chain(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)), f"{tmp_path}/out")
    after = peaks(spark)
    assert chain.count() == n and after
    # A worker without the events has less than 150 MB, one with them more than 300.
    assert max(v - max(before.get(k, 0), 100) for k, v in after.items()) < 100, (before, after)


def test_rate_windows_hold_the_last_events(spark, tmp_path):
    rows = [(i, i % 7, f"2024-01-01 0{i // 100}:{i % 60:02d}:00") for i in range(400)]
    write(spark, rows, "event_id long, user_id long, ts string", f"{tmp_path}/events.parquet")
    events = burst(spark.read.parquet(f"{tmp_path}/events.parquet"))
    want = events.groupBy("key", F.window("ts", "60 seconds").start.alias("window_start")).agg(F.count("*").alias("n")).collect()
    got = entry.queries()["stream_rate_windows"](spark, str(tmp_path)).collect()
    assert sorted((r.key, r.window_start, r.n, r.n > 2) for r in want) == sorted((r.key, r.window_start, r.n, r.exceeded) for r in got)
