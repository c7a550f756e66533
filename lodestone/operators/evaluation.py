"""Evaluation of retrieval and answers against labelled cases, slices and deployment gates.

Cases: case_id, intent, insufficient, specialized, sql_safe_required, expected (array<struct<label, source_type,
relevance, facts>>), required, contradictions, retrievers. Observations: case_id, retrieved, cited, segments
(array<struct<text, labels>>), intent, retrievers, insufficient, safe_sql, error, latency, cost, judge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.checkpoints import cut
from lodestone.functions.text import collapse_whitespace

METRICS = ("recall", "precision", "hit", "mrr", "ndcg", "citation_accuracy", "faithfulness", "answer_relevance", "route_accuracy")
# Tolerated loss, metrics that must be 1, the latency ratio and tolerated loss in a slice.
LOSS, EXACT, LATENCY_RATIO, SLICE_LOSS = 0.02, ("citation_accuracy", "faithfulness", "sql_safety"), 1.10, 0.05


def fold(text: Column) -> Column:
    return F.lower(collapse_whitespace(text))


def dcg(grades: Column) -> Column:
    parts = F.transform(grades, lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2(i + 2.0))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def score_cases(cases: DataFrame, observed: DataFrame, k: int = 5) -> DataFrame:
    """One row per observation with all metrics; failed cases score 0, cases that should find nothing score by that."""
    c = cases.select("case_id", "expected", "required", "contradictions", F.col("insufficient").alias("want_none"), F.col("intent").alias("want_intent"), F.col("retrievers").alias("want_retrievers"), "sql_safe_required")
    r = observed.join(c, "case_id").withColumn("top", F.slice("retrieved", 1, k))
    relevant = F.transform("expected", lambda e: e["label"])
    grade = F.map_from_entries(F.transform("expected", lambda e: F.struct(e["label"], e["relevance"].cast("double"))))
    hits = F.filter("top", lambda x: F.array_contains(relevant, x))
    ranks = F.filter(F.transform("top", lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda x: x.isNotNull())
    empty = (F.col("insufficient") & (F.size("top") == 0)).cast("double")
    ideal = dcg(F.slice(F.reverse(F.array_sort(F.transform("expected", lambda e: e["relevance"].cast("double")))), 1, k))
    actual = dcg(F.transform("top", lambda x: F.coalesce(grade[x], F.lit(0.0))))
    none = F.col("want_none")

    def unless(value: Column) -> Column:
        return F.when(F.col("error").isNotNull(), 0.0).otherwise(value)

    either = lambda value: unless(F.when(none, empty).otherwise(value))
    cited_ok = F.when(none, F.size("cited") == 0).otherwise((F.size("cited") > 0) & (F.size(F.array_except("cited", F.array_intersect(relevant, "top"))) == 0))

    def supported(s: Column) -> Column:
        known = F.filter("expected", lambda e: F.array_contains(s["labels"], e["label"]))
        facts = F.transform(F.flatten(F.transform(known, lambda e: e["facts"])), fold)
        claims = F.filter(F.transform(F.split(s["text"], r"[.!?]+"), fold), lambda x: x != "")
        clean = ~F.exists("contradictions", lambda x: F.contains(fold(s["text"]), fold(x)))
        return (F.size(known) == F.size(F.array_distinct(s["labels"]))) & (F.size(known) > 0) & clean & (F.size(claims) > 0) & (F.size(F.array_except(claims, facts)) == 0)

    faithful = F.when(none, F.col("insufficient") & (F.size("segments") == 0)).otherwise((F.size("segments") > 0) & F.forall("segments", supported))
    text = fold(F.array_join(F.transform("segments", lambda s: s["text"]), " "))
    answers = F.when(none, F.col("insufficient")).otherwise(~F.col("insufficient") & F.forall("required", lambda x: F.contains(text, fold(x))))
    routed = (F.col("intent") == F.col("want_intent")) & (F.col("retrievers") == F.col("want_retrievers"))
    return r.select(
        "case_id", "latency", "cost", "judge",
        either(F.try_divide(F.size(F.array_distinct(hits)), F.size("expected"))).alias("recall"), either(F.coalesce(F.try_divide(F.size(hits), F.size("top")), F.lit(0.0))).alias("precision"),
        either((F.size(hits) > 0).cast("double")).alias("hit"), either(F.coalesce(1.0 / F.get(ranks, F.lit(0)), F.lit(0.0))).alias("mrr"), either(F.when(ideal == 0, 0.0).otherwise(actual / ideal)).alias("ndcg"),
        unless(cited_ok.cast("double")).alias("citation_accuracy"), unless(faithful.cast("double")).alias("faithfulness"), unless(answers.cast("double")).alias("answer_relevance"), unless(routed.cast("double")).alias("route_accuracy"),
        F.when(F.col("sql_safe_required"), unless(F.coalesce(F.col("safe_sql"), F.lit(False)).cast("double"))).alias("sql_safety"),
    )


def order_statistics(rows: DataFrame, by: list[str], value: str, places: dict[str, tuple[float, Callable[[Column], Column]]], accuracy: int = 100_000) -> DataFrame:
    """``by`` and, for each name in ``places``, the value of a rank in its group, exact. ``places`` gives a share that the rank is
    near to, and the rank (from 1) by the number of values that are not null.

    A first pass makes a sketch of each group, whose error in rank is at most the group's size over ``accuracy``; so two of its
    quantiles enclose the value sought. A second pass counts what is below them and each value between them. Only those few
    different values are put in order, so no task gets a group's values."""
    shares = {name: share for name, (share, _) in places.items()}
    ends = [min(1.0, max(0.0, share + sign * 2 / accuracy)) for share in shares.values() for sign in (-1, 1)]
    seen = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    size = seen.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_v", ends, accuracy).alias("_ends"))
    sought = F.array(*[F.struct(F.lit(name).alias("_name"), F.get("_ends", F.lit(2 * i)).alias("_low"), F.get("_ends", F.lit(2 * i + 1)).alias("_high"), rank(F.col("_n")).cast("long").alias("_rank")) for i, (name, (_, rank)) in enumerate(places.items())])
    wanted = size.select(*by, F.inline(sought))
    wanted = wanted.withColumnsRenamed({c: f"_of_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    met = seen.join(wanted if by else F.broadcast(wanted), same or F.lit(True)).filter(F.col("_v") <= F.col("_high"))
    counts = met.groupBy(*by, "_name", "_rank", F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by, "_name").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("_upto", upto).filter(F.col("_upto") >= F.col("_rank")).groupBy(*by, "_name").agg(F.min("_v").alias("_v"))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in places])


def latencies(rows: DataFrame, by: list[str], value: str = "latency") -> DataFrame:
    """``by``, the median (of an even number the mean of the middle two) and the nearest-rank 95th percentile."""
    nearest = lambda n: F.greatest(F.lit(1), F.ceil(n * 0.95 - 1e-9))
    found = order_statistics(rows, by, value, {"_low_median": (0.5, lambda n: F.floor((n + 1) / 2)), "_high_median": (0.5, lambda n: F.floor(n / 2) + 1), "p95_latency": (0.95, nearest)})
    return found.select(*by, ((F.col("_low_median") + F.col("_high_median")) / 2).alias("median_latency"), "p95_latency")


def latency_cost_summary(rows: DataFrame, latency: str, cost: str) -> DataFrame:
    """One row: median and 95th percentile of latencies, mean cost."""
    return latencies(rows, [], latency).join(F.broadcast(rows.agg(F.avg(cost).alias("mean_cost"))), F.lit(True))


def summarize(scores: DataFrame, *by: str) -> DataFrame:
    """Means of all metrics, nearest-rank latencies, mean cost and judge share, by the given columns."""
    means = [F.avg(m).alias(m) for m in METRICS]
    scores = cut(scores.select(*by, *METRICS, "sql_safety", "latency", "cost", "judge"))  # read three times
    plain = scores.groupBy(*by).agg(
        F.count("*").alias("cases"), *means, F.coalesce(F.avg("sql_safety"), F.lit(1.0)).alias("sql_safety"), F.avg("cost").alias("mean_cost"), F.avg(F.col("judge").cast("double")).alias("judge")
    )
    named = [c for c in plain.columns if c not in (*by, "mean_cost", "judge")]
    return plain.join(latencies(scores, list(by)), list(by), "left").select(*by, *named, "median_latency", "p95_latency", "mean_cost", "judge")


def score_slices(cases: DataFrame, observed: DataFrame, k: int = 5) -> DataFrame:
    """Summaries by intent, answerability and route, and by source type against evidence of that type only."""
    keys = F.array(F.concat(F.lit("intent:"), "intent"), F.when(F.col("insufficient"), "answerability:insufficient").otherwise("answerability:answerable"), F.when(F.col("specialized"), "route:specialized").otherwise("route:default"))
    plain = score_cases(cases, observed, k).join(cases.select("case_id", F.explode(keys).alias("slice")), "case_id")
    types = cases.select("case_id", F.explode(F.array_distinct(F.transform("expected", lambda e: e["source_type"]))).alias("kind"))
    return summarize(plain.unionByName(score_by_type(cases, observed, types, k)), "slice")


def score_by_type(cases: DataFrame, observed: DataFrame, types: DataFrame, k: int) -> DataFrame:
    keyed = types.withColumn("slice", F.concat(F.lit("source:"), "kind")).withColumn("key", F.concat_ws("|", "case_id", "kind"))
    only = cases.join(keyed, "case_id").withColumn("expected", F.filter("expected", lambda e: e["source_type"] == F.col("kind"))).withColumn("case_id", F.col("key")).drop("kind", "slice", "key")
    seen = observed.join(keyed.select("case_id", "key"), "case_id").withColumn("case_id", F.col("key")).drop("key")
    return score_cases(only, seen, k).join(keyed.select(F.col("key").alias("case_id"), "slice"), "case_id")


def deployment_gates(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """(slice, gate, observed, passed) for summaries with a ``slice`` (``all`` for the whole): tolerated losses, metrics
    that must be 1, the latency ratio; a slice of the baseline that is missing fails."""
    whole = F.col("slice") == "all"
    a, b = candidate.alias("a"), baseline.alias("b")
    both = b.join(a, "slice", "left")

    def gate(name: str, observed: Column, passed: Column) -> Column:
        return F.struct(F.lit(name).alias("gate"), observed.cast("double").alias("observed"), passed.alias("passed"))

    loss = lambda m: F.col(f"a.{m}") - F.col(f"b.{m}")
    limit = F.when(whole, LOSS).otherwise(SLICE_LOSS)
    gates = [gate(f"{m}_loss", loss(m), loss(m) >= -limit - 1e-12) for m in ("recall", "mrr")]
    gates += [F.when(whole, gate(m, F.col(f"a.{m}"), F.col(f"a.{m}") == 1.0)) for m in EXACT]
    ratio = F.try_divide(F.col("a.median_latency"), F.col("b.median_latency"))
    gates.append(gate("latency_ratio", ratio, F.when(F.col("b.median_latency") == 0, F.col("a.median_latency") == 0).otherwise(ratio <= LATENCY_RATIO)))
    missing = F.array(gate("slice_present", F.lit(0.0), F.lit(False)))
    return both.select("slice", F.explode(F.when(F.col("a.cases").isNull(), missing).otherwise(F.array_compact(F.array(*gates)))).alias("g")).select("slice", "g.*")


def compare_reports(gates: DataFrame, candidate_hash: str, baseline_hash: str) -> DataFrame:
    """Whether all gates pass; reports over different benchmarks cannot be compared."""
    if candidate_hash != baseline_hash:
        raise ValueError("reports are of different benchmarks")
    return gates.agg(F.bool_and("passed").alias("passed"), F.count("*").alias("gates"), F.count_if(~F.col("passed")).alias("failed"))


def benchmark_violations(cases: DataFrame, types: list[str], intents: list[str], least: int = 30, most: int = 50) -> DataFrame:
    """(rule, detail): doubled cases or labels, missing source types or intents, the number of cases."""
    spark = cases.sparkSession
    doubled = cases.groupBy("case_id").count().filter("count > 1").select(F.lit("doubled_case").alias("rule"), F.col("case_id").cast("string").alias("detail"))
    labels = cases.select("case_id", F.explode("expected").alias("e")).groupBy("case_id", "e.label").count().filter("count > 1").select(F.lit("doubled_label").alias("rule"), F.col("label").alias("detail"))
    wanted = lambda xs, rule: spark.createDataFrame([(x, rule) for x in xs], "v string, rule string")
    seen_types = cases.select(F.explode("expected").alias("e")).select(F.col("e.source_type").alias("v")).distinct()
    gone = wanted(types, "missing_source_type").join(seen_types, "v", "left_anti").unionByName(wanted(intents, "missing_intent").join(cases.select(F.col("intent").alias("v")).distinct(), "v", "left_anti"))
    size = cases.agg(F.count("*").alias("n")).filter(~F.col("n").between(least, most)).select(F.lit("case_count").alias("rule"), F.col("n").cast("string").alias("detail"))
    return doubled.unionByName(labels).unionByName(gone.select("rule", F.col("v").alias("detail"))).unionByName(size)


def benchmark_hash(cases: DataFrame) -> DataFrame:
    """One row: SHA-256 of the cases' JSON in order of case_id (a benchmark is a bounded set)."""
    rows = F.array_sort(F.collect_list(F.struct("case_id", F.to_json(F.struct(*[F.col(c) for c in sorted(cases.columns)])).alias("json"))))
    return cases.agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["json"]), "\n"), 256).alias("hash"))


def compare_retrieval(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """By strategy: questions, hit rate and mean reciprocal rank of ranked (strategy, query_id, document_id, rank) against
    relevant (query_id, document_id) pairs."""
    hits = ranked.join(truth.withColumn("good", F.lit(1)), ["query_id", "document_id"], "left")
    one = hits.groupBy("strategy", "query_id").agg(F.min(F.when(F.col("good") == 1, F.col("rank"))).alias("first"))
    return one.groupBy("strategy").agg(F.count("*").alias("questions"), F.avg(F.col("first").isNotNull().cast("double")).alias("hit"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


def label_observations(cited: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, labels): citations (case_id, position, source_type, display) mapped back to the expected labels of the same
    type and place, distinct, in order of first use. Cases have expected items with a ``display``."""
    wanted = cases.select("case_id", F.explode("expected").alias("e")).select("case_id", F.col("e.label").alias("label"), F.col("e.source_type").alias("source_type"), F.col("e.display").alias("display"))
    hits = cited.join(wanted, ["case_id", "source_type", "display"])
    ordered = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("position", "label"))), lambda x: x["label"]))
    return cases.select("case_id").join(hits.groupBy("case_id").agg(ordered.alias("labels")), "case_id", "left").select("case_id", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


def compare_graph(found: DataFrame, expected: DataFrame, supports: DataFrame) -> DataFrame:
    """One row: how often the expected path (query_id, nodes) is found and at which reciprocal rank, how often its first
    node is linked, the share of edges of the found paths (query_id, path_id, nodes, path, rank) that have a support
    (query_id, path_id, relationship_id, document_id), and that of paths with supports from several documents."""
    hits = expected.alias("e").join(found.alias("f"), (F.col("e.query_id") == F.col("f.query_id")) & (F.col("e.nodes") == F.col("f.nodes")), "left").groupBy("e.query_id").agg(F.min("f.rank").alias("rank"))
    linked = expected.alias("e").join(found.alias("f"), (F.col("e.query_id") == F.col("f.query_id")) & F.array_contains(F.col("f.nodes"), F.get("e.nodes", F.lit(0))), "left").groupBy("e.query_id").agg(F.count("f.rank").alias("n"))
    steps = found.select("query_id", "path_id", F.explode("path").alias("relationship_id"))
    known = supports.select("query_id", "path_id", "relationship_id").distinct().withColumn("ok", F.lit(1.0))
    cover = steps.join(known, ["query_id", "path_id", "relationship_id"], "left").agg(F.avg(F.coalesce("ok", F.lit(0.0))).alias("edge_coverage"))
    cross = supports.groupBy("query_id", "path_id").agg((F.countDistinct("document_id") > 1).cast("double").alias("x")).agg(F.avg("x").alias("cross_document"))
    first = hits.agg(F.avg(F.col("rank").isNotNull().cast("double")).alias("path_hit"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))
    link = linked.agg(F.avg((F.col("n") > 0).cast("double")).alias("linked"))
    out = first
    for part in (link, cover, cross):  # one row each
        out = out.join(F.broadcast(part), F.lit(True))
    return out


def compare_reranking(runs: DataFrame, grades: DataFrame, k: int = 5) -> DataFrame:
    """By strategy: graded reciprocal rank and NDCG of runs (strategy, query_id, document_id, source, rank) against grades
    (query_id, document_id, grade), and the share of a query's relevant sources that are covered."""
    rows = runs.filter(F.col("rank") <= k).join(grades, ["query_id", "document_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    ideal = grades.groupBy("query_id").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.col("grade").cast("double")))), 1, k).alias("best")).select("query_id", dcg(F.col("best")).alias("ideal"))
    gain = F.sum((F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("rank") + 1.0))
    one = rows.groupBy("strategy", "query_id").agg(gain.alias("dcg"), F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"), F.countDistinct(F.when(F.col("grade") > 0, F.col("source"))).alias("sources"))
    both = one.join(ideal, "query_id", "left")
    return both.groupBy("strategy").agg(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(F.coalesce(F.try_divide("dcg", "ideal"), F.lit(0.0))).alias("ndcg"), F.avg("sources").alias("sources"))


def compare_routing(routed: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: the share of questions whose intent is as wanted, and the median latency that plans of their own save
    against the default (latency, default_latency), over questions with such a plan."""
    both = routed.join(wanted, "query_id")
    saved = F.median(F.when(F.col("intent") != "default", F.col("default_latency") - F.col("latency")))
    return both.agg(F.avg((F.col("intent") == F.col("wanted")).cast("double")).alias("plan_accuracy"), saved.alias("median_saved"), F.count("*").alias("questions"))
