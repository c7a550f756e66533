"""Property graph: entity resolution over mentions, relationships with supports, and paths from a question's anchors.

Mentions: mention_id, entity_type, name, aliases, and the support's document_id, begin, end. Relations: subject and object
mention ids, predicate, confidence, and the support's place. Everything is joins and grouping; only a count per round
of label propagation comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.checkpoints import cut
from lodestone.functions.text import URL_NAMESPACE, normalize_name, uuid5
from lodestone.operators.components import components, star_edges

# Words of a question that speak of a predicate.
PREDICATE_TERMS = {
    "WORKS_FOR": ("work", "works", "employed", "employment"),
    "OWNS": ("own", "owns", "owner", "owned"),
    "MANAGES": ("manage", "manages", "manager", "managed"),
    "APPLIES_TO": ("apply", "applies", "applicable"),
    "REFERENCES": ("reference", "references", "cites"),
    "GOVERNS": ("govern", "governs", "governed"),
    "LOCATED_IN": ("located", "location", "where"),
    "PART_OF": ("part", "belongs"),
    "REQUIRES": ("require", "requires", "required"),
    "RELATED_TO": ("related", "relationship"),
}


def locate_support(rows: DataFrame, text: str, content: str) -> DataFrame:
    """With ``begin`` and ``end`` of the trimmed support in its document; rows whose support is not there are left out."""
    place = F.expr(f"locate(trim({text}), {content})")
    return rows.withColumn("begin", (place - 1).cast("long")).filter(F.col("begin") >= 0).withColumn("end", F.col("begin") + F.length(F.trim(text)))


def invalid_extractions(mentions: DataFrame, relations: DataFrame, documents: DataFrame) -> DataFrame:
    """(rule, detail): doubled references, mentions of unknown documents, relations with unknown ends."""
    doubled = mentions.groupBy("mention_id").count().filter("count > 1").select(F.lit("doubled_reference").alias("rule"), F.col("mention_id").cast("string").alias("detail"))
    orphan = mentions.join(documents, "document_id", "left_anti").select(F.lit("unknown_document").alias("rule"), F.col("mention_id").cast("string").alias("detail"))
    ends = relations.select(F.explode(F.array("subject", "object")).alias("mention_id")).distinct().join(mentions, "mention_id", "left_anti")
    return doubled.unionByName(orphan).unionByName(ends.select(F.lit("unknown_endpoint").alias("rule"), F.col("mention_id").cast("string").alias("detail")))


def resolve_entities(mentions: DataFrame) -> DataFrame:
    """(mention_id, component): mentions of a type that share a normalized name or alias, transitively; one row for each
    mention_id, however many rows it has. Mentions that share no name are their own component.

    A name's mentions are linked by stars instead of pairs, and a name that many share by a star for each share of them.
    """
    names = mentions.select("mention_id", "entity_type", F.explode(F.array_union(F.array("name"), "aliases")).alias("name"))
    names = names.withColumn("name", normalize_name(F.col("name"))).filter("name <> ''")
    labels = components(star_edges(names, ["entity_type", "name"], "mention_id"))
    every = mentions.select("mention_id").distinct()
    return every.join(labels.withColumnRenamed("node", "mention_id"), "mention_id", "left").select("mention_id", F.coalesce("label", "mention_id").alias("component"))


def canonicalize(mentions: DataFrame, components: DataFrame, workspace: str) -> tuple[DataFrame, DataFrame]:
    """Entities (entity_id, entity_type, canonical_name, normalized_name, aliases, mentions) and (mention_id, entity_id).

    The canonical name is the shortest, then the first in alphabetical order."""
    rows = mentions.join(components, "mention_id")
    best = F.min_by("name", F.struct(F.length("name"), F.lower("name"), "name"))
    one = rows.groupBy("component").agg(F.min("entity_type").alias("entity_type"), best.alias("canonical_name"))
    one = one.withColumn("normalized_name", normalize_name(F.col("canonical_name")))
    one = one.withColumn("entity_id", uuid5(URL_NAMESPACE, F.concat_ws(":", F.lit(workspace), "entity_type", "normalized_name")))
    names = rows.select("component", F.explode(F.array_union(F.array("name"), "aliases")).alias("other"))
    names = names.join(one.select("component", "normalized_name"), "component").filter(normalize_name(F.col("other")) != F.col("normalized_name"))
    ordered = F.array_sort(F.collect_set(F.struct(F.lower("other").alias("k"), F.col("other").alias("v"))))
    aliases = names.groupBy("component").agg(F.transform(ordered, lambda x: x["v"]).alias("aliases"))
    supports = rows.groupBy("component").agg(F.array_sort(F.collect_set(F.struct("document_id", "begin", "end"))).alias("mentions"))
    entities = one.join(aliases, "component", "left").join(supports, "component").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    return entities.drop("component"), components.join(one.select("component", "entity_id"), "component").select("mention_id", "entity_id")


def aggregate_relationships(relations: DataFrame, of: DataFrame, workspace: str) -> DataFrame:
    """(relationship_id, subject, predicate, object, confidence, supports) of relations between mentions: the highest
    confidence, and the distinct supports (document_id, begin, end, source) in order, the last of each place."""
    ends = relations.join(of.select(F.col("mention_id").alias("subject"), F.col("entity_id").alias("s")), "subject").join(of.select(F.col("mention_id").alias("object"), F.col("entity_id").alias("o")), "object")
    one = ends.groupBy("s", "predicate", "o", "document_id", "begin", "end").agg(F.max("confidence").alias("confidence"), F.max("source_id").alias("source_id"))
    merged = one.groupBy(F.col("s").alias("subject"), "predicate", F.col("o").alias("object")).agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set(F.struct("document_id", "begin", "end", "source_id"))).alias("supports"))
    return merged.withColumn("relationship_id", uuid5(URL_NAMESPACE, F.concat_ws(":", F.lit(workspace), "subject", "predicate", "object")))


def find_anchors(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, entity_id, quality): entities of which a name or alias occurs in the question as whole words. The
    question's word n-grams meet the names by equality; they are as long as the longest name."""
    names = entities.select("entity_id", F.explode(F.array_union(F.array("normalized_name"), F.transform("aliases", normalize_name))).alias("name")).filter("name <> ''").distinct()
    longest = names.agg(F.coalesce(F.max(F.size(F.split("name", " "))), F.lit(0)).alias("longest"))  # one row
    words = F.split(normalize_name(F.col("question")), " ")
    q = questions.select("query_id", words.alias("w")).withColumn("n", F.size("w")).join(F.broadcast(longest), F.lit(True))
    starts = q.select("query_id", "w", "n", "longest", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).filter("longest > 0")
    spans = starts.select("query_id", "w", "n", "i", F.explode(F.sequence(F.lit(1), F.least("longest", F.col("n") - F.col("i") + 1))).alias("k"))
    grams = spans.select("query_id", "n", "k", F.array_join(F.slice("w", F.col("i"), F.col("k")), " ").alias("name"))
    return grams.join(names, "name").groupBy("query_id", "entity_id").agg(F.max(F.col("k") / F.col("n")).alias("quality"))


def walk_paths(anchors: DataFrame, relationships: DataFrame, hops: int = 2, sources: list[str] | None = None) -> DataFrame:
    """(query_id, quality, nodes, path, steps): simple undirected paths of 1 to ``hops`` edges from each anchor, over edges with
    a support in one of ``sources``. Walking begins at anchors, so a hub counts only where a path reaches it. ``steps`` holds
    each edge's predicate, confidence and number of supports, so that nobody has to look them up again."""
    if not 1 <= hops <= 4:
        raise ValueError("hops must be 1 to 4")
    if sources:
        relationships = relationships.filter(F.exists("supports", lambda s: s["source_id"].isin(sources)))
    step = F.struct("predicate", F.col("confidence").cast("double").alias("confidence"), F.size("supports").alias("n")).alias("step")
    ends = relationships.select("subject", "object", "relationship_id", step)
    edge = ends.select(F.col("subject").alias("at"), F.col("object").alias("to"), "relationship_id", "step").unionByName(ends.select(F.col("object").alias("at"), F.col("subject").alias("to"), "relationship_id", "step"))
    none = F.array().cast("array<struct<predicate:string,confidence:double,n:int>>")
    paths = anchors.select("query_id", "quality", F.array("entity_id").alias("nodes"), F.array().cast("array<string>").alias("path"), none.alias("steps"), F.col("entity_id").alias("at"))
    out = None
    for _ in range(hops):
        paths = paths.join(edge, "at").filter(~F.array_contains("nodes", F.col("to")) & ~F.array_contains("path", F.col("relationship_id")))
        paths = paths.select("query_id", "quality", F.array_append("nodes", F.col("to")).alias("nodes"), F.array_append("path", F.col("relationship_id")).alias("path"), F.array_append("steps", F.col("step")).alias("steps"), F.col("to").alias("at"))
        out = paths if out is None else out.unionByName(paths)
    return out.drop("at")


def score_paths(paths: DataFrame, questions: DataFrame) -> DataFrame:
    """Paths of ``walk_paths`` with path_id, a score and whether an edge of theirs has a support: 0.30 anchor + 0.25 predicate
    named in the question + 0.25 mean confidence + 0.10 support + 0.10 length, at most 1. A projection, but for the questions."""
    terms = F.create_map(*[x for k, v in PREDICATE_TERMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    asked = questions.select("query_id", F.split(normalize_name(F.col("question")), " ").alias("asked"))
    wanted = F.flatten(F.transform("steps", lambda s: F.coalesce(terms[s["predicate"]], F.array().cast("array<string>"))))
    mean = lambda name: F.aggregate("steps", F.lit(0.0), lambda total, s: total + s[name]) / F.size("steps")
    hit = F.arrays_overlap(wanted, "asked").cast("double")
    score = 0.30 * F.col("quality") + 0.25 * hit + 0.25 * F.round(mean("confidence"), 12) + 0.10 * F.least(F.lit(1.0), mean("n") / 2) + 0.10 * F.when(F.size("path") == 1, 1.0).otherwise(0.9)
    supported = F.exists("steps", lambda s: s["n"] > 0)
    scored = paths.join(asked, "query_id").withColumn("score", F.round(F.least(F.lit(1.0), score), 9))
    return scored.select("query_id", F.concat_ws(">", "path").alias("path_id"), "quality", "nodes", "path", "score", supported.alias("supported"))


def retrieve_graph(scored: DataFrame, k: int = 5, least: float = 0.0) -> DataFrame:
    """The best k distinct paths of each question with at least one support."""
    order = Window.partitionBy("query_id", "path_id").orderBy(F.desc("score"), F.array_join("nodes", ">"))
    live = scored.filter((F.col("score") >= least) & F.col("supported")).drop("supported")
    one = live.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "path_id")
    return one.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k)


def path_supports(paths: DataFrame, relationships: DataFrame) -> DataFrame:
    """(query_id, path_id, place, relationship_id, document_id, begin, end): edges by confidence, supports by place."""
    steps = paths.select("query_id", "path_id", F.explode("path").alias("relationship_id")).join(relationships.select("relationship_id", "confidence", F.explode("supports").alias("s")), "relationship_id")
    rows = steps.select("query_id", "path_id", "relationship_id", "confidence", "s.document_id", "s.begin", "s.end", "s.source_id").distinct()
    order = Window.partitionBy("query_id", "path_id").orderBy(F.desc("confidence"), "relationship_id", "source_id", "document_id", "begin", "end")
    return rows.withColumn("place", F.row_number().over(order).cast("long"))


def render_paths(paths: DataFrame, relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, path_id, text): names of the nodes with each predicate and its direction between them."""
    steps = paths.select("query_id", "path_id", "nodes", F.posexplode("path").alias("i", "relationship_id")).join(relationships.select("relationship_id", "subject", "predicate"), "relationship_id")
    steps = steps.withColumn("from", F.get("nodes", F.col("i"))).withColumn("entity_id", F.get("nodes", F.col("i") + 1))
    arrow = F.when(F.col("subject") == F.col("from"), F.concat(F.lit("— "), "predicate", F.lit(" → "))).otherwise(F.concat(F.lit("← "), "predicate", F.lit(" — ")))
    names = entities.select("entity_id", "canonical_name")
    parts = steps.withColumn("arrow", arrow).join(names, "entity_id").groupBy("query_id", "path_id").agg(F.array_sort(F.collect_list(F.struct("i", F.concat(F.lit(" "), "arrow", "canonical_name").alias("t")))).alias("parts"))
    first = paths.select("query_id", "path_id", F.get("nodes", F.lit(0)).alias("entity_id")).join(names, "entity_id").select("query_id", "path_id", "canonical_name")
    return parts.join(first, ["query_id", "path_id"]).select("query_id", "path_id", F.concat("canonical_name", F.array_join(F.transform("parts", lambda p: p["t"]), "")).alias("text"))


def pack_batches(docs: DataFrame, most_docs: int = 8, most_chars: int = 20_000) -> DataFrame:
    """(workspace_id, document_id, batch): greedy batches in order of document_id by workspace. Where one ends depends on all
    before it in its workspace, so a workspace's ids and lengths stream through one task in order, which holds one batch's
    counts; workspaces are packed apart."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, batch, n, chars = object(), 0, 0, 0
        for rows in batches:
            out = []
            for workspace, size in zip(rows.column("workspace_id").to_pylist(), rows.column("chars").to_pylist(), strict=True):
                if workspace != last:
                    last, batch, n, chars = workspace, 0, 0, 0
                elif n == most_docs or chars + size > most_chars:
                    batch, n, chars = batch + 1, 0, 0
                n, chars = n + 1, chars + size
                out.append(batch)
            yield pa.RecordBatch.from_arrays([rows.column("workspace_id"), rows.column("document_id"), pa.array(out, pa.int64())], ["workspace_id", "document_id", "batch"])

    sizes = docs.select("workspace_id", "document_id", F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("chars"))
    return sizes.repartition("workspace_id").sortWithinPartitions("workspace_id", "document_id").mapInArrow(pack, "workspace_id string, document_id long, batch long")


def graph_violations(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """(rule, detail): doubled ids, edges without an end, edges from an entity to itself, edges without support."""
    rule = lambda df, name, c: df.select(F.lit(name).alias("rule"), F.col(c).alias("detail"))
    ends = relationships.select("relationship_id", F.explode(F.array("subject", "object")).alias("entity_id"))
    return (
        rule(entities.groupBy("entity_id").count().filter("count > 1"), "doubled_entity", "entity_id")
        .unionByName(rule(relationships.groupBy("relationship_id").count().filter("count > 1"), "doubled_relationship", "relationship_id"))
        .unionByName(rule(ends.join(entities, "entity_id", "left_anti").select("relationship_id").distinct(), "dangling_edge", "relationship_id"))
        .unionByName(rule(relationships.filter("subject = object"), "self_edge", "relationship_id"))
        .unionByName(rule(relationships.filter(F.size("supports") == 0), "no_support", "relationship_id"))
    )


def graph_manifest(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row: counts, and a hash of all ids in order of their hashes, which needs no global sort of rows."""
    part = lambda df, c: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(c).cast("decimal(38,0)")).cast("string").alias("h"))
    e, r = part(entities, "entity_id"), part(relationships, "relationship_id")
    return e.select(F.col("n").alias("entities"), F.col("h").alias("eh")).join(F.broadcast(r.select(F.col("n").alias("relationships"), F.col("h").alias("rh"))), F.lit(True)).select("entities", "relationships", F.sha2(F.concat_ws(":", "eh", "rh"), 256).alias("checksum"))


def pending_extractions(documents: DataFrame, sources: DataFrame, done: DataFrame, version: str) -> DataFrame:
    """Documents of ready sources that are no databases and have no stored extraction; ``done`` (document_id, version) of
    another version fails the query."""
    if done.filter(F.col("version") != version).limit(1).count():
        raise ValueError("stored extractions are of another version")
    ready = sources.filter("status = 'ready' AND source_type <> 'database'").select("source_id")
    return documents.join(ready, "source_id", "left_semi").join(done.select("document_id"), "document_id", "left_anti")
