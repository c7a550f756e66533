"""Queries over the property graph: suppliers, customers, nations and regions as entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import normalize_name
from lodestone.operators import graph
from lodestone.plans.registry import query, table
from lodestone.plans.views import DOCS_NORM, docs_norm

UUID = "substr({d}, 1, 8) || '-' || substr({d}, 9, 4) || '-5' || substr({d}, 14, 3) || '-' || substr('89ab', CAST((strpos('0123456789abcdef', substr({d}, 17, 1)) - 1) % 4 + 1 AS BIGINT), 1) || substr({d}, 18, 3) || '-' || substr({d}, 21, 12)"


def uuid_sql(name: str) -> str:
    return UUID.format(d=f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))")


#: One mention of each supplier, of customers with shared aliases in groups of up to twelve, of nations (twice, by two spellings) and regions.
MENTIONS = """mentions AS (
SELECT s_suppkey AS mention_id, 'ORGANIZATION' AS entity_type, s_name || ' Limited' AS name, [s_name || ', Ltd.'] AS aliases, s_suppkey AS document_id FROM supplier
UNION ALL SELECT 10000000 + c_custkey, 'ORGANIZATION', c_name, ['group ' || CAST(c_custkey // 3 AS VARCHAR), CASE WHEN c_custkey % 12 = 11 THEN 'lone ' || c_custkey ELSE 'club ' || CAST((c_custkey + 1) // 3 AS VARCHAR) END], 10000000 + c_custkey FROM customer
UNION ALL SELECT 20000000 + n_nationkey, 'LOCATION', n_name, ['the ' || lower(n_name)], 20000000 + n_nationkey FROM nation
UNION ALL SELECT 21000000 + n_nationkey, 'LOCATION', 'The ' || n_name, [], 21000000 + n_nationkey FROM nation
UNION ALL SELECT 22000000 + r_regionkey, 'LOCATION', r_name || ' region', [r_name], 22000000 + r_regionkey FROM region)"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda n: table(spark, sf_dir, n)
    none = F.array().cast("array<string>")

    def part(df: DataFrame, base: int, key: str, kind: str, name, aliases) -> DataFrame:
        number = F.col(key).cast("long") + base
        return df.select(number.alias("mention_id"), F.lit(kind).alias("entity_type"), name.alias("name"), aliases.alias("aliases"), number.alias("document_id"), F.lit(0).cast("long").alias("begin"), F.length(name).cast("long").alias("end"))

    s, c, n, r = F.col("s_name"), F.col("c_custkey"), F.col("n_name"), F.col("r_name")
    third = lambda x: F.floor(x / 3).cast("string")
    return (
        part(read("supplier"), 0, "s_suppkey", "ORGANIZATION", F.concat(s, F.lit(" Limited")), F.array(F.concat(s, F.lit(", Ltd."))))
        .unionByName(part(read("customer"), 10_000_000, "c_custkey", "ORGANIZATION", F.col("c_name"), F.array(F.concat(F.lit("group "), third(c)), F.when(c % 12 == 11, F.concat(F.lit("lone "), c)).otherwise(F.concat(F.lit("club "), third(c + 1))))))
        .unionByName(part(read("nation"), 20_000_000, "n_nationkey", "LOCATION", n, F.array(F.concat(F.lit("the "), F.lower(n)))))
        .unionByName(part(read("nation"), 21_000_000, "n_nationkey", "LOCATION", F.concat(F.lit("The "), n), none))
        .unionByName(part(read("region"), 22_000_000, "r_regionkey", "LOCATION", F.concat(r, F.lit(" region")), F.array(r)))
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda n: table(spark, sf_dir, n)
    place = [F.lit(0).cast("long").alias("begin"), F.lit(9).cast("long").alias("end")]

    def part(df: DataFrame, subject, predicate: str, object_, confidence, source: str) -> DataFrame:
        return df.select(subject.cast("long").alias("subject"), F.lit(predicate).alias("predicate"), object_.cast("long").alias("object"), confidence.alias("confidence"), subject.cast("long").alias("document_id"), F.lit(source).alias("source_id"), *place)

    share = lambda c: 0.5 + (F.col(c) % 5) / 10
    return (
        part(read("supplier"), F.col("s_suppkey"), "LOCATED_IN", 20_000_000 + F.col("s_nationkey"), share("s_suppkey"), "suppliers")
        .unionByName(part(read("customer"), 10_000_000 + F.col("c_custkey"), "LOCATED_IN", 21_000_000 + F.col("c_nationkey"), share("c_custkey"), "customers"))
        .unionByName(part(read("nation"), 20_000_000 + F.col("n_nationkey"), "PART_OF", 22_000_000 + F.col("n_regionkey"), share("n_nationkey"), "nations"))
    )


RELATIONS = """relations AS (
SELECT s_suppkey AS subject, 'LOCATED_IN' AS predicate, 20000000 + s_nationkey AS object, 0.5::DOUBLE + (s_suppkey % 5) / 10.0::DOUBLE AS confidence, s_suppkey AS document_id, 'suppliers' AS source_id FROM supplier
UNION ALL SELECT 10000000 + c_custkey, 'LOCATED_IN', 21000000 + c_nationkey, 0.5::DOUBLE + (c_custkey % 5) / 10.0::DOUBLE, 10000000 + c_custkey, 'customers' FROM customer
UNION ALL SELECT 20000000 + n_nationkey, 'PART_OF', 22000000 + n_regionkey, 0.5::DOUBLE + (n_nationkey % 5) / 10.0::DOUBLE, 20000000 + n_nationkey, 'nations' FROM nation)"""
NORMAL = "array_to_string([CASE w WHEN 'incorporated' THEN 'inc' WHEN 'corporation' THEN 'corp' WHEN 'limited' THEN 'ltd' ELSE w END for w in string_split(trim(regexp_replace(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')], ' ')"
NAMES = f"""names AS (SELECT mention_id, entity_type, {NORMAL.format('n')} AS name FROM (SELECT mention_id, entity_type, unnest(list_concat([name], aliases)) AS n FROM mentions))"""
COMPONENTS = f"""{MENTIONS}, {NAMES}, hubs AS (SELECT entity_type, name, min(mention_id) AS hub FROM names GROUP BY 1, 2),
edges AS (SELECT DISTINCT mention_id AS a, hub AS b FROM names JOIN hubs USING (entity_type, name) WHERE mention_id <> hub), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT mention_id, mention_id FROM mentions UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a), comps AS (SELECT a AS mention_id, min(b) AS component FROM reach GROUP BY a)"""
ENTITIES = f"""{COMPONENTS}, cm AS (SELECT m.*, component FROM mentions m JOIN comps USING (mention_id)),
canon AS (SELECT component, min(entity_type) AS entity_type, first(name ORDER BY length(name), lower(name), name) AS canonical_name, count(DISTINCT document_id) AS n_mentions FROM cm GROUP BY 1),
named AS (SELECT *, {NORMAL.format('canonical_name')} AS normalized_name FROM canon),
others AS (SELECT DISTINCT component, other FROM (SELECT component, unnest(list_concat([name], aliases)) AS other FROM cm)),
al AS (SELECT component, string_agg(other, '|' ORDER BY lower(other), other) AS aliases FROM others JOIN named USING (component) WHERE {NORMAL.format('other')} <> normalized_name GROUP BY 1),
entities AS (SELECT component, {uuid_sql("'ws:' || entity_type || ':' || normalized_name")} AS entity_id, entity_type, canonical_name, normalized_name, coalesce(aliases, '') AS aliases, n_mentions FROM named LEFT JOIN al USING (component))"""
EDGES = f"""{ENTITIES}, {RELATIONS}, of_m AS (SELECT mention_id, entity_id FROM comps JOIN entities USING (component)),
rels AS (SELECT s.entity_id AS subject, predicate, o.entity_id AS object, max(confidence) AS confidence, count(DISTINCT document_id) AS n_supports, list(DISTINCT source_id) AS sources FROM relations r JOIN of_m s ON r.subject = s.mention_id JOIN of_m o ON r.object = o.mention_id GROUP BY 1, 2, 3),
relationships AS (SELECT *, {uuid_sql("'ws:' || subject || ':' || predicate || ':' || object")} AS relationship_id FROM rels)"""
#: Questions name a region and a nation.
GRAPH_QUESTIONS = "gq AS (SELECT n_nationkey AS query_id, 'Which suppliers are located in ' || n_name || ' or the ' || r_name || ' region?' AS question FROM nation JOIN region ON n_regionkey = r_regionkey)"
ANCHORS = f"""{EDGES}, {GRAPH_QUESTIONS}, qw AS (SELECT query_id, string_split({NORMAL.format('question')}, ' ') AS w FROM gq),
keys AS (SELECT DISTINCT entity_id, {NORMAL.format('k')} AS name FROM (SELECT entity_id, unnest(list_concat([canonical_name], CASE aliases WHEN '' THEN [] ELSE string_split(aliases, '|') END)) AS k FROM entities)),
anchors AS (SELECT query_id, entity_id, max(len(string_split(name, ' ')) / len(w)) AS quality FROM qw, keys WHERE name <> '' AND contains(' ' || array_to_string(w, ' ') || ' ', ' ' || name || ' ') GROUP BY 1, 2)"""
PATHS = f"""{ANCHORS}, ends AS (SELECT subject AS f, object AS t, relationship_id FROM relationships UNION ALL SELECT object, subject, relationship_id FROM relationships),
p1 AS (SELECT query_id, quality, [entity_id, t] AS nodes, [relationship_id] AS path FROM anchors JOIN ends ON entity_id = f WHERE t <> entity_id),
p2 AS (SELECT query_id, quality, list_append(nodes, t), list_append(path, relationship_id) FROM p1 JOIN ends ON nodes[2] = f WHERE NOT list_contains(nodes, t) AND NOT list_contains(path, relationship_id)),
paths AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2)"""
SCORED = f"""{PATHS}, steps AS (SELECT DISTINCT query_id, array_to_string(path, '>') AS path_id, unnest(path) AS relationship_id FROM paths),
facts AS (SELECT query_id, path_id, round(avg(confidence), 12) AS confidence, avg(n_supports) AS n, list(DISTINCT predicate) AS predicates FROM steps JOIN relationships USING (relationship_id) GROUP BY 1, 2),
scored AS (SELECT p.query_id, path_id, nodes, path, round(least(1.0, 0.30 * quality + 0.25 * CASE WHEN list_contains(predicates, 'LOCATED_IN') AND len(list_intersect(w, ['located', 'location', 'where'])) > 0 OR list_contains(predicates, 'PART_OF') AND len(list_intersect(w, ['part', 'belongs'])) > 0 THEN 1 ELSE 0 END
 + 0.25 * f.confidence + 0.10 * least(1.0, n / 2) + 0.10 * CASE WHEN len(path) = 1 THEN 1.0 ELSE 0.9 END), 9) AS score FROM (SELECT *, array_to_string(path, '>') AS path_id FROM paths) p JOIN facts f USING (query_id, path_id) JOIN qw USING (query_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path_id ORDER BY score DESC, array_to_string(nodes, '>')) AS nth FROM scored) WHERE nth = 1),
top AS (SELECT query_id, path_id, nodes, path, score, rank FROM best WHERE rank <= 5)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.lit("Which suppliers are located in "), "n_name", F.lit(" or the "), "r_name", F.lit(" region?")).alias("question"))


def entities_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = mentions(spark, sf_dir)
    return graph.canonicalize(m, graph.resolve_entities(m), "ws")


def graph_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    entities, of = entities_of(spark, sf_dir)
    return graph.cut(entities), graph.cut(graph.aggregate_relationships(relations(spark, sf_dir), of, "ws"))


def top_paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    entities, edges = graph_of(spark, sf_dir)
    asked = questions(spark, sf_dir)
    scored = graph.score_paths(graph.walk_paths(graph.find_anchors(asked, entities), edges), asked)
    return graph.retrieve_graph(scored), scored, edges, entities


@query(f"WITH {DOCS_NORM}, s AS (SELECT document_id, CASE WHEN document_id % 3 = 0 THEN 'not in there at all' ELSE ' ' || substr(content, 20, 30) || ' ' END AS support, content FROM docs_norm) SELECT document_id, strpos(content, trim(support)) - 1 AS \"begin\", strpos(content, trim(support)) - 1 + length(trim(support)) AS \"end\" FROM s WHERE strpos(content, trim(support)) > 0")
def locate_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("document_id") % 3 == 0, "not in there at all").otherwise(F.concat(F.lit(" "), F.substring("content", 20, 30), F.lit(" ")))
    return graph.locate_support(docs_norm(spark, sf_dir).withColumn("support", text), "support", "content").select("document_id", "begin", "end")


@query(f"WITH {MENTIONS} SELECT mention_id, {NORMAL.format('name')} AS name FROM mentions")
def normalize_entity_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir).select("mention_id", normalize_name(F.col("name")).alias("name"))


@query("SELECT 'unknown_document' AS rule, CAST(s_suppkey AS VARCHAR) AS detail FROM supplier WHERE s_suppkey % 10 = 0 UNION ALL SELECT 'unknown_document', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 10 = 0 AND s_suppkey < 4 UNION ALL SELECT DISTINCT 'unknown_endpoint', CAST(20000000 + s_nationkey AS VARCHAR) FROM supplier UNION ALL SELECT 'doubled_reference', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey < 4")
def validate_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = mentions(spark, sf_dir).filter("mention_id < 10000000")
    own = own.unionByName(own.filter("mention_id < 4"))
    known = table(spark, sf_dir, "supplier").filter("s_suppkey % 10 <> 0").select(F.col("s_suppkey").alias("document_id"))
    return graph.invalid_extractions(own, relations(spark, sf_dir).filter("source_id = 'suppliers'"), known)


@query(f"WITH RECURSIVE {COMPONENTS} SELECT mention_id, component FROM comps")
def resolve_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolve_entities(mentions(spark, sf_dir))


@query(f"WITH RECURSIVE {ENTITIES} SELECT entity_id, entity_type, canonical_name, normalized_name, aliases, n_mentions FROM entities")
def canonicalize_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entities_of(spark, sf_dir)[0]
    return found.select("entity_id", "entity_type", "canonical_name", "normalized_name", F.array_join("aliases", "|").alias("aliases"), F.size("mentions").cast("long").alias("n_mentions"))


@query(f"WITH RECURSIVE {EDGES} SELECT relationship_id, subject, predicate, object, round(confidence, 6) AS confidence, n_supports FROM relationships")
def aggregate_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_of(spark, sf_dir)[1].select("relationship_id", "subject", "predicate", "object", F.round("confidence", 6).alias("confidence"), F.size("supports").cast("long").alias("n_supports"))


@query(f"WITH RECURSIVE {ANCHORS} SELECT query_id, entity_id, round(quality, 6) AS quality FROM anchors")
def find_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.find_anchors(questions(spark, sf_dir), entities_of(spark, sf_dir)[0]).withColumn("quality", F.round("quality", 6))


@query(f"WITH RECURSIVE {PATHS} SELECT query_id, array_to_string(nodes, '>') AS nodes, array_to_string(path, '>') AS path FROM paths")
def walk_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, edges = graph_of(spark, sf_dir)
    found = graph.walk_paths(graph.find_anchors(questions(spark, sf_dir), entities), edges)
    return found.select("query_id", F.array_join("nodes", ">").alias("nodes"), F.array_join("path", ">").alias("path"))


@query(f"WITH RECURSIVE {SCORED} SELECT query_id, path_id, array_to_string(nodes, '>') AS nodes, round(score, 6) AS score FROM scored")
def score_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_paths(spark, sf_dir)[1].select("query_id", "path_id", F.array_join("nodes", ">").alias("nodes"), F.round("score", 6).alias("score"))


@query(f"WITH RECURSIVE {SCORED} SELECT query_id, path_id, rank, round(score, 6) AS score FROM top")
def retrieve_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_paths(spark, sf_dir)[0].select("query_id", "path_id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE {SCORED}, st AS (SELECT query_id, path_id, unnest(path) AS relationship_id FROM top),
places AS (SELECT DISTINCT s.entity_id AS subject, predicate, o.entity_id AS object, document_id, source_id FROM relations r JOIN of_m s ON r.subject = s.mention_id JOIN of_m o ON r.object = o.mention_id),
merged AS (SELECT subject, predicate, object, document_id, max(source_id) AS source_id FROM places GROUP BY 1, 2, 3, 4)
SELECT st.query_id, st.path_id, relationship_id, confidence, document_id, 0 AS "begin", 9 AS "end", source_id,
row_number() OVER (PARTITION BY st.query_id, st.path_id ORDER BY confidence DESC, relationship_id, source_id, document_id) AS place
FROM (SELECT DISTINCT * FROM st) st JOIN relationships USING (relationship_id) JOIN merged USING (subject, predicate, object)""")
def path_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    best, _, edges, _ = top_paths(spark, sf_dir)
    return graph.path_supports(best, edges)


@query(f"""WITH RECURSIVE {SCORED}, st AS (SELECT query_id, path_id, nodes, unnest(path) AS relationship_id, generate_subscripts(path, 1) AS i FROM top),
parts AS (SELECT query_id, path_id, string_agg(CASE WHEN subject = nodes[i] THEN ' — ' || predicate || ' → ' ELSE ' ← ' || predicate || ' — ' END || canonical_name, '' ORDER BY i) AS rest FROM st JOIN relationships USING (relationship_id) JOIN entities ON entity_id = nodes[i + 1] GROUP BY 1, 2)
SELECT query_id, path_id, canonical_name || rest AS text FROM parts JOIN top USING (query_id, path_id) JOIN entities ON entity_id = nodes[1]""")
def render_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    best, _, edges, entities = top_paths(spark, sf_dir)
    return graph.render_paths(best, edges, entities)


@query(f"""WITH RECURSIVE {DOCS_NORM}, o AS (SELECT workspace_id, document_id, length(content) AS chars, row_number() OVER (PARTITION BY workspace_id ORDER BY document_id) AS i FROM docs_norm),
b(workspace_id, i, document_id, batch, n, chars) AS (SELECT workspace_id, i, document_id, 0, 1, chars FROM o WHERE i = 1
UNION ALL SELECT o.workspace_id, o.i, o.document_id, CASE WHEN b.n = 8 OR b.chars + o.chars > 20000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.n = 8 OR b.chars + o.chars > 20000 THEN 1 ELSE b.n + 1 END, CASE WHEN b.n = 8 OR b.chars + o.chars > 20000 THEN o.chars ELSE b.chars + o.chars END
FROM b JOIN o ON o.workspace_id = b.workspace_id AND o.i = b.i + 1) SELECT workspace_id, document_id, batch FROM b""")
def pack_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pack_batches(docs_norm(spark, sf_dir))


@query(f"WITH RECURSIVE {EDGES} SELECT 'self_edge' AS rule, relationship_id AS detail FROM relationships WHERE subject = object UNION ALL SELECT 'dangling_edge', relationship_id FROM relationships WHERE subject IN (SELECT entity_id FROM entities WHERE entity_type = 'LOCATION') OR object IN (SELECT entity_id FROM entities WHERE entity_type = 'LOCATION')")
def validate_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, edges = graph_of(spark, sf_dir)
    return graph.graph_violations(entities.filter("entity_type <> 'LOCATION'"), edges)


@query("SELECT doc_id AS document_id FROM documents WHERE source NOT IN ('src4', 'src5') AND doc_id % 4 <> 0")
def graph_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_norm(spark, sf_dir).select("document_id", "source_id")
    kinds = docs.select("source_id").distinct().select("source_id", F.when(F.col("source_id") == "src5", "failed").otherwise("ready").alias("status"), F.when(F.col("source_id") == "src4", "database").otherwise("pdf").alias("source_type"))
    done = docs.filter("document_id % 4 = 0").select("document_id", F.lit("v1").alias("version"))
    return graph.pending_extractions(docs, kinds, done, "v1").select("document_id")
