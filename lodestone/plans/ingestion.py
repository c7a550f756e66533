"""Queries over ingestion operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import URL_NAMESPACE, collapse_whitespace, injection_labels, redact, split_sentences, uuid5
from lodestone.functions.urls import host_of, normalize_url
from lodestone.operators import ingest
from lodestone.plans.registry import query, table
from lodestone.plans.views import DOCS_NORM, DOCS_TAGGED, docs_norm, docs_tagged
from lodestone.checkpoints import fresh_folder
from lodestone.sources import csv as csv_sources
from lodestone.sources import files
from lodestone.sources.csv import infer_types

CHUNKS = """{name}(key1, key2, key3, n, text, s, e) AS (
  SELECT key1, key2, key3, 0, text, 0, CASE WHEN length(text) <= 1200 THEN length(text) ELSE {cut0} END FROM {source} WHERE text <> ''
  UNION ALL
  SELECT key1, key2, key3, n + 1, text, s2, CASE WHEN s2 + 1200 >= length(text) THEN length(text) ELSE {cut} END
  FROM (SELECT key1, key2, key3, n, text, e, CASE WHEN substr(text, greatest(e - 200, s + 1) + 1, 1) = ' ' THEN greatest(e - 200, s + 1) + 1 ELSE greatest(e - 200, s + 1) END AS s2
        FROM {name} WHERE e < length(text)))"""


def _cut(s: str) -> str:
    """The end of a chunk that starts at s: the last space in (s + 1 .. s + 1200], or s + 1200 without one."""
    window = f"substr(text, {s} + 2, 1200)"
    return f"CASE WHEN strpos(reverse({window}), ' ') > 0 THEN {s} + 1 + length({window}) - strpos(reverse({window}), ' ') ELSE {s} + 1200 END"


def chunk_sql(name: str, source: str) -> str:
    return CHUNKS.format(name=name, source=source, cut0=_cut("0"), cut=_cut("s2"))


FLAT = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


@query(f"WITH {DOCS_NORM} SELECT document_id, workspace_id, source_id, source_type, title, content FROM docs_norm")
def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_norm(spark, sf_dir)


@query("SELECT doc_id AS document_id, lang AS workspace_id, source AS source_id, text AS content FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2')")
def write_and_read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written by workspace and source; two sources of one workspace read again, from their folders only."""
    path = f"{fresh_folder(spark)}/documents"
    files.write_documents(docs_norm(spark, sf_dir).select("document_id", "workspace_id", "source_id", "content"), path)
    parts = [files.read_documents(spark, path, "en", s) for s in ("src1", "src2")]
    return parts[0].unionByName(parts[1]).select("document_id", "workspace_id", "source_id", "content")


def written_csv(spark: SparkSession, sf_dir: str) -> str:
    """Files of ``part`` as CSV, with quotes, line ends and empty fields in them: as many as the contract of files needs."""
    folder = f"{fresh_folder(spark)}/csv"
    part = table(spark, sf_dir, "part").withColumn("p_name", F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit('say "'), "p_name", F.lit('",\nthen'))).otherwise(F.col("p_name")))
    part = part.withColumn("p_brand", F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand")))
    csv_sources.write_csv(part, f"{folder}/part")
    return folder


TEXT_PART = "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'say \"' || p_name || '\",' || chr(10) || 'then' ELSE p_name END AS p_name, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size FROM part"


@query(TEXT_PART)
def read_csv_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = csv_sources.read_csv_strict(spark, f"{written_csv(spark, sf_dir)}/part")
    return rows.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


@query(f"""WITH t AS ({TEXT_PART}) SELECT "column", CASE "column" WHEN 'p_partkey' THEN 'integer' WHEN 'p_size' THEN 'integer' ELSE 'text' END AS type, (SELECT count(*) FROM t) AS row_count, sample FROM
(SELECT unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size']) AS "column", unnest([list(p_partkey), list(p_name), list(p_brand), list(p_type), list(p_size)]) AS sample FROM (SELECT * FROM t ORDER BY CAST(p_partkey AS BIGINT) LIMIT 3))""")
def csv_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = csv_sources.read_csv_strict(spark, f"{written_csv(spark, sf_dir)}/part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return csv_sources.preview(rows.withColumn("_at", F.col("p_partkey").cast("long")), ["_at"], 3)


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 10 AS k, row_number() OVER (PARTITION BY o_orderkey % 10 ORDER BY o_orderkey) AS r FROM orders)
SELECT CAST(k AS INTEGER) AS file, r AS "row", CASE WHEN o_orderkey % 110 = k THEN 'field_count' WHEN length(o_orderkey::VARCHAR) > 4 THEN 'long_field' END AS rule, CASE WHEN o_orderkey % 110 = k THEN '1 of 2' WHEN length(o_orderkey::VARCHAR) > 4 THEN 'key' END AS detail FROM o WHERE o_orderkey % 110 = k OR length(o_orderkey::VARCHAR) > 4
UNION ALL SELECT CAST(k AS INTEGER), -1, 'too_many_rows', 'more than 1000' FROM o GROUP BY k HAVING count(*) > 1000""")
def csv_contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten files of orders, in which some records lack a field and some fields are longer than the contract allows; all faults."""
    folder = f"{fresh_folder(spark)}/csv"
    k = (F.col("o_orderkey") % 10).cast("int")
    line = F.when(F.col("o_orderkey") % 110 == k, F.col("o_orderkey").cast("string")).otherwise(F.concat("o_orderkey", F.lit(","), "o_orderstatus"))
    lines = table(spark, sf_dir, "orders").select(k.alias("k"), F.col("o_orderkey").alias("at"), line.alias("value"))
    heads = spark.range(10).select(F.col("id").cast("int").alias("k"), F.lit(-1).cast("long").alias("at"), F.lit(" key ,kind").alias("value"))
    # One file for each k: its lines are dealt by k and sorted.
    lines.unionByName(heads).repartition(10, "k").sortWithinPartitions("k", "at").select("k", "value").write.partitionBy("k").option("compression", "none").text(folder)
    found = csv_sources.csv_records(spark, renamed(spark, folder, ".txt", ".csv"), csv_sources.Contract(most_rows=1000, longest=4))
    return csv_sources.csv_faults(found).select(F.regexp_extract("file", r"/k=(\d+)/", 1).cast("int").alias("file"), "row", "rule", "detail")


def renamed(spark: SparkSession, folder: str, old: str, new: str, where: str = "") -> str:
    """Gives the files below a folder (whose paths match ``where``) another ending: Spark names what it writes by format."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for row in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path").filter(F.col("path").endswith(old) & F.col("path").rlike(where)).collect():
        fs.rename(path(row[0]), path(row[0].removesuffix(old) + new))
    return folder


@query("""WITH f AS (SELECT source, CAST(doc_id % 3 AS INTEGER) AS kind, 9 + sum(length(doc_id::VARCHAR) + 1)::BIGINT AS length FROM documents GROUP BY ALL)
SELECT source, kind, length, CASE WHEN kind = 2 THEN 'extension' WHEN length > 75 THEN 'too_large' WHEN kind = 1 THEN 'magic' ELSE 'kept' END AS status FROM f""")
def file_inventory_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files for each source, with the ids of its documents: one that begins as PDF does, one that does not, one of another kind."""
    folder = f"{fresh_folder(spark)}/files"
    ids = table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 3).cast("int").alias("kind"), "doc_id")
    heads = ids.select("source", "kind").distinct().select("source", "kind", F.lit(-1).cast("long").alias("doc_id"))
    line = F.when(F.col("doc_id") >= 0, F.col("doc_id").cast("string")).when(F.col("kind") == 1, "%PDX-1.7").otherwise("%PDF-1.7")
    rows = ids.unionByName(heads).repartition("source", "kind").sortWithinPartitions("source", "kind", "doc_id")
    rows.select("source", "kind", line.alias("value")).write.partitionBy("source", "kind").option("compression", "none").text(folder)
    found = files.file_inventory(spark, renamed(spark, folder, ".txt", ".pdf", "/kind=[01]/"), "pdf", 75)
    return found.select(F.regexp_extract("path", "/source=([^/]+)/", 1).alias("source"), F.regexp_extract("path", "/kind=(\\d)/", 1).cast("int").alias("kind"), "length", "status")


@query("""WITH s AS (SELECT lang AS workspace_id, source AS source_id, min(doc_id) AS created, count(*) AS documents FROM documents GROUP BY 1, 2)
SELECT workspace_id, source_id, created, documents, row_number() OVER (PARTITION BY workspace_id ORDER BY created, source_id) AS place FROM s""")
def list_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = docs_norm(spark, sf_dir).groupBy("workspace_id", "source_id").agg(F.min("document_id").alias("created"), F.count("*").alias("documents"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("workspace_id").orderBy("created", "source_id")).cast("long"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE source = 'src3' ORDER BY doc_id LIMIT 20 OFFSET 10")
def list_documents_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("source = 'src3'").select("doc_id", "source", "n_chars").orderBy("doc_id").offset(10).limit(20)


#: A column's type by its values, as the reading of text has it.
TYPED = """SELECT "column", CASE WHEN count(v) = 0 THEN 'text' WHEN bool_and(regexp_matches(v, '(?i)^(true|false|yes|no)$')) THEN 'boolean' WHEN bool_and(regexp_matches(v, '^[+-]?\\d+$')) THEN 'integer'
WHEN bool_and(regexp_matches(v, '^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?$')) THEN 'decimal' WHEN bool_and(regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}') AND TRY_CAST(v AS TIMESTAMP) IS NOT NULL) THEN 'datetime'
WHEN bool_and(regexp_matches(v, '^\\d{4}-\\d{2}-\\d{2}$') AND TRY_CAST(v AS DATE) IS NOT NULL) THEN 'date' ELSE 'text' END AS type"""


@query(f"""{TYPED} FROM (SELECT unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice', 'is_large', 'nothing']) AS "column",
unnest([p_partkey::VARCHAR, p_name, p_brand, p_type, p_size::VARCHAR, p_retailprice::VARCHAR, (p_size > 25)::VARCHAR, NULL]) AS v FROM part) GROUP BY 1""")
def infer_csv_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    text = part.select(*[F.col(c).cast("string").alias(c) for c in part.columns], (F.col("p_size") > 25).cast("string").alias("is_large"), F.lit(None).cast("string").alias("nothing"))
    return infer_types(text)


@query("""SELECT 'row_id_doubled' AS rule, o_custkey AS detail FROM (SELECT CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 5)
UNION ALL SELECT 'unknown_column', 'o_note'""")
def validate_column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.column_roles(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_note"], "o_custkey")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS row_id, 'part' AS title, 'p_name: ' || p_name || chr(10) || 'p_brand: ' || p_brand || CASE WHEN p_size > 10 THEN chr(10) || 'p_size: ' || p_size ELSE '' END AS content,
p_type AS kind FROM part""")
def rows_as_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("p_size", F.when(F.col("p_size") > 10, F.col("p_size")))
    out = ingest.rows_as_documents(part, ["p_name", "p_brand", "p_size"], "p_partkey", "part")
    return out.select("row_id", "title", "content", F.col("metadata")["p_type"].alias("kind"))


@query(f"SELECT doc_id, {FLAT.format('text')} AS flat FROM documents")
def collapse_whitespace_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", collapse_whitespace("text").alias("flat"))


@query(f"""WITH RECURSIVE flat AS (SELECT doc_id AS key1, 0 AS key2, 0 AS key3, {FLAT.format('text')} AS text FROM documents),
{chunk_sql('c', 'flat')}
SELECT key1 AS doc_id, n AS part, trim(substr(text, s + 1, e - s)) AS chunk FROM c WHERE trim(substr(text, s + 1, e - s)) <> ''""")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parts = docs.select("doc_id", F.posexplode(ingest.chunk_text(collapse_whitespace("text"))).alias("part", "chunk"))
    return parts.select("doc_id", F.col("part").cast("long").alias("part"), "chunk")


@query(f"""WITH RECURSIVE lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position FROM documents),
flat AS (SELECT source AS key1, doc_id * 1000 + position // 10 AS key2, position AS key3, {FLAT.format('line')} AS text FROM lines),
{chunk_sql('c', 'flat')}
SELECT key1 AS source, key2 AS page, key3 AS position, n AS page_chunk, trim(substr(text, s + 1, e - s)) AS chunk,
row_number() OVER (PARTITION BY key1 ORDER BY key2, key3, n) - 1 AS chunk_index FROM c""")
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("position", "text"))
    position = F.col("position").cast("long")
    return ingest.chunk_pages(lines.select("source", (F.col("doc_id") * 1000 + F.floor(position / 10)).alias("page"), position.alias("position"), "text"))


@query(f"""WITH RECURSIVE lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS row_id FROM documents),
flat AS (SELECT doc_id AS key1, row_id AS key2, 0 AS key3, {FLAT.format('line')} AS text FROM lines),
{chunk_sql('c', 'flat')}
SELECT key1 AS doc_id, key2 AS row_id, n AS part, trim(substr(text, s + 1, e - s)) AS chunk FROM c""")
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.chunk_paragraphs(table(spark, sf_dir, "documents"))


@query("""WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('doc:' || doc_id)) AS d FROM documents)
SELECT doc_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab', CAST((strpos('0123456789abcdef', substr(d, 17, 1)) - 1) % 4 + 1 AS BIGINT), 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS id FROM h""")
def stable_document_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", uuid5(URL_NAMESPACE, F.concat(F.lit("doc:"), F.col("doc_id"))).alias("id"))


#: Visible text of the test pages, which nest no hidden elements and hold few kinds of references.
VISIBLE = "regexp_replace(html, '<!--.*?-->', ' ', 'gs')"
for _tag in ingest.HIDDEN:
    VISIBLE = f"regexp_replace({VISIBLE}, '<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', ' ', 'gis')"


def unescaped(x: str) -> str:
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"regexp_replace({x}, '{name}?', '{sign}', 'g')"
    return f"nullif(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '')"


PAGES = f"""extracted AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host, {unescaped("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')")} AS title,
{unescaped(f"regexp_replace({VISIBLE}, '<[/!?]?[A-Za-z][^>]*>', ' ', 'g')")} AS text, len(regexp_extract_all(html, '<a\\s[^>]*href=["''][^"'']*[^"''\\s][^"'']*["'']', 0, 'i')) AS n_links FROM pages)"""


@query(f"WITH {PAGES} SELECT page_id, url, title, text, url AS canonical, n_links FROM extracted")
def extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", ingest.extract_html(F.col("html"), F.col("url")).alias("p"))
    return pages.select("page_id", "url", "p.title", "p.text", "p.canonical", F.size("p.links").cast("long").alias("n_links"))


@query(f"""WITH RECURSIVE {PAGES}, flat AS (SELECT host AS key1, page_id AS key2, 0 AS key3, text FROM extracted WHERE text IS NOT NULL), {chunk_sql('c', 'flat')}
SELECT key1 AS source, key2 AS page, key3 AS position, n AS page_chunk, trim(substr(text, s + 1, e - s)) AS chunk, row_number() OVER (PARTITION BY key1 ORDER BY key2, key3, n) - 1 AS chunk_index FROM c""")
def chunk_web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("source"), ingest.extract_html(F.col("html")).alias("p"))
    return ingest.chunk_pages(pages.filter("p.text is not null").select("source", F.col("page_id").alias("page"), F.lit(0).alias("position"), F.col("p.text").alias("text")))


URLS = """urls AS (SELECT page_id, CASE page_id % 6 WHEN 1 THEN upper(split_part(url, '://', 1)) || '://' || split_part(url, '://', 2) || '#top' WHEN 2 THEN 'ftp://' || split_part(url, '://', 2)
WHEN 3 THEN split_part(url, '://', 1) || '://user:pw@' || split_part(url, '://', 2) WHEN 4 THEN 'https://Example.com:8443/x' WHEN 5 THEN 'https://Example.com' ELSE url END AS url FROM pages)"""


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest, scheme, k = F.substring_index("url", "://", -1), F.substring_index("url", "://", 1), F.col("page_id") % 6
    new = (
        F.when(k == 1, F.concat(F.upper(scheme), F.lit("://"), rest, F.lit("#top"))).when(k == 2, F.concat(F.lit("ftp://"), rest)).when(k == 3, F.concat(scheme, F.lit("://user:pw@"), rest))
        .when(k == 4, "https://Example.com:8443/x").when(k == 5, "https://Example.com").otherwise(F.col("url"))
    )
    return table(spark, sf_dir, "pages").select("page_id", new.alias("url"))


@query(f"""WITH {URLS}, p AS (SELECT page_id, lower(split_part(url, '://', 1)) AS scheme, regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^#]*)', 1) AS rest FROM urls)
SELECT page_id, CASE WHEN scheme NOT IN ('http', 'https') OR contains(host, '@') OR host LIKE '%:8443' THEN NULL
ELSE scheme || '://' || lower(host) || CASE WHEN rest = '' OR rest[1] = '?' THEN '/' || rest ELSE rest END END AS url FROM p""")
def normalize_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls(spark, sf_dir).select("page_id", normalize_url(F.col("url")).alias("url"))


@query("""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host FROM pages)
SELECT page_id, host FROM h WHERE host LIKE '%.example' OR host = 'example' OR host LIKE '%1.example.com' OR host LIKE '%.site2.example.org' OR host = 'site2.example.org'
OR host IN (SELECT host FROM h WHERE page_id < 3) OR EXISTS (SELECT 1 FROM h g WHERE g.page_id < 3 AND ends_with(h.host, '.' || g.host))""")
def domain_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    own = pages.filter("page_id < 3").select(F.concat(F.lit("*."), host_of(F.col("url"))).alias("pattern"))
    fixed = spark.createDataFrame([("*.example",), ("site2.example.org",)], "pattern string")
    return ingest.allowed_pages(pages, own.union(fixed)).select("page_id", host_of(F.col("url")).alias("host"))


@query("""WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host, regexp_replace(url, '^[A-Za-z]+://[^/]*', '') AS path FROM pages),
rules AS (SELECT DISTINCT host, r.priority, r.prefix, r.allow FROM h, (VALUES (1, '/p/1', true), (2, '/p', false), (3, '/', true)) r(priority, prefix, allow)),
m AS (SELECT page_id, arg_min(allow, priority) AS allow FROM h JOIN rules USING (host) WHERE starts_with(path, prefix) GROUP BY page_id)
SELECT h.page_id, url, coalesce(allow, true) AS allowed FROM h LEFT JOIN m USING (page_id)""")
def robots_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    hosts = pages.select(host_of(F.col("url")).alias("host")).distinct()
    fixed = F.array(*[F.struct(F.lit(p).alias("priority"), F.lit(x).alias("prefix"), F.lit(a).alias("allow")) for p, x, a in ((1, "/p/1", True), (2, "/p", False), (3, "/", True))])
    return ingest.robots_verdicts(pages, hosts.select("host", F.explode(fixed).alias("r")).select("host", "r.*"))


@query("""WITH RECURSIVE links AS (SELECT p.page_id AS src, q.page_id AS dst FROM pages p JOIN pages q ON q.page_id IN (p.page_id * 2 + 1, p.page_id * 2 + 2, p.page_id + 7)),
reach(node, depth) AS (SELECT page_id, 0 FROM pages WHERE page_id < 2 UNION SELECT dst, depth + 1 FROM reach JOIN links ON node = src WHERE depth < 12),
nearest AS (SELECT node, min(depth) AS depth FROM reach GROUP BY 1) SELECT node, depth, row_number() OVER (ORDER BY depth, node) AS place FROM nearest ORDER BY depth, node LIMIT 100""")
def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id")
    p = F.col("page_id")
    links = pages.select(p.alias("src"), F.explode(F.array(p * 2 + 1, p * 2 + 2, p + 7)).alias("dst"))
    return ingest.crawl_order(links.join(pages, links.dst == pages.page_id, "left_semi"), pages.filter("page_id < 2").withColumnRenamed("page_id", "node"), 100)


@query("""WITH b AS (SELECT lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)) AS base, regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^#]*)', 1) AS rest, html FROM pages),
n AS (SELECT base, base || CASE WHEN rest = '' OR rest[1] = '?' THEN '/' || rest ELSE rest END AS url, html FROM b), seeds AS (SELECT DISTINCT split_part(base, '://', 2) AS host, url FROM n),
first AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY url) AS place FROM seeds), links AS (SELECT DISTINCT url AS src, base || unnest(regexp_extract_all(html, '<a\\s[^>]*href=["'']([^"'']*[^"''\\s][^"'']*)["'']', 1, 'i')) AS dst FROM n),
found AS (SELECT DISTINCT host, dst AS url FROM first JOIN links ON src = url WHERE place <= 20 AND dst NOT IN (SELECT url FROM seeds)), sizes AS (SELECT host, count(*) AS n FROM seeds GROUP BY 1),
second AS (SELECT f.host, url, n + row_number() OVER (PARTITION BY f.host ORDER BY url) AS place FROM found f JOIN sizes s ON s.host = f.host)
SELECT host, url, 0 AS depth, place FROM first WHERE place <= 20 UNION ALL SELECT host, url, 1, place FROM second WHERE place <= 20""")
def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each host crawled from its stored pages over the links that are in them."""
    pages = table(spark, sf_dir, "pages").select("url", "html")
    return ingest.crawl_hosts(ingest.page_links(pages), pages.select(normalize_url(F.col("url")).alias("url")), 20)


@query("""WITH p AS (SELECT doc_id, 'u' || (doc_id % 700) AS url, text FROM documents), a AS (SELECT doc_id, url, sha256(text) AS sha, row_number() OVER (PARTITION BY url ORDER BY doc_id) AS nth FROM p),
b AS (SELECT doc_id, url, nth, row_number() OVER (PARTITION BY sha, nth = 1 ORDER BY doc_id) AS c FROM a)
SELECT doc_id, url, CASE WHEN nth > 1 THEN 'duplicate_url' WHEN c > 1 THEN 'duplicate_content' ELSE 'kept' END AS status FROM b""")
def dedup_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("u"), F.col("doc_id") % 700).alias("url"), "text")
    return ingest.dedup_pages(pages, "url", "text", "doc_id").select("doc_id", "url", "status")


@query("""WITH h AS (SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS seed, page_id FROM pages)
SELECT seed, count(*) AS fetched, count(*) FILTER (page_id % 7 <> 0) AS indexed, coalesce(string_agg(page_id || ':empty', ',' ORDER BY page_id) FILTER (page_id % 7 = 0), '') AS failures FROM h GROUP BY seed""")
def crawl_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = table(spark, sf_dir, "pages").select(host_of(F.col("url")).alias("seed"), "page_id", (F.col("page_id") % 7 == 0).alias("failed"))
    failures = F.transform(F.array_sort(F.collect_list(F.when(F.col("failed"), F.col("page_id")))), lambda p: F.concat(p, F.lit(":empty")))
    return status.groupBy("seed").agg(F.count("*").alias("fetched"), F.count_if(~F.col("failed")).alias("indexed"), F.array_join(failures, ",").alias("failures"))


INJECTION_SQL = """CASE WHEN regexp_matches(text, '(?i)\\b(reveal|print|repeat|exfiltrate|leak|send)\\b[^.\\n]{0,40}\\b(system prompt|instructions|api key|secret|credentials?)\\b') THEN ['exfiltration-request'] ELSE [] END
|| CASE WHEN regexp_matches(text, '(?i)\\b(ignore|disregard|forget)\\b[^.\\n]{0,40}\\b(previous|prior|above|earlier)\\b') THEN ['instruction-override'] ELSE [] END
|| CASE WHEN regexp_matches(text, '(?i)<\\s*/?\\s*(system|assistant|tool)\\s*>') THEN ['role-markup'] ELSE [] END
|| CASE WHEN regexp_matches(text, '(?im)^\\s*(system|assistant)\\s*:\\s') THEN ['role-prefix'] ELSE [] END
|| CASE WHEN regexp_matches(text, '(?i)\\byou are now\\b|\\bnew (system prompt|instructions|role)\\b') THEN ['role-reassignment'] ELSE [] END"""


@query(f"WITH {DOCS_TAGGED} SELECT doc_id, array_to_string({INJECTION_SQL}, ',') AS labels FROM docs_tagged")
def scan_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_tagged(spark, sf_dir).select("doc_id", F.array_join(injection_labels(F.col("text")), ",").alias("labels"))


@query(f"""WITH {DOCS_TAGGED}, l AS (SELECT source, unnest({INJECTION_SQL}) AS label FROM docs_tagged), g AS (SELECT source, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM l GROUP BY source)
SELECT s.source, coalesce(labels, '') AS labels FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN g ON s.source = g.source""")
def flag_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.flag_sources(docs_tagged(spark, sf_dir)).withColumn("labels", F.array_join("labels", ","))


REDACTED = """regexp_replace(regexp_replace(regexp_replace(replace({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ_0123456789', '[redacted]'), '(?i)\\bbearer\\s+[A-Za-z0-9._\\-]+', 'bearer [redacted]', 'g'),
'[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', '[redacted]', 'g'), '(?i)\\b(password|passwd|secret|token|api[_-]?key|authorization|cookie)\\b(\\s*[=:]\\s*)[^\\s;,]+', '\\1\\2[redacted]', 'g')"""


@query(f"WITH {DOCS_TAGGED} SELECT doc_id, {REDACTED.format('text')} AS text FROM docs_tagged")
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_tagged(spark, sf_dir).select("doc_id", redact(F.col("text")).alias("text"))


@query(f"SELECT conv_id, turn, role, {REDACTED.format('text')} AS text FROM conversations")
def redact_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.redact_record(table(spark, sf_dir, "conversations"), {"role"})


@query("SELECT count(*) AS documents, sum(length(text)) AS chars, max(length(text)) AS longest FROM documents")
def corpus_budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.enforce_budget(table(spark, sf_dir, "documents"), 10**12, 10**15, 10**9)


@query()
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(split_sentences(F.col("text"))).alias("position", "s"))
    return found.select("doc_id", F.col("position").cast("long").alias("position"), "s.*")


