"""Ingestion: chunks with locators, rows as documents, page extraction and filters, safety flags, budgets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.checkpoints import cut
from lodestone.functions.text import chunk_text, collapse_whitespace, injection_labels, redact
from lodestone.functions.urls import host_of, normalize_url


def chunk_pages(pages: DataFrame, size: int = 1200, overlap: int = 200, block: int = 1000) -> DataFrame:
    """(source, page, position, text) to chunks with a source-wide ``chunk_index`` and a per-page ``page_chunk``. Rows without
    text, null or blank, give no chunks and take no number.

    Rows are numbered in blocks of ``block`` pages; the blocks' totals, one row each, are added up by source. So the texts of
    a large source are dealt by block, not all to one task."""
    rows = pages.select("source", "page", "position", chunk_text(collapse_whitespace(F.coalesce("text", F.lit(""))), size, overlap).alias("chunks"), F.floor(F.col("page") / block).alias("block"))
    # Counted apart from the texts, so that only the second join carries them.
    totals = rows.groupBy("source", "block").agg(F.sum(F.size("chunks")).alias("n"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "block").orderBy("page", "position").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("ahead", F.coalesce(F.sum(F.size("chunks")).over(within), F.lit(0))).join(offsets, ["source", "block"])
    found = own.select("source", "page", "position", F.posexplode("chunks").alias("at", "chunk"), (F.col("offset") + F.col("ahead")).alias("first"))
    return found.select("source", "page", "position", F.col("at").cast("long").alias("page_chunk"), "chunk", (F.col("first") + F.col("at")).cast("long").alias("chunk_index"))


def chunk_paragraphs(docs: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """(doc_id, text) to chunks per line; blank lines count in ``row_id`` but give no chunk."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "line"))
    lines = lines.select("doc_id", (F.col("position") + 1).cast("long").alias("row_id"), collapse_whitespace(F.col("line")).alias("line")).filter("line <> ''")
    return lines.select("doc_id", "row_id", F.posexplode(chunk_text(F.col("line"), size, overlap)).alias("part", "chunk")).withColumn("part", F.col("part").cast("long"))


def rows_as_documents(rows: DataFrame, text_columns: list[str], row_id: str, title: str) -> DataFrame:
    """One document per row: "column: value" lines of the text columns that are not null; rows without any are left out."""
    values = [F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in text_columns]
    others = [c for c in rows.columns if c not in text_columns]
    pairs = [x for c in others for x in (F.lit(c), F.col(c).cast("string"))]
    out = rows.select(F.col(row_id).cast("string").alias("row_id"), F.lit(title).alias("title"), F.concat_ws("\n", *values).alias("content"), F.create_map(*pairs).alias("metadata"))
    return out.filter("content <> ''")


def column_roles(rows: DataFrame, text_columns: list[str], row_id: str | None, most: int = 5) -> DataFrame:
    """One row per broken rule (rule, detail): unknown or doubled text columns, a row id that is null or not unique."""
    spark, found = rows.sparkSession, []
    if not text_columns:
        found.append(("text_columns_empty", ""))
    found += [("unknown_column", c) for c in [*text_columns, *([row_id] if row_id else [])] if c not in rows.columns]
    found += [("doubled_column", c) for c in sorted({c for c in text_columns if text_columns.count(c) > 1})]
    out = spark.createDataFrame(found, "rule string, detail string")
    if row_id and row_id in rows.columns:
        nulls = rows.filter(F.col(row_id).isNull()).agg(F.count("*").alias("n")).filter("n > 0").select(F.lit("row_id_missing").alias("rule"), F.col("n").cast("string").alias("detail"))
        doubled = rows.filter(F.col(row_id).isNotNull()).groupBy(row_id).count().filter("count > 1").orderBy(F.col(row_id).cast("string")).limit(most)
        out = out.unionByName(nulls).unionByName(doubled.select(F.lit("row_id_doubled").alias("rule"), F.col(row_id).cast("string").alias("detail")))
    return out


# Elements whose text is not visible content.
HIDDEN = ("script", "style", "nav", "form", "noscript", "svg", "canvas")


#: Elements whose content is no markup.
RAW = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style")}
NAME, SIGN = re.compile(r"([/!?]?)([A-Za-z][^\s/>]*)"), re.compile("""["'>]""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


class Markup:
    """Tags of a page from left to right. What is never closed is looked for once: from then on it is known to be absent, so that
    a page costs time in proportion to its length, however broken it is."""

    def __init__(self, html: str):
        self.html, self.absent, self.loose = html, set(), False

    def find(self, what: str, at: int) -> int:
        if what in self.absent:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found

    def end(self, at: int) -> int:
        """Behind the tag that ``at`` lies in; -1 where it has no end. A sign in quotes ends no tag; where quotes leave a tag open
        to the end of the page, they count for nothing from there on."""
        place = at
        while not self.loose:
            sign = SIGN.search(self.html, place)
            if sign and sign[0] == ">":
                return sign.end()
            place = self.find(sign[0], sign.end()) + 1 if sign else 0
            self.loose = place == 0
        return self.find(">", at) + 1 or -1

    def tags(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(begin, end, name, closing, attributes); comments, and scripts and styles with their content, as name ''. A tag that is
        closed in itself comes twice. Where a script never ends, so does the page."""
        at = 0
        while (begin := self.find("<", at)) >= 0:
            at = begin + 1
            if self.html.startswith("<!--", begin):
                if (end := self.find("-->", begin + 4)) >= 0:
                    at = end + 3
                    yield begin, at, "", False, ""
                continue
            named = NAME.match(self.html, at)
            if not named or (end := self.end(named.end())) < 0:
                continue
            at, name, body = end, named[2].lower(), self.html[named.end() : end - 1]
            if name in RAW and not named[1]:
                close = RAW[name].search(self.html, end)
                at = close.end() if close else len(self.html)
                yield begin, at, "", False, ""
                continue
            yield begin, end, name, named[1] == "/", body
            if body.endswith("/") and not named[1]:
                yield end, end, name, True, ""


def plain_text(parts: list[str]) -> str | None:
    return " ".join(unescape(" ".join(parts)).split()) or None


def page_facts(html: str, url: str | None) -> dict:
    """Title, visible text, the canonical link as an absolute address, and links of a page. A hidden element reaches to its own
    end, and to the end of the page where it has none; others may lie in it."""
    seen, titles, links, named = [], [], [], None
    hidden: list[str] = []
    at, title = 0, None
    for begin, end, name, closing, body in Markup(html).tags():
        if not hidden:
            seen.append(html[at:begin])
        if title is not None:
            titles.append(html[at:begin])
        at = end
        if name == "title":
            title = None if closing else begin
        if name in HIDDEN and not closing:
            hidden.append(name)
        elif hidden and closing and name == hidden[-1]:
            hidden.pop()
        if name in ("a", "link") and not closing:
            values = {k.lower(): unescape(x or y or z) for k, x, y, z in ATTRIBUTE.findall(body)}
            if name == "a" and values.get("href", "").strip():
                links.append(values["href"])
            if name == "link" and "canonical" in values.get("rel", "").lower().split():
                named = values.get("href")
    if not hidden:
        seen.append(html[at:])
    if title is not None:
        titles.append(html[at:])
    return {"title": plain_text(titles), "text": plain_text(seen), "canonical": joined_url(url, named) if named else None, "links": links}


def joined_url(url: str | None, link: str) -> str | None:
    try:
        return urljoin(url or "", link)
    except ValueError:
        return None


def extract_html(html: Column, url: Column | None = None) -> Column:
    """struct<title, text, canonical, links> of a page; null text where nothing is visible. ``canonical`` is the page's own
    canonical link where it is on the page's host, else the page's address."""
    kind = pa.struct([("title", pa.string()), ("text", pa.string()), ("canonical", pa.string()), ("links", pa.list_(pa.string()))])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pages, urls in batches:
            yield pa.array([None if h is None else page_facts(h, u) for h, u in zip(pages.to_pylist(), urls.to_pylist(), strict=True)], kind)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    url = F.lit(None).cast("string") if url is None else url
    found = F.arrow_udf(run, "struct<title: string, text: string, canonical: string, links: array<string>>")(html, url)
    own = F.when(host_of(found["canonical"]) == host_of(url), normalize_url(found["canonical"]))
    return F.when(found.isNotNull(), found.withField("canonical", F.coalesce(own, url)))


def allowed_pages(pages: DataFrame, patterns: DataFrame) -> DataFrame:
    """Pages (url) whose host is on the list; all where the list is empty. A host's own name and what is left of it after
    each dot meet the listed domains (pattern) by equality, however many there are."""
    if not patterns.limit(1).count():
        return pages
    domains = patterns.select(F.regexp_replace(F.lower(F.trim("pattern")), r"^\*\.", "").alias("domain")).distinct()
    hosts = pages.select(host_of(F.col("url")).alias("host")).distinct()
    parts = F.split("host", r"\.")
    ends = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("domain"))
    listed = ends.join(domains, "domain", "left_semi").select("host").distinct()
    return pages.join(listed, host_of(F.col("url")) == F.col("host"), "left_semi")


def robots_verdicts(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (page_id, url) with ``allowed``: the first rule (host, priority, prefix, allow) of the host whose prefix begins
    the path decides; without one a page is allowed."""
    path = F.regexp_replace(F.col("url"), r"^[A-Za-z]+://[^/]*", "")
    named = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path.alias("path"))
    hits = named.join(rules, "host").filter(F.expr("startswith(path, prefix)"))
    first = hits.groupBy("page_id").agg(F.min_by("allow", "priority").alias("allow"))
    return named.join(first, "page_id", "left").select("page_id", "url", F.coalesce("allow", F.lit(True)).alias("allowed"))


def dedup_pages(pages: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """Every page with a status: the first of each canonical key, then the first of each text, are kept. ``order`` tells
    pages apart. Firsts are found by grouping hashes; texts are not sent."""
    slim = pages.select(F.col(order).alias("_order"), F.col(key).alias("_key"), F.sha2(text, 256).alias("_sha"))
    firsts = slim.groupBy("_key").agg(F.min(F.struct("_order", "_sha")).alias("f")).select("f.*")
    kept = firsts.groupBy("_sha").agg(F.min("_order").alias("_order")).select("_order", F.lit("kept").alias("_kept"))
    status = firsts.join(kept, "_order", "left").select("_order", F.coalesce("_kept", F.lit("duplicate_content")).alias("status"))
    found = pages.join(status, F.col(order) == F.col("_order"), "left").drop("_order")
    return found.withColumn("status", F.coalesce("status", F.lit("duplicate_url")))


def crawl_order(links: DataFrame, seeds: DataFrame, page_limit: int = 100) -> DataFrame:
    """Breadth-first closure over ``links`` (src, dst) from ``seeds`` (node): node, depth and place in the crawl, up to
    ``page_limit`` pages. The loop runs once per depth, until nothing is new or the limit is reached; only a count comes to
    the driver, and each round writes only what is new."""
    level = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    seen, total, depth = level, level.count(), 0
    while total < page_limit:
        depth += 1
        reached = level.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        level = cut(reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        new = level.count()
        if not new:
            break
        seen, total = seen.unionByName(level), total + new
    nearest = seen.orderBy("depth", "node").limit(page_limit)
    # At most page_limit rows, an argument, so that one window may number them.
    return nearest.withColumn("place", F.row_number().over(Window.orderBy("depth", "node")).cast("long"))


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst): the normalized addresses of pages (url, html), and of the links in them that can be crawled and stay on the
    page's host; each pair once."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for urls, links in batches:
            whole = [None if u is None or own is None else [x for link in own if (x := joined_url(u, link.strip())) is not None] for u, own in zip(urls.to_pylist(), links.to_pylist(), strict=True)]
            yield pa.array(whole, pa.list_(pa.string()))

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    absolute = F.arrow_udf(run, "array<string>")
    found = pages.select("url", extract_html(F.col("html"), F.col("url"))["links"].alias("links")).select(normalize_url(F.col("url")).alias("src"), F.explode(absolute(F.col("url"), F.col("links"))).alias("link"))
    both = found.select("src", normalize_url(F.col("link")).alias("dst")).filter("src is not null and dst is not null")
    return both.filter((host_of(F.col("src")) == host_of(F.col("dst"))) & (F.col("src") != F.col("dst"))).distinct()


def crawl_hosts(links: DataFrame, seeds: DataFrame, page_limit: int = 100, queue: int = 10) -> DataFrame:
    """(host, url, depth, place): a breadth-first crawl of each host over ``links`` (src, dst) from ``seeds`` (url), all hosts side by
    side. Of a host ``page_limit`` pages are fetched, by depth, then address; links are followed from these only, and a queue
    holds at most ``queue`` times as many addresses. A round is a join; what it sends to the driver is whether anything is new."""
    most = page_limit * queue
    by_host = Window.partitionBy("host").orderBy("url")
    first = seeds.select(host_of(F.col("url")).alias("host"), "url").filter("url is not null").distinct()
    level = cut(first.withColumn("place", F.row_number().over(by_host).cast("long")).filter(F.col("place") <= most).withColumn("depth", F.lit(0)))
    seen, depth = level, 0
    while not level.isEmpty():
        depth += 1
        fetched = level.filter(F.col("place") <= page_limit).select("host", F.col("url").alias("src"))
        new = fetched.join(links, "src").select("host", F.col("dst").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        nth = new.withColumn("nth", F.row_number().over(by_host)).filter(F.col("nth") <= most)  # no more are taken of a host
        ahead = seen.groupBy("host").agg(F.max("place").alias("ahead"))
        placed = nth.join(ahead, "host").select("host", "url", (F.col("ahead") + F.col("nth")).alias("place"), F.lit(depth).alias("depth"))
        level = cut(placed.filter(F.col("place") <= most))
        seen = seen.unionByName(level)
    return seen.filter(F.col("place") <= page_limit).select("host", "url", "depth", "place")


def flag_sources(docs: DataFrame) -> DataFrame:
    """source and its sorted distinct injection labels; sources without any have an empty list."""
    found = docs.select("source", F.explode_outer(injection_labels(F.col("text"))).alias("label"))
    return found.groupBy("source").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def redact_record(rows: DataFrame, allowed: set[str]) -> DataFrame:
    """All string columns but the allowed ones redacted, in one projection."""
    return rows.select(*[redact(F.col(c)).alias(c) if t == "string" and c not in allowed else F.col(c) for c, t in rows.dtypes])


def corpus_budget(docs: DataFrame, text: str = "text") -> DataFrame:
    """Document count, characters and the longest document, in one pass."""
    return docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"), F.coalesce(F.max(F.length(text)), F.lit(0)).cast("long").alias("longest"))


def enforce_budget(docs: DataFrame, documents: int, chars: int, longest: int) -> DataFrame:
    """:func:`corpus_budget` with the three limits checked; a broken one fails the query."""
    b = corpus_budget(docs)
    checks = [F.assert_true(F.col(c) <= limit, f"{c} above {limit}").alias(f"_{c}") for c, limit in (("documents", documents), ("chars", chars), ("longest", longest))]
    return b.select("*", *checks).drop(*[f"_{c}" for c in ("documents", "chars", "longest")])
