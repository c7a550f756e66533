"""Citations and extractive answers over ranked evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import collapse_whitespace, excerpt

INSUFFICIENT = "I could not find enough evidence in the indexed sources to answer reliably."


def typed_locator(rows: DataFrame) -> DataFrame:
    """With ``locator``, a struct of which one shape is filled by source type, and its ``display``; ``display`` is null
    where the type's own place is missing."""
    kind, has = F.col("source_type"), lambda c: F.col(c).isNotNull()
    table = F.concat(F.lit("table "), "table_name", F.when(has("row_id"), F.concat(F.lit(", record "), "row_id")).when(has("query_fingerprint"), F.concat(F.lit(", query "), F.substring("query_fingerprint", 1, 12))).otherwise(""))
    display = (
        F.when((kind == "docx") & has("row_id"), F.concat(F.lit("paragraph "), "row_id")).when((kind == "pdf") & has("page_number"), F.concat(F.lit("page "), F.col("page_number").cast("string")))
        .when((kind == "website") & has("source_uri"), F.col("source_uri")).when((kind == "csv") & has("row_id"), F.concat(F.lit("row "), "row_id")).when((kind == "database") & has("table_name"), table)
    )
    only = lambda k, c: F.when(kind == k, F.col(c))
    locator = F.struct(only("docx", "row_id").alias("paragraph"), only("pdf", "page_number").alias("page"), only("website", "source_uri").alias("url"), only("csv", "row_id").alias("row"), only("database", "table_name").alias("table"))
    return rows.withColumn("locator", F.when(display.isNotNull(), locator)).withColumn("display", display)


def assign_citations(evidence: DataFrame) -> DataFrame:
    """Evidence (query_id, position, source_id, display, content, ...) with ``excerpt`` and ``citation_id``: S1, S2, ... by
    first use in each question; the same source, place and folded excerpt share one."""
    identity = ["query_id", "source_id", "display", "_folded"]
    rows = evidence.withColumn("excerpt", excerpt(F.col("content"))).withColumn("_folded", F.lower("excerpt"))
    rows = rows.withColumn("_first", F.min("position").over(Window.partitionBy(*identity)))
    number = F.dense_rank().over(Window.partitionBy("query_id").orderBy("_first"))
    return rows.withColumn("citation_id", F.concat(F.lit("S"), number)).drop("_folded", "_first")


def edge_citations(cited: DataFrame) -> DataFrame:
    """(query_id, citations): a map from relationship to its distinct citations in order. cited: query_id,
    relationship_id, position, citation_id."""
    ordered = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("position", "citation_id"))), lambda c: c["citation_id"]))
    one = cited.groupBy("query_id", "relationship_id").agg(ordered.alias("ids"))
    return one.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("relationship_id", "ids")))).alias("citations"))


def neutralize(text: Column) -> Column:
    """Look-alikes of citation markers in source text, in full-width brackets."""
    closed = F.regexp_replace(text, r"\[(S[^\]\n]*)\]", "［$1］")
    return F.regexp_replace(closed, r"\[(S[^\]\n]*)", "［$1")


def extractive_answer(questions: DataFrame, cited: DataFrame, passages: int = 3) -> DataFrame:
    """(query_id, answer, insufficient): the paragraphs of the first passages with their markers; a fixed sentence for
    questions without evidence. cited: query_id, position (from 1), content, citation_id."""
    paragraphs = F.filter(F.transform(F.split(neutralize(F.col("content")), r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    marked = F.transform(paragraphs, lambda p: F.concat(p, F.lit(" ["), F.col("citation_id"), F.lit("]")))
    rows = cited.filter(F.col("position") <= passages).select("query_id", "position", marked.alias("parts"))
    one = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "parts"))).alias("all"))
    text = F.array_join(F.flatten(F.transform("all", lambda x: x["parts"])), "\n\n")
    out = questions.select("query_id").join(one.select("query_id", text.alias("answer")), "query_id", "left")
    return out.select("query_id", F.coalesce("answer", F.lit(INSUFFICIENT)).alias("answer"), F.col("answer").isNull().alias("insufficient"))


def validate_citations(answers: DataFrame) -> DataFrame:
    """answers (answer_id, answer, known: array<string>) with ``status`` (ok, or what is wrong with the first bad
    paragraph) and ``segments`` (array<struct<text, citation_ids>>) of good answers."""
    marker, trailing = r"\[S[1-9][0-9]*\]", r"(?:\s*\[S[1-9][0-9]*\])+\s*$"
    paragraphs = F.filter(F.split(F.regexp_replace("answer", r"^\s+|\s+$", ""), r"\n\s*\n"), lambda p: F.trim(collapse_whitespace(p)) != "")

    def check(p: Column) -> Column:
        like, good = F.regexp_extract_all(p, F.lit(r"\[S[^\]\n]*\]"), F.lit(0)), F.regexp_extract_all(p, F.lit(marker), F.lit(0))
        last = F.regexp_extract_all(F.regexp_extract(p, trailing, 0), F.lit(marker), F.lit(0))
        ids = F.array_distinct(F.transform(good, lambda m: F.substring(m, 2, 100).substr(F.lit(1), F.length(m) - 2)))
        text = collapse_whitespace(F.regexp_replace(p, trailing, ""))
        status = (
            F.when(like != good, "malformed").when((F.size(good) > 0) & (good != last), "misplaced").when(F.size(F.array_except(ids, F.col("known"))) > 0, "unknown")
            .when(F.size(ids) == 0, "uncited").when(text == "", "empty").otherwise("ok")
        )
        return F.struct(status.alias("status"), text.alias("text"), ids.alias("citation_ids"))

    checked = answers.withColumn("_c", F.transform(paragraphs, check))
    bad = F.get(F.filter("_c", lambda c: c["status"] != "ok"), F.lit(0))
    status = F.when(F.size("known") == 0, "no_citations").when(F.size("_c") == 0, "no_segments").otherwise(F.coalesce(bad["status"], F.lit("ok")))
    segments = F.transform("_c", lambda c: F.struct(c["text"].alias("text"), c["citation_ids"].alias("citation_ids")))
    return checked.withColumn("status", status).withColumn("segments", F.when(F.col("status") == "ok", segments)).drop("_c")


def grounded_prompt(questions: DataFrame, cited: DataFrame, rules: str) -> DataFrame:
    """(query_id, prompt): rules, question and the evidence with its markers, in order."""
    lines = F.array_sort(F.collect_list(F.struct("position", F.concat(F.lit("["), "citation_id", F.lit("] "), "excerpt").alias("line"))))
    one = cited.groupBy("query_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("evidence"))
    return questions.join(one, "query_id", "left").select("query_id", F.concat_ws("\n\n", F.lit(rules), F.concat(F.lit("Question: "), "question"), F.concat(F.lit("Evidence:\n"), F.coalesce("evidence", F.lit("none")))).alias("prompt"))
