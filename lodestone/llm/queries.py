"""Queries over whole tables, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op3_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.media import digests

    return digests(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.substrings import remove_repeated

    return remove_repeated(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.simhash import hex_fingerprint, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_fingerprint(found["fp"]).alias("fingerprint"), "component_id")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.suffixes import remove_repeated

    return remove_repeated(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text", "text_hash")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.pii import digests

    return digests(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.discriminant import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.divergence import audit

    return audit(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_byte_bpe,
        op3_matroska,
        op4_language_id,
        op5_toxicity,
        op6_substring_dedup,
        op7_simhash,
        op8_suffix_dedup,
        op9_personal_data,
        op10_quality_rules,
        op11_embedding_whitening,
        op12_quality_classifier,
        op13_source_divergence,
    )
}
#: Words as the contracts define them, one row each.
WORDS = """words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents))"""
ORACLES: dict[str, str] = {
    "op6_substring_dedup": f"""WITH {WORDS},
keyed AS (SELECT doc_id, i, w, CASE WHEN count(*) OVER f = 20 THEN string_agg(w, ' ') OVER f END AS k FROM words WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
firsts AS (SELECT k, min(doc_id) AS d, arg_min(i, (doc_id, i)) AS p FROM keyed WHERE k IS NOT NULL GROUP BY k),
marked AS (SELECT doc_id, i, w, bool_or(d IS NOT NULL AND (d, p) <> (doc_id, i)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM keyed LEFT JOIN firsts USING (k)),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (NOT gone), '') AS t FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
    "op8_suffix_dedup": """WITH h AS (SELECT doc_id, regexp_extract_all(lower(hex(encode(coalesce(text, '')))), '..') AS x FROM documents),
bytes AS (SELECT doc_id, unnest(x) AS b, generate_subscripts(x, 1) AS i FROM h),
b AS (SELECT doc_id, i, b, CASE WHEN count(*) OVER f = 50 THEN md5_number(string_agg(b, '') OVER f) END AS k FROM bytes WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
firsts AS (SELECT k, min(doc_id) AS d FROM b WHERE k IS NOT NULL GROUP BY k HAVING min(doc_id) < max(doc_id)),
marked AS (SELECT doc_id, i, b, coalesce(i - max(CASE WHEN d < doc_id THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) < 50, false) AS gone FROM b LEFT JOIN firsts USING (k)),
turns AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM marked),
kept AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, coalesce(string_agg(b, '' ORDER BY i) FILTER (NOT gone), '') AS t FROM turns GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256 FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
    "op10_quality_rules": f"""WITH {WORDS},
triples AS (SELECT doc_id, i, w, CASE WHEN count(*) OVER f = 3 THEN string_agg(w, ' ') OVER f END AS k FROM words WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
twice AS (SELECT *, k IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, k) > 1 AS t FROM triples),
inside AS (SELECT doc_id, i, w, bool_or(t) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS r FROM twice),
per_doc AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (r) AS n_repeat_words, count(*) FILTER (w <> lower(w) AND w = upper(w)) AS n_upper FROM inside GROUP BY 1),
pairs AS (SELECT doc_id, w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS pair FROM words),
often AS (SELECT doc_id, max(n) AS commonest FROM (SELECT doc_id, pair, count(*) AS n FROM pairs WHERE pair IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
counts AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_upper, 0) AS n_upper, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS breaks,
  length(regexp_replace(coalesce(text, ''), '\\P{{L}}', '', 'g')) AS n_letters, coalesce(commonest, 0) AS commonest FROM documents d LEFT JOIN per_doc p ON p.doc_id = d.doc_id LEFT JOIN lines l ON l.doc_id = d.doc_id LEFT JOIN often o ON o.doc_id = d.doc_id)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT n_symbols > 0.2 * greatest(n_words, 1) AND NOT n_dup_lines > 0.3 * (breaks + 1) AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 30 AND NOT n_upper > 0.5 * n_words
  AND NOT n_letters < 0.5 * word_chars AND NOT commonest > 0.2 * n_words AS kept FROM counts""",
    "op13_source_divergence": """WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
held AS (SELECT r, lang, source, term, count(*) AS c FROM (SELECT r, lang, source, unnest(ts) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term FROM held GROUP BY ALL HAVING count(*) >= 3),
groups AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT lang, source, term, sum(c) AS c FROM held GROUP BY ALL),
counts AS (SELECT g.lang, g.source, k.term, coalesce(o.c, 0)::BIGINT AS c FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
p AS (SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 1)) // (sum(c) OVER w + count(*) OVER w) AS p FROM counts WINDOW w AS (PARTITION BY lang, source)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 1)) // (sum(c) OVER w + count(*) OVER w) AS q FROM (SELECT lang, term, sum(c) AS c FROM counts GROUP BY ALL) WINDOW w AS (PARTITION BY lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
}
