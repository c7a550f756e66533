"""Quality rules as a short-circuit cascade.

A rule looks at features of a text (its words, its lines, its repeated windows, ...). Features are computed when a rule
first asks for them, so a verdict that stops at the first rejection pays for no later feature. :func:`plan_cascade`
measures on a bounded sample what each feature costs and what each rule rejects, and puts the rules in order of rejection
per cost: at each step the rule with the most rejected per second among the sample's survivors, where features that
earlier rules computed are free. The order changes what a verdict costs, never the verdict.

Null and empty texts have no words: they fail the base rules and are rejected. An empty table gives an empty table, with
the rules in their written order. Extra columns and repeated rows do not matter, since every row is judged by its text alone.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import per_text

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
NOT_SYMBOL = {i: None for i in range(128) if chr(i) not in SYMBOLS}
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
KIND = pa.struct([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())])


def words_of(text: str) -> list[str]:
    return WORD.findall(text)


def repeated_words(words: list[str]) -> int:
    """Words inside a window of three words that occurs twice or more in the text."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    size = len(number) + 1
    if size < 2_000_000:
        codes = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:  # codes of pairs first, so that a code fits 64 bits at any length
        pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
        codes = pairs[:-1] * size + ids[2:]
    order = np.sort(codes)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return 0
    hit = twice[np.minimum(np.searchsorted(twice, codes), len(twice) - 1)] == codes
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + n] |= hit
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


def commonest_pair(words: list[str]) -> int:
    """How often the most frequent pair of neighbouring words occurs."""
    return max(Counter(zip(words, words[1:], strict=False)).values(), default=0)


#: What rules look at: how each feature is computed, from the text and from features before it.
FEATURES: dict[str, Callable[[Facts], object]] = {
    "words": lambda f: words_of(f.text),
    "word_chars": lambda f: sum(map(len, f["words"])),
    "n_symbols": lambda f: len(f.text.translate(NOT_SYMBOL)) if f.text.isascii() else sum(map(f.text.count, SYMBOLS)),
    "n_dup_lines": lambda f: duplicate_lines(f.text),
    "n_repeat_words": lambda f: repeated_words(f["words"]),
    "n_upper": lambda f: sum(map(str.isupper, f["words"])),
    "n_letters": lambda f: sum(map(str.isalpha, f.text)),
    "commonest_pair": lambda f: commonest_pair(f["words"]),
}


class Facts:
    """A text and those of its features that have been asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.known: dict[str, object] = {}

    def __getitem__(self, name: str):
        if name not in self.known:
            self.known[name] = FEATURES[name](self)
        return self.known[name]

    @property
    def n_words(self) -> int:
        return len(self["words"])


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Facts], bool]


def _short(f: Facts) -> bool:
    return f.n_words < 50


def _repetitive(f: Facts) -> bool:
    return 100 * f["n_repeat_words"] > 50 * f.n_words


#: The base rules first; beyond them the limits are wide, so that ordinary prose of any length passes.
RULES = (
    Rule("short", ("words",), _short),
    Rule("repetitive", ("words", "n_repeat_words"), _repetitive),
    Rule("symbols", ("words", "n_symbols"), lambda f: f["n_symbols"] > 0.2 * max(1, f.n_words)),
    Rule("duplicate_lines", ("n_dup_lines",), lambda f: f["n_dup_lines"] > 0.3 * (f.text.count("\n") + 1)),
    Rule("word_length", ("words", "word_chars"), lambda f: not 2 <= f["word_chars"] / max(1, f.n_words) <= 30),
    Rule("shouting", ("words", "n_upper"), lambda f: f["n_upper"] > 0.5 * f.n_words),
    Rule("few_letters", ("words", "word_chars", "n_letters"), lambda f: f["n_letters"] < 0.5 * f["word_chars"]),
    Rule("one_phrase", ("words", "commonest_pair"), lambda f: f["commonest_pair"] > 0.2 * f.n_words),
)


def base_failed(f: Facts) -> bool:
    return _short(f) or _repetitive(f)


def plan_order(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """The rules by rejection per cost over a sample of texts."""
    facts = [Facts(t) for t in texts]
    seconds: dict[str, float] = {}
    for name in dict.fromkeys(n for r in rules for n in r.needs):
        began = time.perf_counter()
        for f in facts:
            f[name]
        seconds[name] = time.perf_counter() - began
    own: dict[str, float] = {}
    gone: dict[str, list[bool]] = {}
    for r in rules:
        began = time.perf_counter()
        gone[r.name] = [r.rejects(f) for f in facts]
        own[r.name] = time.perf_counter() - began
    left, computed, order = set(range(len(facts))), set(), []
    while len(order) < len(rules):
        # Costs are of the whole sample, and so are the same for all up to the share of it that is left.
        cost = {r.name: own[r.name] + sum(seconds[n] for n in r.needs if n not in computed) for r in rules if r not in order}
        hits = {k: sum(gone[k][i] for i in left) for k in cost}
        best = max((r for r in rules if r not in order), key=lambda r: (hits[r.name] / max(cost[r.name], 1e-9), -cost[r.name]))
        order.append(best)
        computed.update(best.needs)
        left = {i for i in left if not gone[best.name][i]}
    return tuple(order)


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 400, text: str = "text") -> tuple[Rule, ...]:
    """The rules in the order of :func:`plan_order`, as measured on at most ``sample_rows`` whole documents (of up to 20,000
    characters, which bounds what the driver holds)."""
    sample = [r[0] for r in docs.filter(F.length(text) <= 20_000).select(text).limit(sample_rows).collect()]
    return plan_order(sample, rules) if sample else rules


def verdict(f: Facts, rules: tuple[Rule, ...]) -> bool:
    """True if no rule rejects; later rules do not run once one has, nor are their features computed."""
    return not any(rule.rejects(f) for rule in rules)


def kept(text: Column, names: tuple[str, ...]) -> Column:
    """The verdict alone, by the rules with these names in this order."""

    def judge(texts: list[str | None]) -> pa.Array:
        known = {r.name: r for r in RULES}
        return pa.array([verdict(Facts(t), tuple(known[n] for n in names)) for t in texts], pa.bool_())

    return per_text(judge, "boolean")(text)


def quality(text: Column, names: tuple[str, ...]) -> Column:
    """A struct of FIELDS: the verdict by the rules with these names in this order, then what counts are still missing."""

    def judge(texts: list[str | None]) -> pa.Array:
        known = {r.name: r for r in RULES}
        out = []
        for t in texts:
            f = Facts(t)
            keep = verdict(f, tuple(known[n] for n in names))
            out.append((f.n_words, f["word_chars"], f["n_symbols"], f["n_dup_lines"], f["n_repeat_words"], base_failed(f), keep))
        columns = list(zip(*out, strict=True)) if out else [[]] * 7
        return pa.StructArray.from_arrays([pa.array(c, type=k.type) for c, k in zip(columns, KIND, strict=True)], fields=list(KIND))

    return per_text(judge, f"struct<{', '.join(x.replace(' ', ': ') for x in FIELDS.split(', '))}>")(text)


def _names(docs: DataFrame, sample_rows: int) -> tuple[str, ...]:
    return tuple(r.name for r in plan_cascade(docs, sample_rows=sample_rows))


def score_quality(docs: DataFrame, sample_rows: int = 400) -> DataFrame:
    """doc_id with FIELDS for every row of ``docs``."""
    return docs.select("doc_id", quality(F.col("text"), _names(docs, sample_rows)).alias("q")).select("doc_id", "q.*")


def keep_good(docs: DataFrame, sample_rows: int = 400) -> DataFrame:
    """``docs`` without the rows that the cascade rejects; all columns stay."""
    return docs.filter(kept(F.col("text"), _names(docs, sample_rows)))
