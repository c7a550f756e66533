"""Personal data by base patterns and a semi-Markov conditional random field.

The base spans (email, ip, card, phone) are exact patterns with checks. Around units that may belong to personal data
(digits, an at sign) the text is cut in regions of units: runs of digits, runs of letters, long runs of both, single other
characters. The field scores whole candidate segments: their shape, digit count, checks, first character, neighbours and
the word before. Dynamic programming over segments of at most ``LONGEST`` units chooses boundaries and types jointly. It is
trained here by likelihood, on a bounded sample of regions whose base spans are the labels, with altered copies of the
base spans (other separators, spelled-out signs) that the patterns miss, and with made-up secrets (kind ``secret``: random
keys after a word such as token) beside random strings that are none. Its segments are added where they overlap no base
span and are certain; base spans always stay. :func:`assess` measures what it adds on altered spans of other texts.

An empty table gives an empty table. Null text counts as empty: no spans. Places are code points, ends exclusive. Repeated
rows give repeated results; other columns are not looked at. Without any base span in the sample, nothing is added.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import per_text

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9][0-9.]*")
ADDRESS = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HOT = re.compile(r"[0-9]+|@|\b(?:at|dot)\b")
MIXED = r"(?=[0-9]*[A-Za-z])(?=[A-Za-z]*[0-9])[A-Za-z0-9]{16,}"
UNIT = re.compile(rf"(?<![A-Za-z0-9]){MIXED}|[0-9]+|[^\W\d_]+|[\s\S]")
LONGEST, REACH = 16, 24
#: Regions longer than this are cut into pieces that overlap by more than any entity is long.
LONG, OVERLAP = 600, 120
#: Words before a made-up secret, and before a random string that is none.
SECRET_WORDS = ("token", "key", "secret", "password", "passwd", "api_key", "auth", "bearer", "credential", "access_key")
OTHER_WORDS = ("commit", "sha", "hash", "checksum", "digest", "id", "ref", "build", "file", "block")
#: What Spark finds in texts that may hold a base span of each kind: only for choosing the sample.
LIKELY = {"email": "[A-Za-z0-9._%+-]@[A-Za-z0-9-]+[.][A-Za-z0-9-]", "ip": "[0-9]{1,3}([.][0-9]{1,3}){3}", "card": "([0-9][ -]?){12}[0-9]", "phone": "[+][0-9][ ().0-9-]{7,}[0-9]"}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, by kind and start."""
    out: list[Span] = []
    if "@" in text:
        last = 0
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                last = m.end()
    if not re.search("[0-9]", text):
        return out
    for run in DOTTED.finditer(text) if "." in text else ():
        if run[0].count(".") >= 3:
            for m in ADDRESS.finditer(text, run.start(), run.end()):
                if all(len(p.lstrip("0")) <= 3 and int(p[-12:]) <= 255 for p in m[0].split(".")):
                    out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(digits_of(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Ranges around units that may be personal data: those near one another, with some context; long ones in pieces that
    overlap, so that every entity lies within one of them."""
    out: list[list[int]] = []
    for m in HOT.finditer(text):
        if m[0] in ("at", "dot") and not re.search(r"\bat\b.{1,40}\bdot\b|\[(?:at|dot)|\((?:at|dot)", text[max(0, m.start() - 40) : m.end() + 40]):
            continue
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(x, min(b, x + LONG)) for a, b in out for x in range(a, max(a + 1, b - OVERLAP), LONG - OVERLAP)]


def shape(text: str) -> str:
    if re.fullmatch(MIXED, text):
        return "mixed"
    s = re.sub(r"[0-9]+", lambda m: "9" if len(m[0]) < 5 else "99", text)
    return re.sub(r"[^\W\d_]+", "a", s)[:24]


def features(text: str, a: int, b: int, size: int) -> list[str]:
    """Of a whole candidate segment."""
    s = text[a:b]
    d = digits_of(s)
    before, after = text[a - 1 : a] if a else "^", text[b : b + 1] or "$"
    kind = lambda c: "9" if c.isdigit() else "a" if c.isalpha() else " " if c.isspace() else c
    groups = [len(x) for x in re.findall(r"[0-9]+", s)]
    word = re.search(r"([^\W\d_]+)\W*$", text[max(0, a - 20) : a])
    out = [f"shape={shape(s)}", f"digits={len(d)}", f"first={kind(s[0])}", f"last={kind(s[-1])}", f"edge={kind(before)}{kind(after)}", f"size={min(size, 12)}", f"groups={groups[:6]}"]
    if word:
        out.append(f"word={word[1].lower()[:12]}")
    if out[0] == "shape=mixed":
        out += [f"long={min(len(s) // 8, 8)}", f"hex={not s.strip('0123456789abcdefABCDEF')}", f"set={before in '\"\'=:'}"]
    if "@" in s:
        out.append(f"at={s.count('@')}{'.' in s.partition('@')[2]}{any(c.isspace() for c in s)}")
    if len(groups) == 4 and re.fullmatch(r"[0-9.]+", s):
        out.append(f"octets={all(int(x) <= 255 for x in s.split('.') if x)}")
    if 13 <= len(d) <= 19 and len(d) >= 0.7 * len(s):
        out.append(f"luhn={luhn(d)}")
    return out


@dataclass
class Lattice:
    """Units of a region and its candidate segments: (first unit, unit after the last, features)."""

    places: list[int]
    segments: list[tuple[int, int, list[str]]]


def lattice(text: str, begin: int, end: int) -> Lattice:
    units = [(m.start(), m[0]) for m in UNIT.finditer(text, begin, end)]
    places = [a for a, _ in units] + [end]
    n = len(units)
    segments = []
    for i, (_, head) in enumerate(units):
        c = head[0]
        if not (c.isalnum() or c in "+(") or i and units[i - 1][1] in "+(" and not c.isalnum():
            continue
        good = False
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            last = units[j - 1][1]
            good = good or last[0].isdigit() or last == "@" or len(last) >= 16
            if last == "\n":
                break
            if good and last[-1].isalnum() and places[j] - places[i] >= 5:
                segments.append((i, j, features(text, places[i], places[j], j - i)))
    return Lattice(places, segments)


class Field:
    """A weight for each feature and kind; place 0 is the bias. A unit outside all segments scores 0."""

    def __init__(self, names: list[str] = ()):
        self.number = {f: i for i, f in enumerate(("bias", *names))}
        self.weights = np.zeros((len(self.number), len(KINDS)))
        self.weights[0] = -2.0

    def places(self, lat: Lattice) -> tuple[np.ndarray, np.ndarray]:
        """The features of all segments, each segment's after one another and the bias first; and where each begins."""
        get, ids, begin = self.number.get, [], []
        for _, _, fs in lat.segments:
            begin.append(len(ids))
            ids.append(0)
            ids += [k for f in fs if (k := get(f)) is not None]
        return np.array(ids, np.int64), np.array(begin, np.int64)

    def best(self, lat: Lattice) -> list[tuple[str, int, int, float]]:
        """The best segmentation's spans, each with how much better it is than leaving its units outside."""
        ids, begin = self.places(lat)
        scores = np.add.reduceat(self.weights[ids], begin, axis=0)
        kinds, tops = scores.argmax(axis=1).tolist(), scores.max(axis=1).tolist()
        by_end: list[list[int]] = [[] for _ in lat.places]
        for at, (_, j, _) in enumerate(lat.segments):
            if tops[at] > 0:
                by_end[j].append(at)
        top, back = [0.0] * len(lat.places), [-1] * len(lat.places)
        for j in range(1, len(lat.places)):
            top[j] = top[j - 1]
            for at in by_end[j]:
                if (new := top[lat.segments[at][0]] + tops[at]) > top[j]:
                    top[j], back[j] = new, at
        out, j = [], len(lat.places) - 1
        while j > 0:
            if back[j] < 0:
                j -= 1
            else:
                i = lat.segments[back[j]][0]
                out.append((KINDS[kinds[back[j]]], lat.places[i], lat.places[j], tops[back[j]]))
                j = i
        return out[::-1]

    def step(self, lat: Lattice, ids: np.ndarray, begin: np.ndarray, gold: np.ndarray, rate: float) -> None:
        """One step of likelihood: observed minus expected segments (segment x kind), by forward and backward sums."""
        scores = np.add.reduceat(self.weights[ids], begin, axis=0)
        high = scores.max(axis=1, keepdims=True)
        share = np.exp(scores - high)
        total = (high[:, 0] + np.log(share.sum(axis=1))).tolist()
        share /= share.sum(axis=1, keepdims=True)
        n = len(lat.places)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        starts: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for (i, j, _), s in zip(lat.segments, total, strict=True):
            ends[j].append((i, s))
            starts[i].append((j, s))
        fore, rear = [0.0] * n, [0.0] * n
        for j in range(1, n):
            fore[j] = log_sum([fore[j - 1], *(fore[i] + s for i, s in ends[j])])
        for i in range(n - 2, -1, -1):
            rear[i] = log_sum([rear[i + 1], *(rear[j] + s for j, s in starts[i])])
        chance = [math.exp(min(0.0, fore[i] + s + rear[j] - fore[-1])) for (i, j, _), s in zip(lat.segments, total, strict=True)]
        change = rate * (gold - share * np.array(chance)[:, None])
        np.add.at(self.weights, ids, np.repeat(change, np.diff(begin, append=len(ids)), axis=0))


def log_sum(terms: list[float]) -> float:
    high = max(terms)
    return high + math.log(sum(math.exp(t - high) for t in terms))


def altered(rng: random.Random, kind: str, s: str) -> str:
    """The same thing as written otherwise."""
    if kind == "card":
        d = digits_of(s)
        return rng.choice((".", "/", "  ", " - ", "_")).join(d[i : i + 4] for i in range(0, len(d), 4))
    if kind == "phone":
        d = digits_of(s)
        return rng.choice(("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "({}){}-{}")).format(d[-10:-7], d[-7:-4], d[-4:])
    if kind == "email":
        return s.replace("@", rng.choice((" @ ", " [at] ", " (at) ", "[at]"))) if rng.random() < 0.7 else s.replace("@", " @ ").replace(".", " . ")
    return s.replace(".", rng.choice((" . ", "[.]")))


def made_secret(rng: random.Random) -> tuple[str, int, int]:
    """A random string after a word, and where it begins and ends; the ends are 0 where the word says that it is no secret."""
    alphabet = rng.choice(("0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
    value = "".join(rng.choices(alphabet, k=rng.choice((20, 24, 32, 40, 48, 64)))) + "a7"
    real = rng.random() < 0.6
    head = rng.choice(SECRET_WORDS if real else OTHER_WORDS) + rng.choice((" = ", "=", ": ", " ", ' = "', '="', ': "', "='"))
    text = head + value + (head[-1] if head[-1] in "\"'" else "")
    return (text, len(head), len(head) + len(value)) if real else (text, 0, 0)


def chosen(texts: list[str], most_regions: int, a_text: int = 4) -> list[tuple[str, int, int, list[Span]]]:
    """At most ``most_regions`` regions (text, begin, end, base spans): equal shares for regions with each kind of span and
    for those without; what a share leaves free goes to the others in turn. A text gives at most ``a_text`` regions to a
    share, spread over its length, until all texts have had their turn."""
    queues: dict[str, list[tuple[int, int, tuple[str, int, int, list[Span]]]]] = {k: [] for k in (*BASE, "")}
    for at, text in enumerate(texts):
        spans, own = base_spans(text), {k: [] for k in queues}
        for a, b in regions(text):
            inside = [s for s in spans if a <= s[1] and s[2] <= b]
            own[min((s[0] for s in inside), key=BASE.index, default="")].append((text, a, b, inside))
        for k, found in own.items():
            step = -(-len(found) // a_text)
            queues[k] += [(i % step if step else 0, at, r) for i, r in enumerate(found)]
    lists = [[r for _, _, r in sorted(q, key=lambda x: x[:2])] for q in queues.values()]
    taken, out = [0] * len(lists), []
    while len(out) < most_regions and any(n < len(q) for n, q in zip(taken, lists, strict=True)):
        for i, q in enumerate(lists):
            if taken[i] < len(q) and len(out) < most_regions:
                out.append(q[taken[i]])
                taken[i] += 1
    return out


def variants(rng: random.Random, text: str, a: int, b: int, own: list[Span]) -> Iterator[tuple[str, list[Span]]]:
    """Copies of a region with one base span written otherwise, or with a random string put in at a space; and their spans."""
    moved = lambda spans, at, by: [(k, x + by * (x >= at), y + by * (x >= at)) for k, x, y in spans]
    piece, own = text[a:b], [(k, x - a, y - a) for k, x, y in own]
    if own:
        kind, x, y = rng.choice(own)
        new = altered(rng, kind, piece[x:y])
        others = [s for s in own if s[2] <= x or s[1] >= y]
        if len(others) == len(own) - 1:
            yield piece[:x] + new + piece[y:], [*moved(others, y, len(new) - (y - x)), (kind, x, x + len(new))]
    gaps = [m.end() for m in re.finditer(" ", piece) if not any(x < m.end() < y for _, x, y in own)]
    if gaps:
        at = rng.choice(gaps)
        new, x, y = made_secret(rng)
        yield piece[:at] + new + " " + piece[at:], [*moved(own, at, len(new) + 1), *([("secret", at + x, at + y)] if y else [])]


def train(texts: list[str], epochs: int = 4, rate: float = 0.3, most_regions: int = 500, seed: int = 5) -> Field | None:
    """Learns from at most ``most_regions`` regions of the texts, whose base spans are the labels, and altered copies. Regions
    with a long run of digits and letters, which may or may not be a secret, are left out."""
    rng = random.Random(seed)
    examples: list[tuple[Lattice, set[Span]]] = []
    known = [r for r in chosen(texts, most_regions) if not re.search(MIXED, r[0][r[1] : r[2]])]
    if not any(own for *_, own in known):
        return None
    times = min(8, -(-2 * most_regions // max(1, len(known))))  # few regions are altered more often
    for text, a, b, own in known:
        examples.append((lattice(text[a:b], 0, b - a), {(k, x - a, y - a) for k, x, y in own}))
        for _ in range(times):
            examples += [(lattice(piece, 0, len(piece)), set(spans)) for piece, spans in variants(rng, text, a, b, own)]
    field = Field(sorted({f for lat, _ in examples for *_, fs in lat.segments for f in fs}))
    ready = []
    for lat, spans in examples:
        if lat.segments:
            gold = np.array([[(k, lat.places[i], lat.places[j]) in spans for k in KINDS] for i, j, _ in lat.segments], float)
            ready.append((lat, *field.places(lat), gold))
    for epoch in range(epochs):
        rng.shuffle(ready)
        for lat, ids, begin, gold in ready:
            field.step(lat, ids, begin, gold, rate / (1 + epoch))
    return field


def assess(texts: list[str], field: Field | None, most_regions: int = 2000, seed: int = 17) -> dict[str, tuple[int, int, int]]:
    """By kind: altered spans and made-up secrets in regions of the texts that base patterns miss, how many of them the field
    adds with exact boundaries, and how many spans it adds in all."""
    rng = random.Random(seed)
    out = {k: [0, 0, 0] for k in KINDS}
    for text, a, b, own in chosen(texts, most_regions):
        for piece, spans in () if re.search(MIXED, text[a:b]) else variants(rng, text, a, b, own):
            base = base_spans(piece)
            gold = {s for s in spans if not any(p < s[2] and s[1] < q for _, p, q in base)}
            added = added_spans(piece, base, field)
            for k in KINDS:
                mine = [s for s in added if s[0] == k]
                for i, n in enumerate((sum(s[0] == k for s in gold), sum(s in gold for s in mine), len(mine))):
                    out[k][i] += n
    return {k: tuple(v) for k, v in out.items()}


def added_spans(text: str, base: list[Span], field: Field | None, margin: float = 2.0) -> list[Span]:
    """Segments of the field that overlap no base span and beat the outside by ``margin``."""
    if field is None:
        return []
    out: list[Span] = []
    for a, b in regions(text):
        lat = lattice(text, a, b)
        for kind, x, y, s in field.best(lat) if lat.segments else ():
            # What touches the border of a piece is seen whole in the piece beside it.
            whole = (x > a or not a or b - a < LONG) and (y < b or b == len(text) or b - a < LONG)
            if s >= margin and whole and not any(p < y and x < q for _, p, q in base) and not (out and x < out[-1][2]):
                out.append((kind, x, y))
    return out


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def learn(docs: DataFrame, sample_rows: int = 4000) -> Field | None:
    """From the regions of about ``sample_rows`` different texts (of at most 20,000 characters, which bounds what the driver
    holds) of the whole table: those with the least hashes, in equal parts of the texts that may hold each kind of base
    span and of the others with three digits or an at sign."""
    text = F.col("text")
    found = docs.filter(text.rlike(r"[0-9]{3}|@|[0-9]\.[0-9]+\.[0-9]") & (F.length("text") <= 20_000))
    kinds = [F.when(text.rlike(p), F.lit(k)) for k, p in LIKELY.items()]
    found = found.select("text", F.xxhash64("text").alias("h"), F.array_compact(F.array(*kinds)).alias("kinds"))
    found = found.select("text", "h", F.explode(F.when(F.size("kinds") > 0, F.col("kinds")).otherwise(F.array(F.lit("")))).alias("kind"))
    counts = {r[0]: max(1, r[1]) for r in found.groupBy("kind").agg(F.approx_count_distinct("h", 0.02)).collect()}
    if not counts:
        return None
    want = -(-sample_rows // (len(LIKELY) + 1))
    limit = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, (2 * want + 20) / n) * 2**53))])
    some = found.filter(F.shiftrightunsigned("h", 11) <= limit[F.col("kind")]).groupBy("kind", "h").agg(F.first("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy("h"))
    rows = some.select("text", "h", place.alias("place")).filter(F.col("place") <= want).select("h", "text").distinct().collect()
    return train([r[1] for r in sorted(rows)])


def all_spans(text: str | None, field: Field | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, in order."""
    base = base_spans(text or "")
    return base, in_order([*base, *added_spans(text or "", base, field)])


def find(text: Column, field: Field | None, spark) -> Column:
    """struct<base, spans> of a text column: arrays of struct<kind, begin, end>."""
    shared = spark.sparkContext.broadcast(field)
    span = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))

    def run(texts: list[str | None]) -> pa.Array:
        rows = [all_spans(t, shared.value) for t in texts]
        both = [pa.array([[dict(zip(("kind", "begin", "end"), s, strict=True)) for s in r[k]] for r in rows], span) for k in (0, 1)]
        return pa.StructArray.from_arrays(both, ["base", "spans"])

    one = "array<struct<kind: string, begin: long, end: long>>"
    return per_text(run, f"struct<base: {one}, spans: {one}>")(text)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and all spans as a string."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(learn(docs))
    names = (*(f"n_{k}" for k in BASE), "base_sha256", "spans")

    def run(texts: list[str | None]) -> pa.Array:
        out = []
        for t in texts:
            base, spans = all_spans(t, shared.value)
            kinds = [s[0] for s in base]
            out.append((*(kinds.count(k) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        types = [*[pa.int64()] * 4, pa.string(), pa.string()]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], names)

    returns = ", ".join(f"{n}: {'long' if n.startswith('n_') else 'string'}" for n in names)
    return docs.select("doc_id", per_text(run, f"struct<{returns}>")(F.col("text")).alias("r")).select("doc_id", "r.*")


def redact(text: Column, field: Field | None, spark) -> Column:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    shared = spark.sparkContext.broadcast(field)

    def run(texts: list[str | None]) -> pa.Array:
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            parts, at = [], 0
            for kind, a, b in sorted(all_spans(t, shared.value)[1], key=lambda s: (s[1], -s[2])):
                if a >= at:
                    parts += [t[at:a], f"<{kind}>"]
                    at = b
                elif b > at:
                    at = b
            out.append("".join((*parts, t[at:])))
        return pa.array(out, pa.string())

    return per_text(run, "string")(text)
