"""CSV sources: strict reading with a report of every broken record, contract checks, conservative types, previews, and writing by
the contract.

Files are bounded by the contract (``most_bytes``), so a task parses a file at a time: quotes may run over lines, and only a parser
that has read the file from its beginning knows which line ends end a record. Larger files are refused by their length, which
the listing has, and are not opened.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Shapes of logical types, in order of precedence.
BOOLEAN = r"(?i)^(true|false|yes|no)$"
INTEGER = r"^[+-]?\d+$"
DECIMAL = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
DATETIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"
DATE = r"^\d{4}-\d{2}-\d{2}$"


@dataclass(frozen=True)
class Contract:
    """What a file may hold."""

    most_bytes: int = 10_000_000
    most_rows: int = 100_000
    most_columns: int = 200
    longest: int = 100_000


RECORD = pa.schema([("row", pa.int64()), ("rule", pa.string()), ("detail", pa.string()), ("fields", pa.list_(pa.string()))])
BATCH = 1000


def header_faults(names: list[str], limits: Contract) -> Iterator[tuple[str, str]]:
    if len(names) > limits.most_columns:
        yield "too_many_columns", str(len(names))
    if not all(names):
        yield "blank_header", str(names.index("") + 1)
    doubled = sorted({n for n in names if names.count(n) > 1})
    if doubled:
        yield "doubled_header", ", ".join(doubled)
    for n in names:
        if len(n) > limits.longest:
            yield "long_header", n[:50]


def records(data: bytes, limits: Contract) -> Iterator[tuple[int, str | None, str | None, list[str | None] | None]]:
    """(row, rule, detail, fields) of a file: its header as row 0, then each data record with a rule if it breaks one. Faults of
    the whole file have row -1. Empty fields are null; names in the header are trimmed."""
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        yield -1, "encoding", f"byte {e.start}", None
        return
    if "\x00" in text:
        yield -1, "null_byte", f"character {text.index(chr(0))}", None
        return
    reader = csv.reader(io.StringIO(text, newline=""), strict=True)
    row, names, filled = -1, None, False
    while True:
        row += 1
        try:
            fields = next(reader, None)
        except csv.Error as e:
            yield row, "malformed", str(e), None
            if row == 0:
                return
            continue
        if fields is None:
            break
        if row == 0:
            names = [x.strip() for x in fields]
            for rule, detail in header_faults(names, limits):
                yield 0, rule, detail, None
            yield 0, None, None, names
            continue
        if row == limits.most_rows + 1:
            yield -1, "too_many_rows", f"more than {limits.most_rows}", None
        if len(fields) != len(names):
            yield row, "field_count", f"{len(fields)} of {len(names)}", None
        elif max(map(len, fields), default=0) > limits.longest:
            yield row, "long_field", names[next(i for i, x in enumerate(fields) if len(x) > limits.longest)], None
        else:
            filled = filled or any(fields)
            yield row, None, None, [x or None for x in fields]
    if names is None:
        yield -1, "empty", "no header", None
    elif row == 1:
        yield -1, "no_rows", "0", None
    elif not filled:
        yield -1, "no_values", "0", None


def csv_records(spark: SparkSession, path: str, limits: Contract = Contract()) -> DataFrame:
    """(file, row, rule, detail, fields) of all files below ``path``: sound records (``rule`` is null) and every fault. No file
    fails the query."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = F.lower("path").endswith(".csv")
    refused = files.select(F.col("path").alias("file"), F.when(~named, "extension").when(F.col("length") > limits.most_bytes, "too_large").alias("rule"), F.col("length").cast("string").alias("detail")).filter("rule is not null")
    # The bound on the length is taken from the listing, so that the content of larger files is never read.
    small = files.filter(named & (F.col("length") <= limits.most_bytes)).select(F.col("path").alias("file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("file").to_pylist(), b.column("content"), strict=True):
                held = []
                for r in records(content.as_py(), limits):
                    held.append(dict(zip(RECORD.names, r, strict=True)))
                    if len(held) == BATCH:
                        yield named_batch(file, held)
                        held = []
                if held:
                    yield named_batch(file, held)

    def named_batch(file: str, rows: list[dict]) -> pa.RecordBatch:
        part = pa.RecordBatch.from_pylist(rows, RECORD)
        return pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), *part.columns], ["file", *RECORD.names])

    schema = "file string, row long, rule string, detail string, fields array<string>"
    whole = refused.select("file", F.lit(-1).cast("long").alias("row"), "rule", "detail", F.lit(None).cast("array<string>").alias("fields"))
    return small.mapInArrow(run, schema).unionByName(whole)


def csv_faults(found: DataFrame) -> DataFrame:
    """(file, row, rule, detail): every fault of :func:`csv_records`."""
    return found.filter("rule is not null").select("file", "row", "rule", "detail")


def csv_verdicts(found: DataFrame) -> DataFrame:
    """(file, accepted, rows, faults): a file is accepted if nothing in it is at fault."""
    return found.groupBy("file").agg((F.count("rule") == 0).alias("accepted"), F.count_if((F.col("row") > 0) & F.col("rule").isNull()).alias("rows"), F.count("rule").alias("faults"))


def read_csv_strict(spark: SparkSession, path: str, columns: list[str] | None = None, limits: Contract = Contract()) -> DataFrame:
    """The rows of all accepted files below ``path``, all text, with ``_file`` and ``_row``; by ``columns`` or else the header that
    the accepted files share. Files at fault are left out whole: :func:`csv_faults` says why. An error if there is no file to
    accept or headers differ."""
    found = csv_records(spark, path, limits)
    accepted = csv_verdicts(found).filter("accepted").select("file")
    if columns is None:
        heads = found.filter("row = 0 and rule is null").join(accepted, "file", "left_semi").select("fields").distinct().limit(2).collect()
        if len(heads) != 1:
            raise ValueError("headers differ" if heads else "no file is accepted")
        columns = list(heads[0][0])
    rows = found.filter("row > 0 and rule is null").join(accepted, "file", "left_semi")
    return rows.select(F.col("file").alias("_file"), F.col("row").alias("_row"), *[F.col("fields")[i].alias(c) for i, c in enumerate(columns)])


def write_csv(rows: DataFrame, path: str, limits: Contract = Contract(), least: int = 4) -> None:
    """``rows`` as text in CSV files below ``path``, as many as keep each within the contract's rows and bytes whatever the lengths of
    its records; dealt ``least`` ways at least. Null and empty fields are alike. What no file can hold under the contract (a record longer
    than a file, a file of nothing but empty fields) is written, and readers report it."""
    text = rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns])
    # At most two quotes, a separator, and each quote doubled.
    sized = text.withColumn("_bytes", sum(2 * F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) + 3 for c in rows.columns).cast("long"))
    total, count = sized.agg(F.coalesce(F.sum("_bytes"), F.lit(0)), F.count("*")).first()
    # A record beyond half a file has one of its own. The others begin below the half, so that they end within the file.
    half = max(1, (limits.most_bytes - sum(2 * len(c.encode()) + 3 for c in rows.columns)) // 2)
    deals = max(least, -(-total // half), -(-2 * count // limits.most_rows))
    dealt = sized.withColumns({"_hash": F.xxhash64(*[f"`{c}`" for c in rows.columns]), "alone": F.col("_bytes") > half}).withColumn("deal", F.pmod("_hash", F.lit(deals)))
    before = Window.partitionBy("deal", "alone").orderBy("_hash").rowsBetween(Window.unboundedPreceding, -1)
    place, begins = F.count("*").over(before), F.coalesce(F.sum("_bytes").over(before), F.lit(0))
    cuts = {"by_rows": F.floor(place / F.lit(limits.most_rows)), "by_bytes": F.when(F.col("alone"), place).otherwise(F.floor(begins / F.lit(half)))}
    exact = {"header": True, "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    dealt.withColumns(cuts).drop("_bytes", "_hash").write.partitionBy("deal", "alone", *cuts).options(**exact).csv(path)


def infer_types(rows: DataFrame) -> DataFrame:
    """(column, type) of text columns in one pass: the first of boolean, integer, decimal, datetime, date that fits all
    values that are not null; text otherwise, and for columns without values."""
    one = rows.agg(*[kind_of(c).alias(f"c{i}") for i, c in enumerate(rows.columns)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("type")) for i, c in enumerate(rows.columns)])).alias("p")).select("p.*")


def kind_of(c: str) -> Column:
    """The type of a text column, as an aggregate."""
    text = F.trim(F.col(f"`{c}`"))

    def all_like(pattern: str, also: Column | None = None) -> Column:
        fits = text.rlike(pattern)
        return F.bool_and(fits if also is None else fits & also)

    day = F.expr(f"try_to_date(trim(`{c}`), 'yyyy-MM-dd')").isNotNull()
    moment = F.expr(f"try_cast(trim(`{c}`) AS timestamp)").isNotNull()
    return (
        F.when(F.count(f"`{c}`") == 0, "text").when(all_like(BOOLEAN), "boolean").when(all_like(INTEGER), "integer").when(all_like(DECIMAL), "decimal")
        .when(all_like(DATETIME, moment), "datetime").when(all_like(DATE, day), "date").otherwise("text")
    )


def preview(rows: DataFrame, order: list[str], first: int = 10) -> DataFrame:
    """(column, type, row_count, sample) in one pass: each column's type, the number of rows, and its values in the first rows by
    ``order``."""
    names = [c for c in rows.columns if c not in order]
    head = F.slice(F.array_sort(F.collect_list(F.struct(*order, *[F.col(f"`{c}`") for c in names]))), 1, first)
    # Only the first rows of each task's part can be first of all: what is collected is bounded by a limit before it.
    top = rows.orderBy(*order).limit(first).agg(head.alias("head"))
    one = rows.agg(F.count("*").alias("row_count"), *[kind_of(c).alias(f"c{i}") for i, c in enumerate(names)]).join(F.broadcast(top), F.lit(True))
    sample = lambda c: F.transform("head", lambda h: h[c])
    each = [F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("type"), sample(c).alias("sample")) for i, c in enumerate(names)]
    return one.select("row_count", F.explode(F.array(*each)).alias("p")).select("p.column", "p.type", "row_count", "p.sample")
