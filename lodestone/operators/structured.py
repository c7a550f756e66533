"""Structured retrieval: governed views, bounded parameterized queries, and result rows as evidence.

A statement is text of a user. Spark analyses it as a subquery, so that it can be nothing but a query; then its analysed plan is
walked before anything runs: every relation must be a view that the policy made in this session, every operator and function
must be on a list. Views of other sessions, catalog tables, files, table functions, and functions that call into the JVM or run
user code are refused by being absent.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GovernedTable:
    """What of a table may be queried: columns, the column that holds the tenant, and the keys that name a row."""

    name: str
    columns: tuple[str, ...]
    tenant: str | None = None
    keys: tuple[str, ...] = field(default=())


class RefusedQuery(ValueError):
    """A statement that reaches for something that the policy does not name."""


@dataclass(frozen=True)
class Governed:
    """A session and the only views that its statements may read."""

    session: SparkSession
    views: frozenset[str]


# What a statement may be made of, by the names of Spark's operators and expressions. Whatever is not here is
# refused, so that a new function is closed until it is named.
OPERATORS = frozenset(
    "Aggregate CTERelationDef CTERelationRef Deduplicate Distinct Except Filter GlobalLimit Having Intersect Join LocalLimit Offset OneRowRelation Project Sort SubqueryAlias Union UnresolvedHaving "
    "Window WithCTE".split()
)
FUNCTIONS = frozenset("Abs Cast Coalesce Concat CurrentDate Extract Lower NullIf Nullif Round TruncTimestamp Upper".split())
#: What functions above become, and the signs and words of SQL.
SIGNS = frozenset(
    "CommonExpressionDef CommonExpressionRef TypedNullLiteral With Add AggregateExpression Alias And AttributeReference Between CaseWhen DatePart DateFormatClass DayOfMonth DayOfWeek DayOfYear Divide EqualNullSafe EqualTo Exists GreaterThan GreaterThanOrEqual Hour If In "
    "InSubquery IntegralDivide IsNotNull IsNull LateralColumnAliasReference LessThan LessThanOrEqual Like ListQuery Literal Minute Month Multiply Not Or OuterReference Quarter Remainder ScalarSubquery Second "
    "SecondWithFraction SortOrder SpecifiedWindowFrame Subtract TimestampAddInterval DateAddInterval DateAdd DateSub UnaryMinus UnaryPositive UnboundedFollowing UnboundedPreceding CurrentRow UpCast WeekOfYear "
    "WindowExpression WindowSpecDefinition Year YearOfWeek DateAddYMInterval TimestampAddYMInterval ToPrettyString AnsiCast TempResolvedColumn".split()
)
AGGREGATES = "org.apache.spark.sql.catalyst.expressions.aggregate."
#: Aggregates of this package that run code of a user.
FOREIGN = frozenset("ScalaAggregator ScalaUDAF TypedAggregateExpression SimpleTypedAggregateExpression ComplexTypedAggregateExpression V2Aggregator".split())


def governed_session(spark: SparkSession, tables: dict[str, DataFrame], policy: list[GovernedTable], tenant: object = None) -> Governed:
    """A session in which only the approved tables and columns exist, each with the tenant's rows only. The filter is
    part of the view, so that it reaches the scan; files cannot be queried by path."""
    session = spark.newSession()
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    for t in policy:
        if t.name not in tables:
            raise ValueError(f"unknown table {t.name}")
        df = tables[t.name]
        unknown = {*t.columns, *t.keys, *([t.tenant] if t.tenant else [])} - set(df.columns)
        if unknown:
            raise ValueError(f"unknown columns {sorted(unknown)} of {t.name}")
        if t.tenant is not None:
            if tenant is None:
                raise ValueError(f"{t.name} needs a tenant")
            df = df.filter(F.col(t.tenant) == F.lit(tenant))
        view_of(session, df.select(*t.columns), t.name)
    return Governed(session, frozenset(t.name.lower() for t in policy))


def view_of(session: SparkSession, df: DataFrame, name: str) -> None:
    """``df`` as a view of another session over the same context. It passes through a global view that is gone when this
    returns: the view keeps the plan, not the name."""
    shared = f"governed_{uuid.uuid4().hex}"
    df.createGlobalTempView(shared)
    try:
        session.table(f"global_temp.{shared}").createOrReplaceTempView(name)
    finally:
        df.sparkSession.catalog.dropGlobalTempView(shared)


def items(sequence) -> list:
    """A JVM sequence as a list."""
    return [sequence.apply(i) for i in range(sequence.size())]


def inspected(df: DataFrame, views: frozenset[str]) -> DataFrame:
    """``df`` if its analysed plan reads the given views of its own session, at least one, and nothing else, by the operators and
    functions above; else an error. Nothing of the statement has run by then."""
    read: set[str] = set()

    def relation(node, kind: str) -> bool:
        if kind != "View":
            return False
        name = node.desc().identifier()
        if not node.isTempView() or name.database().isDefined() or name.table().lower() not in views:
            raise RefusedQuery(f"{name.unquotedString()} may not be read")
        read.add(name.table().lower())
        return True

    def plan(node) -> None:
        kind = node.getClass().getSimpleName().rstrip("$")
        if relation(node, kind):
            return  # what a view is made of is the policy's business
        if kind not in OPERATORS:
            raise RefusedQuery(f"{kind} is not allowed")
        for e in items(node.expressions()):
            expression(e)
        for child in items(node.children()):
            plan(child)

    def expression(node) -> None:
        kind = node.getClass()
        name = kind.getSimpleName().rstrip("$")
        known = name in FUNCTIONS or name in SIGNS or (kind.getName().startswith(AGGREGATES) and name not in FOREIGN)
        if not known:
            raise RefusedQuery(f"{node.prettyName()} is not allowed")
        if name in ("ScalarSubquery", "Exists", "ListQuery"):
            plan(node.plan())
        for child in items(node.children()):
            expression(child)

    plan(df._jdf.queryExecution().analyzed())
    if not read:
        raise RefusedQuery("the statement reads no governed table")
    return df


def bounded_query(own: Governed, statement: str, most_rows: int = 200, **parameters: object) -> DataFrame:
    """A SELECT with named parameters, at most ``most_rows`` rows. As a subquery it can be nothing but a query."""
    return inspected(own.session.sql(f"SELECT * FROM (\n{statement}\n) LIMIT {int(most_rows)}", args=parameters or None), own.views)


def governed_query(own: Governed, statement: str, **parameters: object) -> DataFrame:
    """A SELECT with named parameters, with all its rows. As a subquery it can be nothing but a query."""
    return inspected(own.session.sql(f"SELECT * FROM (\n{statement}\n)", args=parameters or None), own.views)


def query_fingerprint(statement: str, most_rows: int = 200) -> Column:
    return F.sha2(F.lit(f"SELECT * FROM (\n{statement}\n) LIMIT {int(most_rows)}"), 256)


def as_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(columns)]))


def rows_to_evidence(rows: DataFrame, order: list[str], k: int = 20) -> DataFrame:
    """The first k rows by ``order``, one evidence each: sorted-key JSON, score 1."""
    return rows.orderBy(*order).limit(k).select(as_json(rows.columns).alias("content"), F.lit(1.0).alias("raw_score"))


def aggregate_to_evidence(rows: DataFrame, order: list[str]) -> DataFrame:
    """The whole (bounded) result as one evidence."""
    items = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], as_json(rows.columns).alias("_json"))))
    return rows.agg(F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: x["_json"]), ","), F.lit("]")).alias("content"), F.lit(1.0).alias("raw_score"))


def row_identifier(parts: list[tuple[str, str]]) -> Column:
    """``table.column=value`` of each key, joined by a comma. parts: (table.column, result column)."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{name}="), F.col(c).cast("string")) for name, c in parts])
