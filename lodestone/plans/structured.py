"""Queries over governed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.structured import Governed, GovernedTable, aggregate_to_evidence, bounded_query, governed_query, governed_session, query_fingerprint, row_identifier, rows_to_evidence
from lodestone.plans.registry import ORACLES, query, table

POLICY = [
    GovernedTable("region", ("r_regionkey", "r_name")),
    GovernedTable("nation", ("n_nationkey", "n_name", "n_regionkey")),
    GovernedTable("customer", ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), keys=("c_custkey",)),
    GovernedTable("supplier", ("s_suppkey", "s_name", "s_nationkey")),
    GovernedTable("part", ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")),
    GovernedTable("orders", ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), keys=("o_orderkey",)),
    GovernedTable("lineitem", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")),
]


def session(spark: SparkSession, sf_dir: str) -> Governed:
    return governed_session(spark, {t.name: table(spark, sf_dir, t.name) for t in POLICY}, POLICY)


def shaped(name: str, statement: str, most_rows: int | None = None, **parameters: object) -> None:
    """Registers a query shape: the same SQL runs on the governed views and in DuckDB; with ``most_rows``, as a bounded query."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = session(spark, sf_dir)
        return governed_query(own, statement, **parameters) if most_rows is None else bounded_query(own, statement, most_rows, **parameters)

    run.__name__ = name
    literal = statement
    for k, v in parameters.items():
        literal = literal.replace(f":{k}", f"'{v}'" if isinstance(v, str) else str(v))
    query(literal)(run)


# The shapes of questions that the path must answer.
shaped("filter_with_parameters", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = :status AND o_totalprice > :least", status="O", least=300000.0)
shaped("date_filter", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderdate >= CAST(:since AS DATE)", since="1998-01-01")
shaped("equi_join", "SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey")
shaped("group_by_aggregate", """SELECT r.r_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, count(*) AS items FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name""")
shaped("top_by_aggregate", """SELECT r.r_name, count(*) AS orders FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name ORDER BY orders DESC, r.r_name LIMIT 1""")
shaped("count_for_period", "SELECT count(*) AS orders FROM orders WHERE o_orderdate >= CAST('1997-03-01' AS DATE) AND o_orderdate < CAST('1997-04-01' AS DATE)")
shaped("average_by_group", "SELECT p.p_brand, round(avg(l.l_extendedprice), 4) AS mean_price FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY p.p_brand")
shaped("arg_max_row", "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1")
shaped("time_trend", "SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, round(sum(o_totalprice), 2) AS sales FROM orders GROUP BY 1")
shaped("cte_alias_limit", "WITH big AS (SELECT o_custkey AS customer, o_totalprice AS price FROM orders WHERE o_totalprice > 250000), best AS (SELECT customer, price FROM big ORDER BY price DESC, customer LIMIT 25) SELECT customer, count(*) AS n, max(price) AS price FROM best GROUP BY customer")
shaped("scalar_functions", """SELECT c_custkey, lower(c_name) AS low, upper(c_mktsegment) AS up, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, abs(c_custkey - 100) AS distance,
concat(c_name, '/', c_mktsegment) AS label, CAST(c_custkey AS DOUBLE) AS number, round(c_custkey / 7.0, 3) AS part FROM customer""")
shaped("date_parts", "SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CAST(extract(month FROM o_orderdate) AS BIGINT) AS m FROM orders")
shaped("bounded_rows", "SELECT o_orderkey FROM orders ORDER BY o_orderkey", most_rows=200)
ORACLES["bounded_rows"] = "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 200"
shaped("semi_join_shape", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_nationkey = 7")
def tenant_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = [GovernedTable("customer", ("c_custkey", "c_name", "c_mktsegment"), tenant="c_nationkey")]
    own = governed_session(spark, {"customer": table(spark, sf_dir, "customer")}, policy, tenant=7)
    return governed_query(own, "SELECT * FROM customer")


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def governed_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of an approved table; of its columns only those that the policy names."""
    return governed_query(session(spark, sf_dir), "SELECT * FROM customer")


@query("SELECT sha256('SELECT * FROM (' || chr(10) || 'SELECT o_orderkey FROM orders' || chr(10) || ') LIMIT 200') AS fingerprint, 'orders' AS tables, count(*) AS \"rows\" FROM orders")
def query_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").agg(F.count("*").alias("rows"))
    return rows.select(query_fingerprint("SELECT o_orderkey FROM orders").alias("fingerprint"), F.lit("orders").alias("tables"), "rows")


@query("""SELECT '{"c_custkey":"' || c_custkey || '","c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}' AS content, 1.0::DOUBLE AS raw_score FROM customer ORDER BY c_custkey LIMIT 20""")
def database_rows_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bounded_query(session(spark, sf_dir), "SELECT c_custkey, c_name, c_mktsegment FROM customer ORDER BY c_custkey", 200)
    return rows_to_evidence(found, ["c_custkey"])


@query("""SELECT '[' || string_agg('{"c_mktsegment":"' || c_mktsegment || '","n":"' || n || '"}', ',' ORDER BY c_mktsegment) || ']' AS content, 1.0::DOUBLE AS raw_score FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)""")
def database_aggregate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bounded_query(session(spark, sf_dir), "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
    return aggregate_to_evidence(found, ["c_mktsegment"])


@query("SELECT 'orders.o_orderkey=' || o_orderkey || ', customer.c_custkey=' || c_custkey AS row_id FROM orders JOIN customer ON o_custkey = c_custkey")
def row_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = governed_query(session(spark, sf_dir), "SELECT o_orderkey AS order_key, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey")
    return found.select(row_identifier([("orders.o_orderkey", "order_key"), ("customer.c_custkey", "c_custkey")]).alias("row_id"))
