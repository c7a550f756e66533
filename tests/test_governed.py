"""Statements over governed tables: what they may read and call, and what is refused before anything runs."""

import pytest
from pyspark.errors import PySparkException

from lodestone.operators.structured import GovernedTable, RefusedQuery, bounded_query, governed_query, governed_session


@pytest.fixture(scope="module")
def tables(spark):
    return {"t": spark.createDataFrame([(1, "a", 7, 2.0), (2, "b", 8, 3.0), (3, None, 7, 4.0)], "k long, v string, tenant int, x double"), "u": spark.createDataFrame([(1, "2024-03-01")], "k long, d string")}


POLICY = [GovernedTable("t", ("k", "v", "x"), tenant="tenant"), GovernedTable("u", ("k", "d"))]


@pytest.fixture(scope="module")
def own(spark, tables):
    return governed_session(spark, tables, POLICY, tenant=7)


@pytest.mark.parametrize(
    "statement, rows",
    [
        ("SELECT * FROM t", [(1, "a", 2.0), (3, None, 4.0)]),
        ("SELECT T.K FROM T WHERE x > 2 ORDER BY k LIMIT 5", [(3,)]),
        ("WITH c AS (SELECT k, upper(v) AS w FROM t) SELECT c.k, coalesce(w, 'none') FROM c JOIN u ON c.k = u.k", [(1, "A")]),
        ("SELECT count(*), sum(x), avg(x), max(v), min(abs(x)), round(stddev(x), 3) FROM t", [(2, 6.0, 3.0, "a", 2.0, 1.414)]),
        ("SELECT k FROM t WHERE EXISTS (SELECT 1 FROM u WHERE u.k = t.k) AND k IN (SELECT k FROM u) AND x = (SELECT min(x) FROM t)", [(1,)]),
        ("SELECT extract(year FROM CAST(d AS DATE)), CAST(date_trunc('month', CAST(d AS TIMESTAMP)) AS DATE) = CAST('2024-03-01' AS DATE), nullif(k, 2), concat(d, '!') FROM u", [(2024, True, 1, "2024-03-01!")]),
        ("SELECT k FROM t UNION ALL SELECT k FROM u EXCEPT SELECT 3", [(1,)]),
        ("SELECT CASE WHEN k = 1 THEN 'one' ELSE lower('X') END, sum(x) OVER (PARTITION BY v) FROM t WHERE v LIKE 'a%' OR v IS NOT NULL AND k BETWEEN 0 AND 9", [("one", 2.0)]),
        ("SELECT v, count(*) AS n FROM t GROUP BY v HAVING count(*) > 0 AND v IS NOT NULL", [("a", 1)]),
        ("SELECT k FROM t WHERE current_date() > CAST('2020-01-01' AS DATE) AND k - 1 = 0 AND -k < 0", [(1,)]),
    ],
)
def test_what_is_allowed(own, statement, rows):
    assert sorted(map(tuple, governed_query(own, statement).collect()), key=repr) == sorted(rows, key=repr)


def test_parameters_and_bounds(own):
    assert [tuple(r) for r in bounded_query(own, "SELECT k FROM t WHERE k >= :least ORDER BY k", 1, least=1).collect()] == [(1,)]


@pytest.mark.parametrize(
    "statement",
    [
        "SELECT reflect('java.lang.System', 'getProperty', 'user.dir') FROM t",
        "SELECT java_method('java.lang.System', 'getProperty', 'user.dir') FROM t",
        "SELECT k FROM t WHERE v = reflect('java.lang.System', 'getProperty', 'user.dir')",
        "SELECT k FROM t ORDER BY reflect('java.lang.System', 'getProperty', 'user.dir')",
        "SELECT k FROM t WHERE k IN (SELECT length(java_method('java.lang.System', 'getProperty', 'user.dir')) FROM u)",
        "SELECT t.k FROM t JOIN u ON t.k = u.k AND typeof(v) = ''",
        "SELECT input_file_name() FROM t",
        "SELECT sum(length(to_csv(struct(v)))) FROM t",
        "SELECT 1",
        "SELECT * FROM range(5)",
        "SELECT t.k, r.id FROM t, range(5) r",
        "SELECT explode(array(1, 2)) FROM t",
        "SELECT k FROM t LATERAL VIEW explode(array(1)) e AS y",
        "SELECT * FROM VALUES (1), (2)",
        "SELECT current_user(), k FROM t",
        "SELECT rand() FROM t",
        "SELECT from_json(v, 'a int') FROM t",
        "SELECT * FROM (SELECT k FROM t) TABLESAMPLE (50 PERCENT)",
    ],
)
def test_what_is_refused(own, statement):
    with pytest.raises(RefusedQuery):
        governed_query(own, statement)


@pytest.mark.parametrize("statement", ["SELECT tenant FROM t", "DROP VIEW t", "SELECT 1); DROP VIEW t; --", "SELECT * FROM other", "SELECT * FROM parquet.`/tmp`", "INSERT INTO t VALUES (1)", "SELECT 1 FROM t /*"])
def test_what_is_no_query_over_them(own, statement):
    with pytest.raises(PySparkException):
        bounded_query(own, statement)


def test_other_sessions_stay_closed(spark, tables, own):
    """Neither views of another tenant, nor global views, nor tables of the catalog can be read, by any name."""
    theirs = governed_session(spark, tables, POLICY, tenant=8)
    assert [r.k for r in governed_query(theirs, "SELECT k FROM t").collect()] == [2] and [r.k for r in governed_query(own, "SELECT k FROM t").collect()] == [1, 3]
    assert [r.name for r in spark.catalog.listTables("global_temp") if r.name.startswith("governed_")] == []
    spark.range(3).createOrReplaceGlobalTempView("open_to_all")
    spark.range(3).createOrReplaceTempView("t_of_the_first")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW t AS SELECT 99 AS k")
    try:
        with pytest.raises(RefusedQuery):
            governed_query(own, "SELECT * FROM global_temp.open_to_all")
        with pytest.raises(RefusedQuery):
            governed_query(own, "WITH t AS (SELECT id AS k FROM global_temp.open_to_all) SELECT k FROM t")
        with pytest.raises(PySparkException):
            governed_query(own, "SELECT * FROM t_of_the_first")
        assert [r.k for r in governed_query(own, "SELECT k FROM t").collect()] == [1, 3]
    finally:
        spark.catalog.dropGlobalTempView("open_to_all")
        spark.catalog.dropTempView("t")


def test_a_filter_reaches_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id AS k", "id % 5 AS tenant", "'x' AS hidden").write.parquet(f"{tmp_path}/t")
    own = governed_session(spark, {"t": spark.read.parquet(f"{tmp_path}/t")}, [GovernedTable("t", ("k",), tenant="tenant")], tenant=3)
    found = governed_query(own, "SELECT k FROM t WHERE k < 10")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(tenant,3)" in plan and "LessThan(k,10)" in plan and "hidden" not in plan
    assert sorted(r.k for r in found.collect()) == [3, 8]


def test_policies_that_cannot_be(spark, tables):
    for policy, tenant in ((GovernedTable("t", ("nope",)), None), (GovernedTable("x", ()), None), (GovernedTable("t", ("k",), tenant="tenant"), None)):
        with pytest.raises(ValueError):
            governed_session(spark, tables, [policy], tenant)
