"""Query shapes over more than a million rows: none is lost."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.plans.structured import POLICY

ROWS = 1_000_003
VALUES = {
    "o_orderkey": "id", "o_custkey": "id", "c_custkey": "id", "o_orderdate": "timestamp '1999-02-03'", "o_totalprice": "400000.0D", "o_orderstatus": "'O'", "c_nationkey": "7", "n_nationkey": "7",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("many")
    for t in POLICY:
        rows = spark.range(ROWS if t.name in ("orders", "customer") else 1)
        rows.select(*[F.expr(VALUES.get(c, "'x'")).alias(c) for c in t.columns]).write.parquet(f"{path}/{t.name}.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["equi_join", "date_parts", "scalar_functions", "filter_with_parameters", "date_filter", "semi_join_shape", "tenant_filter", "row_identifiers"])
def test_all_rows(spark, folder, name):
    assert entry.queries()[name](spark, folder).count() == ROWS


def test_bounded_rows(spark, folder):
    assert entry.queries()["bounded_rows"](spark, folder).count() == 200
