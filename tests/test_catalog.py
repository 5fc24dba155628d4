"""A few queries of the catalog against their SQL; the driver runs them all."""

import os

import duckdb
import pytest

from rowforge.plans import catalog

SF = "/root/testdata/sf0.001"
SOME = ["log1p_colsum", "normalize_rows", "row_take_ints", "argmax_all", "repartition_after_mask", "zarr_ncopies", "evaluate_many", "int_wraps", "cross_source_add", "median_axis0", "percentile_axis1", "quantile_vector", "cumsum_axis0", "cumsum_vector", "cumprod_axis0", "argsort_axis1", "sort_vector", "argsort_vector", "unique_values", "matmul_joined", "matmul_arrays", "row_operand_array", "frexp_mantissa", "frexp_exponent", "zarr_mapping", "fmax", "fmin"]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{table}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE[name]})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want)


def test_cross_source_add_has_all_common_rows(spark):
    """Against a join of the whole tables: 10,000 events meet 15,000 orders."""
    sf = "/root/testdata/sf0.01"
    want = duckdb.sql(f"SELECT o_orderkey, round(o_totalprice + value, 6) + 0.0 FROM '{sf}/orders.parquet' JOIN '{sf}/events.parquet' ON o_orderkey = event_id").fetchall()
    got = catalog.QUERIES["cross_source_add"](spark, sf).select("i", "x").collect()
    assert len(want) > 5000 and sorted(map(tuple, got)) == sorted(want)


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 64
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_row_operands_are_lazy(spark):
    """A row operand that is an array itself runs as a subquery of the one plan: no job runs while it is made."""
    x = catalog.embeddings(spark, SF)
    spark.sparkContext.setJobGroup("making", "")
    made = ((x - x.mean(axis=0)) / x.std(axis=0)).to_df()
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("making")
    spark.sparkContext.setJobGroup("other", "")
    assert "Subquery" in made._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    """No join and one scan where operands share rows; slices reach the scan."""
    one = catalog.QUERIES["normalize_rows"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in one and one.count("FileScan") == 1
    cut = catalog.QUERIES["row_slice"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(vec_id,100)" in cut and "LessThan(vec_id,200)" in cut
    total = catalog.QUERIES["sum_axis0"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in total and "transform(" not in total
