"""Every registered report against its SQL twin on the smallest tables."""

import compare
import duckdb
import pytest

from demandgrid.plans import REPORTS
from demandgrid.sources.driver_tables import driver_star


@pytest.fixture(scope="module")
def con(folder):
    return compare.connect(folder)


@pytest.mark.parametrize("name", sorted(n for n, r in REPORTS.items() if r.sql))
def test_report_equals_its_sql_twin(spark, folder, con, name):
    report = REPORTS[name]
    assert compare.differences(report.build(driver_star(spark, folder)), con, report.sql) == []


def test_bin_labels_equal_their_sql_on_repeated_parts_and_unknown_sizes(spark, tmp_path):
    parts = [(10, 1), (10, 1), (20, None), (40, 3), (40, None), (77, 2)]
    columns = "p_partkey bigint, p_type string, p_size int, p_retailprice double"
    spark.createDataFrame([(key, None, size, 1.0) for key, size in parts], columns).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    report = REPORTS["p20_bin_label_format"]
    labels = report.build(driver_star(spark, str(tmp_path)))
    assert labels.count() == 5 and compare.differences(labels, con, report.sql) == []


@pytest.mark.parametrize("keys, labels", [([90, 180, 91], ["5-5%"] * 5), ([10], ["10-10%"] * 5), ([1, None], ["-%"] * 5), ([], ["-%"] * 5)])
def test_bin_labels_equal_their_sql_with_one_discount_or_none(spark, tmp_path, keys, labels):
    columns = "p_partkey bigint, p_type string, p_size int, p_retailprice double"
    spark.createDataFrame([(key, None, 1, 1.0) for key in keys], columns).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    report = REPORTS["p20_bin_label_format"]
    got = report.build(driver_star(spark, str(tmp_path)))
    assert [r.label for r in got.orderBy("bin").collect()] == labels and compare.differences(got, con, report.sql) == []


def test_bootstrap_interval_surrounds_the_mean_and_repeats(spark, folder):
    build = REPORTS["g41_store_attr_bar_interval"].build
    first, second = (sorted(build(driver_star(spark, folder)).collect()) for _ in range(2))
    assert first == second
    assert all(row.ci_lo <= row.mean_units <= row.ci_hi for row in first)


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 200
