"""A part of the catalogue against its SQL; tools_compare.py compares all of it."""

import os

import pytest

import __spark_entry__ as entry
from tools_compare import connect, rows

D = "/root/testdata/sf0.001"
NAMES = ["vendor_rates", "monthly_trends", "finding_rows_filtered", "review_queue", "recurrence_prior_findings", "components_exact_opening", "sample_stratified_topk", "latest_reviewed", "span_prf1_per_label", "export_csv_rows", "gold_gates", "split_policies", "partition_vendor", "prepared_evidence", "redaction_flags", "contextual_components", "integrity_violations"]
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="the tables are not here")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    mine, want = entry.queries()[name](spark, D).toPandas(), connect(D).execute(entry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(want.columns) and rows(mine) == rows(want)


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["vendor", "inspected_reports", "affected_reports", "affected_report_rate"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rows_do_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    one = rows(entry.queries()["heatmap_component"](spark, D).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows(entry.queries()["heatmap_component"](spark, D).toPandas()) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
