"""Counts of earlier findings agree with their lists and take no list."""

from pyspark.sql import functions as F

from gaugeline.operators import analytics as A
from gaugeline.operators import extract as X

COLUMNS = "record_id string, narrative string, domain string, report_id string, vendor string, report_date string, report_status string, asset_id string, batch string"


def found(spark):
    texts = ["Steel ring cracked.", "Pipe leaking; rod cracked.", "No crack observed.", "Possible leak."]
    rows = [(f"r{i}", texts[i % 4], "pipeline", (f"p{i % 11}", "", None)[i % 7 // 3], ("One", "one ", "Two", " ")[i % 5 // 2], f"2024-01-{1 + i % 9:02}" if i % 13 else None, None, "" if i % 3 else "a", "b") for i in range(200)]
    return X.findings(X.extract(spark.createDataFrame(rows, COLUMNS)))


def test_counts_are_the_sizes_of_the_lists(spark):
    rows = found(spark)
    listed = {r.finding_id: r.n for r in A.recurrence(rows).select("finding_id", F.size("previous").alias("n")).collect()}
    counted = A.recurrence_counts(rows).collect()
    assert len(counted) == len(listed) > 100 and {r.finding_id: r.n_previous for r in counted} == listed


def test_the_query_of_a_hot_vendor_makes_no_lists_of_earlier_findings(spark):
    from gaugeline.plans import catalogue

    plan = catalogue.queries()["recurrence_hot_vendor"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "flatten" not in plan
