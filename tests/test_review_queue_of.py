"""The queue in one pass has the entries of the queue in three, and records say themselves whether they are in it."""

from pyspark.sql import functions as F

from gaugeline.functions import text as T
from gaugeline.operators import analytics as A
from gaugeline.operators import extract as X
from gaugeline.plans import catalogue

COLUMNS = "record_id string, narrative string, domain string, report_id string, vendor string, report_date string, report_status string"
TINY = "/root/testdata/sf0.001"


def found(spark):
    texts = ["Steel ring cracked; pipe leaking.", "No defects were found.", "Brass gear exhibits flensing.", None, "", "Fine.", "Inspect the door. Rod worn."]
    rows = [(f"r{i}", texts[i % 7], "pipeline", ("p", "", None)[i % 3], ("v", None)[i % 2], None, (None, "reviewed", "", "in_progress")[i % 4]) for i in range(84)]
    return X.findings(X.extract(spark.createDataFrame(rows, COLUMNS)))


def test_one_pass_has_the_entries_of_three(spark):
    rows, flags = found(spark), F.when(T.token_count(F.col("narrative")) < 5, "sparse_text").otherwise("")
    for some in (rows, rows.withColumn("review_priority", F.lit(None).cast("double"))):
        for quality in (flags, None):
            known, got = A.review_queue(some, A.finding_rows(some), quality), A.review_queue_of(some, quality)
            assert known.columns == got.columns
            assert sorted(map(tuple, known.collect()), key=repr) == sorted(map(tuple, got.collect()), key=repr)
            assert {r.record_id for r in A.queued(some, quality).collect()} == {r.record_id for r in got.collect()}


def plan(spark, name):
    return catalogue.queries()[name](spark, TINY)._jdf.queryExecution().optimizedPlan().toString()


def test_the_queue_is_no_union_of_three(spark):
    assert plan(spark, "review_queue").count("explode") == 1


def test_records_of_the_queue_are_told_without_it(spark):
    text = plan(spark, "queue_records_semi")
    assert "LeftSemi" not in text and not [x for x in text.splitlines() if "Filter" in x and "size(" in x]


def test_places_by_age_take_no_window_over_a_priority(spark):
    text = plan(spark, "review_queue_by_age")
    assert "row_number" not in text
