"""Ages of a backlog."""

import datetime

from pyspark.sql import functions as F

from gaugeline.operators import analytics as A


def test_age_counts_seconds_as_sql_does(spark):
    at = datetime.datetime(2024, 1, 23, 0, 0, 0, 500000)
    rows = spark.createDataFrame([(at,)], "ts timestamp")
    assert rows.select(A.age_days(F.col("ts"), F.lit("2024-01-31").cast("timestamp"))).first()[0] == 8
