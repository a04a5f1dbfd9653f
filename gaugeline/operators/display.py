"""What a page shows of records, findings and runs: projections and small aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.functions import text as T
from gaugeline.operators.analytics import workflow

#: Columns that a prediction fills; a gold record is read without them.
PREDICTED = ("entities", "findings", "relations", "review_candidates", "absences", "mapping_status", "assertion_status", "reported_severity", "review_priority", "clean_to_display")


def evidence(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Finding rows as a table shows them: the report's number, or else its document, and lists joined by commas."""
    names = records.select("record_id", F.coalesce(T.blank_to_null(F.col("report_number")), F.col("source_document")).alias("report"))
    lists = [F.array_join(c, ", ").alias(c) for c in ("component", "material", "severity")]
    return rows.join(names, "record_id").select("finding_id", "vendor", "report", "date", "defect", "evidence", "assertion", "priority", *lists, "reasons")


def choices(records: DataFrame) -> DataFrame:
    """(record_id, label) of records as a list offers them."""
    return records.select("record_id", F.concat_ws(" · ", "source_document", F.coalesce("vendor", F.lit("Unknown")), F.col("source_row").cast("string"), F.right("record_id", F.lit(8))).alias("label"))


def state() -> Column:
    return (
        F.when(workflow() == "reviewed", "Reviewed").when(F.col("mapping_status") == "review_required", "Needs review")
        .when(F.size("absences") > 0, "Explicit no-defect wording").otherwise("No supported defect extracted")
    )


def version_counts(records: DataFrame, metadata: str = "document_metadata") -> DataFrame:
    """Narratives by extractor version and mode, as a map of metadata names them."""
    said = lambda key: F.coalesce(F.try_element_at(metadata, F.lit(key)), F.lit("unknown"))
    return records.groupBy(said("extractor_version").alias("version"), said("extraction_mode").alias("mode")).agg(F.count("*").alias("narratives"))


def with_run_times(versions: DataFrame, runs: DataFrame) -> DataFrame:
    """versions(run_id, ...) with created_at of their run; a version without a run does not appear."""
    return versions.join(runs.select("run_id", F.col("created_at").alias("run_at")), "run_id")


def blank_predictions(rows: DataFrame) -> DataFrame:
    """Gold rows without what a prediction would fill."""
    return rows.drop(*PREDICTED)


def signature(inputs: Sequence[Column], settings: Column) -> Column:
    """SHA-256 of all that a result depends on: another input or setting, another signature; null and blank differ."""
    named = F.struct(*[c.alias(f"input_{i}") for i, c in enumerate(inputs)], settings.alias("settings"))
    return F.sha2(F.to_json(named, {"ignoreNullFields": "false"}).cast("binary"), 256)
