"""Files that arrive are extracted and appended once: structured streaming over the same operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeline.operators.extract import Pack, extract, findings
from gaugeline.operators.store import insert_if_absent


def arriving(spark: SparkSession, path: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """Records that are dropped as JSON lines."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(path)


def ingest(records: DataFrame, store: str, checkpoint: str, keys: Sequence[str] = ("record_id",), packs: Sequence[Pack] = ()) -> StreamingQuery:
    """Extract and append what the store lacks; each batch writes its own directory, so that a repeated batch adds nothing."""

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = findings(extract(batch, packs))
        rows = found.select(*batch.columns, "entities", "findings", "review_candidates", "mapping_status", "review_priority")
        path = f"{store}/batch={number}"
        try:
            before = spark.read.option("basePath", store).parquet(store).where(F.col("batch") < number).select(*keys)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            before = spark.createDataFrame([], batch.select(*keys).schema)
        insert_if_absent(rows, before, list(keys), keys[0]).write.mode("overwrite").parquet(path)

    return records.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def monthly_counts(records: DataFrame, time: str, lateness: str = "31 days") -> DataFrame:
    """Records by month of a stream, late ones up to the watermark."""
    return records.withWatermark(time, lateness).groupBy(F.window(time, "30 days").alias("period")).agg(F.count("*").alias("records"))


def unrepeated(records: DataFrame, keys: Sequence[str], time: str, within: str = "1 day") -> DataFrame:
    return records.withWatermark(time, within).dropDuplicatesWithinWatermark(list(keys))
