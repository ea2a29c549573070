"""New documents judged as they arrive.

Each micro-batch is judged by itself: rules within one document need no state,
and references reach the documents that the batch brings along. Findings are
appended with their batch number, so a batch that is run again replaces its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assayer.plans.validate import validate
from assayer.rules.pack import RulePack


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and text of JSON files that appear in a folder."""
    rows = spark.readStream.option("pathGlobFilter", "*.json").schema("value string").text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def watch(documents: DataFrame, pack: RulePack, folder: str, checkpoint: str) -> StreamingQuery:
    """Judges every micro-batch and writes its findings under ``folder``, one subfolder a batch."""

    def judge(batch: DataFrame, number: int) -> None:
        validate(batch, pack).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return documents.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).start()
