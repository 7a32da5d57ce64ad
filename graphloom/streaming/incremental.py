"""Incremental ingest: only new contents, each exactly once in the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import latest


def unprocessed(parsed: DataFrame, processed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents that no run has processed yet."""
    return parsed.join(processed.select(key), key, "left_anti")


def upsert_batch(known: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a batch replace those with the same keys."""
    return latest(known.unionByName(batch, allowMissingColumns=True), keys)


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> None:
    """Everything that is new in ``source`` into versioned Parquet under ``target``: one folder per batch id.

    A batch that is repeated after a failure overwrites its own folder, so each row counts once; content hashes that
    earlier batches have are left out."""

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.withColumn("content_hash", F.sha2("text", 256)).dropDuplicates(["content_hash"])
        if batch_id:
            before = spark.read.option("recursiveFileLookup", True).parquet(target).where(~F.input_file_name().contains(f"/batch={batch_id}/"))
            fresh = fresh.join(before.select("content_hash"), "content_hash", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
