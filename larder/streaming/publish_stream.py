"""Publish JSON recipe batches as they land in a folder (Structured Streaming).

``readStream`` over JSON-lines files -> per micro-batch: map to the published
schema and validate -> valid rows written under ``updates/epoch=<id>``,
failures under ``failures/epoch=<id>``. Writes are keyed by the epoch and use
overwrite, so a retried micro-batch (executor loss, restart from the
checkpoint) replaces its own output instead of duplicating it. The current
snapshot is the last version of each id over all epochs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.mapping import map_recipes, validate
from larder.operators.publish import last_by_id
from larder.session import checkpoint_dir


def publish_stream(spark: SparkSession, source_dir: str, target_base: str, schema: str,
                   checkpoint: str | None = None, available_now: bool = True):
    """Start the stream; returns the StreamingQuery."""
    chk = checkpoint or f"{checkpoint_dir(spark)}/publish-stream"
    stream = spark.readStream.schema(schema).json(source_dir)

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        checked = validate(map_recipes(batch))
        checked.filter("valid").drop("valid", "error").withColumn("epoch", F.lit(epoch_id)) \
            .write.mode("overwrite").parquet(f"{target_base}/updates/epoch={epoch_id}")
        checked.filter("NOT valid").select("id", "error").write.mode("overwrite") \
            .parquet(f"{target_base}/failures/epoch={epoch_id}")

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", chk)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def current_snapshot(spark: SparkSession, target_base: str) -> DataFrame:
    """Latest row per id across all published epochs; of an id's rows in one epoch the one with the largest digest."""
    updates = spark.read.option("basePath", f"{target_base}/updates").parquet(f"{target_base}/updates")
    return last_by_id(updates, "epoch")


def failures(spark: SparkSession, target_base: str) -> DataFrame:
    return spark.read.parquet(f"{target_base}/failures")
