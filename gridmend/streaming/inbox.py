"""Detection over an inbox: files are scanned as they arrive. Each file is a unit of its own, so no state is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from gridmend.operators.cells import SCHEMA
from gridmend.operators.registry import Registry
from gridmend.plans.detect import detect


def watch_cells(spark: SparkSession, inbox: str, out: str, checkpoint: str, registry: Registry | None = None, available_now: bool = True) -> StreamingQuery:
    """Watch a folder of Parquet cell tables and append their suspicions to ``out``, by batch, so that a batch that is run again replaces its
    own output."""

    def handle(batch: DataFrame, epoch: int) -> None:
        found = detect(batch, registry).suspicions
        found.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    writer = spark.readStream.schema(SCHEMA).parquet(inbox).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
