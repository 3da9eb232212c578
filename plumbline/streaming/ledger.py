"""Streaming ledger: an extension, as the batch operators need no stream.

Entries arrive as JSON lines in a folder. Each micro-batch is appended to the
ledger table once (the batch id names its folder, so that a replay overwrites it),
and open entries are counted per region with closings in the same stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "region string, `when` string, status string, closes string, owner string"


def entries(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(folder)


def append_to(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the stream to a ledger folder; a replayed batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").json(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def open_counts(stream: DataFrame) -> DataFrame:
    """(region, n_open): entries less closings so far; state is one row for each region."""
    step = F.when(F.col("status") == "closed", -1).otherwise(1)
    return stream.groupBy("region").agg(F.sum(step).alias("n_open"))
