"""The delta log as a stream: micro-batches are appended, states follow by adding them up.

Deltas add up in any order but for selections, which go by sequence number, so batches may
come late or twice: a delta's identity is its content, and one that is stored is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import state

SCHEMA = "doc long, seq long, evidence string, selected string"
PARTS = ["doc", "seq", "evidence", "selected"]


def appended(batch: DataFrame, log: str) -> None:
    """Adds a batch's deltas to the Parquet log, each once."""
    spark = batch.sparkSession
    new = state.delta_ids(batch, PARTS).dropDuplicates(["delta_id"])
    try:
        known = spark.read.parquet(log).select("delta_id")
    except Exception as error:  # the first batch finds no log
        if "PATH_NOT_FOUND" not in str(error):
            raise
        known = None
    (new if known is None else new.join(known, "delta_id", "left_anti")).write.mode("append").parquet(log)


def follow(spark: SparkSession, source: str, log: str, checkpoint: str) -> StreamingQuery:
    """Follows a folder of Parquet deltas until what is there is read."""
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    return stream.writeStream.foreachBatch(lambda batch, _: appended(batch, log)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, log: str) -> DataFrame:
    rows = spark.read.parquet(log)
    return state.materialized(rows.limit(0), rows, ["doc"], "seq")


def batches_of(deltas: DataFrame, every: int) -> DataFrame:
    """When a checkpoint is due: after each ``every`` deltas of a document."""
    counts = deltas.groupBy("doc").agg(F.count("*").alias("deltas"))
    return counts.withColumn("due", state.checkpoint_due(F.lit("every"), F.col("deltas"), F.lit(every)))
