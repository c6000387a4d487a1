"""Edge weights over arriving evidence: a Structured Streaming form of the aggregate, with event time and watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_as_evidence(events: DataFrame) -> DataFrame:
    """(ts, donor, receptor, weight) from an event log: user and JSON key choose the nodes."""
    key = F.get_json_object("props", "$.k").cast("long")
    return events.select(F.col("ts").cast("timestamp").alias("ts"), (1 + F.col("user_id") % 63).cast("long").alias("donor"), (1 + key % 63).cast("long").alias("receptor"), F.lit(1).cast("long").alias("weight"))


def windowed_weights(evidence: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, donor, receptor, weight) by tumbling windows; works on streams and on tables."""
    rows = evidence.withWatermark("ts", late) if evidence.isStreaming else evidence
    by = rows.groupBy(F.window("ts", width).alias("w"), "donor", "receptor").agg(F.sum("weight").alias("weight"))
    return by.select(F.col("w.start").alias("start"), "donor", "receptor", "weight")


def run_once(spark: SparkSession, folder: str, schema, checkpoint: str, sink: str, width: str = "1 day") -> DataFrame:
    """What has arrived in folder, through the stream, as the in-memory table named sink."""
    stream = spark.readStream.schema(schema).parquet(folder)
    out = windowed_weights(events_as_evidence(stream), width)
    done = out.writeStream.format("memory").queryName(sink).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.table(sink)
