"""Structured Streaming: ingest into tables, windowed aggregates with watermarks, the latest row per entity."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronolane.sources import files
from chronolane.sources.storage import TsTable


def ingest(stream: DataFrame, table: TsTable, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upserts each micro-batch as one commit.

    The commit names the stream, by the id kept in its checkpoint folder, and the batch's number: a repeated batch isn't
    written twice, and other streams, or one begun anew in another folder, aren't taken for this one.
    """

    def put(batch: DataFrame, number: int) -> None:
        stream_id = json.loads(files.read_text(table.spark, f"{checkpoint.rstrip('/')}/metadata"))["id"]
        table.write(batch, transaction=(stream_id, number))

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def downsample_stream(stream: DataFrame, column: str, interval_ms: int, lateness: str, anchor_ms: int = 0) -> DataFrame:
    """Per entity and tumbling window the average, maximum and count of a column; rows later than the watermark are dropped.

    In append mode a window comes out once, when the watermark has passed its end, and its state is freed then; in update mode
    after every change.
    """
    timed = stream.withColumn("_at", F.timestamp_millis("ts")).withWatermark("_at", lateness)
    win = F.window("_at", f"{interval_ms} milliseconds", f"{interval_ms} milliseconds", f"{anchor_ms % interval_ms} milliseconds")
    out = timed.groupBy("vin", win).agg(F.avg(column).alias("avg"), F.max(column).alias("max"), F.count("*").alias("n"))
    return out.select("vin", F.unix_millis("window.start").alias("ts"), "avg", "max", "n")


def latest_stream(stream: DataFrame) -> DataFrame:
    """The newest row per entity, to be written in update mode: one row of state per entity."""
    rest = [c for c in stream.columns if c != "vin"]
    return stream.groupBy("vin").agg(F.max_by(F.struct(*rest), "ts").alias("_row")).select("vin", "_row.*")


def materialize(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a streaming aggregate over all that is there and gives its result, kept as a table.

    Complete mode: each micro-batch replaces the table by the whole result so far.
    """

    def put(batch: DataFrame, _number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(path)


def append_closed(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the windows that the watermark has closed to a Parquet table; each comes out once."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
