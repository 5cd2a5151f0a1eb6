"""The relational test tables seen as series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _as_series(events: DataFrame) -> DataFrame:
    return events.select(
        F.lpad(F.col("user_id").cast("string"), 17, "0").alias("vin"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
        F.regexp_extract("props", "([0-9]+)", 1).try_cast("int").alias("k"),
        "value",
        "event_type",
    )


def events_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vin, ts, k INT, value DOUBLE, event_type STRING) from ``events``."""
    return _as_series(table(spark, sf_dir, "events"))


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same series as a stream of the table's files."""
    schema = table(spark, sf_dir, "events").schema
    return _as_series(spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir))


def orders_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vin, ts, price DOUBLE, status STRING, seq BIGINT) from ``orders``; (vin, ts) repeats."""
    return table(spark, sf_dir, "orders").select(
        F.lpad(F.col("o_custkey").cast("string"), 17, "0").alias("vin"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderkey").alias("seq"),
    )


def lineitem_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vin, ts, line INT, price DOUBLE, flag STRING) from ``lineitem``; dense duplicates, no total order."""
    return table(spark, sf_dir, "lineitem").select(
        F.lpad(F.col("l_suppkey").cast("string"), 17, "0").alias("vin"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ts"),
        F.col("l_linenumber").cast("int").alias("line"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_returnflag").alias("flag"),
    )
