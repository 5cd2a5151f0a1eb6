"""Statistics that tell how well a column encodes: gaps, deltas, dictionaries, run lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolane.functions import zigzag_encode
from chronolane.operators.ordered import lagged, positions


def timestamp_gaps(df: DataFrame) -> DataFrame:
    """(vin, ts, gap): ms since the entity's previous row; the first row has none and is left out."""
    return lagged(df.select("vin", "ts"), ["ts"]).where(F.size("_lag") == 1).select("vin", "ts", (F.col("ts") - F.col("_lag")[0]["ts"]).alias("gap"))


def int_deltas(df: DataFrame, column: str) -> DataFrame:
    """(vin, ts, delta, zz): difference to the previous row and its zigzag code."""
    delta = (F.col(column).cast("bigint") - F.col("_lag")[0][column].cast("bigint")).alias("delta")
    rows = lagged(df.select("vin", "ts", column), [column]).where(F.size("_lag") == 1).select("vin", "ts", delta)
    return rows.withColumn("zz", zigzag_encode(F.col("delta")))


def third_deltas(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    """(vin, ts, d3): third-order difference of a double column, rounded."""
    x = [F.col(column), *[F.col("_lag")[i][column] for i in range(3)]]
    d3 = F.round(x[0] - 3 * x[1] + 3 * x[2] - x[3], digits).alias("d3")
    return lagged(df.select("vin", "ts", column), [column], depth=3).where(F.size("_lag") == 3).select("vin", "ts", d3)


def dictionary_sizes(df: DataFrame, column: str, block_rows: int = 250) -> DataFrame:
    """(vin, blk, n_distinct): distinct values of a column in each block of consecutive rows."""
    blk = F.expr(f"_pos div {block_rows}").cast("bigint").alias("blk")
    pairs = positions(df.select("vin", "ts", column)).select("vin", blk, column).distinct()
    return pairs.groupBy("vin", "blk").agg(F.count(column).cast("bigint").alias("n_distinct"))


def column_profile(df: DataFrame, column: str) -> DataFrame:
    """One row: count, min, max, distinct values, runs in entity order, mean run length, share of whole numbers.

    Nulls and NaN don't count as values; a run ends where the next row of the entity differs. No rows: counts 0, null rest.
    """
    v = F.col(column).cast("double")
    clean = df.select("vin", "ts", v.alias("v")).where(v.isNotNull() & ~F.isnan(v))
    rows = lagged(clean, ["v"]).select("v", (F.coalesce(F.get("_lag", F.lit(0))["v"] != F.col("v"), F.lit(True))).alias("start"))
    # distinct values counted by value first: partial sums per value, then one row per value
    values = rows.groupBy("v").agg(F.count("*").alias("n"), F.count_if("start").alias("runs"))
    n = F.coalesce(F.sum("n"), F.lit(0)).cast("bigint")
    return values.agg(
        n.alias("n"), F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.count("*").cast("bigint").alias("n_distinct"),
        F.coalesce(F.sum("runs"), F.lit(0)).cast("bigint").alias("n_runs"),
        F.round(F.sum("n") / F.nullif(F.sum("runs"), F.lit(0)), 6).alias("mean_run"),
        F.round(F.sum(F.when(F.col("v") == F.floor("v"), F.col("n")).otherwise(0)) / F.nullif(F.sum("n"), F.lit(0)), 6).alias("whole_share"),
    )


def smoothness(df: DataFrame, column: str) -> DataFrame:
    """One row (n, mean_change, std_change, smoothness): how evenly a column moves from row to row.

    Over the signed changes between an entity's neighbouring rows: their mean, standard deviation, and the latter over the
    absolute mean (near 0 for a column that moves evenly, null if the mean is 0). Nulls, NaN and infinities are skipped.
    Without any change: ``n`` 0, the rest null.
    """
    v = F.col(column).cast("double")
    clean = df.select("vin", "ts", v.alias("v")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    step = lagged(clean, ["v"]).where(F.size("_lag") == 1).select((F.col("v") - F.col("_lag")[0]["v"]).alias("d"))
    moved = step.agg(F.count("*").alias("n"), F.avg("d").alias("mean_change"), F.stddev_pop("d").alias("std_change"))
    return moved.withColumn("smoothness", F.col("std_change") / F.nullif(F.abs("mean_change"), F.lit(0.0)))
