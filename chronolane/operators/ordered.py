"""Order-dependent work without one task per key.

Two tools. ``lagged`` gives each row its predecessors with built-in expressions only: rows are cut into (key, time chunk)
groups, and the last rows of a chunk are handed to the next. ``ordered_partitions`` range-partitions rows, so that even one
key that holds a third of all rows is spread evenly; whole partitions are then scanned in Arrow batches, and what depends on
a neighbouring partition is settled from a few rows at the partition edges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolane.session import scratch_path, written

ROWS_PER_PARTITION = 500_000
DAY_MS = 86_400_000


def partition_count(df: DataFrame, rows_per_partition: int = ROWS_PER_PARTITION) -> int:
    """Partitions so that each holds a bounded number of rows, at least the session's shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(df.count() / rows_per_partition))


def ordered_partitions(df: DataFrame, *by: str, partitions: int | None = None) -> DataFrame:
    """Rows in range partitions of about equal size, sorted within. ``by`` should end in a column that splits ties."""
    n = partitions or partition_count(df)
    return df.repartitionByRange(n, *by).sortWithinPartitions(*by)


def kept_partitions(df: DataFrame, what: str, *by: str, partitions: int | None = None) -> DataFrame:
    """Range partitions written as sorted files, one per partition and of one row group each, with their number in ``_part``.

    A file is never split, so a task reads a partition as one stretch of rows in order (and maybe several, one after the
    other). Rows equal in ``by`` share a partition.
    """
    spark = df.sparkSession
    path = scratch_path(spark, what)
    n = partitions or partition_count(df)
    placed = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    placed.write.options(**{"compression": "zstd", "parquet.block.size": str(1 << 30)}).parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def arrival_cuts(rows: DataFrame, arrival: str, slices: int, **more: Column) -> tuple[list[int], Row]:
    """Arrival times (microseconds) that cut the rows into ``slices`` of about equal size; with them other totals of the same pass."""
    at = F.unix_micros(F.col(arrival).cast("timestamp"))
    shares = [i / slices for i in range(1, slices)]
    quantiles = F.percentile_approx(at, shares, 1000) if shares else F.array().cast("array<bigint>")
    row = rows.agg(quantiles.alias("_cuts"), *[c.alias(n) for n, c in more.items()]).first()
    return sorted(set(row["_cuts"] or [])), row


def arrival_slices(rows: DataFrame, arrival: str, cuts: list[int]) -> list[DataFrame]:
    """The rows parted at ``cuts``, in order of arrival; rows that came together stay together, a null arrival belongs to the first."""
    at = F.unix_micros(F.col(arrival).cast("timestamp"))
    out = []
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        part = F.lit(True) if lo is None else at > lo
        if hi is not None:
            part = part & (at <= hi if lo is not None else at.isNull() | (at <= hi))
        out.append(rows.where(part))
    return out


def dense_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """``column`` (distinct values) with dense ids from 0 in its order.

    Range partitions number their rows; a table of one row per partition holds the offsets. Empty input: no rows.
    """
    local = ordered_partitions(df, column).withColumn("_at", F.monotonically_increasing_id())
    local = local.select(column, F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))
    kept = written(local, "ids")
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row per partition
    return kept.join(F.broadcast(offsets), "_part").select(column, (F.col("_before") + F.col("_row")).cast("int").alias(name))


def time_chunk(ts: str = "ts", width: int = DAY_MS):
    return F.expr(f"floor({ts} / {width}d)").cast("bigint") if width > 1 else F.col(ts)


def positions(df: DataFrame, key: str = "vin", ts: str = "ts", name: str = "_pos", width: int = DAY_MS) -> DataFrame:
    """Position of each row in its key's order from 0; (key, ts) must be unique.

    Rows are numbered inside (key, chunk) groups - at most ``width`` rows, one per ms - and a chunk's offset is the running
    count over the chunks of its key. One shuffle of the rows; the join finds them already partitioned.
    """
    rows = df.withColumn("_chunk", time_chunk(ts, width))
    counts = df.select(key, time_chunk(ts, width).alias("_chunk")).groupBy(key, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_row", F.row_number().over(Window.partitionBy(key, "_chunk").orderBy(ts)))
    return (
        numbered.join(offsets, [key, "_chunk"])
        .withColumn(name, (F.col("_before") + F.col("_row") - 1).cast("bigint"))
        .drop("_chunk", "_row", "_before")
    )


def lagged(df: DataFrame, columns: list[str], depth: int = 1, key: str = "vin", ts: str = "ts", width: int = DAY_MS) -> DataFrame:
    """Adds ``_lag``: array of up to ``depth`` preceding rows (structs of ``columns``), nearest first; (key, ts) unique.

    Each non-empty chunk passes on its last ``depth`` rows, so the ``depth`` chunks before always suffice.
    """
    rows = df.withColumn("_chunk", time_chunk(ts, width)).withColumn("_me", F.struct(*columns))
    inside = Window.partitionBy(key, "_chunk").orderBy(ts)
    back = Window.partitionBy(key, "_chunk").orderBy(F.col(ts).desc())
    tails = (
        df.select(key, ts, time_chunk(ts, width).alias("_chunk"), F.struct(*columns).alias("_me"))
        .withColumn("_back", F.row_number().over(back))
        .where(F.col("_back") <= depth)
        .groupBy(key, "_chunk")
        .agg(F.sort_array(F.collect_list(F.struct("_back", "_me"))).alias("_tail"))
        .select(key, "_chunk", F.col("_tail._me").alias("_tail"))
    )
    chunks = Window.partitionBy(key).orderBy("_chunk")
    earlier = F.flatten(F.array(*[F.coalesce(F.lag("_tail", i).over(chunks), F.array()) for i in range(1, depth + 1)]))
    carried = tails.select(key, "_chunk", earlier.alias("_carried"))
    own = F.filter(F.array(*[F.lag("_me", i).over(inside) for i in range(1, depth + 1)]), lambda x: x.isNotNull())
    return (
        rows.withColumn("_own", own)
        .join(carried, [key, "_chunk"])
        .withColumn("_lag", F.slice(F.concat("_own", "_carried"), 1, depth))
        .drop("_chunk", "_me", "_own", "_carried")
    )
