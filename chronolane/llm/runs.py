"""Runs of repeated consecutive events, each collapsed into one event.

Rows are range-partitioned by (vin, ts, seq), so one entity's rows - or many rows at one time - are spread over partitions.
Each partition gathers its run starts into a sorted array and assigns its events to them by binary search; runs cut by a
partition bound are joined from two rows per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolane.functions import fold_text
from chronolane.operators.ordered import ordered_partitions
from chronolane.session import written

TOLERANCE = 0.5
LOCAL = "part int, run bigint, head boolean, tail boolean, vin string, ts_from bigint, ts_to bigint, n_rows bigint, col1 int, col3 string, first2 double, last2 double"


def _scan(tolerance: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts).combine_chunks()
        n = t.num_rows

        def codes(name: str) -> np.ndarray:
            c = t[name].combine_chunks()
            c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
            return c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)

        ts, two = t["ts"].to_numpy(), t["two"].to_numpy()  # a missing number comes as NaN
        same = np.ones(n, bool)
        same[0] = False
        for name in ("vin", "col1", "three"):
            c = codes(name)
            same[1:] &= c[1:] == c[:-1]
        a, b = two[1:], two[:-1]
        none = np.isnan(a) & np.isnan(b)
        with np.errstate(invalid="ignore"):
            same[1:] &= none | (a == b) | (np.abs(a - b) <= tolerance)
        starts = np.flatnonzero(~same)  # sorted run starts
        run_of = np.searchsorted(starts, np.arange(n), side="right") - 1  # each event's run
        sizes = np.bincount(run_of, minlength=len(starts))
        ends = starts + sizes - 1
        k = len(starts)
        at = pa.array(starts)
        number = np.arange(k)
        yield pa.RecordBatch.from_arrays(
            [
                pa.repeat(pa.scalar(TaskContext.get().partitionId(), pa.int32()), k), pa.array(number), pa.array(number == 0), pa.array(number == k - 1),
                t["vin"].combine_chunks().take(at), pa.array(ts[starts]), pa.array(ts[ends]), pa.array(sizes),
                t["col1"].combine_chunks().take(at), t["three"].combine_chunks().take(at), pa.array(two[starts]), pa.array(two[ends]),
            ],
            names=["part", "run", "head", "tail", "vin", "ts_from", "ts_to", "n_rows", "col1", "col3", "first2", "last2"],
        )

    return scan


def event_runs(rows: DataFrame, tolerance: float = TOLERANCE, partitions: int | None = None) -> DataFrame:
    """(vin, ts_from, ts_to, duration_ms, n_rows, col1, col3): every maximal run, single events included.

    Within a vin, in order (ts, seq), a row repeats the row before if ``col1`` is equal (null equals null), ``col3`` is equal
    but for case and outer space (null equals only null) and ``col2`` is missing (null, NaN) in both, or present in both and
    at most ``tolerance`` apart; equal infinities are equal. Rows with a null vin or ts are ignored. ``col3`` comes out folded.
    An empty table gives no runs.
    """
    two = F.coalesce("col2", F.lit(float("nan"))).alias("two")
    keyed = rows.where(F.col("vin").isNotNull() & F.col("ts").isNotNull()).select("vin", F.col("ts").cast("bigint").alias("ts"), "seq", "col1", two, fold_text(F.col("col3")).alias("three"))
    ordered = ordered_partitions(keyed, "vin", "ts", "seq", partitions=partitions)
    local = written(ordered.mapInArrow(_scan(tolerance), LOCAL), "runs")
    inner = local.where(~F.col("head") & ~F.col("tail"))
    order = Window.partitionBy("vin").orderBy("part", "run")
    was = lambda c: F.lag(c).over(order)
    near = F.abs(F.col("first2") - was("last2")) <= tolerance
    alike2 = (F.isnan("first2") & F.isnan(was("last2"))) | (F.col("first2") == was("last2")) | (near & ~F.isnan("first2") & ~F.isnan(was("last2")))
    # the last run of a partition goes on in the first run of the next one
    joined = F.coalesce(was("tail") & F.col("head") & F.col("col1").eqNullSafe(was("col1")) & F.col("col3").eqNullSafe(was("col3")) & alike2, F.lit(False))
    edge = local.where(F.col("head") | F.col("tail")).withColumn("_new", F.when(joined, 0).otherwise(1)).withColumn("_no", F.sum("_new").over(order))
    ends = [F.min("ts_from").alias("ts_from"), F.max("ts_to").alias("ts_to"), F.sum("n_rows").alias("n_rows"), F.first("col1").alias("col1"), F.first("col3").alias("col3")]
    bridged = edge.groupBy("vin", "_no").agg(*ends)
    columns = ["vin", "ts_from", "ts_to", "n_rows", "col1", "col3"]
    both = inner.select(*columns).unionByName(bridged.select(*columns))
    return both.select("vin", "ts_from", "ts_to", (F.col("ts_to") - F.col("ts_from")).alias("duration_ms"), "n_rows", "col1", "col3")
