"""Sessions parted by silence, kept in an incremental session table.

A batch is first reduced to local sessions, then merged with the stored ones: sessions that a new one touches or bridges
become one, and the affected folders are replaced by one atomic version change.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolane.functions import poly_bucket
from chronolane.operators.ordered import DAY_MS, arrival_cuts, arrival_slices
from chronolane.session import scratch_path, written
from chronolane.sources import files
from chronolane.sources.versions import Versions, fresh_name, sweep

GAP_MS = 1_800_000
PERIODS = 1024  # folders per bucket: periods are counted around, so any time has one
ROWS_PER_BUCKET = 20_000_000
SCHEMA = "vin string, ts_from bigint, ts_to bigint, n_rows bigint"


def _merged(parts: DataFrame, gap_ms: int) -> DataFrame:
    """Intervals of one entity at most ``gap_ms`` apart become one. Parts per entity are bounded by time span / gap."""
    order = Window.partitionBy("vin").orderBy("ts_from", "ts_to")
    reach = F.max("ts_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(F.col("ts_from") - reach <= gap_ms, 0).otherwise(1)
    numbered = parts.withColumn("_new", starts).withColumn("_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = [F.min("ts_from").alias("ts_from"), F.max("ts_to").alias("ts_to"), F.sum("n_rows").alias("n_rows")]
    return numbered.groupBy("vin", "_no").agg(*ends).select("vin", "ts_from", "ts_to", "n_rows")


def local_sessions(rows: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """(vin, ts_from, ts_to, n_rows) of the rows alone.

    Rows are first reduced per slot of ``gap_ms``: rows of one slot are always in one session, so the reduction is exact, is
    done partially before the shuffle, and leaves at most span / gap rows of any entity, however hot. Rows with a null vin or
    ts are ignored; repeated rows count in ``n_rows``; an empty table gives no sessions.
    """
    keyed = rows.where(F.col("vin").isNotNull() & F.col("ts").isNotNull())
    slot = ((F.col("ts") - F.pmod("ts", F.lit(gap_ms))) / gap_ms).cast("bigint").alias("_slot")
    ends = [F.min("ts").alias("ts_from"), F.max("ts").alias("ts_to"), F.count("*").alias("n_rows")]
    return _merged(keyed.select("vin", "ts", slot).groupBy("vin", "_slot").agg(*ends).drop("_slot"), gap_ms)


class SessionTable:
    """Stored sessions below a path of the shared file system; versions are switched atomically (``sources.versions``).

    Sessions lie in folders by entity hash and by period of their start. A version names each folder's place and the time its
    sessions span, so a batch reads and rewrites only the folders that hold a session within the gap of a new one.
    """

    def __init__(self, spark: SparkSession, path: str, gap_ms: int = GAP_MS, buckets: int = 16, period_ms: int = DAY_MS) -> None:
        self.spark, self.path, self.gap_ms, self.buckets, self.period_ms = spark, path.rstrip("/"), gap_ms, buckets, period_ms
        self.versions = Versions(spark, f"{self.path}/_versions")

    def _placed(self, sessions: DataFrame) -> DataFrame:
        period = F.pmod(F.floor(F.col("ts_from") / F.lit(float(self.period_ms))), F.lit(PERIODS))
        return sessions.withColumn("_dir", (poly_bucket(F.col("vin"), self.buckets) * PERIODS + period).cast("int"))

    def _spans(self, placed: DataFrame) -> dict[str, list[int]]:
        """Of each folder (at most buckets x PERIODS) the time from its first session's start to its last one's end."""
        rows = placed.groupBy("_dir").agg(F.min("ts_from").alias("a"), F.max("ts_to").alias("b")).collect()
        return {str(r["_dir"]): [r.a, r.b] for r in rows}

    def _rows(self, dirs: dict[str, dict]) -> DataFrame:
        """One scan of the folders' files, however many versions they are from."""
        if not dirs:
            return self.spark.createDataFrame([], SCHEMA)
        by_write: dict[str, list[int]] = {}
        for n, d in dirs.items():
            by_write.setdefault(d["folder"], []).append(int(n))
        read = self.spark.read.schema(f"{SCHEMA}, _write string, _dir int").option("basePath", f"{self.path}/data")
        live = [(F.col("_write") == w) & F.col("_dir").isin(ns) for w, ns in by_write.items()]
        rows = read.parquet(*[f"{self.path}/data/_write={w}" for w in by_write]).where(reduce(lambda x, y: x | y, live))
        return rows.drop("_write", "_dir")

    def read(self) -> DataFrame:
        return self._rows(self.versions.read()[1].get("dirs", {}))

    def _touched(self, new: dict[str, list[int]], stored: dict[str, dict]) -> set[str]:
        """Stored folders whose sessions may lie within the gap of a new one, and those that new sessions start in."""
        by_bucket: dict[int, list[list[int]]] = {}
        for n, span in new.items():
            by_bucket.setdefault(int(n) // PERIODS, []).append(span)
        near = lambda s, e: s[0] <= e[1] + self.gap_ms and s[1] >= e[0] - self.gap_ms
        return {n for n, d in stored.items() if n in new or any(near(d["span"], e) for e in by_bucket.get(int(n) // PERIODS, []))}

    def apply(self, batch: DataFrame) -> int:
        """Merges a batch and gives the new version's number.

        Sessions of the batch are compared with the stored ones in reach; those it touches or bridges become one. Every
        attempt writes a folder of its own; if another writer was faster, the batch is merged with what it left.
        """
        staged = written(self._placed(local_sessions(batch, self.gap_ms)), "sessions")
        new = self._spans(staged)
        while True:
            number, state = self.versions.read()
            if not new:
                return number
            stored = state.get("dirs", {})
            touched = self._touched(new, stored)
            old = self._rows({n: stored[n] for n in touched})
            merged = _merged(old.unionByName(staged.drop("_dir")), self.gap_ms) if touched else staged.drop("_dir")
            folder = fresh_name("s")
            self._placed(merged).repartition("_dir").write.partitionBy("_dir").parquet(f"{self.path}/data/_write={folder}")
            made = self._spans(self.spark.read.schema(f"{SCHEMA}, _dir int").parquet(f"{self.path}/data/_write={folder}"))
            kept = {n: d for n, d in stored.items() if n not in touched}
            if self.versions.commit(number + 1, {"dirs": kept | {n: {"folder": folder, "span": span} for n, span in made.items()}}):
                return number + 1
            files.delete(self.spark, f"{self.path}/data/_write={folder}")

    def vacuum(self, older_than_s: float) -> int:
        """Deletes folders no version needs and that are older than that."""
        live = {f"_write={d['folder']}" for d in self.versions.read()[1].get("dirs", {}).values()}
        self.versions.prune(older_than_s)
        return sweep(self.spark, f"{self.path}/data", live, older_than_s)


def sessions(rows: DataFrame, gap_ms: int = GAP_MS, arrival: str | None = None, slices: int = 2) -> DataFrame:
    """(vin, ts_from, ts_to, duration_ms, n_rows) of all rows, through a session table fed in ``slices`` of arrival, equal in rows."""
    spark = rows.sparkSession
    wanted = rows.select("vin", "ts", *([arrival] if arrival else []))
    parts, n = [wanted], None
    if arrival:
        cuts, totals = arrival_cuts(wanted, arrival, slices, n=F.count("*"))
        parts, n = arrival_slices(wanted, arrival, cuts), totals.n
    buckets = max(1, math.ceil((wanted.count() if n is None else n) / ROWS_PER_BUCKET))
    table = SessionTable(spark, scratch_path(spark, "session-table"), gap_ms, buckets, 28 * DAY_MS)
    for part in parts:
        table.apply(part)
    out = table.read()
    return out.select("vin", "ts_from", "ts_to", (F.col("ts_to") - F.col("ts_from")).alias("duration_ms"), "n_rows")
