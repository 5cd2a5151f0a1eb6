"""Totals over trailing days as versioned daily state.

State holds, per entity and date, counts and sums over the trailing 1, 7 and 30 days. ``RollingTable.advance`` joins it with new
arrivals. An amount of day d is entered for the dates it counts in, d .. d + period - 1, when it arrives; so tomorrow's row
already is yesterday's total without the expiring day's amounts, and an amount leaves without being subtracted. Sums of doubles
can't be taken back exactly (1e33 + 1e-7 - 1e33 is 0), adding is all that happens here. Late rows change the dates they reach
and no others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolane.functions import finite
from chronolane.operators.ordered import DAY_MS, arrival_cuts, arrival_slices
from chronolane.session import scratch_path
from chronolane.sources import files
from chronolane.sources.versions import Versions, fresh_name, sweep

PERIODS = (7, 30)
REACH = (1, *PERIODS)
MEASURES = {"rlxhl": "bigint", "zdl": "double"}
AMOUNTS = {"n": "bigint", **{f"{p}_{m}": k if p == "sum" else "bigint" for m, k in MEASURES.items() for p in ("sum", "cnt")}}
TOTALS = {f"{a}_{p}": k for p in REACH for a, k in AMOUNTS.items()}
STATE = "vin string, day_no int, " + ", ".join(f"{c} {k}" for c, k in TOTALS.items())
SEEN = "vin string, ts bigint, h bigint"
BLOCK_DAYS, FOLDERS = 32, 1024  # dates of a folder; blocks are counted around, so any date has a folder
PIECE = 1024  # days of a long gap made by one generated row


def _zero(kind: str) -> Column:
    return F.lit(0).cast(kind)


def _folder(day: Column) -> Column:
    return F.pmod(F.floor(day / F.lit(float(BLOCK_DAYS))), F.lit(FOLDERS)).cast("int")


def _day() -> Column:
    return F.floor(F.col("ts") / F.lit(float(DAY_MS))).cast("int")


def identified(rows: DataFrame, arrival: str | None = None) -> DataFrame:
    """(vin, ts, h, measures): rows known by entity, time and a 64-bit hash of all columns but ``arrival``.

    Null vin or ts: ignored. Null, NaN and infinite cells are no values.
    """
    rest = [c for c in rows.columns if c != arrival]
    # a null is told from any value and from a null in another column
    cells = [x for i, c in enumerate(rest) for x in (F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNull(), F.lit(i)))]
    values = [(F.col(m).cast("bigint") if k == "bigint" else finite(F.col(m))).alias(m) for m, k in MEASURES.items()]
    keyed = rows.where(F.col("vin").isNotNull() & F.col("ts").isNotNull())
    return keyed.select("vin", F.col("ts").cast("bigint").alias("ts"), F.xxhash64(*cells).alias("h"), *values)


def distinct_rows(came: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Identified rows once each, those without that were ``seen`` (vin, ts, h) before.

    One aggregation: copies are reduced before the shuffle, and a few numbers a row are shuffled, spread by hash, however hot
    an entity or a day is.
    """
    rows = came.withColumn("_old", F.lit(False))
    if seen is not None:
        rows = rows.unionByName(seen.select("vin", "ts", "h", F.lit(True).alias("_old")), allowMissingColumns=True)
    once = rows.groupBy("vin", "ts", "h").agg(*[F.max(m).alias(m) for m in MEASURES], F.max("_old").alias("_old"))
    return once.where(~F.col("_old")).drop("_old").withColumn("day_no", _day())


def daily_amounts(distinct: DataFrame) -> DataFrame:
    """Per (vin, day_no): ``n``, and sum and count of each measure."""
    aggs = [F.count("*").alias("n")]
    for m, k in MEASURES.items():
        aggs += [F.coalesce(F.sum(m).cast(k), _zero(k)).alias(f"sum_{m}"), F.count(m).alias(f"cnt_{m}")]
    return distinct.groupBy("vin", "day_no").agg(*aggs)


def entered(daily: DataFrame) -> DataFrame:
    """Daily amounts entered for every date they count in: (vin, day_no, totals), several rows per date."""
    dates = daily.select("vin", F.explode(F.sequence(F.col("day_no"), F.col("day_no") + max(REACH) - 1)).alias("day_no"), F.col("day_no").alias("_of"), *AMOUNTS)
    counts = {f"{a}_{p}": F.when(F.col("day_no") < F.col("_of") + p, F.col(a)).otherwise(_zero(k)) for p in REACH for a, k in AMOUNTS.items()}
    return dates.select("vin", "day_no", *[c.alias(n) for n, c in counts.items()])


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("vin", "day_no").agg(*[F.sum(c).cast(k).alias(c) for c, k in TOTALS.items()])


class RollingTable:
    """Stored state below a path of the shared file system: totals in folders of 32 dates, hashes of the rows they are made of.

    A version names the folder that each block of dates lies in. Advancing reads and rewrites the blocks that arrivals reach,
    in folders of its own; the next version makes them visible at once.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, f"{self.path}/_versions")

    def _scan(self, what: str, schema: str, live: dict[str, list[str]], only: set[str] | None = None) -> DataFrame:
        """One scan of the live (write, folder) pairs, of ``only`` some folders."""
        by_write: dict[str, list[int]] = {}
        for folder, writes in live.items():
            for w in writes if only is None or folder in only else []:
                by_write.setdefault(w, []).append(int(folder))
        if not by_write:
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(f"{schema}, _write string, _dir int").option("basePath", f"{self.path}/{what}")
        pairs = [(F.col("_write") == w) & F.col("_dir").isin(ds) for w, ds in by_write.items()]
        return read.parquet(*[f"{self.path}/{what}/_write={w}" for w in by_write]).where(reduce(lambda x, y: x | y, pairs)).drop("_write", "_dir")

    def read(self) -> DataFrame:
        """Totals per entity and date, of every date a row counts in (up to 29 days after it)."""
        return self._scan("totals", STATE, self.versions.read()[1].get("totals", {}))

    def _keep(self, df: DataFrame, what: str, write: str) -> set[str]:
        """Writes rows by folder; gives the folders there are."""
        path = f"{self.path}/{what}/_write={write}"
        df.withColumn("_dir", _folder(F.col("day_no"))).repartition("_dir", F.pmod(F.xxhash64("vin"), F.lit(64))).write.partitionBy("_dir").parquet(path)
        return {n.removeprefix("_dir=") for n in files.names(self.spark, path) if n.startswith("_dir=")}

    def advance(self, batch: DataFrame, arrival: str | None = None) -> int:
        """Joins the stored state with a batch's arrivals and gives the new version's number.

        Arrivals may be of today, of any later day, or late (corrections): only blocks with dates they reach are read and
        rewritten. Rows that a former batch brought already count for nothing. If another writer was faster, its version is
        joined instead.
        """
        came = identified(batch, arrival)
        while True:
            number, state = self.versions.read()
            totals, seen = state.get("totals", {}), state.get("seen", {})
            write, before = fresh_name("r"), None
            if seen:
                days = {str(r[0]) for r in came.select(_folder(_day())).distinct().collect()}  # at most FOLDERS
                before = self._scan("seen", SEEN, seen, days)
            fresh_in = self._keep(distinct_rows(came, before), "seen", write)
            if not fresh_in:
                return number
            fresh = self.spark.read.schema(f"{SEEN}, day_no int, " + ", ".join(f"{m} {k}" for m, k in MEASURES.items())).parquet(f"{self.path}/seen/_write={write}")
            moved = entered(daily_amounts(fresh))
            # an amount reaches the next 29 dates, so at most the block after its own
            reached = fresh_in | {str((int(d) + 1) % FOLDERS) for d in fresh_in}
            old = {d for d in reached if d in totals}
            joined = _summed(self._scan("totals", STATE, totals, old).unionByName(moved) if old else moved)
            made = self._keep(joined, "totals", write)
            after = {d: w for d, w in totals.items() if d not in old} | {d: [write] for d in made}
            if self.versions.commit(number + 1, {"totals": after, "seen": seen | {d: [*seen.get(d, []), write] for d in fresh_in}}):
                return number + 1
            for what in ("totals", "seen"):
                files.delete(self.spark, f"{self.path}/{what}/_write={write}")

    def vacuum(self, older_than_s: float) -> int:
        """Deletes totals no version needs and that are older than that."""
        live = {f"_write={w}" for ws in self.versions.read()[1].get("totals", {}).values() for w in ws}
        self.versions.prune(older_than_s)
        return sweep(self.spark, f"{self.path}/totals", live, older_than_s)


def with_quiet_days(state: DataFrame, longest_gap: int | None = None) -> DataFrame:
    """One row per entity and day from its first to its last day with rows.

    Columns: ``vin, day_no``, per period p ``n_p`` and per measure m ``sum_m_p`` (0 without values), ``cnt_m_p``, ``avg_m_p`` (null
    without values), and ``gap_days``: length of the stretch of days without rows that the day lies in, 0 on a day with rows. Days of
    stretches longer than ``longest_gap`` are left out, before they are made.
    """
    active = state.where(F.col("n_1") > 0).select("vin", "day_no")
    follow = F.lead("day_no").over(Window.partitionBy("vin").orderBy("day_no"))  # days of one entity
    spans = active.select("vin", F.col("day_no").alias("_a"), (F.coalesce(follow, F.col("day_no") + 1) - 1).alias("_b"))
    if longest_gap is not None:
        spans = spans.withColumn("_b", F.when(F.col("_b") - F.col("_a") > longest_gap, F.col("_a")).otherwise(F.col("_b")))
    pieces = spans.select("*", F.explode(F.sequence("_a", "_b", F.lit(PIECE))).alias("_from"))
    days = pieces.select("vin", "_a", "_b", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + PIECE - 1, F.col("_b")))).alias("day_no"))
    full = days.join(state, ["vin", "day_no"], "left")
    out = [F.col("vin"), F.col("day_no")]
    for p in PERIODS:
        out.append(F.coalesce(f"n_{p}", F.lit(0)).cast("bigint").alias(f"n_{p}"))
        for m in MEASURES:
            total, count = F.col(f"sum_{m}_{p}").cast("double"), F.col(f"cnt_{m}_{p}")
            out.append(F.coalesce(total, F.lit(0.0)).alias(f"sum_{m}_{p}"))
            out.append(F.coalesce(count, F.lit(0)).cast("bigint").alias(f"cnt_{m}_{p}"))
            out.append((total / F.nullif(count, F.lit(0))).alias(f"avg_{m}_{p}"))
    out.append(F.when(F.col("day_no") == F.col("_a"), 0).otherwise(F.col("_b") - F.col("_a")).cast("int").alias("gap_days"))
    return full.select(*out)


def rolling_state(rows: DataFrame, arrival: str | None = None, slices: int = 2) -> DataFrame:
    """State of a whole history, advanced by ``slices`` of its arrival, equal in rows. An empty table gives no rows."""
    table = RollingTable(rows.sparkSession, scratch_path(rows.sparkSession, "rolling"))
    parts = arrival_slices(rows, arrival, arrival_cuts(rows, arrival, slices)[0]) if arrival else [rows]
    for part in parts:
        table.advance(part, arrival)
    return table.read()


def rolling_totals(rows: DataFrame, arrival: str | None = None, slices: int = 2) -> DataFrame:
    """``with_quiet_days`` of a whole history, days without rows included."""
    return with_quiet_days(rolling_state(rows, arrival, slices))


def quiet_days(rows: DataFrame, arrival: str | None = None, absence_days: int = 50, slices: int = 2) -> DataFrame:
    """(vin, day_no, trail_days): days whose trailing period holds no row, stretches of ``absence_days`` and more left out."""
    near = with_quiet_days(rolling_state(rows, arrival, slices), absence_days - 1)
    flags = F.array(*[F.struct(F.lit(p).alias("trail_days"), (F.col(f"n_{p}") == 0).alias("quiet")) for p in PERIODS])
    return near.select("vin", "day_no", F.explode(flags).alias("f")).where("f.quiet").select("vin", "day_no", "f.trail_days")
