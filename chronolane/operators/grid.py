"""Irregular readings on a regular grid, by validity intervals.

A reading holds from its time to the next reading of its source, at most ``hold_ms``. The intervals are cut at the grid
lines; per cell come out the time-weighted average, the covered fraction and the number of readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronolane.functions import finite

HOUR_MS = 3_600_000
PIECE = 1024  # cells of a stretch made from one row


def _cell(ts: Column, step: int) -> Column:
    return ts - F.pmod(ts, F.lit(step).cast("bigint"))


def validity_intervals(rows: DataFrame, value: str, arrival: str | None = None) -> DataFrame:
    """(vin, ts, ts_next, v): usable readings, each with the time of its source's next one (null for the last).

    Of several usable readings at one (vin, ts) the last arrived counts, then the greatest; they are reduced before the
    shuffle. So a chunk of one hour holds at most 3.6 million rows of a source (one per ms); the next chunk's start comes
    from a table of one row per source and hour.
    """
    order = F.struct(F.col(arrival), F.col("_v")) if arrival else F.struct("_v")
    usable = rows.where(F.col("vin").isNotNull() & F.col("ts").isNotNull()).withColumn("_v", finite(F.col(value))).where(F.col("_v").isNotNull())
    once = usable.groupBy("vin", "ts").agg(F.max_by("_v", order).alias("v")).withColumn("_hour", _cell(F.col("ts"), HOUR_MS))
    starts = usable.groupBy("vin", _cell(F.col("ts"), HOUR_MS).alias("_hour")).agg(F.min("ts").alias("_start"))
    follow = starts.select("vin", "_hour", F.lead("_start").over(Window.partitionBy("vin").orderBy("_hour")).alias("_follow"))
    inside = F.lead("ts").over(Window.partitionBy("vin", "_hour").orderBy("ts"))
    return once.withColumn("_in", inside).join(follow, ["vin", "_hour"]).select("vin", "ts", F.coalesce("_in", "_follow").alias("ts_next"), "v")


def regular_grid(rows: DataFrame, value: str, step_ms: int = 60_000, hold_ms: int = 300_000, arrival: str | None = None, longest_gap: int | None = None) -> DataFrame:
    """One row per source and cell from its first to its last usable reading.

    Columns: ``vin, slot_ts``, ``n_readings``, ``value`` (time-weighted average over the covered part, null if none),
    ``coverage`` (covered fraction of the cell), ``status`` ('measured', 'filled' from a held reading, 'missing') and
    ``gap_slots`` (number of consecutive cells without a reading that the cell is one of; 0 with a reading). Null, NaN and
    infinite values are not usable; rows with a null vin or ts are ignored; a source without usable readings has no rows.
    Cells of stretches of more than ``longest_gap`` without a reading are left out, before they are made. A long stretch (one
    wrong time can make it years) is made in pieces of bounded size.
    """
    spans = validity_intervals(rows, value, arrival)
    first = _cell(F.col("ts"), step_ms)
    last_of_all = F.col("ts_next").isNull()
    until = F.when(last_of_all, first).otherwise(_cell(F.col("ts_next") - 1, step_ms))
    nxt = _cell(F.col("ts_next"), step_ms)
    ends = F.when(last_of_all, F.least(F.col("ts") + hold_ms, first + step_ms)).otherwise(F.least(F.col("ts") + hold_ms, F.col("ts_next")))
    wanted = spans.select("vin", "ts", "v", first.alias("_first"), nxt.alias("_next"), until.alias("_until"), ends.alias("_end"))
    if longest_gap is not None:
        long = (F.col("_next") - F.col("_first")) / step_ms - 1 > longest_gap
        wanted = wanted.withColumn("_until", F.when(long, F.col("_first")).otherwise(F.col("_until")))
    step, piece = F.lit(step_ms).cast("bigint"), F.lit(step_ms * PIECE).cast("bigint")
    pieces = wanted.withColumn("_from", F.explode(F.sequence("_first", "_until", piece)))
    cells = pieces.withColumn("slot_ts", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + piece - step, F.col("_until")), step)))
    weight = F.greatest(F.least("_end", F.col("slot_ts") + step_ms) - F.greatest("ts", "slot_ts"), F.lit(0))
    between = (F.col("slot_ts") > F.col("_first")) & (F.col("slot_ts") < F.col("_next"))
    gap = F.when(between, ((F.col("_next") - F.col("_first")) / step_ms).cast("bigint") - 1).otherwise(0)
    per = cells.select("vin", "slot_ts", weight.alias("w"), (F.col("v") * weight).alias("vw"), gap.alias("g"), (F.col("slot_ts") == F.col("_first")).cast("int").alias("r"))
    # a cell whose readings hold for no time (the next came in the same ms) can't occur: times of readings are distinct
    sums = per.groupBy("vin", "slot_ts").agg(F.sum("r").cast("bigint").alias("n_readings"), F.sum("w").alias("w"), F.sum("vw").alias("vw"), F.max("g").alias("gap_slots"))
    status = F.when(F.col("n_readings") > 0, "measured").when(F.col("w") > 0, "filled").otherwise("missing")
    return sums.select(
        "vin", "slot_ts", "n_readings", (F.col("vw") / F.nullif(F.col("w"), F.lit(0))).alias("value"),
        (F.col("w") / step_ms).alias("coverage"), status.alias("status"), F.col("gap_slots").cast("bigint").alias("gap_slots"),
    )


def missing_slots(rows: DataFrame, value: str, step_ms: int = 60_000, arrival: str | None = None, absence_slots: int = 1440) -> DataFrame:
    """(vin, slot_ts) of cells without a usable reading; stretches of ``absence_slots`` and more are left out."""
    grid = regular_grid(rows, value, step_ms, arrival=arrival, longest_gap=absence_slots - 1)
    return grid.where(F.col("n_readings") == 0).select("vin", "slot_ts")
