"""Block summaries (zone maps) and aggregates answered from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolane.functions import no_data, or_no_data, window_start
from chronolane.operators.ordered import positions
from chronolane.operators.series import matches, numeric_kind, with_empty_windows
from chronolane.requests import Aggregate, Compare, Downsample
from chronolane.types import Aggregator, ColumnType, CompareOp, declared

BLOCK_ROWS = 250
BLOCKS_PER_GROUP = 100
RAW_RANGES = 64  # at most so many stretches of raw rows are named in a scan's filter


def _numeric(df: DataFrame) -> dict[str, str]:
    return {c: k.value for c, k in declared(df.schema).items() if k is not ColumnType.STRING}


def zone_map(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per entity and block of consecutive rows: time bounds, row count and per numeric column sum, max, min.

    Sums of int columns are BIGINT. (vin, ts) must be unique; an empty table gives no blocks.
    """
    numeric = _numeric(df)
    aggs = [F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.count("*").alias("n")]
    for c, kind in numeric.items():
        aggs += [F.sum(c).cast("bigint" if kind == "int" else "double").alias(f"{c}_sum"), F.max(c).alias(f"{c}_max"), F.min(c).alias(f"{c}_min")]
    numbered = positions(df.select("vin", "ts", *numeric))
    return numbered.groupBy("vin", F.expr(f"_pos div {block_rows}").cast("bigint").alias("blk")).agg(*aggs)


def group_zones(zones: DataFrame, per_group: int = BLOCKS_PER_GROUP) -> DataFrame:
    """The second level: ``per_group`` consecutive blocks of an entity merged into one summary."""
    how = {"min_ts": F.min, "max_ts": F.max, "n": F.sum}
    aggs = []
    for c, kind in zones.dtypes:
        if c in ("vin", "blk"):
            continue
        f = how.get(c) or (F.sum if c.endswith("_sum") else F.max if c.endswith("_max") else F.min)
        aggs.append(f(c).cast(kind).alias(c))
    return zones.groupBy("vin", F.expr(f"blk div {per_group}").cast("bigint").alias("grp")).agg(*aggs)


def overlapping(zones: DataFrame, lower: int, upper: int) -> DataFrame:
    """Blocks that can hold a row of [lower, upper)."""
    return zones.where((F.col("max_ts") >= lower) & (F.col("min_ts") < upper))


def _may(column: str, compare: Compare) -> Column:
    low, high, v = F.col(f"{column}_min"), F.col(f"{column}_max"), F.lit(compare.value)
    return high > v if compare.op is CompareOp.GREATER else (low <= v) & (v <= high)


def _all(column: str, compare: Compare) -> Column:
    """NaN is greater than any number in min and max, but matches nothing: a block whose max is NaN holds one."""
    low, high, v = F.col(f"{column}_min"), F.col(f"{column}_max"), F.lit(compare.value)
    hit = low > v if compare.op is CompareOp.GREATER else (low == v) & (high == v)
    return hit & ~F.isnan(high.cast("double"))


def may_match(zones: DataFrame, column: str, compare: Compare) -> DataFrame:
    """Blocks that can hold a cell which matches: all others need not be read."""
    return zones.where(_may(column, compare))


def all_match(zones: DataFrame, column: str, compare: Compare) -> DataFrame:
    """Blocks all of whose cells match: their sums stand for their rows."""
    return zones.where(_all(column, compare))


def last_blocks(zones: DataFrame) -> DataFrame:
    """Per entity the block with the greatest end (of several, the greatest number)."""
    rest = [c for c in zones.columns if c != "vin"]
    best = F.max_by(F.struct(*rest), F.struct("max_ts", "blk")).alias("_b")
    return zones.groupBy("vin").agg(best).select("vin", "_b.*")


def aggregate_from_zones(df: DataFrame, zones: DataFrame, request: Aggregate) -> DataFrame:
    """``series.aggregate`` answered from whole blocks, raw rows being read only for the blocks cut by a bound.

    Blocks of an entity don't overlap in time, so at most two are cut: that side of the join is broadcast. AVG carries
    (sum, count). ``zones`` must be built from ``df``.
    """
    kind = numeric_kind(df, request.column)
    c = request.column
    mine = overlapping(zones.where(F.col("vin") == request.vin), request.lower, request.upper)
    inside = (F.col("min_ts") >= request.lower) & (F.col("max_ts") < request.upper)
    whole = mine.where(inside).select(F.col(f"{c}_sum").cast("double").alias("s"), F.col("n").cast("bigint").alias("n"), F.col(f"{c}_max").alias("m"))
    cut = mine.where(~inside).select(F.col("vin"), "min_ts", "max_ts")
    rows = df.where((F.col("vin") == request.vin) & (F.col("ts") >= request.lower) & (F.col("ts") < request.upper))
    at = (F.col("r.vin") == F.col("z.vin")) & (F.col("r.ts") >= F.col("z.min_ts")) & (F.col("r.ts") <= F.col("z.max_ts"))
    edge = rows.alias("r").join(F.broadcast(cut).alias("z"), at, "left_semi")
    edge = edge.select(F.col(c).cast("double").alias("s"), F.lit(1).cast("bigint").alias("n"), F.col(c).alias("m"))
    both = whole.unionByName(edge)
    if request.how is Aggregator.AVG:
        value = or_no_data(F.sum("s") / F.nullif(F.sum("n"), F.lit(0)), "double")
    else:
        value = or_no_data(F.max("m"), kind)
    return both.agg(value.alias("_v")).select(F.lit(request.vin).alias("vin"), F.lit(request.lower).cast("bigint").alias("ts"), F.col("_v").alias(c))


def raw_ranges(blocks: DataFrame, lower: int, upper: int, most: int = RAW_RANGES) -> list[tuple[int, int]]:
    """At most ``most`` closed ranges of time that cover these blocks and end at block ends: one per equal part of [lower, upper)."""
    width = (upper - lower - 1) // most + 1
    part = F.floor((F.greatest(F.col("min_ts"), F.lit(lower)) - F.lit(lower)) / F.lit(width))
    return [(r.a, r.b) for r in blocks.groupBy(part.alias("_part")).agg(F.min("min_ts").alias("a"), F.max("max_ts").alias("b")).collect()]


def downsample_from_zones(df: DataFrame, zones: DataFrame, request: Downsample) -> DataFrame:
    """``series.downsample`` answered from whole blocks as far as they decide.

    A block inside one window counts with its sums if all its cells match, and with its presence alone if none can. The rows
    of other blocks are read: the scan's filter names the stretches of time they lie in, at most ``RAW_RANGES`` of them, and
    blocks between two of them in one stretch are read as rows too. ``zones`` must be built from ``df``. An AVG from block
    sums may differ from a row-wise one in the last digits.
    """
    kind, c = numeric_kind(df, request.column), request.column
    out = "double" if request.how is Aggregator.AVG else kind
    start = lambda t: window_start(F.col(t), request.lower, request.interval)
    mine = overlapping(zones.where(F.col("vin") == request.vin), request.lower, request.upper)
    whole = (F.col("min_ts") >= request.lower) & (F.col("max_ts") < request.upper) & (start("min_ts") == start("max_ts"))
    counts = F.lit(True) if request.compare is None else _all(c, request.compare)
    decided = whole & (counts if request.compare is None else counts | ~_may(c, request.compare))
    ranges = raw_ranges(mine.where(~decided), request.lower, request.upper)
    inside = lambda t: reduce(lambda x, y: x | y, [F.col(t).between(a, b) for a, b in ranges], F.lit(False))
    blocks = mine.where(~inside("min_ts")).select(
        start("min_ts").alias("ts"), F.when(counts, F.col(f"{c}_sum").cast("double")).alias("s"),
        F.when(counts, F.col("n").cast("bigint")).otherwise(0).alias("n"), F.when(counts, F.col(f"{c}_max")).alias("m"),
    )
    rows = df.where((F.col("vin") == request.vin) & (F.col("ts") >= request.lower) & (F.col("ts") < request.upper) & inside("ts"))
    hit = matches(F.col(c), kind, request.compare)
    cells = rows.select(start("ts").alias("ts"), F.when(hit, F.col(c).cast("double")).alias("s"), hit.cast("bigint").alias("n"), F.when(hit, F.col(c)).alias("m"))
    parts = blocks.unionByName(cells).groupBy("ts")
    if request.compare is not None and request.compare.op is CompareOp.EQUAL:
        value = F.when(F.sum("n") > 0, F.lit(request.compare.value).cast(out)).otherwise(no_data(out))
    elif request.how is Aggregator.AVG:
        value = or_no_data(F.sum("s") / F.nullif(F.sum("n"), F.lit(0)), out)
    else:
        value = or_no_data(F.max("m"), out)
    return with_empty_windows(parts.agg(value.alias(c)), request, out)
