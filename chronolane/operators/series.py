"""The series queries: latest, time range, aggregate, downsample. Pure functions of a DataFrame and a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolane.functions import or_no_data, window_start
from chronolane.functions.columns import no_data
from chronolane.operators.ordered import dense_ids
from chronolane.requests import Aggregate, Compare, Downsample, Latest, Span, TimeRange
from chronolane.types import Aggregator, ColumnType, CompareOp, declared


def _projection(df: DataFrame, columns: tuple[str, ...]) -> list[str]:
    """The requested value columns; none requested means all. Unknown names raise."""
    have = list(declared(df.schema))
    if missing := [c for c in columns if c not in have]:
        raise ValueError(f"unknown columns {missing}")
    return list(columns) or have


def _within(df: DataFrame, span: Span) -> DataFrame:
    """Filters of a kind that reach the Parquet scan."""
    return df.where((F.col("vin") == span.vin) & (F.col("ts") >= span.lower) & (F.col("ts") < span.upper))


def numeric_kind(df: DataFrame, column: str) -> str:
    kinds = declared(df.schema)
    if column not in kinds:
        raise ValueError(f"unknown column {column}")
    if kinds[column] is ColumnType.STRING:
        raise TypeError(f"{column} is a string column; only numbers can be aggregated")
    return kinds[column].value


def latest(df: DataFrame, request: Latest) -> DataFrame:
    """The row with the greatest ``ts`` of each requested entity; unknown entities are skipped.

    One partial aggregation before the shuffle: each task sends one row per entity, however many rows a hot entity has.
    A table with repeated (vin, ts) must be resolved first (``resolve_upserts``). An empty table gives no rows.
    """
    columns = _projection(df, request.columns)
    rows = df
    if request.vins is not None:
        rows = df.where(F.col("vin").isin(list(request.vins))) if request.vins else df.limit(0)
    kinds = declared(df.schema)
    if all(kinds[c] is not ColumnType.STRING for c in columns):
        # fixed-width buffers keep this a hash aggregate
        return rows.groupBy("vin").agg(F.max("ts").alias("ts"), *[F.max_by(c, "ts").alias(c) for c in columns])
    best = F.max_by(F.struct(*columns), F.col("ts")).alias("_row")
    return rows.groupBy("vin").agg(F.max("ts").alias("ts"), best).select("vin", "ts", "_row.*")


def latest_of(df: DataFrame, vins: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """``latest`` for the entities of another DataFrame (column ``vin``): a left semi join, so repeated ids count once."""
    picked = df.join(vins.select("vin").distinct(), "vin", "left_semi")
    return latest(picked, Latest(None, columns))


def time_range(df: DataFrame, request: TimeRange) -> DataFrame:
    """Rows of one entity in [lower, upper), projected; an unknown entity gives no rows."""
    return _within(df, request).select("vin", "ts", *_projection(df, request.columns))


def matches(value: Column, kind: str, compare: Compare | None) -> Column:
    """Whether a cell takes part in the aggregate. NaN neither equals nor exceeds anything."""
    if compare is None:
        return F.lit(True)
    constant = F.lit(compare.value)
    hit = value == constant if compare.op is CompareOp.EQUAL else value > constant
    return hit & ~F.isnan(value) if kind == "double" else hit


def _aggregate(value: Column, kind: str, how: Aggregator, compare: Compare | None) -> Column:
    """The aggregate with its filter inside, so that windows without a match still come out, marked "no data"."""
    hit = matches(value, kind, compare)
    out = "double" if how is Aggregator.AVG else kind
    if compare is not None and compare.op is CompareOp.EQUAL:
        # the average (or maximum) of equal values is that value, exactly
        return F.when(F.count_if(hit) > 0, F.lit(compare.value).cast(out)).otherwise(no_data(out))
    cells = value if compare is None else F.when(hit, value)
    return or_no_data(F.avg(cells) if how is Aggregator.AVG else F.max(cells), out)


def aggregate(df: DataFrame, request: Aggregate) -> DataFrame:
    """One row (vin, ts = lower bound, value); without rows in the range the value is the "no data" marker."""
    kind = numeric_kind(df, request.column)
    value = _aggregate(F.col(request.column), kind, request.how, None).alias("_value")
    return _within(df, request).agg(value).select(
        F.lit(request.vin).alias("vin"),
        F.lit(request.lower).cast("bigint").alias("ts"),
        F.col("_value").alias(request.column),
    )


def downsample(df: DataFrame, request: Downsample) -> DataFrame:
    """Tumbling windows from the lower bound: (vin, ts = window start, value).

    A window whose rows all fail the comparison gives the marker; a window without rows is left out, or, with
    ``empty_windows="fill"``, gives the marker too - unless the whole range has no row, which gives no rows at all.
    The last window ends at the upper bound even if the range is no multiple of the interval.
    """
    kind = numeric_kind(df, request.column)
    out = "double" if request.how is Aggregator.AVG else kind
    rows = _within(df, request).select(
        window_start(F.col("ts"), request.lower, request.interval).alias("ts"), F.col(request.column).alias("_cell")
    )
    value = _aggregate(F.col("_cell"), kind, request.how, request.compare)
    return with_empty_windows(rows.groupBy("ts").agg(value.alias(request.column)), request, out)


def with_empty_windows(seen: DataFrame, request: Downsample, kind: str) -> DataFrame:
    """Of the windows with rows (ts, value) the answer (vin, ts, value), empty windows added if the request wants them."""
    if request.empty_windows == "fill":
        spine = (
            seen.agg(F.count("*").alias("_n"))
            .where(F.col("_n") > 0)
            .select(F.explode(F.sequence(*(F.lit(x).cast("bigint") for x in (request.lower, request.upper - 1, request.interval)))).alias("ts"))
        )
        seen = spine.join(seen, "ts", "left").withColumn(request.column, F.coalesce(request.column, no_data(kind)))
    return seen.select(F.lit(request.vin).alias("vin"), "ts", request.column)


def downsample_all(df: DataFrame, request: Downsample) -> DataFrame:
    """The same windows for every entity at once (``request.vin`` is not used); empty windows are left out."""
    kind = numeric_kind(df, request.column)
    rows = df.where((F.col("ts") >= request.lower) & (F.col("ts") < request.upper)).select(
        "vin", window_start(F.col("ts"), request.lower, request.interval).alias("ts"), F.col(request.column).alias("_cell")
    )
    value = _aggregate(F.col("_cell"), kind, request.how, request.compare)
    return rows.groupBy("vin", "ts").agg(value.alias(request.column))


def assign_windows(df: DataFrame, lower: int, upper: int, interval: int) -> DataFrame:
    """Each row of [lower, upper) with its window start ``ts_w``."""
    rows = df.where((F.col("ts") >= lower) & (F.col("ts") < upper))
    return rows.withColumn("ts_w", window_start(F.col("ts"), lower, interval))


def resolve_upserts(df: DataFrame, sequence: str = "_seq", keys: tuple[str, ...] = ("vin", "ts")) -> DataFrame:
    """One row per key, the one with the greatest write sequence (ties: the greatest row, so the result is fixed).

    ``max_by`` aggregates partially before the shuffle, so copies of one key are reduced where they are read.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(sequence), *[F.col(c) for c in rest if c != sequence])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def vin_dictionary(df: DataFrame) -> DataFrame:
    """Dense ids of the distinct entities in their own order, without gathering them in one task.

    Ids are ranks inside range partitions plus the count of all partitions before.
    """
    return dense_ids(df.select("vin").where(F.col("vin").isNotNull()).distinct(), "vin", "vin_id")
