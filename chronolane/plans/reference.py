"""The series queries over the relational test tables, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolane.functions import bit_width, zigzag_decode, zigzag_encode
from chronolane.operators import profile, rollup, series
from chronolane.requests import Aggregate, Compare, Downsample, Latest, TimeRange
from chronolane.session import scratch_path
from chronolane.sources import files, generator, textrows
from chronolane.sources.adapters import events_series, events_stream, lineitem_series, orders_series
from chronolane.sources.generator import telemetry
from chronolane.sources.storage import TsCatalog, TsTable
from chronolane.streaming import append_closed, downsample_stream, ingest, latest_stream, materialize
from chronolane.types import Aggregator, ColumnType, CompareOp, ordinals

Query = Callable[[SparkSession, str], DataFrame]

V, V2, UNKNOWN = "00000000000000007", "00000000000000042", "nosuchvin00000000"
LO, HI = 1704067200000, 1704672000000
DAY, HOUR = 86_400_000, 3_600_000
BLOCK, GROUP = 25, 4
AVG, MAX = Aggregator.AVG, Aggregator.MAX

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SERIES = """WITH s AS (SELECT lpad(CAST(user_id AS VARCHAR), 17, '0') AS vin, epoch_us(ts)//1000 AS ts,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, value, event_type FROM events)"""
INT_MARK, DOUBLE_MARK = "CAST(-2147483648 AS INTEGER)", "CAST('-infinity' AS DOUBLE)"


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def on_events(name: str, f: Callable[[DataFrame], DataFrame], body: str | None = None) -> None:
    add(name, lambda spark, d: f(events_series(spark, d)), body and f"{SERIES} {body}")


# ---- latest
_ARG = "arg_max(k, ts) AS k, arg_max(value, ts) AS value, arg_max(event_type, ts) AS event_type"
on_events("latest_all", lambda s: series.latest(s, Latest.of(None)), f"SELECT vin, max(ts) AS ts, {_ARG} FROM s GROUP BY vin")
on_events("latest_projected", lambda s: series.latest(s, Latest.of(None, ["value"])), "SELECT vin, max(ts) AS ts, arg_max(value, ts) AS value FROM s GROUP BY vin")
on_events(
    "latest_vin_subset",
    lambda s: series.latest(s, Latest.of([V, V2, V, UNKNOWN])),
    f"SELECT vin, max(ts) AS ts, {_ARG} FROM s WHERE vin IN ('{V}', '{V2}', '{UNKNOWN}') GROUP BY vin",
)
add(
    "latest_semi_join",
    lambda spark, d: series.latest_of(events_series(spark, d), orders_series(spark, d).select("vin")),
    f"{SERIES} SELECT vin, max(ts) AS ts, {_ARG} FROM s WHERE vin IN (SELECT lpad(CAST(o_custkey AS VARCHAR), 17, '0') FROM orders) GROUP BY vin",
)

# ---- time range
_RANGE = f"FROM s WHERE vin = '{V}' AND ts >= {LO} AND ts < {HI}"
on_events("time_range_all", lambda s: series.time_range(s, TimeRange(V, LO, HI)), f"SELECT vin, ts, k, value, event_type {_RANGE}")
on_events("time_range_projected", lambda s: series.time_range(s, TimeRange(V, LO, HI, ("value",))), f"SELECT vin, ts, value {_RANGE}")
on_events("time_range_unknown_vin", lambda s: series.time_range(s, TimeRange(UNKNOWN, LO, HI)), f"SELECT vin, ts, k, value, event_type FROM s WHERE vin = '{UNKNOWN}'")


def _boundary(s: DataFrame) -> DataFrame:
    """Bounds taken from the entity's first and last row: the lower is in, the upper out."""
    mine = s.where(F.col("vin") == V)
    bounds = mine.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))  # one row
    return mine.join(F.broadcast(bounds), (F.col("ts") >= F.col("lo")) & (F.col("ts") < F.col("hi"))).select("vin", "ts", "k")


on_events("time_range_boundary", _boundary, f"SELECT vin, ts, k FROM s WHERE vin = '{V}' AND ts >= (SELECT min(ts) FROM s WHERE vin = '{V}') AND ts < (SELECT max(ts) FROM s WHERE vin = '{V}')")

# ---- aggregate
for _how in (AVG, MAX):
    for _c, _kind in (("k", "int"), ("value", "double")):
        _mark = INT_MARK if _how is MAX and _kind == "int" else DOUBLE_MARK
        on_events(
            f"agg_{_how.value}_{_kind}",
            lambda s, how=_how, c=_c: series.aggregate(s, Aggregate(V, LO, HI, c, how)),
            f"SELECT '{V}' AS vin, CAST({LO} AS BIGINT) AS ts, coalesce({_how.value}({_c}), {_mark}) AS {_c} {_RANGE}",
        )
_NONE = f"FROM s WHERE vin = '{V}' AND ts >= 10 AND ts < 20"
for _name, _c, _how, _mark in (("agg_empty_avg", "k", AVG, DOUBLE_MARK), ("agg_empty_max_int", "k", MAX, INT_MARK), ("agg_empty_max_double", "value", MAX, DOUBLE_MARK)):
    on_events(
        _name,
        lambda s, how=_how, c=_c: series.aggregate(s, Aggregate(V, 10, 20, c, how)),
        f"SELECT '{V}' AS vin, CAST(10 AS BIGINT) AS ts, coalesce({_how.value}({_c}), {_mark}) AS {_c} {_NONE}",
    )
on_events(
    "agg_unknown_vin",
    lambda s: series.aggregate(s, Aggregate(UNKNOWN, LO, HI, "k", MAX)),
    f"SELECT '{UNKNOWN}' AS vin, CAST({LO} AS BIGINT) AS ts, coalesce(max(k), {INT_MARK}) AS k FROM s WHERE vin = '{UNKNOWN}' AND ts >= {LO} AND ts < {HI}",
)

# ---- downsample
_W = lambda iv: f"CAST({LO} + ((ts - {LO}) // {iv}) * {iv} AS BIGINT)"
_ROUND = {"double": lambda x: f"round({x}, 9)", "int": lambda x: x}


def _rounded(df: DataFrame, column: str) -> DataFrame:
    """Sums of doubles depend on their order: compared at nine digits."""
    return df.withColumn(column, F.round(column, 9)) if dict(df.dtypes)[column] == "double" else df


for _how in (AVG, MAX):
    for _c, _kind, _gt, _eq in (("k", "int", 60, 42), ("value", "double", 80.0, 55.57)):
        _out = "double" if _how is AVG else _kind
        _mark = INT_MARK if _out == "int" else DOUBLE_MARK
        for _op, _v in ((CompareOp.GREATER, _gt), (CompareOp.EQUAL, _eq)):
            if _op is CompareOp.GREATER:
                _e = f"coalesce({_how.value}({_c}) FILTER ({_c} > {_v}), {_mark})"
            else:
                _e = f"CASE WHEN count(*) FILTER ({_c} = {_v}) > 0 THEN CAST({_v} AS {'INTEGER' if _out == 'int' else 'DOUBLE'}) ELSE {_mark} END"
            on_events(
                f"downsample_{_how.value}_{_kind}_{_op.value}",
                lambda s, how=_how, c=_c, op=_op, v=_v: _rounded(series.downsample(s, Downsample(V, LO, HI, c, how, DAY, Compare(op, v))), c),
                f"SELECT vin, {_W(DAY)} AS ts, {_ROUND[_out](_e)} AS {_c} {_RANGE} GROUP BY 1, 2",
            )


def _down(name: str, request: Downsample, body: str) -> None:
    on_events(name, lambda s: _rounded(series.downsample(s, request), request.column), body)


_down("downsample_nofilter_avg", Downsample(V, LO, HI, "value", AVG, DAY), f"SELECT vin, {_W(DAY)} AS ts, round(avg(value), 9) AS value {_RANGE} GROUP BY 1, 2")
_down("downsample_nofilter_max", Downsample(V, LO, HI, "k", MAX, HOUR), f"SELECT vin, {_W(HOUR)} AS ts, max(k) AS k {_RANGE} GROUP BY 1, 2")
_down("downsample_all_filtered", Downsample(V, LO, HI, "k", MAX, DAY, Compare(CompareOp.GREATER, 1000)), f"SELECT vin, {_W(DAY)} AS ts, {INT_MARK} AS k {_RANGE} GROUP BY 1, 2")
_down("downsample_empty_range", Downsample(V, 10, 20, "k", AVG, 10), f"SELECT vin, CAST(10 AS BIGINT) AS ts, avg(k) AS k {_NONE} GROUP BY 1, 2")
_down("downsample_omit", Downsample(V, LO, HI, "k", MAX, HOUR, Compare(CompareOp.GREATER, 60)), f"SELECT vin, {_W(HOUR)} AS ts, coalesce(max(k) FILTER (k > 60), {INT_MARK}) AS k {_RANGE} GROUP BY 1, 2")
_down(
    "downsample_fill",
    Downsample(V, LO, HI, "k", MAX, HOUR, Compare(CompareOp.GREATER, 60), "fill"),
    f", w AS (SELECT {_W(HOUR)} AS ts, max(k) FILTER (k > 60) AS k {_RANGE} GROUP BY 1), g AS (SELECT unnest(range({LO}, {HI}, {HOUR})) AS ts) "
    f"SELECT '{V}' AS vin, CAST(g.ts AS BIGINT) AS ts, coalesce(w.k, {INT_MARK}) AS k FROM g LEFT JOIN w USING (ts) WHERE (SELECT count(*) FROM w) > 0",
)
_ODD = 5 * HOUR + 1234
_down("downsample_clamped", Downsample(V, LO, HI, "value", MAX, _ODD), f"SELECT vin, {_W(_ODD)} AS ts, max(value) AS value {_RANGE} GROUP BY 1, 2")
on_events(
    "downsample_all_vins",
    lambda s: _rounded(series.downsample_all(s, Downsample("", LO, HI, "value", AVG, DAY, Compare(CompareOp.GREATER, 20.0))), "value"),
    f"SELECT vin, {_W(DAY)} AS ts, round(coalesce(avg(value) FILTER (value > 20.0), {DOUBLE_MARK}), 9) AS value FROM s WHERE ts >= {LO} AND ts < {HI} GROUP BY 1, 2",
)
on_events("window_assign", lambda s: series.assign_windows(s, LO, HI, HOUR).select("vin", "ts", "ts_w"), f"SELECT vin, ts, {_W(HOUR)} AS ts_w FROM s WHERE ts >= {LO} AND ts < {HI}")
add(
    "downsample_dense_duplicates",
    lambda spark, d: series.downsample_all(lineitem_series(spark, d), Downsample("", 0, 1_000_000_000_000, "price", MAX, 30 * DAY)),
    f"SELECT lpad(CAST(l_suppkey AS VARCHAR), 17, '0') AS vin, CAST(((epoch_us(l_shipdate)//1000) // {30 * DAY}) * {30 * DAY} AS BIGINT) AS ts, max(l_extendedprice) AS price "
    "FROM lineitem WHERE epoch_us(l_shipdate)//1000 >= 0 AND epoch_us(l_shipdate)//1000 < 1000000000000 GROUP BY 1, 2",
)

# ---- upserts, unions, dictionary
add(
    "upsert_lww",
    lambda spark, d: series.resolve_upserts(orders_series(spark, d), "seq"),
    "SELECT lpad(CAST(o_custkey AS VARCHAR), 17, '0') AS vin, epoch_us(o_orderdate)//1000 AS ts, max(o_orderkey) AS seq, "
    "arg_max(o_totalprice, o_orderkey) AS price, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1, 2",
)


def _union(s: DataFrame) -> DataFrame:
    old, new = s.where(F.col("ts") < LO + 5 * DAY), s.where(F.col("ts") >= LO + 5 * DAY)
    return old.unionByName(new).select("vin", "ts", "k", "value")


on_events("union_memory_file", _union, "SELECT vin, ts, k, value FROM s")
on_events("vin_dictionary", series.vin_dictionary, "SELECT vin, CAST(dense_rank() OVER (ORDER BY vin) - 1 AS INTEGER) AS vin_id FROM (SELECT DISTINCT vin FROM s)")

# ---- blocks and rollups
_BLOCKS = f"""{SERIES}, b AS (SELECT *, CAST((row_number() OVER (PARTITION BY vin ORDER BY ts) - 1) // {BLOCK} AS BIGINT) AS blk FROM s),
 z AS (SELECT vin, blk, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS n, CAST(sum(k) AS BIGINT) AS k_sum, max(k) AS k_max, min(k) AS k_min,
  round(sum(value), 6) AS value_sum, max(value) AS value_max, min(value) AS value_min FROM b GROUP BY vin, blk)"""


def _zones(s: DataFrame) -> DataFrame:
    return rollup.zone_map(s, BLOCK)


def on_zones(name: str, f: Callable[[DataFrame], DataFrame], body: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = f(_zones(events_series(spark, d)))
        return out.withColumn("value_sum", F.round("value_sum", 6)) if "value_sum" in out.columns else out

    add(name, run, f"{_BLOCKS} {body}")


on_zones("block_zone_map", lambda z: z, "SELECT * FROM z")
on_zones(
    "big_bucket_rollup",
    lambda z: rollup.group_zones(z, GROUP),
    f"SELECT vin, blk // {GROUP} AS grp, min(min_ts) AS min_ts, max(max_ts) AS max_ts, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k_sum) AS BIGINT) AS k_sum, max(k_max) AS k_max, "
    "min(k_min) AS k_min, round(sum(value_sum), 6) AS value_sum, max(value_max) AS value_max, min(value_min) AS value_min FROM z GROUP BY 1, 2",
)
on_zones("block_prune_candidates", lambda z: rollup.overlapping(z, LO, HI).select("vin", "blk", "min_ts", "max_ts", "n"), f"SELECT vin, blk, min_ts, max_ts, n FROM z WHERE max_ts >= {LO} AND min_ts < {HI}")
on_zones("block_may_match", lambda z: rollup.may_match(z, "k", Compare(CompareOp.GREATER, 97)).select("vin", "blk", "k_max"), "SELECT vin, blk, k_max FROM z WHERE k_max > 97")
on_zones("block_all_match", lambda z: rollup.all_match(z, "k", Compare(CompareOp.GREATER, 2)).select("vin", "blk", "k_min"), "SELECT vin, blk, k_min FROM z WHERE k_min > 2")
on_zones("block_may_equal", lambda z: rollup.may_match(z, "k", Compare(CompareOp.EQUAL, 97)).select("vin", "blk", "k_min", "k_max"), "SELECT vin, blk, k_min, k_max FROM z WHERE k_min <= 97 AND k_max >= 97")
on_zones("block_all_equal", lambda z: rollup.all_match(z, "k", Compare(CompareOp.EQUAL, 42)).select("vin", "blk", "n"), "SELECT vin, blk, n FROM z WHERE k_min = 42 AND k_max = 42")
on_zones("last_block", rollup.last_blocks, "SELECT z.* FROM z JOIN (SELECT vin, max(blk) AS blk FROM z GROUP BY vin) USING (vin, blk)")
for _name, _c, _how, _e in (("agg_via_rollup", "k", AVG, f"coalesce(avg(k), {DOUBLE_MARK})"), ("agg_via_rollup_max", "k", MAX, f"coalesce(max(k), {INT_MARK})")):
    on_events(
        _name,
        lambda s, c=_c, how=_how: rollup.aggregate_from_zones(s, _zones(s), Aggregate(V, LO + 1234567, HI - 7654321, c, how)),
        f"SELECT '{V}' AS vin, CAST({LO + 1234567} AS BIGINT) AS ts, {_e} AS {_c} FROM s WHERE vin = '{V}' AND ts >= {LO + 1234567} AND ts < {HI - 7654321}",
    )

# ---- encoding statistics
_LAGS = "lag({0}, {1}) OVER (PARTITION BY vin ORDER BY ts)"
on_events("ts_gap", profile.timestamp_gaps, f"SELECT * FROM (SELECT vin, ts, ts - {_LAGS.format('ts', 1)} AS gap FROM s) WHERE gap IS NOT NULL")
on_events(
    "int_delta_zigzag",
    lambda s: profile.int_deltas(s, "k"),
    f"SELECT vin, ts, delta, CASE WHEN delta >= 0 THEN 2 * delta ELSE -2 * delta - 1 END AS zz FROM (SELECT vin, ts, CAST(k AS BIGINT) - {_LAGS.format('k', 1)} AS delta FROM s) WHERE delta IS NOT NULL",
)
on_events(
    "double_third_delta",
    lambda s: profile.third_deltas(s, "value", 4),
    f"SELECT * FROM (SELECT vin, ts, round(value - 3 * {_LAGS.format('value', 1)} + 3 * {_LAGS.format('value', 2)} - {_LAGS.format('value', 3)}, 4) AS d3 FROM s) WHERE d3 IS NOT NULL",
)
on_events(
    "string_dictionary_size",
    lambda s: profile.dictionary_sizes(s, "event_type", BLOCK),
    f", b AS (SELECT vin, event_type, CAST((row_number() OVER (PARTITION BY vin ORDER BY ts) - 1) // {BLOCK} AS BIGINT) AS blk FROM s) SELECT vin, blk, count(DISTINCT event_type) AS n_distinct FROM b GROUP BY 1, 2",
)
on_events(
    "column_profile",
    lambda s: profile.column_profile(s, "k"),
    ", r AS (SELECT CAST(k AS DOUBLE) AS v, coalesce(k <> lag(k) OVER (PARTITION BY vin ORDER BY ts), true) AS start FROM s WHERE k IS NOT NULL) "
    "SELECT count(*) AS n, min(v) AS v_min, max(v) AS v_max, count(DISTINCT v) AS n_distinct, count(*) FILTER (start) AS n_runs, "
    "round(count(*) / count(*) FILTER (start), 6) AS mean_run, round(count(*) FILTER (v = floor(v)) / count(*), 6) AS whole_share FROM r",
)
on_events(
    "column_smoothness",
    lambda s: profile.smoothness(s, "value").select("n", *[F.round(c, 6).alias(c) for c in ("mean_change", "std_change")]),
    f", d AS (SELECT value - {_LAGS.format('value', 1)} AS d FROM s WHERE isfinite(value)) SELECT count(d) AS n, round(avg(d), 6) AS mean_change, round(stddev_pop(d), 6) AS std_change FROM d",
)


def _ordinals(spark: SparkSession, _dir: str) -> DataFrame:
    I, D, S = ColumnType.INTEGER, ColumnType.DOUBLE, ColumnType.STRING  # noqa: E741
    return spark.createDataFrame(ordinals({"soc": D, "yxms": I, "cs": S, "zdl": D, "ljlc": I, "clzt": S}), "name string, ordinal int, kind string")


add(
    "schema_ordinals",
    _ordinals,
    "SELECT * FROM (VALUES ('ljlc', CAST(0 AS INTEGER), 'int'), ('yxms', 1, 'int'), ('soc', 2, 'double'), ('zdl', 3, 'double'), ('clzt', 4, 'string'), ('cs', 5, 'string')) t(name, ordinal, kind)",
)


on_events(
    "bit_widths",
    lambda s: s.select("vin", "ts", bit_width(F.col("k").cast("bigint")).alias("k_bits"), zigzag_decode(zigzag_encode(F.col("k"), 32), 32).alias("k_back")),
    "SELECT vin, ts, CASE WHEN k = 0 THEN 0 ELSE CAST(length(bin(k)) AS INTEGER) END AS k_bits, k AS k_back FROM s",
)


def _point(s: DataFrame) -> DataFrame:
    """The rows of one entity at given times exactly."""
    first = s.where(F.col("vin") == V).groupBy("vin").agg(F.min("ts").alias("ts"))  # one row
    return s.join(F.broadcast(first), ["vin", "ts"], "left_semi")


on_events("point_lookup", _point, f"SELECT * FROM s WHERE vin = '{V}' AND ts = (SELECT min(ts) FROM s WHERE vin = '{V}')")


# ---- storage
def _catalog(spark: SparkSession) -> TsCatalog:
    path = scratch_path(spark, "catalog")
    files.make_dir(spark, path)
    return TsCatalog(spark, path)


_COLUMNS = {"k": ColumnType.INTEGER, "value": ColumnType.DOUBLE, "event_type": ColumnType.STRING}


def _roundtrip(spark: SparkSession, d: str) -> DataFrame:
    t = _catalog(spark).create_table("events", _COLUMNS, buckets=8)
    t.write(events_series(spark, d))
    return t.read()


def _restart(spark: SparkSession, d: str) -> DataFrame:
    """Written twice, compacted, then opened anew from the path alone."""
    catalog = _catalog(spark)
    t = catalog.create_table("events", _COLUMNS, buckets=8)
    s = events_series(spark, d)
    t.write(s.withColumn("value", F.lit(-1.0)))
    t.write(s)
    t.compact()
    return TsCatalog(spark, catalog.path).table("events").read()


def _stored_upsert(spark: SparkSession, d: str) -> DataFrame:
    t = _catalog(spark).create_table("orders", {"price": ColumnType.DOUBLE, "status": ColumnType.STRING}, buckets=8)
    t.write(orders_series(spark, d), sequence="seq")
    return t.read()


add("storage_roundtrip", _roundtrip, f"{SERIES} SELECT vin, ts, k, value, event_type FROM s")
add("restart_roundtrip", _restart, f"{SERIES} SELECT vin, ts, k, value, event_type FROM s")
add(
    "storage_upsert",
    _stored_upsert,
    "SELECT lpad(CAST(o_custkey AS VARCHAR), 17, '0') AS vin, epoch_us(o_orderdate)//1000 AS ts, arg_max(o_totalprice, o_orderkey) AS price, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1, 2",
)


def _stored_queries(spark: SparkSession, d: str) -> TsTable:
    """A compacted table: one segment of unique keys, read without a dedup."""
    t = _catalog(spark).create_table("events", _COLUMNS, buckets=8)
    t.write(events_series(spark, d))
    t.compact()
    return t


add("stored_latest", lambda spark, d: _stored_queries(spark, d).latest(Latest.of([V, V2])), f"{SERIES} SELECT vin, max(ts) AS ts, {_ARG} FROM s WHERE vin IN ('{V}', '{V2}') GROUP BY vin")
add("stored_time_range", lambda spark, d: _stored_queries(spark, d).time_range(TimeRange(V, LO, HI, ("value",))), f"{SERIES} SELECT vin, ts, value {_RANGE}")
add(
    "stored_downsample",
    lambda spark, d: _stored_queries(spark, d).downsample(Downsample(V, LO, HI, "k", MAX, DAY, Compare(CompareOp.GREATER, 60))),
    f"{SERIES} SELECT vin, {_W(DAY)} AS ts, coalesce(max(k) FILTER (k > 60), {INT_MARK}) AS k {_RANGE} GROUP BY 1, 2",
)
add("stored_rollup", lambda spark, d: _stored_queries(spark, d).build_rollup(BLOCK).select("vin", "blk", "min_ts", "max_ts", "n", "k_max"), f"{_BLOCKS} SELECT vin, blk, min_ts, max_ts, n, k_max FROM z")


def _with_rollup(spark: SparkSession, d: str, block_rows: int = 4) -> tuple[DataFrame, DataFrame]:
    """Stored rows and their stored rollup, in blocks small enough that a day holds whole ones."""
    t = _stored_queries(spark, d)
    return t.read([V], LO, HI), t.build_rollup(block_rows)


for _op, _v in ((CompareOp.GREATER, 20), (CompareOp.EQUAL, 42)):
    _e = f"coalesce(round(avg(k) FILTER (k > {_v}), 9), {DOUBLE_MARK})" if _op is CompareOp.GREATER else f"CASE WHEN count(*) FILTER (k = {_v}) > 0 THEN CAST({_v} AS DOUBLE) ELSE {DOUBLE_MARK} END"
    add(
        f"stored_downsample_rollup_{_op.value}",
        lambda spark, d, op=_op, v=_v: _rounded(rollup.downsample_from_zones(*_with_rollup(spark, d), Downsample(V, LO, HI, "k", AVG, 2 * DAY, Compare(op, v))), "k"),
        f"{SERIES} SELECT vin, {_W(2 * DAY)} AS ts, {_e} AS k {_RANGE} GROUP BY 1, 2",
    )
add(
    "stored_downsample_rollup_max",
    lambda spark, d: rollup.downsample_from_zones(*_with_rollup(spark, d), Downsample(V, LO, HI, "value", MAX, 2 * DAY)),
    f"{SERIES} SELECT vin, {_W(2 * DAY)} AS ts, max(value) AS value {_RANGE} GROUP BY 1, 2",
)


def _stored_aggregate(spark: SparkSession, d: str) -> DataFrame:
    t = _stored_queries(spark, d)
    t.build_rollup()
    return _rounded(t.aggregate(Aggregate(V, LO + 1234567, HI - 7654321, "value", AVG)), "value")


def _stored_point(spark: SparkSession, d: str) -> DataFrame:
    t = _stored_queries(spark, d)
    first = t.read([V]).agg(F.min("ts")).first()[0]  # one row
    return t.point(V, [first, first + 1])


def _stored_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the first write's entities keep their place when a second write brings more."""
    t = _catalog(spark).create_table("events", _COLUMNS, buckets=8)
    s = events_series(spark, d)
    t.write(s.where(F.col("vin") > V2))
    t.dictionary()
    t.write(s)
    return t.dictionary()


def _compression(spark: SparkSession, d: str) -> DataFrame:
    """Raw size exactly; of the stored size, which no SQL knows, that it is there and smaller."""
    made = _stored_queries(spark, d).compression()
    return made.select("n_rows", "raw_bytes", ((F.col("stored_bytes") > 0) & (F.col("ratio") < 1)).alias("smaller"))


add("stored_aggregate", _stored_aggregate, f"{SERIES} SELECT '{V}' AS vin, CAST({LO + 1234567} AS BIGINT) AS ts, coalesce(round(avg(value), 9), {DOUBLE_MARK}) AS value FROM s WHERE vin = '{V}' AND ts >= {LO + 1234567} AND ts < {HI - 7654321}")
add("stored_point_lookup", _stored_point, f"{SERIES} SELECT * FROM s WHERE vin = '{V}' AND ts <= (SELECT min(ts) FROM s WHERE vin = '{V}') + 1")
add(
    "stored_dictionary",
    _stored_dictionary,
    f"{SERIES}, v AS (SELECT DISTINCT vin, vin <= '{V2}' AS late FROM s) SELECT vin, CAST(row_number() OVER (ORDER BY late, vin) - 1 AS INTEGER) AS vin_id FROM v",
)
add("compression_ratio", _compression, f"{SERIES} SELECT count(*) AS n_rows, CAST(sum(17 + 8 + 4 + 8 + strlen(event_type)) AS BIGINT) AS raw_bytes, true AS smaller FROM s")


def _text_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path, rows = scratch_path(spark, "text"), events_series(spark, d)
    textrows.export_rows(rows, path)
    return textrows.import_rows(spark, path, rows.schema)


add("text_roundtrip", _text_roundtrip, f"{SERIES} SELECT vin, ts, k, value, event_type FROM s")
add(
    "generated_rows",
    lambda spark, _d: telemetry(spark, vins=10, rows_per_vin=100).select("vin", "ts", "YXMS", "SOC", F.length("ORNI").alias("orni"), F.length("JUBK").alias("jubk"), F.substring("CS", 2, 3).alias("cs")),
    """WITH g AS (SELECT id, (((id + 1) * 2654435761 + (42 + 17) * 40503001::BIGINT) % 4294967296) >> 12 AS y, (((id + 1) * 2654435761 + (42 + 106) * 40503001::BIGINT) % 4294967296) >> 12 AS s FROM range(1000) r(id))
 SELECT lpad(CAST(id // 100 AS VARCHAR), 17, '0') AS vin, CAST(16492012515000 + id % 100 * 1000 AS BIGINT) AS ts, CAST(y % 4 AS INTEGER) AS "YXMS", CAST(s % 1000 AS DOUBLE) AS "SOC", 30 AS orni, 100 AS jubk, 'asd' AS cs FROM g""",
)


def _generated_requests(spark: SparkSession, _d: str) -> DataFrame:
    """The four workloads' requests on the generated table: how many rows one of each kind gives."""
    t = _catalog(spark).create_table("vehicles", generator.SCHEMA, buckets=8)
    t.write(telemetry(spark, vins=1))
    r, a, w = next(generator.time_range_requests()), next(generator.aggregate_requests()), next(generator.downsample_requests())
    counts = [("latest", t.latest(next(generator.latest_requests()))), ("time_range", t.time_range(r)), ("aggregate", t.aggregate(a)), ("downsample", t.downsample(w))]
    out = None
    for name, df in counts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


add("generated_requests", _generated_requests, "SELECT * FROM (VALUES ('latest', CAST(1 AS BIGINT)), ('time_range', 300), ('aggregate', 1), ('downsample', 360)) t(kind, n)")


# ---- streams
def _stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    t = _catalog(spark).create_table("events", _COLUMNS, buckets=8)
    ingest(events_stream(spark, d), t, scratch_path(spark, "progress")).awaitTermination()
    return t.read()


def _stream_downsample(spark: SparkSession, d: str) -> DataFrame:
    out = downsample_stream(events_stream(spark, d), "value", DAY, "1 hour", LO)
    return materialize(out, scratch_path(spark, "stream"), scratch_path(spark, "progress")).withColumn("avg", F.round("avg", 9))


def _stream_closed(spark: SparkSession, d: str) -> DataFrame:
    """Append mode over two files, the second one late: only windows the watermark has closed come out, late rows don't."""
    base = scratch_path(spark, "late")
    one = events_series(spark, d).where(F.col("ts") < LO + 3 * DAY)
    one.coalesce(1).write.parquet(f"{base}/in/a")
    stream = spark.readStream.schema(one.schema).option("recursiveFileLookup", "true").parquet(f"{base}/in")
    windows = downsample_stream(stream, "value", DAY, "1 hour", LO)
    append_closed(windows, f"{base}/out", f"{base}/ck").awaitTermination()
    events_series(spark, d).where(F.col("ts") < LO + DAY).withColumn("value", F.lit(1e6)).coalesce(1).write.parquet(f"{base}/in/b")
    append_closed(windows, f"{base}/out", f"{base}/ck").awaitTermination()
    return spark.read.schema(windows.schema).parquet(f"{base}/out").withColumn("avg", F.round("avg", 9))


add("stream_ingest", _stream_ingest, f"{SERIES} SELECT vin, ts, k, value, event_type FROM s")
add("stream_downsample", _stream_downsample, f"{SERIES} SELECT vin, {_W(DAY)} AS ts, round(avg(value), 9) AS avg, max(value) AS max, count(*) AS n FROM s GROUP BY 1, 2")
add(
    "stream_latest",
    lambda spark, d: materialize(latest_stream(events_stream(spark, d)), scratch_path(spark, "stream"), scratch_path(spark, "progress")),
    f"{SERIES} SELECT vin, max(ts) AS ts, {_ARG} FROM s GROUP BY vin",
)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Downsampled average over a comparison, for every entity of the events table."""
    return series.downsample_all(events_series(spark, d), Downsample("", LO, HI, "value", AVG, DAY, Compare(CompareOp.GREATER, 20.0)))

add(
    "stream_closed_windows",
    _stream_closed,
    f"{SERIES}, r AS (SELECT * FROM s WHERE ts < {LO + 3 * DAY}), w AS (SELECT vin, {_W(DAY)} AS ts, round(avg(value), 9) AS avg, max(value) AS max, count(*) AS n FROM r GROUP BY 1, 2) "
    f"SELECT * FROM w WHERE ts + {DAY} <= (SELECT max(ts) FROM r) - {HOUR}",
)
