"""Golden cases of the query contract and its corner cases."""

import pytest

from chronolane.operators import series
from chronolane.requests import Aggregate, Compare, Downsample, Latest, TimeRange
from chronolane.types import Aggregator, ColumnType, CompareOp, ordinals, series_schema
from tests.conftest import rows_of

VIN, T0 = "A" * 17, 1693274400000
GT, EQ = CompareOp.GREATER, CompareOp.EQUAL
AVG, MAX = Aggregator.AVG, Aggregator.MAX
INF = float("inf")


def micro(spark, first=10):
    values = [first, 11, 13, 15, 17, 19, 21, 20, 18, 16]
    return spark.createDataFrame([(VIN, T0 + 1000 * i, v) for i, v in enumerate(values)], "vin string, ts bigint, azkp int")


def test_golden_aggregate(spark):
    got = series.aggregate(micro(spark), Aggregate(VIN, T0 + 155, T0 + 10235, "azkp", MAX)).collect()
    assert [tuple(r) for r in got] == [(VIN, T0 + 155, 21)]


@pytest.mark.parametrize(
    ("compare", "lower", "upper", "want"),
    [
        (Compare(GT, 11), T0 + 183, T0 + 10183, [(T0 + 183, 16.0), (T0 + 5183, 18.75)]),
        (Compare(EQ, 20), T0 + 183, T0 + 10183, [(T0 + 183, -INF), (T0 + 5183, 20.0)]),
        (Compare(GT, 10), T0 + 10000, T0 + 20000, []),
    ],
)
def test_golden_downsample(spark, compare, lower, upper, want):
    got = series.downsample(micro(spark, 15), Downsample(VIN, lower, upper, "azkp", AVG, 5000, compare))
    assert sorted((r.ts, r.azkp) for r in got.collect()) == want


def test_empty_windows_and_clamping(spark):
    df = micro(spark)
    req = dict(vin=VIN, lower=T0 - 4000, upper=T0 + 9500, column="azkp", how=MAX, interval=4000)
    omit = series.downsample(df, Downsample(**req))
    fill = series.downsample(df, Downsample(**req, empty_windows="fill"))
    assert rows_of(omit) == [(15, T0, VIN), (18, T0 + 8000, VIN), (21, T0 + 4000, VIN)]
    assert (-2147483648, T0 - 4000, VIN) in rows_of(fill) and fill.count() == 4
    nothing = Downsample(VIN, 10, 20, "azkp", MAX, 5, None, "fill")
    assert series.downsample(df, nothing).count() == 0


def test_nan_never_matches(spark):
    df = spark.createDataFrame([(VIN, 1, float("nan")), (VIN, 2, 0.7), (VIN, 3, 0.7), (VIN, 4, 0.7)], "vin string, ts bigint, d double")
    one = lambda c, how: series.downsample(df, Downsample(VIN, 0, 10, "d", how, 10, c)).first().d
    assert one(Compare(GT, 0.5), MAX) == 0.7
    assert one(Compare(EQ, 0.7), AVG) == 0.7  # the constant, not a rounded mean
    assert one(Compare(EQ, float("nan")), MAX) == -INF


def test_zero_rows_give_markers(spark):
    df = micro(spark)
    assert series.aggregate(df, Aggregate("B" * 17, 0, 10, "azkp", MAX)).first().azkp == -2147483648
    assert series.aggregate(df, Aggregate(VIN, 0, 10, "azkp", AVG)).first().azkp == -INF


def test_latest_and_range(spark):
    df = micro(spark).withColumnRenamed("azkp", "c")
    assert rows_of(series.latest(df, Latest.of([VIN, VIN, "nobody"]))) == [(16, T0 + 9000, VIN)]
    assert series.latest(df, Latest.of([])).count() == 0
    assert series.time_range(df, TimeRange(VIN, T0, T0 + 2000)).count() == 2
    assert series.time_range(df, TimeRange("nobody", T0, T0 + 2000)).columns == ["vin", "ts", "c"]
    with pytest.raises(ValueError):
        series.time_range(df, TimeRange(VIN, 0, 1, ("nope",)))


def test_requests_are_validated(spark):
    for bad in (lambda: TimeRange(VIN, 5, 5), lambda: Downsample(VIN, 0, 5, "c", AVG, 0), lambda: Downsample(VIN, 0, 5, "c", AVG, 1, None, "maybe")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        Compare(GT, "x")
    df = spark.createDataFrame([(VIN, 1, "a")], "vin string, ts bigint, s string")
    with pytest.raises(TypeError):
        series.aggregate(df, Aggregate(VIN, 0, 5, "s", MAX))


def test_upserts(spark):
    df = spark.createDataFrame([("a", 1, 5, 1), ("a", 1, 6, 3), ("a", 1, 7, 2), ("a", 2, 8, 0)], "vin string, ts bigint, v int, _seq int")
    assert sorted((r.ts, r.v) for r in series.resolve_upserts(df).collect()) == [(1, 6), (2, 8)]


def test_dictionary_over_many_partitions(spark):
    df = spark.range(1000).selectExpr("lpad(string(id % 300), 17, '0') AS vin")
    got = {r.vin: r.vin_id for r in series.vin_dictionary(df).collect()}
    assert got == {f"{i:017d}": i for i in range(300)}
    assert series.vin_dictionary(df.limit(0)).count() == 0


def test_schema_rules():
    assert [n for n, _, _ in ordinals({"b": ColumnType.DOUBLE, "a": ColumnType.STRING, "z": ColumnType.INTEGER})] == ["z", "b", "a"]
    for bad in ({}, {"vin": ColumnType.STRING}, {"a": ColumnType.STRING, "A": ColumnType.STRING}):
        with pytest.raises(ValueError):
            series_schema(bad)


def test_filters_reach_the_scan(spark, small):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = spark.read.parquet(f"{small}/trip_rows.parquet").select("vin", "ts", "rlxhl", "zdl", "clzt")
    plan = series.aggregate(df, Aggregate(VIN, 0, 5, "rlxhl", MAX))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(vin," in plan and "LessThan(ts,5)" in plan and "zdl" not in plan.split("ReadSchema")[1]
