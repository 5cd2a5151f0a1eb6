"""Every query with SQL against DuckDB on the smallest tables; columns functions; the entry point."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chronolane.functions import bit_width, fold_text, zigzag_decode, zigzag_encode
from chronolane.plans import general, reference
from tests.conftest import compare_with_sql


@pytest.mark.parametrize("catalogue", [reference, general], ids=["reference", "general"])
def test_against_sql(spark, small, catalogue):
    assert compare_with_sql(spark, small, list(catalogue.SQL)) == []


def test_all_have_sql():
    assert set(reference.QUERIES) == set(reference.SQL) and set(general.QUERIES) == set(general.SQL)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["vin", "ts", "value"] and df.count() > 0


def test_functions(spark):
    df = spark.createDataFrame([(x,) for x in (0, -1, 1, -2, 2**31 - 1, -(2**31))], "x bigint")
    rows = df.select("x", zigzag_encode(F.col("x")).alias("z"), zigzag_decode(zigzag_encode(F.col("x"))).alias("back")).collect()
    assert all(r.back == r.x and r.z == (2 * r.x if r.x >= 0 else -2 * r.x - 1) for r in rows)
    small = df.select(F.col("x").cast("int").alias("x")).select("x", zigzag_decode(zigzag_encode(F.col("x"), 32), 32).alias("back")).collect()
    assert all(r.back == r.x for r in small)
    assert [r[0] for r in spark.range(5).select(bit_width(F.col("id"))).collect()] == [0, 1, 2, 2, 3]
    assert spark.createDataFrame([(" \tÄb　",)], "s string").select(fold_text(F.col("s"))).first()[0] == "äb"
