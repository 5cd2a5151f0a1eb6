"""Rows as text lines for fixtures and exchange: CSV with a header, strings quoted, doubles in full precision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_OPTIONS = {"header": "true", "quoteAll": "true", "escape": '"', "emptyValue": "", "nullValue": "\\N", "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def export_rows(df: DataFrame, path: str) -> None:
    df.write.options(**_OPTIONS).mode("errorifexists").csv(path)


def import_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).options(**_OPTIONS, mode="FAILFAST").csv(path)
