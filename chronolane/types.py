"""Column types, markers and schema rules of a series table."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T

# Fixed values of the contract.
VIN_LENGTH = 17
INT_NO_DATA = -2147483648
DOUBLE_NO_DATA = float("-inf")

KEY_FIELDS = [T.StructField("vin", T.StringType(), False), T.StructField("ts", T.LongType(), False)]
RESERVED = {"vin", "ts", "_seq", "_bucket"}


class ColumnType(Enum):
    INTEGER = "int"
    DOUBLE = "double"
    STRING = "string"

    @property
    def spark(self) -> T.DataType:
        return {"int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}[self.value]

    @classmethod
    def of(cls, kind: T.DataType) -> ColumnType:
        for x in cls:
            if x.spark == kind:
                return x
        raise TypeError(f"unsupported column type {kind.simpleString()}")


class Aggregator(Enum):
    AVG = "avg"
    MAX = "max"


class CompareOp(Enum):
    EQUAL = "eq"
    GREATER = "gt"


def series_schema(columns: dict[str, ColumnType]) -> T.StructType:
    """``vin`` and ``ts`` followed by the declared columns, none of them nullable."""
    if not columns:
        raise ValueError("a series table needs at least one column")
    folded = [c.lower() for c in columns]
    if len(set(folded)) < len(folded) or RESERVED & set(folded):
        raise ValueError(f"clashing column names: {sorted(columns)}")
    return T.StructType(KEY_FIELDS + [T.StructField(c, k.spark, False) for c, k in columns.items()])


def declared(schema: T.StructType) -> dict[str, ColumnType]:
    """The value columns of a table; its key and internal columns left out."""
    return {f.name: ColumnType.of(f.dataType) for f in schema if f.name not in RESERVED}


def ordinals(columns: dict[str, ColumnType]) -> list[tuple[str, int, str]]:
    """(name, ordinal, type): ints, then doubles, then strings, by name in each type."""
    rank = {ColumnType.INTEGER: 0, ColumnType.DOUBLE: 1, ColumnType.STRING: 2}
    names = sorted(columns, key=lambda c: (rank[columns[c]], c))
    return [(c, i, columns[c].value) for i, c in enumerate(names)]
