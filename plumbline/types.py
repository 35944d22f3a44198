"""The three column types and how they map to Spark."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import types as T


class ColumnType(IntEnum):
    INT = 0
    FLOAT = 1
    STRING = 2

    def __str__(self) -> str:
        return self.name.lower()

    @property
    def spark(self) -> T.DataType:
        return (T.LongType(), T.DoubleType(), T.StringType())[self]


def adapted(kind: T.DataType) -> ColumnType | None:
    """The column type that holds values of a Spark type, None if there is none."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return ColumnType.INT
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return ColumnType.FLOAT
    if isinstance(kind, T.StringType):
        return ColumnType.STRING
    return None
