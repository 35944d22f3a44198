"""Comparison of a column with a constant."""

from __future__ import annotations

import math
import operator
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.errors import TEXT_AND_NUMBER
from plumbline.types import ColumnType

OPERATORS = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def check(name: str, kind: ColumnType, op: str, value: Any) -> None:
    """Raises what comparing a column of this type with the constant raises."""
    if op not in OPERATORS:
        raise ValueError(f"{op!r} is no comparison; there are {' '.join(OPERATORS)}")
    if isinstance(value, bool):
        raise TypeError(f"{name!r} holds no bools to compare with")
    if not isinstance(value, (int, float, str)):
        raise TypeError(f"{name!r} compares with int, float or str, not {type(value).__name__}")
    if isinstance(value, str) != (kind is ColumnType.STRING):
        raise TypeError(f"{TEXT_AND_NUMBER}: {name} {op} {value!r}")
    if isinstance(value, int) and not -(2**63) <= value < 2**63:
        raise OverflowError(f"{value} does not fit 64 bits")


def predicate(column: Column, kind: ColumnType, op: str, value: Any) -> Column:
    """An int column meets an int constant exactly, and a float one as a float; a float column meets either as a
    float. NaN is different from everything, itself included. Text is compared by its bytes."""
    if isinstance(value, float) and math.isnan(value):
        return F.lit(op == "!=")
    if kind is ColumnType.FLOAT or isinstance(value, float):
        value = float(value)
        column = column.cast("double") if kind is ColumnType.INT else column
    return OPERATORS[op](column, F.lit(value))
