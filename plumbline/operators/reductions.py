"""Reductions of whole columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.errors import EMPTY_COLUMN, NOT_NUMERIC, run
from plumbline.plans import Plan
from plumbline.types import ColumnType

FUNCTIONS = ("sum", "mean", "min", "max", "count")


def checked_sum(column: Column, kind: ColumnType, ansi: bool) -> Column:
    """Sum of the column's type. With ANSI off Spark's own sum would wrap, so that the sum is taken in decimals and
    checked on its way back."""
    if kind is ColumnType.FLOAT or ansi:
        return F.sum(column)
    total = F.sum(column.cast("decimal(38,0)"))
    fits = total.isNull() | total.between(F.lit(-(2**63)).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)"))
    return F.when(fits, total.cast("bigint")).otherwise(F.raise_error(F.lit("ARITHMETIC_OVERFLOW")).cast("bigint"))


def ansi(plan: Plan) -> bool:
    return plan.df.sparkSession.conf.get("spark.sql.ansi.enabled") == "true"


def aggregate(plan: Plan, i: int, func: str) -> Column:
    """The aggregate of column i. Text has none but count."""
    column, kind = plan.column(i), plan.types[i]
    if func == "count":
        return F.count(F.lit(1))
    if kind is ColumnType.STRING:
        raise TypeError(f"{NOT_NUMERIC}: {plan.names[i]}")
    if func == "sum":
        return checked_sum(column, kind, ansi(plan))
    return {"mean": F.avg, "min": F.min, "max": F.max}[func](column)


def reduce(plan: Plan, i: int, func: str) -> int | float:
    """sum, mean, min or max of a column: int columns keep their type but for the mean; no rows sum to zero and have
    no other value."""
    value, rows = run(lambda: plan.df.agg(aggregate(plan, i, func), F.count(F.lit(1))).first(), plan.names[i])
    if rows:
        return value
    if func != "sum":
        raise ValueError(f"{EMPTY_COLUMN}: {plan.names[i]}")
    return 0 if plan.types[i] is ColumnType.INT else 0.0
