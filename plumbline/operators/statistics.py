"""Statistics of every column."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans import Plan
from plumbline.types import ColumnType

_NAMES = ("column", "type", "min", "max", "mean", "distinct")


def _one(plan: Plan, i: int) -> DataFrame:
    """Column i's row of the report. A count of distinct values groups by them, so that each column is an aggregate of its own, over a scan of just
    that column: several in one would copy every row once for each."""
    c, kind = plan.column(i), plan.types[i]
    nothing = F.lit(None).cast("double")
    numbers = (nothing,) * 3 if kind is ColumnType.STRING else (F.min(c), F.max(c), F.avg(c))
    return plan.df.agg(F.lit(plan.names[i]).alias("c0"), F.lit(str(kind)).alias("c1"), *(n.alias(f"c{k}") for k, n in enumerate(numbers, 2)), F.count_distinct(c).alias("c5"))


def statistics(plan: Plan) -> list[dict[str, Any]]:
    """For each column its name, type, min, max, mean (None for text or no rows) and distinct values, integers exactly."""
    out = []
    for i, kind in enumerate(plan.types):
        row = _one(plan, i).first()
        out.append({**dict(zip(_NAMES, row, strict=True)), "type": kind})
    return out
