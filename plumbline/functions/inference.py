"""Type inference as one Catalyst expression for each column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.types import ColumnType

#: \A and \z, as $ would also match before a final line break.
INT = r"\A[+-]?[0-9]+\z"
FLOAT = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


def rank(cell: Column) -> Column:
    """The narrowest type that holds a cell's text: a 64-bit int, a finite float, else text. The widest over a
    column is its type."""
    number = cell.try_cast("double")
    finite = (number < float("inf")) & (number > float("-inf"))
    return (
        F.when(cell.rlike(INT) & cell.try_cast("bigint").isNotNull(), int(ColumnType.INT)).when(cell.rlike(FLOAT) & finite, int(ColumnType.FLOAT)).otherwise(int(ColumnType.STRING))
    )


def widest(cell: Column) -> Column:
    """The column's type; text if there are no rows."""
    return F.coalesce(F.max(rank(cell)), F.lit(int(ColumnType.STRING)))
