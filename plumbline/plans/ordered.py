"""A table as a lazy Spark plan that carries its row order.

The Spark DataFrame has columns c0..cN in display order, whatever their names (which may repeat or be empty), a
long column ORD that tells rows apart and gives their first order, and a hidden column for each pending
sort key. Sorting only notes a key: rows are ordered when they leave, by all keys at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.types import ColumnType

ORD = "__ord"


@dataclass(frozen=True)
class Plan:
    df: DataFrame
    names: tuple[str, ...]
    types: tuple[ColumnType, ...]
    #: pending sort keys, the first counts most: hidden column, ascending
    keys: tuple[tuple[str, bool], ...] = ()
    #: partitions, and rows in them, are in the order of ORD: true of scans and sorts, not of groups
    in_order: bool = False

    def column(self, i: int) -> Column:
        return F.col(f"c{i}")

    def order(self) -> list[Column]:
        return [*(F.asc(k) if up else F.desc(k) for k, up in self.keys), F.asc(ORD)]

    def hidden(self) -> list[str]:
        return [*(k for k, _ in self.keys), ORD]

    def select(self, indices: Sequence[int]) -> Plan:
        df = self.df.select(*[self.column(i).alias(f"c{k}") for k, i in enumerate(indices)], *self.hidden())
        return replace(self, df=df, names=tuple(self.names[i] for i in indices), types=tuple(self.types[i] for i in indices))

    def where(self, condition: Column) -> Plan:
        return replace(self, df=self.df.where(condition))

    def sorted(self, i: int, ascending: bool) -> Plan:
        """By column i; rows that tie keep their order. Of two sorts by one column only the later one matters,
        unless another came between them, so keys are kept until rows leave."""
        key = f"__key{len(self.keys)}"
        return replace(self, df=self.df.withColumn(key, self.column(i)), keys=((key, ascending), *self.keys))

    def numbered(self) -> Plan:
        """The same rows with pending keys turned into ORD: one range-partitioned sort, then numbers that rise
        with the partitions."""
        if not self.keys:
            return self
        visible = [f"c{i}" for i in range(len(self.names))]
        df = self.df.orderBy(*self.order()).select(*visible, F.monotonically_increasing_id().alias(ORD))
        return replace(self, df=df, keys=(), in_order=True)

    def rows(self) -> DataFrame:
        """All columns, rows in order. Where they are in order already, nothing is sorted."""
        return self.df if self.in_order and not self.keys else self.df.orderBy(*self.order())

    def ordered(self) -> DataFrame:
        """The visible columns, rows in order."""
        return self.rows().select(*[f"c{i}" for i in range(len(self.names))])

    def first(self, n: int) -> DataFrame:
        """The first n rows: of a scan, just the partitions that hold them are read; of pending sort keys, a top-k."""
        return self.rows().limit(n).select(*[f"c{i}" for i in range(len(self.names))])

    def renamed(self) -> DataFrame:
        """The visible columns under their display names, in no order."""
        return self.df.select(*[self.column(i).alias(n) for i, n in enumerate(self.names)])
