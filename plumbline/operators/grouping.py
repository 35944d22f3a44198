"""Grouping by one key, groups in order of first appearance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators.reductions import aggregate
from plumbline.plans import ORD, Plan
from plumbline.types import ColumnType


def grouped(plan: Plan, key: int, specs: Sequence[tuple[int, str]]) -> Plan:
    """One row a group: the key, then a column for each (column, function). Partial aggregates before the one
    shuffle; the order is each group's least ORD. Of -0.0 and 0.0, which are one key, the first in order is shown."""
    plan = plan.numbered()
    columns = [aggregate(plan, i, func).alias(f"c{k}") for k, (i, func) in enumerate(specs, 1)]
    shown = F.min_by("c_key", ORD) if plan.types[key] is ColumnType.FLOAT else F.col("c_key")
    keyed = plan.df.withColumn("c_key", plan.column(key)).groupBy("c_key")
    df = keyed.agg(*columns, F.min(ORD).alias(ORD), *([shown.alias("c0")] if plan.types[key] is ColumnType.FLOAT else []))
    if plan.types[key] is not ColumnType.FLOAT:
        df = df.withColumnRenamed("c_key", "c0")
    df = df.select(*[f"c{k}" for k in range(len(specs) + 1)], ORD)
    names = (plan.names[key], *("count" if func == "count" else plan.names[i] for i, func in specs))
    types = (plan.types[key], *(ColumnType.INT if f == "count" else ColumnType.FLOAT if f == "mean" else plan.types[i] for i, f in specs))
    return Plan(df, names, types)


def ranked(plan: Plan) -> Plan:
    """plan with one more column `rank`: the place of each row in order, from 1. Rows are numbered within the partitions of one sort, and each
    partition's numbers begin where the one before ends; only the partitions' sizes meet. The sorted rows are kept until the session
    ends or their plan is unpersisted, as both passes must see the same partitions."""
    k = len(plan.names)
    place = F.monotonically_increasing_id()
    kept = plan.rows().withColumn("__place", place).persist(StorageLevel.DISK_ONLY)
    part = F.shiftright("__place", 33).alias("__part")
    sizes = kept.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    inside = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    df = kept.withColumn("__part", F.shiftright("__place", 33)).join(F.broadcast(before), "__part")
    df = df.withColumn(f"c{k}", F.col("__before") + inside + 1).drop("__place", "__part", "__before")
    return Plan(df, (*plan.names, "rank"), (*plan.types, ColumnType.INT), plan.keys)
