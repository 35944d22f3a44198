"""Tables from Spark DataFrames, Parquet for one."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans import ORD, Plan
from plumbline.types import ColumnType, adapted


def from_spark(df: DataFrame, check: bool = False) -> Plan:
    """df as a table. Rows of a folder of files are in the order of the files' paths, then of the rows in them, however the scan packs its tasks;
    others in that of their partitions. Narrower ints become 64-bit, floats doubles. Columns of other types
    are refused. check: a job that refuses nulls, NaN and infinities, which no table holds."""
    types = []
    for field in df.schema:
        kind = adapted(field.dataType)
        if kind is None:
            raise TypeError(f"column {field.name!r} has type {field.dataType.simpleString()}, which no table holds; select other columns or cast it first")
        types.append(kind)
    names = [f.name for f in df.schema]
    placed = _placed(df)
    positional = (df if placed is None else placed).toDF(*[f"c{i}" for i in range(len(names))], *([] if placed is None else [ORD]))
    columns = [F.col(f"c{i}").cast(kind.spark).alias(f"c{i}") for i, kind in enumerate(types)]
    order = F.monotonically_increasing_id().alias(ORD) if placed is None else F.col(ORD)
    plan = Plan(positional.select(*columns, order), tuple(names), tuple(types), in_order=placed is None)
    if check:
        _refuse(plan)
    return plan


#: Bits of a row's place in its file.
_ROW_BITS = 40


def _placed(df: DataFrame) -> DataFrame | None:
    """df with one more column, the last, that rises with (file, row in it), if df reads several files; else None."""
    plain = lambda path: re.sub("^([^:/]+):/+", r"\1:/", path)
    files = sorted(set(map(plain, df.inputFiles())))
    if len(files) < 2:
        return None
    try:
        meta = df.metadataColumn("_metadata")
        path = F.regexp_replace(meta["file_path"], "^([^:/]+):/+", "$1:/").alias("\0path")
        rows = df.select(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns], path, meta["row_index"].alias("\0row"))
        rows.schema  # noqa: B018
    except AnalysisException:
        return None
    # a row for each file; of Arrow's rows the planner knows the size, and broadcasts them if they are small, so that df is not shuffled
    table = pa.table({"\0file": pa.array(files, pa.string()), "\0rank": pa.array([i << _ROW_BITS for i in range(len(files))], pa.int64())})
    ranks = df.sparkSession.createDataFrame(table, "`\0file` string, `\0rank` long")
    found = rows.join(ranks, F.col("`\0path`") == F.col("`\0file`"), "left")
    place = F.coalesce(F.col("`\0rank`"), F.raise_error(F.lit("a file that was not there when the table was opened")).cast("long")) + F.col("`\0row`")
    return found.select(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns], place.alias(ORD))


def _refuse(plan: Plan) -> None:
    bad = [plan.column(i).isNull() | ((F.isnan(plan.column(i)) | (F.abs(plan.column(i)) == float("inf"))) if kind is ColumnType.FLOAT else F.lit(False)) for i, kind in enumerate(plan.types)]
    if not bad:
        return
    row = plan.df.agg(*[F.coalesce(F.max(b), F.lit(False)) for b in bad]).first()
    for name, found in zip(plan.names, row, strict=True):
        if found:
            raise ValueError(f"column {name!r} holds a null, NaN or infinity")
