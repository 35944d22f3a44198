"""CSV in: a distributed split of lines where no quote occurs, a distributed record scan where one does."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.errors import parse_error
from plumbline.functions.inference import rank, widest
from plumbline.plans import ORD, Plan
from plumbline.sources.files import Peek
from plumbline.sources.scanner import Malformed, delimiter_byte, ends_open, records, table
from plumbline.types import ColumnType

BOM = b"\xef\xbb\xbf"


def read(spark: SparkSession, path: str | os.PathLike[str], delimiter: str = ",", types: Sequence[ColumnType] | None = None) -> Plan:
    """The table in one file. The grammar and the types are checked here and now, in two jobs; the rows are read when
    they are used. types: asked for instead of those that the cells would have."""
    mark = delimiter_byte(delimiter)
    peek = Peek(spark, path)
    source = os.fsdecode(os.fspath(path))
    return _split(spark, peek, delimiter, source, types) or _scanned(spark, peek, mark, source, types)


def _split(spark: SparkSession, peek: Peek, delimiter: str, source: str, asked: Sequence[ColumnType] | None) -> Plan | None:
    """The fast path over a splittable line scan; None if there is a quote, or a CR at the end."""
    # ORD right on the scan, where it rises with the place in the file; lines end at LF only
    lines = spark.read.text(peek.uri, lineSep="\n").select("value", F.monotonically_increasing_id().alias(ORD))
    if peek.last == b"\r":  # a CR that ends the file is data, and only the record scan knows its line
        return None
    line = F.when(F.endswith("value", F.lit("\r")), F.left("value", F.length("value") - 1)).otherwise(F.col("value"))
    lines = lines.select(line.alias("value"), ORD).where("value <> ''")
    first = lines.select("value", ORD, F.expr("is_valid_utf8(value)").alias("valid")).head()
    if first is None:
        raise parse_error("no_header", source)
    if '"' in first.value:
        return None
    header = first.value.split(delimiter)
    if peek.first == BOM and not header[0].startswith("﻿"):
        header[0] = "﻿" + header[0]
    cells = F.split("value", "\\Q" + delimiter + "\\E", -1)
    rows = lines.where(F.col(ORD) > first[ORD])
    split = rows.select(cells.alias("cells"), "value", ORD)
    width = len(header)
    checks = split.agg(
        F.coalesce(F.max(F.contains("value", F.lit('"'))), F.lit(False)).alias("quote"),
        F.coalesce(F.max(F.size("cells") != width), F.lit(False)).alias("ragged"),
        F.coalesce(F.min(F.expr("is_valid_utf8(value)")), F.lit(True)).alias("valid"),
        *[widest(F.get("cells", F.lit(i))).alias(f"t{i}") for i in range(width)],
    ).first()
    if checks["quote"]:
        return None
    if checks["ragged"]:
        raise parse_error("ragged", source)
    if not checks["valid"] or not first.valid:
        raise UnicodeDecodeError("utf-8", b"", 0, 1, f"invalid bytes in {source}")
    types = _types([checks[f"t{i}"] for i in range(width)], asked, tuple(header))
    return Plan(split.select(*_typed(lambda i: F.col("cells")[i], types), ORD), tuple(header), types, in_order=True)


def _types(inferred: list[int], asked: Sequence[ColumnType] | None, names: tuple[str, ...]) -> tuple[ColumnType, ...]:
    """The columns' types. One that is asked for must hold all cells: integers go as floats, and anything as text."""
    found = tuple(map(ColumnType, inferred))
    if asked is None:
        return found
    if len(asked) != len(found):
        raise ValueError(f"{len(asked)} types for {len(found)} columns")
    for name, kind, wish in zip(names, found, asked, strict=True):
        if kind > wish:
            raise ValueError(f"column {name!r} has cells that are no {wish}")
    return tuple(map(ColumnType, asked))


def _typed(cell, types: tuple[ColumnType, ...]) -> list[Column]:
    """Casts that can't fail: the types were inferred from these cells."""
    return [cell(i).cast(kind.spark).alias(f"c{i}") for i, kind in enumerate(types)]


class _Split:
    """Scanning one split of a file: it knows whether it starts inside a quoted field, and in which record."""

    def __init__(self, mark: int, bom: bool, final: int | None):
        self.mark, self.bom, self.final = mark, bom, final

    def lines(self, batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
        for n, line in zip(batch.column(ORD).to_pylist(), batch.column("value").to_pylist(), strict=True):
            yield n, BOM + line if self.bom and n == 0 else line

    def summary(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(start of the split, for either start: the record that is open at its end, -1 if none is, null if it is the one that
        was open at its start; and the number of the last line)."""
        now: list[tuple[bool, int | None]] = [(False, -1), (True, None)]
        start = n = None
        for batch in batches:
            if start is None and batch.num_rows:
                start = batch.column("split")[0].as_py()
            for n, line in self.lines(batch):
                if b'"' in line:
                    now = [(after, (-1 if not after else at if inside else n)) for inside, at in now for after in (ends_open(inside, line, self.mark),)]
        if start is not None:
            columns = [pa.array([start], pa.int64()), *(pa.array([at], pa.int64()) for _, at in now), pa.array([n], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["split", "plain", "quoted", "last"])

    def records(self, opened: dict[int, int]):
        """Rows of records that lie in one split, numbered by their first line, and the lines of those that don't, with
        their record's number. opened: for every split the record that is open where it starts, -1 if none is."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            record, pending, whole, first = -1, [], True, True
            for batch in batches:
                if first and batch.num_rows:
                    start = batch.column("split")[0].as_py()
                    if start not in opened:
                        raise RuntimeError("files are split otherwise than when the table was read; keep spark.sql.files settings, or read it again")
                    record = opened[start]
                    whole, first = record < 0, False
                out = _Rows()
                for n, line in self.lines(batch):
                    quote = b'"' in line
                    if record < 0:
                        if quote and ends_open(False, line, self.mark):
                            record, pending = n, [(n, line)]
                        else:
                            self._parse(out, n, line, n)
                        continue
                    pending.append((n, line))
                    if quote and not ends_open(True, line, self.mark):
                        if whole:
                            self._parse(out, record, b"\n".join(x for _, x in pending), n)
                        else:
                            out.pieces(record, pending)
                        record, pending, whole = -1, [], True
                if not whole:
                    out.pieces(record, pending)
                    pending = []
                yield out.batch()
            if pending:
                out = _Rows()
                out.pieces(record, pending)
                yield out.batch()

        return run

    def joined(self, key: tuple, rows: pa.Table) -> pa.Table:
        """A record from its lines, in order."""
        rows = rows.sort_by("line")
        out = _Rows()
        self._parse(out, key[0].as_py(), b"\n".join(rows.column("piece").to_pylist()), rows.column("line")[-1].as_py())
        return pa.Table.from_batches([out.batch()])

    def _parse(self, out: _Rows, number: int, text: bytes, last: int) -> None:
        """Adds the record in `text`, whose last line is number `last`; none if it is blank."""
        try:
            for record in records(text if last == self.final else text + b"\n", self.mark):
                out.add(number, [c.decode() for c in record])
        except Malformed as e:
            out.add(number, None, e.args[0])
        except UnicodeDecodeError:
            out.add(number, None, "encoding")


class _Rows:
    """Rows to be: a record's cells, an error, or a line of a record that goes on elsewhere."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, number: int, cells: list[str] | None, error: str | None = None) -> None:
        self.rows.append((number, cells, error, None, None))

    def pieces(self, number: int, lines: list[tuple[int, bytes]]) -> None:
        self.rows += [(number, None, None, n, line) for n, line in lines]

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[ORD, "cells", "error", "line", "piece"])


_ROWS = f"{ORD} long, cells array<string>, error string, line long, piece binary"


def _scanned(spark: SparkSession, peek: Peek, mark: int, source: str, asked: Sequence[ColumnType] | None) -> Plan:
    """The strict path. A first pass over the file's splits finds where quoted fields are open at their ends, one row a
    split; then every split is scanned from the right state, and only records that cross splits are put together."""
    lines = spark.read.text(peek.uri, lineSep="\n").select(F.col("value").cast("binary").alias("value"), F.monotonically_increasing_id().alias(ORD), F.col("_metadata.file_block_start").alias("split"))
    split = _Split(mark, peek.first == BOM, None)
    opened, at, final = {}, -1, -1
    for row in sorted(lines.mapInArrow(split.summary, "split long, plain long, quoted long, last long").collect()):
        opened[row.split] = at
        if at < 0:
            at = row.plain
        elif row.quoted is not None:
            at = row.quoted
        final = max(final, row.last)
    if peek.last != b"\n":
        split.final = final
    found = lines.mapInArrow(split.records(opened), _ROWS)
    if at >= 0:
        # a quote that is never closed takes in the rest of the file: those lines are not put together, only what comes before is checked
        found = found.where(F.col(ORD) < at)
    early = min((n for n in opened.values() if n >= 0 and n != at), default=None)
    if early is not None:
        crossing = found.where("line IS NOT NULL").groupBy(ORD).applyInArrow(lambda key, rows: split.joined(key, rows), _ROWS)
        whole = found.where("line IS NULL").union(crossing)
    else:
        whole = found
    found = whole.select(ORD, "cells", "error")
    # the header is the first row of the scan, unless a record that crosses splits comes before it
    first = found.head() if early is None else found.orderBy(ORD).head()
    if first is None:
        raise parse_error("no_header" if at < 0 else "unterminated", source)
    width = len(first.cells or [])
    rows = found.where(F.col(ORD) > first[ORD])
    failed = F.when(F.col("error").isNotNull(), F.col(ORD))
    checks = found.agg(
        F.min_by("error", failed).alias("error"),
        F.coalesce(F.min(F.when((F.size("cells") != width) & F.col("error").isNull(), F.col(ORD))), F.lit(-1)).alias("ragged"),
        F.coalesce(F.min(failed), F.lit(-1)).alias("failed"),
        *[F.coalesce(F.max(F.when(F.col(ORD) > first[ORD], rank(F.get("cells", F.lit(i))))), F.lit(int(ColumnType.STRING))).alias(f"t{i}") for i in range(width)],
    ).first()
    # whichever comes first in the file
    if checks["ragged"] >= 0 and (checks["failed"] < 0 or checks["ragged"] < checks["failed"]):
        raise parse_error("ragged", source)
    if checks["error"] == "encoding":
        raise UnicodeDecodeError("utf-8", b"", 0, 1, f"invalid bytes in {source}")
    if checks["error"] or at >= 0:
        raise parse_error(checks["error"] or "unterminated", source)
    types = _types([checks[f"t{i}"] for i in range(width)], asked, tuple(first.cells))
    return Plan(rows.select(*_typed(lambda i: F.col("cells")[i], types), ORD), tuple(first.cells), types, in_order=early is None)


def parse(spark: SparkSession, text: str | bytes, delimiter: str = ",", types: Sequence[ColumnType] | None = None) -> Plan:
    """The table in text that is in memory already."""
    mark = delimiter_byte(delimiter)
    data = text.encode() if isinstance(text, str) else bytes(text)
    try:
        header, rows = table(data, mark)
    except Malformed as e:
        raise parse_error(e.args[0], None) from None
    names = tuple(h.decode() for h in header)
    cells = [[r[i].decode() for r in rows] for i in range(len(names))]
    fields = [T.StructField(f"c{i}", T.StringType(), False) for i in range(len(names))]
    schema = T.StructType([*fields, T.StructField(ORD, T.LongType(), False)])
    arrays = [*(pa.array(c, pa.string()) for c in cells), pa.array(range(len(rows)), pa.int64())]
    df = spark.createDataFrame(pa.Table.from_arrays(arrays, names=[f.name for f in schema]), schema)
    found = df.agg(*[widest(F.col(f"c{i}")).alias(f"t{i}") for i in range(len(names))]).first()
    kinds = _types(list(found), types, names)
    return Plan(df.select(*_typed(lambda i: F.col(f"c{i}"), kinds), ORD), names, kinds, in_order=True)

