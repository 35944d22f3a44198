"""CSV out."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.csv_text import field, header
from plumbline.plans import Plan
from plumbline.sources.files import escaped, located, seen_by_tasks
from plumbline.sources.scanner import delimiter_byte

#: Bytes of text in a row of the table that a file is made from, and in a row group of it.
_BLOCK, _GROUP = 1 << 18, 1 << 24


def _lines(plan: Plan, delimiter: str) -> DataFrame:
    """The records in order, a row (value) each, without line ends."""
    fields = [field(F.col(f"c{i}"), kind, delimiter, len(plan.types) == 1) for i, kind in enumerate(plan.types)]
    return plan.ordered().select(F.concat_ws(delimiter, *fields).alias("value"))


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(["\n".join(batch.column(0).to_pylist())], pa.string())], names=["block"])


def blocks(plan: Plan, delimiter: str) -> Iterator[str]:
    """The records in order, header first, many to a text, without its last line end. They come a partition at a time."""
    delimiter_byte(delimiter)
    yield header(plan.names, delimiter)
    if not plan.names:
        for _ in range(plan.df.count()):
            yield ""
        return
    for row in _lines(plan, delimiter).mapInArrow(_block_batches, "block string").toLocalIterator(prefetchPartitions=True):
        yield row.block


def to_csv(plan: Plan, path: str | os.PathLike[str] | None = None, delimiter: str = ",") -> str | None:
    """The table as CSV text, or written to one local file. It reads back with the same names, types and values. The tasks write the file
    if they see it (see files.seen_by_tasks); else it comes to the driver, whose disk it is for, a partition at a time."""
    found = blocks(plan, delimiter)
    if path is None:
        return "".join(block + "\n" for block in found)
    first = next(found)
    where = os.path.realpath(os.fsdecode(os.fspath(path)))
    if plan.names and seen_by_tasks(plan.df.sparkSession, where):
        _write_file(plan, where, delimiter, first.encode() + b"\n")
        return None
    with open(path, "wb") as out:
        out.write(first.encode() + b"\n")
        for block in found:
            out.write(block.encode() + b"\n")
    return None


def _placed_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of a partition's records in blocks, each with the partition and its place in that partition's text."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        # records with their line ends, which lie one after another
        lines = pc.binary_join_element_wise(batch.column(0).cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
        _, places, data = lines.buffers()
        places = memoryview(places).cast("q")
        text = memoryview(data)[places[lines.offset] : places[lines.offset + len(lines)]]
        cuts = range(0, len(text), _BLOCK)
        found = [text[k : k + _BLOCK] for k in cuts]
        columns = [pa.array([part] * len(cuts), pa.int32()), pa.array([at + k for k in cuts], pa.int64()), pa.array(map(len, found), pa.int64()), pa.array(map(bytes, found), pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "at", "size", "text"])
        at += len(text)


def _into(path: str, starts: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes blocks at their places in the file; a row of how many bytes they have. A block that is written twice is the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 0
        out = os.open(path, os.O_WRONLY)
        try:
            for batch in batches:
                for part, at, text in zip(batch.column("part").to_pylist(), batch.column("at").to_pylist(), batch.column("text"), strict=True):
                    rest, place = memoryview(text.as_buffer()), starts[part] + at
                    size += len(rest)
                    while rest:
                        n = os.pwrite(out, rest, place)
                        rest, place = rest[n:], place + n
            os.fsync(out)
        finally:
            os.close(out)
        yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64())], names=["size"])

    return run


def _write_file(plan: Plan, path: str, delimiter: str, top: bytes) -> None:
    """One file, written by the tasks. The text goes to a table beside it first, in blocks, as only then the sizes of the partitions
    are known and stay what they are; these come to the driver, and every block is written at its own place."""
    with open(path, "ab"):  # what is wrong with the path is raised before there is a job
        pass
    spark = plan.df.sparkSession
    folder = os.path.join(os.path.dirname(path), f"csv-{uuid.uuid4().hex}.parts")
    try:
        staged = _lines(plan, delimiter).mapInArrow(_placed_blocks, "part int, at long, size long, text binary")
        staged.write.option("compression", "zstd").option("parquet.block.size", _GROUP).parquet(located(folder))
        blocks = spark.read.schema(staged.schema).parquet(escaped(located(folder)))
        starts, end = {}, len(top)
        for part, size in sorted(blocks.groupBy("part").agg(F.sum("size")).collect()):
            starts[part] = end
            end += size
        with open(path, "wb") as out:
            out.write(top)
            out.truncate(end)
        written = blocks.select("part", "at", "text").mapInArrow(_into(path, starts), "size long").agg(F.sum("size")).first()[0] or 0
        if len(top) + written != end:
            raise OSError(f"{len(top) + written} of {end} bytes were written to {path}")
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def write_parts(plan: Plan, path: str, delimiter: str = ",") -> None:
    """The table as a folder of text files, part by part in row order, for tables that one file or the driver is too small for. The header
    is the first part's first record; the files one after another, in the order of their names, are the CSV text."""
    delimiter_byte(delimiter)
    records = _lines(plan, delimiter)
    top = plan.df.sparkSession.createDataFrame([(header(plan.names, delimiter),)], "value string").coalesce(1)
    top.union(records).write.text(path)
