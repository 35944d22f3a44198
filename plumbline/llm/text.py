"""Byte-level word splitting over whole Arrow columns, and small Spark helpers shared by the operators.

A text column arrives from Spark as one contiguous UTF-8 buffer with offsets. All splitting works on that
buffer with NumPy, a few megabytes of documents at a time, so that Python never touches a single word more
often than once per distinct word of a chunk. Both word patterns used here only tell ASCII bytes apart
(every byte of a multi-byte character is 0x80 or more), so looking at bytes gives the same words as the
regular expression on the decoded text.
"""

from __future__ import annotations

import atexit
import ctypes
import math
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one NumPy pass works on; a longer document is one chunk of its own.
CHUNK_BYTES = 1 << 20

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

#: `[^\x20\x09-\x0D]+`
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` on lower-cased text
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (one more than rows) of a string column; null counts as the empty text. Called once a
    batch: what earlier batches left goes back to the system first, as a worker lives on through many stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(at: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most `most` bytes; a longer row stands alone."""
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


class Words:
    """The words of a few documents: positions in `data` (lower-cased bytes), and the row that each lies in."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, table: np.ndarray, lower: bool = True):
        self.at = at
        self.data = _LOWER[raw] if lower else raw
        self.inside = inside = table[self.data]
        n = len(raw)
        first = np.empty(n, dtype=bool)
        last = np.empty(n, dtype=bool)
        if n:
            first[0], first[1:] = True, ~inside[:-1]
            last[-1], last[:-1] = True, ~inside[1:]
            edges = at[(at > 0) & (at < n)]
            first[edges] = True
            last[edges - 1] = True
        self.start = np.flatnonzero(inside & first)
        self.end = np.flatnonzero(inside & last) + 1
        self.row = np.searchsorted(at, self.start, "right") - 1
        self.per_row = np.bincount(self.row, minlength=len(at) - 1)
        #: index of each row's first word, and one past the last row's last word
        self.word_at = np.concatenate(([0], np.cumsum(self.per_row)))

    def __len__(self) -> int:
        return len(self.start)

    def coded(self) -> tuple[np.ndarray, list[bytes]]:
        """A code for each word, and the distinct words by code."""
        return coded(self.data[self.inside], self.end - self.start)


def coded(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Dictionary-encodes the byte strings that lie one after another in `data`."""
    at = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=at[1:])
    strings = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
    found = pc.dictionary_encode(strings)
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist()


def crc_of_id(ids: pa.Array) -> np.ndarray:
    """crc32 of an integer id written as text; a null id counts as the empty text."""
    from zlib import crc32

    return np.fromiter((crc32(b"" if i is None else str(i).encode()) for i in ids.to_pylist()), dtype=np.int64, count=len(ids))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the one set on the context; with neither, a
    temporary one in a local session (tests). On a cluster one of the two must be set: any other folder may be a machine's own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not path:
        found = context._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        path = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(path)
    return path


def written(df: DataFrame, keep: str = "zstd") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, which cuts its lineage: a lost executor
    costs only the tasks it was running."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", keep).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key of more rows than this is joined by broadcast; there are at most rows / HOT_ROWS such keys.
HOT_ROWS = 100_000


def joined(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """rows with the columns of classes, which has each key of rows once and in `rows` how many rows have it. Rows of keys that
    are very frequent meet their class where they are, so that no task gets all of them."""
    hot, rest = classes.where(F.col("rows") > HOT_ROWS), classes.where(F.col("rows") <= HOT_ROWS)
    if hot.isEmpty():
        return rows.join(classes, key)
    hot = F.broadcast(hot)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))


def partitions_for(rows: int, each: int) -> int:
    return max(1, math.ceil(rows / each))


#: Types of the internal names: narrower ids are widened.
_KINDS = {"doc_id": "long", "page_id": "long", "vec_id": "long", "text": "string", "url": "string"}


def columns(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Just the named columns, renamed to fixed internal names, so that no other column can clash."""
    named = [(F.col(f"`{name}`"), alias) for name, alias in pairs]
    return df.select(*[(c.cast(_KINDS[alias]) if alias in _KINDS else c).alias(alias) for c, alias in named])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_thread() -> None:
    """Executors run a task on each core; a BLAS pool of its own in each worker would only get in the way."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
