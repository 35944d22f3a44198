"""A few bytes of a file, and what is wrong with a path, before Spark plans a job for it."""

from __future__ import annotations

import errno
import os
import re

from pyspark.sql import SparkSession

_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]+://?")


def located(path: str | os.PathLike[str]) -> str:
    """A path that Spark resolves as the caller means it: local paths are made file URIs, other URIs stay."""
    text = os.fspath(path)
    text = os.fsdecode(text)
    return text if _SCHEME.match(text) else "file://" + os.path.abspath(text)


def escaped(uri: str) -> str:
    """A URI that Spark reads as it stands, where it would take some characters for a pattern."""
    return re.sub(r"([*?{}\[\]\\])", r"\\\1", uri)


def seen_by_tasks(spark: SparkSession, path: str) -> bool:
    """Whether tasks can write to a local path of the driver: in a local session, or in the folder that spark.checkpoint.dir (else the
    context) names, which all machines share. The path is no device, pipe or folder."""
    if os.path.exists(path) and not os.path.isfile(path):
        return False
    if spark.sparkContext.master.split("[")[0] == "local":
        return True
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        shared = found.get() if found.isDefined() else None
    shared = re.sub("^file:/+", "/", shared or "")
    return shared.startswith("/") and os.path.realpath(path).startswith(os.path.join(os.path.realpath(shared), ""))


def _missing(code: int, path: str) -> OSError:
    return OSError(code, os.strerror(code), path)


class Peek:
    """Size, first bytes and last byte of one file, in any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str | os.PathLike[str]):
        self.uri = located(path)
        name = os.fsdecode(os.fspath(path))
        if self.uri.startswith("file:/") and not _SCHEME.match(name):
            # the local errors as Python raises them
            if os.path.isdir(name):
                raise _missing(errno.EISDIR, name)
            with open(name, "rb") as f:
                self.first = f.read(3)
                self.size = os.fstat(f.fileno()).st_size
                f.seek(max(0, self.size - 1))
                self.last = f.read(1)
            return
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(self.uri)
        fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            raise _missing(errno.ENOENT, name)
        status = fs.getFileStatus(hadoop)
        if status.isDirectory():
            raise _missing(errno.EISDIR, name)
        self.size = status.getLen()
        stream = fs.open(hadoop)
        try:
            self.first = bytes(b for b in (stream.read() for _ in range(min(3, self.size))))
            stream.seek(max(0, self.size - 1))
            self.last = bytes([stream.read()]) if self.size else b""
        finally:
            stream.close()
