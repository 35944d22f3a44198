"""A store of immutable Parquet shards with size-tiered compaction and versioned manifests.

* `append` writes arrivals as small shards, one or more for each task, without a shuffle.
* `compact` sorts live shards into tiers of similar size (each tier FANIN times the one below) and merges every tier that
  has FANIN shards or more into files of about the target size. Spark's file scan packs whole small files into a task up to
  that size, so a merge is a scan and a write: no shuffle, no task larger than the target, whatever the skew of sources.
* Each change commits a new manifest, a list of the live shards. It is written under another name and then
  renamed to the next version, which fails if that version exists: readers see the old list or the new one,
  never a part, and of two writers one commits and the other has to start over.
* Files that a crashed job left are in no manifest; `vacuum` removes what the last versions don't list.

Documents are only touched by DataFrame reads and writes; the driver holds a line for each shard.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TARGET_BYTES = 128 << 20
#: Shards of a tier that are worth a merge, and how much larger a tier's shards are than those of the tier below.
FANIN = 4
SMALL_BYTES = 1 << 20
#: Rows of an arrival's shard, at most.
SMALL_ROWS = 5_000
#: Columns that `read` adds.
SHARD, SHARD_SIZE = "_shard", "_shard_bytes"


class Conflict(RuntimeError):
    """Another writer committed the version first; nothing was changed."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, fanin: int = FANIN, small_rows: int = SMALL_ROWS):
        self.spark, self.root, self.target, self.fanin, self.small_rows = spark, root.rstrip("/"), target, fanin, small_rows
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    # manifests

    def version(self) -> int:
        """The newest version, 0 before the first commit."""
        folder = self._path("manifest")
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> list[dict]:
        """Live shards of a version: path under the root, bytes."""
        version = self.version() if version is None else version
        if not version:
            return []
        lines = self.spark.read.text(f"{self.root}/manifest/v{version:08d}.json").toLocalIterator()
        return sorted((json.loads(r.value) for r in lines), key=lambda s: s["path"])

    def commit(self, shards: list[dict], base: int) -> int:
        """Makes `shards` the version after `base`, or raises Conflict."""
        name = f"v{base + 1:08d}.json"
        draft = self._path(f"manifest/.draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        try:
            for shard in sorted(shards, key=lambda s: s["path"]):
                out.write(bytearray(json.dumps(shard, sort_keys=True).encode() + b"\n"))
        finally:
            out.close()
        fc = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.conf)
        plain = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            fc.rename(fc.makeQualified(draft), fc.makeQualified(self._path(f"manifest/{name}")), plain)
        except Exception as e:
            self.fs.delete(draft, False)
            if self.version() > base:
                raise Conflict(f"version {base + 1} is there already") from e
            raise
        return base + 1

    # shards

    def _write(self, df: DataFrame) -> list[dict]:
        if SHARD in df.columns:
            raise ValueError(f"column {SHARD!r} is the store's own")
        folder = f"data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", self.small_rows if self.small_rows else 0).parquet(f"{self.root}/{folder}")
        return self._listed(folder, df.schema.json())

    def _listed(self, folder: str, schema: str) -> list[dict]:
        files = self.fs.listStatus(self._path(folder))
        return [{"path": f"{folder}/{s.getPath().getName()}", "bytes": s.getLen(), "schema": schema} for s in files if s.getPath().getName().endswith(".parquet")]

    def append(self, df: DataFrame) -> int:
        """Adds the rows of df as small shards; returns the version. Rows are kept as they are: nulls, repeated rows, texts of any length, any
        columns but one of the name SHARD. Each shard's schema is in the manifest, so arrivals may differ in columns; of shards that lack a column it
        is null. An empty df adds one shard without rows, which holds the schema."""
        base = self.version()
        return self.commit([*self.manifest(base), *self._write(df)], base)

    def tier(self, bytes_: int) -> int:
        """Shards of tier t have SMALL_BYTES * fanin^t bytes or more (tier 0: fewer, too)."""
        return max(0, math.floor(math.log(max(bytes_, 1) / SMALL_BYTES, self.fanin))) if bytes_ >= SMALL_BYTES else 0

    def due(self, shards: list[dict]) -> list[list[dict]]:
        """Groups of shards of one tier and schema, below half the target, that are to be merged."""
        tiers: dict[tuple[int, str], list[dict]] = {}
        for s in shards:
            if 2 * s["bytes"] < self.target:
                tiers.setdefault((self.tier(s["bytes"]), s["schema"]), []).append(s)
        return [group for _, group in sorted(tiers.items()) if len(group) >= self.fanin]

    def compact(self) -> int:
        """Merges until no tier is due; every round is a version of its own. Returns the last version. A group that the scan can't pack into
        fewer files stays as it was. If another writer commits first, its shards are taken in and the round's merges kept."""
        base = self.version()
        shards, settled = self.manifest(base), set()
        while groups := [g for g in self.due(shards) if frozenset(s["path"] for s in g) not in settled]:
            merged = []
            for group in groups:
                made = self._merge(group)
                if len(made) < len(group):
                    merged.append(({s["path"] for s in group}, made))
                else:
                    settled.add(frozenset(s["path"] for s in group))
            while merged:
                live = {s["path"] for s in shards}
                fit = [(gone, made) for gone, made in merged if gone <= live]
                lost = set().union(*(gone for gone, _ in fit)) if fit else set()
                after = [s for s in shards if s["path"] not in lost] + [s for _, made in fit for s in made]
                if not fit:
                    break
                try:
                    base, shards = self.commit(after, base), after
                    break
                except Conflict:
                    base = self.version()
                    shards = self.manifest(base)
        return base

    def _merge(self, group: list[dict]) -> list[dict]:
        session = self.spark.newSession()
        for key, value in (("maxPartitionBytes", self.target), ("openCostInBytes", 0), ("minPartitionNum", 1)):
            session.conf.set(f"spark.sql.files.{key}", str(value))
        paths = [f"{self.root}/{s['path']}" for s in group]
        folder = f"data/{uuid.uuid4().hex}"
        schema = group[0]["schema"]
        rows = session.read.schema(StructType.fromJson(json.loads(schema))).parquet(*paths)
        rows.write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(f"{self.root}/{folder}")
        return self._listed(folder, schema)

    def vacuum(self, versions: int = 1) -> None:
        """Deletes data that the last `versions` versions don't list. Not while another writer is at work."""
        now = self.version()
        listed = {s["path"].rpartition("/")[0] for v in range(max(1, now - versions + 1), now + 1) for s in self.manifest(v)}
        live = {s["path"] for v in range(max(1, now - versions + 1), now + 1) for s in self.manifest(v)}
        for folder in self.fs.listStatus(self._path("data")):
            name = f"data/{folder.getPath().getName()}"
            if name not in listed:
                self.fs.delete(folder.getPath(), True)
                continue
            for f in self.fs.listStatus(folder.getPath()):
                if f.getPath().getName().endswith(".parquet") and f"{name}/{f.getPath().getName()}" not in live:
                    self.fs.delete(f.getPath(), False)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with the shard's path under the root as the column SHARD and its size as SHARD_SIZE. Columns are those of all
        shards; where one type of a column can't hold the others', it raises TypeError."""
        shards = self.manifest(version)
        if not shards:
            raise FileNotFoundError(f"no version in {self.root}")
        parts: dict[str, list[str]] = {}
        for s in shards:
            parts.setdefault(s["schema"], []).append(f"{self.root}/{s['path']}")
        whole = None
        for schema, paths in sorted(parts.items()):
            df = self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*paths)
            meta = df.metadataColumn("_metadata")
            df = df.select("*", F.regexp_extract(meta["file_path"], "data/[^/]*/[^/]*$", 0).alias(SHARD), meta["file_size"].alias(SHARD_SIZE))
            kinds = {f.name: f.dataType for f in df.schema}
            if whole is not None and any(kinds.get(f.name, f.dataType) != f.dataType for f in whole.schema):
                raise TypeError("shards hold a column in different types")
            whole = df if whole is None else whole.unionByName(df, allowMissingColumns=True)
        return whole
