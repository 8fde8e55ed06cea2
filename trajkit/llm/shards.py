"""Sharding by size-tiered compaction: immutable shards, merges of similarly sized runs, versioned manifests committed by one rename."""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from trajkit.llm.common import fresh_names


@dataclass(frozen=True)
class Shard:
    """path is relative to the store."""

    path: str
    size: int


class CommitConflict(RuntimeError):
    """Another writer has committed the version."""


class ShardStore:
    """A set of Parquet shards below one folder that all executors share.

    Writers put new files into a folder of their own and then commit a manifest that lists all live shards as version n + 1:
    the manifest is written beside and renamed into place, which fails where that version exists; a writer that comes too
    late looks at the newer version and commits on top of it. The rename must be atomic, as it is on HDFS and local disks; a
    store without such a rename needs a file system in front of it that has one. A reader sees one version whole or not at
    all; a task or executor that is lost leaves files that no manifest names, which vacuum() deletes.

    A manifest holds the schema and a path and a size per shard: the driver's share grows with the number of files, not of
    rows. Arrivals may bring new columns; older rows hold null there. A column whose type differs, or whose name differs only
    by case, is refused with ValueError before anything is written.
    """

    def __init__(self, spark: SparkSession, root: str, *, target_bytes: int = 512 << 20, fan_in: int = 4, merges_per_job: int = 64):
        self.spark, self.root, self.target, self.fan_in, self.per_job = spark, root.rstrip("/"), target_bytes, fan_in, merges_per_job
        self._jvm = spark._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        if not self._fs().exists(self._path("manifests")):
            return []
        names = [s.getPath().getName() for s in self._fs().listStatus(self._path("manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _manifest(self, version: int | None) -> dict:
        known = self.versions()
        version = version if version is not None else (known[-1] if known else 0)
        if not version:
            return {"version": 0, "schema": StructType([]).jsonValue(), "shards": []}
        stream = self._fs().open(self._path(f"manifests/v{version:010d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def shards(self, version: int | None = None) -> tuple[int, list[Shard]]:
        """(version, its live shards); the newest version unless one is named, 0 and none for an empty store."""
        found = self._manifest(version)
        return found["version"], [Shard(**s) for s in found["shards"]]

    def schema(self, version: int | None = None) -> StructType:
        return StructType.fromJson(self._manifest(version)["schema"])

    def commit(self, version: int, shards: list[Shard], schema: StructType | None = None) -> int:
        """Make shards the live ones of version, atomically; CommitConflict if it exists. The schema stays unless one is given."""
        schema = self.schema() if schema is None else schema
        fs, aside, place = self._fs(), self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/v{version:010d}.json")
        out = fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps({"version": version, "schema": schema.jsonValue(), "shards": [asdict(s) for s in shards]}).encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self._conf)
        never_over = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never_over[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(aside, place, never_over)
        except Exception as e:
            fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(f"version {version} exists") from e
            raise
        return version

    def _written(self, df: DataFrame) -> list[Shard]:
        """Write df into a new folder and list its files."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        files = [(s.getPath().getName(), s.getLen()) for s in self._fs().listStatus(self._path(folder))]
        return [Shard(f"{folder}/{name}", size) for name, size in sorted(files) if name.endswith(".parquet")]

    def _rebased(self, change: Callable[[list[Shard]], list[Shard]], arriving: StructType | None = None) -> int:
        """Commit what change makes of the newest version's shards, again on top of each version that others commit first."""
        while True:
            version, live = self.shards()
            held = self.schema()
            try:
                return self.commit(version + 1, change(live), held if arriving is None else merged_schema(held, arriving))
            except CommitConflict:
                continue

    def append(self, arrivals: DataFrame) -> int:
        """Add arrivals as small shards, as many as df has partitions; a new version."""
        merged_schema(self.schema(), arrivals.schema)  # refuses before anything is written
        new = self._written(arrivals)
        return self._rebased(lambda live: live + new, arrivals.schema)

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs to merge. Shards below target are of tier floor(log_fan_in(size)); a tier with fan_in shards is cut into runs of about target."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.size < self.target // 2:
                tiers.setdefault(int(math.log(max(s.size, 1), self.fan_in)), []).append(s)
        runs = []
        for tier in sorted(tiers):
            some = sorted(tiers[tier], key=lambda s: (s.size, s.path))
            if len(some) < self.fan_in:
                continue
            count = max(1, round(sum(s.size for s in some) / self.target))
            share, held, run = sum(s.size for s in some) / count, 0, []
            for s in some:
                run.append(s)
                held += s.size
                if held >= share:
                    runs.append(run)
                    run, held = [], 0
            if run:
                runs.append(run)
        return [r for r in runs if len(r) > 1]

    def compact(self) -> int:
        """Merge tiers, smallest first, until none has fan_in shards. Each round is a job without a shuffle: a task merges one run.

        A merge whose shards another writer has merged meanwhile is dropped; the rest is planned anew.
        """
        while True:
            version, live = self.shards()
            runs, schema = self.plan(live), self.schema(version)
            if not runs:
                return version
            merged = []
            for a in range(0, len(runs), self.per_job):
                parts = [self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in run]).coalesce(1) for run in runs[a : a + self.per_job]]
                merged += self._written(reduce(DataFrame.union, parts))
            gone = {s.path for run in runs for s in run}

            def change(now: list[Shard], gone: set[str] = gone, merged: list[Shard] = merged) -> list[Shard]:
                return [s for s in now if s.path not in gone] + merged if gone <= {s.path for s in now} else now

            self._rebased(change)

    def vacuum(self, orphan_ms: int = 24 * 3_600_000) -> None:
        """Delete shards and manifests that the newest version does not name, and what dead writers left orphan_ms ago or earlier.

        Readers of older versions must be done; writers must commit within orphan_ms of their first file.
        """
        version, live = self.shards()
        fs, named = self._fs(), {s.path for s in live}
        for v in self.versions():
            if v < version:
                for s in self.shards(v)[1]:
                    if s.path not in named:
                        fs.delete(self._path(s.path), False)
                fs.delete(self._path(f"manifests/v{v:010d}.json"), False)
        until = int(time.time() * 1000) - orphan_ms
        folders = {p.rsplit("/", 1)[0] for p in named}
        for kind in ("data", "manifests"):
            for s in fs.listStatus(self._path(kind)) if fs.exists(self._path(kind)) else []:
                name = f"{kind}/{s.getPath().getName()}"
                if name not in folders and (kind == "data" or name.startswith("manifests/.")) and s.getModificationTime() <= until:
                    fs.delete(s.getPath(), True)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, with the file of each in `shard`, or in a name with underscores before it that no column has; None for an empty store."""
        version, live = self.shards(version)
        if not live:
            return None
        schema = self.schema(version)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in live])
        return rows.withColumn(fresh_names(schema.names, "shard")[0], F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def merged_schema(held: StructType, arriving: StructType) -> StructType:
    """held with the columns that arriving has besides; ValueError where types differ, or names only by case."""
    fields = {f.name.lower(): f for f in held}
    for f in arriving:
        known = fields.setdefault(f.name.lower(), StructField(f.name, f.dataType, True))
        if known.name != f.name or known.dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} {f.dataType.simpleString()} meets {known.name} {known.dataType.simpleString()}")
    return StructType(list(fields.values()))


def arrival(doc_id: Column, arrivals: int) -> Column:
    """The arrival of a document, from 0, by a digest of its id."""
    return (F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % arrivals).alias("arrival")


def shard_documents(docs: DataFrame, root: str, *, doc_id: str = "doc_id", arrivals: int = 4, target_bytes: int = 512 << 20, fan_in: int = 4) -> ShardStore:
    """Put docs into a new store at root, in arrivals chosen by a hash of doc_id, compacting after each.

    Every row arrives once, whatever its columns hold: null ids, null, empty or very long texts, repeated rows, names that
    clash. An empty table gives shards without rows.
    """
    store = ShardStore(docs.sparkSession, root, target_bytes=target_bytes, fan_in=fan_in)
    for i in range(arrivals):
        store.append(docs.where(arrival(F.col(f"`{doc_id}`"), arrivals) == i))
        store.compact()
        store.vacuum()
    return store
