"""Sharded storage with size-tiered compaction and a versioned manifest, by DataFrame operations only.

append() writes arrivals as small immutable Parquet shards.  compact() takes the live shards below the target size, puts
those of similar size (within a factor) into a tier, and rewrites runs of a tier that fit together as one file of at most
SPAN targets: each is a read partition, so no row is shuffled; merged files below the target are taken up again until no
tier can be merged.  Each change is one new manifest version, written aside
and renamed to its name, which fails if another writer took that version: then the commit alone is tried again on the
version that came between, and the data that was written stays as it is.  The rename has to be atomic, as on a
distributed file system; on an object store without such a rename two writers need a lock of their own.
A reader keeps the version it opened; superseded shards stay until vacuum(), which leaves alone what a writer has announced
as pending and not yet committed.  The manifest has one entry for each file, so target bounds its size.

Defined results: nulls, empty and long texts and extra columns are kept as they are, repeated rows are kept each; columns
that arrive later are null in earlier rows, columns that are missing are null, and one of another type is an error; ties in
size fall in one tier; an empty table gives a version without shards.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


SPAN = 1.5  # targets that runs merged into one file may have


class Conflict(RuntimeError):
    """Another writer has committed the version."""


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    size: int


def _merged_schema(stored: T.StructType, arriving: T.StructType) -> T.StructType:
    """stored with the columns that only arriving has."""
    known = {f.name: f for f in stored.fields}
    other = [f.name for f in arriving.fields if f.name in known and f.dataType != known[f.name].dataType]
    if other:
        raise ValueError(f"columns arrive with another type than the stored one: {other}")
    return T.StructType([*stored.fields, *(f for f in arriving.fields if f.name not in known)])


class ShardStore:
    """A table under `root`; target is the wished size of a file in bytes, factor the span of sizes in a tier."""

    def __init__(self, spark: SparkSession, root: str, *, target: int = 32 << 20, factor: float = 4.0, least_runs: int = 2):
        self.spark, self.root, self.target, self.factor, self.least_runs = spark, root.rstrip("/"), target, factor, least_runs
        jvm = spark.sparkContext._jvm
        self._path, self._fs_package, self._conf = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def version(self) -> int:
        """The newest committed version, 0 before any."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[1:]) for n in names if n.startswith("v")), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        return self._manifest(version)[1] if version else []

    def _manifest(self, version: int) -> tuple[T.StructType, list[Shard]]:
        stored = json.loads(self.spark.read.text(f"{self.root}/manifests/v{version:08d}", wholetext=True).first()[0])
        return T.StructType.fromJson(stored["schema"]), [Shard(**s) for s in stored["shards"]]

    def _commit(self, base: int, schema: T.StructType, shards: list[Shard]) -> int:
        """Make `shards` version base + 1 in one rename, or raise Conflict because that version exists."""
        aside, name = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}"), self._path(f"{self.root}/manifests/v{base + 1:08d}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps({"schema": schema.jsonValue(), "shards": [asdict(s) for s in sorted(shards, key=lambda s: s.path)]}).encode()))
        out.close()
        gateway = self.spark.sparkContext._gateway
        none = gateway.new_array(getattr(self._fs_package, "Options$Rename"), 0)  # without an option an existing name is an error
        try:
            self._fs_package.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else self._fs.getUri(), self._conf).rename(aside, name, none)
        except Exception as error:
            self._fs.delete(aside, False)
            if not self._fs.exists(name):
                raise
            raise Conflict(f"version {base + 1} of {self.root} was committed by another writer") from error
        return base + 1

    def _commit_on_newest(self, change: Callable[[int], tuple[T.StructType, list[Shard]]], made: list[Shard]) -> int:
        """Commit change(newest version), again on each newer version that comes between; made are shards that must be there."""
        missing = [s.path for s in made if not self._fs.exists(self._path(s.path))]
        if missing:
            raise FileNotFoundError(f"shards to be committed are gone: {missing[:3]}")
        while True:
            base = self.version()
            try:
                return self._commit(base, *change(base))
            except Conflict:
                continue

    @contextmanager
    def _pending(self) -> Iterator[str]:
        """A new data folder, announced so that vacuum() leaves it alone until it is committed or given up."""
        name = uuid.uuid4().hex
        marker = self._path(f"{self.root}/pending/{name}")
        self._fs.create(marker, False).close()
        try:
            yield f"{self.root}/data/{name}"
        finally:
            self._fs.delete(marker, False)

    def _written(self, folder: str, schema: T.StructType) -> list[Shard]:
        files = self.spark.read.schema(schema).parquet(folder).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).agg(F.count("*").alias("rows"))
        return [Shard(r["path"], r["rows"], r["size"]) for r in files.collect()]  # metadata: one row a file

    def append(self, df: DataFrame, *, arrival_rows: int = 4000) -> int:
        """Write df as new small shards and commit them."""
        with self._pending() as folder:
            df.write.option("maxRecordsPerFile", arrival_rows).parquet(folder)
            made = self._written(folder, df.schema)

            def change(base: int) -> tuple[T.StructType, list[Shard]]:
                schema, live = self._manifest(base) if base else (df.schema, [])
                return _merged_schema(schema, df.schema), live + made

            return self._commit_on_newest(change, made)

    def tiers(self, shards: list[Shard]) -> dict[int, list[Shard]]:
        """Shards below the target by the logarithm of their size."""
        found: dict[int, list[Shard]] = {}
        for s in shards:
            if s.size < self.target:
                found.setdefault(math.floor(math.log(self.target / max(s.size, 1), self.factor)), []).append(s)
        return found

    def compact(self) -> int:
        """Merge every tier of enough runs, until none is left, and commit once; the version stays if nothing was merged."""
        base = self.version()
        if not base:
            return 0
        schema, live = self._manifest(base)
        before = {s.path for s in live}
        with ExitStack() as pending:
            while (merged := self._merged(schema, live, lambda: pending.enter_context(self._pending()))) is not None:
                for s in set(live) - set(merged):
                    if s.path not in before:  # made by an earlier round, in no version
                        self._fs.delete(self._path(s.path), False)
                live = merged
            made, gone = [s for s in live if s.path not in before], before - {s.path for s in live}
            if not made:
                return base

            def change(newest: int) -> tuple[T.StructType, list[Shard]]:
                schema, now = self._manifest(newest)
                if gone - {s.path for s in now}:
                    raise RuntimeError(f"another writer has merged the same shards of {self.root} by version {newest}; nothing was changed")
                return schema, [s for s in now if s.path not in gone] + made

            return self._commit_on_newest(change, made)

    def _merged(self, schema: T.StructType, live: list[Shard], new_folder: Callable[[], str]) -> list[Shard] | None:
        """The shards after one round; None if no tier could be merged."""
        gone: set[str] = set()
        made: list[Shard] = []
        for runs in self.tiers(live).values():
            bins: list[list[Shard]] = []
            for s in sorted(runs, key=lambda s: -s.size):  # as Spark packs files into read partitions
                if not bins or sum(x.size for x in bins[-1]) + s.size > int(SPAN * self.target):
                    bins.append([])
                bins[-1].append(s)
            bins = [b for b in bins if len(b) >= self.least_runs]
            runs = [s for b in bins for s in b]
            if runs:
                folder = new_folder()
                with self._read_partitions():
                    self.spark.read.schema(schema).parquet(*[s.path for s in runs]).coalesce(len(bins)).write.parquet(folder)  # fewer files than runs, so rounds end
                made += self._written(folder, schema)
                gone.update(s.path for s in runs)
        return [s for s in live if s.path not in gone] + made if gone else None

    @contextmanager
    def _read_partitions(self) -> Iterator[None]:
        """Files are read in partitions of at most SPAN targets, whatever the session's settings."""
        wanted = {"spark.sql.files.maxPartitionBytes": str(int(SPAN * self.target)), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
        before = {k: self.spark.conf.get(k, None) for k in wanted}
        try:
            for k, v in wanted.items():
                self.spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version; None before the first."""
        version = self.version() if version is None else version
        if not version:
            return None
        schema, live = self._manifest(version)
        return self.spark.read.schema(schema).parquet(*[s.path for s in live]) if live else self.spark.createDataFrame([], schema)

    def vacuum(self, *, abandoned: float = 7 * 86_400.0) -> int:
        """Delete shards that neither the newest version holds nor a writer has pending; older versions can't be read any more.

        Files are listed first, then what is pending, then the newest version is read: a file that is in neither was not
        committed in between.  Announcements older than `abandoned` seconds are those of writers that died.
        """
        data = self._path(f"{self.root}/data")
        files = [f.getPath() for folder in (self._fs.listStatus(data) if self._fs.exists(data) else []) for f in self._fs.listStatus(folder.getPath())]
        pending = self._path(f"{self.root}/pending")
        announced = self._fs.listStatus(pending) if self._fs.exists(pending) else []
        busy = {s.getPath().getName() for s in announced if s.getModificationTime() / 1000 > time.time() - abandoned}
        kept = {s.path.rsplit("/", 1)[-1] for s in self.shards()}
        dropped = 0
        for file in files:
            if file.getName().endswith(".parquet") and file.getName() not in kept and file.getParent().getName() not in busy:
                dropped += bool(self._fs.delete(file, False))
        return dropped
