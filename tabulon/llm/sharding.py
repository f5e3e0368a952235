"""Shards with size-tiered compaction and a versioned manifest.

    <root>/data/<write>/part-*.parquet   immutable shards; a manifest names those that are live
    <root>/manifest/v<number>.json       one file a version, never changed

Arrivals are written as they come, as small shards. Shards of similar size (the same tier: powers of
`fanout` above `least_bytes`) form a run; a tier that holds `fanout` of them or more is merged into files
of about `target_bytes`: shards are put together until the target is reached, and each group is read
and written by one task, without a shuffle, whatever the table's size. Shards at half the target or more
rest. A merge counts rows of what it read and wrote and commits only if they agree.

A commit writes its change (shards added and dropped) to a temporary file and renames it to the next version's
name, which fails if another writer was faster; then the commit is tried again on the newer version. Once the
changes since the last whole list outnumber the live shards, or after `chain` of them, a version holds the whole
list, so commits cost about what they change and a reader opens at most `chain` files. Readers open the newest
version and see all of a commit or nothing. Data files of lost attempts are in no manifest.
`vacuum` deletes files that only older versions name.

Defined results: nulls, empty texts, repeated rows and columns of any name are stored as they are; an
empty arrival commits a version with no new shard; an empty table reads as empty with its schema.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fresh


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int
    tier: int


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    shards: tuple[Shard, ...]
    since: int = 0  # shards added and dropped since the last whole list
    links: int = 0  # versions since then


@dataclass(frozen=True)
class Tiers:
    target_bytes: int = 128 << 20
    least_bytes: int = 1 << 20
    fanout: int = 4
    groups_a_job: int = 64
    chain: int = 64

    def tier(self, size: int) -> int:
        t, edge = 0, self.least_bytes
        while size >= edge and edge < self.target_bytes:
            t, edge = t + 1, edge * self.fanout
        return t


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class ShardTable:
    def __init__(self, spark: SparkSession, root: str, tiers: Tiers = Tiers()):
        self.spark, self.root, self.tiers = spark, root.rstrip("/"), tiers
        self._seen: Manifest | None = None  # the newest version read; versions never change
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._prefix = f"{self._path(self.root).makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory()).toString()}/"
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory()).toUri(), self._conf)

    # --- manifest ---

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def load(self, version: int | None = None) -> Manifest | None:
        known = self.versions()
        if not known:
            return None
        at = version = known[-1] if version is None else version
        changes, base = [], None
        while base is None:
            if self._seen and self._seen.version == at:
                base = self._seen
                break
            m = self._read(at)
            if "shards" in m:
                base = Manifest(at, m["schema"], tuple(Shard(**s) for s in m["shards"]))
            else:
                changes.append(m)
                at -= 1
        live, since = {s.path: s for s in base.shards}, base.since
        for m in reversed(changes):
            for path in m["drop"]:
                del live[path]
            live |= {s["path"]: Shard(**s) for s in m["add"]}
            since += len(m["add"]) + len(m["drop"])
        out = Manifest(version, changes[0]["schema"] if changes else base.schema, tuple(live.values()), since, base.links + len(changes))
        if self._seen is None or version > self._seen.version:
            self._seen = out
        return out

    def _read(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/manifest/v{version:010d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, m: Manifest, change: dict | None = None) -> None:
        """Version m as a change to the one before, or whole."""
        held = change if change is not None else {"shards": [asdict(s) for s in m.shards]}
        text = json.dumps({"version": m.version, "schema": m.schema, **held})
        temporary = self._path(f"{self.root}/manifest/.tmp-{uuid.uuid4().hex}")
        out = self._fs.create(temporary, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        none = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        try:
            self._context.rename(temporary, self._path(f"{self.root}/manifest/v{m.version:010d}.json"), options)
        except Exception as e:
            self._fs.delete(temporary, False)
            raise Conflict(f"version {m.version} exists") from e

    def commit(self, add: list[Shard], drop: set[str] = frozenset(), schema: str | None = None, tries: int = 10) -> Manifest:
        """Next version: the newest one without `drop`, with `add`. A merge whose input is gone fails."""
        for _ in range(tries):
            old = self.load()
            live = old.shards if old else ()
            if drop - {s.path for s in live}:
                raise Conflict("shards to be replaced are no longer live")
            version, schema = (old.version if old else 0) + 1, old.schema if old else schema or ""
            shards = (*(s for s in live if s.path not in drop), *add)
            since, links = (old.since + len(add) + len(drop), old.links + 1) if old else (0, 0)
            whole = old is None or since >= max(len(live), 1) or links >= self.tiers.chain
            new = Manifest(version, schema, shards) if whole else Manifest(version, schema, shards, since, links)
            try:
                self._publish(new, None if whole else {"add": [asdict(s) for s in add], "drop": sorted(drop)})
                return new
            except Conflict:
                continue
        raise Conflict(f"no commit in {tries} tries")

    # --- data ---

    def _files(self, folder: str) -> list[tuple[str, int]]:
        """Path below the root and size of each data file."""
        out, it = [], self._fs.listFiles(self._path(folder), True)
        while it.hasNext():
            s = it.next()
            if s.getPath().getName().startswith("part-"):
                out.append((s.getPath().toString().removeprefix(self._prefix), s.getLen()))
        return sorted(out)

    def _counts(self, folder: str, schema: StructType) -> dict[str, int]:
        """Rows by file name (from footers)."""
        df = self.spark.read.schema(schema).parquet(folder).select(F.col("_metadata.file_path").alias("p"))
        return {r[0].rpartition("/")[2]: r[1] for r in df.groupBy("p").count().toLocalIterator()}

    def _shards(self, name: str, schema: StructType) -> list[Shard]:
        folder = f"{self.root}/data/{name}"
        counts = self._counts(folder, schema)
        return [Shard(p, n, counts[f], self.tiers.tier(n)) for p, n in self._files(folder) if (f := p.rpartition("/")[2]) in counts]

    def append(self, df: DataFrame) -> Manifest:
        """One arrival: its partitions become shards, then one commit."""
        name = uuid.uuid4().hex
        df.write.option("compression", "zstd").parquet(f"{self.root}/data/{name}")
        return self.commit(self._shards(name, df.schema), schema=df.schema.json())

    def append_arrivals(self, df: DataFrame, arrival: str) -> list[Manifest]:
        """Arrivals that a column numbers or names, written in one pass; a commit for each value, in order.

        Nothing is committed unless the files found hold as many rows as were written.
        """
        name = uuid.uuid4().hex
        folder = f"{self.root}/data/{name}"
        seen, value = Observation(), fresh(df, "arrival_value")
        df.withColumn(value, F.col(f"`{arrival}`")).observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy(value).option("compression", "zstd").parquet(folder)
        by: dict[str, list[Shard]] = {}
        counts = self._counts_by_path(folder, df.schema)
        for p, n in self._files(folder):
            value, file = p.split("/")[-2:]
            if f"{value}/{file}" not in counts:
                raise RuntimeError(f"no row count of {p}")
            by.setdefault(value, []).append(Shard(p, n, counts[f"{value}/{file}"], self.tiers.tier(n)))
        written, found = seen.get["rows"], sum(s.rows for v in by.values() for s in v)
        if written != found:
            raise RuntimeError(f"arrivals of {written} rows gave files of {found}")
        order = sorted(by, key=lambda v: (len(v), v))
        return [self.commit(by[v], schema=df.schema.json()) for v in order] or [self.commit([], schema=df.schema.json())]

    def _counts_by_path(self, folder: str, schema: StructType) -> dict[str, int]:
        """Rows by folder and file name, as `_files` gives them: _metadata.file_path is URL-encoded."""
        df = self.spark.read.schema(schema).parquet(folder).select(F.col("_metadata.file_path").alias("p"))
        return {unquote("/".join(r[0].split("/")[-2:])): r[1] for r in df.groupBy("p").count().toLocalIterator()}

    def groups(self, m: Manifest) -> list[list[Shard]]:
        """Runs to merge: within a tier, shards put together up to the target."""
        out = []
        for tier in sorted({s.tier for s in m.shards}):
            run = sorted((s for s in m.shards if s.tier == tier and s.bytes * 2 < self.tiers.target_bytes), key=lambda s: (-s.bytes, s.path))
            if len(run) < self.tiers.fanout:
                continue
            group, size = [], 0
            for s in run:
                if group and size + s.bytes > self.tiers.target_bytes:
                    out.append(group)
                    group, size = [], 0
                group.append(s)
                size += s.bytes
            out.append(group)
        return [g for g in out if len(g) > 1]

    def compact(self, most_rounds: int = 20) -> Manifest | None:
        """Merge until no tier holds a full run; a commit for each batch of groups."""
        for _ in range(most_rounds):
            m = self.load()
            todo = self.groups(m) if m else []
            if not todo:
                return m
            for i in range(0, len(todo), self.tiers.groups_a_job):
                self._merge(todo[i : i + self.tiers.groups_a_job], m)
        return self.load()

    def _merge(self, groups: list[list[Shard]], m: Manifest) -> Manifest:
        schema = StructType.fromJson(json.loads(m.schema))
        parts = [self.spark.read.schema(schema).parquet(*(f"{self.root}/{s.path}" for s in g)).coalesce(1) for g in groups]
        name = uuid.uuid4().hex
        tables = parts[0]
        for p in parts[1:]:
            tables = tables.union(p)
        # one task a group: a union of one-partition frames must not be read as one partition
        key = "spark.sql.unionOutputPartitioning"
        was = self.spark.conf.get(key, "true")
        self.spark.conf.set(key, "false")
        try:
            tables.write.option("compression", "zstd").parquet(f"{self.root}/data/{name}")
        finally:
            self.spark.conf.set(key, was)
        new = self._shards(name, schema)
        before, after = sum(s.rows for g in groups for s in g), sum(s.rows for s in new)
        if before != after:
            raise RuntimeError(f"merge read {before} rows and wrote {after}")
        return self.commit(new, {s.path for g in groups for s in g})

    def vacuum(self, keep: int = 1) -> int:
        """Delete data files that none of the newest `keep` versions names."""
        live = {s.path for v in self.versions()[-keep:] for s in self.load(v).shards}
        gone = [p for p, _ in self._files(f"{self.root}/data") if p not in live]
        for p in gone:
            self._fs.delete(self._path(f"{self.root}/{p}"), False)
        return len(gone)

    def read(self, version: int | None = None) -> DataFrame:
        m = self.load(version)
        if m is None:
            raise FileNotFoundError(f"no version at {self.root}")
        schema = StructType.fromJson(json.loads(m.schema))
        if not m.shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{s.path}" for s in m.shards))


__all__ = ["Conflict", "Manifest", "Shard", "ShardTable", "Tiers"]
