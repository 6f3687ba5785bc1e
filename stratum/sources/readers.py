"""Backup sources and repository tables as DataFrames."""

from __future__ import annotations

import logging
import re
import subprocess
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions.scalars import snapshot_argument
from stratum.operators.filters import not_excluded
from stratum.operators.select import lookup

#: The columns of a snapshot table.
SNAPSHOTS = ("id string, original string, time timestamp, hostname string, label string, tags array<string>, paths array<string>, tree string, parent string, delete_kind string, delete_after timestamp, description string, "
             "program_version string, summary struct<total_bytes_processed: long, data_added: long, files_new: long, files_changed: long, files_unmodified: long, dirs_new: long, dirs_changed: long, dirs_unmodified: long>")


def files(spark: SparkSession, *paths: str, globs: Sequence[str] = (), larger_than: int | None = None, content: bool = False) -> DataFrame:
    """Files below paths of any Hadoop file system: path (of a remote one, below the name of its store), node_type, size, mtime, and
    content when asked for."""
    if len(paths) > 1 and any(re.match(r"(?!file:)[A-Za-z0-9+.-]+://", p) for p in paths):
        raise ValueError("a remote source stands alone")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    local = F.regexp_replace("path", r"^file:(?://)?(?=/)", "")
    out = found.select(F.regexp_replace(local, r"^[A-Za-z0-9+.-]+:/*", "/").alias("path"), F.lit("file").alias("node_type"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *(["content"] if content else []))
    if globs:
        out = out.where(not_excluded("path", globs))
    return out if larger_than is None else out.where(F.col("size") <= larger_than)


def one_file(spark: SparkSession, data: bytes, name: str = "stdin") -> DataFrame:
    """Bytes read from standard input as a source of one file."""
    return spark.createDataFrame([(name, "file", len(data), bytearray(data))], "path string, node_type string, size long, content binary")


def command_output(spark: SparkSession, command: Sequence[str], name: str = "stdin") -> DataFrame:
    """A command's output as a source of one file; a failing command raises."""
    return one_file(spark, subprocess.run(command, stdout=subprocess.PIPE, check=True).stdout, name)


def scan_size(source: DataFrame) -> DataFrame:
    return source.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))


def index_entries(index_files: DataFrame) -> DataFrame:
    """Nested index files (id, packs[pack_id, time, blobs[blob_id, blob_type, length, uncompressed_length]]) as one row a blob."""
    packs = index_files.select(F.col("id").alias("index_id"), F.explode("packs").alias("p"))
    return packs.select("index_id", "p.pack_id", F.explode("p.blobs").alias("b")).select("index_id", "pack_id", "b.blob_type", "b.blob_id", "b.length", F.coalesce("b.uncompressed_length", F.lit(0)).alias("uncompressed_length"))


@dataclass
class Repository:
    """Named tables of a repository; a hot store may hold the metadata.  Tables are read when asked for, so an operation
    loads only what it needs."""

    spark: SparkSession
    uri: str
    hot_uri: str | None = None
    append_only: bool = False
    cache: bool = False
    tables: dict[str, DataFrame] = field(default_factory=dict)

    HOT = ("snapshots", "index", "trees", "keys")

    def _base(self, name: str) -> str:
        return (self.hot_uri if self.hot_uri and name in self.HOT else self.uri).rstrip("/")

    def versions(self, name: str) -> list[int]:
        """The written versions of a table, oldest first; 0 is the one without a number."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        base = jvm.org.apache.hadoop.fs.Path(self._base(name))
        fs = base.getFileSystem(conf)
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self._base(name)}/{name}*")) or []
        names = [(s.getPath().getName(), s.getPath()) for s in found]
        hit = [(int(m[1] or 0), path) for n, path in names if (m := re.fullmatch(re.escape(name) + r"(?:@(\d+))?", n))]
        return sorted(v for v, path in hit if v == 0 or fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")))

    def table(self, name: str) -> DataFrame:
        """The newest version of a table that was written to its end; kept in memory or on the executors' disks where `cache` is set."""
        if name not in self.tables:
            newest = (self.versions(name) or [0])[-1]
            found = self.spark.read.parquet(f"{self._base(name)}/{name}{f'@{newest}' if newest else ''}")
            self.tables[name] = found.cache() if self.cache else found
        return self.tables[name]

    def save(self, name: str, add: DataFrame | None = None, drop: DataFrame | None = None, key: str = "id") -> int:
        """Writes a new version of a table, with rows added and others (by key) dropped; readers see it once it is whole.  Its number."""
        if drop is not None and self.append_only:
            raise PermissionError("the repository is append-only")
        out = self.table(name)
        if drop is not None:
            out = out.join(drop.select(key).distinct(), key, "left_anti")
        if add is not None:
            out = out.unionByName(add, allowMissingColumns=True)
        number = (self.versions(name) or [0])[-1] + 1
        out.select(*self.table(name).columns).write.parquet(f"{self._base(name)}/{name}@{number}")
        if self.cache:
            self.tables[name].unpersist()
        self.tables.pop(name, None)
        return number

    def guard(self, operation: str) -> None:
        """An append-only repository refuses to forget, prune or change its configuration."""
        if self.append_only and operation in ("forget", "prune", "config"):
            raise PermissionError(f"the repository is append-only: no {operation}")

    def init(self, config: dict[str, str], keys: DataFrame | None = None, hot_only: bool = False) -> None:
        """Creates the configuration (and keys) of a new repository; hot_only fills a new hot store beside a store that is there."""
        schema = "name string, value string"
        if hot_only:
            if not self.hot_uri:
                raise ValueError("no hot store is named")
            cold = Repository(self.spark, self.uri)
            for name in ("config", *self.HOT):
                if name == "config" or cold.versions(name):
                    cold.table(name).write.parquet(f"{self.hot_uri.rstrip('/')}/{name}")
            return
        if self.versions("config"):
            raise ValueError("there is a repository already")
        self.spark.createDataFrame(sorted(config.items()), schema).write.parquet(f"{self._base('config')}/config")
        if keys is not None:
            keys.write.parquet(f"{self._base('keys')}/keys")

    def config(self) -> dict[str, str]:
        return {r["name"]: r["value"] for r in self.table("config").collect()}

    def change_config(self, **changes: str) -> bool:
        """Writes changed values as a new version; False where nothing changes."""
        self.guard("config")
        old = self.config()
        if all(old.get(k) == v for k, v in changes.items()):
            return False
        rows = self.spark.createDataFrame(sorted(changes.items()), "name string, value string")
        self.save("config", rows, rows.select("name"), key="name")
        return True

    def remove_keys(self, ids: Sequence[str], used: str) -> int:
        """Drops keys; the one in use is refused."""
        if used in ids:
            raise PermissionError("this key is in use")
        return self.save("keys", drop=self.spark.createDataFrame([(i,) for i in ids], "id string"))

    def ids(self, name: str) -> DataFrame:
        return self.table(name).select("id")

    def snapshots(self, *wanted: str) -> DataFrame:
        return lookup(self.table("snapshots"), wanted) if wanted else self.table("snapshots")

    def row(self, name: str, id_prefix: str) -> DataFrame:
        """One object as JSON."""
        found = self.table(name)
        return found.where(F.col("id").startswith(id_prefix)).select(F.to_json(F.struct(*found.columns)).alias("json"))

    def write(self, name: str, df: DataFrame, mode: str = "append") -> None:
        if self.append_only and mode != "append":
            raise PermissionError("the repository is append-only")
        df.write.mode(mode).parquet(f"{self.uri.rstrip('/')}/{name}")
        self.tables.pop(name, None)


def json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Small JSON objects, one a file (keys, snapshots), as they are in a repository; unreadable ones are skipped, and logged."""
    found = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(f"{schema}, _bad string").json(path).withColumn("_file", F.input_file_name()).cache()
    for r in found.where("_bad is not null").select("_file").limit(20).collect():
        logging.getLogger("stratum").warning("skipped %s: it cannot be read", r["_file"])
    return found.where("_bad is null").drop("_bad", "_file")


def node_at(snapshots: DataFrame, nodes: DataFrame, argument: str) -> DataFrame:
    """The node of SNAPSHOT[:PATH] among nodes(snapshot_id, path, ...); without a path, the root's nodes.  What is not there raises when read."""
    wanted, path = snapshot_argument(argument)
    if wanted is None:
        raise ValueError(f"no snapshot in {argument!r}")
    own = lookup(snapshots, [wanted]).select(F.col("id").alias("snapshot_id"))
    path = "/" + path.strip("/") if path.strip("/") else ""
    inside = nodes.join(own, "snapshot_id")
    if not path:
        return inside
    row = F.struct(*[F.col(c) for c in inside.columns])
    one = inside.where(F.col("path") == path).limit(1).agg(F.first(row).alias("row"))
    return one.select(F.coalesce("row", F.raise_error(F.lit(f"no node {path}")).cast(one.schema["row"].dataType)).alias("row")).select("row.*")


def raw_object(spark: SparkSession, uri: str, kind: str, id_prefix: str = "") -> DataFrame:
    """The bytes of a stored file (config, index, snapshot, key or pack): id, content."""
    pattern = f"{uri.rstrip('/')}/config" if kind == "config" else f"{uri.rstrip('/')}/{kind}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern)
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("id"), "content").where(F.col("id").startswith(id_prefix))


def inventory(spark: SparkSession, uri: str, tier: str = "cold") -> DataFrame:
    """Files of a repository by kind (the folder below its root), with sizes; contents are not read."""
    root = uri.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return found.select(F.regexp_extract("path", r"([^/]+)/(?:[^/]{2}/)?[^/]+$", 1).alias("file_type"), F.regexp_extract("path", r"([^/]+)$", 1).alias("id"), F.col("length").alias("size"), F.lit(tier).alias("tier"))


def register_walk(spark: SparkSession) -> None:
    """A data source 'stratum_walk' for local trees with all metadata, one partition for each entry of the root:
    spark.read.format("stratum_walk").load(path)."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Part(InputPartition):
        pass

    class Reader(DataSourceReader):
        def __init__(self, root):
            self.root = root

        def partitions(self):
            import os

            return [Part(e.path) for e in sorted(os.scandir(self.root), key=lambda e: e.name)] or [Part(None)]

        def read(self, partition):
            import os
            import stat

            kinds = ((stat.S_ISDIR, "dir"), (stat.S_ISLNK, "symlink"), (stat.S_ISBLK, "dev"), (stat.S_ISCHR, "chardev"), (stat.S_ISFIFO, "fifo"), (stat.S_ISSOCK, "socket"))
            todo = [partition.value] if partition.value else []
            while todo:
                path = todo.pop()
                s = os.lstat(path)
                kind = next((k for test, k in kinds if test(s.st_mode)), "file")
                yield path, kind, os.readlink(path) if kind == "symlink" else None, s.st_size, stat.S_IMODE(s.st_mode), s.st_uid, s.st_gid, s.st_mtime, s.st_nlink, s.st_dev, s.st_ino
                if kind == "dir":
                    todo += [e.path for e in os.scandir(path)]

    class Walk(DataSource):
        @classmethod
        def name(cls):
            return "stratum_walk"

        def schema(self):
            return "path string, node_type string, link_target string, size bigint, mode int, uid bigint, gid bigint, mtime double, links bigint, device bigint, inode bigint"

        def reader(self, schema):
            return Reader(self.options["path"])

    spark.dataSource.register(Walk)
