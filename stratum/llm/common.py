"""Shared helpers: reading tables, shared-folder materialisation, skew-safe components."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: So many edges at most are joined in one task.
FEW_EDGES = 1 << 18
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Setting, its defaults, and our bound.
_BATCH = (("spark.sql.execution.arrow.maxRecordsPerBatch", ("10000",), "500"), ("spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64MB"), "4194304b"))
_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; documents that come in no more splits than there are cores (one row group may hold them all) are dealt out
    over the cores first, since work on texts is dear.  Larger inputs are read as they lie, without a shuffle."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() <= cores else df


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder of our own only where it is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="stratum-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _written.pop(path, None)


@atexit.register
def _clean() -> None:
    for path, spark in list(_written.items()):
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # the session may be gone; the folder is then the cluster's to clean
            _written.pop(path, None)


def materialize(df: DataFrame, *replaces: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again, which cuts lineage and
    survives the loss of any executor.  Tables in `replaces` made by this function are deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stratum-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._stratum_path = path
    for old in replaces:
        forget(old)
    return out


def forget(df: DataFrame) -> None:
    if path := getattr(df, "_stratum_path", None):
        delete(df.sparkSession, path)


def settle(make: Callable[[], DataFrame], *replaces: DataFrame) -> DataFrame:
    """Materialises make()'s table and deletes every table that was written on the way to it, and those it replaces."""
    before = set(_written)
    out = materialize(make(), *replaces)
    for path in set(_written) - before - {out._stratum_path}:
        delete(out.sparkSession, path)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else.  lower() is the same on pure ASCII and much faster."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def row_key(key: str, text: str) -> Column:
    """Names a row by its id and text, null-safe; rows that agree in both are one document."""
    name = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("null"))
    return F.concat_ws(":", name, F.hex(F.xxhash64(F.col(text))), F.octet_length(F.col(text)))


def named(df: DataFrame, columns, *rest: str) -> DataFrame:
    """Columns k0, k1, ... under their own names again, in one step, so that no name can clash on the way."""
    return df.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(columns)], *rest)


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(rk, row): each row's key beside all its columns, out of reach of any name."""
    return df.select(row_key(key, text).alias("rk"), F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(df.columns)]).alias("row"))


def unkeyed(df: DataFrame, columns) -> DataFrame:
    return df.select(*[F.col(f"row.k{i}").alias(c) for i, c in enumerate(columns)])


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a context, so that their Python workers can import it
    wherever the driver found it."""
    context = spark.sparkContext
    if getattr(context, "_stratum_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="stratum-"), "stratum-package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    z.write(full := os.path.join(folder, name), os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    context._stratum_shipped = True


def blocks_of(texts: list[str], size: int) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about `size` characters (a longer text is a run), so that memory follows the longest text, not the
    batch; each with the number of its first text."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield start, texts[start:i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


@functools.cache
def _trim() -> Callable:
    """glibc's malloc_trim; where the C library has none, nothing is done."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda pad: 0


def give_back() -> None:
    """Returns to the system what the allocators hold but nothing uses, which else stays with an idle worker through all later stages."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def arrow_map(df: DataFrame, make: Callable, schema: str, calm: bool = False) -> DataFrame:
    """mapInArrow over batches bounded by rows and bytes (by the session's own settings, where it has any): `make()` is called once
    a task and returns a function from a RecordBatch to a RecordBatch (or None).  calm: the task keeps large caches of small objects without cycles, which the
    collector need not scan all the time; workers are used again, so at the end `close` drops them and its settings are put back, and
    every task gives back the memory that it no longer uses, a calm one after every batch."""
    spark = df.sparkSession
    ship(spark)
    for name, usual, bound in _BATCH:
        if spark.conf.get(name) in usual:
            spark.conf.set(name, bound)

    def run(batches):
        apply, limits, batch, out = make(), gc.get_threshold(), None, None
        if calm:
            gc.set_threshold(100_000, 20, 50)
        try:
            for batch in batches:
                if batch.num_rows and (out := apply(batch)) is not None:
                    yield out
                if calm:  # while a batch is awaited, only the caches are held
                    batch = out = None
                    give_back()
        finally:
            if calm:
                getattr(apply, "close", lambda: None)()  # idle workers shall not hold caches
                gc.set_threshold(*limits)
                gc.collect()
            apply = batch = out = None
            give_back()

    return df.mapInArrow(run, schema)


def shuffled(df: DataFrame) -> DataFrame:
    """For a side of a join that grows with the input: joined by shuffles however small its files are, so it is never held by the driver."""
    return df.hint("merge")


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges -> every end that is not the smallest of its component, and that smallest one."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = at[:len(a)], at[len(a):]
    label = np.arange(len(ids))
    while True:
        la, lb = label[one], label[two]
        on = np.flatnonzero(la != lb)
        if not len(on):
            break
        one, two = la[on], lb[on]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while (label[label] != label).any():
            label = label[label]
    low = np.flatnonzero(label != np.arange(len(ids)))
    return ids[low], ids[label[low]]


def _few_roots(links: DataFrame) -> DataFrame:
    """links(a, b) of long ids, FEW_EDGES at most -> (a, to), found in one task."""
    ship(links.sparkSession)

    def run(batches):
        held = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
        if held:
            a, to = roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.record_batch({"a": pa.array(a), "to": pa.array(to)})

    return links.coalesce(1).mapInArrow(run, "a long, to long")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components: (id, component), component = the smallest id reachable, for every row of
    `nodes(id)`; `edges(a, b)` are undirected.  In each round every end of an edge goes to its smallest neighbour below it, chains of
    these are followed to their ends by pointer jumping, and the edges are contracted to what still joins different ends; so a star is
    gone after one round, and rounds are O(log n).  Each round is written to the shared folder.  Once FEW_EDGES or fewer are left (of long ids),
    one task joins them all, so the driver plans a few steps, not dozens.

    A hub's edges are aggregated partially before the shuffle, and the joins read both sides from
    written tables, so adaptive execution can split a hub's partition.
    """
    links = materialize(edges.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct())
    left, wide = links.count(), links.schema["a"].dataType.simpleString() == links.schema["b"].dataType.simpleString() == "bigint"
    if not left:
        forget(links)
        return nodes.select("id", F.col("id").alias("component"))
    labels = None
    while left:
        few = wide and left <= FEW_EDGES
        parent = materialize(_few_roots(links) if few else links.groupBy("a").agg(F.min("b").alias("to")))  # always downwards, so there is no cycle
        while not few:
            up = parent.select(F.col("a").alias("to"), F.col("to").alias("further"))
            jumped = materialize(parent.join(shuffled(up), "to", "left").select("a", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
            going = not jumped.where("moved").isEmpty()
            parent = materialize(jumped.drop("moved"), jumped, parent) if going else parent
            if not going:
                forget(jumped)
                break
        if few:
            forget(links)
            left = 0
        else:
            here = links.join(shuffled(parent.select("a", F.col("to").alias("ra"))), "a").join(shuffled(parent.select(F.col("a").alias("b"), F.col("to").alias("rb"))), "b", "left").select("ra", F.coalesce("rb", "b").alias("rb"))
            links = materialize(here.where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), links)
            left = links.count()
        found = parent.select(F.col("a").alias("id"), F.col("to").alias("component"))
        if labels is None:
            labels = parent = materialize(found, parent)
        else:  # what was known moves on with its label; what has a label now for the first time is added
            moved = labels.join(shuffled(parent.select(F.col("a").alias("component"), F.col("to").alias("root"))), "component", "left").select("id", F.coalesce("root", "component").alias("component"))
            labels = materialize(moved.unionByName(found.join(shuffled(labels.select("id")), "id", "left_anti")), labels, parent)
    forget(links)
    return nodes.join(shuffled(labels), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
