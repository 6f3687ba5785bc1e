"""Materialising in the folder that all executors share, and orders that no single task has to hold."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder of our own only where it is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="stratum-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Writes df there as Parquet and reads it again: the lineage is cut, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/stratum-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = df.sparkSession
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for path, spark in list(_written.items()):
        try:
            if spark.sparkContext._jsc is not None:
                target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone; the folder is then the cluster's to clean
            pass
        _written.pop(path, None)


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join in which a missing key equals a missing key."""
    if not on:
        return left.join(right, how=how)
    other = right.select(*[F.col(c).alias(f"_right_{c}") if c in on else F.col(c) for c in right.columns])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_right_{c}"))
    return left.join(other, same, how).drop(*[f"_right_{c}" for c in on])


def ranged(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """df written in ranges of an order, with _part, the number of its range: the ranges follow each other."""
    return materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def running_total(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """The running sum of `value` in a total order, without one task that sorts all: rows are range-partitioned, summed
    within each range, and shifted by the totals of the ranges before (one row a partition)."""
    cut = ranged(df, order)
    own = cut.withColumn("_own", F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = cut.groupBy("_part").agg(F.sum(value).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    return own.join(F.broadcast(shift), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


#: Rows of one group that one task may hold for a window; beyond that the same is done over ranges.
LARGE = 1_000_000


def busy(df: DataFrame, group: Sequence[str]) -> bool:
    """Whether some group has more rows than one task shall hold."""
    return (df.groupBy(*group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > LARGE


def previous(df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """df with `name`: struct(value) of the row before in the same group, null at a group's first row.  A busy group is no single
    task: rows are range-partitioned by group and order then, and each range's first row takes the last of the ranges before."""
    if not busy(df, group):
        return df.withColumn(name, F.lag(F.struct(value.alias("value"))).over(Window.partitionBy(*group).orderBy(*order)))
    by = [F.col(c) for c in (*group, *order)]
    cut = ranged(df.withColumn("_value", F.struct(value.alias("value"))).withColumn("_group", F.struct(*group) if group else F.struct(F.lit(0))), by)
    w = Window.partitionBy("_part").orderBy(*by)
    last = cut.groupBy("_part").agg(F.max_by(F.struct("_group", "_value"), F.struct(*by)).alias("_last"))
    last = last.withColumn("_border", F.lag("_last").over(Window.orderBy("_part"))).select("_part", "_border")  # one row a partition
    here = cut.join(F.broadcast(last), "_part").withColumn("_row_before", F.coalesce(F.lag(F.struct("_group", "_value")).over(w), F.col("_border")))
    return here.withColumn(name, F.when(F.col("_row_before._group").eqNullSafe(F.col("_group")), F.col("_row_before._value"))).drop("_part", "_value", "_group", "_border", "_row_before")
