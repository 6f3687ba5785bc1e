"""Choosing snapshots: by id prefix, latest~N, last N of a group, runs, group totals."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.shared import busy, join_null_safe, previous, ranged


def newest_first(*group: str):
    return Window.partitionBy(*group).orderBy(F.desc("time"), F.desc("id"))


def last_n(df: DataFrame, n: int, group: Sequence[str] = ()) -> DataFrame:
    """The n newest of each group (of all, without a group: a top-n that no single task sorts)."""
    if not group:
        return df.orderBy(F.desc("time"), F.desc("id")).limit(n)
    return df.withColumn("_n", F.row_number().over(newest_first(*group))).where(F.col("_n") <= n).drop("_n")


def latest(df: DataFrame, n: int = 0, group: Sequence[str] = ()) -> DataFrame:
    """latest~n: the n-th before the newest, of each group or of all."""
    if not group:
        return df.orderBy(F.desc("time"), F.desc("id")).offset(n).limit(1)
    return df.withColumn("_n", F.row_number().over(newest_first(*group))).where(F.col("_n") == n + 1).drop("_n")


def lookup(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Snapshots for id prefixes, 'latest' and 'latest~N', in the order asked for, repeats kept; column position.  What is not there,
    or a prefix that fits several ids, raises when the rows are read."""
    out = None
    for i, want in enumerate(wanted):
        m = re.fullmatch(r"latest(?:~(\d+))?", want)
        some = latest(df, int(m[1] or 0)) if m else df.where(F.col("id").startswith(want)).limit(2)
        row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        found = some.agg(F.count("*").alias("n"), F.first(row).alias("row"))
        error = F.raise_error(F.concat(F.when(F.col("n") == 0, "no snapshot for ").otherwise("several snapshots for "), F.lit(want)))
        found = found.select(F.when(F.col("n") == 1, F.col("row")).otherwise(error.cast(found.schema["row"].dataType)).alias("row"), F.lit(i).alias("position"))
        found = found.select("row.*", "position")
        out = found if out is None else out.unionByName(found)
    return out


def group_key(*by: str) -> list[Column]:
    """Group columns of a criterion; lists are compared as wholes."""
    return [F.array_join(b, ",").alias(b) if b in ("paths", "tags") else F.col(b) for b in by]


def group_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of each group and, with nulls as the key, of all."""
    keyed = df.select(*group_key(*by))
    if len(by) == 1:
        return keyed.rollup(*by).agg(F.count("*").alias("n"))
    return keyed.groupBy(*by).agg(F.count("*").alias("n")).unionByName(keyed.agg(F.count("*").alias("n")).select(*[F.lit(None).cast("string").alias(b) for b in by], "n"))


def by_group_and_time(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Sorted by group, then time."""
    return df.orderBy(*group_key(*group), "time", "id")


def collapse_runs(df: DataFrame, value: Column, group: Sequence[str], order: Sequence[str] = ("time", "id")) -> DataFrame:
    """Consecutive rows of a group with an equal value become the first of them and `more`, how many follow.  Where a group is too
    large for one task, rows are written once, in ranges of group and order; runs are numbered within each range and shifted by the runs of the
    ranges before."""
    if not busy(df, group):
        w = Window.partitionBy(*group).orderBy(*order)
        marked = df.withColumn("_v", value).withColumn("_last", F.lag(F.struct("_v")).over(w))
        run = marked.withColumn("_run", F.sum((F.col("_last").isNull() | ~F.col("_last._v").eqNullSafe(F.col("_v"))).cast("int")).over(w))
        return run.groupBy(*group, "_run").agg(F.min(F.struct(*order)).alias("first"), F.first("_v").alias("value"), (F.count("*") - 1).alias("more")) \
            .select(*group, *[F.col(f"first.{o}").alias(o) for o in order], "value", "more")
    by = [F.col(c) for c in (*group, *order)]
    cut = ranged(df.select(*group, *order, F.struct(F.struct(*group) if group else F.lit(0).alias("g"), value.alias("value")).alias("_own")), by)
    last = cut.groupBy("_part").agg(F.max_by("_own", F.struct(*by)).alias("_last"))
    border = last.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_border"))  # one row a partition
    w = Window.partitionBy("_part").orderBy(*by)
    marked = cut.join(F.broadcast(border), "_part").withColumn("_new", (~F.coalesce(F.lag("_own").over(w), F.col("_border")).eqNullSafe(F.col("_own"))).cast("int"))
    parts = marked.withColumn("_run", F.sum("_new").over(w)).groupBy("_part", "_run").agg(F.min(F.struct(*by)).alias("first"), F.first("_own").alias("_own"), F.count("*").alias("n"))
    shift = parts.groupBy("_part").agg(F.max("_run").alias("runs")).select("_part", F.coalesce(F.sum("runs").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    whole = parts.join(F.broadcast(shift), "_part").groupBy((F.col("_run") + F.col("before")).alias("run")).agg(F.min("first").alias("first"), F.first("_own").alias("_own"), F.sum("n").alias("n"))
    return whole.select(*[F.col(f"first.{c}").alias(c) for c in (*group, *order)], F.col("_own.value").alias("value"), (F.col("n") - 1).alias("more"))


def with_parent(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """parent: the latest strictly earlier snapshot of the same group."""
    times = df.groupBy(*group, "time").agg(F.max("id").alias("last_id"))
    before = previous(times, group, ["time"], F.col("last_id"), "_before").select(*group, "time", F.col("_before.value").alias("parent"))
    return join_null_safe(df, before, [*group, "time"])


def choose_parents(df: DataFrame, group: Sequence[str], explicit: Sequence[str] = (), force: bool = False) -> DataFrame:
    """parents: none when forced, the named snapshots (id prefixes), or the latest earlier one of the group."""
    if force:
        return df.withColumn("parents", F.array().cast("array<string>"))
    if explicit:
        named = lookup(df, explicit).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda x: x["id"]).alias("parents"))
        return df.join(named)  # one row
    return with_parent(df, group).withColumn("parents", F.array_compact(F.array("parent"))).drop("parent")
