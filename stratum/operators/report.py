"""Reports: totals with a Total row, listings, virtual paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions.scalars import human_size, link_string, listing_time, mode_string, or_unknown, short_id
from stratum.shared import join_null_safe, previous


def with_total(df: DataFrame, key: str, aggregates: list[Column]) -> DataFrame:
    """One row a key and a row 'Total': a one-column rollup."""
    out = df.rollup(key).agg(F.grouping(key).alias("_all"), *aggregates)
    return out.withColumn(key, F.when(F.col("_all") == 1, "Total").otherwise(F.col(key))).drop("_all")


def snapshot_listing(df: DataFrame, *more: Column) -> DataFrame:
    """The rows of a snapshot table: id (with how many alike follow, where a column `more` tells), time, host, label, tags, paths, files, dirs
    and size; question marks where there is no summary."""
    short = short_id("id")
    name = F.when(F.col("more") > 0, F.concat(short, F.lit(" (+"), F.col("more"), F.lit(")"))).otherwise(short) if "more" in df.columns else short
    return df.select(name.alias("id"), F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"), "hostname", "label", F.array_join("tags", "\n").alias("tags"), F.array_join("paths", "\n").alias("paths"),
                     or_unknown(F.col("summary.total_files_processed")).alias("files"), or_unknown(F.col("summary.total_dirs_processed")).alias("dirs"), or_unknown(human_size("summary.total_bytes_processed")).alias("size"), *more)


def node_listing(nodes: DataFrame) -> DataFrame:
    """Long rows of nodes: mode, user and group (their numbers where they have no name), size, mtime, path and link."""
    def either(name: str, number: str) -> Column:
        held = [F.col(c).cast("string") for c in (name, number) if c in nodes.columns]
        return F.coalesce(*held, F.lit("?"))

    mtime = listing_time(F.col("mtime").cast("timestamp")) if "mtime" in nodes.columns else F.lit("?")
    return nodes.select("path", mode_string("node_type", F.col("mode").cast("int")).alias("mode"), either("user", "uid").alias("user"), either("group", "gid").alias("group"), or_unknown(F.col("size")).alias("size"),
                        F.coalesce(mtime, F.lit("?")).alias("mtime"), link_string("node_type", "link_target").alias("link"))


def key_listing(keys: DataFrame, used: str | None = None) -> DataFrame:
    """Keys, the one in use marked by *."""
    mine = F.col("id") == F.lit(used) if used else F.lit(False)
    return keys.select(F.when(mine, F.concat(F.lit("*"), "id")).otherwise(F.col("id")).alias("id"), *[c for c in keys.columns if c != "id"])


def snapshot_views(df: DataFrame, marked: Column, modified: Column, matching: Column) -> DataFrame:
    """df with view, the narrowest of the views that show a snapshot: marked, modified, filter, all."""
    return df.withColumn("view", F.when(marked, "marked").when(modified, "modified").when(matching, "filter").otherwise("all"))


def group_flags(df: DataFrame, group: list[str], flags: dict[str, Column], common: list[str], counts: dict[str, Column] | None = None, longest: dict[str, str] | None = None) -> DataFrame:
    """For each group: whether any row has a flag, how many meet a condition, the common value of columns ('' where they differ), and the
    most entries of list columns."""
    out = [F.bool_or(c).alias(n) for n, c in flags.items()] + [F.count_if(c).alias(n) for n, c in (counts or {}).items()]
    out += [F.when(F.min(c) == F.max(c), F.min(c)).otherwise("").alias(f"common_{c}") for c in common]
    return df.groupBy(*group).agg(*out, *[F.max(F.size(c)).alias(n) for n, c in (longest or {}).items()])


def virtual_path(template: str, time_format: str = "yyyy-MM-dd_HH-mm-ss") -> Column:
    """A path from a template with {id} {id_long} {time} {username} {hostname} {label} {tags} {backup_start} {backup_end}; [...] around a name
    is dropped; parts that are empty vanish.  An unknown name raises."""
    time = lambda c: F.date_format(c, time_format)
    values = {"id": lambda: short_id("id"), "id_long": lambda: F.col("id"), "time": lambda: time("time"), "username": lambda: F.col("username"), "hostname": lambda: F.col("hostname"), "label": lambda: F.col("label"),
              "tags": lambda: F.array_join("tags", ","), "backup_start": lambda: time("summary.backup_start"), "backup_end": lambda: time("summary.backup_end")}
    out: Column = F.lit("")
    for part in re.split(r"(\[?\{\w+\}\]?)", template):
        name = part.strip("[]").strip("{}")
        if part.strip("[]").startswith("{"):
            if name not in values:
                raise ValueError(f"no such part of a path: {name}")
            out = F.concat(out, F.coalesce(values[name](), F.lit("")))
        else:
            out = F.concat(out, F.lit(part))
    return F.regexp_replace(out, "/+", "/")


def marked_paths(df: DataFrame, template: str, group: list[str]) -> DataFrame:
    """df with path, latest (the newest of its group) and identical (the one before it has the same tree): these two become links."""
    newest = df.groupBy(*group).agg(F.max(F.struct("time", "id"))["id"].alias("_newest"))
    out = previous(df, group, ("time", "id"), F.col("tree"), "_prior").withColumn("path", virtual_path(template))
    out = out.withColumn("identical", F.coalesce(F.col("_prior.value") == F.col("tree"), F.lit(False)))
    return join_null_safe(out, newest, group).withColumn("latest", F.col("id") == F.col("_newest")).drop("_prior", "_newest")
