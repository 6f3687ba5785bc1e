"""Snapshot and path predicates: every clause is one boolean Column, and clauses are AND-ed cheapest first."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions.scalars import SizeRange, after_bound, as_column, before_bound, file_name, glob_regex
from stratum.operators.select import last_n

Lists = Sequence[Sequence[str]]


def all_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def contains_lists(column, lists: Lists) -> Column:
    """Some list is contained in the array column; no list is no condition."""
    column = as_column(column)
    return any_of([F.size(F.array_except(F.array(*map(F.lit, want)), column)) == 0 if want else F.lit(True) for want in lists]) if lists else F.lit(True)


def equals_lists(column, lists: Lists) -> Column:
    column = as_column(column)
    return any_of([column == F.array(*map(F.lit, want)) for want in lists]) if lists else F.lit(True)


def in_size(column, bounds: SizeRange | str | None) -> Column:
    """A missing size passes."""
    if bounds is None:
        return F.lit(True)
    bounds = SizeRange.parse(bounds) if isinstance(bounds, str) else bounds
    column = as_column(column)
    return column.isNull() | bounds.contains(column)


@dataclass(frozen=True)
class SnapshotFilter:
    """All clauses must hold; an empty clause holds.

    `expr` is a SQL condition over the snapshot's columns and `predicate` a callable from DataFrame to Column (which may hold
    a vectorised UDF); both come last, as the dearest, and a bad one raises instead of being ignored."""

    hosts: Sequence[str] = ()
    labels: Sequence[str] = ()
    paths: Lists = ()
    paths_exact: Lists = ()
    tags: Lists = ()
    tags_exact: Lists = ()
    after: str | None = None
    before: str | None = None
    size: SizeRange | str | None = None
    size_added: SizeRange | str | None = None
    last: int | None = None
    expr: str | None = None
    predicate: Callable[[DataFrame], Column] | None = None

    def condition(self, df: DataFrame) -> Column:
        out = []
        if self.after:
            out.append(F.col("time") > F.lit(after_bound(self.after)).cast("timestamp_ntz"))
        if self.before:
            out.append(F.col("time") < F.lit(before_bound(self.before)).cast("timestamp_ntz"))
        if self.hosts:
            out.append(F.col("hostname").isin(*self.hosts))
        if self.labels:
            out.append(F.col("label").isin(*self.labels))
        if self.size:
            out.append(in_size("summary.total_bytes_processed", self.size))
        if self.size_added:
            out.append(in_size("summary.data_added", self.size_added))
        out += [contains_lists("paths", self.paths), contains_lists("tags", self.tags), equals_lists("paths", self.paths_exact), equals_lists("tags", self.tags_exact)]
        if self.expr:
            out.append(F.coalesce(F.expr(self.expr), F.lit(False)))
        if self.predicate:
            out.append(F.coalesce(self.predicate(df), F.lit(False)))
        return all_of(out)

    def apply(self, df: DataFrame, group: Sequence[str] = ()) -> DataFrame:
        df = df.where(self.condition(df))
        return df if self.last is None else last_n(df, self.last, group)


def row_predicate(fn: Callable[[dict], bool], *columns: str) -> Callable[[DataFrame], Column]:
    """A predicate from a Python function of one row (a dict of these columns), in Arrow batches.  A row that it fails on is dropped, as is
    one that it says nothing clear about; the failure is logged where it happens."""
    def build(df: DataFrame) -> Column:
        import pandas as pd

        def judge(rows):
            import logging

            def one(row: dict) -> bool:
                try:
                    return fn(row) is True
                except Exception as e:  # the row is at fault, not the query
                    logging.getLogger("stratum").warning("a filter function failed: %s", e)
                    return False

            return pd.Series([one(r) for r in rows.to_dict("records")], dtype=bool)

        judge.__annotations__ = {"rows": pd.DataFrame, "return": pd.Series}
        return F.pandas_udf(judge, "boolean")(F.struct(*columns))

    return build


def glob_matches(path, globs: Sequence[str] = (), iglobs: Sequence[str] = ()) -> Column:
    """Some glob matches the whole path or the file name."""
    path = as_column(path)
    patterns = [glob_regex(g) for g in globs] + [glob_regex(g, ignore_case=True) for g in iglobs]
    return any_of([path.rlike(p) | file_name(path).rlike(p) for p in patterns])


def not_excluded(path, globs: Sequence[str]) -> Column:
    """Exclusion lists in the ignore-file manner: '!' excludes, the last match wins, no match includes."""
    path = as_column(path)
    out = F.lit(True)
    for g in globs:
        body = g.removeprefix("!")
        out = F.when(path.rlike(glob_regex(body)) | file_name(path).rlike(glob_regex(body)), F.lit(not g.startswith("!"))).otherwise(out)
    return out


def without_marked_directories(nodes: DataFrame, marker: str) -> DataFrame:
    """Drops everything below a directory that holds a file of this name."""
    marked = nodes.where(file_name("path") == marker).select(F.regexp_replace("path", r"/[^/]*$", "").alias("dir")).distinct()
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))
    below = nodes.select("path", F.explode(up).alias("dir")).join(marked, "dir", "left_semi").select("path").distinct()
    return nodes.join(below, "path", "left_anti")


def must_keep(now) -> Column:
    """Protected from deletion at `now`."""
    return F.coalesce((F.col("delete_kind") == "never") | ((F.col("delete_kind") == "after") & (F.col("delete_after") > now)), F.lit(False))


def must_delete(now) -> Column:
    return F.coalesce((F.col("delete_kind") == "after") & (F.col("delete_after") <= now), F.lit(False))


def in_part(blob_id, part: int, parts: int) -> Column:
    """The part-th of `parts` deterministic subsets, by the id's first eight hex digits."""
    return F.pmod(F.conv(F.substring(as_column(blob_id), 1, 8), 16, 10).cast("long"), F.lit(parts)) == part - 1


def in_share(blob_id, percent: float) -> Column:
    """A deterministic subset of this percentage, by the id's first eight hex digits."""
    return F.conv(F.substring(as_column(blob_id), 1, 8), 16, 10).cast("long") < F.lit(int(percent / 100 * 2**32))


def find_nodes(nodes: DataFrame, path: str | None = None, globs: Sequence[str] = (), iglobs: Sequence[str] = ()) -> DataFrame:
    """Nodes of one exact path, or that a glob matches; both at once are refused."""
    if path is not None:
        if globs or iglobs:
            raise ValueError("a path and globs exclude each other")
        return nodes.where(F.col("path") == path)
    return nodes.where(glob_matches("path", globs, iglobs))


def named_sources(sources: DataFrame, names: Sequence[str]) -> DataFrame:
    """Configured sources of these names, all without names; an unknown name raises when the rows are read."""
    if not names:
        return sources
    wanted = sources.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
    found = wanted.join(sources.withColumn("_there", F.lit(True)), "name", "left")
    return found.where(F.when(F.col("_there"), True).otherwise(F.raise_error(F.concat(F.lit("no source named "), "name")).cast("boolean"))).drop("_there")


#: More rules than this in all ignore files are refused, as every one is a condition of the plan.
MAX_IGNORE_RULES = 2000


def ignore_rules(files: DataFrame, names: Sequence[str] = (".gitignore",), content: str = "content") -> list[tuple[str, str, bool, bool]]:
    """(directory, regular expression, include, directories only) of every line of the ignore files, outer directories first."""
    rows = files.where(file_name("path").isin(*names)).select(F.regexp_replace("path", r"/[^/]*$", "").alias("dir"), F.col(content).cast("string").alias("text")).limit(MAX_IGNORE_RULES + 1).collect()
    out = []
    for r in sorted(rows, key=lambda r: (r["dir"].count("/"), r["dir"])):
        for line in (r["text"] or "").splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            include, line = line.startswith("!"), line.removeprefix("!")
            only_dirs, line = line.endswith("/"), line.rstrip("/")
            body = line.lstrip("/") if "/" in line else f"**/{line}"
            out.append((r["dir"], glob_regex(body, cross_separator=False), include, only_dirs))
    if len(out) > MAX_IGNORE_RULES:
        raise ValueError(f"more than {MAX_IGNORE_RULES} ignore rules")
    return out


def without_ignored(nodes: DataFrame, rules: Sequence[tuple[str, str, bool, bool]]) -> DataFrame:
    """Drops what ignore files exclude: the last rule that fits a path decides, and below an excluded directory nothing is read again."""
    def ignored(path: Column, is_dir: Column) -> Column:
        out = F.lit(False)
        for folder, regex, include, only_dirs in rules:
            rest = F.substring(path, len(folder) + 2, 1 << 30)
            fits = path.startswith(folder + "/") & rest.rlike(regex) & (is_dir if only_dirs else F.lit(True))
            out = F.when(fits, F.lit(not include)).otherwise(out)
        return out

    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    inside = F.when(F.size(parts) > 2, F.exists(above, lambda a: ignored(a, F.lit(True)))).otherwise(F.lit(False))
    return nodes.where(~ignored(F.col("path"), F.col("node_type") == "dir") & ~inside)


def without_attribute(name: str) -> Column:
    """Nodes that do not carry an extended attribute of this name."""
    return ~F.coalesce(F.exists("xattrs", lambda x: x["name"] == name), F.lit(False))


def on_one_file_system(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes on the device of the root they lie below: roots(root, device)."""
    own = roots.select("root", F.col("device").alias("root_device"))
    return nodes.join(own, "root").where(F.col("device").eqNullSafe(F.col("root_device"))).drop("root_device")


def not_larger_than(limit: int) -> Column:
    return F.coalesce(F.col("size") <= limit, F.lit(True))
