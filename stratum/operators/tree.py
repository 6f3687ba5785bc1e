"""Trees: listings, roll-ups over directories, descendant counts, identities without metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.operators.filters import not_excluded
from stratum.shared import materialize


def ancestors(path="path") -> Column:
    """All proper ancestors of an absolute path, the root as ''."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def listing_summary(nodes: DataFrame) -> DataFrame:
    """dirs, files (all that is no directory), size (of regular files)."""
    return nodes.agg(F.count_if(F.col("node_type") == "dir").alias("dirs"), F.count_if(F.col("node_type") != "dir").alias("files"),
                     F.coalesce(F.sum(F.when(F.col("node_type") == "file", F.col("size"))), F.lit(0)).alias("size"))


def roll_up(nodes: DataFrame) -> DataFrame:
    """files, size and dirs (itself and all below that nodes name) of each directory, once for every occurrence; partial sums run before the shuffle."""
    is_dir = F.col("node_type") == "dir"
    up = F.when(is_dir, F.array_append(ancestors(), F.col("path"))).otherwise(ancestors())
    return nodes.select(F.explode(up).alias("dir"), is_dir.alias("is_dir"), F.when(F.col("node_type") == "file", F.col("size")).alias("size")) \
        .groupBy("dir").agg(F.count_if(~F.col("is_dir")).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count_if("is_dir").alias("dirs"))


def descendants(nodes: DataFrame) -> DataFrame:
    """Distinct paths below each directory, implied directories included."""
    paths = nodes.select(F.explode(F.array_union(F.array("path"), F.filter(ancestors(), lambda a: a != ""))).alias("path")).distinct()
    return paths.select(F.explode(ancestors()).alias("dir")).groupBy("dir").agg(F.count("*").alias("n"))


def identities(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """(dir, id): a bottom-up hash of each directory's names, types, contents and child hashes, blind to metadata.

    `depth` is the greatest number of path parts, taken from the data where it is not given; one aggregation for each level.  A directory's
    entries are hashed in 256 parts by their names, and then the parts' hashes, so that a flat one is no single row of all its entries."""
    level = lambda path: F.size(F.split(path, "/")) - 1
    entry = nodes.where("node_type <> 'dir'").select("path", F.concat_ws("|", F.col("node_type"), F.coalesce("content", F.lit(""))).alias("entry"), level(F.col("path")).alias("depth"))
    if depth is None:
        depth = entry.agg(F.max("depth")).first()[0] or 0
    else:
        entry = entry.withColumn("depth", F.when(F.col("depth") <= depth, F.col("depth")).otherwise(F.raise_error(F.concat(F.lit("deeper than told: "), "path")).cast("int")))
    found = None
    for d in range(depth, 0, -1):
        name = F.regexp_extract("path", "([^/]*)$", 1)
        here = entry.where(F.col("depth") == d).select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.substring(F.sha2(name, 256), 1, 2).alias("part"), F.concat_ws("|", name, "entry").alias("line"))
        parts = here.groupBy("dir", "part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("own"))
        done = parts.groupBy("dir").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "own"))), lambda x: x["own"]), "\n"), 256).alias("id"))
        found = done if found is None else found.unionByName(done)
        entry = entry.where(F.col("depth") < d).unionByName(done.select(F.col("dir").alias("path"), F.concat_ws("|", F.lit("dir"), "id").alias("entry"), F.lit(d - 1).alias("depth")))
    return nodes.sparkSession.createDataFrame([], "dir string, id string") if found is None else found


def recursive_listing(children: DataFrame, roots: DataFrame) -> DataFrame:
    """children(tree, name, subtree) followed from roots(tree, path): one row for each entry with its path; a level loop
    that ends with the deepest tree.  A tree that contains itself raises."""
    level, out = roots.select("tree", "path", F.array("tree").alias("_above")), None
    while True:
        found = materialize(level.join(children, "tree").select(F.concat_ws("/", "path", "name").alias("path"), "subtree", "_above"))
        own = found.drop("_above")
        out = own if out is None else out.unionByName(own)
        below = found.where("subtree is not null")
        if not below.where(F.array_contains("_above", F.col("subtree"))).isEmpty():
            raise ValueError("a tree contains itself")
        if below.isEmpty():
            return out
        level = below.select(F.col("subtree").alias("tree"), "path", F.array_append("_above", F.col("subtree")).alias("_above"))


def listing(nodes: DataFrame, directory: str = "", recursive: bool = True, globs: Sequence[str] = ()) -> DataFrame:
    """Nodes below a directory (all of them, or its own entries only) that the exclusion globs let through, in pre-order."""
    inside = nodes.where(F.col("path").startswith(directory.rstrip("/") + "/"))
    if not recursive:
        inside = inside.where(F.size(F.split("path", "/")) == directory.rstrip("/").count("/") + 2)
    if globs:
        inside = inside.where(not_excluded("path", globs))
    return pre_order(inside)


def pre_order(nodes: DataFrame) -> DataFrame:
    """Depth first, each directory before what it holds: the order of the paths' parts."""
    return nodes.orderBy(F.split("path", "/"))


def open_rows(nodes: DataFrame, opened: Sequence[str]) -> DataFrame:
    """What a tree view shows: entries all of whose directories are open, the root itself skipped, in pre-order."""
    shown = F.forall(F.filter(ancestors(), lambda a: a != ""), lambda a: a.isin(*opened) if opened else F.lit(False))
    return pre_order(nodes.where((F.col("path") != "") & shown))
