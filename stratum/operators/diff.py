"""Comparing two listings: one full outer join on the path, then a classification by precedence.

Classes: + added, - removed, T type changed, M content changed, U metadata changed, = identical.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Same = Callable[[Column, Column], Column]


def same_content(left: Column, right: Column) -> Column:
    """Files by their content, directories and links always, every other kind never."""
    kind = left["node_type"]
    return F.when(kind == "file", left["content"].eqNullSafe(right["content"])).otherwise(kind.isin("dir", "symlink"))


def ignore_content(left: Column, right: Column) -> Column:
    kind = left["node_type"]
    return kind.isin("file", "dir", "symlink")


def classify(left: Column, right: Column, meta: Sequence[str], content: Same = same_content, metadata: bool = True) -> Column:
    """The class of a pair of nullable node structs."""
    links = (left["node_type"] == "symlink") & (right["node_type"] == "symlink")
    same_meta = F.lit(True)
    for m in meta if metadata else ():
        same_meta = same_meta & left[m].eqNullSafe(right[m])
    return (F.when(left.isNull(), "+").when(right.isNull(), "-").when((left["node_type"] != right["node_type"]) & ~links, "T")
            .when(links & ~left["link_target"].eqNullSafe(right["link_target"]), "M").when(~content(left, right), "M").when(~same_meta, "U").otherwise("="))


def _packed(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name))


#: What a node is and holds; every other column is metadata.
NOT_META = ("node_type", "link_target", "content", "subtree")


def metadata_of(left: DataFrame, right: DataFrame, key: str = "path") -> list[str]:
    """The metadata columns that both sides have."""
    return [c for c in left.columns if c in right.columns and c != key and c not in NOT_META]


def diff(left: DataFrame, right: DataFrame, meta: Sequence[str] | None = None, content: Same = same_content, metadata: bool = True, key: str = "path") -> DataFrame:
    """path, left, right (structs), cls.  Nodes need node_type, link_target and content; `meta` is all metadata of both unless told."""
    meta = metadata_of(left, right, key) if meta is None else meta
    both = _packed(left, key, "left").join(_packed(right, key, "right"), key, "full")
    return both.withColumn("cls", classify(F.col("left"), F.col("right"), meta, content, metadata))


def kind_of(row_left: str = "left", row_right: str = "right") -> Column:
    kind = F.coalesce(F.col(f"{row_right}.node_type"), F.col(f"{row_left}.node_type"))
    return F.when(kind.isin("file", "dir", "symlink"), kind).otherwise("other")


def stats(compared: DataFrame) -> DataFrame:
    """Rows of each kind and class; changes of the type itself are of no kind and count once, under 'type'."""
    return compared.groupBy(F.when(F.col("cls") == "T", "type").otherwise(kind_of()).alias("kind"), "cls").agg(F.count("*").alias("n"))


def bit_rot(left: DataFrame, right: DataFrame, meta: Sequence[str] | None = None) -> DataFrame:
    """Files with equal metadata (all of it unless told) on both sides, and whether their contents differ all the same."""
    meta = metadata_of(left, right) if meta is None else meta
    pairs = _packed(left.where("node_type = 'file'"), "path", "left").join(_packed(right.where("node_type = 'file'"), "path", "right"), "path")
    same = F.lit(True)
    for m in meta:
        same = same & F.col(f"left.{m}").eqNullSafe(F.col(f"right.{m}"))
    return pairs.where(same).select("path", (~F.col("left.content").eqNullSafe(F.col("right.content"))).alias("changed"))


def without_equal_subtrees(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drops from both sides what lies below directories with one subtree id on both: a rewrite for large, nearly equal trees."""
    equal = left.where("node_type = 'dir' and subtree is not null").select("path", "subtree").join(right.where("node_type = 'dir'").select("path", "subtree"), ["path", "subtree"]).select(F.col("path").alias("dir"))

    def rest(df: DataFrame) -> DataFrame:
        parts = F.split("path", "/")
        up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
        below = df.select("path", F.explode(up).alias("dir")).join(equal, "dir", "left_semi").select("path").distinct()
        return df.join(below, "path", "left_anti")

    return rest(left), rest(right)
