"""Snapshot details, summaries as JSON, progress: projections for people and scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions.scalars import delete_text, duration_text, human_size


def snapshot_details(df: DataFrame) -> DataFrame:
    """Title/value rows of each snapshot, in order; rows about a summary only where there is one, the original id only where it differs,
    the description only where it is set."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    s = lambda c: F.col(f"summary.{c}")
    have = {f.name for f in df.schema["summary"].dataType.fields} if "summary" in df.columns else set()
    text = lambda c, none="": F.coalesce(F.col(c), F.lit(none)) if c in df.columns else F.lit(none)
    counts = lambda kind: F.format_string("new: %10d / changed: %10d / unchanged: %10d", *[s(f"{kind}_{x}") for x in ("new", "changed", "unmodified")])
    blobs = lambda name, n, raw, packed: F.format_string(f"{name}%10d blobs / raw: %10s / packed: %10s", n, human_size(raw), human_size(packed))
    rows = [("Snapshot", F.col("id"))]
    if "original" in df.columns:
        rows.append(("Original ID", F.when(F.col("original") != F.col("id"), F.col("original"))))
    rows += [("Time", stamp("time")), ("Generated by", text("program_version")), ("Host", text("hostname")), ("Label", text("label")), ("Tags", F.array_join("tags", "\n")),
             ("Delete", delete_text("delete_kind", stamp("delete_after"))), ("Paths", F.array_join("paths", "\n")), ("Parent", text("parent", "no parent snapshot"))]
    told = F.col("summary").isNotNull() if have else F.lit(False)
    wanted = {"Command": (("command",), lambda: s("command")),
              "Source": (("total_files_processed", "total_dirs_processed", "total_bytes_processed"), lambda: F.concat(F.format_string("files: %d / dirs: %d / size: ", s("total_files_processed"), s("total_dirs_processed")), human_size(s("total_bytes_processed")))),
              "Files": (("files_new", "files_changed", "files_unmodified"), lambda: counts("files")), "Dirs": (("dirs_new", "dirs_changed", "dirs_unmodified"), lambda: counts("dirs")),
              "Added to repo": (("data_blobs", "tree_blobs", "data_added_files", "data_added_files_packed", "data_added_trees", "data_added_trees_packed", "data_added", "data_added_packed"),
                                lambda: F.concat_ws("\n", blobs("data:  ", s("data_blobs"), s("data_added_files"), s("data_added_files_packed")), blobs("tree:  ", s("tree_blobs"), s("data_added_trees"), s("data_added_trees_packed")),
                                                    blobs("total: ", s("tree_blobs") + s("data_blobs"), s("data_added"), s("data_added_packed")))),
              "Duration": (("backup_start", "backup_end", "backup_duration", "total_duration"),
                           lambda: F.concat(F.lit("backup start: "), stamp("summary.backup_start"), F.lit(" / backup end: "), stamp("summary.backup_end"), F.lit(" / backup duration: "), duration_text(s("backup_duration")), F.lit("\ntotal duration: "), duration_text(s("total_duration"))))}
    rows += [(title, F.when(told, value())) for title, (needs, value) in wanted.items() if have.issuperset(needs)]
    if "description" in df.columns:
        rows.append(("Description", F.col("description")))
    pairs = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(t).alias("title"), v.alias("value")) for i, (t, v) in enumerate(rows)])
    return df.select("id", F.inline(F.filter(pairs, lambda p: p["value"].isNotNull())))


def summary_json(df: DataFrame) -> DataFrame:
    """One JSON line a snapshot, without empty fields, and without the id where it is not set."""
    return df.select(F.to_json(F.struct(F.when(F.col("id") != "", F.col("id")).alias("snapshot_id"), F.lit("summary").alias("message_type"), "summary.*"), {"ignoreNullFields": "true"}).alias("json"))


def progress(position: Column, length: Column, elapsed: Column) -> tuple[Column, Column]:
    """(share done, seconds remaining): the share is a fraction of at most 1; nothing remains to tell at position 0."""
    share = F.least(F.try_divide(position.cast("double"), length.cast("double")), F.lit(1.0))
    return share, F.when(position > 0, F.floor(elapsed * (length - position) / position))


def widths(df: DataFrame) -> DataFrame:
    """The widest value of each column."""
    return df.agg(*[F.greatest(F.lit(len(c)), F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0))).alias(c) for c in df.columns])


def commands(*levels: Column) -> Column:
    """Hook commands of several levels, in order."""
    return F.flatten(F.array(*levels))


def attributes(nodes: DataFrame, now: Column) -> DataFrame:
    """File attributes with defaults: mode 0755, owner and group 0, the given time."""
    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default).alias(name) if name in nodes.columns else default.alias(name)

    return nodes.select("path", "node_type", given("size", F.lit(0).cast("long")), given("mode", F.lit(0o755).cast("long")), given("uid", F.lit(0).cast("long")), given("gid", F.lit(0).cast("long")), given("mtime", now), given("links", F.lit(1).cast("long")))


def browse(nodes: DataFrame, directory: str) -> DataFrame:
    """The entries of one directory: name, kind, and size, that of a directory being all below it."""
    depth = directory.count("/") + 2
    parts = F.split("path", "/")
    inside = nodes.where(F.col("path").startswith(directory + "/"))
    entry = F.element_at(parts, depth)
    kind = F.when(F.size(parts) > depth, "dir").otherwise(F.col("node_type"))
    return inside.groupBy(entry.alias("name")).agg(F.max(kind).alias("kind"), F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))


def find_results(snapshots: DataFrame, hits: DataFrame, show_misses: bool = False) -> DataFrame:
    """snapshots(id) with their hits(id, path); those without a hit only when asked for."""
    return snapshots.join(hits, "id", "left" if show_misses else "inner")


def pack_listing(index: DataFrame) -> DataFrame:
    """Packs with their type, size and time ('' where unknown)."""
    time = F.max("pack_time") if "pack_time" in index.columns else F.lit(None).cast("timestamp")
    return index.groupBy("pack_id", "blob_type").agg(F.sum("length").alias("size"), F.coalesce(F.date_format(time, "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("time"))


def index_totals(index: DataFrame) -> DataFrame:
    """Blobs and bytes by type, live and marked for deletion, and in all; types without rows do not show."""
    kind = F.when(F.col("to_delete"), F.concat("blob_type", F.lit(" to delete"))).otherwise(F.col("blob_type"))
    rows = index.withColumn("kind", kind).rollup("kind").agg(F.grouping("kind").alias("_all"), F.count("*").alias("blobs"), F.sum("data_length").alias("data_size"), F.sum("length").alias("packed_size"))
    return rows.withColumn("kind", F.when(F.col("_all") == 1, "Total").otherwise(F.col("kind"))).drop("_all")


def pack_sizes(index: DataFrame) -> DataFrame:
    """Packs of each blob type: how many, the smallest and the largest ('-' where there is none is the reader's)."""
    return index.groupBy("pack_id", "blob_type").agg(F.sum("length").alias("size")).groupBy("blob_type").agg(F.count("*").alias("packs"), F.min("size").alias("smallest"), F.max("size").alias("largest"))


def preview(files: DataFrame, key: str, content: str = "text", most: int = 1_000_000) -> DataFrame:
    """The first bytes of each file as text, where the file is UTF-8; a character cut by the bound goes."""
    raw = F.col(content).cast("binary")
    head = F.make_valid_utf8(F.substring(raw, 1, most).cast("string"))
    text = F.when(F.length(raw) > most, F.regexp_replace(head, "\ufffd+$", "")).otherwise(head)
    return files.where(F.is_valid_utf8(raw.cast("string"))).select(key, text.alias("preview"))
