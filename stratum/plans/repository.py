"""Plans of repository operations: each is a pure query of what would be done; applying it writes a new table version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions.scalars import epoch_seconds
from stratum.operators.blobs import locate, stored_sizes
from stratum.operators.filters import must_keep, not_excluded
from stratum.operators.tree import identities


# --- backup
def file_states(source: DataFrame, parent: DataFrame, ignore_ctime: bool = True, ignore_inode: bool = True) -> DataFrame:
    """source with state: new, changed or unmodified against the parent tree (size and mtime, ctime and inode unless ignored)."""
    keys = ["size", "mtime"] + ([] if ignore_ctime else ["ctime"]) + ([] if ignore_inode else ["inode"])
    old = parent.select("path", F.struct(F.col("node_type"), *keys).alias("old"))
    same = F.col("node_type") == F.col("old.node_type")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"old.{k}"))
    state = F.when(F.col("old").isNull(), "new").when(F.coalesce(same, F.lit(False)), "unmodified").otherwise("changed")
    return source.join(old, "path", "left").withColumn("state", state).drop("old")


def new_blobs(content: DataFrame, index: DataFrame) -> DataFrame:
    """Blobs of a backup (blob_id, blob_type, length, packed_length) that no index knows, each once."""
    return content.dropDuplicates(["blob_id"]).join(index.select("blob_id"), "blob_id", "left_anti")


def backup_summary(states: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """What a backup did, as one row: entries by state, totals, and the blobs it added (new_blobs; without them, data_added is what changed)."""
    kind = {"files": F.col("node_type") != "dir", "dirs": F.col("node_type") == "dir"}
    out = [F.count_if(when & (F.col("state") == s)).alias(f"{name}_{s}") for name, when in kind.items() for s in ("new", "changed", "unmodified")]
    total = lambda when, column="size": F.coalesce(F.sum(F.when(when, F.col(column))), F.lit(0))
    out += [F.count_if(kind["files"]).alias("total_files_processed"), total(kind["files"]).alias("total_bytes_processed"), F.count_if(kind["dirs"]).alias("total_dirs_processed"), total(kind["dirs"]).alias("total_dirsize_processed")]
    if added is None:
        return states.agg(*out, total(F.col("state") != "unmodified").alias("data_added"))
    of = {"files": F.col("blob_type") == "data", "trees": F.col("blob_type") == "tree"}
    blobs = added.agg(F.count_if(of["files"]).alias("data_blobs"), F.count_if(of["trees"]).alias("tree_blobs"), total(F.lit(True), "length").alias("data_added"), total(F.lit(True), "packed_length").alias("data_added_packed"),
                      *[x for name, when in of.items() for x in (total(when, "length").alias(f"data_added_{name}"), total(when, "packed_length").alias(f"data_added_{name}_packed"))])
    return states.agg(*out).join(F.broadcast(blobs))  # two single rows


def with_times(summary: DataFrame, start, end, command_start) -> DataFrame:
    """A summary with the backup's start, end and durations in seconds."""
    start, end, command_start = (F.lit(t).cast("timestamp") for t in (start, end, command_start))
    out = summary.withColumn("backup_start", start).withColumn("backup_end", end)
    return out.withColumn("backup_duration", epoch_seconds(end) - epoch_seconds(start)).withColumn("total_duration", epoch_seconds(end) - epoch_seconds(command_start))


#: The measures of a summary that are pushed, in order; times become seconds.
COUNTS = ("files_new", "files_changed", "files_unmodified", "total_files_processed", "total_bytes_processed", "dirs_new", "dirs_changed", "dirs_unmodified", "total_dirs_processed", "total_dirsize_processed", "data_blobs", "tree_blobs",
          "data_added", "data_added_packed", "data_added_files", "data_added_files_packed", "data_added_trees", "data_added_trees_packed")
TIMES, DURATIONS = ("backup_start", "backup_end"), ("backup_duration", "total_duration")


def snapshot_metrics(snapshots: DataFrame, prefix: str = "backup_") -> DataFrame:
    """(id, metric, value): the snapshot's time and all measures of its summary, 23 rows; snapshots without a summary have none."""
    rows = [("time", epoch_seconds("time"))] + [(c, F.col(f"summary.{c}").cast("double")) for c in COUNTS] + [(c, epoch_seconds(F.col(f"summary.{c}"))) for c in TIMES] + [(c, F.col(f"summary.{c}").cast("double")) for c in DURATIONS]
    pairs = F.array(*[F.struct(F.lit(prefix + n).alias("metric"), v.alias("value")) for n, v in rows])
    return snapshots.where(F.col("summary").isNotNull()).select("id", F.inline(pairs))


def unchanged(tree: str, parent: DataFrame) -> bool:
    """Whether a backup can be skipped: the parent snapshot has the same tree."""
    return not parent.where(F.col("tree") == tree).isEmpty()


def metrics(summary: DataFrame, names: Sequence[str]) -> DataFrame:
    """One summary row as (metric, value) rows."""
    parts = ", ".join(f"'{n}', cast({n} as double)" for n in names)
    return summary.select(F.expr(f"stack({len(names)}, {parts}) as (metric, value)"))


def metric_labels(given: Column, defaults: Column) -> Column:
    """Given labels win over defaults; empty ones are dropped."""
    extra = F.map_filter(defaults, lambda k, _: ~F.array_contains(F.map_keys(given), k))
    return F.map_filter(F.map_concat(given, extra), lambda _, v: v != "")


# --- restore
def restore_plan(snapshot: DataFrame, destination: DataFrame, verify: bool = False) -> DataFrame:
    """path, action: restore, modify, unchanged, verified, additional.  Equal size and mtime are trusted unless verify."""
    a = snapshot.select("path", F.struct("node_type", "size", "mtime", "content").alias("want"))
    b = destination.select("path", F.struct("node_type", "size", "mtime", "content").alias("have"))
    trusted = (F.col("want.node_type") == F.col("have.node_type")) & (F.col("want.size") == F.col("have.size")) & F.col("want.mtime").eqNullSafe(F.col("have.mtime"))
    equal = F.col("want.content").eqNullSafe(F.col("have.content"))
    action = F.when(F.col("want").isNull(), "additional").when(F.col("have").isNull(), "restore")
    action = action.when(equal, "verified").otherwise("modify") if verify else action.when(trusted, "unchanged").otherwise("modify")
    return a.join(b, "path", "full").select("path", action.alias("action"), F.coalesce("want.node_type", "have.node_type").alias("node_type"), F.coalesce("want.size", F.lit(0)).alias("size"))


def restore_stats(plan: DataFrame) -> DataFrame:
    todo = F.col("action").isin("restore", "modify")
    return plan.groupBy("node_type", "action").agg(F.count("*").alias("n"), F.sum(F.when(todo, F.col("size")).otherwise(0)).alias("restore_size"), F.sum(F.when(F.col("action").isin("unchanged", "verified"), F.col("size")).otherwise(0)).alias("matched_size"))


def restore_actions(plan: DataFrame, delete: bool = False) -> DataFrame:
    """What applying a restore plan does, in order: directories first, then files and the rest, and with `delete` what is additional, deepest first."""
    depth = F.size(F.split("path", "/"))
    step = F.when(F.col("action") == "additional", F.when(F.lit(delete), "remove")).when(F.col("action").isin("restore", "modify"), F.when(F.col("node_type") == "dir", "create").otherwise("write"))
    order = F.when(F.col("step") == "create", F.struct(F.lit(0), depth)).when(F.col("step") == "write", F.struct(F.lit(1), depth)).otherwise(F.struct(F.lit(2), -depth))
    return plan.withColumn("step", step).where("step is not null").select("path", "node_type", "step", "size", order.alias("at")).orderBy("at", "path").drop("at")


def restore_packs(plan: DataFrame, content: DataFrame, index: DataFrame) -> DataFrame:
    """The packs (pack_id, bytes) that a restore reads: those of content(path, blob_id, len) of files to be written; a blob no index knows raises."""
    need = content.join(plan.where("action in ('restore', 'modify') and node_type = 'file'").select("path"), "path", "left_semi").select("blob_id", "len").dropDuplicates(["blob_id"])
    return locate(need, index, strict=True).groupBy("pack_id").agg(F.sum("len").alias("bytes"))


def restore_files(plan: DataFrame, content: DataFrame, destination: str) -> None:
    """Applies a plan: writes the files (content(path, pos, chunk binary)) below a folder that all executors share, one task a file."""
    files = content.join(plan.where("action in ('restore', 'modify') and node_type = 'file'").select("path"), "path", "left_semi")
    root = destination.rstrip("/")

    def write(rows) -> None:
        import os

        open_, out = None, None
        try:
            for r in rows:
                if r["path"] != open_:
                    if out:
                        out.close()
                    os.makedirs(os.path.dirname(root + r["path"]), exist_ok=True)
                    open_, out = r["path"], open(root + r["path"], "wb")
                out.write(bytes(r["chunk"] or b""))
        finally:
            if out:
                out.close()

    files.repartition("path").sortWithinPartitions("path", "pos").foreachPartition(write)


# --- copy, merge, rewrite
def copy_plan(snapshots: DataFrame, target: DataFrame, force: bool = False) -> DataFrame:
    """snapshots with relevant: the target has none with the same original id."""
    known = target.select("original").distinct().withColumn("known", F.lit(True))
    return snapshots.join(known, "original", "left").withColumn("relevant", F.lit(True) if force else F.col("known").isNull()).drop("known")


def same_chunker(source: dict, target: dict) -> None:
    """Copies between repositories that cut files differently are refused: nothing would be shared."""
    keys = ("chunker", "chunk_size", "chunk_min_size", "chunk_max_size", "chunker_polynomial")
    if odd := [k for k in keys if source.get(k) != target.get(k)]:
        raise ValueError(f"the repositories cut files differently: {', '.join(odd)}")


def copy_blobs(plan: DataFrame, content: DataFrame, target_index: DataFrame) -> DataFrame:
    """Blobs (blob_id, len) that relevant snapshots refer to by content(tree, blob_id, len) and the target lacks, each once."""
    trees = plan.where("relevant").select("tree").distinct()
    return content.join(trees, "tree", "left_semi").select("blob_id", "len").dropDuplicates(["blob_id"]).join(target_index.select("blob_id"), "blob_id", "left_anti")


def merge_trees(nodes: DataFrame, order: Sequence[Column]) -> DataFrame:
    """One node for each path, first by `order` (latest modified first); a partial aggregate, no sort of whole groups."""
    rest = [c for c in nodes.columns if c != "path"]
    if all(isinstance(o, str) for o in order):
        return nodes.groupBy("path").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("n")).select("path", "n.*")
    w = Window.partitionBy("path").orderBy(*order)
    return nodes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def union_left_wins(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of all sources, one a key: that of the first source that has it."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("_priority", F.lit(-i))
        out = s if out is None else out.unionByName(s)
    rest = [c for c in out.columns if c not in (key, "_priority")]
    return out.groupBy(key).agg(F.max_by(F.struct(*rest, (-F.col("_priority")).alias("source")), "_priority").alias("n")).select(key, "n.*")


def rewrite_tags(tags, add: Sequence[str] = (), remove: Sequence[str] = (), replace: Sequence[str] | None = None) -> Column:
    """Set, then add, then remove; duplicates go."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    lits = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    out = tags if replace is None else lits(replace)
    return F.array_except(F.array_distinct(F.array_union(out, lits(add))), lits(remove))


def rewrite_snapshots(df: DataFrame, add_tags: Sequence[str] = (), remove_tags: Sequence[str] = (), set_tags: Sequence[str] | None = None, forget: bool = False, **fields) -> DataFrame:
    """The changed snapshots, ready to be saved: new ids, `original` kept; without forget they get the tag 'rewrite'."""
    new = rewrite_tags("tags", [*add_tags, *([] if forget else ["rewrite"])], remove_tags, set_tags)
    out = df.withColumn("tags_new", new)
    changed = ~(F.col("tags_new") == F.col("tags"))
    for name, value in fields.items():
        changed = changed | ~F.col(name).eqNullSafe(F.lit(value))
    out = out.where(changed).withColumn("tags", F.col("tags_new")).drop("tags_new")
    for name, value in fields.items():
        out = out.withColumn(name, F.lit(value))
    return out.withColumn("original", F.coalesce("original", "id")).withColumn("id", F.sha2(F.concat_ws("|", "id", F.array_join("tags", ","), *[F.col(n).cast("string") for n in fields]), 256))


def deletable_inputs(df: DataFrame, now) -> DataFrame:
    """Inputs of a merge that may go: those that are not protected."""
    return df.where(~must_keep(F.lit(now)))


def rewrite_tree(nodes: DataFrame, globs: Sequence[str] = (), **changes: Column) -> tuple[DataFrame, DataFrame]:
    """(nodes, identities) of a tree without what the globs exclude and with changed node fields; identities are blind to metadata, so an
    unchanged root id tells that only metadata changed."""
    out = nodes.where(not_excluded("path", globs)) if globs else nodes
    for name, value in changes.items():
        out = out.withColumn(name, value)
    return out, identities(out)


def merge_and_drop(inputs: DataFrame, nodes: DataFrame, order: Sequence[Column], now) -> tuple[DataFrame, DataFrame]:
    """(merged tree, ids of the inputs that may be removed afterwards)."""
    return merge_trees(nodes, order), deletable_inputs(inputs, now).select("id")


# --- repair
def read_packs(packs: DataFrame, content: str = "chunk") -> DataFrame:
    """Index entries made anew from the packs' own blobs (pack_id, blob_type, content): what reading all packs gives."""
    data = F.col(content).cast("binary")
    return packs.select(F.sha2(data, 256).alias("blob_id"), "pack_id", "blob_type", F.length(data).cast("long").alias("length")).distinct()


def rebuild_index(packs: DataFrame, index: DataFrame, read_all: bool = False) -> DataFrame:
    """Index entries after a repair: with read_all all from the packs, else those of known packs and, for packs without an index, from the packs."""
    fresh = read_packs(packs)
    if read_all:
        return fresh
    held = index.join(packs.select("pack_id").distinct(), "pack_id", "left_semi")
    return held.select(*fresh.columns).unionByName(fresh.join(index.select("pack_id").distinct(), "pack_id", "left_anti"))


def repair_snapshots(snapshots: DataFrame, broken: DataFrame, tag: str = "repaired", delete: bool = False) -> tuple[DataFrame, DataFrame]:
    """(snapshots to save, ids to remove) for snapshots whose tree is in broken(tree, new_tree): they get the new tree and a tag; a snapshot of which
    nothing is left (no new tree) is only removed, and with `delete` so are the originals."""
    hit = snapshots.join(broken, "tree")
    tags = F.array_distinct(F.array_append("tags", F.lit(tag)))
    saved = hit.where("new_tree is not null").withColumn("original", F.coalesce("original", "id")).withColumn("id", F.sha2(F.concat_ws("|", "id", "new_tree"), 256)).withColumn("tree", F.col("new_tree")).withColumn("tags", tags).drop("new_tree")
    return saved.select(*snapshots.columns), hit.where(F.lit(delete) | F.col("new_tree").isNull()).select("id")


def repair_index(packs: DataFrame, index: DataFrame) -> DataFrame:
    """pack_id, action: drop (indexed, no such pack), add (pack without index), keep."""
    a = packs.select("pack_id").distinct().withColumn("there", F.lit(True))
    b = index.select("pack_id").distinct().withColumn("indexed", F.lit(True))
    return a.join(b, "pack_id", "full").select("pack_id", F.when(F.col("there").isNull(), "drop").when(F.col("indexed").isNull(), "add").otherwise("keep").alias("action"))


def repair_nodes(nodes: DataFrame, content: DataFrame, index: DataFrame, suffix: str = ".repaired") -> DataFrame:
    """nodes whose content has missing blobs get the suffix and keep the blobs that are there: path, new_path, lost."""
    lost = content.join(index.select("blob_id"), "blob_id", "left_anti").groupBy("path").agg(F.count("*").alias("lost"))
    return nodes.join(lost, "path", "left").withColumn("lost", F.coalesce("lost", F.lit(0))).withColumn("new_path", F.when(F.col("lost") > 0, F.concat("path", F.lit(suffix))).otherwise(F.col("path")))


def compare_tiers(cold: DataFrame, hot: DataFrame) -> DataFrame:
    """Files that only one of the hot and cold stores has."""
    a, b = cold.select("id").distinct().withColumn("c", F.lit(True)), hot.select("id").distinct().withColumn("h", F.lit(True))
    return a.join(b, "id", "full").where("c is null or h is null").select("id", F.when(F.col("h").isNull(), "missing in hot").otherwise("missing in cold").alias("state"))


def new_rows(known: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """Incremental re-read: what is known, and what of the new listing is not."""
    return known.unionByName(found.join(known.select(key), key, "left_anti").select(*known.columns))


# --- sizes of what differs
def exclusive_sizes(left: DataFrame, right: DataFrame, index: DataFrame) -> DataFrame:
    """Stored and uncompressed bytes of the blobs that only one side has: (side, blobs, stored, uncompressed)."""
    sides = {"left": left.select("blob_id").distinct().join(right.select("blob_id"), "blob_id", "left_anti"), "right": right.select("blob_id").distinct().join(left.select("blob_id"), "blob_id", "left_anti")}
    rows = [stored_sizes(own, index).select(F.lit(side).alias("side"), "*") for side, own in sides.items()]
    return rows[0].unionByName(rows[1])
