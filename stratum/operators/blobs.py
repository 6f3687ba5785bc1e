"""Content-addressed blobs: chunking, dedup accounting, reachability, checks, packs and prune plans."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions.scalars import content_matches
from stratum.operators.filters import in_part, in_share
from stratum.shared import running_total

#: Target sizes of packs, how they grow, their limit, and the least share of it that is tolerated.
TREE_PACK, DATA_PACK, GROW, PACK_LIMIT, LEAST_SHARE = 4 << 20, 32 << 20, 32, (1 << 32) - 1, 0.3


def pack_target(total: int, base: int = DATA_PACK, grow: int = GROW, limit: int = PACK_LIMIT) -> int:
    """Target size of packs: the base, grown by the square root of all packs' size times `grow`, up to the limit."""
    return min(limit, base + grow * math.isqrt(total))


def well_sized(size: Column, target: int, least: float = LEAST_SHARE, most: float | None = None) -> Column:
    """Whether a pack's size is tolerated."""
    return (size >= least * target) & (size <= most * target if most else F.lit(True))


def fixed_chunks(files: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(key, pos, chunk, blob_id, len): chunks of `size` characters."""
    n = F.greatest(F.ceil(F.char_length(text) / F.lit(float(size))).cast("int"), F.lit(0))
    return files.where(F.char_length(text) > 0).select(key, text, F.explode(F.sequence(F.lit(0), n - 1)).alias("pos")) \
        .select(key, "pos", F.substring(F.col(text), F.col("pos") * size + 1, F.lit(size)).alias("chunk")) \
        .withColumn("blob_id", F.sha2("chunk", 256)).withColumn("len", F.char_length("chunk").cast("long"))


def rolling_chunks(files: DataFrame, key: str, data: str, least: int = 512, mask_bits: int = 10, most: int = 8192) -> DataFrame:
    """(key, pos, offset, len, blob_id): content-defined chunks of binary or text data by a rolling hash over 48 bytes.

    Sequential within a file by nature, so it runs in Python over Arrow batches, parallel over files."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    kind = files.schema[key].dataType.simpleString()
    window, base = 48, 0x9E3779B97F4A7C15

    def cut(raw: bytes) -> Iterator[tuple[int, int]]:
        x = np.frombuffer(raw, np.uint8).astype(np.uint64)
        ends = np.zeros(0, np.int64)
        if len(x) > window:
            with np.errstate(over="ignore"):
                # hash of the window that ends at i, as a polynomial: prefix sums over powers of the inverse base
                inverse = np.uint64(pow(base, -1, 1 << 64))
                steps = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(x), inverse, np.uint64)]))
                prefix = np.concatenate([[np.uint64(0)], np.cumsum((x + np.uint64(1)) * steps[:-1], dtype=np.uint64)])
                up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(x), np.uint64(base), np.uint64)]))
                rolled = (prefix[window:] - prefix[:-window]) * up[window - 1:len(x)]
            ends = np.flatnonzero(rolled >> np.uint64(64 - mask_bits) == 0) + window
        start = 0
        while start < len(raw):
            at = ends[np.searchsorted(ends, start + least):][:1]
            end = min(int(at[0]) if len(at) else len(raw), start + most, len(raw))
            yield start, end
            start = end

    def run(batches):
        for batch in batches:
            keys, out = [], {c: [] for c in ("pos", "offset", "len", "blob_id")}
            for i, value in enumerate(batch.column(1).to_pylist()):
                raw = value.encode() if isinstance(value, str) else value or b""
                for pos, (a, b) in enumerate(cut(raw)):
                    keys.append(i)
                    out["pos"].append(pos)
                    out["offset"].append(a)
                    out["len"].append(b - a)
                    out["blob_id"].append(hashlib.sha256(raw[a:b]).hexdigest())
            yield pa.record_batch({key: batch.column(0).take(pa.array(keys, pa.int64())), "pos": pa.array(out["pos"], pa.int32()), "offset": pa.array(out["offset"], pa.int64()), "len": pa.array(out["len"], pa.int64()), "blob_id": pa.array(out["blob_id"], pa.string())})

    return files.select(key, data).mapInArrow(run, f"{key} {kind}, pos int, offset long, len long, blob_id string")


def distinct_blobs(blobs: DataFrame) -> DataFrame:
    return blobs.groupBy("blob_id").agg(F.max("len").alias("len"))


def sizes(blobs: DataFrame) -> DataFrame:
    """count, bytes before and after dedup, and their ratio (null where nothing is stored)."""
    per = blobs.groupBy("blob_id").agg(F.max("len").alias("len"), F.sum("len").alias("all_len"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("blobs"), F.sum("n").alias("occurrences"), F.sum("len").alias("unique_bytes"), F.sum("all_len").alias("total_bytes")) \
        .withColumn("ratio", F.round(F.try_divide("unique_bytes", "total_bytes"), 6))


def shared_exclusive(left: DataFrame, right: DataFrame) -> DataFrame:
    """blobs and bytes that only the left, only the right, or both sides refer to; each blob once."""
    both = distinct_blobs(left).select("blob_id", F.col("len").alias("l")).join(distinct_blobs(right).select("blob_id", F.col("len").alias("r")), "blob_id", "full")
    side = F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right").otherwise("shared")
    return both.groupBy(side.alias("side")).agg(F.count("*").alias("blobs"), F.sum(F.coalesce("l", "r")).alias("bytes"))


def stored_sizes(blobs: DataFrame, index: DataFrame) -> DataFrame:
    """Of a set of blobs, by their index entries: how many, stored and uncompressed bytes."""
    return blobs.select("blob_id").distinct().join(index.select("blob_id", "length", "uncompressed_length").dropDuplicates(["blob_id"]), "blob_id") \
        .agg(F.count("*").alias("blobs"), F.coalesce(F.sum("length"), F.lit(0)).alias("stored"), F.coalesce(F.sum(F.coalesce(F.nullif("uncompressed_length", F.lit(0)), "length")), F.lit(0)).alias("uncompressed"))


def locate(blobs: DataFrame, index: DataFrame, strict: bool = False) -> DataFrame:
    """blobs with the pack that holds each (null where no index knows it; strict raises)."""
    out = blobs.join(index.select("blob_id", "pack_id"), "blob_id", "left")
    return out.withColumn("pack_id", F.coalesce("pack_id", F.raise_error(F.concat(F.lit("no index knows blob "), "blob_id")).cast("string"))) if strict else out


def live_blobs(snapshots: DataFrame, content: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """Blobs (blob_id) that snapshots(id, tree) refer to by content(tree, blob_id), but for ignored snapshots (id)."""
    kept = snapshots if ignored is None else snapshots.join(ignored.select("id").distinct(), "id", "left_anti")
    return content.join(kept.select("tree").distinct(), "tree", "left_semi").select("blob_id").distinct()


def check_content(blobs: DataFrame, content: str = "chunk", subset: str = "100%", length: str = "len") -> DataFrame:
    """Blobs whose bytes do not give their id, of all or a subset: 'n/m' (the n-th of m parts), 'x%', or a size like '10 MiB'."""
    part = blobs
    if "/" in subset:
        n, m = map(int, subset.split("/"))
        part = blobs.where(in_part("blob_id", n, m))
    elif subset.endswith("%"):
        part = blobs.where(in_share("blob_id", float(subset[:-1])))
    else:
        part = within_size(blobs, subset, length)
    return part.where(~content_matches(content, "blob_id")).select("blob_id")


def within_size(blobs: DataFrame, size: str, length: str = "len") -> DataFrame:
    """Blobs in order of a hash of their ids, as many as fit in the size."""
    from stratum.functions.scalars import size_of

    mixed = blobs.withColumn("_order", F.xxhash64("blob_id"))
    return running_total(mixed, [F.col("_order"), F.col("blob_id")], length, "_upto").where(F.col("_upto") <= size_of(size)).drop("_order", "_upto")


def missing(used: DataFrame, index: DataFrame) -> DataFrame:
    """Blobs in use that no index knows."""
    return used.select("blob_id").distinct().join(index.select("blob_id"), "blob_id", "left_anti")


def unused(index: DataFrame, used: DataFrame) -> DataFrame:
    return index.join(used.select("blob_id"), "blob_id", "left_anti")


def pack_usage(index: DataFrame, used: DataFrame) -> DataFrame:
    """Used and unused blobs and bytes of each pack."""
    live = used.select("blob_id").distinct().withColumn("on", F.lit(True))
    on = F.coalesce("on", F.lit(False))
    return index.join(live, "blob_id", "left").groupBy("pack_id").agg(
        F.count_if(on).alias("used_blobs"), F.count_if(~on).alias("unused_blobs"),
        F.sum(F.when(on, F.col("len")).otherwise(0)).alias("used_bytes"), F.sum(F.when(on, 0).otherwise(F.col("len"))).alias("unused_bytes"))


def prune_plan(index: DataFrame, used: DataFrame, max_repack: int | None = None, keep_packs: tuple[str, ...] = ()) -> DataFrame:
    """pack_usage with action: keep (all used), remove (none used), repack (some), or keep-budget where repacking it, most
    unused share first, would exceed max_repack bytes."""
    usage = pack_usage(index, used)
    part = (F.col("used_blobs") > 0) & (F.col("unused_blobs") > 0)
    action = F.when(F.col("pack_id").isin(*keep_packs) if keep_packs else F.lit(False), "keep").when(F.col("used_blobs") == 0, "remove").when(part, "repack").otherwise("keep")
    plan = usage.withColumn("action", action)
    if max_repack is None:
        return plan
    share = F.col("unused_bytes") / (F.col("unused_bytes") + F.col("used_bytes"))
    some = plan.where("action = 'repack'").withColumn("_share", share)
    some = running_total(some, [F.desc("_share"), F.asc("pack_id")], "used_bytes", "_spent")
    some = some.withColumn("action", F.when(F.col("_spent") <= max_repack, "repack").otherwise("keep-budget")).drop("_share", "_spent")
    return plan.where("action <> 'repack'").unionByName(some)


def prune_decisions(index: DataFrame, used: DataFrame, now, keep_pack: str = "0 days", keep_delete: str = "23 hours", max_repack: int | None = None, max_unused: int | None = None, instant_delete: bool = False) -> DataFrame:
    """pack_usage with action, for index(blob_id, pack_id, len, pack_time, marked_at): of packs that are not marked keep (all used, younger than
    keep_pack, or beyond the limits), mark (none used; remove with instant_delete) or repack (some used); of packs marked before
    recover (used again), delete (marked keep_delete ago or longer) or keep-marked.

    Packs are repacked most unused share first, while their used bytes fit in max_repack and more than max_unused bytes would stay unused."""
    now = F.lit(now).cast(index.schema["pack_time"].dataType)
    packs = index.groupBy("pack_id").agg(F.max("pack_time").alias("pack_time"), F.max("marked_at").alias("marked_at"))
    usage = pack_usage(index, used).join(packs, "pack_id")
    old = F.col("marked_at") <= now - F.expr(f"interval {keep_delete}")
    young = F.col("pack_time") > now - F.expr(f"interval {keep_pack}")
    action = (F.when(F.col("marked_at").isNotNull(), F.when(F.col("used_blobs") > 0, "recover").when(old | F.lit(instant_delete), "delete").otherwise("keep-marked"))
              .when(young | (F.col("unused_blobs") == 0), "keep").when(F.col("used_blobs") == 0, "remove" if instant_delete else "mark").otherwise("repack"))
    plan = usage.withColumn("action", action).drop("pack_time", "marked_at")
    if max_repack is None and max_unused is None:
        return plan
    some = plan.where("action = 'repack'").withColumn("_share", F.col("unused_bytes") / (F.col("unused_bytes") + F.col("used_bytes")))
    total = some.agg(F.coalesce(F.sum("unused_bytes"), F.lit(0)).alias("_total"))
    order = [F.desc("_share"), F.asc("pack_id")]
    some = running_total(running_total(some, order, "used_bytes", "_spent"), order, "unused_bytes", "_freed").join(F.broadcast(total))
    enough = (F.col("_spent") <= max_repack) if max_repack is not None else F.lit(True)
    needed = (F.col("_total") - F.col("_freed") + F.col("unused_bytes") > max_unused) if max_unused is not None else F.lit(True)
    some = some.withColumn("action", F.when(enough & needed, "repack").otherwise("keep")).select(*plan.columns)
    return plan.where("action <> 'repack'").unionByName(some)


def prune_statistics(plan: DataFrame, packs: DataFrame | None = None) -> DataFrame:
    """One row of a plan's totals: blobs and bytes used, unused, to repack, removed by that, to delete; packs by action; what remains and the
    percentage of it that is unused; and packs(pack_id, size) that no index knows."""
    act = lambda *names: F.col("action").isin(*names)
    total = lambda column, when, name: F.coalesce(F.sum(F.when(when, F.col(column))), F.lit(0)).alias(name)
    unmarked = ~act("recover", "delete", "keep-marked")
    out = []
    for what in ("blobs", "bytes"):
        out += [total(f"used_{what}", F.lit(True), f"used_{what}"), total(f"unused_{what}", unmarked, f"unused_{what}"), total(f"used_{what}", act("repack"), f"repack_{what}"), total(f"unused_{what}", act("repack"), f"repackrm_{what}"),
                total(f"unused_{what}", act("mark", "remove"), f"remove_{what}")]
    out += [F.count_if(act(a)).alias(f"packs_{a.replace('-', '_')}") for a in ("keep", "repack", "mark", "remove", "delete", "recover", "keep-marked")]
    row = plan.agg(*out)
    left = F.col("used_bytes") + F.col("unused_bytes") - F.col("repackrm_bytes") - F.col("remove_bytes")
    unused = F.col("unused_bytes") - F.col("repackrm_bytes") - F.col("remove_bytes")
    row = row.withColumn("remaining_bytes", left).withColumn("unused_after_bytes", unused).withColumn("unused_percent", F.round(F.try_divide(unused * 100.0, left.cast("double")), 2))
    if packs is None:
        return row
    unknown = packs.join(plan.select("pack_id"), "pack_id", "left_anti").agg(F.count("*").alias("packs_unref"), F.coalesce(F.sum("size"), F.lit(0)).alias("size_unref"))
    return row.join(F.broadcast(unknown))


def packs_needed(plan: DataFrame, batch: int = 1000) -> DataFrame:
    """The packs a plan reads, each once, with the number of the batch that it is warmed up in."""
    packs = plan.select("pack_id").where("pack_id is not null").distinct().withColumn("_one", F.lit(1))
    return running_total(packs, [F.col("pack_id")], "_one", "_n").select("pack_id", F.floor((F.col("_n") - 1) / batch).alias("batch"))


def assemble_packs(blobs: DataFrame, target: int, spread: int = 2) -> DataFrame:
    """Distinct blobs dealt into packs of about `target` bytes, within ranges of the id's first `spread` hex digits, so that packs
    form in parallel: pack = floor(bytes before / target)."""
    prefix = F.substring("blob_id", 1, spread)
    before = F.sum("len").over(Window.partitionBy("prefix").orderBy("blob_id").rowsBetween(Window.unboundedPreceding, -1))
    placed = distinct_blobs(blobs).withColumn("prefix", prefix).withColumn("slot", F.floor(F.coalesce(before, F.lit(0)) / target).cast("long"))
    return placed.withColumn("pack_id", F.concat_ws("-", "prefix", "slot"))


def byte_range(content: DataFrame, offset: int, length: int, key: str) -> DataFrame:
    """The part of each file (its blobs in order of pos) from offset on: key, data; files are read by running offsets."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = content.withColumn("start", F.coalesce(F.sum("len").over(w), F.lit(0))).withColumn("end", F.col("start") + F.col("len"))
    hit = placed.where((F.col("end") > offset) & (F.col("start") < offset + length))
    a = F.greatest(F.lit(offset) - F.col("start"), F.lit(0))
    b = F.least(F.lit(offset + length) - F.col("start"), F.col("len"))
    part = F.substring(F.col("chunk"), (a + 1).cast("int"), (b - a).cast("int"))
    return hit.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))), lambda x: x["part"]), "").alias("data"))
