"""The test tables seen as snapshots, nodes, blobs, packs and indexes (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Summary fields of the test snapshots, as SQL that both engines read (k is the event's number).
SUMMARY = {"total_bytes_processed": "cast(round(value * 100) as bigint)", "data_added": "event_id", "data_added_packed": "event_id // 2", "total_files_processed": "k * 3", "total_dirs_processed": "k", "total_dirsize_processed": "k * 10",
           "files_new": "event_id % 7", "files_changed": "event_id % 5", "files_unmodified": "event_id % 3", "dirs_new": "event_id % 2", "dirs_changed": "event_id % 11", "dirs_unmodified": "event_id % 13", "data_blobs": "k % 9", "tree_blobs": "k % 4",
           "data_added_files": "event_id - event_id // 4", "data_added_files_packed": "event_id // 3", "data_added_trees": "event_id // 4", "data_added_trees_packed": "event_id // 5"}


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot an event; every 23rd has no label, every 50th no summary."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").withColumn("k", k).select(
        "event_id", F.sha2(F.col("event_id").cast("string"), 256).alias("id"), F.sha2(F.col("event_id").cast("string"), 256).alias("original"), F.col("ts").alias("time"),
        F.concat(F.lit("host"), F.col("user_id") % 10).alias("hostname"), F.when(F.col("event_id") % 23 != 0, F.col("event_type")).alias("label"), F.col("k").cast("long").alias("k"), F.concat(F.lit("t"), F.expr("k div 25")).alias("tree"),
        F.array(F.concat(F.lit("/home/"), F.col("user_id"))).alias("paths"), F.array(F.concat(F.lit("k"), F.col("k") % 5), F.concat(F.lit("m"), F.col("k") % 3)).alias("tags"),
        F.when(F.col("event_id") % 97 == 0, "never").when(F.col("event_id") % 89 == 0, "after").otherwise("notset").alias("delete_kind"),
        F.when(F.col("event_id") % 89 == 0, F.expr("ts + interval 10 days")).alias("delete_after"),
        F.when(F.col("event_id") % 50 != 0, F.struct(*[F.expr(sql.replace("//", "div")).cast("long").alias(c) for c, sql in SUMMARY.items()], F.col("ts").alias("backup_start"), F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, k)").alias("backup_end"),
                                                     F.col("k").cast("double").alias("backup_duration"), (F.col("k") + 0.5).cast("double").alias("total_duration"))).alias("summary"))


SNAP = f"""snap as (
  select event_id, sha256(cast(event_id as varchar)) as id, ts as time, 'host' || (user_id % 10) as hostname, case when event_id % 23 <> 0 then event_type end as label,
         k, 't' || (cast(props->>'$.k' as bigint) // 25) as tree, '/home/' || user_id as path,
         ['k' || (cast(props->>'$.k' as bigint) % 5), 'm' || (cast(props->>'$.k' as bigint) % 3)] as tags,
         case when event_id % 97 = 0 then 'never' when event_id % 89 = 0 then 'after' else 'notset' end as delete_kind,
         case when event_id % 89 = 0 then ts + interval 10 day end as delete_after,
         case when event_id % 50 <> 0 then cast(round(value * 100) as bigint) end as total_bytes,
         {", ".join(f"case when event_id % 50 <> 0 then cast({sql} as bigint) end as {c}" for c, sql in SUMMARY.items())},
         case when event_id % 50 <> 0 then cast(round(value * 100) as bigint) end as total_bytes, case when event_id % 50 <> 0 then ts end as backup_start, case when event_id % 50 <> 0 then ts + to_seconds(k) end as backup_end
  from (select *, cast(props->>'$.k' as bigint) as k from events))"""


def _path():
    return F.concat(F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.expr("lpad(cast(doc_id as string), greatest(8, length(cast(doc_id as string))), '0')"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a document."""
    return table(spark, sf_dir, "documents").select("doc_id", _path().alias("path"), F.lit("file").alias("node_type"), F.lit(None).cast("string").alias("link_target"), F.col("n_chars").alias("size"),
                                                    F.lit(420).cast("long").alias("mode"), F.lit(0).cast("long").alias("mtime"), F.sha2("text", 256).alias("content"))


def nodes_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).where("doc_id % 7 <> 0")


def nodes_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.col("doc_id") % 5 == 0
    return nodes(spark, sf_dir).where("doc_id % 11 <> 0").withColumn("content", F.when(changed, F.concat("content", F.lit("x"))).otherwise(F.col("content"))) \
        .withColumn("mode", F.when(F.col("doc_id") % 13 == 0, 384).otherwise(420).cast("long")).withColumn("mtime", F.when(changed, 1).otherwise(0).cast("long")) \
        .withColumn("node_type", F.when(F.col("doc_id") % 29 == 0, "symlink").otherwise("file")).withColumn("link_target", F.when(F.col("doc_id") % 29 == 0, "target"))


NODES = """node as (
  select doc_id, '/' || coalesce(lang, 'none') || '/' || coalesce(source, 'none') || '/' || lpad(cast(doc_id as varchar), cast(greatest(8, length(cast(doc_id as varchar))) as integer), '0') as path, 'file' as node_type, cast(null as varchar) as link_target,
         n_chars as size, cast(420 as bigint) as mode, cast(0 as bigint) as mtime, sha256(text) as content from documents),
v1 as (select * from node where doc_id % 7 <> 0),
v2 as (select doc_id, path, case when doc_id % 29 = 0 then 'symlink' else 'file' end as node_type, case when doc_id % 29 = 0 then 'target' end as link_target, size,
              cast(case when doc_id % 13 = 0 then 384 else 420 end as bigint) as mode, cast(case when doc_id % 5 = 0 then 1 else 0 end as bigint) as mtime,
              case when doc_id % 5 = 0 then content || 'x' else content end as content
       from node where doc_id % 11 <> 0)"""


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of CHUNK characters of every document."""
    from stratum.operators.blobs import fixed_chunks

    return fixed_chunks(table(spark, sf_dir, "documents"), CHUNK, "doc_id", "text")


BLOBS = f"""blob as (
  select doc_id, cast(pos as integer) as pos, substring(text, pos * {CHUNK} + 1, {CHUNK}) as chunk, sha256(substring(text, pos * {CHUNK} + 1, {CHUNK})) as blob_id,
         cast(length(substring(text, pos * {CHUNK} + 1, {CHUNK})) as bigint) as len
  from documents, unnest(range(0, cast(ceil(length(text) / {CHUNK}.0) as bigint))) as t(pos) where length(text) > 0)"""


def nested_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index files as they are stored: one for each four first digits of the blobs' ids, with packs and their blobs."""
    blob = F.struct("blob_id", "blob_type", F.col("len").alias("length"), F.when(F.col("blob_id") < "8", F.col("len") * 2).alias("uncompressed_length"))
    return index(spark, sf_dir).groupBy(F.substring("blob_id", 1, 4).alias("id"), "pack_id").agg(F.collect_list(blob).alias("blobs")).select("id", F.array(F.struct("pack_id", "blobs")).alias("packs"))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct blobs in packs by the id's first two digits, with a blob type."""
    return blobs(spark, sf_dir).groupBy("blob_id").agg(F.max("len").alias("len")).withColumn("pack_id", F.substring("blob_id", 1, 2)).withColumn("blob_type", F.when(F.substring("blob_id", 3, 1) == "0", "tree").otherwise("data"))


INDEX = """idx as (select blob_id, max(len) as len, substring(blob_id, 1, 2) as pack_id, case when substring(blob_id, 3, 1) = '0' then 'tree' else 'data' end as blob_type from blob group by blob_id)"""


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs of documents labelled good."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    return blobs(spark, sf_dir).join(good, "doc_id", "left_semi")


LIVE = """live as (select distinct blob_id from blob where doc_id in (select doc_id from labels where quality = 1))"""


def marked_index(spark: SparkSession, sf_dir: str, now: str) -> DataFrame:
    """The index with packs marked for deletion: some a month ago, some an hour ago; and packs with their creation times."""
    now_ = F.lit(now).cast("timestamp_ntz")
    marked = F.when(F.col("pack_id") < "10", now_ - F.expr("interval 30 days")).when(F.col("pack_id") < "20", now_ - F.expr("interval 1 hour"))
    return index(spark, sf_dir).withColumn("marked_at", marked).withColumn("pack_time", F.when(F.col("pack_id") > "f0", now_).otherwise(now_ - F.expr("interval 60 days")))


def marked_sql(now: str) -> str:
    return f"""midx as (select *, case when pack_id < '10' then timestamp '{now}' - interval 30 day when pack_id < '20' then timestamp '{now}' - interval 1 hour end as marked_at,
  case when pack_id > 'f0' then timestamp '{now}' else timestamp '{now}' - interval 60 day end as pack_time from idx)"""
