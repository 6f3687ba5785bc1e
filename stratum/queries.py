"""The named queries over the test tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions import scalars as X
from stratum.operators import blobs as B
from stratum.operators import details as V
from stratum.operators import diff as D
from stratum.operators import filters as S
from stratum.operators import report as R
from stratum.operators import retention as K
from stratum.operators import select as L
from stratum.operators import tree as T
from stratum.plans import repository as P
from stratum.plans.edit import EditBuffer
from stratum.sources import readers
from stratum.sources.adapters import BLOBS, INDEX, LIVE, NODES, SNAP, SUMMARY, blobs, index, live, marked_index, marked_sql, nested_index, nodes, nodes_v1, nodes_v2, snapshots, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NOW = "2024-02-01 00:00:00"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f
    return add


def _human(b: str) -> str:
    """Human sizes below one GiB, as SQL."""
    def unit(f: int, name: str) -> str:
        tenths = f"((({b}) % {f}) * 10 + {f // 2}) // {f}"
        return f"when ({b}) >= {f} then (({b}) // {f} + ({tenths}) // 10) || '.' || (({tenths}) % 10) || ' {name}'"

    return f"case {unit(1 << 20, 'MiB')} {unit(1 << 10, 'kiB')} else ({b}) || ' B' end"


def brief(df: DataFrame) -> DataFrame:
    return df.select("event_id", "hostname", "label")


# --- filters
@query(f"with {SNAP} select event_id, hostname, label from snap where hostname in ('host1', 'host2') and label in ('click', 'view', 'purchase') and time > timestamp '2024-01-03 23:59:59.999999' and time < timestamp '2024-01-20 12:00:00' and (total_bytes is null or (total_bytes >= 1000 and total_bytes <= 8000))")
def snap_filter_multi(spark, sf):
    return brief(S.SnapshotFilter(hosts=("host1", "host2"), labels=("click", "view", "purchase"), after="2024-01-03", before="2024-01-20 12:00:00", size="1000..8k").apply(snapshots(spark, sf)))


@query(f"with {SNAP} select event_id, hostname, label from snap where (list_has_all(tags, ['k1', 'm1']) or list_has_all(tags, ['k2'])) and (tags = ['k1', 'm1'] or tags = ['k2', 'm0'])")
def snap_filter_tags(spark, sf):
    return brief(S.SnapshotFilter(tags=(("k1", "m1"), ("k2",)), tags_exact=(("k1", "m1"), ("k2", "m0"))).apply(snapshots(spark, sf)))


@query(f"with {SNAP} select event_id, hostname, label from snap where path in ('/home/1', '/home/2', '/home/17') and (data_added is null or data_added >= 100)")
def snap_filter_paths(spark, sf):
    return brief(S.SnapshotFilter(paths=(("/home/1",), ("/home/2",), ("/home/17",)), size_added="100..").apply(snapshots(spark, sf)))


@query(f"with {SNAP} select event_id, hostname, label from snap where k > 50 and contains(label, 'c')")
def snap_filter_expr(spark, sf):
    return brief(S.SnapshotFilter(expr="k > 50 and contains(label, 'c')").apply(snapshots(spark, sf)))


@query(f"with {SNAP} select event_id, hostname, label from snap where label = 'click' and cast(right(hostname, 1) as integer) % 2 = 1")
def udf_predicate(spark, sf):
    import pandas as pd

    @F.pandas_udf("boolean")
    def odd_hosts(host):
        return host.str[-1].astype(int) % 2 == 1

    odd_hosts.func.__annotations__ = {"host": pd.Series, "return": pd.Series}
    return brief(S.SnapshotFilter(labels=("click",), predicate=lambda df: odd_hosts("hostname")).apply(snapshots(spark, sf)))


@query(f"with {SNAP} select event_id, hostname, label from (select *, row_number() over (partition by hostname order by time desc, id desc) as n from snap) where n <= 3")
def snap_last_n(spark, sf):
    return brief(S.SnapshotFilter(last=3).apply(snapshots(spark, sf), ("hostname",)))


@query(f"with {SNAP}, r as (select *, row_number() over (order by time desc, id desc) as n from snap), h as (select *, row_number() over (partition by hostname order by time desc, id desc) as n from snap) "
       "select event_id, hostname, 'all' as scope from r where n = 3 union all select event_id, hostname, 'host' from h where n = 3")
def snap_latest_n(spark, sf):
    s = snapshots(spark, sf)
    return L.latest(s, 2).select("event_id", "hostname", F.lit("all").alias("scope")).unionByName(L.latest(s, 2, ("hostname",)).select("event_id", "hostname", F.lit("host").alias("scope")))


@query(f"with {SNAP}, m as (select id from snap order by time desc, id desc limit 1), one as (select event_id from snap where id like '6b86b273%'), l1 as (select event_id from snap order by time desc, id desc limit 1 offset 1), l0 as (select event_id from snap order by time desc, id desc limit 1) "
       "select event_id, cast(0 as integer) as position from l0 union all select event_id, 1 from one union all select event_id, 2 from l1 union all select event_id, 3 from one")
def point_lookup(spark, sf):
    return L.lookup(snapshots(spark, sf), ("latest", "6b86b273", "latest~1", "6b86b273")).select("event_id", "position")


@query(f"with {SNAP} select hostname, label, path as paths, count(*) as n from snap group by hostname, label, path union all select null, null, null, count(*) from snap")
def snap_group_counts(spark, sf):
    return L.group_counts(snapshots(spark, sf), ("hostname", "label", "paths"))


@query(f"with {SNAP} select hostname, count(*) as n from snap group by rollup(hostname)")
def snap_host_counts(spark, sf):
    return L.group_counts(snapshots(spark, sf), ("hostname",))


@query(f"""with {SNAP}, a as (select *, case when row_number() over w = 1 or lag(tree) over w <> tree then 1 else 0 end as new from snap window w as (partition by hostname order by time, id)),
b as (select *, sum(new) over (partition by hostname order by time, id rows unbounded preceding) as run from a)
select hostname, arg_min(event_id, struct_pack(t := time, i := id)) as first_event, min(tree) as tree, count(*) - 1 as more from b group by hostname, run""")
def snap_runs(spark, sf):
    s = snapshots(spark, sf)
    return L.collapse_runs(s, F.col("tree"), ("hostname",), ("time", "id", "event_id")).select("hostname", F.col("event_id").alias("first_event"), F.col("value").alias("tree"), "more")


@query(f"""with {SNAP}, h as (select page_id % 100 as slot, count(*) || ':' || sum(page_id) || ':' || max(page_id) as found from pages where page_id % 3 = 0 group by 1),
m as (select hostname, event_id, time, id, coalesce(found, '') as found from snap left join h on h.slot = snap.k // 4),
a as (select *, case when row_number() over w = 1 or lag(found) over w <> found then 1 else 0 end as new from m window w as (partition by hostname order by time, id)),
b as (select *, sum(new) over (partition by hostname order by time, id rows unbounded preceding) as run from a)
select hostname, arg_min(event_id, struct_pack(t := time, i := id)) as first_event, min(found) as found, count(*) - 1 as more from b group by hostname, run""")
def find_runs(spark, sf):
    hits = S.find_nodes(table(spark, sf, "pages").withColumn("path", F.lit("/page")), path="/page").where("page_id % 3 = 0")
    hits = hits.groupBy((F.col("page_id") % 100).alias("slot")).agg(F.concat_ws(":", F.count("*"), F.sum("page_id"), F.max("page_id")).alias("found"))
    found = snapshots(spark, sf).withColumn("slot", F.expr("k div 4")).join(hits, "slot", "left").withColumn("found", F.coalesce("found", F.lit("")))
    return L.collapse_runs(found, F.col("found"), ("hostname",), ("time", "id", "event_id")).select("hostname", F.col("event_id").alias("first_event"), F.col("value").alias("found"), "more")


@query("select page_id from pages where regexp_matches(url, '(?s)^https://.*/en/.*$') or regexp_matches(lower(regexp_extract(url, '([^/]*)$', 1)), '^[0-9]5.*$')")
def find_glob(spark, sf):
    return S.find_nodes(table(spark, sf, "pages").withColumnRenamed("url", "path"), globs=("https://*/en/*",), iglobs=("[0-9]5*",)).select("page_id")


@query(f"with {NODES} select doc_id, path from node where path = '/en/src1/00000003' or path = (select max(path) from node)")
def find_path(spark, sf):
    n = nodes(spark, sf)
    last = n.agg(F.max("path")).first()[0]
    return S.find_nodes(n, path="/en/src1/00000003").unionByName(S.find_nodes(n, path=last)).select("doc_id", "path").distinct()


@query(f"with {SNAP} select event_id, hostname, label from snap where path in ('/home/1', '/home/2')")
def snap_filter_paths_exact(spark, sf):
    return brief(S.SnapshotFilter(paths_exact=(("/home/1",), ("/home/2",))).apply(snapshots(spark, sf)))


# --- retention
def _keep(policy: K.KeepPolicy, df: DataFrame) -> DataFrame:
    return K.reasons(df, policy, ("hostname",)).join(df, "id").select("event_id", F.array_join("reasons", ",").alias("reasons"))


def _bucket_sql(rule: str, bucket: str, n: int) -> str:
    keep = "true" if n < 0 else f"b <= {n}"
    return f"""with {SNAP}, r as (select *, row_number() over (partition by hostname, {bucket} order by time desc, id desc) as n, dense_rank() over (partition by hostname order by {bucket} desc) as b from snap)
select event_id, '{rule}' as reasons from r where n = 1 and {keep}"""


_SQL_BUCKET = {"minutely": "date_trunc('minute', time)", "hourly": "date_trunc('hour', time)", "daily": "date_trunc('day', time)", "weekly": "date_trunc('week', time)", "monthly": "date_trunc('month', time)", "quarter_yearly": "date_trunc('quarter', time)",
               "half_yearly": "year(time) * 2 + case when month(time) <= 6 then 0 else 1 end", "yearly": "date_trunc('year', time)"}
for _p, _n in (("minutely", 7), ("hourly", 10), ("daily", 3), ("weekly", 2), ("monthly", -1), ("quarter_yearly", 4), ("half_yearly", 1), ("yearly", 1)):
    query(_bucket_sql(_p, _SQL_BUCKET[_p], _n), f"keep_{_p}")(lambda spark, sf, p=_p, n=_n: _keep(K.KeepPolicy(periods={p: n}), snapshots(spark, sf)))


@query(f"with {SNAP} select event_id, 'last' as reasons from (select *, row_number() over (partition by hostname order by time desc, id desc) as n from snap) where n <= 5")
def keep_last(spark, sf):
    return _keep(K.KeepPolicy(last=5), snapshots(spark, sf))


@query(f"""with {SNAP}, m as (select *, max(time) over (partition by hostname) as newest from snap), d as (select *, row_number() over (partition by hostname, date_trunc('day', time) order by time desc, id desc) as n from m where time > newest - interval 7 day)
select event_id, string_agg(reason, ',' order by o) as reasons from (select event_id, 'within' as reason, 1 as o from m where time > newest - interval 36 hour union all select event_id, 'within_daily', 2 from d where n = 1) group by event_id""")
def keep_within(spark, sf):
    return _keep(K.KeepPolicy(within="36 hours", within_periods={"daily": "7 days"}), snapshots(spark, sf))


@query(f"with {SNAP} select event_id, case when list_has_all(tags, ['k1', 'm1']) and (id like 'aa%' or id like 'b%') then 'tags,ids' when list_has_all(tags, ['k1', 'm1']) then 'tags' else 'ids' end as reasons from snap where list_has_all(tags, ['k1', 'm1']) or id like 'aa%' or id like 'b%'")
def keep_tags_ids(spark, sf):
    return _keep(K.KeepPolicy(tags=(("k1", "m1"),), ids=("aa", "b")), snapshots(spark, sf))


@query(f"""with {SNAP}, m as (select *, max(time) over (partition by hostname, label) as newest from snap), d as (select *, row_number() over (partition by hostname, label, date_trunc('day', time) order by time desc, id desc) as n from m where time > newest - interval 7 day)
select event_id, string_agg(reason, ',' order by o) as reasons from (select event_id, 'within' as reason, 1 as o from m where time > newest - interval 36 hour union all select event_id, 'within_daily', 2 from d where n = 1) group by event_id""")
def keep_within_labels(spark, sf):
    s = snapshots(spark, sf)
    out = K.reasons(s, K.KeepPolicy(within=X.interval("36h"), within_periods={"daily": X.interval("1 week")}), ("hostname", "label"))
    return out.join(s, "id").select("event_id", F.array_join("reasons", ",").alias("reasons"))


_FORGET = f"""{SNAP}, m as (select *, max(time) over (partition by hostname) as newest, row_number() over (partition by hostname order by time desc, id desc) as l,
  row_number() over (partition by hostname, date_trunc('day', time) order by time desc, id desc) as dn, dense_rank() over (partition by hostname order by date_trunc('day', time) desc) as db,
  row_number() over (partition by hostname, date_trunc('week', time) order by time desc, id desc) as wn, dense_rank() over (partition by hostname order by date_trunc('week', time) desc) as wb,
  coalesce(lag(tree) over (partition by hostname order by time, id) = tree, false) as same from snap),
p as (select *, concat_ws(',', case when l <= 2 then 'last' end, case when dn = 1 and db <= 3 then 'daily' end, case when wn = 1 and wb <= 4 then 'weekly' end, case when time > newest - interval 12 hour then 'within' end) as why from m),
f as (select *, delete_kind = 'never' or coalesce(delete_after > timestamp '{NOW}', false) as guarded, coalesce(delete_after <= timestamp '{NOW}', false) as expired from p)"""


@query(f"with {_FORGET} select event_id, case when guarded then true when expired then false else why <> '' end as keep, case when guarded then 'protected' when expired then 'expired' else why end as reasons from f")
def forget_plan(spark, sf):
    out = K.forget(snapshots(spark, sf), K.KeepPolicy(last=2, periods={"daily": 3, "weekly": 4}, within="12 hours"), ("hostname",), NOW)
    return out.select("event_id", "keep", F.array_join("reasons", ",").alias("reasons"))


@query(f"with {_FORGET} select event_id, case when guarded then true when expired then false when same then false else l <= 2 end as keep, case when guarded then 'protected' when expired then 'expired' when same then 'unchanged' when l <= 2 then 'last' else '' end as reasons from f")
def forget_unchanged(spark, sf):
    out = K.forget(snapshots(spark, sf), K.KeepPolicy(last=2, delete_unchanged=True), ("hostname",), NOW)
    return out.select("event_id", "keep", F.array_join("reasons", ",").alias("reasons"))


@query(f"""with {_FORGET.replace("partition by hostname", "partition by hostname, label")} select substring(id, 1, 8) as id, strftime(time, '%Y-%m-%d %H:%M:%S') as time, hostname, label, array_to_string(tags, chr(10)) as tags, path as paths,
  coalesce(cast(total_files_processed as varchar), '?') as files, coalesce(cast(total_dirs_processed as varchar), '?') as dirs, case when total_bytes is null then '?' else {_human('total_bytes')} end as size,
  case when guarded or (not expired and why <> '') then 'keep' else 'remove' end as action, case when guarded then 'protected' when expired then 'expired' else replace(why, ',', chr(10)) end as reason from f""")
def forget_listing(spark, sf):
    return K.forget_rows(K.forget(snapshots(spark, sf), K.KeepPolicy(last=2, periods={"daily": 3, "weekly": 4}, within="12 hours"), ("hostname", "label"), NOW))


@query(f"with {_FORGET} select event_id, guarded as keep, case when guarded then 'keep' else 'remove' end as action from f where event_id % 10 = 0")
def forget_ids(spark, sf):
    s = snapshots(spark, sf)
    return K.forget_ids(s, s.where("event_id % 10 = 0").select("id"), NOW).select("event_id", "keep", F.when(F.col("keep"), "keep").otherwise("remove").alias("action"))


@query(f"""with {SNAP}, r as (select *, row_number() over (partition by hostname, date_trunc('day', time) order by time desc, id desc) as dn, dense_rank() over (partition by hostname order by date_trunc('day', time) desc) as db,
  row_number() over (partition by hostname order by time desc, id desc) as l from snap where hostname <> 'host0' and time > timestamp '2024-01-05 23:59:59.999999' and (total_bytes is null or total_bytes >= 500)),
k as (select hostname, case when delete_kind = 'never' or coalesce(delete_after > timestamp '{NOW}', false) then true when coalesce(delete_after <= timestamp '{NOW}', false) then false else l <= 2 or (dn = 1 and db <= 3) end as keep from r)
select hostname, count(*) filter (keep) as kept, count(*) filter (not keep) as removed from k group by hostname""")
def forget_counts(spark, sf):
    chosen = S.SnapshotFilter(after="2024-01-05", size="500", expr="hostname <> 'host0'").apply(snapshots(spark, sf))
    plan = K.forget(chosen, K.KeepPolicy(last=2, periods={"daily": 3}), ("hostname",), NOW)
    return plan.groupBy("hostname").agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("removed"))


# --- diff
_CLS = """case when a.path is null then '+' when b.path is null then '-' when a.node_type <> b.node_type then 'T' {content} {meta} else '=' end"""
_CONTENT, _META = "when a.node_type = 'file' and a.content is distinct from b.content then 'M'", "when a.size is distinct from b.size or a.mode is distinct from b.mode or a.mtime is distinct from b.mtime then 'U'"


def _diff_sql(content: str = _CONTENT, meta: str = _META) -> str:
    return f"with {NODES}, d as (select coalesce(a.path, b.path) as path, coalesce(b.node_type, a.node_type) as kind, {_CLS.format(content=content, meta=meta)} as cls from v1 a full join v2 b on a.path = b.path)"


@query(_diff_sql() + " select path, cls from d where cls <> '='")
def diff_rows(spark, sf):
    return D.diff(nodes_v1(spark, sf), nodes_v2(spark, sf)).where("cls <> '='").select("path", "cls")


@query(_diff_sql() + " select case when cls = 'T' then 'type' else kind end as kind, cls, count(*) as n from d group by 1, 2")
def diff_stats(spark, sf):
    return D.stats(D.diff(nodes_v1(spark, sf), nodes_v2(spark, sf)))


@query(_diff_sql(content="") + " select case when cls = 'T' then 'type' else kind end as kind, cls, count(*) as n from d group by 1, 2")
def diff_no_content(spark, sf):
    return D.stats(D.diff(nodes_v1(spark, sf), nodes_v2(spark, sf), content=D.ignore_content))


@query(_diff_sql(meta="") + " select case when cls = 'T' then 'type' else kind end as kind, cls, count(*) as n from d group by 1, 2")
def diff_metadata(spark, sf):
    return D.stats(D.diff(nodes_v1(spark, sf), nodes_v2(spark, sf), metadata=False))


@query(f"with {NODES} select count(*) as checked, cast(sum(case when a.content <> b.content then 1 else 0 end) as bigint) as changed from v1 a join v2 b on a.path = b.path where a.node_type = 'file' and b.node_type = 'file' and a.size = b.size and a.mode = b.mode")
def diff_bitrot(spark, sf):
    return D.bit_rot(nodes_v1(spark, sf), nodes_v2(spark, sf), ("size", "mode")).agg(F.count("*").alias("checked"), F.count_if("changed").alias("changed"))


@query(_diff_sql() + " select regexp_extract(path, '([^/]*)$', 1) as name, cls from d where path like '/en/src3/%'")
def dir_diff(spark, sf):
    side = lambda df: df.where(X.parent_path("path") == "/en/src3").withColumn("name", X.file_name("path")).drop("path")
    return D.diff(side(nodes_v1(spark, sf)), side(nodes_v2(spark, sf)), key="name").select("name", "cls")


# --- trees
@query(f"with {NODES} select cast(sum(case when node_type = 'dir' then 1 else 0 end) as bigint) as dirs, cast(sum(case when node_type <> 'dir' then 1 else 0 end) as bigint) as files, cast(sum(case when node_type = 'file' then size else 0 end) as bigint) as size from v2")
def ls_summary(spark, sf):
    return T.listing_summary(nodes_v2(spark, sf))


@query(f"with {NODES}, p as (select string_split(path, '/') as s, size from node), a as (select array_to_string(s[1:i], '/') as dir, size from p, unnest(range(1, len(s))) as t(i)) select dir, count(*) as files, cast(sum(size) as bigint) as size, cast(0 as bigint) as dirs from a group by dir")
def tree_rollup(spark, sf):
    return T.roll_up(nodes(spark, sf))


@query(f"with {NODES}, p as (select path, string_split(path, '/') as s from node), q as (select path from p union select array_to_string(s[1:i], '/') from p, unnest(range(2, len(s))) as t(i)), r as (select string_split(path, '/') as s from q) select array_to_string(s[1:i], '/') as dir, count(*) as n from r, unnest(range(1, len(s))) as t(i) group by 1")
def tree_descendants(spark, sf):
    return T.descendants(nodes(spark, sf))


def _identity_sql() -> str:
    """The bottom-up hash of three levels: entries of a directory in parts by their names' hashes, then the parts."""
    out, below = [], "select regexp_replace(path, '/[^/]*$', '') as dir, regexp_extract(path, '([^/]*)$', 1) as name, '|file|' || content as rest from node"
    for level in (3, 2, 1):
        out.append(f"""p{level} as (select dir, substring(sha256(name), 1, 2) as part, sha256(string_agg(name || rest, chr(10) order by name || rest)) as own from ({below}) group by 1, 2),
l{level} as (select dir, sha256(string_agg(own, chr(10) order by part)) as id from p{level} group by dir)""")
        below = f"select regexp_replace(dir, '/[^/]*$', '') as dir, regexp_extract(dir, '([^/]*)$', 1) as name, '|dir|' || id as rest from l{level}"
    return f"with {NODES}, {', '.join(out)} select * from l3 union all select * from l2 union all select * from l1"


@query(_identity_sql())
def tree_identity(spark, sf):
    return T.identities(nodes(spark, sf))


@query(f"with {NODES} select path from node where path like '/en/src1/%' and not regexp_matches(path, '^.*7$')")
def ls_directory(spark, sf):
    return T.listing(nodes(spark, sf), "/en/src1", recursive=False, globs=("!*7",)).select("path")


@query(f"with {SNAP}, {NODES}, n as (select s.event_id, v.path, v.size from snap s join v1 v on s.event_id % 5 = v.doc_id % 5 where s.event_id < 5) select path, size from n where event_id = 3 and path = (select max(path) from v1 where doc_id % 5 = 3)")
def node_lookup(spark, sf):
    s = snapshots(spark, sf)
    few = s.where("event_id < 5").select(F.col("id").alias("snapshot_id"), (F.col("event_id") % 5).alias("part"))  # five trees, that all documents are dealt to
    trees = nodes_v1(spark, sf).withColumn("part", F.col("doc_id") % 5).join(few, "part")
    path = nodes_v1(spark, sf).where("doc_id % 5 = 3").agg(F.max("path")).first()[0]
    found = s.where("event_id = 3").select("id").first()[0]
    return readers.node_at(s, trees, f"{found}:{path}").select("path", "size")


@query("select 'root/' || r_name as path from region union all select 'root/' || r_name || '/' || n_name from region join nation on n_regionkey = r_regionkey union all select 'root/' || r_name || '/' || n_name || '/' || c_name from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey")
def recursive_ls(spark, sf):
    r, n, c = (table(spark, sf, t) for t in ("region", "nation", "customer"))
    children = r.select(F.lit("R").alias("tree"), F.col("r_name").alias("name"), F.concat(F.lit("r"), "r_regionkey").alias("subtree")) \
        .unionByName(n.select(F.concat(F.lit("r"), "n_regionkey").alias("tree"), F.col("n_name").alias("name"), F.concat(F.lit("n"), "n_nationkey").alias("subtree"))) \
        .unionByName(c.select(F.concat(F.lit("n"), "c_nationkey").alias("tree"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("subtree")))
    roots = spark.createDataFrame([("R", "root")], "tree string, path string")
    return T.recursive_listing(children, roots).select("path")


@query(f"with {NODES} select path, case when regexp_matches(path, '^/en/src1.*$') then true when regexp_matches(path, '^/en/.*$') then false else true end as included from node")
def excludes(spark, sf):
    return nodes(spark, sf).select("path", S.not_excluded("path", ("!/en/*", "/en/src1*")).alias("included"))


@query(f"with {NODES} select path from node where size <= 5000")
def size_limit(spark, sf):
    return nodes(spark, sf).where(S.not_larger_than(5000)).select("path")


@query(f"with {NODES} select path from node where not (path like '/en/src1/%' and right(path, 1) = '7') and not (path like '/fr/%' and right(path, 2) <> '12')")
def ignore_files(spark, sf):
    files = spark.createDataFrame([("/en/src1/.gitignore", "# odd ones\n*7\n"), ("/.gitignore", "/fr/*/*\n"), ("/fr/.gitignore", "!*12\n")], "path string, content string")
    return S.without_ignored(nodes(spark, sf), S.ignore_rules(files)).select("path")


@query(f"with {NODES}, m as (select distinct regexp_replace(path, '/[^/]*$', '') as dir from node where regexp_extract(path, '([^/]*)$', 1) = '00000007') select path from node where not exists (select 1 from m where starts_with(node.path, m.dir || '/'))")
def exclude_marker(spark, sf):
    return S.without_marked_directories(nodes(spark, sf), "00000007").select("path")


# --- blobs and packs
@query(f"with {BLOBS} select doc_id, pos, blob_id, len from blob")
def blob_chunks(spark, sf):
    return blobs(spark, sf).select("doc_id", "pos", "blob_id", "len")


@query(f"with {BLOBS}, d as (select blob_id, max(len) as len, sum(len) as all_len, count(*) as n from blob group by blob_id) select count(*) as blobs, cast(sum(n) as bigint) as occurrences, cast(sum(len) as bigint) as unique_bytes, cast(sum(all_len) as bigint) as total_bytes, round(sum(len) / sum(all_len)::double, 6) as ratio from d")
def blob_dedup_sizes(spark, sf):
    return B.sizes(blobs(spark, sf))


@query(f"with {BLOBS}, l as (select blob_id, max(len) as len from blob where doc_id % 7 <> 0 group by 1), r as (select blob_id, max(len) as len from blob where doc_id % 11 <> 0 group by 1) select case when r.blob_id is null then 'left' when l.blob_id is null then 'right' else 'shared' end as side, count(*) as blobs, cast(sum(coalesce(l.len, r.len)) as bigint) as bytes from l full join r on l.blob_id = r.blob_id group by 1")
def blob_shared_exclusive(spark, sf):
    b = blobs(spark, sf)
    return B.shared_exclusive(b.where("doc_id % 7 <> 0"), b.where("doc_id % 11 <> 0"))


@query(f"with {BLOBS}, {INDEX} select distinct blob_id from blob where blob_id not in (select blob_id from idx where pack_id <> '0a')")
def check_missing(spark, sf):
    return B.missing(blobs(spark, sf), index(spark, sf).where("pack_id <> '0a'"))


@query(f"with {BLOBS}, {INDEX} select b.doc_id, b.pos, i.pack_id, i.blob_id is null as lost from blob b left join (select * from idx where pack_id <> '0a') i on i.blob_id = b.blob_id")
def blob_lookup(spark, sf):
    i = index(spark, sf).where("pack_id <> '0a'").select("blob_id", "pack_id")
    return B.locate(blobs(spark, sf).select("doc_id", "pos", "blob_id"), i).select("doc_id", "pos", "pack_id", F.col("pack_id").isNull().alias("lost"))


@query(f"with {BLOBS}, {INDEX} select count(*) as blobs, cast(sum(len) as bigint) as stored, cast(sum(case when blob_id < '8' then len * 2 else len end) as bigint) as uncompressed from idx where blob_id in (select blob_id from blob where doc_id % 7 <> 0)")
def stored_sizes(spark, sf):
    entries = readers.index_entries(nested_index(spark, sf))
    return B.stored_sizes(blobs(spark, sf).where("doc_id % 7 <> 0"), entries)


@query(f"with {BLOBS}, {INDEX} select blob_id from blob where (doc_id % 13 = 0 or blob_id in (select b.blob_id from blob b where b.doc_id % 13 = 0)) and cast('0x' || substring(blob_id, 1, 8) as bigint) % 2 = 0 and doc_id % 13 = 0")
def check_data(spark, sf):
    damaged = blobs(spark, sf).withColumn("chunk", F.when(F.col("doc_id") % 13 == 0, F.concat("chunk", F.lit("!"))).otherwise(F.col("chunk")))
    return B.check_content(damaged, subset="1/2")


@query(f"with {BLOBS}, {INDEX}, o as (select blob_id, len, sum(len) over (order by blob_id rows unbounded preceding) as upto from idx where cast('0x' || substring(blob_id, 1, 8) as bigint) < cast(floor(0.25 * 4294967296) as bigint)) select blob_id from o")
def read_share(spark, sf):
    return index(spark, sf).where(S.in_share("blob_id", 25)).select("blob_id")


@query(f"with {SNAP}, t as (select distinct doc_id % 25 as tree, blob_id from (select doc_id, sha256(substring(text, 1, 1000)) as blob_id from documents where length(text) > 0)) select distinct t.blob_id from t join snap on snap.tree = 't' || t.tree where event_id % 40 <> 0 and k >= 50")
def live_ignoring(spark, sf):
    content = blobs(spark, sf).where("pos = 0").select(F.concat(F.lit("t"), F.col("doc_id") % 25).alias("tree"), "blob_id")
    s = snapshots(spark, sf).where("k >= 50")
    return B.live_blobs(s, content, ignored=s.where("event_id % 40 = 0"))


_USAGE = f"{BLOBS}, {INDEX}, {LIVE}, u as (select pack_id, count(live.blob_id) as used_blobs, count(*) - count(live.blob_id) as unused_blobs, cast(sum(case when live.blob_id is not null then len else 0 end) as bigint) as used_bytes, cast(sum(case when live.blob_id is null then len else 0 end) as bigint) as unused_bytes from idx left join live on live.blob_id = idx.blob_id group by pack_id)"


@query(f"with {_USAGE} select *, case when used_blobs = 0 then 'remove' when unused_blobs > 0 then 'repack' else 'keep' end as action from u")
def prune_plan(spark, sf):
    return B.prune_plan(index(spark, sf), live(spark, sf))


@query(f"with {_USAGE}, p as (select *, sum(used_bytes) over (order by unused_bytes / (unused_bytes + used_bytes)::double desc, pack_id rows unbounded preceding) as spent from u where used_blobs > 0 and unused_blobs > 0) "
       "select pack_id, case when spent <= 50000 then 'repack' else 'keep-budget' end as action from p union all select pack_id, case when used_blobs = 0 then 'remove' else 'keep' end from u where used_blobs = 0 or unused_blobs = 0")
def prune_budget(spark, sf):
    return B.prune_plan(index(spark, sf), live(spark, sf), max_repack=50_000).select("pack_id", "action")


_DECIDE = f"""{_USAGE}, {marked_sql(NOW)}, pk as (select pack_id, max(marked_at) as marked_at, max(pack_time) as pack_time from midx group by pack_id),
d0 as (select u.*, case when marked_at is not null then case when used_blobs > 0 then 'recover' when marked_at <= timestamp '{NOW}' - interval 23 hour then 'delete' else 'keep-marked' end
  when pack_time > timestamp '{NOW}' - interval 7 day or unused_blobs = 0 then 'keep' when used_blobs = 0 then 'mark' else 'repack' end as first_action from u join pk on pk.pack_id = u.pack_id),
d1 as (select pack_id, sum(used_bytes) over w as spent, sum(unused_bytes) over w as freed, unused_bytes as own, sum(unused_bytes) over () as total from d0 where first_action = 'repack' window w as (order by unused_bytes / (unused_bytes + used_bytes)::double desc, pack_id rows unbounded preceding)),
dec as (select d0.*, case when first_action = 'repack' and not (spent <= 400000 and total - freed + own > 3000) then 'keep' else first_action end as action from d0 left join d1 on d1.pack_id = d0.pack_id)"""


def _decisions(spark, sf):
    return B.prune_decisions(marked_index(spark, sf, NOW), live(spark, sf), NOW, keep_pack="7 days", max_repack=400_000, max_unused=3_000)


@query(f"with {_DECIDE} select pack_id, used_blobs, unused_blobs, used_bytes, unused_bytes, action from dec")
def prune_decisions(spark, sf):
    return _decisions(spark, sf)


_UNMARKED = "action not in ('recover', 'delete', 'keep-marked')"
_TOTALS = ", ".join(f"cast(coalesce(sum({c}_{w}) filter ({when}), 0) as bigint) as {n}_{w}" for w in ("blobs", "bytes") for c, when, n in (("used", "true", "used"), ("unused", _UNMARKED, "unused"), ("used", "action = 'repack'", "repack"), ("unused", "action = 'repack'", "repackrm"), ("unused", "action in ('mark', 'remove')", "remove")))


@query(f"""with {_DECIDE}, t as (select {_TOTALS}, {", ".join(f"count(*) filter (action = '{a}') as packs_{a.replace('-', '_')}" for a in ("keep", "repack", "mark", "remove", "delete", "recover", "keep-marked"))} from dec),
n as (select cast(count(*) as bigint) as packs_unref, cast(coalesce(sum(size), 0) as bigint) as size_unref from (select 'zz' || r_regionkey as pack_id, r_regionkey * 100 as size from region))
select *, used_bytes + unused_bytes - repackrm_bytes - remove_bytes as remaining_bytes, unused_bytes - repackrm_bytes - remove_bytes as unused_after_bytes,
  round((unused_bytes - repackrm_bytes - remove_bytes) * 100.0::double / (used_bytes + unused_bytes - repackrm_bytes - remove_bytes), 2) as unused_percent from t, n""")
def prune_stats(spark, sf):
    stray = table(spark, sf, "region").select(F.concat(F.lit("zz"), "r_regionkey").alias("pack_id"), (F.col("r_regionkey") * 100).cast("long").alias("size"))
    known = index(spark, sf).groupBy("pack_id").agg(F.sum("len").alias("size"))
    return B.prune_statistics(_decisions(spark, sf), known.unionByName(stray))


@query(f"with {_DECIDE}, r as (select distinct pack_id from dec where action = 'repack') select pack_id, cast((row_number() over (order by pack_id) - 1) // 10 as bigint) as batch from r")
def packs_to_warm(spark, sf):
    return B.packs_needed(_decisions(spark, sf).where("action = 'repack'"), batch=10)


@query(f"with {BLOBS}, {INDEX}, p as (select pack_id, blob_type, cast(sum(len) as bigint) as size from idx group by 1, 2) select blob_type, count(*) as packs, min(size) as smallest, max(size) as largest from p group by blob_type")
def pack_stats(spark, sf):
    return V.pack_sizes(index(spark, sf).withColumnRenamed("len", "length"))


@query(f"with {BLOBS}, d as (select blob_id, max(len) as len from blob group by 1), r as (select *, coalesce(sum(len) over (partition by substring(blob_id, 1, 4) order by blob_id rows between unbounded preceding and 1 preceding), 0) as before from d) select blob_id, substring(blob_id, 1, 4) || '-' || cast(cast(before as bigint) // 40000 as varchar) as pack_id from r")
def pack_assembly(spark, sf):
    return B.assemble_packs(blobs(spark, sf), 40_000, spread=4).select("blob_id", "pack_id")


@query(f"with {BLOBS}, {INDEX} select blob_type, blob_id, pack_id, len as length, cast(case when blob_id < '8' then len * 2 else 0 end as bigint) as uncompressed_length from idx")
def list_index(spark, sf):
    return readers.index_entries(nested_index(spark, sf)).select("blob_type", "blob_id", "pack_id", "length", "uncompressed_length")


@query(f"with {BLOBS}, {INDEX} select blob_id from idx where cast('0x' || substring(blob_id, 1, 8) as bigint) % 7 = 2")
def read_subset(spark, sf):
    return index(spark, sf).where(S.in_part("blob_id", 3, 7)).select("blob_id")


@query("select doc_id, substring(text, 951, 200) as data from documents where length(text) > 950")
def byte_range(spark, sf):
    return B.byte_range(blobs(spark, sf), 950, 200, "doc_id")


@query("select doc_id, text as preview from documents where text is not null and octet_length(encode(text)) <= 1000000")
def file_preview(spark, sf):
    return V.preview(table(spark, sf, "documents").where("octet_length(text) <= 1000000"), "doc_id")


@query()
def cdc_chunks(spark, sf):
    return B.rolling_chunks(table(spark, sf, "documents"), "doc_id", "text")


@query(f"with {BLOBS}, {INDEX}, c as (select blob_id from idx where blob_id < 'c'), h as (select blob_id from idx where blob_id > '4') select coalesce(c.blob_id, h.blob_id) as id, case when h.blob_id is null then 'missing in hot' else 'missing in cold' end as state from c full join h on c.blob_id = h.blob_id where c.blob_id is null or h.blob_id is null")
def hot_cold(spark, sf):
    i = index(spark, sf).select(F.col("blob_id").alias("id"))
    return P.compare_tiers(i.where("id < 'c'"), i.where("id > '4'"))


@query(f"with {BLOBS}, {INDEX}, p as (select distinct pack_id from idx where pack_id > '10'), i as (select distinct pack_id from idx where pack_id < 'f0') select coalesce(p.pack_id, i.pack_id) as pack_id, case when p.pack_id is null then 'drop' when i.pack_id is null then 'add' else 'keep' end as action from p full join i on p.pack_id = i.pack_id")
def repair_index(spark, sf):
    i = index(spark, sf)
    return P.repair_index(i.where("pack_id > '10'"), i.where("pack_id < 'f0'"))


@query(f"with {NODES}, {BLOBS}, {INDEX}, lost as (select doc_id, count(*) as lost from blob where blob_id not in (select blob_id from idx where pack_id <> '0a') group by doc_id) select n.path, coalesce(l.lost, 0) as lost, case when l.lost > 0 then n.path || '.repaired' else n.path end as new_path from node n left join lost l on l.doc_id = n.doc_id")
def repair_snapshots(spark, sf):
    n = nodes(spark, sf)
    content = blobs(spark, sf).select("doc_id", "blob_id").join(n.select("doc_id", "path"), "doc_id").select("path", "blob_id")
    return P.repair_nodes(n, content, index(spark, sf).where("pack_id <> '0a'")).select("path", "lost", "new_path")


# --- reports
@query("select coalesce(l_returnflag, 'Total') as file_type, count(*) as files, cast(sum(cast(round(l_quantity) as bigint)) as bigint) as size from lineitem group by rollup(l_returnflag)")
def repoinfo_files(spark, sf):
    f = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("file_type"), F.round("l_quantity").cast("long").alias("size"))
    return R.with_total(f, "file_type", [F.count("*").alias("files"), F.sum("size").alias("size")])


@query(f"with {BLOBS}, {INDEX} select coalesce(blob_type, 'Total') as blob_type, count(*) as blobs, cast(sum(len) as bigint) as size from idx group by rollup(blob_type) having count(*) > 0")
def repoinfo_index(spark, sf):
    return R.with_total(index(spark, sf), "blob_type", [F.count("*").alias("blobs"), F.sum("len").alias("size")]).where("blobs > 0")


@query(f"with {SNAP} select substring(id, 1, 8) || case when k % 4 > 0 then ' (+' || (k % 4) || ')' else '' end as id, strftime(time, '%Y-%m-%d %H:%M:%S') as time, hostname, label, array_to_string(tags, chr(10)) as tags, path as paths, "
       f"coalesce(cast(total_files_processed as varchar), '?') as files, coalesce(cast(total_dirs_processed as varchar), '?') as dirs, case when total_bytes is null then '?' else {_human('total_bytes')} end as size from snap")
def snap_listing(spark, sf):
    return R.snapshot_listing(snapshots(spark, sf).withColumn("more", F.col("k") % 4))


@query(f"with {SNAP} select hostname, bool_or(k > 90) as any_marked, bool_or(k <= 90) as any_unmarked, cast(sum(case when label = 'click' then 1 else 0 end) as bigint) as to_forget, case when count(distinct label) = 1 then min(label) else '' end as common_label, cast(max(len(tags)) as integer) as most_tags from snap group by hostname")
def snap_flags(spark, sf):
    return R.group_flags(snapshots(spark, sf), ["hostname"], {"any_marked": F.col("k") > 90, "any_unmarked": F.col("k") <= 90}, ["label"], {"to_forget": F.col("label") == "click"}, {"most_tags": "tags"})


@query(f"with {SNAP} select event_id, '/' || hostname || case when label is null then '' else '/' || label end || '/' || strftime(time, '%Y-%m-%d_%H-%M-%S') as path, row_number() over (partition by hostname order by time desc, id desc) = 1 as latest, coalesce(lag(tree) over (partition by hostname order by time, id) = tree, false) as identical from snap")
def vfs_paths(spark, sf):
    return R.marked_paths(snapshots(spark, sf), "/[{hostname}]/[{label}]/{time}", ["hostname"]).select("event_id", "path", "latest", "identical")


def _details_sql() -> str:
    stamp = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
    told = lambda v: f"case when total_bytes is not null then {v} end"
    counts = lambda kind: f"printf('new: %10d / changed: %10d / unchanged: %10d', {kind}_new, {kind}_changed, {kind}_unmodified)"
    blobs = lambda name, n, raw, packed: f"printf('{name}%10d blobs / raw: %10s / packed: %10s', {n}, {_human(raw)}, {_human(packed)})"
    seconds = "case when k = 0 then '0s' else concat_ws(' ', case when k // 60 > 0 then (k // 60) || 'm' end, case when k % 60 > 0 then (k % 60) || 's' end) end"
    rows = [("Snapshot", "id"), ("Original ID", "cast(null as varchar)"), ("Time", stamp("time")), ("Generated by", "''"), ("Host", "hostname"), ("Label", "coalesce(label, '')"), ("Tags", "array_to_string(tags, chr(10))"),
            ("Delete", f"case delete_kind when 'never' then 'never' when 'after' then 'after ' || {stamp('delete_after')} else 'not set' end"), ("Paths", "path"), ("Parent", "'no parent snapshot'"),
            ("Source", told(f"printf('files: %d / dirs: %d / size: ', total_files_processed, total_dirs_processed) || {_human('total_bytes')}")), ("Files", told(counts("files"))), ("Dirs", told(counts("dirs"))),
            ("Added to repo", told(f"{blobs('data:  ', 'data_blobs', 'data_added_files', 'data_added_files_packed')} || chr(10) || {blobs('tree:  ', 'tree_blobs', 'data_added_trees', 'data_added_trees_packed')} || chr(10) || {blobs('total: ', 'tree_blobs + data_blobs', 'data_added', 'data_added_packed')}")),
            ("Duration", told(f"'backup start: ' || {stamp('backup_start')} || ' / backup end: ' || {stamp('backup_end')} || ' / backup duration: ' || {seconds} || chr(10) || 'total duration: ' || {seconds}"))]
    return f"with {SNAP}, d as ({' union all '.join(f'select id, cast({i} as integer) as position, {chr(39)}{t}{chr(39)} as title, {v} as value from snap' for i, (t, v) in enumerate(rows))}) select * from d where value is not null"


@query(_details_sql())
def snap_details(spark, sf):
    return V.snapshot_details(snapshots(spark, sf))


@query(f"with {SNAP} select event_id, least(event_id / 5000.0::double, 1.0) as share, case when event_id > 0 then cast(floor(60 * (5000 - event_id) / event_id::double) as bigint) end as remaining from snap")
def progress(spark, sf):
    share, rest = V.progress(F.col("event_id"), F.lit(5000), F.lit(60))
    return snapshots(spark, sf).select("event_id", share.alias("share"), rest.alias("remaining"))


@query(f"with {SNAP}, s as (select hostname, label, k, case when k > 90 then 'marked' when k > 60 then 'modified' when label = 'click' then 'filter' else 'all' end as view from snap) select view, count(*) as n, cast(sum(k) as bigint) as total from s group by view having count(*) > 0")
def snap_views(spark, sf):
    seen = R.snapshot_views(snapshots(spark, sf), F.col("k") > 90, F.col("k") > 60, F.col("label") == "click")
    return seen.groupBy("view").agg(F.count("*").alias("n"), F.sum("k").alias("total")).where("n > 0")


@query(f"with {NODES}, e as (select string_split(path, '/') as s, size from node where starts_with(path, '/en/')) select s[3] as name, 'dir' as kind, count(*) as files, cast(sum(size) as bigint) as size from e group by 1")
def browse_directory(spark, sf):
    return V.browse(nodes(spark, sf), "/en")


@query(f"with {NODES} select path, node_type, size, mode, cast(0 as bigint) as uid, cast(0 as bigint) as gid, mtime, cast(1 as bigint) as links from v2")
def node_attributes(spark, sf):
    return V.attributes(nodes_v2(spark, sf), F.lit(0).cast("long"))


@query(f"with {SNAP} select s.event_id, p.page_id from snap s left join (select page_id from pages where page_id % 7 = 0) p on p.page_id = s.event_id")
def find_misses(spark, sf):
    hits = table(spark, sf, "pages").where("page_id % 7 = 0").select(F.col("page_id").alias("id"), "page_id")
    return V.find_results(snapshots(spark, sf).select(F.col("event_id").alias("id")), hits, show_misses=True).select(F.col("id").alias("event_id"), "page_id")


@query(f"with {BLOBS}, {INDEX} select pack_id, blob_type, cast(sum(len) as bigint) as size, '' as time from idx group by 1, 2")
def pack_listing(spark, sf):
    return V.pack_listing(index(spark, sf).withColumnRenamed("len", "length"))


@query(f"with {BLOBS}, {INDEX}, t as (select *, blob_type || case when pack_id < '20' then ' to delete' else '' end as kind from idx) select coalesce(kind, 'Total') as kind, count(*) as blobs, cast(sum(len) as bigint) as data_size, cast(sum(len // 2) as bigint) as packed_size from t group by rollup(kind)")
def index_totals(spark, sf):
    return V.index_totals(index(spark, sf).select("blob_type", F.col("len").alias("data_length"), F.expr("len div 2").alias("length"), (F.col("pack_id") < "20").alias("to_delete")))


@query(f"with {NODES}, d as (select string_split(coalesce(a.path, b.path), '/')[3] as name, a.size as left_size, b.size as right_size from (select * from v1 where starts_with(path, '/en/')) a full join (select * from v2 where starts_with(path, '/en/')) b on a.path = b.path) select name, cast(coalesce(sum(left_size), 0) as bigint) as left_size, cast(coalesce(sum(right_size), 0) as bigint) as right_size from d group by name")
def browse_diff(spark, sf):
    left, right = (V.browse(n, "/en").select("name", F.col("size").alias(f"{side}_size")) for n, side in ((nodes_v1(spark, sf), "left"), (nodes_v2(spark, sf), "right")))
    return left.join(right, "name", "full").select("name", F.coalesce("left_size", F.lit(0)).alias("left_size"), F.coalesce("right_size", F.lit(0)).alias("right_size"))


# --- plans
@query(f"with {SNAP} select event_id, case when event_id % 3 = 0 then 'existing' else 'to copy' end as status from snap")
def copy_plan(spark, sf):
    s = snapshots(spark, sf)
    return P.copy_plan(s, s.where("event_id % 3 = 0").select("original")).select("event_id", F.when(F.col("relevant"), "to copy").otherwise("existing").alias("status"))


@query(f"with {SNAP} select s.event_id, p.event_id as parent_event, coalesce(p.tree = s.tree, false) as identical from (select *, lag(id) over (partition by hostname, label order by time, id) as parent from snap) s left join snap p on p.id = s.parent")
def parent_diff(spark, sf):
    s = L.with_parent(snapshots(spark, sf), ("hostname", "label"))
    p = s.select(F.col("id").alias("parent"), F.col("event_id").alias("parent_event"), F.col("tree").alias("parent_tree"))
    return s.join(p, "parent", "left").select("event_id", "parent_event", F.coalesce(F.col("parent_tree") == F.col("tree"), F.lit(False)).alias("identical"))


_STATES = f"""{NODES}, {BLOBS}, {INDEX}, st as (select b.*, case when a.path is null then 'new' when a.node_type = b.node_type and a.size = b.size and a.mtime = b.mtime then 'unmodified' else 'changed' end as state from v2 b left join v1 a on a.path = b.path),
ad as (select i.blob_type, i.len, i.len // 2 as packed from idx i where blob_id in (select blob_id from blob where doc_id % 11 <> 0) and blob_id not in (select blob_id from blob where doc_id % 7 <> 0))"""
_BLOBS_OF = {"data_blobs": "count(*) filter (blob_type = 'data')", "tree_blobs": "count(*) filter (blob_type = 'tree')", "data_added": "coalesce(sum(len), 0)", "data_added_packed": "coalesce(sum(packed), 0)",
             "data_added_files": "coalesce(sum(len) filter (blob_type = 'data'), 0)", "data_added_files_packed": "coalesce(sum(packed) filter (blob_type = 'data'), 0)", "data_added_trees": "coalesce(sum(len) filter (blob_type = 'tree'), 0)",
             "data_added_trees_packed": "coalesce(sum(packed) filter (blob_type = 'tree'), 0)"}
_MEASURES = {f"{k}_{s}": (f"count(*) filter (node_type {o} 'dir' and state = '{s}')", "st") for k, o in (("files", "<>"), ("dirs", "=")) for s in ("new", "changed", "unmodified")} | {
    "total_files_processed": ("count(*) filter (node_type <> 'dir')", "st"), "total_bytes_processed": ("coalesce(sum(size) filter (node_type <> 'dir'), 0)", "st"), "total_dirs_processed": ("count(*) filter (node_type = 'dir')", "st"),
    "total_dirsize_processed": ("coalesce(sum(size) filter (node_type = 'dir'), 0)", "st")} | {k: (v, "ad") for k, v in _BLOBS_OF.items()}


@query(f"with {SNAP} select s.event_id, case when p.id is null then [] else [p.id] end as parents from (select *, lag(id) over (partition by hostname, label order by time, id) as parent from snap) s left join snap p on p.id = s.parent")
def parent_choice(spark, sf):
    return L.choose_parents(snapshots(spark, sf), ("hostname", "label")).select("event_id", "parents")


@query(f"with {_STATES} " + " union all ".join(f"select '{name}' as metric, cast({sql} as double) as value from {of}" for name, (sql, of) in _MEASURES.items()))
def backup_summary(spark, sf):
    content = blobs(spark, sf).where("doc_id % 11 <> 0").select("blob_id").join(index(spark, sf), "blob_id").select("blob_id", "blob_type", F.col("len").alias("length"), F.expr("len div 2").alias("packed_length"))
    added = P.new_blobs(content, blobs(spark, sf).where("doc_id % 7 <> 0"))
    return P.metrics(P.backup_summary(P.file_states(nodes_v2(spark, sf), nodes_v1(spark, sf)), added), P.COUNTS)


@query(f"with {SNAP} " + " union all ".join(f"select id, 'backup_{name}' as metric, cast({sql} as double) as value from snap where total_bytes is not null" for name, sql in
       ({"time": "epoch_us(time) // 1000 / 1000.0"} | {c: c for c in SUMMARY} | {c: f"epoch_us({c}) // 1000 / 1000.0" for c in P.TIMES} | {"backup_duration": "k", "total_duration": "k + 0.5"}).items()))
def snap_metrics(spark, sf):
    return P.snapshot_metrics(snapshots(spark, sf))


_RESTORE = f"{NODES}, r as (select coalesce(a.node_type, b.node_type) as node_type, coalesce(a.size, 0) as size, case when a.path is null then 'additional' when b.path is null then 'restore' when a.node_type = b.node_type and a.size = b.size and a.mtime = b.mtime then 'unchanged' else 'modify' end as action from v1 a full join v2 b on a.path = b.path)"


@query(f"with {_RESTORE} select node_type, action, count(*) as n, cast(sum(case when action in ('restore', 'modify') then size else 0 end) as bigint) as restore_size, cast(sum(case when action in ('unchanged', 'verified') then size else 0 end) as bigint) as matched_size from r group by 1, 2")
def restore_plan(spark, sf):
    return P.restore_stats(P.restore_plan(nodes_v1(spark, sf), nodes_v2(spark, sf)))


@query(f"with {_RESTORE.replace('select coalesce(a.node_type', 'select coalesce(a.path, b.path) as path, coalesce(a.node_type')} select path, node_type, case when action = 'additional' then 'remove' else 'write' end as step, size from r where action <> 'unchanged'")
def restore_steps(spark, sf):
    return P.restore_actions(P.restore_plan(nodes_v1(spark, sf), nodes_v2(spark, sf)), delete=True)


@query(f"with {_RESTORE.replace('select coalesce(a.node_type', 'select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(a.node_type')}, {BLOBS}, {INDEX} select pack_id, cast(sum(len) as bigint) as bytes from idx where blob_id in (select blob_id from blob where doc_id in (select doc_id from r where action in ('restore', 'modify') and node_type = 'file')) group by pack_id")
def restore_packs(spark, sf):
    n = nodes(spark, sf).select("doc_id", "path")
    content = blobs(spark, sf).select("doc_id", "blob_id", "len").join(n, "doc_id").select("path", "blob_id", "len")
    return P.restore_packs(P.restore_plan(nodes_v1(spark, sf), nodes_v2(spark, sf)), content, index(spark, sf))


@query(f"with {SNAP}, {BLOBS}, w as (select distinct tree from snap where event_id % 3 <> 0 and k < 50) select blob_id, max(len) as len from blob where 't' || (doc_id % 25) in (select tree from w) and blob_id not in (select blob_id from blob where doc_id % 4 = 0) group by blob_id")
def copy_blobs(spark, sf):
    P.same_chunker({"chunker": "fixed", "chunk_size": "1000"}, {"chunker": "fixed", "chunk_size": "1000"})
    s = snapshots(spark, sf).where("k < 50")
    content = blobs(spark, sf).select(F.concat(F.lit("t"), F.col("doc_id") % 25).alias("tree"), "blob_id", "len")
    return P.copy_blobs(P.copy_plan(s, s.where("event_id % 3 = 0").select("original")), content, blobs(spark, sf).where("doc_id % 4 = 0"))


@query(f"with {BLOBS}, {INDEX}, l as (select distinct blob_id from blob where doc_id % 7 <> 0), r as (select distinct blob_id from blob where doc_id % 11 <> 0), x as (select 'left' as side, blob_id from l where blob_id not in (select blob_id from r) union all select 'right', blob_id from r where blob_id not in (select blob_id from l)) "
       "select side, count(*) as blobs, cast(sum(len) as bigint) as stored, cast(sum(case when x.blob_id < '8' then len * 2 else len end) as bigint) as uncompressed from x join idx on idx.blob_id = x.blob_id group by side")
def exclusive_sizes(spark, sf):
    b = blobs(spark, sf)
    return P.exclusive_sizes(b.where("doc_id % 7 <> 0"), b.where("doc_id % 11 <> 0"), readers.index_entries(nested_index(spark, sf)))


@query(f"with {BLOBS}, {INDEX} select blob_id, pack_id, blob_type, max(octet_length(encode(chunk))) as length from (select b.blob_id, b.chunk, i.pack_id, i.blob_type from blob b join idx i on i.blob_id = b.blob_id) group by 1, 2, 3")
def rebuild_index(spark, sf):
    stored = blobs(spark, sf).select("blob_id", "chunk").join(index(spark, sf).select("blob_id", "pack_id", "blob_type"), "blob_id")
    return P.rebuild_index(stored, index(spark, sf), read_all=True)


@query(f"with {SNAP} select event_id, id as original, 't' || (k // 25) || '.repaired' as tree, array_to_string(list_concat(tags, ['repaired']), ',') as tags, 'save' as action from snap where tree = 't1' "
       "union all select event_id, null, null, null, 'remove' from snap where tree in ('t1', 't2')")
def repair_saved(spark, sf):
    s = snapshots(spark, sf)
    broken = spark.createDataFrame([("t1", "t1.repaired"), ("t2", None)], "tree string, new_tree string")
    saved, gone = P.repair_snapshots(s, broken, delete=True)
    none = F.lit(None).cast("string")
    return saved.select("event_id", "original", "tree", F.array_join("tags", ",").alias("tags"), F.lit("save").alias("action")) \
        .unionByName(gone.join(s, "id").select("event_id", none.alias("original"), none.alias("tree"), none.alias("tags"), F.lit("remove").alias("action")))


@query(f"with {SNAP} select event_id, 'new label' as label, 'saved' as what from snap where event_id = 5 union all select event_id, null, 'gone' from snap where event_id in (5, 8)")
def edit_buffer(spark, sf):
    s = snapshots(spark, sf)
    named = {r["event_id"]: r["id"] for r in s.where("event_id in (5, 8, 97)").select("event_id", "id").collect()}
    buffer = EditBuffer(s)
    buffer.modify([named[5]], label="new label")
    buffer.forget([named[8]] + ([named[97]] if 97 in named else []))  # 97 is protected
    saved, gone = buffer.result(NOW)
    return saved.select("event_id", "label", F.lit("saved").alias("what")).unionByName(gone.join(s, "id").select("event_id", F.lit(None).cast("string").alias("label"), F.lit("gone").alias("what")))


@query(f"with {NODES}, u as (select *, 1 as v from v1 union all select *, 2 from v2) select path, arg_max(content, struct_pack(m := mtime, v := v)) as content, max(struct_pack(m := mtime, v := v)).v as v from u group by path")
def merge_latest(spark, sf):
    both = nodes_v1(spark, sf).withColumn("v", F.lit(1)).unionByName(nodes_v2(spark, sf).withColumn("v", F.lit(2)))
    return P.merge_trees(both.select("path", "content", "mtime", "v"), ["mtime", "v"]).select("path", "content", "v")


@query(f"with {NODES} select coalesce(a.path, b.path) as path, coalesce(a.mode, b.mode) as mode, cast(case when a.path is null then 1 else 0 end as integer) as source from v2 a full join v1 b on a.path = b.path")
def union_priority(spark, sf):
    return P.union_left_wins([nodes_v2(spark, sf).select("path", "mode"), nodes_v1(spark, sf).select("path", "mode")], "path")


@query(f"with {SNAP} select event_id, array_to_string(list_filter(list_concat(tags, list_filter(['k1', 'new'], lambda x: not list_contains(tags, x))), lambda x: x <> 'm0'), ',') as tags from snap")
def tags_rewrite(spark, sf):
    return snapshots(spark, sf).select("event_id", F.array_join(P.rewrite_tags("tags", ("k1", "new"), ("m0",)), ",").alias("tags"))


@query(f"with {SNAP} select event_id, id as original, array_to_string(list_concat(tags, ['rewrite']), ',') as tags, 'moved' as hostname from snap where hostname = 'host3'")
def snap_rewrite(spark, sf):
    return P.rewrite_snapshots(snapshots(spark, sf).where("hostname = 'host3'"), hostname="moved").select("event_id", "original", F.array_join("tags", ",").alias("tags"), "hostname")


@query(f"with {NODES} select count(*) as files, cast(sum(size) as bigint) as size from node where not (path like '/fr/%') or path like '/fr/src2/%'")
def rewrite_trees(spark, sf):
    kept = nodes(spark, sf).where(S.not_excluded("path", ("!/fr/*", "/fr/src2/*")))
    return T.listing_summary(kept).select("files", "size")


@query(f"with {SNAP} select event_id, event_id % 3 = 0 as known from snap")
def incremental_reread(spark, sf):
    s = snapshots(spark, sf)
    known = s.where("event_id % 3 = 0").withColumn("known", F.lit(True))
    return P.new_rows(known, s.withColumn("known", F.lit(False))).select("event_id", "known")


# --- scalars and literals
_MODE = "(p_size * 37) % 512"


def _triplet(shift: int) -> str:
    b = f"((cast({_MODE} as bigint) >> {shift}) & 7)"
    return f"(case when {b} & 4 <> 0 then 'r' else '-' end || case when {b} & 2 <> 0 then 'w' else '-' end || case when {b} & 1 <> 0 then 'x' else '-' end)"


@query(f"select p_partkey, case when p_partkey % 5 = 0 then 'd' when p_partkey % 5 = 1 then 'l' else '-' end || {_triplet(6)} || {_triplet(3)} || {_triplet(0)} as mode, cast({_MODE} as bigint) & 64 <> 0 as executable from part")
def mode_strings(spark, sf):
    p = table(spark, sf, "part").withColumn("mode", F.expr(f"cast({_MODE} as int)")).withColumn("kind", F.when(F.col("p_partkey") % 5 == 0, "dir").when(F.col("p_partkey") % 5 == 1, "symlink").otherwise("file"))
    return p.select("p_partkey", X.mode_string("kind", "mode").alias("mode"), X.is_executable("mode").alias("executable"))


@query(f"with {NODES} select path, case when node_type = 'symlink' then 'l' else '-' end || 'rw-' || case when mode = 384 then '------' else 'r--r--' end as mode, '?' as user, '?' as group, cast(size as varchar) as size, ' 1 Jan 1970 00:00' as mtime, case when node_type = 'symlink' then '-> target' else '' end as link from v2")
def node_listing(spark, sf):
    return R.node_listing(nodes_v2(spark, sf))


@query(f"select o_orderkey, {_human('b')} as size from (select o_orderkey, (o_orderkey * 7919) % 5000000 as b from orders)")
def size_human(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.human_size(F.expr("(o_orderkey * 7919) % 5000000")).alias("size"))


@query("select l_orderkey, l_linenumber, l_partkey, u, case u when 0 then n when 1 then n * 1000 when 2 then n * 1000000 else n * 1073741824 end as bytes from (select l_orderkey, l_linenumber, l_partkey, l_linenumber % 4 as u, l_partkey as n from lineitem)")
def size_units(spark, sf):
    unit = F.element_at(F.array(*map(F.lit, ("", "k", " MB", "GiB"))), F.col("u") + 1)
    return table(spark, sf, "lineitem").withColumn("u", F.col("l_linenumber") % 4).select("l_orderkey", "l_linenumber", "l_partkey", "u", X.parse_size(F.concat(F.col("l_partkey").cast("string"), unit)).alias("bytes"))


@query("select * from (values ('10', 10::bigint), ('10k', 10000), ('1MB', 1000000), ('1 GiB', 1073741824), (' 2G ', 2000000000), ('x', null)) t(text, bytes)")
def size_parse(spark, sf):
    return spark.createDataFrame([(t,) for t in ("10", "10k", "1MB", "1 GiB", " 2G ", "x")], "text string").select("text", X.parse_size("text").alias("bytes"))


@query("select * from (values ('abc=xyz, path=/my/path', 'abc', 'xyz'), ('abc=xyz, path=/my/path', 'path', '/my/path'), ('tags=a', 'tags', 'a'), ('tags=a', 'host', 'h')) t(text, k, v)")
def label_map(spark, sf):
    given = spark.createDataFrame([("abc=xyz, path=/my/path",), ("tags=a",)], "text string")
    defaults = F.when(F.col("text").startswith("tags"), F.create_map(F.lit("host"), F.lit("h"), F.lit("tags"), F.lit("b"), F.lit("nogroup"), F.lit(""))).otherwise(F.create_map().cast("map<string,string>"))
    return given.select("text", F.explode(P.metric_labels(X.parse_labels("text"), defaults)).alias("k", "v"))


@query("select case when c_custkey = 7 then '*' || sha256(cast(c_custkey as varchar)) else sha256(cast(c_custkey as varchar)) end as id, c_name as username, c_custkey <> 7 as removable from customer")
def key_listing(spark, sf):
    import hashlib

    used = hashlib.sha256(b"7").hexdigest()
    keys = table(spark, sf, "customer").select(F.sha2(F.col("c_custkey").cast("string"), 256).alias("id"), F.col("c_name").alias("username"))
    return R.key_listing(keys.withColumn("removable", F.col("id") != used), used)


@query("select n_name as name, n_regionkey as region from nation where n_name in (select min(n_name) from nation union all select max(n_name) from nation)")
def config_names(spark, sf):
    sources = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return S.named_sources(sources, list(sources.agg(F.min("name"), F.max("name")).first()))


@query("select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || case event_id % 3 when 0 then '' else '*' end as time, strftime(ts + to_hours((event_id % 3) * 2), '%Y-%m-%d %H:%M:%S') || '+0' || ((event_id % 3) * 2) || '00' as with_offset from events")
def time_display(spark, sf):
    zone = F.element_at(F.array(*map(F.lit, ("+00:00", "+02:00", "+04:00"))), (F.col("event_id") % 3 + 1).cast("int"))
    instant = F.to_timestamp_ltz(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSX"))
    return table(spark, sf, "events").select("event_id", X.format_time(instant, zone, "+00:00").alias("time"), X.format_time(instant, zone, "+00:00", show_offset=True).alias("with_offset"))


@query(f"with {NODES} select path, case node_type when 'symlink' then 'symlink' when 'dir' then 'directory' else 'regular' end as kind from v2")
def archive_kinds(spark, sf):
    return nodes_v2(spark, sf).select("path", X.file_kind("node_type").alias("kind"))


@query("select p_partkey, array_to_string(list_filter(list_transform(string_split(p_name || ', ,' || p_brand, ','), lambda x: trim(x)), lambda x: x <> ''), chr(10)) as lines from part")
def string_lists(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.string_list(F.concat("p_name", F.lit(", ,"), "p_brand")), "\n").alias("lines"))


@query("select c_custkey, rtrim(replace(replace(to_base64(encode(c_name || '?>')), '+', '-'), '/', '_'), '=') as code from customer")
def url_codes(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.url_base64(F.concat("c_name", F.lit("?>"))).alias("code"))


@query("select event_id, printf('%02d:%02d:%02d', event_id // 3600, (event_id // 60) % 60, event_id % 60) as elapsed, lpad(strftime(ts, '%-d'), 2, ' ') || strftime(ts, ' %b %Y %H:%M') as listed from events")
def clock_times(spark, sf):
    return table(spark, sf, "events").select("event_id", X.clock("event_id").alias("elapsed"), X.listing_time("ts").alias("listed"))


@query("select cast(greatest(8, max(length(r_name))) as integer) as name_wide, cast(greatest(3, max(length(cast(r_regionkey as varchar)))) as integer) as key_wide from region")
def column_widths(spark, sf):
    return V.widths(table(spark, sf, "region").select(F.col("r_name").alias("the_name"), F.col("r_regionkey").alias("key"))).select(F.col("the_name").cast("int").alias("name_wide"), F.col("key").cast("int").alias("key_wide"))


@query(f"with {NODES} select count(*) as files, cast(sum(size) as bigint) as size from node")
def scan_size(spark, sf):
    return readers.scan_size(nodes(spark, sf))


@query(f"with {NODES} select path from node where doc_id % 3 = 1")
def one_file_system(spark, sf):
    roots = spark.createDataFrame([("/", 1)], "root string, device long")
    return S.on_one_file_system(nodes(spark, sf).withColumn("device", F.col("doc_id") % 3).withColumn("root", F.lit("/")), roots).select("path")


@query(f"with {BLOBS}, {INDEX}, p as (select pack_id, cast(sum(len) as bigint) as size from idx group by 1) select pack_id, size, size >= 0.3 * 8000 and size <= 2.0 * 8000 as tolerated from p")
def pack_tolerance(spark, sf):
    packs = index(spark, sf).groupBy("pack_id").agg(F.sum("len").alias("size"))
    return packs.withColumn("tolerated", B.well_sized(F.col("size"), 8000, most=2.0))
