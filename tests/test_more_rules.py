"""Hand-made tables for missing keys, errors, deep trees, prune decisions, durations, edits and repairs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratum import shared
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
from stratum.shared import previous

from .test_rules import at, ids, snaps


def unlabelled(spark):
    return snaps(spark, [("a", "2024-01-01"), ("b", "2024-01-02"), ("c", "2024-01-05")]).withColumn("label", F.when(F.col("id") == "b", "l"))


def test_missing_group_keys_are_a_group(spark):
    df = unlabelled(spark)
    for policy in (K.KeepPolicy(within="10 days"), K.KeepPolicy(within_periods={"daily": "10 days"}), K.KeepPolicy(last=5), K.KeepPolicy(periods={"daily": 5})):
        assert {r["id"]: r["keep"] for r in K.forget(df, policy, ("hostname", "label"), "2024-06-01").collect()} == {"a": True, "b": True, "c": True}, policy
    assert {r["id"]: r["parent"] for r in L.with_parent(df, ("hostname", "label")).collect()} == {"a": None, "b": None, "c": "a"}
    assert ids(K.forget(df, K.KeepPolicy(last=9, delete_unchanged=True), ("label",), "2024-06-01").where("keep")) == ["a", "b"]
    assert {r["id"]: r["latest"] for r in R.marked_paths(df, "{label}/{id}", ["label"]).collect()} == {"a": False, "b": True, "c": True}
    assert {r["id"]: r["reasons"] for r in K.reasons(df, K.KeepPolicy(within="2 days"), ()).collect()} == {"c": ["within"]}


@pytest.mark.parametrize("large", [0, 1_000_000])
def test_runs_in_one_task_or_in_ranges(spark, monkeypatch, large):
    monkeypatch.setattr(shared, "LARGE", large)
    rows = [(g, i, "AABAAA"[i % 6] if i % 7 else None) for g in ("a", "b", None) for i in range(150)]
    want, last = {}, None
    for g, i, v in rows:
        if (g, v) != last:
            want[g, i] = [v, -1]
            at_, last = (g, i), (g, v)
        want[at_][1] += 1
    out = L.collapse_runs(spark.createDataFrame(rows, "g string, i int, v string").repartition(5), F.col("v"), ["g"], ["i"]).collect()
    assert {(r["g"], r["i"]): [r["value"], r["more"]] for r in out} == want and len(out) == len(want)


@pytest.mark.parametrize("large", [0, 1_000_000])
def test_previous_across_ranges(spark, monkeypatch, large):
    monkeypatch.setattr(shared, "LARGE", large)
    rows = [(g, i, f"{g}{i}") for g in "abc" for i in range(200)] + [(None, 1, "n1"), (None, 2, None), (None, 3, "n3")]
    out = {(r["g"], r["i"]): r["p"] for r in previous(spark.createDataFrame(rows, "g string, i int, v string").repartition(7), ["g"], ["i"], F.col("v"), "p").collect()}
    by = {}
    for g, i, v in rows:
        assert (out[g, i] is None) == (g not in by) and (g not in by or out[g, i]["value"] == by[g])
        by[g] = v


def test_parents(spark):
    df = unlabelled(spark)
    assert {r["id"]: r["parents"] for r in L.choose_parents(df, ("label",)).collect()} == {"a": [], "b": [], "c": ["a"]}
    assert {tuple(r["parents"]) for r in L.choose_parents(df, (), explicit=("latest", "a")).collect()} == {("c", "a")}
    assert {tuple(r["parents"]) for r in L.choose_parents(df, (), force=True).collect()} == {()}


def test_lookup_errors(spark):
    df = snaps(spark, [("aa1", "2024-01-01"), ("ab2", "2024-01-02")])
    for odd in ("latest~2", "zz", "a"):
        with pytest.raises(Exception, match="no snapshot|several snapshots"):
            L.lookup(df, ("latest", odd)).select("position").where("id is not null").collect()
    assert [r["id"] for r in L.by_group_and_time(df, ("hostname",)).collect()] == ["aa1", "ab2"]


def test_deep_trees(spark):
    children = spark.createDataFrame([(f"t{i}", f"n{i}", f"t{i + 1}") for i in range(9)] + [("t9", "end", None)], "tree string, name string, subtree string")
    roots = spark.createDataFrame([("t0", "r")], "tree string, path string")
    paths = [r["path"] for r in T.recursive_listing(children, roots).collect()]
    assert len(paths) == 10 and max(p.count("/") for p in paths) == 10
    with pytest.raises(ValueError, match="contains itself"):
        T.recursive_listing(children.unionByName(spark.createDataFrame([("t9", "loop", "t3")], children.schema)), roots)
    nodes = spark.createDataFrame([("/a/b/c/d/e", "file", "1", 5), ("/x", "file", "2", 5)], "path string, node_type string, content string, size long")
    deep, other = ({r["dir"]: r["id"] for r in T.identities(n).collect()} for n in (nodes, nodes.withColumn("content", F.concat("content", F.lit("!")))))
    assert set(deep) == {"", "/a", "/a/b", "/a/b/c", "/a/b/c/d"} and all(deep[k] != other[k] for k in deep)
    with pytest.raises(Exception, match="deeper than told"):
        T.identities(nodes, 3).collect()
    assert T.identities(nodes.limit(0)).count() == 0


def test_listings(spark):
    nodes = spark.createDataFrame([("/b", "dir"), ("/a", "dir"), ("/a/x", "file"), ("/a-b", "file"), ("/a/d", "dir"), ("/a/d/z", "file")], "path string, node_type string").withColumn("size", F.lit(1).cast("long"))
    assert [r["path"] for r in T.listing(nodes).collect()] == ["/a", "/a/d", "/a/d/z", "/a/x", "/a-b", "/b"]  # pre-order
    assert [r["path"] for r in T.listing(nodes, "/a", recursive=False, globs=("!x",)).collect()] == ["/a/d"]
    assert [r["path"] for r in T.open_rows(nodes, ["/a"]).collect()] == ["/a", "/a/d", "/a/x", "/a-b", "/b"] and T.open_rows(nodes, []).count() == 3
    assert {r["dir"]: (r["files"], r["dirs"]) for r in T.roll_up(nodes).collect()} == {"": (3, 3), "/a": (2, 2), "/a/d": (1, 1), "/b": (0, 1)}  # a directory counts itself
    assert ids(S.find_nodes(nodes.withColumnRenamed("path", "id").withColumn("path", F.col("id")), path="/a/x")) == ["/a/x"]
    with pytest.raises(ValueError):
        S.find_nodes(nodes, path="/a", globs=("*",))


def test_ignore_files(spark):
    nodes = spark.createDataFrame([("/p/a.o", "file"), ("/p/keep.o", "file"), ("/p/out", "dir"), ("/p/out/x", "file"), ("/p/sub/out", "file"), ("/p/sub/deep/b.o", "file"), ("/q/a.o", "file"), ("/p/top", "file"), ("/p/sub/top", "file")], "path string, node_type string")
    files = spark.createDataFrame([("/p/.gitignore", "# objects\n*.o\n!keep.o\nout/\n/top\n")], "path string, content string")
    assert sorted(r["path"] for r in S.without_ignored(nodes, S.ignore_rules(files)).collect()) == ["/p/keep.o", "/p/sub/out", "/p/sub/top", "/q/a.o"]


def test_row_predicate(spark):
    df = snaps(spark, [("a", "2024-01-01", "7"), ("b", "2024-01-02", "x"), ("c", "2024-01-03", "2")])
    assert ids(S.SnapshotFilter(predicate=S.row_predicate(lambda r: int(r["tree"]) > 5, "tree")).apply(df)) == ["a"]  # what fails is dropped
    assert ids(S.SnapshotFilter(predicate=S.row_predicate(lambda r: "yes", "tree")).apply(df)) == []


def test_named_sources(spark):
    sources = spark.createDataFrame([("home", "/home"), ("etc", "/etc")], "name string, path string")
    assert [r["path"] for r in S.named_sources(sources, ["etc"]).collect()] == ["/etc"] and S.named_sources(sources, []).count() == 2
    with pytest.raises(Exception, match="no source named"):
        S.named_sources(sources, ["nothing"]).collect()


def test_pack_sizes():
    assert B.pack_target(0) == 32 << 20 and B.pack_target(1 << 40, B.TREE_PACK) == (4 << 20) + 32 * (1 << 20) and B.pack_target(1 << 62) == B.PACK_LIMIT


def test_prune_decisions(spark):
    now, old, new = at("2024-06-01"), at("2024-01-01"), at("2024-05-31 23:00")
    packs = {"used": ("ab", None), "part": ("Ac", None), "small": ("AAAb", None), "none": ("AA", None), "young": ("AA", None), "marked": ("AA", new), "gone": ("AA", old), "back": ("Ab", old)}
    rows = [(f"{p}{i}{c}", p, 10, new if p == "young" else old, m) for p, (blobs, m) in packs.items() for i, c in enumerate(blobs)]
    index = spark.createDataFrame(rows, "blob_id string, pack_id string, len long, pack_time timestamp_ntz, marked_at timestamp_ntz")
    used = index.where("lower(right(blob_id, 1)) = right(blob_id, 1)")
    decide = lambda **k: {r["pack_id"]: r["action"] for r in B.prune_decisions(index, used, now, keep_pack="7 days", **k).collect()}
    want = {"used": "keep", "part": "repack", "small": "repack", "none": "mark", "young": "keep", "marked": "keep-marked", "gone": "delete", "back": "recover"}
    assert decide() == want
    assert decide(max_unused=10) == want | {"part": "keep"}  # the emptier pack first, then little enough stays unused
    assert decide(max_repack=10) == want | {"part": "keep"} and decide(max_repack=5) == want | {"part": "keep", "small": "keep"}
    assert decide(instant_delete=True) == want | {"none": "remove", "marked": "delete"}
    row = B.prune_statistics(B.prune_decisions(index, used, now, keep_pack="7 days"), spark.createDataFrame([("used", 20), ("stray", 7)], "pack_id string, size long")).first()
    assert (row["used_bytes"], row["unused_bytes"], row["repack_bytes"], row["repackrm_bytes"], row["remove_bytes"], row["remaining_bytes"], row["unused_after_bytes"], row["unused_percent"]) == (50, 80, 20, 40, 20, 70, 20, 28.57)
    assert (row["packs_unref"], row["size_unref"], row["packs_recover"], row["packs_delete"], row["packs_keep_marked"]) == (1, 7, 1, 1, 1)
    assert {r["pack_id"]: r["batch"] for r in B.packs_needed(index, batch=3).collect()} == {p: i // 3 for i, p in enumerate(sorted(packs))}


def test_check_content(spark):
    blobs = spark.range(400).select(F.concat(F.lit("text "), "id").alias("chunk")).withColumn("blob_id", F.sha2("chunk", 256)).withColumn("len", F.length("chunk").cast("long"))
    bad = blobs.withColumn("chunk", F.concat("chunk", F.lit("!")))
    assert B.check_content(blobs).count() == 0 and B.check_content(bad).count() == 400
    assert sum(B.check_content(bad, subset=f"{i}/3").count() for i in (1, 2, 3)) == 400 and 60 < B.check_content(bad, subset="25%").count() < 140
    some = B.within_size(blobs, "1k").agg(F.sum("len")).first()[0]
    assert 900 < some <= 1000 and B.check_content(bad, subset="1k").count() == B.within_size(blobs, "1k").count()
    with pytest.raises(Exception, match="no index knows"):
        B.locate(blobs, spark.createDataFrame([("x", "p")], "blob_id string, pack_id string"), strict=True).collect()


def test_rolling_chunks_against_a_plain_loop(spark):
    """Every boundary from a window hashed by itself, one byte after another."""
    import random

    rng = random.Random(6)
    texts = {i: bytes(rng.choices(b"abcdef", k=rng.choice((0, 10, 700, 30_000)))) for i in range(8)}
    rows = B.rolling_chunks(spark.createDataFrame([(i, bytearray(t)) for i, t in texts.items()], "id int, data binary"), "id", "data", least=200, mask_bits=8, most=2000).collect()
    base, window = 0x9E3779B97F4A7C15, 48
    for i, t in texts.items():
        ends = []
        for e in range(window, len(t)):  # the window that ends before byte e
            h = 0
            for c in t[e - window:e]:
                h = (h * base + c + 1) % 2**64
            if h * pow(base, 0, 2**64) % 2**64 >> 56 == 0:
                ends.append(e)
        got = sorted((r["offset"], r["len"]) for r in rows if r["id"] == i)
        assert [a for a, _ in got] == [0, *[a + n for a, n in got]][:len(got)] and sum(n for _, n in got) == len(t)
        start, want = 0, []
        while start < len(t):
            end = min(next((e for e in ends if e >= start + 200), len(t)), start + 2000, len(t))
            want.append((start, end - start))
            start = end
        assert got == want, i


def test_durations():
    assert X.parse_duration("2h30m") == (0, 9000) and X.parse_duration("1 year 2 months") == (14, 0) and X.parse_duration("10 days, 5s") == (0, 864005) and X.parse_duration("0s") == (0, 0)
    for odd in ("", "ten days", "5", "3 parsecs"):
        with pytest.raises(ValueError):
            X.parse_duration(odd)
    assert X.option_field("--dry-run") == X.option_field("DRY_RUN") == "dry-run" and X.environment_name("dry-run", "app") == "APP_DRY_RUN"


def test_times(spark):
    df = spark.sql("select timestamp'2024-07-01 10:00:00Z' as t, 'Europe/Berlin' as zone")
    row = df.select(X.format_time("t", F.col("zone"), "UTC").alias("a"), X.format_time("t", F.col("zone"), "Africa/Harare").alias("b"), X.format_time("t", F.col("zone"), "UTC", show_offset=True).alias("c"),
                    X.format_time("t", "-03:30", "UTC", show_offset=True).alias("d"), X.duration_text(F.lit(93784)).alias("e"), X.duration_text(F.lit(0.4)).alias("f")).first()
    assert tuple(row) == ("2024-07-01 10:00:00*", "2024-07-01 12:00:00", "2024-07-01 12:00:00+0200", "2024-07-01 06:30:00-0330", "1d 2h 3m 4s", "0s")


def test_virtual_paths(spark):
    df = spark.sql("select 'abcdefghij' as id, timestamp_ntz'2024-01-02 03:04:05' as time, 'u' as username, 'h' as hostname, '' as label, array('x', 'y') as tags, named_struct('backup_start', timestamp_ntz'2024-01-02 03:00:00', 'backup_end', timestamp_ntz'2024-01-02 03:01:00') as summary")
    path = lambda t: df.select(R.virtual_path(t).alias("p")).first()["p"]
    assert path("/[{hostname}]/[{label}]/{time}") == "/h/2024-01-02_03-04-05" and path("/{username}/{hostname}/{backup_start}-{backup_end}") == "/u/h/2024-01-02_03-00-00-2024-01-02_03-01-00"
    assert path("/{id}/{tags}/{id_long}") == "/abcdefgh/x,y/abcdefghij"
    with pytest.raises(ValueError):
        R.virtual_path("/{nothing}")


def test_details_leave_out_what_is_not_there(spark):
    df = spark.sql("select 'a' as id, 'b' as original, timestamp_ntz'2024-01-02' as time, 'h' as hostname, cast(null as string) as label, array('x') as tags, array('/p') as paths, 'notset' as delete_kind, cast(null as timestamp_ntz) as delete_after, 'why' as description, cast(null as string) as parent")
    rows = {r["title"]: r["value"] for r in V.snapshot_details(df).collect()}
    assert rows["Original ID"] == "b" and rows["Label"] == "" and rows["Parent"] == "no parent snapshot" and rows["Description"] == "why" and "Source" not in rows
    again = {r["title"] for r in V.snapshot_details(df.withColumn("original", F.col("id")).withColumn("description", F.lit(None).cast("string"))).collect()}
    assert not {"Original ID", "Description"} & again


def test_preview(spark):
    df = spark.createDataFrame([(1, bytearray("aé".encode())), (2, bytearray(b"\xff\x00")), (3, None)], "id int, data binary")
    assert {r["id"]: r["preview"] for r in V.preview(df, "id", "data").collect()} == {1: "aé"} and V.preview(df, "id", "data", most=2).first()["preview"] == "a"


def test_default_metadata_of_diff(spark):
    schema = "path string, node_type string, link_target string, content string, size long, mode long, mtime long, user string"
    a, b = (spark.createDataFrame([("/x", "file", None, "c", 1, 1, 1, u), ("/t", "file" if u == "a" else "dir", None, "c", 1, 1, 1, "a")], schema) for u in "ab")
    assert {r["path"]: r["cls"] for r in D.diff(a, b).collect()} == {"/x": "U", "/t": "T"} and {r["path"]: r["cls"] for r in D.diff(a, b, ("size",)).collect()}["/x"] == "="
    assert {(r["kind"], r["cls"]): r["n"] for r in D.stats(D.diff(a, b)).collect()} == {("file", "U"): 1, ("type", "T"): 1}


def test_backup_measures(spark):
    s = "path string, node_type string, size long, mtime long, inode long"
    old = spark.createDataFrame([("a", "file", 1, 1, 5), ("d", "dir", 3, 1, 6)], s)
    new = spark.createDataFrame([("a", "file", 1, 1, 9), ("b", "file", 2, 1, 7), ("d", "dir", 4, 1, 6)], s)
    assert {r["path"]: r["state"] for r in P.file_states(new, old, ignore_inode=False).collect()} == {"a": "changed", "b": "new", "d": "changed"}
    content = spark.createDataFrame([("x", "data", 10, 5), ("x", "data", 10, 5), ("y", "tree", 4, 3), ("z", "data", 7, 7)], "blob_id string, blob_type string, length long, packed_length long")
    added = P.new_blobs(content, spark.createDataFrame([("z",)], "blob_id string"))
    summary = P.with_times(P.backup_summary(P.file_states(new, old), added), dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 1, 10, 1), dt.datetime(2024, 1, 1, 9, 59))
    row = summary.first()
    assert (row["files_new"], row["files_unmodified"], row["dirs_changed"], row["total_bytes_processed"], row["total_dirsize_processed"], row["data_blobs"], row["tree_blobs"], row["data_added"], row["data_added_packed"], row["data_added_trees_packed"]) == (1, 1, 1, 3, 4, 1, 1, 14, 8, 3)
    snap = summary.select(F.lit("id").alias("id"), F.lit("1970-01-01 00:00:10.5").cast("timestamp").alias("time"), F.struct("*").alias("summary"))
    found = {r["metric"]: r["value"] for r in P.snapshot_metrics(snap).collect()}
    assert len(found) == 23 and found["backup_time"] == 10.5 and found["backup_backup_duration"] == 60.0 and found["backup_total_duration"] == 120.0
    parent = spark.createDataFrame([("p", "t1")], "id string, tree string")
    assert P.unchanged("t1", parent) and not P.unchanged("t2", parent)


def test_restore_applies(spark, tmp_path):
    s = "path string, node_type string, size long, mtime long, content string"
    want = spark.createDataFrame([("/d", "dir", None, 1, None), ("/d/a", "file", 6, 1, "1"), ("/e", "file", 1, 1, "2")], s)
    have = spark.createDataFrame([("/e", "file", 1, 1, "2"), ("/old", "dir", None, 1, None), ("/old/x", "file", 1, 1, "3")], s)
    plan = P.restore_plan(want, have)
    assert [(r["path"], r["step"]) for r in P.restore_actions(plan, delete=True).collect()] == [("/d", "create"), ("/d/a", "write"), ("/old/x", "remove"), ("/old", "remove")]
    assert [r["path"] for r in P.restore_actions(plan).collect()] == ["/d", "/d/a"]
    content = spark.createDataFrame([("/d/a", 1, bytearray(b"def")), ("/d/a", 0, bytearray(b"abc")), ("/e", 0, bytearray(b"x"))], "path string, pos int, chunk binary")
    P.restore_files(plan, content, str(tmp_path))
    assert (tmp_path / "d/a").read_bytes() == b"abcdef" and not (tmp_path / "e").exists()
    need = content.select("path", F.concat("path", "pos").alias("blob_id"), F.lit(3).cast("long").alias("len"))
    index = spark.createDataFrame([("/d/a0", "p"), ("/d/a1", "q"), ("/e0", "r")], "blob_id string, pack_id string")
    assert {r["pack_id"]: r["bytes"] for r in P.restore_packs(plan, need, index).collect()} == {"p": 3, "q": 3}


def test_copies_between_chunkers_are_refused():
    P.same_chunker({"chunker": "rabin"}, {"chunker": "rabin", "version": "2"})
    with pytest.raises(ValueError, match="chunker"):
        P.same_chunker({"chunker": "rabin"}, {"chunker": "fixed"})


def test_rewrite_tree(spark):
    nodes = spark.createDataFrame([("/a/x", "file", "1", 5), ("/a/y.o", "file", "2", 5)], "path string, node_type string, content string, size long").withColumn("mode", F.lit(420))
    root = lambda pair: {r["dir"]: r["id"] for r in pair[1].collect()}[""]
    same, fewer = P.rewrite_tree(nodes, mode=F.lit(384)), P.rewrite_tree(nodes, globs=("!*.o",))
    assert root(same) == root(P.rewrite_tree(nodes)) != root(fewer) and {r["mode"] for r in same[0].collect()} == {384} and fewer[0].count() == 1


def test_merge_drops_what_may_go(spark):
    df = snaps(spark, [("a", "2024-01-01", "t", "never"), ("b", "2024-01-02")])
    nodes = spark.createDataFrame([("/x", 1, "old"), ("/x", 2, "new")], "path string, mtime long, content string")
    tree, gone = P.merge_and_drop(df, nodes, ["mtime"], at("2024-06-01"))
    assert tree.first()["content"] == "new" and ids(gone) == ["b"]


def test_repairs(spark):
    df = snaps(spark, [("a", "2024-01-01", "t1"), ("b", "2024-01-02", "t2"), ("c", "2024-01-03", "t3")])
    broken = spark.createDataFrame([("t1", "t1r"), ("t2", None)], "tree string, new_tree string")
    saved, gone = P.repair_snapshots(df, broken)
    row = saved.first()
    assert (row["original"], row["tree"], row["tags"]) == ("a", "t1r", ["a", "repaired"]) and ids(gone) == ["b"] and ids(P.repair_snapshots(df, broken, delete=True)[1]) == ["a", "b"]
    packs = spark.createDataFrame([("p", "data", bytearray(b"x")), ("q", "tree", bytearray(b"y"))], "pack_id string, blob_type string, chunk binary")
    index = spark.createDataFrame([("bx", "p", "data", 1), ("bz", "lost", "data", 1)], "blob_id string, pack_id string, blob_type string, length long")
    assert {(r["pack_id"], r["blob_id"][:2]) for r in P.rebuild_index(packs, index).collect()} == {("p", "bx"), ("q", "a1")} and P.rebuild_index(packs, index, read_all=True).where("blob_id = 'bx'").count() == 0


def test_edit_buffer(spark):
    df = snaps(spark, [("a", "2024-01-01", "t", "never"), ("b", "2024-01-02"), ("c", "2024-01-03")])
    buffer = EditBuffer(df)
    buffer.modify(["b"], add_tags=["n"])
    buffer.modify(["b"], label="other")
    buffer.forget(["a", "c"])
    assert {r["id"]: (r["modified"], r["to_forget"]) for r in buffer.status().collect()} == {"a": (False, True), "b": (True, False), "c": (False, True)}
    saved, gone = buffer.result(at("2024-06-01"))
    row = saved.first()
    assert (row["original"], row["label"], row["tags"]) == ("b", "other", ["a", "n"]) and ids(gone) == ["b", "c"]  # a is protected
    buffer.forget(["c"])
    assert ids(buffer.result(at("2024-06-01"))[1]) == ["b"]


def test_node_listing(spark):
    df = spark.sql("select '/l' as path, 'symlink' as node_type, 511L as mode, 3L as size, 't' as link_target, 7L as uid, cast(null as string) as user, timestamp'2024-10-08 08:11:00' as mtime")
    assert tuple(R.node_listing(df).first()) == ("/l", "lrwxrwxrwx", "7", "?", "3", " 8 Oct 2024 08:11", "-> t")
    assert [r["id"] for r in R.key_listing(spark.createDataFrame([("k",), ("l",)], "id string"), "l").orderBy("id").collect()] == ["*l", "k"]
