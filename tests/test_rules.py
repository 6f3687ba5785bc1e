"""Hand-made tables for each rule: sizes, globs, classification, retention, roll-ups, plans."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratum.functions import scalars as X
from stratum.operators import blobs as B
from stratum.operators import diff as D
from stratum.operators import filters as S
from stratum.operators import retention as K
from stratum.operators import select as L
from stratum.operators import tree as T
from stratum.plans import repository as P

SNAP = "id string, original string, time timestamp_ntz, hostname string, label string, tags array<string>, paths array<string>, tree string, delete_kind string, delete_after timestamp_ntz, summary struct<total_bytes_processed: long, data_added: long>"


def at(text):
    return dt.datetime.fromisoformat(text)


def snaps(spark, rows):
    """rows of (id, time[, tree, kind, after, tags, size])."""
    out = []
    for r in rows:
        i, time, tree, kind, after, tags, size = (*r, *("t", "notset", None, ["a"], 1)[len(r) - 2:])
        out.append((i, i, at(time), "h", "l", tags, ["/p"], tree, kind, at(after) if after else None, (size, size) if size is not None else None))
    return spark.createDataFrame(out, SNAP)


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("text,low,high", [("..", None, None), ("10", 10, None), ("..10k", None, 10_000), ("1MB..", 1_000_000, None), ("1 MB .. 1 GiB", 1_000_000, 1 << 30), ("10 .. 20 ", 10, 20), (" 2G ", 2 * 10**9, None)])
def test_size_range(text, low, high):
    assert X.SizeRange.parse(text) == X.SizeRange(low, high)


def test_bad_size():
    with pytest.raises(ValueError):
        X.size_of("ten")


def test_bounds():
    assert X.after_bound("2024-01-03") == dt.datetime(2024, 1, 3, 23, 59, 59, 999999)
    assert X.after_bound("2024-01-03 10:00") == dt.datetime(2024, 1, 3, 10)


def test_snapshot_argument():
    assert X.snapshot_argument("latest:/x") == ("latest", "/x") and X.snapshot_argument("local:dir") == (None, "dir") and X.snapshot_argument("./a") == (None, "./a")


@pytest.mark.parametrize("glob,text,hit", [("*.rs", "/a/b.rs", True), ("/a/*.rs", "/a/b/c.rs", True), ("b.{rs,py}", "b.py", True), ("[!a]x", "bx", True), ("[!a]x", "ax", False), ("a?c", "abc", True), ("**/c", "c", True), ("a.b", "axb", False)])
def test_glob(glob, text, hit):
    import re

    assert bool(re.search(X.glob_regex(glob), text)) == hit


def test_scalars(spark):
    row = spark.range(1).select(
        X.mode_string(F.lit("dir"), F.lit(0o755)).alias("a"), X.permissions(F.lit(None).cast("int")).alias("b"), X.human_size(F.lit(246272)).alias("c"), X.human_size(F.lit(1023)).alias("d"), X.human_size(F.lit((1 << 20) - 1)).alias("e"),
        X.url_base64(F.lit("/my/path??>")).alias("f"), X.clock(F.lit(3725)).alias("g"), X.extension(F.lit("/a/b.tar.gz")).alias("h"), X.percent(F.lit(1), F.lit(0)).alias("i"), X.parent_path(F.lit("/a/b")).alias("j"),
        X.epoch_seconds(F.lit("1970-01-01 00:00:01.5").cast("timestamp")).alias("k"), X.delete_text(F.lit("never"), F.lit(None)).alias("l"), X.link_string(F.lit("symlink"), F.lit("t")).alias("m")).first()
    assert tuple(row) == ("drwxr-xr-x", "?????????", "240.5 kiB", "1023 B", "1024.0 kiB", "L215L3BhdGg_Pz4", "01:02:05", "gz", None, "/a", 1.5, "never", "-> t")


def test_bad_label_raises(spark):
    df = spark.createDataFrame([("a=b, c",)], "x string")
    with pytest.raises(Exception, match="label without"):
        df.select(X.parse_labels("x")).collect()


def test_filters(spark):
    df = snaps(spark, [("a", "2024-01-01 10:00:00"), ("b", "2024-01-02 00:00:00", "t", "notset", None, ["a", "b"], None), ("c", "2024-01-03 00:00:00", "t", "notset", None, [], 500)])
    assert ids(S.SnapshotFilter(after="2024-01-01").apply(df)) == ["b", "c"]  # the end of that day
    assert ids(S.SnapshotFilter(before="2024-01-02").apply(df)) == ["a"]  # strict
    assert ids(S.SnapshotFilter(size="2..500").apply(df)) == ["b", "c"]  # no summary passes, bounds are inclusive
    assert ids(S.SnapshotFilter(tags=(("a",),)).apply(df)) == ["a", "b"]
    assert ids(S.SnapshotFilter(tags_exact=(("a",),)).apply(df)) == ["a"]
    assert ids(S.SnapshotFilter(last=1).apply(df)) == ["c"] and ids(S.SnapshotFilter().apply(df)) == ["a", "b", "c"]
    with pytest.raises(Exception):
        S.SnapshotFilter(expr="no such thing(").apply(df)


def test_lookup_order(spark):
    df = snaps(spark, [("aa1", "2024-01-01"), ("ab2", "2024-01-02"), ("b3", "2024-01-03")])
    rows = sorted((r["position"], r["id"]) for r in L.lookup(df, ("latest~1", "aa", "latest", "aa")).collect())
    assert rows == [(0, "ab2"), (1, "aa1"), (2, "b3"), (3, "aa1")]


def test_runs(spark):
    df = snaps(spark, [(str(i), f"2024-01-0{i + 1}", t) for i, t in enumerate("AABAAA")])
    rows = sorted((r["id"], r["value"], r["more"]) for r in L.collapse_runs(df, F.col("tree"), ("hostname",)).collect())
    assert rows == [("0", "A", 1), ("2", "B", 0), ("3", "A", 2)]


def test_parent_is_strictly_earlier(spark):
    df = snaps(spark, [("a", "2024-01-01"), ("b", "2024-01-02"), ("c", "2024-01-02")])
    assert {r["id"]: r["parent"] for r in L.with_parent(df, ("hostname",)).collect()} == {"a": None, "b": "a", "c": "a"}


def kept(df, policy, now="2024-06-01"):
    return {r["id"]: (r["keep"], r["reasons"]) for r in K.forget(df, policy, ("hostname",), now).collect()}


def test_retention(spark):
    df = snaps(spark, [("a", "2023-01-01 10:00"), ("b", "2023-01-01 12:00"), ("c", "2023-07-01 00:00"), ("d", "2024-01-01 00:00"), ("e", "2024-01-01 00:00")])
    out = kept(df, K.KeepPolicy(last=1, periods={"daily": 2, "half_yearly": -1, "yearly": 1}))
    assert out["e"] == (True, ["last", "daily", "half_yearly", "yearly"])  # of two at one time the larger id is newer
    assert out["d"][0] is False and out["a"][0] is False and out["b"] == (True, ["half_yearly"]) and out["c"] == (True, ["daily", "half_yearly"])
    assert kept(df, K.KeepPolicy(within="300 days"))["a"][0] is False and kept(df, K.KeepPolicy(within="184 days"))["c"][0] is False and kept(df, K.KeepPolicy(within="185 days"))["c"][0] is True  # strict


def test_retention_guards(spark):
    df = snaps(spark, [("a", "2024-01-01", "x", "never"), ("b", "2024-01-02", "x", "after", "2024-02-01"), ("c", "2024-01-03", "x", "after", "2025-01-01"), ("d", "2024-01-04", "x"), ("e", "2024-01-05", "x")])
    out = kept(df, K.KeepPolicy(last=10))
    assert out["a"] == (True, ["protected"]) and out["b"] == (False, ["expired"]) and out["c"] == (True, ["protected"])
    out = kept(df, K.KeepPolicy(last=10, ids=("e",), delete_unchanged=True))
    assert out["d"] == (False, ["unchanged"]) and out["e"][0] is True
    assert not any(k for k, _ in [v for i, v in kept(df, K.KeepPolicy(none=True)).items() if i in "de"])
    with pytest.raises(ValueError):
        K.reasons(df, K.KeepPolicy(), ("hostname",))
    assert [r["keep"] for r in K.forget_ids(df, df.where("id in ('a', 'd')"), "2024-06-01").orderBy("id").collect()] == [True, False]


NODE = "path string, node_type string, link_target string, content string, size long, mode long"


def test_diff_classes(spark):
    left, right = [], []
    for kind in ("file", "dir", "symlink", "dev", "fifo", "socket"):
        same = (kind, "t" if kind == "symlink" else None, "c", 1, 1)
        left += [(f"{kind}=", *same), (f"{kind}-", *same), (f"{kind}U", *same), (f"{kind}T", *same)]
        right += [(f"{kind}=", *same), (f"{kind}+", *same), (f"{kind}U", *same[:4], 2), (f"{kind}T", "dir" if kind == "file" else "file", None, "c", 1, 1)]
    left += [("fileM", "file", None, "c", 1, 1), ("symlinkM", "symlink", "t", "c", 1, 1)]
    right += [("fileM", "file", None, "d", 1, 1), ("symlinkM", "symlink", "u", "c", 1, 1)]
    out = {r["path"]: r["cls"] for r in D.diff(spark.createDataFrame(left, NODE), spark.createDataFrame(right, NODE)).collect()}
    for path, cls in out.items():
        odd = path.rstrip("=-UT+M") in ("dev", "fifo", "socket")
        assert cls == ("M" if odd and path[-1] in "=U" else path[-1]), path
    loose = {r["path"]: r["cls"] for r in D.diff(spark.createDataFrame(left, NODE), spark.createDataFrame(right, NODE), content=D.ignore_content, metadata=False).collect()}
    assert loose["fileM"] == "=" and loose["fileU"] == "="


def test_equal_subtrees_are_skipped(spark):
    schema = "path string, node_type string, subtree string"
    a = spark.createDataFrame([("/d", "dir", "s1"), ("/d/x", "file", None), ("/e", "dir", "s2"), ("/e/y", "file", None)], schema)
    b = spark.createDataFrame([("/d", "dir", "s1"), ("/d/x", "file", None), ("/e", "dir", "s3"), ("/e/z", "file", None)], schema)
    left, right = D.without_equal_subtrees(a, b)
    assert sorted(r["path"] for r in left.collect()) == ["/d", "/e", "/e/y"] and sorted(r["path"] for r in right.collect()) == ["/d", "/e", "/e/z"]


def test_trees(spark):
    nodes = spark.createDataFrame([("/a/x", "file", "1", 5), ("/a/b/y", "file", "2", 7), ("/c/b/y", "file", "2", 7), ("/l", "symlink", None, 9)], "path string, node_type string, content string, size long")
    assert {r["dir"]: (r["files"], r["size"]) for r in T.roll_up(nodes).collect()} == {"": (4, 19), "/a": (2, 12), "/a/b": (1, 7), "/c": (1, 7), "/c/b": (1, 7)}
    assert {r["dir"]: r["n"] for r in T.descendants(nodes).collect()}["/a"] == 3
    hashes = {r["dir"]: r["id"] for r in T.identities(nodes, 3).collect()}
    assert hashes["/a/b"] == hashes["/c/b"] and hashes["/a"] != hashes["/c"] and len(hashes[""]) == 64
    assert tuple(T.listing_summary(nodes).first()) == (0, 4, 19) and tuple(T.listing_summary(nodes.limit(0)).first()) == (0, 0, 0)


def test_excludes(spark):
    df = spark.createDataFrame([("/a/x.rs",), ("/a/y.py",), ("/b/.mark",), ("/b/c/z",)], "path string")
    assert [r["path"] for r in df.where(S.not_excluded("path", ("!*", "*.py"))).collect()] == ["/a/y.py"]
    assert sorted(r["path"] for r in S.without_marked_directories(df, ".mark").collect()) == ["/a/x.rs", "/a/y.py"]
    assert [r["path"] for r in df.where(S.glob_matches("path", ("*.rs",), ("*.PY",))).collect()] == ["/a/x.rs", "/a/y.py"]


def test_blobs(spark):
    files = spark.createDataFrame([(1, "aaaabb"), (2, "aaaacc"), (3, ""), (4, None)], "id int, text string")
    chunks = B.fixed_chunks(files, 4, "id", "text")
    assert sorted((r["id"], r["pos"], r["chunk"]) for r in chunks.collect()) == [(1, 0, "aaaa"), (1, 1, "bb"), (2, 0, "aaaa"), (2, 1, "cc")]
    assert tuple(B.sizes(chunks).first())[:4] == (3, 4, 8, 12)
    assert {r["side"]: (r["blobs"], r["bytes"]) for r in B.shared_exclusive(chunks.where("id = 1"), chunks.where("id = 2")).collect()} == {"left": (1, 2), "right": (1, 2), "shared": (1, 4)}
    assert {r["id"]: r["data"] for r in B.byte_range(chunks, 3, 2, "id").collect()} == {1: "ab", 2: "ac"}


def test_prune(spark):
    index = spark.createDataFrame([("a", "p1", 10), ("b", "p1", 10), ("c", "p2", 10), ("d", "p3", 10), ("e", "p4", 30), ("f", "p4", 10)], "blob_id string, pack_id string, len long")
    used = spark.createDataFrame([("a",), ("c",), ("e",), ("e",)], "blob_id string")
    assert {r["pack_id"]: r["action"] for r in B.prune_plan(index, used).collect()} == {"p1": "repack", "p2": "keep", "p3": "remove", "p4": "repack"}
    assert {r["pack_id"]: r["action"] for r in B.prune_plan(index, used, max_repack=20, keep_packs=("p3",)).collect()} == {"p1": "repack", "p2": "keep", "p3": "keep", "p4": "keep-budget"}
    assert B.missing(spark.createDataFrame([("a",), ("zz",)], "blob_id string"), index).first()["blob_id"] == "zz"


def test_running_total(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("v"))
    out = B.running_total(df, [F.asc("id")], "v", "sum").orderBy("id").collect()
    total = 0
    for r in out:
        total += r["v"]
        assert r["sum"] == total


def test_content_defined_chunks_resist_shifts(spark):
    import random

    rng = random.Random(5)
    body = "".join(rng.choice("abcdefghij") for _ in range(60_000))
    out = B.rolling_chunks(spark.createDataFrame([(1, body), (2, "XYZ" + body), (3, ""), (4, None)], "id int, text string"), "id", "text").collect()
    a, b = ({r["blob_id"] for r in out if r["id"] == i} for i in (1, 2))
    assert len(a & b) > 0.8 * len(a) and sum(r["len"] for r in out if r["id"] == 1) == 60_000 and {r["id"] for r in out} == {1, 2}


def test_plans(spark):
    s = "path string, node_type string, size long, mtime long, content string"
    old = spark.createDataFrame([("a", "file", 1, 1, "x"), ("b", "file", 1, 1, "x"), ("d", "dir", None, 1, None)], s)
    new = spark.createDataFrame([("a", "file", 1, 1, "y"), ("b", "file", 2, 1, "x"), ("c", "file", 1, 1, "x"), ("d", "dir", None, 1, None)], s)
    summary = P.backup_summary(P.file_states(new, old)).first()
    assert (summary["files_new"], summary["files_changed"], summary["files_unmodified"], summary["dirs_unmodified"], summary["data_added"]) == (1, 1, 1, 1, 3)
    again = P.backup_summary(P.file_states(new, new)).first()
    assert again["data_added"] == 0  # an identical second backup adds nothing
    assert {r["path"]: r["action"] for r in P.restore_plan(new, old).collect()} == {"a": "unchanged", "b": "modify", "c": "restore", "d": "modify"}
    assert {r["path"]: r["action"] for r in P.restore_plan(new, old, verify=True).collect()}["a"] == "modify"
    merged = {r["path"]: r["content"] for r in P.merge_trees(old.withColumn("v", F.lit(1)).unionByName(new.withColumn("v", F.lit(2))), ["mtime", "v"]).collect()}
    assert merged["a"] == "y" and set(merged) == {"a", "b", "c", "d"}
    assert {r["path"]: (r["content"], r["source"]) for r in P.union_left_wins([old, new], "path").collect()}["a"] == ("x", 0)


def test_copy_and_rewrite(spark):
    df = snaps(spark, [("a", "2024-01-01"), ("b", "2024-01-02")])
    assert {r["id"]: r["relevant"] for r in P.copy_plan(df, df.where("id = 'a'")).collect()} == {"a": False, "b": True}
    assert all(r["relevant"] for r in P.copy_plan(df, df, force=True).collect())
    out = P.rewrite_snapshots(df, add_tags=("n",)).collect()
    assert {r["original"] for r in out} == {"a", "b"} and out[0]["tags"] == ["a", "n", "rewrite"] and out[0]["id"] != "a"
    assert P.rewrite_snapshots(df, forget=True).count() == 0  # nothing changed
    assert {r["pack_id"]: r["action"] for r in P.repair_index(spark.createDataFrame([("p",), ("q",)], "pack_id string"), spark.createDataFrame([("q",), ("r",)], "pack_id string")).collect()} == {"p": "add", "q": "keep", "r": "drop"}
