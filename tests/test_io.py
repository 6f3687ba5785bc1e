"""Sources, sinks, profiles, hooks and streams."""

import io
import json
import tarfile
import zipfile

import pytest

from stratum import config
from stratum.sources import readers, sinks
from stratum.streaming import incremental


def test_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"x" * 100)
    rows = {r["path"].rsplit("/", 1)[1]: r["size"] for r in readers.files(spark, str(tmp_path)).collect()}
    assert rows == {"a.txt": 3, "b.bin": 100}
    assert readers.files(spark, str(tmp_path), globs=("!*.txt",), larger_than=1000).count() == 1
    assert tuple(readers.scan_size(readers.files(spark, str(tmp_path), larger_than=50)).first()) == (1, 3)
    assert bytes(readers.command_output(spark, ["printf", "hi"]).first()["content"]) == b"hi"
    with pytest.raises(Exception):
        readers.command_output(spark, ["false"])


def test_repository(spark, tmp_path):
    repo = readers.Repository(spark, str(tmp_path))
    repo.write("snapshots", spark.sql("select 'aa1' as id, timestamp'2024-01-01' as time union all select 'ab2', timestamp'2024-01-02'"))
    assert [r["id"] for r in repo.snapshots("latest").collect()] == ["ab2"] and repo.ids("snapshots").count() == 2
    assert repo.row("snapshots", "aa").first()["json"].startswith('{"id":"aa1"')
    repo.append_only = True
    with pytest.raises(PermissionError):
        repo.write("snapshots", repo.snapshots(), mode="overwrite")
    nested = spark.sql("select 'i' as id, array(struct('p' as pack_id, array(struct('b' as blob_id, 'data' as blob_type, 5L as length, cast(null as bigint) as uncompressed_length)) as blobs)) as packs")
    assert tuple(readers.index_entries(nested).first()) == ("i", "p", "data", "b", 5, 0)


def test_archives(spark):
    nodes = spark.createDataFrame([("/d", "dir", None, None), ("/d/b", "file", bytearray(b"two"), None), ("/d/a", "file", bytearray(b"one"), None), ("/d/l", "symlink", None, "a")], "path string, node_type string, content binary, link_target string")
    out = io.BytesIO()
    assert sinks.dump(nodes, out) == 2 and out.getvalue() == b"onetwo"
    for kind in ("tar", "tar.gz"):
        out = io.BytesIO()
        sinks.dump(nodes, out, kind)
        tar = tarfile.open(fileobj=io.BytesIO(out.getvalue()))
        assert tar.getnames() == ["d", "d/a", "d/b", "d/l"] and tar.extractfile("d/a").read() == b"one" and tar.getmember("d/l").linkname == "a" and tar.getmember("d").mode == 0o755
    out = io.BytesIO()
    sinks.dump(nodes, out, "zip")
    assert zipfile.ZipFile(io.BytesIO(out.getvalue())).read("d/b") == b"two"
    assert [sinks.archive_kind(*a) for a in (("x.tgz", False), ("x.zip", True), ("x", True), ("x", False))] == ["tar.gz", "zip", "tar", "content"]


def test_texts(spark):
    df = spark.createDataFrame([("a", 1), ("b", 22)], "name string, n long")
    assert sinks.markdown(df) == "| **name** | **n** |\n|----------|------:|\n| a        |     1 |\n| b        |    22 |"
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(5), most=4)
    bare, grouped = io.StringIO(), io.StringIO()
    sinks.grouped_json(df, bare)
    sinks.grouped_json(df.unionByName(df.selectExpr("name", "n + 1 as n")), grouped, ["name"])
    assert json.loads(bare.getvalue()) == [{"name": "a", "n": 1}, {"name": "b", "n": 22}]
    assert json.loads(grouped.getvalue()) == [{"group_key": {"name": "a"}, "items": [{"n": 1}, {"n": 2}]}, {"group_key": {"name": "b"}, "items": [{"n": 22}, {"n": 23}]}]
    none = io.StringIO()
    sinks.grouped_json(df.limit(0), none, ["name"])
    assert json.loads(none.getvalue()) == []
    assert sorted(r["json"] for r in sinks.item_json(df, ["name"]).collect())[0] == '{"group_key":{"name":"a"},"item":{"n":1}}'
    out = io.StringIO()
    assert sinks.paths_json(spark.createDataFrame([("/b",), ('/a"x',)], "path string"), out) == 2 and json.loads(out.getvalue()) == ['/a"x', "/b"]
    assert json.loads(sinks.status_line(5, 20, 3.7)) == {"message_type": "status", "seconds_elapsed": 3, "bytes_done": 5, "percent_done": 0.25, "total_bytes": 20}


def test_metrics_exporters(spark):
    metrics, sent = spark.createDataFrame([("m", 1.0), ("d", 1.5)], "metric string, value double"), []
    assert sinks.metrics_text(metrics.where("metric = 'm'"), {"host": "h", "none": ""}) == 'm{host="h"} 1.0\n'
    labels = {"abc": "xyz", "path": "/my/path", "tags": "a,b,cde", "nogroup": ""}
    sinks.TextPush("test_job", labels, lambda path, body: sent.append((path, body))).push(metrics)
    assert sent == [("metrics/job@base64/dGVzdF9qb2I/abc@base64/eHl6/path@base64/L215L3BhdGg/tags@base64/YSxiLGNkZQ", "d{} 1.5\nm{} 1.0\n")]
    sinks.JsonPush(labels, lambda path, body: sent.append(json.loads(body))).push(metrics)
    own = sent[1]["resourceMetrics"][0]
    assert [m["gauge"]["dataPoints"][0] for m in own["scopeMetrics"][0]["metrics"]] == [{"asDouble": 1.5}, {"asInt": "1"}] and len(own["resource"]["attributes"]) == 3


def test_archives_keep_metadata(spark):
    nodes = spark.sql("select * from values ('/d', 'dir', cast(null as binary), cast(null as string), 488L, 7L, 8L, 'u', 'g', 1000000000L), ('/d/f', 'file', binary('x'), null, 384L, 7L, 8L, 'u', 'g', 1000000000L), ('/d/l', 'symlink', null, 'f', null, 7L, 8L, 'u', 'g', 0L) t(path, node_type, content, link_target, mode, uid, gid, user, group, mtime)")
    out = io.BytesIO()
    sinks.dump(nodes, out, "tar")
    f = tarfile.open(fileobj=io.BytesIO(out.getvalue())).getmember("d/f")
    assert (f.mode, f.uid, f.gid, f.uname, f.gname, f.mtime) == (0o600, 7, 8, "u", "g", 1000000000)
    out = io.BytesIO()
    sinks.dump(nodes, out, "zip")
    z = zipfile.ZipFile(io.BytesIO(out.getvalue()))
    assert z.getinfo("d/f").external_attr >> 16 == 0o100600 and z.getinfo("d/f").date_time[:3] == (2001, 9, 9) and z.read("d/l") == b"f" and z.getinfo("d/l").external_attr >> 28 == 0o12 and z.getinfo("d/").external_attr >> 16 == 0o40750


def test_progress_and_lines(spark, tmp_path):
    nodes = spark.createDataFrame([("/a", "file", bytearray(b"one")), ("/b", "file", bytearray(b"three"))], "path string, node_type string, content binary")
    lines, seen = io.StringIO(), []
    sinks.dump(nodes, io.BytesIO(), progress=sinks.json_progress(lines, every=0.0))
    sinks.dump(nodes, io.BytesIO(), progress=lambda done, length: seen.append(done))
    assert [json.loads(x)["bytes_done"] for x in lines.getvalue().splitlines()] == seen == [3, 8]
    sinks.ndjson(nodes.select("path"), str(tmp_path / "out"))
    assert sorted(r["path"] for r in spark.read.json(str(tmp_path / "out")).collect()) == ["/a", "/b"]


def test_versions_config_and_keys(spark, tmp_path):
    repo = readers.Repository(spark, str(tmp_path / "r"), hot_uri=None, cache=True)
    repo.init({"chunker": "rabin", "version": "2"}, keys=spark.createDataFrame([("k1", "u"), ("k2", "v")], "id string, username string"))
    with pytest.raises(ValueError):
        repo.init({})
    assert repo.config() == {"chunker": "rabin", "version": "2"} and repo.change_config(version="2") is False and repo.change_config(version="3") is True and repo.config()["version"] == "3"
    with pytest.raises(PermissionError):
        repo.remove_keys(["k1", "k2"], used="k1")
    assert repo.remove_keys(["k2"], used="k1") == 1 and [r["id"] for r in repo.table("keys").collect()] == ["k1"] and repo.versions("keys") == [0, 1]
    assert repo.save("keys", spark.createDataFrame([("k3", "w")], "id string, username string")) == 2 and repo.ids("keys").count() == 2
    (tmp_path / "r/keys@9").mkdir()  # a version that was not written to its end
    assert repo.versions("keys") == [0, 1, 2]
    repo.append_only = True
    with pytest.raises(PermissionError):
        repo.save("keys", drop=repo.ids("keys"))
    for operation in ("forget", "prune", "config"):
        with pytest.raises(PermissionError):
            repo.guard(operation)
    with pytest.raises(ValueError):
        repo.init({}, hot_only=True)
    hot = readers.Repository(spark, str(tmp_path / "r"), hot_uri=str(tmp_path / "hot"))
    hot.init({}, hot_only=True)
    assert hot.ids("keys").count() == 2 and (tmp_path / "hot/keys").exists()
    raw = {r["id"]: bytes(r["content"])[:4] for r in readers.raw_object(spark, str(tmp_path / "r"), "keys", "part-").collect()}
    assert raw and set(raw.values()) == {b"PAR1"}


def test_remote_sources_stand_alone(spark):
    with pytest.raises(ValueError):
        readers.files(spark, "s3a://bucket/x", "/local")


def test_node_at(spark):
    s = spark.sql("select * from values ('aa1', timestamp'2024-01-01'), ('ab2', timestamp'2024-01-02') t(id, time)")
    n = spark.sql("select * from values ('aa1', '/x', 1), ('ab2', '/x', 2), ('ab2', '/x/y', 3) t(snapshot_id, path, size)")
    assert readers.node_at(s, n, "latest:x").first()["size"] == 2 and readers.node_at(s, n, "aa:/x/").first()["size"] == 1 and readers.node_at(s, n, "ab2").count() == 2
    for odd in ("latest:/nowhere", "zz:/x", "a:/x"):
        with pytest.raises(Exception, match="no node|no snapshot|several"):
            readers.node_at(s, n, odd).collect()
    with pytest.raises(ValueError):
        readers.node_at(s, n, "./local")


def test_logging(tmp_path, capsys):
    log = config.set_up_logging("info", str(tmp_path / "log"), {"quiet": "error"}, dry_run=True)
    log.info("hello")
    log.debug("nothing")
    config.logging.getLogger("stratum.quiet").info("nothing")
    text = (tmp_path / "log").read_text()
    assert text.startswith("[dry run] ") and "hello" in text and "nothing" not in text
    config.set_up_logging()


def test_profiles(tmp_path):
    (tmp_path / "a.toml").write_text('[global]\nuse-profiles = ["b"]\nrun-before = ["1"]\n[repository]\nrepository = "${HERE}/r"\n')
    (tmp_path / "b.toml").write_text('[global]\nrun-before = ["2"]\n[repository]\nrepository = "other"\npassword = "x"\n')
    got = config.load_profile("a", [tmp_path], {"HERE": "/h"})
    assert got["repository"] == {"repository": "/h/r", "password": "x"} and got["global"]["run-before"] == ["1", "2"]
    (tmp_path / "c.toml").write_text('[global]\nuse-profiles = ["c"]\n')
    with pytest.raises(ValueError):
        config.load_profile("c", [tmp_path])
    with pytest.raises(FileNotFoundError):
        config.load_profile("nowhere", [tmp_path])


def test_hook_order():
    log = []

    def run(c):
        log.append(c)
        if c == "bad":
            raise RuntimeError(c)

    level = lambda n, first="before": config.Hooks([f"{n} {first}"], [f"{n} after"], [f"{n} failed"], [f"{n} finally"])
    with config.hooked(level("global"), run), config.hooked(level("backup"), run):
        log.append("work")
    assert log == ["global before", "backup before", "work", "backup after", "backup finally", "global after", "global finally"]
    log.clear()
    with pytest.raises(RuntimeError), config.hooked(level("global"), run), config.hooked(config.Hooks(["bad"], [], ["failed"], ["finally"]), run), config.hooked(level("inner"), run):
        log.append("work")
    assert log == ["global before", "bad", "failed", "finally", "global failed", "global finally"]


def test_stream(spark, tmp_path):
    schema = "id string, time timestamp, hostname string, summary struct<total_bytes_processed: long>"
    rows = spark.sql("select id, timestamp(time) as time, hostname, named_struct('total_bytes_processed', size) as summary from values ('a', '2024-01-01 10:00', 'h', 1L), ('a', '2024-01-01 10:00', 'h', 1L), ('b', '2024-01-01 11:00', 'h', 2L), ('c', '2024-01-03', 'h', 4L) t(id, time, hostname, size)")
    rows.write.parquet(str(tmp_path / "in"))
    q = incremental.append_new(incremental.once_each(incremental.new_snapshots(spark, str(tmp_path / "in"), schema)), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
    totals = incremental.window_totals(incremental.new_snapshots(spark, str(tmp_path / "in"), schema)).writeStream.format("memory").queryName("totals").outputMode("append").trigger(availableNow=True).start()
    totals.awaitTermination(120)
    assert [(r["n"], r["size"]) for r in spark.sql("select * from totals order by start").collect()][:1] == [(3, 4)]
    batch = incremental.sessions(spark.read.schema(schema).parquet(str(tmp_path / "in")), "90 minutes").orderBy("start").collect()
    assert [r["n"] for r in batch] == [3, 1]


def test_walk_and_inventory(spark, tmp_path):
    import os

    (tmp_path / "data/ab").mkdir(parents=True)
    (tmp_path / "data/ab/abcd").write_bytes(b"123")
    (tmp_path / "keys").mkdir()
    (tmp_path / "keys/k1").write_text('{"username": "u", "hostname": "h"}')
    (tmp_path / "keys/k2").write_text("{not json")
    os.symlink("keys", tmp_path / "link")
    readers.register_walk(spark)
    rows = {r["path"].removeprefix(str(tmp_path)): r for r in spark.read.format("stratum_walk").load(str(tmp_path)).collect()}
    assert set(rows) == {"/data", "/data/ab", "/data/ab/abcd", "/keys", "/keys/k1", "/keys/k2", "/link"}
    assert rows["/link"]["node_type"] == "symlink" and rows["/link"]["link_target"] == "keys" and rows["/data/ab/abcd"]["size"] == 3 and rows["/data"]["node_type"] == "dir"
    found = {r["id"]: (r["file_type"], r["size"]) for r in readers.inventory(spark, str(tmp_path)).collect()}
    assert found["abcd"] == ("data", 3) and found["k1"][0] == "keys"
    assert [r["username"] for r in readers.json_objects(spark, str(tmp_path / "keys"), "username string, hostname string").collect()] == ["u"]


def test_more_filters(spark):
    from pyspark.sql import functions as F

    from stratum.operators import details as V
    from stratum.operators import filters as S

    df = spark.sql("select * from values ('a', 5L, 1L, array(named_struct('name', 'user.skip', 'value', binary('')))), ('b', cast(null as bigint), 2L, null) t(path, size, device, xattrs)")
    assert [r["path"] for r in df.where(S.without_attribute("user.skip")).collect()] == ["b"]
    assert [r["path"] for r in df.where(S.not_larger_than(4)).collect()] == ["b"]
    assert [r["path"] for r in S.on_one_file_system(df.withColumn("root", F.lit("/")), spark.sql("select '/' as root, 1L as device")).collect()] == ["a"]
    line = V.summary_json(spark.sql("select '' as id, named_struct('files_new', 1L, 'label', cast(null as string)) as summary")).first()["json"]
    assert line == '{"message_type":"summary","files_new":1}'
    assert tuple(V.widths(spark.sql("select 'abc' as a, 12345 as bb")).first()) == (3, 5)
