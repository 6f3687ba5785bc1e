"""Sinks: tables and JSON for people, NDJSON, and archives.  Archives stream rows to the driver one partition at a time."""

from __future__ import annotations

import base64
import gzip
import io
import json
import stat
import tarfile
import time
import zipfile
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import BinaryIO, Protocol, TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def markdown(df: DataFrame, most: int = 10_000) -> str:
    """A Markdown table with a bold header; numbers are aligned to the right.  A table of more than `most` rows is none for people: it raises."""
    numeric = {f.name for f in df.schema if f.dataType.typeName() in ("long", "integer", "double", "short", "byte", "float")}
    rows = [["" if v is None else str(v) for v in r] for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write them as a file")
    head = [f"**{c}**" for c in df.columns]
    wide = [max([len(h), *(len(r[i]) for r in rows)]) for i, h in enumerate(head)]
    line = lambda r: "| " + " | ".join(v.rjust(w) if c in numeric else v.ljust(w) for v, w, c in zip(r, wide, df.columns, strict=True)) + " |"
    return "\n".join([line(head), "|" + "|".join("-" * (w + 1) + (":" if c in numeric else "-") for w, c in zip(wide, df.columns, strict=True)) + "|", *map(line, rows)])


def item_json(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One JSON object a row, {group_key, item} where there are groups: what a distributed writer takes."""
    rest = F.struct(*[c for c in df.columns if c not in by])
    return df.select(F.to_json(F.struct(F.struct(*by).alias("group_key"), rest.alias("item")) if by else rest).alias("json"))


def grouped_json(df: DataFrame, out: TextIO, by: Sequence[str] = ()) -> int:
    """Pretty JSON: a list of {group_key, items} in order of the keys, or a bare list without groups.  Rows stream to the driver in order,
    so no group is held anywhere as a whole."""
    rest = [c for c in df.columns if c not in by]
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    order = [*by, *rest]
    n, open_ = 0, None
    out.write("[")
    for r in df.orderBy(*order).select(key.alias("key"), F.to_json(F.struct(*rest)).alias("item")).toLocalIterator():
        if by and r["key"] != open_:
            out.write("" if open_ is None else "\n  ]}")
            out.write((",\n" if open_ is not None else "\n") + ' {"group_key": ' + r["key"] + ', "items": [')
            open_, n = r["key"], 0
        out.write((",\n" if n else "\n") + ("   " if by else " ") + r["item"])
        n += 1
    out.write(("\n  ]}" if open_ is not None else "") + "\n]\n")
    return n


def paths_json(nodes: DataFrame, out: TextIO) -> int:
    """A JSON array of all paths, in order."""
    n = 0
    out.write("[")
    for r in nodes.select("path").orderBy("path").toLocalIterator():
        out.write((",\n " if n else "\n ") + json.dumps(r["path"], ensure_ascii=False))
        n += 1
    out.write("\n]\n")
    return n


def status_line(position: int, length: int | None, seconds: float) -> str:
    """One line of progress for scripts."""
    share = min(position / length, 1.0) if length else None
    return json.dumps({"message_type": "status", "seconds_elapsed": int(seconds), "bytes_done": position} | ({"percent_done": share, "total_bytes": length} if share is not None else {}))


class Progress(Protocol):
    """What is told of long writes: bytes done so far, and of how many, where that is known."""

    def __call__(self, done: int, length: int | None) -> None: ...


def json_progress(out: TextIO, every: float = 10.0) -> Progress:
    """Progress as status lines, at most one in `every` seconds."""
    begun = last = time.monotonic()

    def tell(done: int, length: int | None) -> None:
        nonlocal last
        if (now := time.monotonic()) - last >= every:
            last = now
            out.write(status_line(done, length, now - begun) + "\n")

    return tell


def ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def archive_kind(path: str, is_dir: bool) -> str:
    """tar, tar.gz, zip or content: by extension, else tar for directories and content for files."""
    for end, kind in ((".tar.gz", "tar.gz"), (".tgz", "tar.gz"), (".tar", "tar"), (".zip", "zip")):
        if path.endswith(end):
            return kind
    return "tar" if is_dir else "content"


def _mode(row: dict) -> int:
    return row["mode"] & 0o7777 if row.get("mode") is not None else (0o755 if row["node_type"] == "dir" else 0o644)


def told(rows: Iterator, progress: Progress | None) -> Iterator:
    """The rows, with the bytes of their contents told as they go by."""
    done = 0
    for r in rows:
        yield r
        done += len(r["content"] or b"")
        if progress:
            progress(done, None)


def dump(nodes: DataFrame, out: BinaryIO, kind: str = "content", progress: Progress | None = None) -> int:
    """Writes nodes (path, node_type, content binary, and mode, mtime, uid, gid, user, group, link_target where known) in path order."""
    rows = told(nodes.orderBy("path").toLocalIterator(), progress)
    n = 0
    if kind == "content":
        for r in rows:
            if r["node_type"] == "file":
                out.write(bytes(r["content"] or b""))
                n += 1
        return n
    if kind == "zip":
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for r in rows:
                name = r["path"].lstrip("/") + ("/" if r["node_type"] == "dir" else "")
                row = r.asDict()
                info = zipfile.ZipInfo(name, max(time.gmtime(int(row.get("mtime") or 0))[:6], (1980, 1, 1, 0, 0, 0)))  # the format knows no earlier time
                link = row["node_type"] == "symlink"
                info.external_attr = ((stat.S_IFDIR if row["node_type"] == "dir" else stat.S_IFLNK if link else stat.S_IFREG) | _mode(row)) << 16
                info.compress_type = zipfile.ZIP_DEFLATED
                z.writestr(info, (row.get("link_target") or "").encode() if link else bytes(r["content"] or b""))
                n += 1
        return n
    raw = gzip.GzipFile(fileobj=out, mode="wb", mtime=0) if kind == "tar.gz" else out
    kinds = {"dir": tarfile.DIRTYPE, "symlink": tarfile.SYMTYPE, "fifo": tarfile.FIFOTYPE, "dev": tarfile.BLKTYPE, "chardev": tarfile.CHRTYPE}
    with tarfile.open(fileobj=raw, mode="w") as tar:
        for r in rows:
            row, data = r.asDict(), bytes(r["content"] or b"") if r["node_type"] == "file" else b""
            info = tarfile.TarInfo(row["path"].lstrip("/"))
            info.type, info.size = kinds.get(row["node_type"], tarfile.REGTYPE), len(data)
            info.mode, info.uid, info.gid, info.uname, info.gname = _mode(row), row.get("uid") or 0, row.get("gid") or 0, row.get("user") or "", row.get("group") or ""
            info.mtime, info.linkname = int(row.get("mtime") or 0), row.get("link_target") or ""
            tar.addfile(info, io.BytesIO(data) if data else None)
            n += 1
    if raw is not out:
        raw.close()
    return n


def metrics_text(metrics: DataFrame, labels: dict[str, str]) -> str:
    """Gauges in the text exposition format; empty labels are left out."""
    tags = ",".join(f"{k}={json.dumps(v)}" for k, v in sorted(labels.items()) if v)
    return "".join(f"{r['metric']}{{{tags}}} {r['value']}\n" for r in metrics.orderBy("metric").collect())


def push_path(job: str, labels: dict[str, str]) -> str:
    """The path of a push gateway: job and grouping labels in URL-safe base64; empty labels are left out."""
    code = lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("=")
    return "/".join(["metrics", "job@base64", code(job), *[x for k, v in labels.items() if v for x in (f"{k}@base64", code(v))]])


def gauge_points(metrics: DataFrame, labels: dict[str, str]) -> dict:
    """Gauges as resource metrics of the open telemetry JSON form: whole numbers as integers, others as doubles."""
    point = lambda v: {"asInt": str(int(v))} if float(v).is_integer() else {"asDouble": v}
    attributes = [{"key": k, "value": {"stringValue": v}} for k, v in sorted(labels.items()) if v]
    return {"resourceMetrics": [{"resource": {"attributes": attributes}, "scopeMetrics": [{"metrics": [{"name": r["metric"], "gauge": {"dataPoints": [point(r["value"])]}} for r in metrics.orderBy("metric").collect()]}]}]}


class MetricsExporter(Protocol):
    """Where metrics go; `send` of the exporters below takes a path or an empty one, and the body."""

    def push(self, metrics: DataFrame) -> None: ...


@dataclass(frozen=True)
class TextPush:
    job: str
    labels: dict[str, str]
    send: Callable[[str, str], None]

    def push(self, metrics: DataFrame) -> None:
        self.send(push_path(self.job, self.labels), metrics_text(metrics, {}))


@dataclass(frozen=True)
class JsonPush:
    labels: dict[str, str]
    send: Callable[[str, str], None]

    def push(self, metrics: DataFrame) -> None:
        self.send("", json.dumps(gauge_points(metrics, self.labels)))
