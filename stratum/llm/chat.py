"""Operator 9: chat formatting of reply trees.

Messages form trees (node, parent).  Iterative self-joins enumerate every root-to-leaf path: jump
tables (1, 2, 4, ... steps up) are made by joining the last one with itself, until none is left; what is
left after as many steps as a conversation has messages leads into a cycle.  Then the paths' members double with each table, so a
tree of depth d takes log2(d) rounds.  Paths are ranked within their conversation by the
sum of their nodes' scores (ties by the least leaf), and each chosen path is formatted as one conversation.

The template marks turns as <|role|>\\n text <|end|>\\n.  Inside texts and roles the characters that
begin control strings (of this template and of the common <s> and [INST] ones) are written as
backslash codes, so no control string can stand there; `unescape` undoes it exactly.

Defined results: null text and role are empty; an unknown parent makes a root; paths that meet a cycle
reach no root and are left out; equal turns are ordered by role, then text, and repeated rows are
repeated turns; a row without a conversation id is a conversation of its own (equal ones together); a null score is 0; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.llm.common import arrow_map, materialize, table

_CODES = {"\\": "\\\\", "<": "\\l", "[": "\\b", "|": "\\p"}
_escape = str.maketrans(_CODES)
_chars = {v: k for k, v in _CODES.items()}
_turn = re.compile(r"<\|([^|]*)\|>\n([^<]*)<\|end\|>\n")
END = "<|end|>\n"


def escape(text: str) -> str:
    return text.translate(_escape)


def unescape(text: str) -> str:
    return re.sub(r"\\[\\lbp]", lambda m: _chars[m[0]], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of it under the loss mask (assistant texts)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<|{escape(role)}|>\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in _turn.findall(formatted)]


def reply_paths(nodes: DataFrame) -> DataFrame:
    """nodes(conv string, node long, parent long, score double), (conv, node) unique and not null ->
    one row for each node of each root-to-leaf path: (conv, leaf, node, up), up = steps from the leaf."""
    nodes = nodes.select("conv", "node", "parent")
    known = nodes.select("conv", F.col("node").alias("parent"))
    jump = materialize(nodes.where("parent is not null").join(known, ["conv", "parent"], "left_semi")
                       .select("conv", "node", F.col("parent").alias("to")))
    most = nodes.groupBy("conv").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    jumps, step = [jump], 1
    while step < most and not jumps[-1].isEmpty():
        last = jumps[-1]
        jumps.append(materialize(last.join(last.select("conv", F.col("node").alias("to"), F.col("to").alias("next")), ["conv", "to"])
                                 .select("conv", "node", F.col("next").alias("to"))))
        step *= 2
    leaves = nodes.join(jump.select("conv", F.col("to").alias("node")), ["conv", "node"], "left_anti")
    if not jumps[-1].isEmpty():  # what still has somewhere to go after so many steps goes round in a cycle
        leaves = leaves.join(jumps[-1].select("conv", "node"), ["conv", "node"], "left_anti")
    paths = materialize(leaves.select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))
    for i, jump in enumerate(jumps):
        more = paths.join(jump, ["conv", "node"]).select("conv", "leaf", F.col("to").alias("node"), (F.col("up") + (1 << i)).alias("up"))
        paths = materialize(paths.unionByName(more), paths, jump)
    return paths


def ranked(paths: DataFrame, slices: int) -> DataFrame:
    """paths(conv, leaf, score, ...) with rank within each conversation: best score first, ties by leaf.  Ranges of the order are ranked
    by themselves and then set off by the sizes of those before, so a conversation of very many paths is no single task."""
    order = [F.col("conv"), F.desc("score"), F.col("leaf")]
    slim = paths.select("conv", "leaf", "score").repartitionByRange(slices, *order)
    cut = materialize(slim.withColumn("part", F.spark_partition_id()))
    sizes = cut.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("conv", "part", F.coalesce("before", F.lit(0)).alias("before"))
    own = cut.withColumn("own", F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order[1:])))
    return paths.join(own.join(before, ["conv", "part"]).select("conv", "leaf", (F.col("own") + F.col("before")).cast("long").alias("rank")), ["conv", "leaf"])


def format_trees(messages: DataFrame, top: int | None = None) -> DataFrame:
    """messages(conv string, node long, parent long, role, text, score double) -> one row for each chosen path:
    conv, leaf, rank, score, formatted, loss array<struct<start, end>> in code points.

    `top` keeps the best-ranked paths of each conversation; None keeps all."""
    messages = messages.select("conv", "node", "parent", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score"))
    rows = reply_paths(messages).join(messages.drop("parent"), ["conv", "node"])
    paths = materialize(rows.groupBy("conv", "leaf").agg(
        F.sum("score").alias("score"),
        F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns")))
    paths = ranked(paths, messages.sparkSession.sparkContext.defaultParallelism)
    if top is not None:
        paths = paths.where(F.col("rank") <= top)

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            done = [render([(t["role"], t["text"]) for t in turns]) for turns in batch.column("turns").to_pylist()]
            loss = pa.array([[{"start": a, "end": b} for a, b in spans] for _, spans in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            return pa.record_batch({k: batch.column(k) for k in ("conv", "leaf", "rank", "score")} | {"formatted": pa.array([f for f, _ in done], pa.string()), "loss": loss})
        return apply

    return arrow_map(paths.select("conv", "leaf", "rank", "score", "turns"), make, "conv string, leaf long, rank long, score double, formatted string, loss array<struct<start: long, end: long>>")


def threads(conversations: DataFrame) -> DataFrame:
    """A table of turns (conv_id, turn, role, text) as trees: each turn replies to the one before it.  A path's score is the
    length of what the assistant says in it."""
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    alone = F.concat(F.lit("null:"), F.hex(F.xxhash64("turn", "role", "text")))
    return conversations.select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), alone).alias("conv"), "turn", "role", "text") \
        .withColumn("node", F.row_number().over(order).cast("long")) \
        .select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.when(F.col("role") == "assistant", F.length("text")).cast("double").alias("score"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what stands in the output: conv, rank, score, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"]:s["end"]]) for s in spans)
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest())
                out["loss_chars"].append(len(loss))
                out["loss_sha256"].append(hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest())
                out["formatted_chars"].append(len(text))
            return pa.record_batch({k: batch.column(k) for k in ("conv", "rank", "score")} | out)
        return apply

    return arrow_map(formatted.select("conv", "rank", "score", "formatted", "loss"), make, "conv string, rank long, score double, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], rows.schema)
    out = read_back(format_trees(threads(rows.unionByName(odd))))
    return out.select(F.when(F.col("conv").startswith("="), F.substring("conv", 2, 40).cast("long")).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rank", "score")


_ESCAPED = "replace(replace(replace(replace({0}, '\\', '\\\\'), '<', '\\l'), '[', '\\b'), '|', '\\p')"
OP9_SQL = f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
k as (select *, case when conv_id is null then struct_pack(t := turn, r := role, x := text) end as alone from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + {len("<||>") + 1 + len(END)}) as bigint) as formatted_chars,
       cast(1 as bigint) as rank, cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as double) as score
from k group by conv_id, alone"""
