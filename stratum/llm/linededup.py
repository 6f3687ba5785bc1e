"""Operator 8: line dedup by content-defined line chunks.

A text is cut into chunks of whole lines.  A long line (LONG words or more) is a chunk by itself.  In a run of
shorter lines a boundary stands at every line whose rolling hash (over it and the line before) is less than one of
its neighbours', so every two lines in a row hold one, and boundaries depend on nearby lines only: an insertion shifts none
further on.  A chunk goes from a boundary line to the next one, both included (or to the run's end), so it has two lines at least.
Of five short lines that repeat, all boundaries but the outermost are the same in every copy, so they share a whole chunk, and no more than
NEAR lines of a repeated run are left outside of its shared chunks and long lines.  Chunks whose hash
occurs more than once in the corpus are compared byte by byte with their first occurrence
(smallest id, then place), and so are the NEAR short lines next to them to both sides, going outwards.  Lines found equal are marked in every later occurrence, and a run of
marked lines is removed if it has at least two lines and `min_words` words, or is one line of `long_words`.
A removed line always has an equal one at an earlier place, so nothing is lost from the corpus.

Only chunks that probably repeat (by a Bloom filter of the repeated hashes, at most 2^26 bits; a fuller filter lets more
pass, but loses none) carry their bytes into the comparison.

Defined results: null text stays null; a text of which every line goes becomes empty; rows equal in id
and text count as one document and all stay as that one; null ids come first in the order; other
columns are ignored (the pipeline stage keeps them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.common import arrow_map, forget, materialize, named, row_key, table

LONG, NEAR, MIN_WORDS, LONG_WORDS, MAX_FILTER_BITS = 12, 4, 20, 50, 26
_HASHES = 3


def chunks(lines: list[str]) -> list[tuple[int, int]]:
    """Chunks as (first line, end) in order; they cover all lines, and chunks of short lines share their boundary line."""
    from xxhash import xxh3_64_intdigest as xxh

    out, start = [], 0
    for end in [i for i, line in enumerate(lines) if line.count(" ") + 1 >= LONG] + [len(lines)]:
        if start < end:
            rolled, last = [], 0
            for line in lines[start:end]:
                own = xxh(line)
                rolled.append((last * 0x9E3779B97F4A7C15 + own) & 0xFFFFFFFFFFFFFFFF)
                last = own
            n, begin = end - start, 0
            for i in range(1, n - 1):
                if rolled[i] <= rolled[i - 1] or rolled[i] <= rolled[i + 1]:
                    out.append((start + begin, start + i + 1))
                    begin = i
            out.append((start + begin, end))
        if end < len(lines):
            out.append((end, end + 1))
        start = end + 1
    return out


def _key(lines: list[str], a: int, b: int) -> int:
    from xxhash import xxh3_64_intdigest as xxh

    return xxh(lines[a] if b == a + 1 else "\n".join(lines[a:b]))


def _near(lines: list[str], places) -> list[str]:
    """The short lines next to a chunk, going outwards."""
    out = []
    for i in places:
        if lines[i].count(" ") + 1 >= LONG:
            break
        out.append(lines[i])
    return out


def _positions(key: Column, bits: int) -> list[Column]:
    one, two = key.bitwiseAND(0x7FFFFFFF), F.shiftrightunsigned(key, 32).bitwiseAND(0x7FFFFFFF)
    return [(one + F.lit(i) * two).bitwiseAND((1 << bits) - 1) for i in range(_HASHES)]


def _filter_of(repeated: DataFrame) -> tuple[int, np.ndarray]:
    n = repeated.count()
    bits = min(max(15, int(np.ceil(np.log2(max(1, n) * 12)))), MAX_FILTER_BITS)
    at = repeated.select(F.explode(F.array(*_positions(F.col("key"), bits))).alias("at")).select((F.col("at") + 1).alias("at"))
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m")).collect()  # at most 2048 rows of 4 KiB
    data = np.zeros((1 << bits) // 8, np.uint8)
    for p in parts:
        data[(p["b"] - 1) * 4096:p["b"] * 4096] = np.frombuffer(p["m"], np.uint8)
    return bits, data


def marked_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(rk, marks array<struct<a, b>>): lines a <= i < b have equal bytes at an earlier place."""
    rows = docs.select(row_key(key, text).alias("rk"), F.col(key).alias("id"), F.col(text).alias("text")).where("text is not null")
    id_type = rows.schema["id"].dataType.simpleString()

    def keys():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = []
            for t in batch.column("text").to_pylist():
                lines = t.split("\n")
                found += [_key(lines, a, b) for a, b in chunks(lines)]
            return pa.record_batch({"key": pa.array(np.array(found, np.uint64).view(np.int64))})
        return apply

    repeated = materialize(arrow_map(rows.select("text"), keys, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    bits, data = _filter_of(repeated)
    forget(repeated)
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def bodies():
        held = shared.value

        def repeated_of(h: np.ndarray) -> np.ndarray:
            one, two = h & np.uint64(0x7FFFFFFF), (h >> np.uint64(32)) & np.uint64(0x7FFFFFFF)
            may = np.ones(len(h), bool)
            for i in range(_HASHES):
                at = (one + np.uint64(i) * two) & np.uint64((1 << bits) - 1)
                may &= held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1
            return np.flatnonzero(may)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            out: dict[str, list] = {c: [] for c in ("key", "d", "a", "b", "left", "body", "right")}
            for d, t in enumerate(batch.column("text").to_pylist()):  # one text at a time: only what may repeat is held
                lines = t.split("\n")
                cuts = chunks(lines)
                h = np.array([_key(lines, a, b) for a, b in cuts], np.uint64)
                for i in repeated_of(h).tolist():
                    a, b = cuts[i]
                    out["key"].append(h[i])
                    out["d"].append(d)
                    out["a"].append(a)
                    out["b"].append(b)
                    out["left"].append(_near(lines, range(a - 1, max(-1, a - 1 - NEAR), -1)))
                    out["body"].append("\n".join(lines[a:b]))
                    out["right"].append(_near(lines, range(b, min(len(lines), b + NEAR))))
            if not out["d"]:
                return None
            rows, strings = pa.array(out["d"]), pa.list_(pa.string())
            return pa.record_batch({
                "key": pa.array(np.array(out["key"], np.uint64).view(np.int64)), "rk": batch.column("rk").take(rows), "id": batch.column("id").take(rows), "a": pa.array(out["a"], pa.int32()), "b": pa.array(out["b"], pa.int32()),
                "left": pa.array(out["left"], strings), "body": pa.array(out["body"], pa.string()), "right": pa.array(out["right"], strings)})
        return apply

    held = materialize(arrow_map(rows, bodies, f"key long, rk string, id {id_type}, a int, b int, left array<string>, body string, right array<string>"))
    place = F.struct("id", "rk", "a")
    first = materialize(held.groupBy("key").agg(F.count("*").alias("n"), F.min(place).alias("at"), F.min_by(F.struct("left", "body", "right"), place).alias("first"))
                        .where("n > 1").select("key", "at", "first"))

    def agree(side: str) -> Column:
        out = F.lit(NEAR)
        for i in range(NEAR - 1, -1, -1):
            out = F.when(F.coalesce(F.expr(f"get({side}, {i}) = get(first.{side}, {i})"), F.lit(False)), out).otherwise(i)
        return out

    same = held.join(first, "key").where("not (rk = at.rk and a = at.a) and body = first.body")
    marks = same.select("rk", F.struct((F.col("a") - agree("left")).alias("a"), (F.col("b") + agree("right")).alias("b")).alias("mark"))
    return materialize(marks.groupBy("rk").agg(F.collect_set("mark").alias("marks")), held, first)


def removable(lines: list[str], marks: list[tuple[int, int]], min_words: int, long_words: int) -> list[tuple[int, int]]:
    """Runs of marked lines that are long enough to go."""
    out, merged = [], []
    for a, b in sorted(marks):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in merged:
        words = sum(len(x.split()) for x in lines[a:b])
        if words >= (min_words if b - a > 1 else long_words):
            out.append((a, b))
    return out


def _cleaned(docs: DataFrame, key: str, text: str, min_words: int, long_words: int) -> DataFrame:
    """The columns of docs as k0, k1, ..., with the text cleaned, and n_lines, n_removed."""
    columns = docs.columns
    marks = marked_lines(docs, key, text)
    kinds = {f"k{i}": docs.schema[c].dataType.simpleString() for i, c in enumerate(columns)}
    at = f"k{columns.index(text)}"
    rows = docs.select(row_key(key, text).alias("rk"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)]).join(marks, "rk", "left").drop("rk")

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, n, gone = batch.column(at).to_pylist(), [], []
            for i, m in enumerate(batch.column("marks").to_pylist()):
                n.append(0 if texts[i] is None else texts[i].count("\n") + 1)
                gone.append(0)
                if not m:
                    continue
                lines = texts[i].split("\n")
                runs = removable(lines, [(x["a"], x["b"]) for x in m], min_words, long_words)
                if runs:
                    kept, last = [], 0
                    for a, b in runs:
                        kept += lines[last:a]
                        last = b
                    texts[i] = "\n".join(kept + lines[last:])
                    gone[i] = sum(b - a for a, b in runs)
            cols = {c: batch.column(c) for c in kinds} | {at: pa.array(texts, pa.string())}
            return pa.record_batch(cols | {"n_lines": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64())})
        return apply

    return arrow_map(rows, make, ", ".join([*[f"{c} {k}" for c, k in kinds.items()], "n_lines long, n_removed long"]))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """All columns of docs, with the text cleaned, and _n_lines, _n_removed (columns of these names are left out)."""
    docs = docs.drop("_n_lines", "_n_removed")
    return named(_cleaned(docs, key, text, min_words, long_words).withColumnsRenamed({"n_lines": "_n_lines", "n_removed": "_n_removed"}), docs.columns, "_n_lines", "_n_removed")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row stays, its repeated chunks of lines go; n_chars follows the text."""
    out, names = _cleaned(docs, "doc_id", "text", MIN_WORDS, LONG_WORDS), docs.columns
    if "n_chars" in names:
        own = f"k{names.index('n_chars')}"
        out = out.withColumn(own, F.when(F.col("n_removed") > 0, F.length(f"k{names.index('text')}").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(own)))
    return named(out, names)
