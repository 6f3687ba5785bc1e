"""Operator 10: language identification by error-correcting output codes over byte n-grams.

Every learned language gets a codeword; one binary classifier a bit (log-odds of hashed byte
trigrams and tetragrams, naive Bayes form) predicts that bit, and the codeword of least logistic
loss wins.  The score is the codeword's share of exp(-loss), times the share of the text whose windows say the same.  The classifiers see at most about `sample_per_lang` labelled documents of each
language (a documented bound: rows are taken by a hash of id and text, at the rate
sample_per_lang / rows of that language); prediction reads every whole text.

Defined results: null text, or text without any letter -> 'und', score 0; no labelled rows at all
-> 'und' for every row; one learned language -> that language; null ids are predicted but never
learned from and count as not held out; repeated rows are each returned; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.common import arrow_map, blocks_of, named, table

BUCKETS, WINDOW = 1 << 16, 512
SAMPLE_PER_LANG = 1500
AMBIGUOUS = 0.75
#: By so much the best codeword's share must be over an even one for the pipeline to keep a text.
TOLD = 1e-3
#: Occurrences added to every n-gram: a copy under a wrong label must not teach its rare n-grams.
SMOOTH = 20.0
_CHUNK = 1 << 18


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1.  Exhaustive code up to 5 classes, else the best of 64 fixed random codes."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        bits = np.arange(1, 2 ** (n - 1))
        rows = np.vstack([np.zeros_like(bits), *[(bits >> i) & 1 for i in range(n - 1)]])
        return (1 - 2 * rows).astype(np.int8)
    width = int(np.ceil(10 * np.log2(n)))
    best, gap = None, -1
    for seed in range(64):
        code = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (n, width))
        far = (width - code.astype(int) @ code.T) // 2 + width * np.eye(n, dtype=int)
        if far.min() > gap and (abs(code.sum(0)) < n).all():
            best, gap = code, far.min()
    return best if best is not None else code


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the byte trigram and of the byte tetragram at every offset of a padded buffer."""
    x = data.astype(np.uint32)
    three = x[:-3] | (x[1:-2] << 8) | (x[2:-1] << 16)
    four = three | (x[3:] << 24)
    return ((three * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int32), \
           (((four * np.uint32(0x85EBCA6B)) >> np.uint32(17)) | np.uint32(BUCKETS // 2)).astype(np.int32)


def packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, lower-cased, each framed by blanks, in one buffer; and where each begins."""
    parts = [b" " + t.lower().encode("utf-8", "ignore") + b"   " for t in texts]
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=at[1:])
    return np.frombuffer(b"".join(parts), np.uint8), at


def _count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    langs = np.array(batch.column("lang").to_pylist())
    out = []
    for lang in np.unique(langs):
        texts = [t for t, own in zip(batch.column("text").to_pylist(), langs == lang, strict=True) if own]
        total = np.zeros(BUCKETS, np.int64)
        for _, some in blocks_of(texts, _CHUNK):
            for g in grams(packed(some)[0]):
                total += np.bincount(g, minlength=BUCKETS)
        at = np.flatnonzero(total)
        out.append(pa.record_batch({"lang": pa.array([str(lang)] * len(at), pa.string()), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(total[at])}))
    return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out and sum(map(len, out)) else None


def train(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id",
          sample_per_lang: int = SAMPLE_PER_LANG) -> dict:
    """The model: languages, codewords and one weight for each bucket and bit."""
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.col(key).cast("string").alias("k")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "code": np.ones((0, 1), np.int8), "weights": np.zeros((BUCKETS, 1), np.float32)}
    rate = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample_per_lang / sizes[k])))])
    some = rows.where(F.pmod(F.xxhash64("k", "text"), F.lit(1 << 20)) < F.element_at(rate, F.col("lang")) * (1 << 20)).select("lang", "text")
    counts = arrow_map(some, lambda: _count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table_ = np.zeros((len(langs), BUCKETS))
    table_[np.searchsorted(langs, counts["lang"].to_numpy(zero_copy_only=False)), counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    code = codewords(len(langs))
    share = table_ / np.maximum(1, table_.sum(1, keepdims=True))  # every language weighs the same
    smooth = SMOOTH / max(1.0, table_.sum() / len(langs))
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        plus, minus = (share[code[:, b] == s] for s in (1, -1))
        if len(plus) and len(minus):
            weights[:, b] = np.log(plus.mean(0) + smooth) - np.log(minus.mean(0) + smooth)
    weights[table_.sum(0) == 0] = 0  # n-grams never seen say nothing
    return {"langs": langs, "code": code, "weights": weights}


def decode(margins: np.ndarray, langs: list[str], code: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Loss-weighted decoding: the codeword of least summed logistic loss, and its share of exp(-loss)."""
    loss = np.logaddexp(0, -margins[:, None, :] * code[None]).sum(2)
    like = np.exp(-(loss - loss.min(1, keepdims=True)))
    return [langs[i] for i in loss.argmin(1)], like.max(1) / like.sum(1)


def _judged(docs: DataFrame, model: dict, text: str, keep: tuple[str, ...]) -> DataFrame:
    """The `keep` columns as k0, k1, ..., lang_pred, score, ambiguous, and told (the classifiers prefer a codeword at all)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("_text"))
    kinds = [rows.schema[f"k{i}"].dataType.simpleString() for i in range(len(keep))]

    def make():
        langs, code, weights = (shared.value[k] for k in ("langs", "code", "weights"))

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            pred, score, told = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            real = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))] if langs else []
            for start, some in blocks_of([texts[i] for i in real], _CHUNK):
                data, at = packed(some)
                three, four = grams(data)
                size = np.diff(at)
                n = -(-size // WINDOW)  # windows of each text
                first = np.cumsum(n) - n
                begins = np.repeat(at[:-1] - WINDOW * first, n) + WINDOW * np.arange(n.sum())
                parts = sum(np.add.reduceat(weights[g], np.minimum(begins, len(three) - 1), axis=0) for g in (three, four))
                margins = np.add.reduceat(parts, first, axis=0) / np.sqrt(size)[:, None]  # n-grams overlap: their evidence grows slower than their number
                best, sure = decode(margins, langs, code)
                clear = sure > 1 / len(langs) + TOLD if len(langs) > 1 else sure > 0
                own, _ = decode(parts / np.sqrt(WINDOW), langs, code)
                wide = np.minimum(np.repeat(at[1:], n) - begins, WINDOW)
                agree = np.array(own) == np.repeat(best, n)
                sure = sure * np.add.reduceat(wide * agree, first) / size  # a text of two languages is never sure
                for j, (b, s, c) in enumerate(zip(best, sure, clear, strict=True)):
                    pred[real[start + j]], score[real[start + j]], told[real[start + j]] = b, s, c
            cols = {f"k{i}": batch.column(f"k{i}") for i in range(len(keep))}
            return pa.record_batch(cols | {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score), "ambiguous": pa.array((score < AMBIGUOUS).tolist(), pa.bool_()), "told": pa.array(told.tolist(), pa.bool_())})

        return apply

    return arrow_map(rows, make, ", ".join([*[f"k{i} {k}" for i, k in enumerate(kinds)], "lang_pred string, score double, ambiguous boolean, told boolean"]))


def identify(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds lang_pred, score (0 to 1) and ambiguous (score below AMBIGUOUS) to the `keep` columns."""
    return named(_judged(docs, model, text, keep), keep, "lang_pred", "score", "ambiguous")


def held_out(key: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train_on_documents(docs: DataFrame) -> dict:
    return train(docs.where(F.col("doc_id").isNotNull() & ~held_out()))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train_on_documents(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows go that have no letter, or for whose n-grams no codeword is nearer than any other (by TOLD, as in a
    script that was never learned); every other row stays as it is, ambiguous ones too: a doubt about which language it is is no reason
    to lose a text.  Where no language could be learned, only the rows without any letter go."""
    model, keep = train_on_documents(docs), tuple(docs.columns)
    if not model["langs"]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return named(_judged(docs, model, "text", keep).where("told"), keep)
