"""Operator 1: benchmark decontamination by winnowing [native].

Words are the runs outside ASCII separators after lower-casing A-Z.  A window is `window` consecutive words of
an item (an item of fewer words is one window).  Both sides are winnowed: of every `window - K + 1`
consecutive K-grams the least hash is kept, so any shared window keeps the same K-gram on both sides and no
shared span of a window or more can be missed.  Kept hashes are joined; each hit is
extended word by word to both sides, and counts where at least a window agrees.  Items shorter than a
window are looked up by their own length, for the lengths that occur.

The benchmark's contexts are broadcast while they are at most `broadcast_rows` rows (checked by a
count); beyond that the same join runs shuffled, and texts are fetched for matching rows only.

Defined results: null text has no words; an item without words has no window; identical items
share their contexts and are all reported; items with a null id mark words but are not listed;
documents are told apart by (id, text), so repeated rows are each returned; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.common import ascii_lower, keyed, materialize, row_key, table, unkeyed

WINDOW, K, BROADCAST_ROWS = 10, 6, 100_000
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SEPARATORS), "")


def _grams(words: Column, k: int) -> Column:
    """Hashes of all k-grams, by position."""
    empty = F.array().cast("array<bigint>")
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k)))).otherwise(empty)


def _winnowed(grams: Column, w: int) -> Column:
    """The least hash of every w consecutive ones, each value once."""
    empty = F.array().cast("array<bigint>")
    return F.when(F.size(grams) >= w, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(grams) - (w - 1)), lambda j: F.array_min(F.slice(grams, j, w))))).otherwise(empty)


def contexts(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW, k: int = K) -> tuple[DataFrame, DataFrame, list[int]]:
    """(contexts, members, short lengths).  contexts: ctx, hash, off, klen, need, gram, around - a kept K-gram with
    the words around it that one window can reach.  members: ctx, item."""
    side, w = window - k, window - k + 1
    items = materialize(benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0))
    long = items.where(F.size("words") >= window).withColumn("grams", _grams(F.col("words"), k))
    kept = long.withColumn("kept", _winnowed(F.col("grams"), w)).select(
        "item", "words", F.explode(F.filter(F.transform(F.col("grams"), lambda h, i: F.struct(h.alias("hash"), i.alias("at"))), lambda x: F.array_contains(F.col("kept"), x["hash"]))).alias("g"))
    rows = kept.select("item", F.col("g.hash").alias("hash"), F.least(F.col("g.at"), F.lit(side)).alias("off"), F.lit(k).alias("klen"), F.lit(window).alias("need"),
                       F.expr(f"slice(words, g.at + 1, {k})").alias("gram"),
                       F.expr(f"slice(words, greatest(g.at - {side}, 0) + 1, least(g.at, {side}) + {k + side})").alias("around"))
    lengths = sorted(r[0] for r in items.where(F.size("words") < window).select(F.size("words")).distinct().collect())
    short = items.where(F.size("words") < window).select("item", F.xxhash64("words").alias("hash"), F.lit(0).alias("off"), F.size("words").alias("klen"), F.size("words").alias("need"), F.col("words").alias("gram"), F.col("words").alias("around"))
    rows = rows.unionByName(short).withColumn("ctx", F.sha2(F.concat_ws(" ", F.concat_ws(",", "off", "klen"), F.concat_ws(" ", "around")), 256))
    members = materialize(rows.select("ctx", "item").distinct())
    found = materialize(rows.groupBy("ctx").agg(*[F.first(c).alias(c) for c in ("hash", "off", "klen", "need", "gram", "around")]))
    return found, members, lengths


def hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, k: int = K, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(found, members).  found: one row with a null ctx for every row of docs (rk, id, n_words), and one for each
    match (rk, ctx, start, end: the words start <= i < end are hit)."""
    side, w = window - k, window - k + 1
    ctx, members, lengths = contexts(benchmark, window=window, k=k)
    small = ctx.count() <= broadcast_rows
    hint = F.broadcast if small else (lambda df: df)
    prints = _winnowed(F.col("grams"), w)
    for n in lengths:
        prints = F.concat(prints, F.array_distinct(_grams(F.col("words"), n)))
    read = docs.select(row_key(key, text).alias("rk"), F.col(key).alias("id"), words_of(F.col(text)).alias("words"))
    seen = read.withColumn("n_words", F.size("words").cast("long")).withColumn("grams", _grams(F.col("words"), k)).withColumn("prints", prints) \
        .select("rk", "id", "n_words", "words", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), F.col("prints"))).alias("hash"))
    if small:
        met = seen.join(hint(ctx), "hash", "left").where("hash is null or ctx is not null")
    else:  # first which rows and hashes meet, then the words of those rows only
        slim = seen.select("rk", "id", "n_words", "hash").join(ctx.select("hash").distinct().withColumn("on", F.lit(True)), "hash", "left").where("hash is null or on")
        slim = materialize(slim.drop("on"))
        held = read.select("rk", "words").join(slim.where("hash is not null").select("rk").distinct(), "rk", "left_semi").dropDuplicates(["rk"])
        met = slim.join(ctx, "hash", "left").join(held, "rk", "left")
    at = F.expr("case when ctx is null then array(0) else filter(sequence(0, greatest(size(words) - klen, 0)), p -> slice(words, p + 1, klen) = gram) end")
    met = met.select("rk", "id", "n_words", "ctx", "off", "klen", "need", "around", F.when(F.col("ctx").isNotNull(), F.col("words")).alias("words"), F.explode(at).alias("p"))

    def run(doc_at, ctx_at) -> Column:
        """How many words agree in a row, up to `side`, going outwards."""
        out = F.lit(side)
        for d in range(side, 0, -1):
            same = F.coalesce(F.expr(f"get(words, {doc_at(d)}) = get(around, {ctx_at(d)})"), F.lit(False))
            out = F.when(same, out).otherwise(d - 1)
        return out

    out = met.select("rk", "id", "n_words", "ctx", "p", "klen", "need", run(lambda d: f"p - {d}", lambda d: f"off - {d}").alias("left"),
                     run(lambda d: f"p + klen - 1 + {d}", lambda d: f"off + klen - 1 + {d}").alias("right"))
    out = out.where("ctx is null or left + right + klen >= need")
    return materialize(out.select("rk", "id", "n_words", "ctx", (F.col("p") - F.col("left")).alias("start"), (F.col("p") + F.col("klen") + F.col("right")).alias("end"))), members


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """id, n_words, n_hit, items (sorted array of strings), contaminated: one row for every row of docs."""
    found, members = hits(docs, benchmark, key, text, window, broadcast_rows=broadcast_rows)
    per = found.groupBy("rk").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.sum(F.expr("cast(ctx is null as int)")).cast("int").alias("n_rows"),
                                  F.collect_set(F.expr("case when ctx is not null then struct(start, end) end")).alias("spans"))
    covered = F.expr("""aggregate(array_sort(spans), struct(0L as upto, 0L as n),
        (s, x) -> struct(greatest(s.upto, cast(x.end as bigint)) as upto, s.n + greatest(0L, x.end - greatest(s.upto, cast(x.start as bigint))) as n), s -> s.n)""")
    items = found.where("ctx is not null").select("rk", "ctx").distinct().join(members, "ctx").groupBy("rk").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return per.join(items, "rk", "left").select(
        "id", "n_words", covered.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.size("spans") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), "n_rows")).alias("_")).drop("_")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a hit go."""
    found, _ = hits(docs, table(spark, sf_dir, "benchmark"))
    bad = found.where("ctx is not null").select("rk").distinct()
    return unkeyed(keyed(docs, "doc_id", "text").join(bad, "rk", "left_anti"), docs.columns)


OP1_SQL = """
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from benchmark),
bw as (select distinct item_id, least(len(words), 10) as n, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') as win
       from b, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as t(i) where len(words) > 0),
sizes as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') as win from w, sizes, unnest(range(1, len(words) - n + 2)) as t(i)),
hit as (select dw.doc_id, dw.i, dw.n, bw.item_id from dw join bw on dw.win = bw.win and dw.n = bw.n),
pos as (select doc_id, count(distinct i + o) as n_hit from hit, unnest(range(0, n)) as t(o) group by doc_id),
its as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hit group by doc_id)
select w.doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join pos on pos.doc_id = w.doc_id left join its on its.doc_id = w.doc_id"""
