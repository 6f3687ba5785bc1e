"""Operator 2: URL filtering with host/path rules and an exact Bloom filter cascade [native].

Rules fit a host and all its subdomains when the url's path starts with the rule's; the longest
wins.  Where none fits, the method decides: a cascade of Bloom filters over the complete key universe of
the corpus (every host and each of its parent domains).  Level 1 encodes the listed keys; level 2
those unlisted keys that level 1 lets pass wrongly; level 3 the listed keys that level 2 lets pass; and so
on until a level lets nothing pass wrongly.  For keys of that universe the alternating answer is exact, and
judging a url needs no join: the levels are binary literals in the plan.

The levels are broadcast with the plan, so they are bounded: a level over `max_bits` (default 2^25
bits, 4 MiB) switches judging to an exact equi-join with the listed keys instead.

Defined results: null url, or one without '://': empty host and path, no rule, 'allow'; keys are
compared as lower-cased text; duplicate listed keys count once; an empty list allows all; repeated
rows are each returned; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.common import ascii_lower, forget, materialize, table

#: verdict, host, path prefix
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The default list of blocked domains (with all their subdomains): these sites under every domain they use.
SITES, TOPS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"), ("com", "net", "org")
LISTED = tuple(f"{site}.example.{top}" for site in SITES for top in TOPS)
BITS_PER_KEY, HASHES, MAX_BITS, _MASK = 8, 5, 1 << 25, 0x7FFFFFFF
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls."""
    rule = verdict = None
    for kind, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, name + start) if rule is None else rule.when(fits, name + start)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def domains(host: Column) -> Column:
    """The host and each of its parent domains: a.b.c -> [a.b.c, b.c, c]."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    one, two = F.xxhash64(key, F.lit(level)).bitwiseAND(_MASK), F.xxhash64(F.lit(level), key).bitwiseAND(_MASK)
    return [F.pmod(one + F.lit(i) * two, F.lit(bits).cast("long")) for i in range(HASHES)]


def _passes(key: Column, level: int, bits: int, data: bytes) -> Column:
    """Whether every bit of this key is set; a byte of the binary literal is read in constant time."""
    held = F.lit(bytearray(data))
    tests = []
    for at in _positions(key, level, bits):
        byte = F.ascii(F.decode(F.substring(held, F.floor(at / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
        tests.append(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1)
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


class Cascade:
    """Exact membership of listed keys within a universe of keys."""

    def __init__(self, universe: DataFrame, listed: DataFrame, max_bits: int = MAX_BITS):
        """universe(key): distinct keys; listed(key)."""
        marked = materialize(universe.join(listed.select("key").distinct().withColumn("on", F.lit(True)), "key", "left")
                             .select("key", F.coalesce("on", F.lit(False)).alias("on")))
        self.levels: list[tuple[int, bytes]] | None = []
        inside = True
        encoded, tested = marked.where("on"), marked.where("not on")
        while n := encoded.count():
            bits = -(-max(64, n * BITS_PER_KEY) // 8) * 8
            if bits > max_bits:
                self.levels = None
                break
            level = len(self.levels)
            bit = encoded.select(F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("at")).select((F.col("at") + 1).alias("at"))
            chunks = bit.groupBy(F.bitmap_bucket_number("at").alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap")).collect()
            data = bytearray(-(-bits // 32768) * 4096)
            for c in chunks:
                data[(c["chunk"] - 1) * 4096:c["chunk"] * 4096] = c["bitmap"]
            self.levels.append((bits, bytes(data[:bits // 8])))
            encoded, tested = tested.where(_passes(F.col("key"), level, *self.levels[-1])), encoded
            inside = not inside
        forget(marked)

    def contains(self, key: Column) -> Column:
        out = F.lit(False)
        for level in range(len(self.levels) - 1, -1, -1):
            out = _passes(key, level, *self.levels[level]) & ~out
        return out


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), rules=RULES, max_bits: int = MAX_BITS) -> DataFrame:
    """keep + host, path, rule, verdict for every row."""
    rows = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    universe = rows.select("host").distinct().select(F.explode(domains(F.col("host"))).alias("key")).distinct()
    keys = listed.select(ascii_lower(F.col(listed.columns[0])).alias("key")).where("key is not null")
    cascade = Cascade(universe, keys, max_bits)
    if cascade.levels is None:
        hosts = rows.select("host").distinct().select("host", F.explode(domains(F.col("host"))).alias("key"))
        bad = hosts.join(keys.distinct(), "key", "left_semi").select("host").distinct().withColumn("bad", F.lit(True))
        rows, found = rows.join(bad, "host", "left"), F.coalesce("bad", F.lit(False))
    else:
        found = F.exists(domains(F.col("host")), cascade.contains)
    return rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "host", "path", rule.alias("rule"),
                       F.coalesce(verdict, F.when(found, "block").otherwise("allow")).alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(k,) for k in LISTED], "key string")
    return judge(table(spark, sf_dir, "pages"), listed)


_FIT = "(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
_BY_LENGTH = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
OP2_SQL = f"""
with u as (
  select page_id, url,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages)
select page_id, host, path,
       case {" ".join(f"when {_FIT.format(h=h, p=p)} then '{h}{p}'" for _, h, p in _BY_LENGTH)} end as rule,
       case {" ".join(f"when {_FIT.format(h=h, p=p)} then '{v}'" for v, h, p in _BY_LENGTH)}
            {" ".join(f"when host = '{k}' or ends_with(host, '.{k}') then 'block'" for k in LISTED)}
            else 'allow' end as verdict
from u"""
