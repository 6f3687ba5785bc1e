"""Operator 6: personal data, by fixed patterns and bootstrapped contextual extraction.

The base kinds (email, ip, card, phone) are found in every whole text.  They seed the bootstrap, together with tokens that look
drawn at random (letters and digits in turn), which are reported only where a pattern bears them out, as kind secret.
Candidates are identifier-like tokens: runs of letters, digits and _ @ . + / - of six characters or more, with two digits.

Lexical patterns of a seed or candidate: k, the key it is assigned to (`id=`, `token = "`); l, the two words before it; b, the
words before and after it; s, how it is spelled (its first four capital or small letters, length and characters).  One scan of the texts
finds all occurrences with their patterns; words are counted, for patterns l and b that have enough seeds, in a second one.
On the graph of patterns and instances, a pattern with MIN_SUPPORT different known instances has as its prior the share of its
occurrences (whatever stands there) that known instances take; a candidate is likely by 1 - product of (1 - prior) over its
patterns, and a pattern's score adds what its likely candidates take.  A pattern is sure with a prior of CONFIDENT / 2 and a score of
CONFIDENT.  Instances of sure patterns become known, under the best one's kind, and seed the next of ROUNDS rounds of DataFrame
joins.  A known instance adds spans where a sure pattern of its stands, and, if it has letters, digits and twelve characters, everywhere.

Pattern sets over `max_patterns` are counted slice by slice, so what is broadcast stays bounded.

Defined results: null text is empty; spans are code points, end exclusive; a found identifier that
overlaps a base span is not added; keys and context words of over 40 characters make no pattern, nor do context words further off
than 200 characters; repeated rows are each returned; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.common import arrow_map, forget, materialize, row_key, table

KINDS, SECRET = ("email", "ip", "card", "phone"), "secret"
MIN_SUPPORT, MAX_PATTERNS, CONFIDENT, ROUNDS = 3, 50_000, 0.8, 3
_REACH, _WORD = 200, 40

# The possessive and lookbehind forms find what the plain patterns find, without quadratic retries.
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")
_digits = re.compile(r"[0-9]+")
_inside = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_@.+/-")
_assign = re.compile(r"[=:]")
_key = re.compile(r"(?:^|[^A-Za-z0-9_.-])([A-Za-z_][A-Za-z0-9_.-]*)[ \t]{0,2}$")
_value = re.compile(r"[ \t]{0,2}([\"']?)(?=[^\s\"'])")
_runs = re.compile(r"[A-Za-z]+|[0-9]+")


def drawn_at_random(token: str) -> bool:
    """Letters and digits in turn, in five runs or more, in sixteen characters or more."""
    return len(token) >= 16 and token.isascii() and token.isalnum() and len(_runs.findall(token)) >= 5


def luhn(digits: str) -> bool:
    twice = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (twice + sum(map(int, digits[-1::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    out, last, pos = [], 0, text.find("@")
    while pos != -1:
        start = pos
        while start > last and text[start - 1] in _local:
            start -= 1
        m = _domain.match(text, pos + 1) if start < pos else None
        if m:
            out.append((start, m.end(), "email"))
            last = m.end()
        pos = text.find("@", m.end() if m else pos + 1)
    if _digit.search(text):
        for m in _ip.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _card.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _phone.finditer(text):
                if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, known: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Identifier-like tokens that overlap no known span."""
    out, last, spans = [], 0, iter(sorted(known))
    span = next(spans, None)
    for m in _digits.finditer(text):
        if m.start() < last:
            continue
        a, b = m.span()
        while a > last and text[a - 1] in _inside:
            a -= 1
        while b < len(text) and text[b] in _inside:
            b += 1
        last = b
        while text[b - 1] in ".+/-@":
            b -= 1
        while text[a] in ".+/-@":
            a += 1
        while span is not None and span[1] <= a:
            span = next(spans, None)
        if b - a >= 6 and sum(len(d) for d in _digits.findall(text, a, b)) >= 2 and (span is None or span[0] >= b):
            out.append((a, b))
    return out


def keys_of(text: str) -> dict[int, str]:
    """Where an assigned value begins -> pattern of its key."""
    out = {}
    for m in _assign.finditer(text):
        key = _key.search(text, max(0, m.start() - _WORD - 3), m.start())
        if key and len(key[1]) <= _WORD and (value := _value.match(text, m.end())):
            out[value.end()] = f"k:{key[1].lower()}{m[0]}{value[1]}"
    return out


def contexts_of(text: str, a: int, b: int) -> list[str]:
    """Patterns of the words around a token that stands free on its left."""
    if a and not text[a - 1].isspace():
        return []
    before = text[max(0, a - _REACH):a].lower()
    left = before.split()
    if a > _REACH and not before[0].isspace():
        left = left[1:]  # may be a part of a word
    rest = text[b:b + _REACH].lower()
    right = rest.split()
    if rest and not rest[0].isspace():
        right = right[1:]
    if right and b + _REACH < len(text) and rest.endswith(right[0]):
        right = []
    out = []
    if len(left) > 1 and max(map(len, left[-2:])) <= _WORD:
        out.append(f"l:{left[-2]} {left[-1]}")
    if left and right and max(len(left[-1]), len(right[0])) <= _WORD:
        out.append(f"b:{left[-1]} {right[0]}")
    return out


def spelling_of(token: str) -> list[str]:
    """Its first four letters, if all capital or all small, its length and which characters it has."""
    start = token[:4]
    if not (12 <= len(token) <= 200 and token.isascii() and token.isalnum() and start.isalpha() and (start.isupper() or start.islower())):
        return []
    return [f"s:{start}{len(token)}{'A' * any(map(str.isupper, token))}{'a' * any(map(str.islower, token))}"]


def occurrences(text: str, known: list[tuple[int, int, str]]) -> tuple[list[dict], Counter]:
    """All seeds and candidates with their patterns, and how often a key has another value."""
    if not known and not _digit.search(text):
        return [], Counter(keys_of(text).values())
    out, keys = [], keys_of(text)
    found = [(a, b, k) for a, b, k in known] + [(a, b, SECRET if drawn_at_random(text[a:b]) else None) for a, b in candidates(text, known)]
    for a, b, kind in found:
        key = keys.pop(a, None)
        patterns = ([key] if key else contexts_of(text, a, b)) + (spelling_of(text[a:b]) if kind not in KINDS else [])
        out.append({"a": a, "b": b, "instance": text[a:b].lower(), "kind": kind, "patterns": patterns})
    return out, Counter(keys.values())


def _find() -> object:
    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("kind", pa.string())]))
    seen = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("instance", pa.string()), ("kind", pa.string()), ("patterns", pa.list_(pa.string()))]))
    rest = pa.list_(pa.struct([("pattern", pa.string()), ("n", pa.int64())]))

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans, found, others, counts = [], [], [], []
        for t in batch.column("text").to_pylist():
            own = base_spans(t or "")
            spans.append([{"a": a, "b": b, "kind": k} for a, b, k in own])
            some, more = occurrences(t or "", own)
            found.append(some)
            others.append([{"pattern": p, "n": n} for p, n in more.items()])
            counts.append(Counter(k for _, _, k in own))
        return pa.record_batch({"rk": batch.column("rk"), "id": batch.column("id"), "spans": pa.array(spans, span), "seen": pa.array(found, seen), "others": pa.array(others, rest)}
                               | {f"n_{k}": pa.array([c[k] for c in counts], pa.int64()) for k in KINDS})
    return apply


def _word_counts(rows: DataFrame, patterns: list[str]) -> DataFrame:
    """How often the words of patterns l and b stand so, whatever comes between or after: (pattern, n), to be summed."""
    shared = rows.sparkSession.sparkContext.broadcast(frozenset(patterns))

    def make():
        pairs = {k: {p[2:] for p in shared.value if p[0] == k} for k in "lb"}
        first = {k: {p.split(" ")[0] for p in own} for k, own in pairs.items()}

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            total = Counter()
            for t in batch.column("text").to_pylist():
                words = (t or "").lower().split()
                for k, gap in (("l", 1), ("b", 2)):
                    own, begin = pairs[k], first[k]
                    if own:
                        total.update(f"{k}:{p}" for x, y in zip(words, words[gap:], strict=False) if x in begin and (p := f"{x} {y}") in own)
            return pa.record_batch({"pattern": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())}) if total else None
        return apply

    return arrow_map(rows.select("text"), make, "pattern string, n long")


def bootstrap(rows: DataFrame, base: DataFrame, min_support: int = MIN_SUPPORT, max_patterns: int = MAX_PATTERNS, confident: float = CONFIDENT, rounds: int = ROUNDS) -> DataFrame | None:
    """(rk, a, b, kind) of identifiers that sure patterns discover; None where there are none."""
    seen = materialize(base.select("rk", F.explode("seen").alias("s")).select("rk", "s.*"))
    if seen.where("kind is null or kind = 'secret'").isEmpty():
        forget(seen)
        return None
    edges = materialize(seen.select("instance", F.explode("patterns").alias("pattern")).groupBy("instance", "pattern").agg(F.count("*").alias("n")))
    kinds = materialize(seen.groupBy("instance").agg(F.min("kind").alias("kind")))
    # Totals: all occurrences of a key or a spelling; of words only where as many instances stand there as a sure pattern needs.
    some = edges.groupBy("pattern").agg(F.sum("n").alias("n"), F.count("*").alias("different")).where(F.col("different") >= min_support)
    some = materialize(some)
    words = some.where("pattern rlike '^[lb]:'")
    slices = -(-words.count() // max_patterns)
    totals = [base.select(F.explode("others").alias("o")).select("o.*"), some.where("not pattern rlike '^[lb]:'").select("pattern", "n")]
    for i in range(slices):
        held = [r["pattern"] for r in words.where(F.pmod(F.xxhash64("pattern"), F.lit(slices)) == i).select("pattern").collect()]
        totals.append(_word_counts(rows, held))
    total = totals[0].unionByName(totals[1])
    for t in totals[2:]:
        total = total.unionByName(t)
    total = materialize(some.select("pattern", F.col("n").alias("met")).join(total.groupBy("pattern").agg(F.sum("n").alias("n")), "pattern", "left")
                        .select("pattern", F.greatest("n", "met").alias("total")), some)
    known, borne_before = kinds.where("kind is not null"), -1
    for _ in range(rounds):
        met = edges.join(known, "instance").groupBy("pattern", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("different"))
        met = met.groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("different").alias("different"), F.max_by("kind", F.struct("n", "kind")).alias("kind")).where(F.col("different") >= min_support)
        met = materialize(met.join(total, "pattern").select("pattern", "kind", "total", (F.col("n") / F.col("total")).alias("prior")).where(F.col("prior") >= confident / 2))
        fresh = edges.join(known, "instance", "left_anti").join(met.select("pattern", "prior"), "pattern")
        likely = fresh.groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.least("prior", F.lit(0.999)))))).alias("likely"))
        gained = fresh.join(likely, "instance").groupBy("pattern").agg(F.sum(F.col("likely") * F.col("n")).alias("gained"))
        sure = met.join(gained, "pattern", "left").select("pattern", "kind", F.least(F.lit(1.0), F.col("prior") + F.coalesce("gained", F.lit(0.0)) / F.col("total")).alias("score"))
        sure = materialize(sure.where(F.col("score") >= confident), met)
        found = edges.join(sure, "pattern").groupBy("instance").agg(F.max_by(sure["kind"], F.struct("score", "pattern")).alias("new"))
        known = materialize(kinds.join(found, "instance", "left").select("instance", F.coalesce(F.when(F.col("kind") != SECRET, F.col("kind")), "new", "kind").alias("kind"), F.col("new").isNotNull().alias("borne")).where("kind is not null"))
        if (now := known.where("borne").count()) == borne_before:
            break  # nothing was added, so nothing more can be
        borne_before = now
    borne = known.where("borne").select("instance", F.col("kind").alias("as"))
    out = seen.where("kind is null or kind = 'secret'").select("rk", "a", "b", "instance", F.explode_outer("patterns").alias("pattern")).join(borne, "instance")
    out = out.join(sure.select("pattern", F.lit(True).alias("on")), "pattern", "left").where("on or (length(instance) >= 12 and instance rlike '[a-z]' and instance rlike '[0-9]')")
    return out.select("rk", "a", "b", F.col("as").alias("kind")).distinct()


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """id, n_<kind> of the base kinds, spans (array of a, b, kind: the base ones), found (base and discovered spans)."""
    rows = docs.select(row_key(key, text).alias("rk"), F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    span = "array<struct<a: long, b: long, kind: string>>"
    seen = "array<struct<a: long, b: long, instance: string, kind: string, patterns: array<string>>>"
    schema = f"rk string, id {rows.schema['id'].dataType.simpleString()}, spans {span}, seen {seen}, others array<struct<pattern: string, n: long>>, " + ", ".join(f"n_{k} long" for k in KINDS)
    base = materialize(arrow_map(rows, _find, schema))
    more = bootstrap(rows, base, **limits)
    out = base.drop("seen", "others")
    if more is None:
        return out.withColumn("found", F.col("spans"))
    more = more.groupBy("rk").agg(F.collect_set(F.struct("a", "b", "kind")).alias("more"))
    return out.join(more, "rk", "left").withColumn("found", F.concat("spans", F.coalesce("more", F.array().cast(span)))).drop("more")


def spans_text(spans: str):
    """kind:start:end by start, then kind as listed, comma-joined."""
    rank = "case x.kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate((*KINDS, SECRET))) + " end"
    return F.expr(f"array_join(transform(array_sort(transform({spans}, x -> struct(x.a as a, {rank} as r, x.b as b, x.kind as kind))), x -> concat(x.kind, ':', x.a, ':', x.b)), ',')")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), *[f"n_{k}" for k in KINDS], F.sha2(spans_text("spans"), 256).alias("base_sha256"), spans_text("found").alias("spans"),
                      F.size("found").cast("long").alias("n_spans"))
