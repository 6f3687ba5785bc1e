"""Operator 7: exact token counts at every prefix, by prefix dynamic programming.

A byte-level BPE encodes each pre-token on its own, so the count at a prefix is the count at the
last pre-token boundary plus the count of the open pre-token's prefix.  Within a pre-token, the
encoding of its i-byte prefix ends in one certain token t, found as the longest suffix that is a
token and may follow the last token of the (i - len(t))-byte prefix; so

    count[i] = count[i - len(t)] + 1

and one pass gives every prefix's exact count, for many pre-tokens at once.  Where a cut changes the pre-tokens themselves
(inside a contraction, before the last blank of a run, inside a special string) the stored count is that of the cut text.
The stored counts answer truncation and budget questions (`fit`, `longest_prefix`) without encoding again.  Pre-token
tables are cached (bounded; when full, the first to come are kept).

Defined results: null text counts as empty (0 bytes, 0 tokens); the special strings of the
vocabulary count as one token wherever they stand in a text, as the library's default has it;
repeated rows are each returned; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.common import arrow_map, blocks_of, named, table

LIMIT = 512
CACHE_WORDS, VECTOR_BYTES, BLOCK_CHARS = 400_000, 48, 1 << 20
#: The pre-tokenizer pattern of the byte-level BPE, and its bytes' printable stand-ins.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Below this code point (Latin scripts) the pattern is spelled out for the faster engine.
_LATIN = 0x250
_P, _SLOTS = 0x9E3779B97F4A7C15, 20


def _stand_ins() -> dict[str, int]:
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _spelled(pattern: str) -> str:
    """The pattern with its classes as explicit characters below _LATIN."""
    import regex

    def chars(of: str) -> str:
        hit = [c for c in range(_LATIN) if regex.fullmatch(of, chr(c))]
        runs = [list(g) for _, g in itertools.groupby(hit, key=lambda c, n=itertools.count(): c - next(n))]
        return "".join(f"\\u{r[0]:04x}-\\u{r[-1]:04x}" for r in runs)

    letters, numbers, blanks = chars(r"\p{L}"), chars(r"\p{N}"), chars(r"\s")
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{blanks}{letters}{numbers}]")
    return out.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{blanks}]").replace(r"\S", f"[^{blanks}]")


class PrefixCounter:
    """Exact prefix counts for one byte-level BPE vocabulary file (.json of the tokenizers library)."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _stand_ins()
        raw = functools.cache(lambda s: bytes(byte[c] for c in s))
        self.special = sorted((a["content"] for a in spec["added_tokens"] if a.get("special")), key=len, reverse=True)
        special = set(self.special)
        self.tokens = sorted({raw(t) for t in spec["model"]["vocab"] if t not in special})
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.tokens))
        self.slow, self.fast, self.wide = regex.compile(PATTERN).findall, re.compile(_spelled(PATTERN)).findall, re.compile(f"[^\\u0000-\\u{_LATIN - 1:04x}]").search
        self.blank = regex.compile(r"\s").match
        self.all_blank = regex.compile(r"\s+").fullmatch
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._tables()
        self.clear()

    def _tables(self) -> None:
        """Hash tables of the tokens and their beginnings (numbers below len(tokens) are tokens)."""
        begun = {t[:i] for t in self.tokens for i in range(1, len(t))}
        names = [*self.tokens, *sorted(begun.difference(self.tokens))]
        self.number = {t: i for i, t in enumerate(names)}
        h = np.array([self._hash(t) for t in names], np.uint64)
        slot = (h >> np.uint64(64 - 22)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        run = np.arange(len(h)) - np.maximum.accumulate(np.where(np.diff(slot[order], prepend=-1) != 0, np.arange(len(h)), 0))
        if len(np.unique(h)) < len(h):
            raise ValueError("two beginnings of tokens have one hash")
        self.levels = np.full((int(run.max()) + 1, 1 << 22), -1, np.int32)  # the few that share a slot stand on further levels
        self.levels[run, slot[order]] = order
        self.hashes = np.append(h, np.uint64(0))
        self.is_token = np.array([i < len(self.tokens) for i in range(len(names))] + [False])
        self.goes_on = np.array([t in begun for t in names] + [False])
        self.alone = np.full(len(self.tokens), -1, np.int8)
        self.follows: dict[int, bool] = {}
        self.pair, self.pair_fits = np.full(1 << _SLOTS, -1, np.int64), np.zeros(1 << _SLOTS, bool)

    @staticmethod
    def _hash(token: bytes) -> int:
        h = 0
        for b in token:
            h = ((h + b + 1) * _P) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 29
        return h

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        slot = (h >> np.uint64(64 - 22)).astype(np.int64)
        at = self.levels[0][slot]
        for level in self.levels[1:]:
            wrong = np.flatnonzero((self.hashes[at] != h) & (at >= 0))
            at[wrong] = level[slot[wrong]]
        at[self.hashes[at] != h] = -1
        return at

    def clear(self, keep: int = 0) -> None:
        """Empties the cache of pre-tokens but for the first ones: their tokens, counts at every character, and white space."""
        old = self.words if keep else {}
        self.words = dict(itertools.islice(old.items(), keep))
        names = ("tokens_of", "start", "chars", "blank_all", "blank_first")
        if keep:
            for c in names:
                setattr(self, c, getattr(self, c)[:keep].copy())
            self.counts = self.counts[:self.start[-1] + self.chars[-1]].copy()
            return
        for c in names:
            setattr(self, c, np.zeros(0, bool if c.startswith("blank") else np.int64))
        self.counts = np.zeros(0, np.int32)

    def merge(self, data: bytes) -> list[bytes]:
        """Plain BPE of a short byte string; only used to decide whether two tokens may stand together."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [(self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))]
            low, i = min(ranked)
            if low == 1 << 60:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _stands(self, t: int) -> bool:
        """Whether merging makes this token from its own bytes."""
        if self.alone[t] < 0:
            self.alone[t] = self.merge(self.tokens[t]) == [self.tokens[t]]
        return bool(self.alone[t])

    def may_follow(self, a: int, b: int) -> bool:
        known = self.follows.get(a << 32 | b)
        if known is None:
            if len(self.follows) > 1_000_000:
                self.follows.clear()
            known = self.follows[a << 32 | b] = self.merge(self.tokens[a] + self.tokens[b]) == [self.tokens[a], self.tokens[b]]
        return known

    def _may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a << 32 | b
        slot = ((code.astype(np.uint64) * np.uint64(_P)) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        new = np.flatnonzero(self.pair[slot] != code)
        if not len(new):
            return self.pair_fits[slot]
        out = self.pair_fits[slot]
        unique, back = np.unique(code[new], return_inverse=True)
        fits = np.array([self.may_follow(c >> 32, c & 0xFFFFFFFF) for c in unique.tolist()])
        out[new] = fits[back]
        self.pair[slot[new]], self.pair_fits[slot[new]] = code[new], out[new]
        return out

    def table(self, data: bytes) -> list[int]:
        """count[i] for every byte prefix of one pre-token; from each place on, only while the bytes still begin a token."""
        n, get = len(data), self.number.get
        count, last = [0] * (n + 1), [-1] * (n + 1)
        for s in range(n):
            for j in range(s + 1, min(n, s + self.longest) + 1):
                t = get(data[s:j])
                if t is None:
                    break
                if last[j] < 0 and t < len(self.tokens) and self._stands(t) and (s == 0 or self.may_follow(last[s], t)):
                    last[j], count[j] = t, count[s] + 1
        return count

    def _tables_of(self, words: list[bytes]) -> np.ndarray:
        """The same for many short pre-tokens at once: a matrix, one column a pre-token."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        size, many, n = size[order], len(words), int(size.max())
        data = np.zeros((many, n), np.uint64)
        data[np.arange(n) < size[:, None]] = np.frombuffer(b"".join([words[i] for i in order.tolist()]), np.uint8)
        data = np.ascontiguousarray(data.T) + np.uint64(1)
        live = many - np.searchsorted(size[::-1], np.arange(n + 1), "right")  # longer than i
        count, last = np.zeros((n + 1, many), np.int32), np.full((n + 1, many), -1, np.int64)
        for s in range(n):
            rows = np.arange(live[s])
            h = np.zeros(len(rows), np.uint64)
            for j in range(s + 1, min(n, s + self.longest) + 1):
                h = (h + data[j - 1][rows]) * np.uint64(_P)
                h ^= h >> np.uint64(29)
                at = self._lookup(h)
                hit = np.flatnonzero(self.is_token[at] & (last[j][rows] < 0))
                if len(hit):
                    own, t = rows[hit], at[hit].astype(np.int64)
                    for x in np.unique(t[self.alone[t] < 0]).tolist():
                        self._stands(x)
                    good = np.flatnonzero(self.alone[t] == 1)
                    own, t = own[good], t[good]
                    if s and len(own):
                        good = np.flatnonzero(self._may_follow(last[s][own], t))
                        own, t = own[good], t[good]
                    last[j, own], count[j, own] = t, count[s, own] + 1
                more = self.goes_on[at]
                if j < n:
                    more &= rows < live[j]
                more = np.flatnonzero(more)
                if not len(more):
                    break
                rows, h = rows[more], h[more]
        back = np.empty(many, np.int64)
        back[order] = np.arange(many)
        return count[:, back]

    def _learn(self, words: list[str]) -> None:
        """Stores the counts at every character of new pre-tokens."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        size, chars = np.fromiter(map(len, data), np.int64, len(data)), np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(chars) - chars
        counts = np.zeros(int(chars.sum()), np.int32)
        short = np.flatnonzero(size <= VECTOR_BYTES)
        for s in range(0, len(short), 20_000):
            some = short[s:s + 20_000]
            held = self._tables_of([data[i] for i in some.tolist()])
            flat = np.frombuffer(b"".join([data[i] for i in some.tolist()]), np.uint8)
            n = size[some]
            first = np.cumsum(n) - n
            ends = np.ones(len(flat), bool)  # a character's last byte: none that continues it comes next
            ends[:-1] = (flat[1:] & 0xC0) != 0x80
            ends[first[1:] - 1] = True
            column = np.repeat(np.arange(len(some)), n)
            byte = np.arange(len(flat)) - first[column] + 1
            where = np.repeat(start[some] - (np.cumsum(chars[some]) - chars[some]), chars[some]) + np.arange(chars[some].sum())
            counts[where] = held[byte[ends], column[ends]]
        for i in np.flatnonzero(size > VECTOR_BYTES).tolist():
            ends = np.array([j + 1 for j in range(size[i]) if j + 1 == size[i] or data[i][j + 1] & 0xC0 != 0x80])
            counts[start[i]:start[i] + chars[i]] = np.array(self.table(data[i]), np.int32)[ends]
        for i in np.flatnonzero(chars == 3).tolist():
            if words[i][0] == "'" and words[i][1:].isalpha():  # cut inside, a contraction is a quote and a letter
                counts[start[i] + 1] = 2
        blank, all_blank = self.blank, self.all_blank
        self.start = np.concatenate([self.start, len(self.counts) + start])
        self.counts = np.concatenate([self.counts, counts])
        self.chars = np.concatenate([self.chars, chars])
        self.tokens_of = np.concatenate([self.tokens_of, counts[start + chars - 1]])
        self.blank_first = np.concatenate([self.blank_first, [blank(w) is not None for w in words]])
        self.blank_all = np.concatenate([self.blank_all, [all_blank(w) is not None for w in words]])

    def find(self, text: str) -> list[str]:
        return self.slow(text) if self.wide(text) else self.fast(text)

    def parts(self, text: str) -> list[str]:
        """The text between special strings, and these; every other one is a special string."""
        return [text] if self.cut is None or not any(s in text for s in self.special) else self.cut.split(text)

    def _numbers(self, words: list[str]) -> np.ndarray:
        known = self.words
        out = np.fromiter(map(known.get, words, itertools.repeat(-1)), np.int64, len(words))
        new, old = np.flatnonzero(out < 0), len(known)
        if len(new):
            out[new] = [known.setdefault(words[i], len(known)) for i in new.tolist()]
            self._learn(list(itertools.islice(known, old, None)) if old else list(known))
        return out

    def tables(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the exact token count of text[:i], for every i from 0 to its length."""
        if len(self.words) > CACHE_WORDS:
            self.clear(keep=CACHE_WORDS // 4)
        parts = [self.parts(t) for t in texts]
        plain = [p for own in parts for p in own[::2]]
        cut = [self.find(p) for p in plain]
        numbers = self._numbers(list(itertools.chain.from_iterable(cut)))
        count = np.fromiter(map(len, cut), np.int64, len(cut))
        upto = np.cumsum(count)
        chars, tokens = self.chars[numbers], self.tokens_of[numbers]
        ends = np.cumsum(chars)
        before = np.cumsum(tokens) - tokens
        all_ = self.counts[np.repeat(self.start[numbers] - (ends - chars), chars) + np.arange(ends[-1] if len(ends) else 0)] + np.repeat(before, chars)
        # A text cut before the last blank of a run ends in the whole run.
        odd = self.blank_all[numbers[:-1]] & self.blank_first[numbers[1:]]
        odd[upto[:-1][(upto[:-1] > 0) & (upto[:-1] < len(numbers))] - 1] = False
        odd = np.flatnonzero(odd)
        if len(odd):
            flat = list(itertools.chain.from_iterable(cut))
            runs = self._numbers([flat[i] + flat[i + 1][0] for i in odd.tolist()])
            all_[ends[odd]] = before[odd] + self.tokens_of[runs]
        out, base, at = [], np.append(0, ends), np.append(0, upto)
        total = np.append(0, np.cumsum(tokens))
        tables = [np.append(0, all_[base[a]:base[b]] - total[a]) for a, b in zip(at[:-1], at[1:], strict=True)]
        tables, cut = iter(tables), iter(cut)
        for own in parts:
            held, words, last = next(tables), next(cut), 0
            for s, _ in zip(own[1::2], own[2::2], strict=True):
                q = words[-1] if words else ""
                left = int(held[len(held) - 1 - len(q)])  # cut inside, a special string is plain text that may join the last pre-token
                inside = [left + self._count(q + s[:i]) for i in range(1, len(s))]
                more, words = next(tables), next(cut)
                last = int(held[-1]) + 1
                held = np.concatenate([held, inside, more + last])
            out.append(held.astype(np.int32))
        return out

    def _count(self, text: str) -> int:
        total = 0
        for i, p in enumerate(self.parts(text)):
            numbers = [] if i % 2 else self._numbers(self.find(p))
            total += 1 if i % 2 else int(self.tokens_of[numbers].sum())
        return total

    def count(self, text: str) -> int:
        return int(self.tables([text])[0][-1])

    def prefixes(self, text: str) -> list[int]:
        return self.tables([text])[0].tolist()


def fit(counts: np.ndarray, budget: int) -> int:
    """From stored counts: the most characters whose prefix has at most `budget` tokens."""
    return len(counts) - 1 if counts[-1] <= budget else int(np.flatnonzero(counts <= budget)[-1])


def longest_prefix(prefix_tokens: Column, budget: int) -> Column:
    """The same on a stored column of counts."""
    return F.array_max(F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i)))


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def count_tokens(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None,
                 limit: int = LIMIT, prefixes: bool = False) -> DataFrame:
    """n_bytes, n_tokens, over_limit and fit_chars (the most characters whose prefix has at most `limit` tokens) of each whole
    text, all read from its prefix counts; with prefixes=True also these, as prefix_tokens."""
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("_text"))
    kinds = [rows.schema[f"k{i}"].dataType.simpleString() for i in range(len(keep))]

    def make():
        own = counter(path or default_path())

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            cols = {f"k{i}": batch.column(f"k{i}") for i in range(len(keep))}
            n, fits, held = [], [], []
            for _, some in blocks_of(texts, BLOCK_CHARS):
                for counts in own.tables(some):
                    n.append(int(counts[-1]))
                    fits.append(fit(counts, limit))
                    if prefixes:
                        held.append(counts)
            cols |= {"n_bytes": pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_()), "fit_chars": pa.array(fits, pa.int64())}
            if prefixes:
                cols["prefix_tokens"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, held)]), pa.int32()), pa.array(np.concatenate(held)))
            return pa.record_batch(cols)

        apply.close = own.clear
        return apply

    schema = ", ".join([*[f"k{i} {k}" for i, k in enumerate(kinds)], "n_bytes long, n_tokens long, over_limit boolean, fit_chars long"] + ["prefix_tokens array<int>"] * prefixes)
    return named(arrow_map(rows, make, schema, calm=True), keep, "n_bytes", "n_tokens", "over_limit", "fit_chars", *["prefix_tokens"] * prefixes)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
