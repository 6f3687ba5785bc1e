"""Operator 5: SentencePiece encoding and decoding, with Gumbel top-k sampling of segmentations.

The plain encoding is the library's own.  For sampling, a text's lattice has an edge for every piece of the vocabulary (and
byte pieces for characters that no piece holds).  A segmentation's weight is the product of its pieces' weights,
(COST * (rank + 2)) ** -alpha, as the vocabulary is ordered by merge rank and fewer pieces are better, times e ** PLAIN for each
piece that stands at its place in the plain encoding too; so the plain encoding is what samples stray from.  No piece crosses a
blank but at its start, so the lattice is a chain of small ones, one a unit (blanks and the word after them); sums over them are exact.

Sampling is without replacement, by perturbed A-star search: the root carries a Gumbel variable of the whole
lattice; popping the best node draws one complete segmentation in it (the node's maximum) and splits the
rest of the node into disjoint parts, one for each unit where a segmentation can first differ, each with a Gumbel
of its own mass truncated at the node's.  The k best complete segmentations come out in order, all
different; the (k+1)-th value kappa gives inclusion scores 1 - exp(-exp(logprob - kappa)).  What is excluded in a unit is
held as a trie over its lattice, so the mass that is left is a sum of positive terms and every draw is exact, however little is left.

Every segmentation, plain or sampled, is decoded from its ids alone, and what comes out is compared with the text.

A batch's texts are cut into units and searched side by side on arrays; units are known by a 64-bit hash, and where the plain
encoding of their units does not read back as the text, the block is done again under another hash.  Random numbers are a hash of the row's key, the round and the place, so a
row's samples never depend on its partition.

Defined results: rank 0 is the plain encoding (no sample: its inclusion is null); null and empty texts have one empty
segmentation with inclusion 1; a text with fewer segmentations than k gives them all, with inclusion 1; U+2581 in a text reads back
as a blank, as in the library; repeated rows give the same samples; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.common import arrow_map, blocks_of, table

ALPHA, COST, PLAIN, SAMPLES = 0.3, 16, 2.0, 2
CACHE_UNITS, VECTOR_CHARS, BLOCK_CHARS, SLOTS = 400_000, 40, 1 << 20, 21
BLANK = "▁"
_P = np.uint64(0x9E3779B97F4A7C15)
_SURE, _TOGETHER, _AT_ONCE = 0.999, 128, 5000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1), one for each different counter."""
    return ((_mixed(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _counter(seeds: np.ndarray, *parts) -> np.ndarray:
    """Counters that name a place of a row: a hash chain over the parts (numbers, or one number a row)."""
    for p in parts:
        p = np.uint64((p + 1) * int(_P) & 0xFFFFFFFFFFFFFFFF) if isinstance(p, int) else (p.astype(np.uint64) + np.uint64(1)) * _P
        seeds = _mixed(seeds + p)
    return seeds


def _log_sum(logs: list[float]) -> float:
    top = max(logs, default=-math.inf)
    return top + math.log(sum(math.exp(x - top) for x in logs)) if top > -math.inf else top


class Stream:
    """Uniform numbers in (0, 1) from one counter, one after another."""

    def __init__(self, counter: int):
        self.at = counter

    def random(self) -> float:
        self.at = (self.at + int(_P)) & 0xFFFFFFFFFFFFFFFF
        return float(_uniform(np.array([self.at], np.uint64))[0])


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one run after another."""
    upto = np.cumsum(size)
    return np.repeat(start - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)


class Lattice:
    """One unit's segmentations; what is excluded is a list of them."""

    def __init__(self, unit: str, model: Pieces, plain: tuple[int, ...]):
        n, get = len(unit), model.known.get
        self.n, self.edges = n, [[] for _ in range(n + 1)]
        for i in range(n):
            for j in range(i + 1, min(n, i + model.longest) + 1):
                if (held := get(unit[i:j])) is not None:
                    self.edges[i].append((j, *held))
                elif j == i + 1:
                    self.edges[i].append((j, *model.bytes_of(unit[i])))
        for i, e in self.path(plain):
            j, ids, w = self.edges[i][e]
            self.edges[i][e] = (j, ids, w + model.plain_bonus)
        self.upto = [0.0] * (n + 1)  # log weight of all suffixes
        for i in range(n - 1, -1, -1):
            self.upto[i] = _log_sum([w + self.upto[j] for j, _, w in self.edges[i]])
        self.total = self.upto[0]

    def path(self, ids) -> list[tuple[int, int]]:
        """(place, number of its edge) of each piece of a segmentation."""
        out, i, left = [], 0, tuple(ids)
        while i < self.n:
            e = next(e for e, (_, own, _) in enumerate(self.edges[i]) if left[:len(own)] == own)
            out.append((i, e))
            i, own, _ = self.edges[i][e]
            left = left[len(own):]
        return out

    def logp(self, ids) -> float:
        return sum(self.edges[i][e][2] for i, e in self.path(ids)) - self.total

    def _trie(self, excluded) -> tuple[list[dict[int, int]], list[list[float]], list[float]]:
        """Nodes (children by edge), the log weight that is left behind each of a node's edges, and in all."""
        kids, place = [{}], [0]
        for ids in excluded:
            node = 0
            for i, e in self.path(ids):
                if e not in kids[node]:
                    kids[node][e] = len(kids)
                    kids.append({})
                    place.append(self.edges[i][e][0])
                node = kids[node][e]
        ways, left = [[] for _ in kids], [-math.inf] * len(kids)
        for node in range(len(kids) - 1, -1, -1):
            ways[node] = [w + (left[kids[node][e]] if e in kids[node] else self.upto[j]) for e, (j, _, w) in enumerate(self.edges[place[node]])]
            left[node] = _log_sum(ways[node])
        return kids, ways, left

    def left(self, excluded) -> float:
        """Log probability of all segmentations that are not excluded."""
        return self._trie(excluded)[2][0] - self.total

    def draw(self, excluded, stream) -> tuple[tuple[int, ...], float]:
        """A segmentation that is not excluded, by its conditional probability; and its log probability."""
        kids, ways, _ = self._trie(excluded)
        node, i, out, weight = 0, 0, (), 0.0
        while i < self.n:
            logs = ways[node] if node is not None else [w + self.upto[j] for j, _, w in self.edges[i]]
            top = max(logs)
            shares = [math.exp(x - top) for x in logs]
            u = stream.random() * sum(shares)
            chosen = 0
            for e, x in enumerate(shares):
                if x > 0:
                    chosen = e
                    if u < x:
                        break
                    u -= x
            node = kids[node].get(chosen) if node is not None else None
            i, ids, w = self.edges[i][chosen]
            out, weight = out + ids, weight + w
        return out, weight - self.total


class Pieces:
    """A SentencePiece vocabulary: plain encoding, decoding, and sampling."""

    def __init__(self, path: str, alpha: float = ALPHA, plain: float = PLAIN):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        names = [self.sp.id_to_piece(i) for i in range(n)]
        usable = [i for i in range(n) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i))]
        rank = {i: r for r, i in enumerate(sorted(usable, key=lambda i: (-self.sp.get_score(i), i)))}
        self.known = {names[i]: ((i,), -alpha * math.log(COST * (rank[i] + 2))) for i in usable}
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(n) if self.sp.is_byte(i)}
        if len(self.byte_ids) < 256:
            raise ValueError("this vocabulary has no byte pieces, so it cannot tell unknown characters apart")
        self.byte_weight, self.plain_bonus = -alpha * math.log(COST * (n + 2)), plain
        raw = [names[i].replace(BLANK, " ").encode() for i in range(n)]
        self.wide = np.array([len(x) for x in names], np.int64)
        for b, i in self.byte_ids.items():
            raw[i], self.wide[i] = bytes([b]), 1
        self.goes_on = np.zeros(n, bool)  # byte pieces inside a character
        self.goes_on[[self.byte_ids[b] for b in range(0x80, 0xC0)]] = True
        for i in range(n):
            if self.sp.is_control(i):
                raw[i] = b""
        self.raw, self.raw_list = raw, pa.array(raw, pa.large_binary())
        self.longest = max(map(len, self.known))
        cut = "".join(c for c in "\n\r\t" if not any(c in p and len(p) > 1 for p in self.known))
        if any(BLANK in p.lstrip(BLANK) for p in self.known):
            raise ValueError("a piece of this vocabulary crosses a blank; its lattice is no chain of words")
        if not cut:
            raise ValueError("this vocabulary has longer pieces with line ends, so texts cannot be parted there")
        self.cuts, self.cut = [ord(c) for c in cut], cut[0]
        self.single = np.zeros(0x110000, bool)  # characters that need no bytes
        self.single[[ord(p) for p in self.known if len(p) == 1]] = True
        heaviest = plain + alpha * math.log(COST * (n + 2))
        self.vector_chars = min(VECTOR_CHARS, int(600 / heaviest))  # products of so many weights fit in a double
        self._tables()
        self.base = 0x9E3779B97F4A7C15
        self.clear()

    # --- cache of units: for each its characters, plain ids and boundaries, log probability of the plain segmentation and of the others
    def clear(self, keep: int = 0) -> None:
        if not keep:
            self.hash, self.best, self.other, self.sure = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), np.zeros(0)
            self.mask, self.start, self.size, self.char_start, self.char_size = (np.zeros(0, np.int64) for _ in range(5))
            self.ids, self.chars = np.zeros(0, np.int32), np.zeros(0, np.uint32)
        else:
            for c in ("hash", "best", "other", "sure", "mask", "start", "size", "char_start", "char_size"):
                setattr(self, c, getattr(self, c)[:keep].copy())
            self.ids, self.chars = self.ids[:self.start[-1] + self.size[-1]].copy(), self.chars[:self.char_start[-1] + self.char_size[-1]].copy()
        self.at = dict(zip(self.hash.tolist(), range(len(self.hash)), strict=True))
        self.slot_hash, self.slot_unit = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.int32)
        self._place(self.hash, 0)
        Pieces.lattice.cache_clear()

    def _place(self, hashes: np.ndarray, first: int) -> None:
        """Writes units into their slots, where these are free."""
        slot = (hashes >> np.uint64(64 - SLOTS)).astype(np.int64)
        free = np.flatnonzero(self.slot_hash[slot] == 0)
        self.slot_hash[slot[free]], self.slot_unit[slot[free]] = hashes[free], first + free

    def _tables(self) -> None:
        """Hash tables of the pieces and their beginnings, for whole arrays of substrings; the odd multiplier is the first without
        a clash."""
        begun = {p[:i] for p in self.known for i in range(1, len(p))}
        names = [*self.known, *sorted(begun - self.known.keys())]
        seed = 0x100000001B3
        while True:
            h = np.array([self._hash(p, seed) for p in names], np.uint64)
            one, two = (h >> np.uint64(44)).astype(np.int64), (h & np.uint64(0xFFFFF)).astype(np.int64)
            _, first = np.unique(one, return_index=True)
            rest = np.setdiff1d(np.arange(len(h)), first)
            order = np.unique(two[rest], return_index=True)[1]
            if len(np.unique(h)) == len(h) and len(order) == len(rest):
                break
            seed += 2
        self.seed = np.uint64(seed)
        self.table_one, self.table_two = (np.full(1 << 20, -1, np.int32) for _ in range(2))
        self.table_one[one[first]], self.table_two[two[rest]] = first, rest
        self.hashes = np.append(h, np.uint64(0))
        self.weights = np.zeros(len(names) + 1)
        self.weights[:len(self.known)] = np.exp([w for _, w in self.known.values()])
        self.piece_ids = np.full(len(names) + 1, -1, np.int32)
        self.piece_ids[:len(self.known)] = [ids[0] for ids, _ in self.known.values()]
        self.kind = np.array([(p in self.known) + 2 * (p in begun) for p in names] + [0], np.uint8)  # 1: a piece, 2: begins a longer one

    @staticmethod
    def _hash(piece: str, seed: int) -> int:
        h = 0
        for c in piece:
            h = (h * seed + (ord(c) + 1) * int(_P)) & 0xFFFFFFFFFFFFFFFF
        return h

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        at = self.table_one[(h >> np.uint64(44)).astype(np.int64)]
        wrong = np.flatnonzero(self.hashes[at] != h)
        if len(wrong):
            own = h[wrong]
            two = self.table_two[(own & np.uint64(0xFFFFF)).astype(np.int64)]
            at[wrong] = np.where(self.hashes[two] == own, two, -1)
        return at

    def bytes_of(self, char: str) -> tuple[tuple[int, ...], float]:
        raw = char.encode("utf-8", "surrogatepass")
        return tuple(self.byte_ids[b] for b in raw), self.byte_weight * len(raw)

    def text_of(self, unit: int) -> str:
        return self.chars[self.char_start[unit]:self.char_start[unit] + self.char_size[unit]].tobytes().decode("utf-32-le", "surrogatepass")

    @functools.lru_cache(maxsize=2000)  # noqa: B019 - a few vocabularies live as long as their process
    def lattice(self, unit: int) -> Lattice:
        return Lattice(self.text_of(unit), self, self.plain_of(unit))

    def plain_of(self, unit: int) -> tuple[int, ...]:
        return tuple(self.ids[self.start[unit]:self.start[unit] + self.size[unit]].tolist())

    def _edges(self, flat: np.ndarray, size: np.ndarray, masks: np.ndarray):
        """The pieces in many units (their characters, one unit after another), by the places they begin at: the places, the nodes
        of both ends, the pieces' numbers, their weights, and whether they are pieces of the plain encoding.  A unit has a node before each character and one at its end."""
        unit, ends = np.repeat(np.arange(len(size)), size), np.repeat(np.cumsum(size), size)
        places = _spread(np.zeros(len(size), np.int64), size)
        codes = (flat.astype(np.uint64) + np.uint64(1)) * _P
        rows, h, starts, found = np.arange(len(flat)), np.zeros(len(flat), np.uint64), [], []
        for n in range(self.longest):  # only where the characters so far still begin a piece
            h = h * self.seed + codes[rows + n]
            at = self._lookup(h)
            kind = self.kind[at]
            hit = np.flatnonzero(kind & 1)
            starts.append(rows[hit])
            found.append(at[hit])
            more = np.flatnonzero((kind & 2 != 0) & (rows + n + 1 < ends[rows]))
            if not len(more):
                break
            rows, h = rows[more], h[more]
        length = np.repeat(np.arange(1, len(starts) + 1), [len(x) for x in starts])
        rows, at = np.concatenate(starts), np.concatenate(found)
        order = np.argsort(places[rows].astype(np.uint8), kind="stable")
        rows, at, length = rows[order], at[order], length[order]
        place, own = places[rows], unit[rows]
        same = masks[own] >> place & ((2 << length) - 1) == 1 | 1 << length
        weight = self.weights[at]
        weight[same] *= math.exp(self.plain_bonus)
        return place, rows + own, rows + own + length, at, weight, same

    def _forward(self, flat: np.ndarray, size: np.ndarray, masks: np.ndarray, which: np.ndarray | None = None, counters: np.ndarray | None = None):
        """Sums over the lattices of many units (their characters, one unit after another) at once, on weights themselves; every character is a piece.  Without counters: the log
        probabilities of the plain segmentation and of all others.  With them: for each counter a segmentation other than the plain
        one of the unit that `which` numbers, as (log probability, number of pieces, all ids): every place keeps one way back to it, drawn by its share
        of the sum so far, once among all ways and once among those that leave the plain segmentation.  The ways are drawn for the places that a segmentation comes by."""
        place, begin, end, at, weight, same = self._edges(flat, size, masks)
        last = np.cumsum(size + 1) - 1
        every, plain, leaving = (np.zeros(last[-1] + 1) for _ in range(3))
        every[last - size], plain[last - size] = 1.0, 1.0
        if counters is not None:  # by the nodes where they end: the edges, their shares and the sums so far, of all ways and of those that leave
            count = np.bincount(end, minlength=len(every))
            first = np.cumsum(count) - count
            free, into = first.copy(), np.empty(len(at), np.int64)
            share, so_far = np.empty((len(at), 2)), np.empty((len(at), 2))
        upto = np.searchsorted(place, np.arange(int(size.max()) + 1))
        for a, b in itertools.pairwise(upto.tolist()):  # no node ends two edges that begin at one place
            here, there, w, on = begin[a:b], end[a:b], weight[a:b], same[a:b]
            add = w * every[here]
            add_left = np.where(on, w * leaving[here], add)
            total, total_left = every[there] + add, leaving[there] + add_left
            every[there], leaving[there] = total, total_left
            if counters is None:
                kept = np.flatnonzero(on)
                plain[there[kept]] = w[kept] * plain[here[kept]]
            else:
                own = free[there]
                free[there] = own + 1
                into[own] = np.arange(a, b)
                share[own, 1], share[own, 0], so_far[own, 1], so_far[own, 0] = add, add_left, total, total_left
        if counters is None:
            with np.errstate(divide="ignore"):
                return np.minimum(np.log(plain[last] / every[last]), 0.0), np.log(leaving[last] / every[last])
        name = ((place * 64 + place + end - begin).astype(np.uint64) * _P)[into]
        piece, weight, place, begin, leaves = self.piece_ids[at][into], np.log(weight)[into], place[into], begin[into], ~same[into]
        node, logp, go, off = last[which], -np.log(every[last])[which], np.arange(len(which)), np.zeros(len(which), np.int64)
        steps = []
        while len(go):  # all from their ends
            many = count[node]
            upto = np.cumsum(many)
            edge, way = _spread(first[node], many), np.repeat(off, many)
            u = _uniform(np.repeat(counters[go], many) + name[edge])
            new = np.where(u * so_far[edge, way] < share[edge, way], np.arange(len(edge)), -1)
            edge = edge[np.maximum.reduceat(new, upto - many)]
            steps.append((go, piece[edge]))
            logp[go] += weight[edge]
            on = np.flatnonzero(place[edge] > 0)
            edge, go = edge[on], go[on]
            node, off = begin[edge], off[on] | leaves[edge]
        went = np.concatenate([own for own, _ in steps])
        pieces = np.bincount(went, minlength=len(which))
        upto, ids = np.cumsum(pieces), np.empty(len(went), np.int32)
        for n, (own, found) in enumerate(steps):
            ids[upto[own] - 1 - n] = found
        return logp, pieces, ids

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Numbers of all units of the texts, where each text's begin, and what decoding shall give; new units are learned."""
        if len(self.at) > CACHE_UNITS:
            self.clear(keep=CACHE_UNITS // 4)  # the first to come are mostly the frequent ones
        marked = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts]
        joined = "".join(marked)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, marked), np.int64, len(marked))
        if not len(chars):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64), b""
        blank, cut = chars == ord(BLANK), np.zeros(len(chars), bool)
        for c in self.cuts:
            cut |= chars == c
        first = cut.copy()  # a unit begins at a cut, after one, at the first of some blanks, and with each text
        first[1:] |= cut[:-1] | (blank[1:] & ~blank[:-1])
        first[(np.cumsum(size) - size)[size > 0]] = True
        start = np.flatnonzero(first)
        length = np.diff(start, append=len(chars))
        begin = np.searchsorted(start, np.append(0, np.cumsum(size)))
        powers = np.cumprod(np.full(int(length.max()), self.base, np.uint64))
        hashes = np.add.reduceat((chars + np.uint64(1)) * powers[_spread(np.zeros(len(start), np.int64), length)], start)
        hashes = _mixed(hashes + length.astype(np.uint64) * _P) | np.uint64(1)
        slot = (hashes >> np.uint64(64 - SLOTS)).astype(np.int64)
        numbers = np.where(self.slot_hash[slot] == hashes, self.slot_unit[slot], -1).astype(np.int64)
        other = np.flatnonzero(numbers < 0)
        numbers[other] = np.fromiter(map(self.at.get, hashes[other].tolist(), itertools.repeat(-1)), np.int64, len(other))
        new = other[numbers[other] < 0]
        if len(new):
            found, where, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            old = len(self.at)
            self._learn(chars, start[new[where]], length[new[where]])
            numbers[new] = old + back
            self.at.update(zip(found.tolist(), range(old, old + len(found)), strict=True))
            self.hash = np.concatenate([self.hash, found])
            self._place(found, old)
        return numbers, begin, joined.replace(BLANK, " ").encode("utf-8", "surrogatepass")

    def _learn(self, chars: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """New units, told by their characters.  The library encodes many in one text, parted by a cut."""
        own = chars[_spread(start, size)]
        first = np.cumsum(size) - size
        text = np.full(len(own) + len(size), ord(self.cut), np.uint32)
        base = first + np.arange(len(size)) + 1
        text[_spread(base, size)] = own
        text, starts = text.tobytes().decode("utf-32-le", "surrogatepass"), [*(base[::_TOGETHER] - 1).tolist(), len(text)]
        encoded = self.sp.encode([text[a:b] for a, b in itertools.pairwise(starts)], num_threads=1)
        ids = np.array(list(itertools.chain.from_iterable(encoded)), np.int32)
        base += np.arange(len(base)) // _TOGETHER + 1  # the library puts a blank first
        width = self.wide[ids]
        width[:-1][self.goes_on[ids[1:]]] = 0  # a character's last byte counts as the character
        ends = np.cumsum(width)
        a, b = np.searchsorted(ends - width, base), np.searchsorted(ends, base + size) + 1
        if ends[-1] != len(text) + len(encoded) or ((ends - width)[a] != base).any() or (ends[b - 1] != base + size).any():
            raise ValueError("the vocabulary's normaliser changes a text; its lattice would not be the text's")
        count = b - a
        where = _spread(a, count)
        bits = np.left_shift(1, np.minimum((ends - width)[where] - np.repeat(base, count), 62))
        mask = np.bitwise_or.reduceat(bits, np.cumsum(count) - count) | np.left_shift(1, np.minimum(size, 62))
        easy = np.logical_and.reduceat(self.single[own], first) & (size <= self.vector_chars)
        mask[~easy] = 0
        best, other = np.zeros(len(size)), np.zeros(len(size))
        some = np.flatnonzero(easy)
        for i in range(0, len(some), _AT_ONCE):
            at = some[i:i + _AT_ONCE]
            best[at], other[at] = self._forward(own[_spread(first[at], size[at])], size[at], mask[at])
        for i in np.flatnonzero(~easy).tolist():
            plain = tuple(ids[a[i]:b[i]].tolist())
            held = Lattice(own[first[i]:first[i] + size[i]].tobytes().decode("utf-32-le", "surrogatepass"), self, plain)
            best[i], other[i] = min(0.0, held.logp(plain)), held.left([plain])
        sure = np.where(other > -np.inf, np.exp(best), 1.0)
        self.start, self.char_start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count]), np.concatenate([self.char_start, len(self.chars) + first])
        self.ids, self.chars = np.concatenate([self.ids, ids[where]]), np.concatenate([self.chars, own])
        for c, x in (("best", best), ("other", other), ("sure", sure), ("mask", mask), ("size", count), ("char_size", size)):
            setattr(self, c, np.concatenate([getattr(self, c), x]))

    # --- encoding and decoding
    def encode(self, text: str) -> list[int]:
        """The library's own encoding."""
        return self.sp.encode(text)

    def decode(self, ids) -> str:
        return next(self.decoded([np.asarray(ids, np.int32)])).decode("utf-8", "replace")

    def decoded(self, lists: list[np.ndarray]) -> Iterator[bytes]:
        """What each list of ids says, as UTF-8, without the blank that begins every text."""
        for _, some in blocks_of(lists, BLOCK_CHARS):
            said, upto = self._said(np.concatenate(some))
            for a, b in itertools.pairwise(upto[np.cumsum([0, *map(len, some)])].tolist()):
                yield said[a + (said[a:min(a + 1, b)] == b" "):b]

    def _said(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """What the pieces say, one after another, and where each begins and the last ends."""
        _, upto, said = self.raw_list.take(pa.array(ids)).buffers()
        return said.to_pybytes() if said else b"", np.frombuffer(upto, np.int64, len(ids) + 1)

    # --- sampling
    def _others(self, units: np.ndarray, counters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each unit a segmentation other than the plain one: log probabilities, numbers of pieces, and all ids in order."""
        logp, size, parts = np.zeros(len(units)), np.zeros(len(units), np.int64), []
        hard = self.mask[units] == 0
        some = np.flatnonzero(~hard)
        some = some[np.argsort(units[some], kind="stable")]  # draws of one unit share its lattice
        for s in range(0, len(some), _AT_ONCE):
            at = some[s:s + _AT_ONCE]
            own, which = np.unique(units[at], return_inverse=True)
            logp[at], size[at], ids = self._forward(self.chars[_spread(self.char_start[own], self.char_size[own])], self.char_size[own], self.mask[own], which, counters[at])
            parts.append(ids)
        rest = np.flatnonzero(hard)
        for i in rest.tolist():
            ids, logp[i] = self.lattice(int(units[i])).draw([self.plain_of(units[i])], Stream(int(counters[i])))
            size[i] = len(ids)
            parts.append(np.array(ids, np.int32))
        flat = np.concatenate([np.zeros(0, np.int32), *parts])
        order = np.concatenate([some, rest])
        start = np.empty(len(units), np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        return logp, size, flat[_spread(start, size)]  # in the order of the units again

    def sample(self, numbers: np.ndarray, begin: np.ndarray, seeds: np.ndarray, k: int) -> tuple[list[list[tuple]], Ways]:
        """For each text, of k different segmentations, best perturbed value first: log probability, inclusion score, and the units
        that differ from the plain encoding with their ways.  numbers, begin: as `read` gives them; seeds: one a text."""
        docs, n, ways = len(begin) - 1, np.diff(begin), Ways(self)
        done: list[list] = [[] for _ in range(docs)]
        nothing = np.zeros(0, np.int64)
        # node: its value, where it may first differ, the ways excluded there, log probability of the units before, and their sample
        roots = -np.log(-np.log(_uniform(_counter(seeds, 0))))
        heaps = [[(-float(roots[d]), 0, 0, (), 0.0, -1)] if n[d] else [] for d in range(docs)]
        ties = 1
        for r in range(k):
            nodes = [(d, heapq.heappop(heaps[d])) for d in range(docs) if heaps[d]]
            if not nodes:
                break
            own = np.array([d for d, _ in nodes])
            first = np.array([x[2] for _, x in nodes])
            size = n[own] - first
            upto = np.cumsum(size)
            starts = upto - size
            place = _spread(first, size)
            unit = numbers[_spread(begin[own] + first, size)]
            counter = _counter(np.repeat(seeds[own], size), r + 1, place)
            logs, rest, way = self.best[unit], self.other[unit], np.full(len(unit), -1, np.int64)
            leave = _uniform(counter) >= self.sure[unit]
            special = [(x[3], s) for (_, x), s in zip(nodes, starts.tolist(), strict=True) if x[3]]
            for gone, s in special:
                leave[s] = gone == (-1,)
            at = np.flatnonzero(leave)
            way[at] = ways.add(*self._others(unit[at], _counter(counter[at], 7)))
            for gone, s in special:
                if not leave[s]:
                    way[s] = ways.draw(int(unit[s]), gone, Stream(int(_counter(counter[s:s + 1], 8)[0])))
            at = np.flatnonzero(way >= 0)
            logs[at] = ways.logp[way[at]]
            taken = np.exp(logs[at])
            rest[at] = np.log1p(-np.minimum(taken, _SURE))
            for p in at[taken >= _SURE].tolist():
                rest[p] = ways.left(int(unit[p]), (int(way[p]),))
            for gone, s in special:
                rest[s] = ways.left(int(unit[s]), (*gone, int(way[s])))
            ends = np.empty(len(logs))
            for a, b, (_, x) in zip(starts.tolist(), upto.tolist(), nodes, strict=True):
                np.cumsum(logs[a:b], out=ends[a:b])  # each text by itself, so that rounding does not depend on its neighbours
                ends[a:b] += x[4]
            with np.errstate(divide="ignore"):
                g = rest + (ends - logs) - np.log(-np.log(_uniform(counter + _P)))
            a, b = np.searchsorted(at, starts), np.searchsorted(at, upto)
            for m, (d, x) in enumerate(nodes):
                before, ways_before = (done[d][x[5]][2:] if x[5] >= 0 else (nothing, nothing))
                held = np.searchsorted(before, x[2])
                some = at[a[m]:b[m]]
                done[d].append((float(ends[upto[m] - 1]), -x[0], np.concatenate([before[:held], place[some]]), np.concatenate([ways_before[:held], way[some]])))
            node = np.repeat(np.arange(len(nodes)), size)
            for _ in range(k - r):  # no more of the parts can still be popped, or tell the next value
                hit = np.flatnonzero((g == np.repeat(np.maximum.reduceat(g, starts), size)) & (g > -np.inf))
                hit = hit[np.unique(node[hit], return_index=True)[1]]
                for p in hit.tolist():
                    m = node[p]
                    d, x = nodes[m]
                    cut = -float(np.logaddexp(x[0], -g[p]))  # truncated at the node's own value, which keeps their order
                    heapq.heappush(heaps[d], (-cut, ties, int(place[p]), (*(x[3] if p == starts[m] else ()), int(way[p])), float(ends[p] - logs[p]), len(done[d]) - 1))
                    ties += 1
                g[hit] = -np.inf
        out = []
        for d in range(docs):
            kappa = -heaps[d][0][0] if heaps[d] else -math.inf  # the value of the next one, without drawing it
            found = done[d] if n[d] else [(0.0, 0.0, nothing, nothing)]
            out.append([(p, 1.0 if kappa == -math.inf else -math.expm1(-math.exp(min(p - kappa, 700.0))), where, own) for p, _, where, own in found])
        return out, ways

    def run(self, texts: list[str], seeds: np.ndarray, k: int) -> list[tuple[int, int, float, float | None, np.ndarray, bool]]:
        """(number of the text, rank, log probability, inclusion, ids, whether they read back) of each text's plain encoding, rank 0,
        and its k sampled segmentations."""
        said = [t.replace(BLANK, " ").encode("utf-8", "surrogatepass") for t in texts]
        rows = self.segmentations(texts, seeds, k)
        return [(*row, back == said[row[0]]) for row, back in zip(rows, self.decoded([row[4] for row in rows]), strict=True)]

    def segmentations(self, texts: list[str], seeds: np.ndarray, k: int) -> list[tuple[int, int, float, float | None, np.ndarray]]:
        """The rows of `run`, not decoded yet."""
        for _ in range(3):
            numbers, begin, target = self.read(texts)
            ids = self.ids[_spread(self.start[numbers], self.size[numbers])]
            if self._said(ids)[0] == target:
                break
            self.base += 2  # two units share a hash
            self.clear()
        else:
            raise ValueError("the vocabulary does not read back a text")
        upto = np.append(0, np.cumsum(self.size[numbers]))
        logs = self.best[numbers]
        out = [(d, 0, float(logs[a:b].sum()), None, ids[upto[a]:upto[b]]) for d, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True))]
        samples, ways = self.sample(numbers, begin, seeds, k)
        start, size, pool = self.start[numbers], self.size[numbers], np.concatenate([self.ids, *ways.ids])
        for d, own in enumerate(samples):
            a, b = begin[d], begin[d + 1]
            for rank, (logp, inclusion, where, way) in enumerate(own, 1):
                s, c = start[a:b].copy(), size[a:b].copy()
                s[where], c[where] = len(self.ids) + ways.start[way], ways.size[way]
                out.append((d, rank, logp, inclusion, pool[_spread(s, c)]))
        return out


class Ways:
    """Segmentations of units that were drawn beside the plain ones, by number; -1 stands for a unit's plain one."""

    def __init__(self, model: Pieces):
        self.model, self.ids, self.held = model, [], 0
        self.logp, self.start, self.size = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, logp: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
        first = len(self.logp)
        self.logp = np.concatenate([self.logp, logp])
        self.start, self.size = np.concatenate([self.start, self.held + np.cumsum(size) - size]), np.concatenate([self.size, size])
        self.ids.append(ids)
        self.held += len(ids)
        return np.arange(first, first + len(logp))

    def ids_of(self, unit: int, way: int) -> tuple[int, ...]:
        if way < 0:
            return self.model.plain_of(unit)
        self.ids = [np.concatenate(self.ids)]
        return tuple(self.ids[0][self.start[way]:self.start[way] + self.size[way]].tolist())

    def left(self, unit: int, excluded: tuple[int, ...]) -> float:
        """Log probability of a unit's segmentations but the excluded ones."""
        if excluded == (-1,):
            return float(self.model.other[unit])
        gone = sum(math.exp(self.model.best[unit] if w < 0 else self.logp[w]) for w in excluded)
        if gone < _SURE:
            return math.log1p(-gone)
        return self.model.lattice(unit).left([self.ids_of(unit, w) for w in excluded])

    def draw(self, unit: int, excluded: tuple[int, ...], stream: Stream) -> int:
        """A way of the unit that is not excluded."""
        if -1 not in excluded and math.log(stream.random()) + self.left(unit, excluded) < self.model.best[unit]:
            return -1
        ids, logp = self.model.lattice(unit).draw([self.ids_of(unit, w) for w in {*excluded, -1}], stream)
        return int(self.add(np.array([logp]), np.array([len(ids)]), np.array(ids, np.int32))[0])


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, alpha: float = ALPHA, plain: float = PLAIN) -> Pieces:
    return Pieces(path, alpha, plain)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def row_seeds(keys) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "little") for key in keys], np.uint64)


def sample_encodings(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SAMPLES, alpha: float = ALPHA, plain: float = PLAIN, path: str | None = None, ids: bool = False, decoded: bool = False) -> DataFrame:
    """Rows of each row of docs: id, rank (0: the plain encoding, then the sampled segmentations, 1 is first), n_pieces, logprob,
    inclusion (null for rank 0), ids_sha256 (of the ids as little-endian 32-bit numbers), exact (decoding gives the text back, U+2581 as a blank); if asked for, the ids, and
    the text decoded from them."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def make():
        own = vocabulary(path or default_path(), alpha, plain)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, texts = batch.column("id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            where, out, found = [], {c: [] for c in ("rank", "n_pieces", "logprob", "inclusion", "ids_sha256", "exact")}, []
            read: list[bytes] = []
            for s, some in blocks_of(texts, BLOCK_CHARS):
                said = [t.replace(BLANK, " ").encode() for t in some]
                rows = own.segmentations(some, row_seeds(names[s:s + len(some)]), k)
                for (d, rank, logp, inclusion, listed), back in zip(rows, own.decoded([x[4] for x in rows]), strict=True):
                    where.append(s + d)
                    out["rank"].append(rank)
                    out["n_pieces"].append(len(listed))
                    out["logprob"].append(logp)
                    out["inclusion"].append(inclusion)
                    out["ids_sha256"].append(hashlib.sha256(listed.astype("<i4", copy=False).tobytes()).hexdigest())
                    out["exact"].append(back == said[d])
                    if ids:
                        found.append(listed)
                    if decoded:
                        read.append(said[d] if out["exact"][-1] else back)  # equal ones are held once
            kinds = {"rank": pa.int32(), "n_pieces": pa.int64(), "logprob": pa.float64(), "inclusion": pa.float64(), "ids_sha256": pa.string(), "exact": pa.bool_()}
            cols = {"id": batch.column("id").take(pa.array(where, pa.int64()))} | {c: pa.array(out[c], t) for c, t in kinds.items()}
            if ids:
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                cols["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32)))
            if decoded:
                cols["decoded"] = pa.array([x if e else x.decode("utf-8", "replace").encode() for x, e in zip(read, out["exact"], strict=True)], pa.binary()).cast(pa.string())
            return pa.record_batch(cols)

        apply.close = own.clear
        return apply

    return arrow_map(rows, make, f"id {id_type}, rank int, n_pieces long, logprob double, inclusion double, ids_sha256 string, exact boolean" + ", ids array<int>" * ids + ", decoded string" * decoded, calm=True)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's plain encoding and sampled segmentations, with their ids and the text decoded from these."""
    return sample_encodings(table(spark, sf_dir, "documents"), ids=True, decoded=True).withColumnRenamed("id", "doc_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the plain encoding and the sampled segmentations of every document, with their ids."""
    return sample_encodings(docs, ids=True).withColumnRenamed("id", "doc_id")
