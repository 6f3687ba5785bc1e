"""Operator 3: SimHash near-duplicates by bit-sliced comparison.

Fingerprint: the majority bits of the XXH64 (seed 42) of a text's word shingles.  Two fingerprints link at
`radius` or fewer differing bits, and a group is a connected component of links.

Candidates are exact, not sampled: the 64 bits are cut into blocks, and two fingerprints within the
radius agree on at least blocks - radius whole blocks, so every choice of that many blocks is one table of
buckets.  Equal fingerprints are folded first, so copies cost nothing more.  Every bucket is compared bit-sliced:
its fingerprints are stored as vertical bit planes (one machine word holds one bit of 64 fingerprints), the
queries' distances to all of them are counted at once by carry-save bitwise counters, and a block of 64 is abandoned as
soon as every counter in it is over the radius.  Buckets of up to 64 stand side by side in shared planes, where one step compares one
member of each bucket with all others of its own; larger ones are compared with many queries at once, after the clusters around
their first members have left the planes, so a dense cluster costs about one scan and gives a spanning tree, not all pairs.
A bucket of over `chunk` fingerprints is dealt out as pairs of chunks, so no task holds an unbounded bucket.

Defined results: null and blank texts have fingerprint zero and link like any other; a text of fewer
words than a shingle is one shingle; rows with a null id take part, but never name a group (a
group of null ids only has a null component_id); repeated rows are each returned; other columns are ignored.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.common import arrow_map, components, keyed, materialize, named, row_key, shuffled, table, unkeyed

RADIUS, SHINGLE, CHUNK = 4, 4, 1024
#: For similarity 0.8 or more of five-word shingles, as the pipeline takes it: three fingerprints, since one misses too many.
STAGE_RADIUS, STAGE_SHINGLE, STAGE_SIMILARITY, STAGE_PRINTS = 7, 5, 0.8, 3
SKETCH = 128
_FULL, _BATCH_WORDS = np.uint64(0xFFFFFFFFFFFFFFFF), 8192


def fingerprints(text: str | None, shingle: int = SHINGLE, prints: int = 1) -> list[int]:
    """Fingerprints as unsigned 64-bit numbers: the first by the shingles' hashes, the others by remixed ones."""
    from xxhash import xxh64_intdigest as xxh

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and \x20\x09-\x0D only
    if not words:
        return [0] * prints
    whole = b" ".join(words)
    if len(words) <= shingle:
        seen = np.array([xxh(whole, 42)], np.uint64)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        ends, starts = end[shingle - 1:].tolist(), (end - size)[:len(words) - shingle + 1].tolist()
        seen = np.fromiter((xxh(whole[a:b], 42) for a, b in zip(starts, ends, strict=True)), np.uint64, len(ends))
    out = []
    for _ in range(prints):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(seen), 1 << 15):
            ones += np.unpackbits(seen[i:i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(seen), bitorder="little").view(np.uint64)[0]))
        seen = (seen ^ (seen >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        seen ^= seen >> np.uint64(29)
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE, prints: int = 1) -> DataFrame:
    """keep + fp (fp0, fp1, ... where more than one is asked for), the fingerprints as signed longs."""
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("_text"))
    kinds = [rows.schema[f"k{i}"].dataType.simpleString() for i in range(len(keep))]
    names = _names(prints)

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprints(t, shingle, prints) for t in batch.column("_text").to_pylist()], np.uint64).view(np.int64)
            return pa.record_batch({f"k{i}": batch.column(f"k{i}") for i in range(len(keep))} | {c: pa.array(fps[:, i]) for i, c in enumerate(names)})
        return apply

    return named(arrow_map(rows, make, ", ".join([*[f"k{i} {k}" for i, k in enumerate(kinds)], *[f"{c} long" for c in names]])), keep, *names)


def _names(prints: int) -> list[str]:
    return ["fp"] if prints == 1 else [f"fp{i}" for i in range(prints)]


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Vertical storage: row b holds bit b of every fingerprint, packed 64 to a word."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits, axis=0, bitorder="little").T
    wide = np.zeros((64, -(-packed.shape[1] // 8) * 8), np.uint8)
    wide[:, :packed.shape[1]] = packed
    return wide.view(np.uint64)


def _counted(planes, over: np.ndarray, radius: int) -> np.ndarray:
    """over: words in which a bit is set for every lane that is out already -> the same after all 64 planes, with a bit for each
    lane over the radius.  planes(b, live): the differing bits b of the words still alive.

    Carry-save counters of three bits, started so that they overflow at radius + 1; overflow is kept."""
    live, out = np.arange(len(over)), over.copy()
    low, mid, high = (np.full(len(over), _FULL if 7 - radius >> i & 1 else 0, np.uint64) for i in range(3))
    for b in range(64):
        carry = planes(b, live)
        low, carry = low ^ carry, low & carry
        mid, carry = mid ^ carry, mid & carry
        high, carry = high ^ carry, high & carry
        over = over | carry
        if b % 8 == 7 or b == 63:
            out[live] = over
            on = np.flatnonzero(over != _FULL)
            if not len(on):
                break
            if len(on) < len(live):  # whole blocks are abandoned
                live, low, mid, high, over = (x[on] for x in (live, low, mid, high, over))
    return out


def _lanes(words: np.ndarray) -> np.ndarray:
    """Numbers of the lanes whose bit is not set."""
    at = np.flatnonzero(words != _FULL)
    bits = np.unpackbits((~words[at]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(-1)
    hit = np.flatnonzero(bits)
    return at[hit // 64] * 64 + hit % 64


def within(planes: np.ndarray, n: int, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, stored) numbers of all pairs that differ in at most `radius` bits; n fingerprints are stored."""
    words, out = planes.shape[1], [np.zeros((0, 2), np.int64)]
    tail = np.zeros(words, np.uint64)
    if n % 64:
        tail[-1] = _FULL << np.uint64(n % 64)
    step = max(1, _BATCH_WORDS // words)
    for s in range(0, len(queries), step):
        some = queries[s:s + step]
        q, w = np.divmod(np.arange(len(some) * words), words)
        over = _counted(lambda b, live, some=some, q=q, w=w: planes[b, w[live]] ^ (np.uint64(0) - (some[q[live]] >> np.uint64(b) & np.uint64(1))), np.tile(tail, len(some)), radius)
        lane = _lanes(over)
        out.append(np.stack([s + q[lane // 64], w[lane // 64] * 64 + lane % 64], 1))
    both = np.concatenate(out)
    return both[:, 0], both[:, 1]


def side_by_side(values: np.ndarray, first: np.ndarray, size: np.ndarray, radius: int) -> np.ndarray:
    """Pairs (numbers of values) within the radius in each of many groups of 2 to 64; a group takes a power of two of lanes."""
    out, wide = [np.zeros((0, 2), np.int64)], 1 << np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64)
    for g in np.unique(wide).tolist():
        own = np.flatnonzero(wide == g)
        for s in range(0, len(own), (1 << 18) // g):
            some = own[s:s + (1 << 18) // g]
            lanes = -(-len(some) * g // 64) * 64
            lane, rank = np.zeros(lanes, np.int64), np.full(lanes, g)
            at = np.repeat(np.arange(len(some)) * g, size[some])
            inside = np.arange(len(at)) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
            lane[at + inside], rank[at + inside] = np.repeat(first[some], size[some]) + inside, inside
            planes = planes_of(values[lane])
            ones, fill = np.uint64(sum(1 << i for i in range(0, 64, g))), np.uint64((1 << g) - 1)
            for p in range(int(size[some].max()) - 1):
                gone = np.packbits((rank <= p) | (rank == g), bitorder="little").view(np.uint64)  # itself, those before it, and empty lanes
                over = _counted(lambda b, live, p=p: planes[b, live] ^ ((planes[b, live] >> np.uint64(p) & ones) * fill), gone, radius)
                hit = _lanes(over)
                out.append(np.stack([lane[hit - rank[hit] + p], lane[hit]], 1))
    return np.concatenate(out)


def forest_of(n: int, pairs: np.ndarray) -> np.ndarray:
    """Numbers of those pairs (of n things) that join what all of them join."""
    label, keep, left = np.arange(n), [], np.arange(len(pairs))
    while len(left):
        la, lb = label[pairs[left, 0]], label[pairs[left, 1]]
        on = np.flatnonzero(la != lb)
        if not len(on):
            break
        left, la, lb = left[on], la[on], lb[on]
        lo, hi = np.minimum(la, lb), np.maximum(la, lb)
        order = np.lexsort((lo, hi))  # each label goes to the least it is linked with, by one link
        one = order[np.unique(hi[order], return_index=True)[1]]
        keep.append(left[one])
        label[hi[one]] = lo[one]
        root = np.arange(n)
        root[hi[one]] = lo[one]
        while (root[root] != root).any():
            root = root[root]
        label = root[label]
    return np.concatenate([np.zeros(0, np.int64), *keep])


def cluster(fps: np.ndarray, radius: int, keep=lambda pairs: pairs) -> np.ndarray:
    """Pairs (numbers of fps) that join what is connected within one large bucket, by the pairs that `keep` lets count."""
    left, links = np.arange(len(fps)), [np.zeros((0, 2), np.int64)]
    while len(left) > 1:
        todo, rest, found = left[:1], left[1:], 1
        while len(todo) and len(rest):
            q, x = within(planes_of(fps[rest]), len(rest), fps[todo], radius)
            pairs = keep(np.stack([todo[q], rest[x]], 1))
            new, one = np.unique(pairs[:, 1], return_index=True)
            links.append(pairs[one])
            found += len(new)
            todo, rest = new, np.setdiff1d(rest, new, assume_unique=True)
        if found * 8 < len(left):  # no dense cluster here: what is left, and this one, is compared all at once
            break
        left = rest
    if len(left) > 1:
        pairs = np.stack(within(planes_of(fps[left]), len(left), fps[left], radius), 1)
        pairs = keep(left[pairs[pairs[:, 0] < pairs[:, 1]]])
        links.append(pairs[forest_of(len(fps), pairs)])
    return np.concatenate(links)


def may_agree(sketch: np.ndarray, size: np.ndarray, pairs: np.ndarray, similarity: float) -> np.ndarray:
    """The pairs whose sets can agree to `similarity`: counts of members by bins bound what two sets share from above, so none is lost."""
    out = [pairs[:0]]
    for i in range(0, len(pairs), 1 << 15):
        a, b = pairs[i:i + (1 << 15)].T
        one, two = sketch[a], sketch[b]
        shared = np.minimum(one, two).sum(1, dtype=np.int64)
        full = ((one == 255) | (two == 255)).any(1)  # counts that may be larger bound nothing
        out.append(pairs[i:i + (1 << 15)][full | (shared >= similarity * (size[a] + size[b] - shared) - 1e-9)])
    return np.concatenate(out)


def links(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None, chunk: int = CHUNK, similarity: float = 0.0) -> DataFrame:
    """fps(fp), distinct -> (a, b): a set of links with the same components as all links within the radius.
    fps(fp, t, part, n, sketch) of texts t -> (a, b): all pairs of texts of different parts within the radius whose sets of shingles may agree
    to `similarity` by their sizes n and sketches.

    More blocks make more, finer tables: 6 blocks (15 tables of 21 bits at radius 4) up to 2^24
    fingerprints, 7 (35 tables of 27 bits) up to 2^28, else 8 (70 tables of 32 bits); all are exact."""
    if not 0 <= radius <= 7:
        raise ValueError("the three-bit counters hold a radius of 0 to 7")
    if blocks is None:
        n = fps.count()
        blocks = radius + 2 + (n > 1 << 24) + (n > 1 << 28)
    told = "sketch" in fps.columns
    item = F.struct("fp", "t", "part", "n", "sketch") if told else F.col("fp")
    edges = np.linspace(0, 64, blocks + 1).round().astype(int).tolist()
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(0).cast("long")
        for c in chosen:
            width = edges[c + 1] - edges[c]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", edges[c]).bitwiseAND((1 << width) - 1))
        keys.append(key.bitwiseOR(F.lit(t << 40).cast("long")))  # blocks differ in width: the table stands above all of them
    rows = fps.select("fp", item.alias("item"), F.posexplode(F.array(*keys)).alias("t", "key"))
    sizes = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    parts = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64(F.col("item.t") if told else F.col("item")), F.col("g")).cast("int")
    dealt = rows.join(shuffled(sizes), "key").withColumn("g", parts).withColumn("own", own).select(
        "key", "t", "item", F.explode(F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda o: F.least(F.col("own"), o) * F.col("g") + F.greatest(F.col("own"), o))).alias("part"))
    groups = dealt.groupBy("key", "part").agg(F.first("t").alias("t"), F.collect_list("item").alias("fps")).where(F.size("fps") > 1).select("t", "fps")
    masks = [sum(((1 << (edges[c + 1] - edges[c])) - 1) << edges[c] for c in range(b)) for b in range(blocks + 1)]
    spans = np.array([masks[c + 1] ^ masks[c] for c in range(blocks)], np.uint64)
    chosen = np.array([[c in own for c in range(blocks)] for own in combinations(range(blocks), blocks - radius)])

    def first_met(fp: np.ndarray, pairs: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The pairs for which table t is the first in which they share a bucket: every pair counts in one table only."""
        out = [pairs[:0]]
        for i in range(0, len(pairs), 1 << 16):
            some = pairs[i:i + (1 << 16)]
            equal = ((fp[some[:, 0]] ^ fp[some[:, 1]])[:, None] & spans) == 0
            equal &= np.cumsum(equal, 1, dtype=np.int8) <= blocks - radius
            out.append(some[(equal == chosen[t[some[:, 0]]]).all(1)])
        return np.concatenate(out)

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            column = batch.column("fps")
            values, at = column.flatten(), column.offsets.to_numpy()
            fp = (values.field("fp") if told else values).to_numpy().view(np.uint64)
            first, size = at[:-1].astype(np.int64) - at[0], np.diff(at).astype(np.int64)
            table = np.repeat(batch.column("t").to_numpy(), size)
            few, many = np.flatnonzero(size <= 64), np.flatnonzero(size > 64).tolist()
            pairs = side_by_side(fp, first[few], size[few], radius)
            if not told:
                pairs = first_met(fp, pairs, table)
                out = [fp[pairs[forest_of(len(fp), pairs)]]]
                for i in many:
                    some = fp[first[i]:first[i] + size[i]]
                    one = np.full(len(some), table[first[i]])
                    out.append(some[cluster(some, radius, lambda own, some=some, one=one: first_met(some, own, one))])
            else:
                part, n, name = (values.field(c).to_numpy() for c in ("part", "n", "t"))
                sketch = np.frombuffer(b"".join(values.field("sketch").to_pylist()), np.uint8).reshape(len(fp), -1)
                out = []
                for own, begin in [(pairs, 0), *[(None, i) for i in many]]:
                    if own is None:
                        i, begin = begin, first[begin]
                        some = fp[begin:begin + size[i]]
                        own = np.stack(within(planes_of(some), len(some), some, radius), 1) + begin
                        own = own[own[:, 0] < own[:, 1]]
                    own = own[part[own[:, 0]] != part[own[:, 1]]]
                    own = first_met(fp, own, table)
                    out.append(name[may_agree(sketch, n, own, similarity)])
            pairs = np.concatenate(out).reshape(-1, 2).view(np.int64)
            return pa.record_batch({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])}) if len(pairs) else None
        return apply

    return arrow_map(groups, make, "a long, b long")


def shingles_of(text: str | None, shingle: int) -> set[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))}


def with_sketch(texts: DataFrame, shingle: int) -> DataFrame:
    """texts(t, text) -> (t, n, sketch): how many different shingles, and how many in each of SKETCH bins (255: or more)."""
    def make():
        from xxhash import xxh64_intdigest as xxh

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, sketches = [], []
            for text in batch.column("text").to_pylist():
                own = shingles_of(text, shingle)
                bins = np.bincount(np.fromiter((xxh(x, 7) % SKETCH for x in own), np.int64, len(own)), minlength=SKETCH)
                sizes.append(len(own))
                sketches.append(np.minimum(bins, 255).astype(np.uint8).tobytes())
            return pa.record_batch({"t": batch.column("t"), "n": pa.array(sizes, pa.int64()), "sketch": pa.array(sketches, pa.binary())})
        return apply

    return arrow_map(texts.select("t", "text"), make, "t long, n long, sketch binary")


def alike(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of texts whose shingle sets agree to at least `similarity` (Jaccard); texts(t, text)."""
    both = pairs.join(shuffled(texts.select(F.col("t").alias("a"), F.col("text").alias("ta"))), "a").join(shuffled(texts.select(F.col("t").alias("b"), F.col("text").alias("tb"))), "b")

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True)):
                x, y = shingles_of(x, shingle), shingles_of(y, shingle)
                if len(x & y) >= similarity * len(x | y):
                    keep.append(i)
            return pa.record_batch({c: batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")}) if keep else None
        return apply

    return arrow_map(both.select("a", "b", "ta", "tb"), make, "a long, b long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def alike_links(nodes: DataFrame, rows: DataFrame, prints: list[str], radius: int, shingle: int, similarity: float) -> DataFrame:
    """nodes(prints..., t, rk), one for every different text -> (a, b): links of texts (t) that hold on the texts, with the same
    components as all pairs within the radius in one of the prints that are alike.

    First a spanning forest of the texts within the radius is checked.  A tree of which every link holds is one group,
    and any pair within the radius lies inside one tree; so only in trees with a link that failed there can be more,
    and of these all pairs within the radius are checked that are not in one group yet, and whose sketches let them be alike."""
    parts = []
    for fp in prints:
        hubs = materialize(nodes.groupBy(F.col(fp).alias("fp")).agg(F.min("t").alias("hub")))
        stars = nodes.join(shuffled(hubs), F.col(fp) == F.col("fp")).where("t <> hub").select(F.col("hub").alias("a"), F.col("t").alias("b"))
        far = _ordered(links(hubs.select("fp"), radius))
        for c in ("a", "b"):
            far = far.join(shuffled(hubs.select(F.col("fp").alias(c), F.col("hub").alias(f"t{c}"))), c)
        parts.append(materialize(stars.unionByName(far.select(F.col("ta").alias("a"), F.col("tb").alias("b"))), hubs))
    tried = materialize(_ordered(functools.reduce(DataFrame.unionByName, parts)), *parts)
    wanted = nodes.join(shuffled(tried.select(F.explode(F.array("a", "b")).alias("t")).distinct()), "t", "left_semi").select("rk", "t")
    texts = materialize(rows.select("rk", "text").join(shuffled(wanted), "rk").dropDuplicates(["t"]).select("t", "text"))
    held = materialize(alike(tried, texts, shingle, similarity))
    if held.count() == tried.count():
        return held
    ends = texts.select(F.col("t").alias("id"))
    trees, groups = (components(ends, x).select(F.col("id").alias("t"), F.col("component").alias(c)) for x, c in ((tried, "tree"), (held, "part")))
    at = materialize(nodes.select(*prints, "t").join(shuffled(trees), "t").join(shuffled(groups), "t"))
    split = at.groupBy("tree").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi")
    open_ = at.join(shuffled(split), "tree", "left_semi").select(*prints, "t", "part")
    open_ = materialize(open_.join(shuffled(with_sketch(texts.join(shuffled(open_.select("t")), "t", "left_semi"), shingle)), "t"), at)
    parts = [materialize(links(open_.select(F.col(fp).alias("fp"), "t", "part", "n", "sketch"), radius, similarity=similarity)) for fp in prints]
    more = _ordered(functools.reduce(DataFrame.unionByName, parts)).join(shuffled(tried), ["a", "b"], "left_anti")
    return materialize(held.unionByName(alike(more, texts, shingle, similarity)), held, tried, texts, open_, *parts)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, similarity: float | None = None, prints: int = 1) -> DataFrame:
    """(id, rk, fp or fp0..., component): one row for every row of docs; component is the smallest id of the group, rk names
    the row by its id and text.  With a similarity, candidates are the pairs within the radius in any of `prints` fingerprints, and
    links between different texts must also hold on the texts."""
    rows = docs.select(F.col(key).alias("id"), row_key(key, text).alias("rk"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    names = _names(prints)
    node, keep = ("fp", ("id", "rk")) if similarity is None else ("t", ("id", "rk", "t"))
    marked = materialize(with_fingerprint(rows, keep=keep, shingle=shingle, prints=prints))
    folded = materialize(marked.groupBy(*dict.fromkeys([*names, node])).agg(F.min("id").alias("least"), F.min("rk").alias("rk")))
    near = links(folded.select("fp"), radius) if similarity is None else alike_links(folded, rows, names, radius, shingle, similarity)
    groups = components(folded.select(F.col(node).alias("id")), near)
    own = materialize(folded.join(shuffled(groups), folded[node] == groups.id).select(node, "least", F.col("component").alias("group")))
    names_ = materialize(own.groupBy("group").agg(F.min("least").alias("component")))
    known = materialize(own.join(shuffled(names_), "group").select(node, "component"), own, folded)
    return marked.join(shuffled(known), node).select("id", "rk", *names, "component")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates the document of the smallest id stays, once; documents
    without any id in their group are not told apart by id and stay.

    The radius is wider than in op3's contract, and links are checked on the texts: five-word shingles agree to 0.8 or more."""
    first = near_duplicates(docs, radius=STAGE_RADIUS, shingle=STAGE_SHINGLE, similarity=STAGE_SIMILARITY, prints=STAGE_PRINTS).where("id = component or component is null").select("rk").distinct()
    return unkeyed(keyed(docs, "doc_id", "text").join(shuffled(first), "rk", "left_semi").dropDuplicates(["rk"]), docs.columns)
