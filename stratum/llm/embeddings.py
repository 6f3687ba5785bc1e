"""Operator 4: embedding near-duplicates by int8 quantised tile products.

Equal vectors are folded into classes first.  Every class is quantised to int8 with its own scale and the norm
of its own rounding error; the products of codes in a tile are exact integers, and scaled they give a rigorous upper bound of
every cosine: |x.y - xq.yq| <= |ex| * |yq| + |ey| for unit x, y.  Only pairs whose bound reaches the threshold are computed
again, pair by pair in double precision, and only those decide.

Tiles are cells around pivots (vectors of a bounded sample; they steer work, never results): a class is
sent to a cell only if the triangle inequality of angles lets it reach a member of that cell, and a
large cell is dealt out over several tiles, which are bounded in rows and bytes.  A tile pair returns counts and a spanning forest, not pairs.

Defined results: a vector that is null, empty, zero, or has null or non-finite components links with nothing,
and so does a row with a null id; vectors of different length never link; repeated ids with one vector
count as rows of that class; a repeated id with different vectors is one node with the links of all of them;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.common import arrow_map, components, forget, materialize, ship, table

THRESHOLD, MIN_TILE, MAX_TILE, TILE_BYTES, MAX_PIVOTS = 0.95, 1024, 16384, 32 << 20, 4096
_STRIP, _PAIRS = 256, 1 << 16
_EXACT = (1 << 24) // 127**2  # so many products of codes add up exactly in float32


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and upper bounds of the norms of the rounding errors, of unit rows."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    error = x - codes * scale[:, None]
    return codes, scale, np.sqrt((error * error).sum(1)) * (1 + 1e-9)


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows of a with columns of b, int8 codes held as float32, exact: float32 holds the sums of _EXACT dimensions at a time (and
    has the faster product)."""
    out = a[:, :_EXACT] @ b[:_EXACT]
    if a.shape[1] > _EXACT:
        out = out.astype(np.float64)
        for d in range(_EXACT, a.shape[1], _EXACT):
            out += a[:, d:d + _EXACT] @ b[d:d + _EXACT]
    return out


def tile_links(a: np.ndarray, b: np.ndarray | None, na: np.ndarray, nb: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(weighted link counts, labels) of the rows of a, then of b; b None: the pairs within a.
    A label is the least row index that a row is connected to within this pair of tiles."""
    one = b is None
    xa, xb = unit(a), unit(a if one else b)
    wb, off = (na, 0) if one else (nb, len(a))
    qa, sa, ea = quantise(xa)
    qb, sb, eb = (qa, sa, ea) if one else quantise(xb)
    # bound = product * sa * sb + ea + eb * (1 + ea); first with the largest eb, in float32 with a slack over its rounding, then by itself
    left, right, scale = qa.astype(np.float32), np.ascontiguousarray(qb.astype(np.float32).T), sb.astype(np.float32)
    least = ((threshold - 1e-5 - ea - eb.max() * (1 + ea)) / sa).astype(np.float32)
    counts, labels = np.zeros(len(a) + (0 if one else len(b)), np.int64), np.arange(len(a) + (0 if one else len(b)))
    for s in range(0, len(a), _STRIP):
        begin = s if one else 0
        bound = code_products(left[s:s + _STRIP], right[:, begin:])
        bound *= scale[begin:]
        i, j = np.nonzero(bound >= least[s:s + _STRIP, None])
        if one:
            i, j = i[j > i], j[j > i]
        near = bound[i, j].astype(np.float64) * sa[s + i] + ea[s + i] + eb[begin + j] * (1 + ea[s + i]) >= threshold - 1e-5
        i, j = i[near], j[near]
        if not len(i):
            continue
        sure = np.zeros(bound.shape, bool)
        for p in range(0, len(i), _PAIRS):
            x, y = i[p:p + _PAIRS], j[p:p + _PAIRS]
            sure[x, y] = np.einsum("ij,ij->i", xa[s + x], xb[begin + y]) >= threshold
        rows = np.flatnonzero(sure.any(1))
        if not len(rows):
            continue
        counts[s + rows] += sure[rows] @ wb[begin:]
        counts[off + begin:off + len(xb)] += na[s:s + _STRIP] @ sure
        for r in rows:
            ends = np.append(off + begin + np.flatnonzero(sure[r]), s + r)
            held = labels[ends]
            if (low := held.min()) != held.max():
                labels[np.isin(labels, np.unique(held))] = low
    return counts, labels


def _compare(threshold: float, kind: str):
    def run(key, t):
        i, j = (k.as_py() for k in key)
        t = t.sort_by([("home", "ascending"), ("id", "ascending")])
        home, ids, n = (t.column(c).to_numpy() for c in ("home", "id", "n"))
        v = np.vstack([np.frombuffer(x, kind) for x in t.column("v").to_pylist()])
        cut = len(home) if i == j else int(np.searchsorted(home, j))
        if i != j and cut in (0, len(home)):
            return pa.table({"id": ids[:0], "links": ids[:0], "to": ids[:0]})
        counts, labels = tile_links(v[:cut], None if i == j else v[cut:], n[:cut], None if i == j else n[cut:], threshold)
        on = np.flatnonzero(counts)
        return pa.table({"id": ids[on], "links": counts[on], "to": ids[labels[on]]})

    return run


def near_pairs(classes: DataFrame, dims: int, threshold: float = THRESHOLD) -> DataFrame:
    """classes(id, n, v array<float or double>), all of one length -> (id, links, to), to be summed by id: the links of id to other
    classes, weighted by their n, and a connected class for each tile pair."""
    spark = classes.sparkSession
    kind = "float32" if classes.schema["v"].dataType.elementType.simpleString() == "float" else "float64"
    total = classes.count()
    tile = int(min(max(total / 12, MIN_TILE), MAX_TILE, max(64, TILE_BYTES // (8 * dims))))
    pivots = min(max(1, -(-total // tile)), MAX_PIVOTS)
    chosen = unit(np.array([r["v"] for r in classes.select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(pivots).collect()]))
    shared, reach = spark.sparkContext.broadcast(chosen), float(np.arccos(threshold))

    def angles(x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(unit(x) @ shared.value.T, -1, 1))

    def locate():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            far = angles(x)
            cell = far.argmin(1)
            return pa.record_batch({"id": batch.column("id"), "n": batch.column("n"), "v": pa.array([r.tobytes() for r in x], pa.binary()),
                                    "cell": pa.array(cell.astype(np.int32)), "angle": pa.array(far[np.arange(len(cell)), cell])})
        return apply

    placed = materialize(arrow_map(classes.select("id", "n", "v"), locate, "id long, n long, v binary, cell int, angle double"))
    many, limit = np.zeros(pivots, np.int64), np.full(pivots, -1.0)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("far")).collect():  # at most `pivots` rows
        many[r["cell"]], limit[r["cell"]] = -(-r["n"] // tile), r["far"] + reach + 1e-6
    first = np.cumsum(many) - many
    plan = spark.sparkContext.broadcast((many, first, limit))

    def send():
        many, first, limit = plan.value

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            """Home tile and the tiles that a class must be compared with."""
            x = np.vstack([np.frombuffer(r, kind) for r in batch.column("v").to_pylist()])
            cell, h = batch.column("cell").to_numpy(), batch.column("h").to_numpy()
            row, to = np.nonzero(angles(x) <= limit)
            count = many[to]
            tiles = np.repeat(first[to] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            ends = np.append(0, np.cumsum(np.bincount(row, count, len(x)).astype(np.int64)))
            return pa.record_batch({"id": batch.column("id"), "n": batch.column("n"), "v": batch.column("v"), "home": pa.array((first[cell] + h % many[cell]).astype(np.int32)),
                                    "tiles": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tiles.astype(np.int32)))})
        return apply

    sent = arrow_map(placed.select("id", "n", "v", "cell", F.xxhash64("id").alias("h")), send, "id long, n long, v binary, home int, tiles array<int>")
    sent = sent.select("id", "n", "v", "home", F.explode("tiles").alias("t")).select("id", "n", "v", "home", F.least("home", "t").alias("i"), F.greatest("home", "t").alias("j"))
    ship(spark)
    return sent.groupBy("i", "j").applyInArrow(_compare(threshold, kind), "id long, links long, to long")


def link_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """id, n_links, component: one row for every row of `rows`."""
    kind = "array<float>" if rows.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"))
    usable = F.coalesce(F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    usable_rows = rows.where(usable)
    classes = materialize(usable_rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    found = None
    for dims in sorted(r[0] for r in classes.select(F.size("v")).distinct().collect()):
        some = near_pairs(classes.where(F.size("v") == dims), dims, threshold)
        found = some if found is None else found.unionByName(some)
    if found is None:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    found = materialize(found)
    groups = materialize(components(classes.select("id").distinct(), found.select(F.col("id").alias("a"), F.col("to").alias("b"))))
    named = materialize(classes.join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left").join(groups, "id")
                        .select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component"))
    forget(found)
    marked = materialize(usable_rows)
    rest = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return marked.join(named, "v").select("id", "n_links", "component").unionByName(rest)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link_vectors(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


OP4_SQL = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding::double[], lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding::double[], lambda x: x <> 0)) > 0),
u as (select vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) as e, len(e) as d from v),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and a.d = b.d and list_dot_product(a.e, b.e) >= 0.95),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a)
select m.vec_id, (select count(*) from l where l.a = m.vec_id) as n_links,
       least(m.vec_id, coalesce((select min(b) from r where r.a = m.vec_id), m.vec_id)) as component_id,
       m.vec_id = least(m.vec_id, coalesce((select min(b) from r where r.a = m.vec_id), m.vec_id)) as kept
from embeddings m"""
