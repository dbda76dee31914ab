"""Exact top-k inner products by a pivot-distance index.

Components become floor(256 * x). Every distinct vector is keyed by its nearest pivot and its distance to it; sorted by
that key, vectors are cut into blocks, and neighbouring blocks of one pivot form an annulus. A query at distance d from a pivot is at
least max(d - hi, lo - d) from every vector of an annulus (lo, hi), and since 2 q.v = |q|^2 + |v|^2 - |q - v|^2, that bounds
its scores there. Annuli are expanded by descending bound, in a few widening steps, and a query stops where the bound
falls below its k-th best score. Bounds carry a slack far above rounding; scores are integers, so the result is exact.

Hot vectors: equal vectors are one entry with their k + 1 smallest ids, which suffices as a query leaves out only its own; equal
queries are searched once. Only pivots and annulus limits, both of bounded number, come from a bounded sample
(SAMPLE vectors by hash order) and pass the driver; every vector is indexed.

Vectors that are null or hold null or non-finite components, and rows without id, take no part. Shorter vectors count as
filled up with zeros, an empty one scores 0. Rows equal in id and vector are one; an id with several vectors is several
queries, and all rows with a query's id are its own. Fewer than k candidates: all are returned; an empty table: no rows.
Scores are 64-bit integers: vectors with a component of 2^62 or more take no part, and products must stay in that range. Other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadwatch.operators.lookup import look_up
from roadwatch.session import stored

SCALE = 256
#: vectors whose positions set the pivots and the limits between annuli
SAMPLE = 8192
#: vectors of a block, and queries that meet it at once
BLOCK = 1024
MAX_PIVOTS, MAX_ANNULI = 64, 4096
#: annuli that a query expands in each step; the last step takes all that its bound allows
STEPS = (1, 4, None)


# -------------------------------------------------------------------- vectors
def _quantise(batches):
    for batch in batches:
        column = batch.column(1)
        ids, lists = batch.column(0), column.to_pylist()
        out: list[bytes | None] = []
        for row in lists:
            x = None if row is None or None in row else np.floor(SCALE * np.array(row, np.float64))
            out.append(None if x is None or not np.isfinite(x).all() or (np.abs(x) >= 2.0 ** 62).any() else _encode(x.astype(np.int64)))
        yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary())], names=["vec_id", "v"])


def _encode(x: np.ndarray) -> bytes:
    """Components in the narrowest of 2, 4 or 8 bytes, after one byte that names the width: equal vectors, equal bytes."""
    top = int(np.abs(x).max(initial=0))
    width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def _matrix(vectors: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, v in enumerate(vectors):
        kinds.setdefault((v[0], len(v)), []).append(i)
    for (width, size), rows in kinds.items():
        flat = np.frombuffer(b"".join([vectors[i][1:] for i in rows]), f"<i{width}")
        out[rows, :(size - 1) // width] = flat.reshape(len(rows), -1)
    return out


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where no sum can leave their integers."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if top < 2.0 ** 52:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x = v.astype(np.float64)
    return np.sqrt(np.stack([((x - p) ** 2).sum(1) for p in pivots], 1)) if len(x) else np.zeros((0, len(pivots)))


def quantised(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): usable rows, once per id and vector; v holds the integer components."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).alias("v")).where("vec_id is not null and v is not null")
    return rows.mapInArrow(_quantise, "vec_id long, v binary").where("v is not null").distinct()


# ---------------------------------------------------------------------- index
class Layout:
    """Pivots and the limits between annuli: what places a vector in the index."""

    def __init__(self, sample: np.ndarray, rows: int):
        points = sample.astype(np.float64)
        count = max(1, min(MAX_PIVOTS, rows // (4 * BLOCK) + 4, len(points)))
        self.dims = sample.shape[1]
        chosen = [points[0]]
        far = ((points - chosen[0]) ** 2).sum(1)
        while len(chosen) < count:
            chosen.append(points[int(far.argmax())])
            far = np.minimum(far, ((points - chosen[-1]) ** 2).sum(1))
        self.pivots = np.stack(chosen)
        for _ in range(5):      # towards the middle of what is nearest
            near = _distances(points, self.pivots).argmin(1)
            self.pivots = np.stack([points[near == p].mean(0) if (near == p).any() else self.pivots[p] for p in range(count)])
        reach = _distances(points, self.pivots)
        near = reach.argmin(1)
        wanted = max(count, min(MAX_ANNULI, rows // BLOCK))
        self.cuts, self.first, total = [], [], 0
        for p in range(count):
            own = np.sort(reach[near == p, p])
            parts = max(1, round(wanted * own.size / len(points)))
            cuts = np.unique(own[[own.size * i // parts for i in range(1, parts)]]) if own.size >= parts > 1 else np.zeros(0)
            self.first.append(total)
            self.cuts.append(cuts)
            total += cuts.size + 1
        self.pivot_of = np.repeat(np.arange(count), [c.size + 1 for c in self.cuts])

    def place(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(annulus, distance to its pivot) of each vector."""
        reach = _distances(v, self.pivots)
        near = reach.argmin(1)
        dist = reach[np.arange(len(v)), near]
        ring = np.array([self.first[p] + int(np.searchsorted(self.cuts[p], d, "right")) for p, d in zip(near, dist)], np.int64)
        return ring, dist


def _placed(layout: Layout):
    def run(batches):
        for batch in batches:
            v = _matrix(batch.column(0).to_pylist(), layout.dims)
            ring, dist = layout.place(v)
            norm = (v.astype(np.float64) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(ring), pa.array(dist), pa.array(norm), batch.column(0), batch.column(1)],
                                             names=["ring", "dist", "norm", "v", "ids"])
    return run


_BLOCK_SCHEMA = "ring long, lo double, hi double, norm double, n long, vs array<binary>, ids array<array<long>>"


def _blocks(batches):
    """Rows sorted by annulus and distance, cut into blocks."""
    held: list[tuple] = []

    def block():
        ring, dist, norm, vs, ids = zip(*held)
        return pa.RecordBatch.from_arrays(
            [pa.array([ring[0]]), pa.array([min(dist)]), pa.array([max(dist)]), pa.array([max(norm)]), pa.array([len(vs)]),
             pa.array([list(vs)], pa.list_(pa.binary())), pa.array([list(ids)], pa.list_(pa.list_(pa.int64())))],
            names=["ring", "lo", "hi", "norm", "n", "vs", "ids"])

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and (held[0][0] != row[0] or len(held) == BLOCK):
                yield block()
                held = []
            held.append(row)
    if held:
        yield block()


class Index:
    """Blocks of distinct vectors in the shared folder, and the limits of each annulus."""

    def __init__(self, rows: DataFrame, k: int):
        spread = Window.partitionBy("v").orderBy("vec_id")
        few = rows.withColumn("place", F.row_number().over(spread)).where(F.col("place") <= k + 1)
        entries = stored(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
        size = entries.agg(F.count("*"), F.max(F.floor((F.length("v") - 1) / 2))).first()    # two bytes a component at least
        self.rows, self.k = size[0], k
        if not self.rows:
            return
        sample = [r.v for r in entries.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()]
        self.layout = Layout(_matrix([bytes(v) for v in sample], int(size[1] or 0)), self.rows)
        placed = entries.mapInArrow(_placed(self.layout), "ring long, dist double, norm double, v binary, ids array<long>")
        ordered = placed.repartitionByRange("ring", "dist", "v").sortWithinPartitions("ring", "dist", "v")
        self.blocks = stored(ordered.mapInArrow(_blocks, _BLOCK_SCHEMA), "blocks")
        limits = self.blocks.groupBy("ring").agg(F.min("lo"), F.max("hi"), F.max("norm")).collect()   # MAX_ANNULI or so
        self.limits = np.array(sorted(map(tuple, limits)), np.float64)


def _bound(norm_q, norm_v, reach, lo, hi) -> np.ndarray:
    gap = np.maximum(np.maximum(reach - hi, lo - reach), 0.0)
    size = norm_q + norm_v
    return (size - gap * gap * (1 - 1e-9)) / 2 + size * 1e-9 + 1e-3


# --------------------------------------------------------------------- search
def _planned(layout: Layout, limits: np.ndarray, start: int, stop: int | None):
    """The annuli that each query expands in this step."""
    ring = limits[:, 0].astype(np.int64)
    pivot, lo, hi, norm = layout.pivot_of[ring], limits[:, 1], limits[:, 2], limits[:, 3]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                q = _matrix(batch.column(0).to_pylist(), layout.dims)
                floor = np.array([-np.inf if f is None else f for f in batch.column(1).to_pylist()])
                reach = _distances(q, layout.pivots)[:, pivot]
                bound = _bound((q.astype(np.float64) ** 2).sum(1)[:, None], norm, reach, lo, hi)
                order = np.argsort(-bound, axis=1, kind="stable")[:, start:stop]
                rows = np.repeat(np.arange(len(q)), order.shape[1])
                cols = order.ravel()
                keep = bound[rows, cols] >= floor[rows]
                rows, cols = rows[keep], cols[keep]
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ring[cols]), taken.column(0), pa.array(reach[rows, cols]), taken.column(1)], names=["ring", "v", "reach", "floor"])
    return run


def _scored(dims: int, most: int):
    """(v, score, vec_id): the best of each query in one block."""
    def run(batches):
        for whole in batches:
            for at in range(whole.num_rows):
                lo, hi, norm, vs, ids, asked = (c[0].as_py() for c in whole.slice(at, 1).columns)
                names = [a["v"] for a in asked]
                q, v = _matrix(names, dims), _matrix(vs, dims)
                reach = np.array([a["reach"] for a in asked])
                floor = np.array([-np.inf if a["floor"] is None else a["floor"] for a in asked])
                needed = np.flatnonzero(_bound((q.astype(np.float64) ** 2).sum(1), norm, reach, lo, hi) >= floor)
                if not needed.size:
                    continue
                scores = _products(q[needed], v)
                cut = np.partition(scores, max(0, len(vs) - most), axis=1)[:, max(0, len(vs) - most)] if len(vs) > most else scores.min(1)
                cut = np.maximum(cut, floor[needed])
                smallest = np.array([i[0] for i in ids])
                out: tuple[list, list, list] = ([], [], [])
                for row in np.flatnonzero(scores.max(1) >= cut).tolist():
                    own = scores[row]
                    found = np.flatnonzero(own >= cut[row])
                    found = found[np.lexsort((smallest[found], -own[found]))][:most].tolist()
                    best = sorted((-int(own[c]), i) for c in found for i in ids[c])[:most]
                    out[0].extend([names[needed[row]]] * len(best))
                    out[1].extend(-s for s, _ in best)
                    out[2].extend(i for _, i in best)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["v", "score", "vec_id"])
    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("v").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def search(index: Index, queries: DataFrame) -> DataFrame:
    """(v, place, vec_id, score): the k + 1 best entries for each distinct vector of ``queries`` (v)."""
    most = index.k + 1
    asked = stored(queries.select("v").distinct(), "asked")
    chunks = max(1, math.ceil(asked.count() / BLOCK))
    best, start = None, 0
    for width in STEPS:
        if best is None:
            state = asked.withColumn("floor", F.lit(None).cast("long"))
        else:
            state = asked.join(best.where(F.col("place") == most).select("v", F.col("score").alias("floor")), "v", "left")
        stop = None if width is None else start + width
        plan = state.mapInArrow(_planned(index.layout, index.limits, start, stop), "ring long, v binary, reach double, floor long")
        groups = plan.groupBy("ring", F.pmod(F.xxhash64("v"), F.lit(chunks)).alias("chunk")).agg(
            F.collect_list(F.struct("v", "reach", "floor")).alias("asked"))
        pairs = index.blocks.join(groups, "ring").select("lo", "hi", "norm", "vs", "ids", "asked")
        found = pairs.mapInArrow(_scored(index.layout.dims, most), "v binary, score long, vec_id long")
        if best is not None:
            found = best.drop("place").unionByName(found)
        best, start = stored(_top(found, most), "best"), stop
    return best


def top_k(vectors: DataFrame, wanted: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for every usable row that ``wanted`` (on vec_id) holds for, the k best other rows."""
    rows = stored(quantised(vectors), "quantised")
    index = Index(rows, k)
    queries = rows.where(wanted)
    if not index.rows:
        return queries.selectExpr("vec_id as query_id", "1 as rank", "vec_id", "vec_id as score").limit(0)
    best = search(index, queries).groupBy("v").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i")))).alias("best"))
    met = look_up(queries, best, ["v"], "inner")
    others = F.slice(F.filter("best", lambda b: b["i"] != F.col("vec_id")), 1, k)
    each = met.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "b"))
    return each.select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.i").alias("vec_id"), (-F.col("b.s")).alias("score"))


def oracle(k: int = 5, every: int = 50) -> str:
    return f"""
WITH q AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= {k}"""
