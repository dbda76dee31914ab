"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into as few segments as leave one of them with at most one
differing bit (four bits: three segments). Every segment is indexed once per bit with that bit wiped out;
two fingerprints within the distance meet in at least one such key, and are then verified on all 64 bits.

Null or empty texts have fingerprint zero and are linked like any other; a null doc_id keeps its row and is never
the smallest id unless its component has no other. Repeated rows share a fingerprint. Empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadwatch.llm.common import free_name, id_field, keyed, map_texts, texts
from roadwatch.llm.components import components
from roadwatch.session import stored

SEED = 42
#: a key met by more fingerprints is cut further by equal blocks instead of being solved in one task
MAX_RUN = 200_000
#: runs up to this size are compared by lag, longer ones by frontier
SHORT_RUN = 8
_PIECE = 1 << 16


def fingerprint(text: str | None, width: int = 4) -> int:
    """Bits set in over half of the shingles' XXH64, as an unsigned integer."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    n = len(words)
    if n <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    first, last = (ends - sizes)[: n - width + 1].tolist(), ends[width - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last)], dtype=">u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _PIECE):
        counts += np.unpackbits(hashes[i:i + _PIECE].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, keys: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; columns ``keys`` of ``keyed`` come along."""
    def run(rows):
        fps = np.array([fingerprint(t, width) for t in rows["text"]], np.uint64)
        return {**rows, "fp": fps.view(np.int64)}

    fields = [T.StructField(k, T.LongType()) for k in (*keys, "fp")]
    rows = keyed(docs).select("doc_id", "text", *keys) if keys else texts(docs)
    return map_texts(rows, run, T.StructType([id_field(docs), *fields]))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def masks(distance: int) -> list[int]:
    """One mask per segment and wiped bit; two values within the distance agree under at least one of them."""
    parts = distance // 2 + 1
    cuts = [64 * i // parts for i in range(parts + 1)]
    segments = [range(a, b) for a, b in zip(cuts, cuts[1:])]
    return [sum(1 << b for b in seg if b != wiped) for seg in segments for wiped in seg]


def blocks(distance: int, level: int) -> list[int]:
    """distance + 1 bit sets that cover 64 bits, other ones at each level: one of them is equal within the distance."""
    k, step = distance + 1, (1, 5, 11)[level % 3]
    order = [(i * step) % 64 for i in range(64)]
    return [sum(1 << b for b in order[64 * i // k:64 * (i + 1) // k]) for i in range(k)]


def _near(values: np.ndarray, pivot: np.uint64, distance: int) -> np.ndarray:
    return np.bitwise_count(values ^ pivot) <= distance


def spanning(values: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever is connected among distinct values: at most one per value."""
    links, todo = [], values
    while todo.size > 1:
        frontier, todo = [todo[0]], todo[1:]
        while frontier and todo.size:
            pivot = frontier.pop()
            near = _near(todo, pivot, distance)
            if near.any():
                hits = todo[near]
                links.append((np.full(hits.size, pivot), hits))
                frontier.extend(hits)
                todo = todo[~near]
    return links


def _short_runs(keys: np.ndarray, values: np.ndarray, long_run: np.ndarray, distance: int):
    for lag in range(1, SHORT_RUN):
        if keys.size <= lag:
            return
        at = np.flatnonzero((keys[:-lag] == keys[lag:]) & ~long_run[:-lag])
        if not at.size:
            return
        at = at[np.bitwise_count(values[at] ^ values[at + lag]) <= distance]
        yield values[at], values[at + lag]


def _link_pass(distance: int, last: bool):
    """Rows sorted by key become links (kind 0), or, for a run beyond MAX_RUN, the run's rows as they are (kind 1)."""
    def emit(pairs):
        if pairs:
            a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            a, b = both[:, 0].copy(), both[:, 1].copy()
            if a.size:
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(a.size, np.int8)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["kind", "a", "b"])

    def rows(keys, values):
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(keys.size, np.int8)), pa.array(keys), pa.array(values.view(np.int64))], names=["kind", "a", "b"])

    def solve(keys, values):
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, keys.size))
        pairs = list(_short_runs(keys, values, np.repeat(sizes > SHORT_RUN, sizes), distance))
        for s, n in zip(starts[sizes > SHORT_RUN], sizes[sizes > SHORT_RUN]):
            pairs += spanning(values[s:s + n], distance)
        return emit(pairs)

    def run(batches):
        keys, values, heavy = np.empty(0, np.int64), np.empty(0, np.uint64), None
        for batch in batches:
            k, v = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if heavy is not None:
                n = int(np.searchsorted(k, heavy, "right"))
                if n:
                    yield from rows(k[:n], v[:n])
                k, v = k[n:], v[n:]
                if not k.size:
                    continue
                heavy = None
            if not k.size:
                continue
            keys, values = np.concatenate([keys, k]), np.concatenate([values, v])
            done = int(np.searchsorted(keys, keys[-1], "left"))   # the last run may go on
            if done:
                yield from solve(keys[:done], values[:done])
                keys, values = keys[done:], values[done:]
            if keys.size > MAX_RUN and not last:
                yield from rows(keys, values)
                heavy, keys, values = keys[-1], keys[:0], values[:0]
        if keys.size:
            yield from solve(keys, values)

    return run


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` within the distance: enough to connect all that are connected."""
    variants = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks(distance))]))
    keyed = fps.select(variants.alias("key"), "fp")
    found = None
    for level in range(4):
        out = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_link_pass(distance, level == 3), "kind byte, a long, b long")
        out = stored(out, "simhash-links")
        pairs = out.where("kind = 0").select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        heavy = out.where("kind = 1")
        if heavy.isEmpty():
            break
        cut = F.explode(F.array(*[F.xxhash64(F.col("a"), F.lit(i), F.col("b").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(blocks(distance, level))]))
        keyed = heavy.select(cut.alias("key"), F.col("b").alias("fp"))
    return found.distinct()


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id): 16 hex digits, and the smallest doc_id reachable over links."""
    fps = stored(fingerprints(docs, width), "simhash")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(classes.select("fp"), distance)).withColumnRenamed("node", "fp")
    known = roots.join(classes, "fp")
    lowest = known.groupBy("root").agg(F.min("first").alias("low"))
    reach = known.join(lowest, "root").select("fp", "low")
    classes = classes.join(reach, "fp", "left").select("fp", F.coalesce("low", "first").alias("component_id"))
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """The document with the smallest (doc_id, text hash) of each component, null ids last, all columns; rows that repeat
    its id and text are one row."""
    fps = stored(fingerprints(docs, width, ("rk", "tk")), "simhash")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk", "rk")
    classes = fps.groupBy("fp").agg(F.min(order).alias("first"))
    roots = components(links(classes.select("fp"), distance)).withColumnRenamed("node", "fp")
    kept = classes.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("of")).agg(F.min("first").alias("first"))
    rk, tk = (free_name(docs, c) for c in ("_rk", "_tk"))
    kept = kept.select(F.col("first.rk").alias(rk), F.col("first.tk").alias(tk))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.withColumns({rk: F.xxhash64(F.col("doc_id"), text), tk: F.xxhash64(text)})
    return named.join(kept, [rk, tk], "left_semi").dropDuplicates([rk, tk]).select(*docs.columns)
