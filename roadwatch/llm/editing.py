"""Document fingerprints by randomised edit embedding.

All texts walk over their characters with the same random bits: at each step the walk notes the character under its
pointer, and a random bit of (step, class of the character) decides whether the pointer moves on. Texts at a small edit distance fall
back into step, so their notes differ at few steps. The fingerprint samples steps: each of SLOTS slots keeps four bits
of the note at the step with the smallest priority so far, which every text draws alike whatever its length. The share of
equal slots estimates how many steps two walks have in common.

Fingerprints are hexadecimal digits, ``-`` in every slot for an empty text (null counts as empty). Equal texts have equal
fingerprints. Order is by (doc_id, text hash), null ids first; repeated rows follow each other. Extra columns
are not read; an empty table gives an empty result, a single document is its own successor.
"""

from __future__ import annotations

import json
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadwatch.llm.common import id_field, keyed, slices
from roadwatch.llm.components import components
from roadwatch.session import stored

SLOTS = 128
SEED = 7
#: documents of one bucket of the order, and most buckets (rows of the broadcast table of their first documents)
BUCKET_ROWS, MAX_BUCKETS = 1_000, 20_000
#: sampled keys for each limit between buckets
OVER = 16
#: characters embedded at once
CHARS = 6 << 20
_BLOCK, _END, _CLASSES = 256, 64, 65
_FEW = 12
_STEPS = 1 << 36
#: fingerprints compared with one other at once
_PIECE = 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(2048)
def _moves(block: int) -> np.ndarray:
    """Shared random bits of _BLOCK steps: a row of 65 moves per step, the last for the end of a text."""
    steps = np.arange(block * _BLOCK, (block + 1) * _BLOCK, dtype=np.uint64)
    words = _mix(_mix(steps + np.uint64(SEED << 40)))
    out = np.zeros((_BLOCK, _CLASSES), np.uint8)
    out[:, :_END] = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1)
    return out


@lru_cache(1)
def _schedule() -> tuple[list[int], list[np.ndarray]]:
    """Steps at which some slot takes a new note, and those slots: the record times of independent random priorities."""
    at: dict[int, list[int]] = {}
    for slot in range(SLOTS):
        step = 1
        draws = _mix(_mix(np.arange(256, dtype=np.uint64) + np.uint64((SEED << 48) + (slot << 16)))).tolist()
        for u in draws:
            at.setdefault(step - 1, []).append(slot)
            step = int(step / ((u + 1) / 2.0**64)) + 1
            if step > _STEPS:
                break
    steps = sorted(at)
    return steps, [np.array(at[s]) for s in steps]


@lru_cache(1)
def _notes() -> np.ndarray:
    """Four bits per slot and class of character."""
    cells = np.arange(SLOTS * _CLASSES, dtype=np.uint64) + np.uint64(SEED << 32)
    return (_mix(cells) & np.uint64(15)).astype(np.uint8).reshape(SLOTS, _CLASSES)


def classes(text: str) -> np.ndarray:
    """One of 64 classes per code point."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((codes * np.uint32(0x9E3779B1)) >> np.uint32(26)).astype(np.uint8)


def embed(parts: list[np.ndarray]) -> np.ndarray:
    """The sampled notes of every sequence of classes: one row of SLOTS values, 255 where there is none."""
    out = np.full((len(parts), SLOTS), 255, np.uint8)
    sizes = np.array([p.size for p in parts], np.int64)
    end = np.array([_END], np.uint8)
    buffer = np.concatenate([x for p in parts for x in (p, end)] or [end])
    ends = np.cumsum(sizes + 1) - 1
    rows, at = np.flatnonzero(sizes), (ends - sizes)[sizes > 0]
    steps, slots = _schedule()
    notes, due, step = _notes(), 0, 0
    while rows.size > _FEW:
        moves = _moves(step // _BLOCK)
        for move in moves:
            seen = buffer[at]
            if steps[due] == step:
                live = np.flatnonzero(seen != _END)
                own = slots[due]
                out[rows[live][:, None], own[None, :]] = notes[own][:, seen[live]].T
                due += 1
            at = at + move[seen]
            step += 1
        live = buffer[at] != _END
        rows, at = rows[live], at[live]
    for row, pointer in zip(rows.tolist(), at.tolist()):
        _finish(buffer[pointer:ends[row] + 1].tobytes(), step, due, out[row])
    return out


def _finish(data: bytes, step: int, due: int, out: np.ndarray) -> None:
    """The rest of one walk, where too few are left to share an array operation."""
    steps, slots = _schedule()
    notes, i = _notes(), 0
    while True:
        block = step // _BLOCK
        flat, base = _moves(block).tobytes(), (step % _BLOCK) * _CLASSES
        stop = (block + 1) * _BLOCK
        while step < stop:
            upto = min(stop, steps[due])
            while step < upto:
                c = data[i]
                if c == _END:
                    return
                i += flat[base + c]
                base += _CLASSES
                step += 1
            if step < stop:   # a scheduled step
                c = data[i]
                if c == _END:
                    return
                out[slots[due]] = notes[slots[due], c]
                due += 1
                i += flat[base + c]
                base += _CLASSES
                step += 1


_DIGITS = np.frombuffer(b"0123456789abcdef" + b"-" * 240, np.uint8)


def _strings(prints: np.ndarray) -> list[str]:
    return [row.tobytes().decode() for row in _DIGITS[prints]]


def _place(limits, key, count: int):
    """How many of ``count`` ascending limits are at most the key, by halving."""
    halves = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, count.bit_length())))])
    return F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.get(limits, at + half - 1) <= key, at + half).otherwise(at))


def _bucketed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rk, tk, bucket): buckets of about BUCKET_ROWS rows in the order of (doc_id, text hash, row hash), nulls first.

    Limits are every OVER-th key of a hash sample, so clustered, null and equal ids of any type fill buckets evenly; only rows equal
    in id and text stay together.
    """
    rows = keyed(docs)
    count = max(1, min(MAX_BUCKETS, rows.count() // BUCKET_ROWS)) - 1
    if not count:
        return rows.withColumn("bucket", F.lit(0))
    key = F.struct("doc_id", "tk", "rk")
    sample = rows.select(key.alias("key")).orderBy(F.xxhash64("key"), "key").limit((count + 1) * OVER - 1)
    nth = F.row_number().over(Window.orderBy("key"))      # a bounded sample
    found = sample.withColumn("n", nth).where(F.col("n") % OVER == 0).orderBy("n").select("key.*").collect()      # MAX_BUCKETS at most
    kind = docs.schema["doc_id"].dataType.simpleString()
    # one literal: as many expressions as limits would be a plan too large to compile
    limits = F.from_json(F.lit(json.dumps([r.asDict() for r in found])), f"array<struct<doc_id:{kind},tk:bigint,rk:bigint>>")
    return rows.withColumn("bucket", _place(limits, key, len(found)))


def _order(docs: DataFrame) -> DataFrame:
    """Rows of all documents by bucket, each bucket followed by a copy of the first document of the next one (tail = 1)."""
    rows = _bucketed(docs)
    heads = rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "tk", "rk")).alias("head"))
    every = Window.orderBy("bucket")   # one row per bucket, MAX_BUCKETS at most
    heads = heads.select("head.tk", "head.rk", "bucket", F.lag("bucket").over(every).alias("before"), F.max("bucket").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"))
    heads = heads.select("tk", "rk", "bucket", F.coalesce("before", "last").alias("before"))
    both = rows.join(F.broadcast(heads), ["tk", "rk", "bucket"], "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("tail"))
    copy = F.struct(F.col("before").alias("bucket"), F.lit(1).alias("tail"))
    target = F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, copy)))
    both = both.select("doc_id", "text", "tk", "rk", target.alias("t")).select("doc_id", "text", "tk", "rk", "t.bucket", "t.tail")
    return both.repartition("bucket").sortWithinPartitions("bucket", "tail", "doc_id", "tk", "rk").select("doc_id", "text", "bucket", "tail")


def _edit(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and their likeness with it and with the next document."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = [("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()),
              ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())]
    schema = T.StructType([id_field(docs), *(T.StructField(c, t) for c, t in fields)])
    target = to_arrow_schema(schema)

    def solve(rows):
        """Rows (doc_id, text, bucket, tail) in order; each document's next one follows it."""
        at = [i for i in range(len(rows) - 1) if rows[i][3] == 0 and rows[i + 1][2] == rows[i][2]]
        if not at:
            return
        edited = [_edit(rows[i][1], rows[i + 1][1]) for i in at]
        prints = embed([classes(r[1]) for r in rows] + [classes(e) for e in edited])
        own, new = prints[:len(rows)], prints[len(rows):]
        mine, following = own[at], own[np.array(at) + 1]
        columns = [[rows[i][0] for i in at], [len(rows[i][1]) for i in at], [sha256(e.encode("utf-8", "replace")).hexdigest() for e in edited],
                   _strings(mine), _strings(new), (mine == new).mean(axis=1), (mine == following).mean(axis=1)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    def run(batches):
        rows, held = [], 0
        for part in slices(batches):
            for row in zip(*(c.to_pylist() for c in part.columns)):
                rows.append(row)
                held += 2 * len(row[1])
                if held >= CHARS and len(rows) > 1:
                    yield from solve(rows)
                    rows, held = rows[-1:], 2 * len(row[1])   # the last one still waits for its successor
        yield from solve(rows)

    return _order(docs).mapInArrow(run, schema)


# ---------------------------------------------------------------- near classes

#: bands of sampled slots: texts of likeness t meet in one of them with a probability of about 1 - (1 - t^ROWS)^BANDS,
#: which is 0.97 at the threshold and 0.9995 at 0.9
BANDS, ROWS, THRESHOLD = 20, 8, 0.8
#: a key with more nodes gets MAX_RUN ** 2 / 2 comparisons in one task; what they leave open is cut by equal blocks
MAX_RUN = 50_000


def band_slots() -> np.ndarray:
    """Slots of each band, drawn without repeats inside a band."""
    priority = _mix(np.arange(BANDS * SLOTS, dtype=np.uint64) + np.uint64(SEED << 52)).reshape(BANDS, SLOTS)
    return np.argsort(priority, axis=1)[:, :ROWS]


def block_slots(threshold: float, level: int) -> list[np.ndarray]:
    """All slots in one block more than slots that may differ at the threshold, other ones at each level: one block is equal."""
    differ = SLOTS - int(np.ceil(threshold * SLOTS))
    order = np.argsort(_mix(np.arange(SLOTS, dtype=np.uint64) + np.uint64((SEED << 52) + (level << 40))))
    return np.array_split(order, min(SLOTS, differ + 1))


def _slot_keys(column: str, groups):
    return [F.concat(F.lit(chr(97 + g)), *[F.substring(column, int(s) + 1, 1) for s in sorted(own)]) for g, own in enumerate(groups)]


def spanning(prints: np.ndarray, threshold: float, budget: float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b) of rows that connect whatever is connected at the threshold: at most one per row. Beyond the budget of
    comparisons, the third array has the rows that still may be near one another; all others were compared with them."""
    none = np.empty(0, np.int64)
    a, b, rest, todo, made = [none], [none], none, np.arange(len(prints)), 0
    while todo.size > 1:
        frontier, todo = [todo[:1]], todo[1:]
        while frontier and todo.size:
            if made >= budget:
                rest, todo = np.concatenate([*frontier, todo]), none
                break
            pivot = frontier[-1][-1]
            frontier[-1] = frontier[-1][:-1]
            made += todo.size
            near = np.concatenate([(prints[todo[i:i + _PIECE]] == prints[pivot]).mean(axis=1) >= threshold for i in range(0, todo.size, _PIECE)])
            hits, todo = todo[near], todo[~near]
            a.append(np.full(hits.size, pivot))
            b.append(hits)
            frontier = [x for x in (*frontier, hits) if x.size]
    return np.concatenate(a), np.concatenate(b), rest


def _shared(batches):
    """Of rows (key, node) sorted by key, those whose key another row has too; only the last row is carried over."""
    key, node, met = None, None, False
    for batch in batches:
        keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not keys.size:
            continue
        if key is not None:
            keys, nodes = np.append(key, keys), np.append(node, nodes)
        same = keys[1:] == keys[:-1]
        before, after = np.append(met, same), np.append(same, False)
        take = np.flatnonzero((before | after)[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(keys[take]), pa.array(nodes[take])], names=["key", "node"])
        key, node, met = keys[-1:], nodes[-1:], bool(before[-1])
    if met:
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], names=["key", "node"])


def _verify(threshold: float, last: bool):
    """Rows (key, node, print) sorted by key: verified links (kind 0), or (node, key) that a run beyond MAX_RUN leaves open (kind 1).

    A run is held as arrays, about 200 bytes a node.
    """
    def batch(kind, a, b):
        if a.size:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(a.size, kind, np.int8)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

    def solve(key, nodes, packed):
        if nodes.size < 2:
            return
        prints = np.concatenate([packed >> 4, packed & 15], axis=1)
        a, b, rest = spanning(prints, threshold, np.inf if last or nodes.size <= MAX_RUN else MAX_RUN ** 2 // 2)
        yield from batch(0, nodes[a], nodes[b])
        yield from batch(1, nodes[rest], np.full(rest.size, key))

    def run(batches):
        key, held = None, []
        for part in batches:
            if not part.num_rows:
                continue
            keys, nodes = part.column(0).to_numpy(), part.column(1).to_numpy()
            packed = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(keys.size, -1)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), keys.size]
            for i, j in zip(cuts, cuts[1:]):
                if held and keys[i] != key:
                    yield from solve(key, *map(np.concatenate, zip(*held)))
                    held = []
                key = keys[i]
                held.append((nodes[i:j], packed[i:j]))
        if held:
            yield from solve(key, *map(np.concatenate, zip(*held)))

    return run


def node_of(fingerprint: str):
    """64 bits that name a fingerprint."""
    return F.xxhash64(fingerprint)


def near_classes(prints: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, class_id) of (doc_id, fingerprint): smallest doc_id reachable over verified links.

    Equal fingerprints are one node (``node_of``), which carries its notes as 64 bytes; that of empty texts has none and no links.
    Keys cross the network once and only those that several nodes share are joined with the notes and verified. What a key with
    more nodes than one task should compare leaves open is cut within that key: nodes at the threshold agree in one of its blocks.
    """
    nodes = prints.groupBy(node_of("fingerprint").alias("node"), F.unhex("fingerprint").alias("print")).agg(F.min("doc_id").alias("first"))
    nodes = stored(nodes, "prints")
    noted = nodes.where("print IS NOT NULL").select("node", "print")
    todo, found = noted.withColumn("within", F.lit(0).cast("long")), None
    for level in range(3):
        groups = block_slots(threshold, level) if level else band_slots()
        spelled = todo.select("node", "within", F.lower(F.hex("print")).alias("digits"))
        keys = spelled.select(F.explode(F.transform(F.array(*_slot_keys("digits", groups)), lambda k: F.xxhash64(k, F.col("within")))).alias("key"), "node")
        shared = keys.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "key long, node long")
        rows = shared.join(noted, "node").select("key", "node", "print")
        out = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_verify(threshold, level == 2), "kind byte, a long, b long")
        out = stored(out, "print-links")
        pairs = out.where("kind = 0").select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        todo = out.where("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("within"))
        if todo.isEmpty():
            break
        todo = todo.join(noted, "node")
    roots = components(found).withColumnRenamed("root", "of")
    known = nodes.select("node", "first").join(roots, "node")
    lowest = known.groupBy("of").agg(F.min("first").alias("low"))
    reach = known.join(lowest, "of").select("node", "low")
    return nodes.select("node", "first").join(reach, "node", "left").select("node", F.coalesce("low", "first").alias("class_id"))


def classified(docs: DataFrame) -> DataFrame:
    """The rows of ``fingerprints`` with class_id: documents whose fingerprints are alike, by the smallest doc_id."""
    rows = stored(fingerprints(docs), "fingerprints")
    classes = near_classes(rows.select("doc_id", "fingerprint"))
    return rows.withColumn("node", node_of("fingerprint")).join(classes, "node").select(*rows.columns, "class_id")
