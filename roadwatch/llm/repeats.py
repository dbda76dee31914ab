"""Suffix-array dedup: removes every byte covered by a string of LENGTH bytes that also starts anywhere else.

Equal windows must meet in one task, so each window is named by its anchor, the smallest hash of its GRAM-byte strings;
neighbouring windows with one anchor form a segment. A segment whose anchor occurs once holds no repeat; one whose anchor
only ever occurs with equal bytes is repeated as a whole, and neither needs sorting. Where an anchor has several variants, or
occurs twice inside a segment, one copy of each variant goes to a suffix array: two-stage sorting (suffixes smaller than their successors are sorted, the rest is induced by
scanning buckets), then common prefixes of neighbours. Segments longer than CUT, which only periodic text has, are cut into
pieces that overlap by a window less one byte. The variants of an anchor with more than MAX_VARIANTS of them are segmented again by a second
hash, and what is still too much for one task groups its windows by their bytes. So a task's bytes are bounded, and the strings found the same.

Null texts are empty; texts shorter than LENGTH lose nothing; very long texts are cut into pieces whose windows overlap.
Each row is a document of its own, so repeated rows are each other's copies. Null ids and extra columns are passed through; empty
tables give empty results.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadwatch.llm.common import free_name, id_field, keyed, slices
from roadwatch.session import stored

LENGTH = 200
GRAM = 40
#: bytes hashed at once, and bytes in one suffix array unless one anchor has more
PIECE = 1 << 20
#: low bits of an anchor that hold its place while minima are taken
_PLACE = 22
#: bytes of one segment
CUT = 1024
#: variants of one anchor that go into one suffix array, which so holds at most this many times CUT bytes and PIECE
MAX_VARIANTS = 10_000

_BASE = 0x9E3779B97F4A7C15
_KEY = ["rk", "tk"]
_STEP = 7   # symbols of nine bits in one sort key


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _gram_hashes(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """A mixed polynomial hash of every GRAM-byte string."""
    n = data.size
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=prefix[1:])
    x = (prefix[GRAM:] - prefix[:-GRAM]) * _powers(pow(_BASE, -1, 1 << 64), n - GRAM + 1)
    x ^= np.uint64(seed)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    m = x.size
    padded = np.full(-(-m // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:m] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(rows, axis=1).ravel()
    return np.minimum(ahead[: m - width + 1], behind[width - 1: m])


def _cut_long(first: np.ndarray, stop: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments cut to CUT bytes at most, each window in one piece, and the segment that each piece comes from."""
    step = max(CUT - length + 1, 1)
    parts = -(-(stop - first - length + 1) // step)
    of = np.repeat(np.arange(first.size), parts)
    at = first[of] + step * (np.arange(of.size) - np.repeat(np.cumsum(parts) - parts, parts))
    return at, np.minimum(at + step + length - 1, stop[of]), of


def segments(texts: list[bytes], length: int = LENGTH, seed: int = 0) -> list[tuple[np.ndarray, ...]]:
    """Per text: anchors, hashes of the segments' bytes, their first bytes, the bytes after their last, and whether the
    anchor occurs more than once in the segment, which may then repeat itself."""
    empty = (*(np.empty(0, np.int64) for _ in range(4)), np.empty(0, bool))
    out = [empty] * len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    long_ = np.flatnonzero(sizes >= length)
    if not long_.size:
        return out
    buffer = b"".join(texts[i] for i in long_)
    ends = np.cumsum(sizes[long_])
    begins = ends - sizes[long_]
    grams = _gram_hashes(np.frombuffer(buffer, np.uint8), seed)
    bits, place = np.uint64(_PLACE), np.uint64((1 << _PLACE) - 1)
    low = _window_min(grams >> bits << bits | np.arange(grams.size, dtype=np.uint64) & place, length - GRAM + 1)
    at, low = low & place, low >> bits
    view, digest = memoryview(buffer), xxhash.xxh64_intdigest
    for i, a, b in zip(long_.tolist(), begins.tolist(), ends.tolist()):
        own = low[a:b - length + 1]
        first = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
        stop = np.append(first[1:], own.size) + length - 1
        moved = np.concatenate([[0], at[a:b - length + 1][1:] != at[a:b - length + 1][:-1]])
        moved[first] = 0
        several = np.add.reduceat(moved, first) > 0
        anchors = own[first].view(np.int64)
        if int((stop - first).max()) > CUT:
            first, stop, of = _cut_long(first, stop, length)
            anchors, several = anchors[of], several[of]
        hashes = np.array([digest(view[a + s:a + e]) for s, e in zip(first.tolist(), stop.tolist())], np.uint64)
        out[i] = (anchors, hashes.view(np.int64), first, stop, several)
    return out


def _long_segments(text: bytes, length: int):
    """A text beyond PIECE, in pieces that overlap by a window less one byte."""
    parts = []
    for at in range(0, len(text) - length + 1, PIECE):
        a, h, s, e, own = segments([text[at:at + PIECE + length - 1]], length)[0]
        parts.append((a, h, s + at, e + at, own))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _segment_rows(length: int):
    fields = [("rk", pa.int64()), ("tk", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("a", "h", "start", "stop")), ("own", pa.list_(pa.bool_()))]
    target = pa.schema(fields)
    fields_of = list(target)[2:]

    def run(batches):
        for part in slices(batches, limit=PIECE):
            rows = part.to_pydict()
            found = []
            texts = [t.encode("utf-8", "replace") for t in rows["text"]]
            if len(texts) == 1 and len(texts[0]) > 2 * PIECE:
                found = [_long_segments(texts[0], length)]
            else:
                found = segments(texts, length)
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*found), fields_of)]
            yield pa.RecordBatch.from_arrays([pa.array(rows["rk"], pa.int64()), pa.array(rows["tk"], pa.int64()), *columns], schema=target)

    return run


# ---------------------------------------------------------------- suffix array

def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their suffixes, exact to ``depth`` symbols at least, and the sort keys.

    Symbols are below 512; zero separates texts. Stage one sorts the suffixes that are smaller than their successors, stage
    two puts every other one behind its successor while buckets of first symbols are scanned upwards.
    """
    n = symbols.size
    padded = np.zeros(n + depth + 2 * _STEP, np.uint64)
    padded[:n] = symbols
    keys = np.zeros(n + depth + _STEP, np.uint64)
    for j in range(_STEP):
        keys = (keys << np.uint64(9)) | padded[j:j + keys.size]
    step = np.sign(np.diff(symbols.astype(np.int32), append=-1)).astype(np.int8)   # the last one is larger than nothing
    at = np.where(step != 0, np.arange(n), n)
    smaller = step[np.minimum.accumulate(at[::-1])[::-1]] > 0
    direct = _direct_sort(np.flatnonzero(smaller), keys, depth)
    return _induce(symbols, direct), keys


def _direct_sort(idx: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    if not idx.size:
        return idx
    idx = idx[np.argsort(keys[idx], kind="stable")]
    group = np.cumsum(np.concatenate([[0], keys[idx][1:] != keys[idx][:-1]]))
    places = np.arange(idx.size)
    for d in range(_STEP, depth, _STEP):
        same = group[1:] == group[:-1]
        tied = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        if not tied.any():
            break
        places, idx_t, group = places[tied], idx[places[tied]], group[tied]
        k = keys[idx_t + d]
        order = np.lexsort((k, group))
        idx[places] = idx_t[order]
        k, g = k[order], group[order]
        group = np.cumsum(np.concatenate([[0], (g[1:] != g[:-1]) | (k[1:] != k[:-1])]))
    return idx


def _induce(symbols: np.ndarray, direct: np.ndarray) -> np.ndarray:
    top = int(symbols.max()) + 1
    first = symbols[direct]
    edges = np.searchsorted(first, np.arange(top + 1))   # sorted suffixes are grouped by first symbol
    waiting: list[list[np.ndarray]] = [[] for _ in range(top)]
    waiting[symbols[-1]].append(np.array([symbols.size - 1]))
    out = []
    for c in range(top):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        bucket = []
        while wave.size:   # runs of one symbol: each wave stands before the next
            bucket.append(wave)
            before = wave[wave > 0] - 1
            wave = before[symbols[before] == c]
        bucket.append(direct[edges[c]:edges[c + 1]])
        full = np.concatenate(bucket)
        out.append(full)
        before = full[full > 0] - 1
        before = before[symbols[before] > c]
        if before.size:
            s = symbols[before]
            order = np.argsort(s, kind="stable")
            s, before = s[order], before[order]
            cuts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            for part, symbol in zip(np.split(before, cuts[1:]), s[cuts]):
                waiting[symbol].append(part)
    return np.concatenate(out)


def repeated_starts(strings: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Per string, a mask over its windows: the window's bytes also start elsewhere among the strings."""
    sizes = np.array([len(s) for s in strings], np.int64)
    joined = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    symbols = joined.astype(np.int16) + 1
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    symbols[begins + sizes] = 0
    order, keys = suffix_order(symbols, length)
    room = np.concatenate([np.arange(n, -1, -1) for n in sizes])   # symbols up to the separator
    x, y = order[:-1], order[1:]
    both = (room[x] >= length) & (room[y] >= length)
    x, y = x[both], y[both]
    for d in [*range(0, length - _STEP, _STEP), length - _STEP]:   # the common prefix, by blocks, as far as it is wanted
        same = keys[x + d] == keys[y + d]
        x, y = x[same], y[same]
    hit = np.zeros(symbols.size, bool)
    hit[x] = hit[y] = True
    return [hit[b:b + max(0, n - length + 1)] for b, n in zip(begins, sizes)]


def _runs(mask: np.ndarray, at: int) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"lo": at + int(a), "hi": at + int(b)} for a, b in zip(edge[::2], edge[1::2])]


_MARKS = "a long, h long, runs array<struct<lo: long, hi: long>>"
_PIECES = "g long, a long, h long, at long, data binary"


def _mark(length: int):
    """Windows that occur again among the pieces of their group ``g``; pieces come in order of it."""
    target = pa.schema([("a", pa.int64()), ("h", pa.int64()), ("runs", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))])

    def solve(rows):
        masks = repeated_starts([r[4] for r in rows], length)
        kept = [(a, h, runs) for (_, a, h, at, _), mask in zip(rows, masks) if (runs := _runs(mask, at))]
        return pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], f.type) for i, f in enumerate(target)], schema=target)

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("g", "a", "h", "at", "data"))):
                if held >= PIECE and rows[-1][0] != row[0]:   # pieces of one group stay together
                    yield solve(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4])
        if rows:
            yield solve(rows)

    return run


def _again(length: int):
    """The variants of a heavy anchor in segments by a second hash; equal windows get equal groups."""
    target = pa.schema([("g", pa.int64()), ("a", pa.int64()), ("h", pa.int64()), ("at", pa.int64()), ("data", pa.binary())])

    def run(batches):
        for part in slices(batches, "data", PIECE):
            rows = part.to_pydict()
            out = []
            for a, h, data, (anchors, _, first, stop, _) in zip(rows["a"], rows["h"], rows["data"], segments(rows["data"], length, _BASE)):
                groups = anchors ^ np.int64(a)
                out += [(g, a, h, s, data[s:e]) for g, s, e in zip(groups.tolist(), first.tolist(), stop.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(target)], schema=target)

    return run


# ---------------------------------------------------------------- on Spark

def _by_weight(pieces: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Pieces of groups that one task can hold, and those of the others."""
    heavy = pieces.groupBy("g").agg(F.count("*").alias("v")).where(F.col("v") > limit).select("g")
    return pieces.join(heavy, "g", "left_anti"), pieces.join(heavy, "g", "left_semi")


def _by_bytes(pieces: DataFrame, length: int) -> DataFrame:
    """The marks of pieces whose windows meet by their bytes, counted before the shuffle."""
    windows = F.transform(F.sequence(F.lit(0), F.octet_length("data") - length), lambda i: F.struct(i.alias("i"), F.substr("data", i + 1, F.lit(length)).alias("w")))
    opened = pieces.select("a", "h", "at", F.explode(windows).alias("x")).select("a", "h", (F.col("at") + F.col("x.i")).alias("lo"), "x.w")
    twice = opened.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    found = opened.join(twice, "w").groupBy("a", "h").agg(F.collect_set(F.struct("lo", (F.col("lo") + 1).alias("hi"))).alias("runs"))
    return found


def covers(rows: DataFrame, length: int = LENGTH, max_variants: int = MAX_VARIANTS) -> DataFrame:
    """(rk, tk, cover): the byte ranges (lo, hi) of each document that repeated strings cover, not merged.

    Only anchors, hashes and places are shuffled for all documents, counts combined before; bytes move for
    one copy of each variant of an anchor that has several.
    """
    found = stored(rows.select(*_KEY, "text").mapInArrow(_segment_rows(length), "rk long, tk long, a array<long>, h array<long>, start array<long>, stop array<long>, own array<boolean>"), "segments")
    flat = found.select(*_KEY, F.explode(F.arrays_zip("a", "h", "start", "stop", "own")).alias("s"))
    flat = flat.select(*_KEY, F.col("s.a").alias("a"), F.col("s.h").alias("h"), F.col("s.start").cast("int").alias("start"), F.col("s.stop").cast("int").alias("stop"), F.col("s.own").alias("own"))
    anchors = flat.groupBy("a").agg(F.count("*").alias("m"), F.min("h").alias("least"), F.max("h").alias("most"), F.max("own").alias("own")).where("m > 1 or own")
    shared = stored(flat.drop("own").join(anchors.select("a", F.expr("own or least != most").alias("mixed")), "a"), "shared")
    whole = shared.where("not mixed").select(*_KEY, F.col("start").alias("lo"), F.col("stop").alias("hi"))

    mixed = shared.where("mixed")
    variants = mixed.groupBy("a", "h").agg(F.count("*").alias("m"), F.min(F.struct(*_KEY, "start", "stop")).alias("p"))
    variants = stored(variants, "variants")
    # every place of a variant with several copies is repeated; it still meets its siblings below
    picks = variants.select("p.*", "a", "h").groupBy(*_KEY).agg(F.collect_list(F.struct("a", "h", "start", "stop")).alias("picks"))
    data = rows.join(picks, _KEY).dropDuplicates(_KEY).select(F.col("text").cast("binary").alias("data"), F.explode("picks").alias("p"))
    data = stored(data.select(F.col("p.a").alias("g"), "p.a", "p.h", F.lit(0).cast("long").alias("at"), F.expr("substring(data, p.start + 1, p.stop - p.start)").alias("data")), "variant-bytes")

    light, heavy = _by_weight(data, max_variants)
    finer = stored(heavy.mapInArrow(_again(length), _PIECES), "pieces")
    light_again, rest = _by_weight(finer, max_variants)
    marks = light.unionByName(light_again).repartition("g").sortWithinPartitions("g").mapInArrow(_mark(length), _MARKS)
    marks = marks.unionByName(_by_bytes(rest, length))

    single = mixed.join(marks, ["a", "h"]).select(*_KEY, "start", F.explode("runs").alias("r"))
    single = single.select(*_KEY, (F.col("start") + F.col("r.lo")).cast("int").alias("lo"), (F.col("start") + F.col("r.hi") + (length - 1)).cast("int").alias("hi"))
    several = mixed.join(variants.where("m > 1").select("a", "h"), ["a", "h"]).select(*_KEY, F.col("start").alias("lo"), F.col("stop").alias("hi"))
    return whole.unionByName(single).unionByName(several).groupBy(*_KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("cover"))


def merge(cover: list[dict]) -> list[tuple[int, int]]:
    """Maximal ranges of a list of ranges; ranges that touch are one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((c["lo"], c["hi"]) for c in cover or ()):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def cut(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for lo, hi in ranges:
        kept.append(text[at:lo])
        at = hi
    return b"".join([*kept, text[at:]])


def dedup(docs: DataFrame, length: int = LENGTH, max_variants: int = MAX_VARIANTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = keyed(docs).repartition(*_KEY)
    longs = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    schema = T.StructType([id_field(docs), *longs, T.StructField("kept_sha256", T.StringType())])
    target = to_arrow_schema(schema)

    def run(batches):
        for part in slices(batches):
            out = []
            for doc, text, cover in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "cover"))):
                data, ranges = text.encode("utf-8", "replace"), merge(cover)
                out.append((doc, len(data), sum(b - a for a, b in ranges), len(ranges), sha256(cut(data, ranges)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

    return rows.join(covers(rows, length, max_variants), _KEY, "left").select("doc_id", "text", "cover").mapInArrow(run, schema)


def clean(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with all their columns and the remaining bytes as text (a character that was cut apart is left out);
    ``n_chars``, where there is one, follows the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rk, tk, cover = (free_name(docs, c) for c in ("_rk", "_tk", "_cover"))
    found = covers(keyed(docs).repartition(*_KEY), length)
    found = found.select(F.col("rk").alias(rk), F.col("tk").alias(tk), F.col("cover").alias(cover))
    joined = docs.withColumns({rk: F.xxhash64(F.col("doc_id"), text), tk: F.xxhash64(text)}).join(found, [rk, tk], "left")
    columns, counted = docs.columns, "n_chars" in docs.columns

    def run(batches):
        for part in slices(batches):
            table = {c: part.column(c) for c in columns}
            new, sizes = [], table["n_chars"].to_pylist() if counted else []
            for i, (t, c) in enumerate(zip(part.column("text").to_pylist(), part.column(cover).to_pylist())):
                if c:
                    t = cut(t.encode("utf-8", "replace"), merge(c)).decode("utf-8", "ignore")
                    if counted:
                        sizes[i] = len(t)
                new.append(t)
            table["text"] = pa.array(new, table["text"].type)
            if counted:
                table["n_chars"] = pa.array(sizes, table["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(table.values()), names=columns)

    return joined.select(*columns, cover).mapInArrow(run, docs.schema)
