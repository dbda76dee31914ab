"""Periodic runs of words: maximal stretches that repeat with a smallest period at least twice.

Descending-LCP Kruskal. Suffixes of each text are sorted by prefix doubling, and neighbours in that order are united by
decreasing common prefix, each class holding its positions in order. When two classes meet at a common prefix of l words,
positions i < j that become neighbours share exactly l words; where j - i <= l, words i to j + l repeat with
period j - i, and that is a run if the word before i breaks the period. Every run is found once, from its own first word.

Words are stretches without ASCII white space. Null and empty texts have no words: no runs, empty collapsed text. Rows stand
alone, so repeated rows and null ids are treated like others; an empty table gives no rows. A text is held by one
task, at about 12 bytes a word and level of doubling (levels end when no stretch repeats any more).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadwatch.llm.common import bind, id_field, map_texts, texts

SHORTEST = 12
#: positions in one block of an ordered set; blocks split at twice that
BLOCK = 512
_RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


class Positions:
    """Ordered positions in short blocks, so that an insertion moves a bounded number of them."""

    __slots__ = ("blocks", "lows", "size")

    def __init__(self, first: int):
        self.blocks, self.lows, self.size = [[first]], [first], 1

    def add(self, x: int) -> tuple[int, int]:
        """Insert and return the neighbours (-1 where there is none)."""
        at = max(bisect_right(self.lows, x) - 1, 0)
        block = self.blocks[at]
        k = bisect_left(block, x)
        left = block[k - 1] if k else (self.blocks[at - 1][-1] if at else -1)
        right = block[k] if k < len(block) else (self.blocks[at + 1][0] if at + 1 < len(self.blocks) else -1)
        block.insert(k, x)
        self.lows[at] = block[0]
        self.size += 1
        if len(block) > 2 * BLOCK:
            self.blocks[at:at + 1] = [block[:BLOCK], block[BLOCK:]]
            self.lows[at:at + 1] = [block[0], block[BLOCK]]
        return left, right

    def __iter__(self):
        for block in self.blocks:
            yield from block


def _repeating(codes: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Texts in which some ``width`` words stand twice, by hash: one too many costs time only."""
    n = codes.size - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = x[:n].copy()
    for j in range(1, width):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + x[j:j + n]
    h ^= doc[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    inside = doc[:n] == doc[width - 1:]
    h, where = h[inside], doc[:n][inside]
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    return np.unique(where[np.isin(h, twice)]) if twice.size else np.zeros(0, np.int64)


def _levels(names: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix order, ranks of the first 1, 2, 4, ... names) by prefix doubling; a rank is its class's first place in the
    order, so only classes of two or more are sorted again."""
    n = names.size
    order = np.argsort(names, kind="stable")
    first = np.flatnonzero(np.r_[True, names[order][1:] != names[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.r_[first, n]))
    levels, step = [rank.astype(np.int32)], 1
    while True:
        held = np.bincount(rank, minlength=n)
        active = order[held[rank[order]] > 1]          # by rank, so classes stay together
        if not active.size:
            break
        group, ahead = rank[active], active + step
        follow = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = group * (n + 1) + follow
        by = np.argsort(key, kind="stable")
        active, key, group = active[by], key[by], group[by]
        place = np.arange(active.size)
        new_group = np.r_[True, group[1:] != group[:-1]]
        new_class = np.r_[True, key[1:] != key[:-1]]
        base = np.maximum.accumulate(np.where(new_group, place, 0))
        start = np.maximum.accumulate(np.where(new_class, place, 0))
        order[group + place - base] = active
        rank[active] = group + start - base
        levels.append(rank.astype(np.int32))
        step *= 2
    return order, levels


def _common(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Common prefix of the suffixes at ``a`` and ``b``. It ends before the mark that closes each text."""
    got = np.zeros(a.size, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        got += (levels[k][a + got] == levels[k][b + got]).astype(np.int64) << k
    return got


def _kruskal(edges, names: list[int], shortest: int) -> dict[tuple[int, int], int]:
    """(start, length) -> smallest period, from (common prefix, position, position) by decreasing prefix."""
    parent: dict[int, int] = {}
    sets: dict[int, Positions] = {}
    runs: dict[tuple[int, int], int] = {}

    def find(x: int) -> int:
        while (up := parent[x]) != x:
            parent[x] = x = parent[up]
        return x

    def seed(i: int, j: int, shared: int) -> None:
        period = j - i
        if period <= shared and period + shared >= shortest and names[i - 1] != names[j - 1]:
            key = (i, period + shared)
            runs[key] = min(period, runs.get(key, period))

    for shared, x, y in edges:
        for p in (x, y):
            if p not in parent:
                parent[p], sets[p] = p, Positions(p)
        x, y = find(x), find(y)
        if sets[x].size < sets[y].size:
            x, y = y, x
        large, last = sets[x], -1
        parent[y] = x
        for p in sets.pop(y):
            left, right = large.add(p)
            if left >= 0 and left != last:      # a neighbour from the other class: the common prefix is exact
                seed(left, p, shared)
            if right >= 0:
                seed(p, right, shared)
            last = p
    return runs


def find_runs(batch: list[list], shortest: int = SHORTEST) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each list of words, by start, then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in batch]
    flat = np.empty(sum(map(len, batch)), object)
    at = 0
    for words in batch:
        flat[at:at + len(words)] = words
        at += len(words)
    if not at:
        return found
    codes = pd.factorize(flat)[0].astype(np.int64)
    sizes = np.array([len(w) for w in batch])
    doc = np.repeat(np.arange(len(batch)), sizes)
    ends = np.cumsum(sizes)
    width = (shortest + 1) // 2                  # l >= period and l + period >= shortest
    chosen = _repeating(codes, doc, width)
    if not chosen.size:
        return found
    # texts side by side, each closed by a mark of its own; a mark also stands before the first
    top = int(codes.max()) + 2
    parts, begins, n = [np.array([-1])], [], 1
    for number, d in enumerate(chosen):
        begins.append(n)
        parts += [codes[ends[d] - sizes[d]:ends[d]] + 1 + number * top, np.array([number * top])]
        n += int(sizes[d]) + 1
    names = np.concatenate(parts)
    order, levels = _levels(names)
    a, b = order[:-1], order[1:]
    near = levels[min((width.bit_length() - 1), len(levels) - 1)]
    near = near[a] == near[b]
    a, b = a[near], b[near]
    shared = _common(a, b, levels)
    keep = shared >= width
    a, b, shared = a[keep], b[keep], shared[keep]
    by = np.argsort(-shared, kind="stable")
    runs = _kruskal(zip(shared[by].tolist(), a[by].tolist(), b[by].tolist()), names.tolist(), shortest)
    for (start, length), period in runs.items():
        number = bisect_right(begins, start) - 1
        found[chosen[number]].append((start - begins[number], length, period))
    for runs_of in found:
        runs_of.sort(key=lambda r: (r[0], r[2]))
    return found


def _kept(words: list, runs: list[tuple[int, int, int]]) -> list:
    """Words outside every run's repetitions, whose first period stays."""
    if not runs:
        return words
    start, length, period = np.array(runs).T
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, start + length, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]


def collapse(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """Per row of documents: doc_id, n_words, runs (start, length, period by start, then period) and collapsed, the words
    outside the repetitions of every run joined by one space. A run has ``shortest`` words at least."""
    def work(rows: dict) -> dict:
        words = [(t or "").encode("utf-8", "replace").split() for t in rows["text"]]
        runs = find_runs(words, shortest)
        names = ("start", "length", "period")
        return {"doc_id": rows["doc_id"], "n_words": [len(w) for w in words],
                "runs": [[dict(zip(names, r)) for r in found] for found in runs],
                "collapsed": [b" ".join(_kept(w, r)).decode() for w, r in zip(words, runs)]}

    schema = T.StructType([id_field(docs), T.StructField("n_words", T.LongType()), T.StructField("runs", _RUN),
                           T.StructField("collapsed", T.StringType())])
    return map_texts(texts(docs), work, schema)


def with_repetitions(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where texts of one id in ten repeat part of themselves: with h = crc32(id as text) divisible by 10, g = h
    div 10 and n words, words from a = g mod n on become a + (i - a) mod p for p = 1 + (n - a) div (3 + g mod 8).
    A null id changes nothing."""
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w):
        n = F.size(w).cast("long")
        start = F.pmod(g, n)
        period = 1 + F.floor((n - start) / (3 + F.pmod(g, F.lit(8))))

        def at(i):
            return F.get(w, F.when(i < start, i).otherwise(start + F.pmod(i - start, period)).cast("int"))

        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), at), " ")).otherwise("")

    changed = F.when(F.pmod(h, F.lit(10)) == 0, bind(words, repeated)).otherwise(F.col("text"))
    return texts(docs).select("doc_id", changed.alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Counts, the longest run (ties: smallest start, then period; no run: nulls) and digests of ``collapse``'s rows."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), listed.alias("listed"), "collapsed").select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
