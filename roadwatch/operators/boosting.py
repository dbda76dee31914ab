"""Boosted trees, many models grown together over one table.

Rows are binned once and packed: a record of the state is a block of rows, column by column. For each tree level one Spark
job adds up the gradients of all models by (model, node, feature, bin): tasks sum their own rows, a shuffle by model adds the
tasks' sums, and the driver, which gets sums of a size that does not depend on the rows, picks the splits. Of two children only
the one with fewer rows is counted; the other has what is left of its parent. Features of few bins are counted together and told
apart afterwards. Folds, configurations, labels and losses are all just models, so 60 models cost as many jobs as one. Trees
since the last step travel with the job; every few trees the scores are taken further, and every few such steps they are
written to the checkpoint folder in place of those written before.

The loops over rows are in BlockTasks.java (``_Compiled``); the same in numpy (``_Plain``) is what they are compared with, and
what a session without a compiler uses.

Categories are ordered by their label statistics, so a column needs no more bins than a number, however many values it
has. Statistics are cross-fitted: they are kept per fold, and the value of a row leaves out the fold that a
model is judged on and the row's own fold. Other columns with such per-fold counts (``Counted``) are treated alike.

Losses: ``log`` for 0/1 labels, ``square``, and ``quantile``, whose trees are grown on the loss's gradient and whose
leaves are then refilled with the exact quantile of their residuals, selected by two counts of 16 bits each.
Rows whose label is null train nothing and are scored like others.
"""

from __future__ import annotations

import json
import logging
import math
import struct
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.serializers import NoOpSerializer
from pyspark.sql import DataFrame, functions as F, types as T

from roadwatch import settings as S
from roadwatch.operators import native
from roadwatch.operators.lookup import look_up
from roadwatch.session import shared_dir, stored

#: bins of a feature; a split is the last bin that goes left
BINS = 64
#: trees between two steps of the scores, and steps between two that are written
EVERY, WRITTEN = 2, 10
#: rows of a node, and ridge on the sum of second derivatives
MIN_ROWS, RIDGE = 20, 1.0
#: rows that one task of the binned table holds at most, and rows worth a task of their own
TASK_ROWS, SMALL_ROWS = 262_144, 2500
#: rows of a block, which a task works on at once
BLOCK_ROWS = 16_384
#: bins of features that are counted together, multiplied; more of them pay while a model has one or two nodes to count
CELLS, WIDE_CELLS = 512, 4096


@dataclass(frozen=True)
class Spec:
    """One model. ``held_out`` names the fold that it is not trained on; ``features`` limits it to some columns."""

    name: str
    label: str
    loss: str = "log"
    held_out: int | None = None
    trees: int = 100
    step: float = 0.1
    depth: int = 5
    subsample: float = 1.0
    quantile: float = 0.5
    balanced: bool = False
    features: tuple[str, ...] | None = None


@dataclass
class Counted:
    """A feature made of label counts: columns ``n`` and ``s`` hold an array with one count and one sum per fold. The mean is
    blended into the prior as for categories, or, with ``weight``, as if the prior had been seen so many times."""

    name: str
    label: str
    n: str
    s: str
    weight: float | None = None


@dataclass
class Tree:
    """A full binary tree by position (children of i: 2i + 1 and 2i + 2); feature -1 marks a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def of(cls, depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return cls(np.full(size, -1, np.int16), np.zeros(size, np.int16), np.zeros(size), np.zeros(size))

    def leaves(self, bins: np.ndarray, columns: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each row, or of the rows with the given numbers. A leaf is its own left child, and nothing lies above its cut."""
        rows = np.arange(len(bins)) if rows is None else rows
        at = np.zeros(len(rows), np.int64)
        inner = self.feature >= 0
        if not inner.any():
            return at
        flat, begin = bins.ravel(), rows * bins.shape[1]
        column = columns[np.maximum(self.feature, 0)]
        cut = np.where(inner, self.cut, 255).astype(np.uint8)
        left = np.where(inner, 2 * np.arange(inner.size) + 1, np.arange(inner.size))
        for _ in range(int(np.flatnonzero(inner)[-1] + 1).bit_length()):
            at = left[at] + (flat[begin + column[at]] > cut[at])
        return at

    def places(self, turned: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """The leaf of each row as small whole numbers, from bins with one line per column: a few passes over bytes for each inner node."""
        kind = np.uint8 if self.feature.size <= 256 else np.int64
        at = np.zeros(turned.shape[1], kind)
        step, here = np.empty_like(at), np.empty(at.size, bool)
        for i in np.flatnonzero(self.feature >= 0).tolist():   # parents come before their children
            np.greater(turned[columns[self.feature[i]]], np.uint8(self.cut[i]), out=here)
            np.add(here, kind(i + 1), out=step, dtype=kind)    # from i to 2i + 1 or 2i + 2
            np.equal(at, kind(i), out=here)
            np.multiply(step, here, out=step)
            np.add(at, step, out=at)
        return at


# --------------------------------------------------------------------- encoding
@dataclass
class Layout:
    """What turns rows into bins: columns, their limits, and the label totals per fold."""

    folds: int
    numeric: tuple[str, ...]
    categories: tuple[str, ...]
    counted: tuple[Counted, ...]
    labels: tuple[str, ...]
    totals: dict[str, tuple[list[float], list[float]]]
    cuts: dict[str, list[float]] = field(default_factory=dict)

    @property
    def statistics(self) -> list[tuple[str, str, str, str, float | None]]:
        """(feature, label, count column, sum column, weight) of every column made of label counts."""
        out = [(c, y, f"_n_{c}_{y}", f"_s_{c}_{y}", None) for c in self.categories for y in self.labels]
        return out + [(c.name, c.label, c.n, c.s, c.weight) for c in self.counted]

    def features(self, label: str) -> list[str]:
        return [*self.numeric, *self.categories, *[c.name for c in self.counted if c.label == label]]

    def column(self, feature: str, label: str, held_out: int | None) -> int:
        """Where a model finds a feature's bins: numbers once, statistics once per label and fold left out."""
        if feature in self.numeric:
            return self.numeric.index(feature)
        at = [(f, y) for f, y, *_ in self.statistics].index((feature, label))
        return len(self.numeric) + at * (self.folds + 1) + (self.folds if held_out is None else held_out)

    def key(self, column: int) -> str:
        """The cut list of a column."""
        if column < len(self.numeric):
            return self.numeric[column]
        feature, label, *_ = self.statistics[(column - len(self.numeric)) // (self.folds + 1)]
        return f"{feature}:{label}"

    @property
    def width(self) -> int:
        return len(self.numeric) + len(self.statistics) * (self.folds + 1)


def _cross_fitted(n: np.ndarray, s: np.ndarray, fold: np.ndarray, total_n: np.ndarray, total_s: np.ndarray, weight: float | None) -> np.ndarray:
    """(rows, folds + 1) label means: column f leaves out fold f and the row's own one, the last only the row's own."""
    k = n.shape[1]
    rows = np.arange(len(n))
    own = np.maximum(fold, 0)
    has = (fold >= 0)[:, None]
    left_out = np.concatenate([np.eye(k), np.zeros((1, k))])                    # (k + 1, k): what each column leaves out
    left_out = np.where(has[:, :, None] & (np.arange(k) == own[:, None])[:, None, :], 1.0, left_out[None])
    keep = 1.0 - left_out                                                       # (rows, k + 1, k)
    count, total = np.einsum("rfk,rk->rf", keep, n), np.einsum("rfk,rk->rf", keep, s)
    prior = np.einsum("rfk,k->rf", keep, total_s) / np.maximum(np.einsum("rfk,k->rf", keep, total_n), 1.0)
    mean = np.where(count > 0, total / np.maximum(count, 1.0), prior)
    if weight is not None:
        return (total + weight * prior) / (count + weight) if weight > 0 else mean
    return prior + (mean - prior) / (1.0 + np.exp(-(count - S.ENCODING_MIN_LEAF) / S.ENCODING_SMOOTHING))


def category_counts(df: DataFrame, category: str, labels: Sequence[str], folds: int, fold: str = "fold") -> DataFrame:
    """One row per category: counts and label sums of every fold, combined before the only shuffle."""
    sums = []
    for y in labels:
        seen = F.col(y).isNotNull()
        sums.append(F.array(*[F.count_if(seen & (F.col(fold) == f)).cast("double") for f in range(folds)]).alias(f"_n_{category}_{y}"))
        sums.append(F.array(*[F.coalesce(F.sum(F.when(F.col(fold) == f, F.col(y).cast("double"))), F.lit(0.0)) for f in range(folds)]).alias(f"_s_{category}_{y}"))
    return df.groupBy(F.coalesce(F.col(category), F.lit("")).alias(category)).agg(*sums)


def _with_counts(df: DataFrame, layout: Layout, tables: dict[str, DataFrame]) -> DataFrame:
    for category, table in tables.items():
        df = look_up(df.withColumn(category, F.coalesce(F.col(category), F.lit(""))), table, [category])
    return df


def _counts(column, folds: int) -> np.ndarray:
    """(rows, folds) of a column of arrays; a missing array has no counts."""
    out = np.zeros((len(column), folds))
    out[pc.is_valid(column).to_numpy(zero_copy_only=False)] = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, folds)
    return out


def _values(layout: Layout, passed: int):
    """mapInArrow: (key, fold, h, labels ...) pass through, the rest becomes one array of feature values."""
    n_numeric = len(layout.numeric)

    def run(batches):
        for batch in batches:
            fold = np.array([-1 if f is None else f for f in batch.column(1).to_pylist()], np.int64)
            out = np.full((batch.num_rows, layout.width), np.nan)
            for j in range(n_numeric):
                out[:, j] = batch.column(passed + j).cast(pa.float64()).to_numpy(zero_copy_only=False)
            for j, (_, label, _, _, weight) in enumerate(layout.statistics):
                at = passed + n_numeric + 2 * j
                n, s = (_counts(batch.column(c), layout.folds) for c in (at, at + 1))
                totals = (np.array(t) for t in layout.totals[label])
                out[:, n_numeric + j * (layout.folds + 1):][:, :layout.folds + 1] = _cross_fitted(n, s, fold, *totals, weight)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, layout.width), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:passed], values], names=[*batch.schema.names[:passed], "x"])
    return run


def encode(df: DataFrame, layout: Layout, tables: dict[str, DataFrame], key: str, labels: Sequence[str]) -> DataFrame:
    """(key, fold, h, labels ..., x): x holds the values of all columns; rows without ``fold`` count as new ones."""
    if "fold" not in df.columns:
        df = df.withColumn("fold", F.lit(None).cast("int"))
    df = _with_counts(df, layout, tables)
    statistics = [c for _, _, n, s, _ in layout.statistics for c in (n, s)]
    rows = df.select(key, F.col("fold").cast("int").alias("fold"), F.xxhash64(key).alias("h"), *[F.col(y).cast("double").alias(y) for y in labels],
                     *[F.col(c).cast("double").alias(c) for c in layout.numeric], *statistics)
    passed = 3 + len(labels)
    kept = rows.schema.fields[:passed]
    return rows.mapInArrow(_values(layout, passed), T.StructType([*kept, T.StructField("x", T.ArrayType(T.DoubleType()))]))


def _cut_points(encoded: DataFrame, layout: Layout) -> dict[str, list[float]]:
    """At most BINS - 1 quantiles of each number and of each statistic's last form, from one aggregate."""
    at = {name: j for j, name in enumerate(layout.numeric)}
    at |= {f"{f}:{y}": layout.column(f, y, None) for f, y, *_ in layout.statistics}
    shares = [i / BINS for i in range(1, BINS)]
    found = encoded.agg(*[F.percentile_approx(F.nanvl(F.get("x", F.lit(j)), F.lit(None).cast("double")), shares, 20_000).alias(f"c{j}") for j in at.values()]).first()
    return {name: sorted(set(found[f"c{j}"] or [])) for name, j in at.items()}


def _bin(x: np.ndarray, layout: Layout) -> np.ndarray:
    out = np.zeros(x.shape, np.uint8)
    for j in range(layout.width):
        cuts = np.array(layout.cuts[layout.key(j)])
        out[:, j] = np.searchsorted(cuts, np.where(np.isnan(x[:, j]), -np.inf, x[:, j]), "left") if cuts.size else 0
    return out


def _matrix(column, dtype) -> np.ndarray:
    """Equally long binary values as a matrix."""
    column = column.cast(pa.binary())
    if not len(column):
        return np.zeros((0, 0), dtype)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].view(dtype).reshape(len(column), -1)


def _binary(matrix: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(matrix)
    size = flat.dtype.itemsize * flat.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(np.arange(0, len(flat) * size + 1, size, np.int32) if size else np.zeros(len(flat) + 1, np.int32)), pa.py_buffer(flat)])


def _doubles(columns) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns], 1)


def _lists(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


# ---------------------------------------------------------------------- growing
@dataclass
class _Work:
    """What a task needs for one level: models, their columns, trees since the checkpoint and the tree that grows."""

    specs: list[Spec]
    columns: list[np.ndarray]
    labels: list[int]
    rates: list[float]
    pending: list[list[Tree]]
    current: list[Tree]
    nodes: list[list[int]]
    number: int
    #: per model, where each feature's bins begin among the sums of a node
    starts: list[np.ndarray] = field(default_factory=list)

    def score(self, m: int, turned: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """The scores of all rows, from bins with one line per column and earlier scores with one per model."""
        total = raw[m].copy()
        for tree in self.pending[m]:
            total += tree.value.take(tree.places(turned, self.columns[m]))
        return total

    def trained(self, m: int, fold: np.ndarray, y: np.ndarray) -> np.ndarray:
        spec = self.specs[m]
        known = ~np.isnan(y)
        return known if spec.held_out is None else known & (fold != spec.held_out)

    def drawn(self, m: int, h: np.ndarray) -> np.ndarray:
        """The rows of this tree's subsample, by hash of row and tree."""
        return self.draw(h) < self.specs[m].subsample

    def draw(self, h: np.ndarray) -> np.ndarray:
        """A number below 1 for each row, by hash of row and tree."""
        x = (h.astype(np.uint64) ^ np.uint64((self.number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        return (x >> np.uint64(11)).astype(np.float64) / 2.0 ** 53

    def gradient(self, m: int, y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spec = self.specs[m]
        if spec.loss == "square":
            return score - y, np.ones(y.size)
        if spec.loss == "quantile":
            return np.where(y > score, -spec.quantile, 1.0 - spec.quantile), np.ones(y.size)
        p = 1.0 / (1.0 + np.exp(-score))
        w = np.where(y > 0.5, 0.5 / self.rates[m], 0.5 / (1.0 - self.rates[m])) if spec.balanced else 1.0
        return w * (p - y), w * p * (1.0 - p)


def _blocks(batches):
    """Batches of the state table put together, so that a pass over a column outweighs its call."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK_ROWS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if rows:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _turned(bins: np.ndarray) -> np.ndarray:
    """One line per column, copied in pieces that the processor's cache can hold."""
    out = np.empty(bins.shape[::-1], bins.dtype)
    for i in range(0, len(bins), 2048):
        out[:, i:i + 2048] = bins[i:i + 2048].T
    return out


def _loose(batch, n_labels: int):
    """(fold, h, labels, bins, raw) of rows that come one per record, the last three with one line per column."""
    fold = pc.fill_null(batch.column(1), -1).to_numpy(zero_copy_only=False).astype(np.int32)
    return (fold, batch.column(2).to_numpy(), _doubles(batch.columns[3:3 + n_labels]).T,
            _turned(_matrix(batch.column(3 + n_labels), np.uint8)), _turned(_matrix(batch.column(4 + n_labels), np.float64)))


def _unpacked(columns, n_labels: int):
    """(fold, h, labels, bins, raw) of a record of the state table, without a copy. No scores at all are zeros for any model."""
    fold, h, y, bins, raw = (np.frombuffer(c.as_buffer(), kind) for c, kind in zip(columns, (np.int32, np.int64, np.float64, np.uint8, np.float64)))
    raw = raw.reshape(-1, fold.size) if raw.size else np.broadcast_to(0.0, (1 << 16, fold.size))
    return fold, h, y.reshape(n_labels, -1), bins.reshape(-1, fold.size), raw


def _packed(fold: np.ndarray, h: np.ndarray, y: np.ndarray, bins: np.ndarray, raw: np.ndarray) -> list[pa.Array]:
    """One record of the state table, but for its keys."""
    return [_binary(np.ascontiguousarray(x).reshape(1, -1)) for x in (fold, h, y, bins, raw)]


#: columns of the state table: the keys, and what is known of their rows, with one line per label, column and model in the last three
KEYS, PACKED = "keys", ("fold", "h", "y", "bins", "raw")
#: rows of the opened table that are handed over at once
OPENED_ROWS = 8192


def _read(batches, n_labels: int):
    """(fold, h, labels, bins, raw) of each block, whether records are blocks or, unpacked, rows after their key."""
    batches = iter(batches)
    for batch in batches:
        if batch.num_columns == len(PACKED):
            yield from (_unpacked([c[i] for c in batch.columns], n_labels) for i in range(batch.num_rows))
        else:
            yield from (_loose(b, n_labels) for b in _blocks(chain([batch], batches)))


@lru_cache(1024)
def _groups(sizes: tuple[int, ...], cells: int) -> list[list[int]]:
    """Features that are counted together, smallest with smallest, up to so many combinations of bins."""
    held: list[list[int]] = []
    for j in sorted(range(len(sizes)), key=lambda j: (sizes[j], j)):
        if held and math.prod(sizes[i] for i in held[-1]) * sizes[j] <= cells:
            held[-1].append(j)
        else:
            held.append([j])
    return held


@lru_cache(1024)
def _bundles(sizes: tuple[int, ...]) -> list[tuple[list[int], np.ndarray]]:
    """Features that are counted together up to CELLS combinations of bins, and the 0/1 matrix that adds combinations up to
    the bins of each."""
    out = []
    for bundle in _groups(sizes, CELLS):
        own = [sizes[j] for j in bundle]
        bins = np.unravel_index(np.arange(math.prod(own)), own)
        out.append((bundle, np.concatenate([np.eye(n)[at] for n, at in zip(own, bins)], 1)))
    return out


def _together(turned: np.ndarray, columns: Sequence[int], sizes: Sequence[int]) -> np.ndarray:
    """The combination of bins of each row, the last column fastest."""
    if len(columns) == 1:
        return turned[columns[0]]
    out = turned[columns[0]].astype(np.uint16)
    for column, size in zip(columns[1:], sizes[1:]):
        out *= np.uint16(size)
        out += turned[column]
    return out


def _span(use: np.ndarray) -> tuple[slice, np.ndarray]:
    """The stretch from the first row to use to the last, and which rows in it are used. Blocks are ordered for this."""
    at = np.flatnonzero(use)
    rows = slice(int(at[0]), int(at[-1]) + 1) if at.size else slice(0, 0)
    return rows, use[rows]


def _sums(work: _Work, m: int, rows: slice, use: np.ndarray, y: np.ndarray, raw: np.ndarray, turned: np.ndarray, joint: dict[tuple, np.ndarray]) -> np.ndarray:
    """(3, open nodes, cells): the sums of one model over those of the ``rows`` to ``use``. Others and those in closed nodes go to
    a node after the last, which is left out at the end: that costs less than taking rows out of each column. ``joint`` keeps
    the combined bins of the block for the models that follow."""
    y, raw, whole, turned = y[rows], raw[:, rows], turned, turned[:, rows]
    spec, nodes, columns, starts = work.specs[m], work.nodes[m], work.columns[m], work.starts[m]
    sizes = tuple(np.diff(starts).tolist())
    place = np.full(work.current[m].feature.size, len(nodes), np.int64)
    place[nodes] = np.arange(len(nodes))
    at = place.take(work.current[m].places(turned, columns))
    at[~use] = len(nodes)
    score = work.score(m, turned, raw)
    out = np.zeros((3, len(nodes), int(starts[-1])))
    if spec.loss == "quantile":
        at += (y > score) * (len(nodes) + 1)   # the gradient has two values, so two counts are enough
    else:
        g, d = work.gradient(m, y, score)
    cell, first = np.empty_like(at), {}
    for bundle, apart in _bundles(sizes):
        own, wide = [sizes[j] for j in bundle], len(apart)
        key = (*(int(columns[j]) for j in bundle), *own)
        if key not in joint:
            joint[key] = _together(whole, key[:len(bundle)], own)
        if wide not in first:
            first[wide] = at * wide
        np.add(first[wide], joint[key][rows], out=cell)
        size = (len(nodes) + 1) * wide
        if spec.loss == "quantile":
            below, over = np.bincount(cell, None, 2 * size).reshape(2, -1, wide)[:, :-1].astype(np.float64)
            found = np.stack([(1.0 - spec.quantile) * below - spec.quantile * over, below + over])
        else:
            # where all second derivatives are 1 their sums are the counts
            parts = [np.bincount(cell, g, size), np.bincount(cell, None, size), *([np.bincount(cell, d, size)] if spec.loss == "log" else [])]
            found = np.stack(parts).reshape(len(parts), -1, wide)[:, :-1]
        if len(bundle) > 1:
            found = found @ apart
        found = found[[0, 2 if len(found) > 2 else 1, 1]]
        for j, end in zip(bundle, np.cumsum(own).tolist()):
            out[:, :, starts[j]:starts[j + 1]] = found[:, :, end - sizes[j]:end]
    return out


def _histograms(work: _Work, n_labels: int):
    """One row per model and open node: sums of gradient, second derivative and rows by feature and bin."""
    groups: dict[tuple, list[int]] = {}
    for m, nodes in enumerate(work.nodes):
        if nodes:
            groups.setdefault((work.labels[m], work.specs[m].held_out), []).append(m)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for fold, h, labels, turned, raw in _read(batches, n_labels):
            joint: dict[tuple, np.ndarray] = {}
            draw = work.draw(h) if any(work.specs[m].subsample < 1.0 for models in groups.values() for m in models) else None
            for (label, held_out), models in groups.items():
                rows, use = _span(work.trained(models[0], fold, labels[label]))
                for m in models if use.any() else ():
                    drawn = use & (draw[rows] < work.specs[m].subsample) if work.specs[m].subsample < 1.0 else use
                    part = _sums(work, m, rows, drawn, labels[label], raw, turned, joint)
                    if m in sums:
                        sums[m] += part
                    else:
                        sums[m] = part
        for m, part in sums.items():
            each = part.transpose(1, 0, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array([m] * len(each), pa.int32()), pa.array(work.nodes[m], pa.int32()), _binary(each.reshape(len(each), -1))], names=["model", "node", "sums"])
    return run


def best_split(sums: np.ndarray, starts: np.ndarray, ridge: float = RIDGE, min_rows: int = MIN_ROWS):
    """(gain, feature, bin, left sums, right sums) of (3, cells) sums, whose features begin at ``starts``; feature -1 where no
    split gains."""
    upto = np.cumsum(sums, axis=1)
    whole = upto[:, starts[1] - 1:starts[1]]
    before = np.concatenate([np.zeros((3, 1)), upto[:, starts[1:-1] - 1]], 1)
    left = upto - np.repeat(before, np.diff(starts), 1)
    right = whole - left

    def worth(part):
        return part[0] ** 2 / (part[1] + ridge)

    gain = worth(left) + worth(right) - worth(whole)
    gain[(left[2] < min_rows) | (right[2] < min_rows)] = -np.inf
    # equal gains up to rounding go to the first feature and bin
    best = gain.max()
    if not best > 1e-9:
        return 0.0, -1, 0, whole[:, 0], whole[:, 0]
    cell = int(np.flatnonzero(gain >= best - 1e-9 * max(1.0, best))[0])
    feature = int(np.searchsorted(starts, cell, "right")) - 1
    return float(best), feature, cell - int(starts[feature]), left[:, cell], right[:, cell]


def _schema(**columns: type[T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind()) for name, kind in columns.items()])


_SUMS = _schema(model=T.IntegerType, node=T.IntegerType, sums=T.BinaryType)
_BUCKETS = _schema(model=T.IntegerType, leaf=T.IntegerType, bucket=T.BinaryType, n=T.BinaryType)
_RANKS = _schema(model=T.IntegerType, leaf=T.IntegerType, at=T.IntegerType, rank=T.LongType)


def _totals(batches):
    """Adds the tasks' sums up."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for m, node, data in zip(*(c.to_pylist() for c in batch.columns)):
            part = np.frombuffer(data, np.float64)
            total[m, node] = total[m, node] + part if (m, node) in total else part
    for (m, node), sums in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([node], pa.int32()), _binary(sums.reshape(1, -1))], names=_SUMS.names)


def _ordered(x: np.ndarray) -> np.ndarray:
    """32-bit numbers in the order of the floats."""
    u = x.astype(np.float32).view(np.uint32)
    return np.where(u >> 31 == 1, ~u, u | np.uint32(1 << 31))


def _unordered(u: int) -> float:
    return float(np.array([u & 0x7FFFFFFF if u >> 31 else ~u & 0xFFFFFFFF], np.uint32).view(np.float32)[0])


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with how often each occurs; plain numbers sort much faster than with their places."""
    key = np.sort(key)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if key.size else np.zeros(0, np.int64)
    return key[first], np.diff(np.r_[first, key.size])


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if key.size else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if key.size else n


def _residual_counts(work: _Work, n_labels: int, models: list[int], prefix: dict[tuple[int, int], int] | None):
    """Counts of the residuals' upper 16 bits by model and leaf, or of the lower ones below a known upper half. Only
    buckets that occur are held, as leaf << 16 | bucket."""
    wanted = {m: np.full(work.current[m].feature.size, -1, np.int64) for m in models}
    for (m, at), upper in (prefix or {}).items():
        wanted[m][at] = upper

    def run(batches):
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {m: [] for m in models}
        for fold, _, labels, turned, raw in _read(batches, n_labels):
            for m in models:
                y = labels[work.labels[m]]
                rows, use = _span(work.trained(m, fold, y))
                u = _ordered((y[rows] - work.score(m, turned[:, rows], raw[:, rows]))[use]).astype(np.int64)
                leaf = work.current[m].places(turned[:, rows], work.columns[m])[use].astype(np.int64)
                if prefix is None:
                    key = leaf << 16 | u >> 16
                else:
                    inside = u >> 16 == wanted[m][leaf]
                    key = (leaf << 16 | u & 0xFFFF)[inside]
                parts = held[m]
                parts.append(_counted(key))
                if sum(len(k) for k, _ in parts[1:]) > len(parts[0][0]):   # added up whenever their length has doubled
                    held[m] = [_added(*zip(*parts))]
        for m, parts in held.items():
            if not parts:
                continue
            key, n = _added(*zip(*parts))
            leaves, first = np.unique(key >> 16, return_index=True)
            pieces = list(zip(np.split(key & 0xFFFF, first[1:]), np.split(n, first[1:]))) if leaves.size else []
            if pieces:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m] * len(pieces), pa.int32()), pa.array(leaves, pa.int32()), pa.array([k.astype("<u2").tobytes() for k, _ in pieces], pa.binary()),
                     pa.array([c.astype("<i8").tobytes() for _, c in pieces], pa.binary())], names=["model", "leaf", "bucket", "n"])
    return run


def _selected(ranks: dict[tuple[int, int], int] | None, shares: dict[int, float]):
    """Per model and leaf: the bucket of the wanted rank and the rank inside it. Unknown ranks are the share's place."""
    def run(batches):
        total: dict[tuple[int, int], tuple[list, list]] = {}
        for batch in batches:
            for m, leaf, bucket, n in zip(*(c.to_pylist() for c in batch.columns)):
                keys, counts = total.setdefault((m, leaf), ([], []))
                keys.append(np.frombuffer(bucket, "<u2"))
                counts.append(np.frombuffer(n, "<i8"))
                if sum(map(len, keys)) > 1 << 18:   # distinct buckets are at most a quarter of that
                    total[m, leaf] = tuple([part] for part in _added(keys, counts))
        rows = []
        for (m, leaf), parts in total.items():
            bucket, n = _added(*parts)
            upto = np.cumsum(n)
            rank = max(1, math.ceil(shares[m] * int(upto[-1]))) if ranks is None else ranks[m, leaf]
            at = int(np.searchsorted(upto, rank, "left"))
            rows.append((m, leaf, int(bucket[at]), rank - int(upto[at] - n[at])))
        if rows:
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["model", "leaf", "at", "rank"])
    return run


@dataclass
class Grown:
    """Fitted models with what they need to score: trees, base scores, layout and category tables."""

    specs: list[Spec]
    layout: Layout
    tables: dict[str, DataFrame]
    trees: list[list[Tree]]
    base: list[float]
    key: str
    state: DataFrame | None = None
    #: scores after so many trees, where they were asked for
    snapshots: dict[int, DataFrame] = field(default_factory=dict)

    def columns(self, m: int) -> np.ndarray:
        return _columns(self.specs[m], self.layout)

    def names(self, m: int) -> list[str]:
        return _names(self.specs[m], self.layout)

    def index(self, name: str, held_out: int | None = None) -> int:
        return next(i for i, s in enumerate(self.specs) if s.name == name and s.held_out == held_out)

    def held_out(self, name: str, score: str, after: int | None = None) -> DataFrame:
        """(key, fold, label, score) of all rows, each by the model that was not trained on its fold. ``after`` reads the
        scores at a checkpoint of so many trees."""
        state = self.state if after is None else self.snapshots[after]
        by_fold = {s.held_out: i for i, s in enumerate(self.specs) if s.name == name and s.held_out is not None}
        spec = self.specs[next(iter(by_fold.values()))]
        at = F.element_at(F.create_map(*[F.lit(x) for f, i in sorted(by_fold.items()) for x in (f, i)]), F.col("fold"))
        raw = F.get(F.col("scores"), at)
        return state.select(self.key, "fold", spec.label, (1 / (1 + F.exp(-raw)) if spec.loss == "log" else raw).alias(score))

    def score(self, df: DataFrame, wanted: dict[str, str]) -> DataFrame:
        """``df`` with one column per entry of ``wanted`` (model without held-out fold -> column name). Rows with a ``fold``
        are rows of the training table: their statistics leave their own fold out, as they did in training."""
        numbers = [self.index(name) for name in wanted]
        work = _Work(self.specs, [self.columns(m) for m in range(len(self.specs))], [], [], self.trees, [], [], 0)
        layout, base, logs = self.layout, self.base, [self.specs[m].loss == "log" for m in numbers]

        def run(batches):
            for batch in batches:
                x = _lists(batch.column(1), layout.width)
                turned = _turned(_bin(x, layout))
                out = []
                for m, log in zip(numbers, logs):
                    raw = work.score(m, turned, np.broadcast_to(base[m], (m + 1, len(x))))
                    out.append(pa.array(1.0 / (1.0 + np.exp(-raw)) if log else raw))
                yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=[batch.schema.names[0], *wanted.values()])

        columns, marks = df.columns, F.struct(*[F.col(c) for c in df.columns])
        rows = encode(df.select(marks.alias("_row"), "*"), self.layout, self.tables, "_row", []).select("_row", "x")
        schema = T.StructType([rows.schema["_row"], *[T.StructField(c, T.DoubleType()) for c in wanted.values()]])
        return rows.mapInArrow(run, schema).select(*[F.col(f"_row.{c}").alias(c) for c in columns], *wanted.values())

    def importances(self, name: str, held_out: int | None = None) -> list[tuple[str, float]]:
        """Share of the total gain by feature, greatest first."""
        m = self.index(name, held_out)
        names = self.names(m)
        gains = dict.fromkeys(names, 0.0)
        for tree in self.trees[m]:
            for f, gain in zip(tree.feature.tolist(), tree.gain.tolist()):
                if f >= 0:
                    gains[names[f]] += gain
        total = sum(gains.values()) or 1.0
        return sorted(((f, g / total) for f, g in gains.items()), key=lambda x: (-x[1], x[0]))

    def save(self, path: str) -> None:
        spark = next(iter(self.tables.values())).sparkSession
        nodes = [(m, t, [int(f) for f in tree.feature], [int(c) for c in tree.cut], tree.value.tolist(), tree.gain.tolist())
                 for m, trees in enumerate(self.trees) for t, tree in enumerate(trees)]
        spark.createDataFrame(nodes, "model int, tree int, feature array<int>, cut array<int>, value array<double>, gain array<double>").coalesce(1).write.parquet(f"{path}/trees")
        head = {"specs": [vars(s) for s in self.specs], "base": self.base, "key": self.key,
                "layout": vars(self.layout) | {"counted": [vars(c) for c in self.layout.counted]}}
        spark.createDataFrame([(json.dumps(head),)], "head string").coalesce(1).write.parquet(f"{path}/head")
        for category, table in self.tables.items():
            table.write.parquet(f"{path}/categories/{category}")
        if self.state is not None:
            self.state.write.parquet(f"{path}/state")

    @classmethod
    def load(cls, spark, path: str, state: bool = True) -> Grown:
        """What ``save`` wrote; without ``state`` the scores of the training rows are left out."""
        head = json.loads(spark.read.parquet(f"{path}/head").first().head)
        specs = [Spec(**s | {"features": tuple(s["features"]) if s["features"] is not None else None}) for s in head["specs"]]
        raw = head["layout"]
        layout = Layout(raw["folds"], tuple(raw["numeric"]), tuple(raw["categories"]), tuple(Counted(**c) for c in raw["counted"]),
                        tuple(raw["labels"]), {k: tuple(v) for k, v in raw["totals"].items()}, raw["cuts"])
        trees: list[list[Tree]] = [[] for _ in specs]
        for r in spark.read.parquet(f"{path}/trees").orderBy("model", "tree").collect():
            trees[r.model].append(Tree(np.array(r.feature, np.int16), np.array(r.cut, np.int16), np.array(r.value), np.array(r.gain)))
        tables = {c: spark.read.parquet(f"{path}/categories/{c}") for c in layout.categories}
        return cls(specs, layout, tables, trees, head["base"], head["key"], spark.read.parquet(f"{path}/state") if state else None)


def _names(spec: Spec, layout: Layout) -> list[str]:
    known = layout.features(spec.label)
    return known if spec.features is None else [f for f in known if f in spec.features]


def _columns(spec: Spec, layout: Layout) -> np.ndarray:
    return np.array([layout.column(f, spec.label, spec.held_out) for f in _names(spec, layout)])


def _binned(layout: Layout, labels: Sequence[str], key: str):
    """mapInArrow: encoded rows to blocks of bins, without scores. The keys of a block are one binary value."""
    n_labels = len(labels)

    def block(held):
        keys, folds, hashes, y, bins = zip(*held)
        fold, y = np.concatenate(folds), np.concatenate(y, 1)
        order = np.lexsort([fold, np.isnan(y).all(0)])   # by fold, rows without a label last: what a model leaves out is often an end
        values = pa.record_batch([pa.concat_arrays(keys).take(pa.array(order))], [key])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, values.schema) as out:
            out.write_batch(values)
        columns = _packed(fold[order], np.concatenate(hashes)[order], y[:, order], np.concatenate(bins, 1)[:, order], np.zeros((0, len(fold))))
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), *columns], names=[KEYS, *PACKED])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            fold = pc.fill_null(batch.column(1), -1).to_numpy(zero_copy_only=False).astype(np.int32)
            bins = _bin(_lists(batch.column(3 + n_labels), layout.width), layout)
            held.append((batch.column(0), fold, batch.column(2).to_numpy(), _doubles(batch.columns[3:3 + n_labels]).T, _turned(bins)))
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                yield block(held)
                held, rows = [], 0
        if rows:
            yield block(held)
    return run


def _advanced(work: _Work, n_labels: int):
    """The state with the pending trees added to its scores."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                _, _, _, turned, raw = _unpacked([c[i] for c in batch.columns[1:]], n_labels)
                new = np.stack([work.score(m, turned, raw) for m in range(len(work.specs))])
                yield pa.RecordBatch.from_arrays([*[c.slice(i, 1) for c in batch.columns[:-1]], _binary(new.reshape(1, -1))], names=batch.schema.names)
    return run


def _opened(state: DataFrame, labels: Sequence[str], key: T.StructField) -> DataFrame:
    """(key, fold, labels ..., scores) of each row of the state; a missing fold and a missing label are null again."""
    names = [key.name, "fold", *labels]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                fold, _, y, _, raw = _unpacked([c[i] for c in batch.columns[1:]], len(labels))
                keys = pa.ipc.open_stream(batch.column(0)[i].as_buffer()).read_next_batch().column(0)
                for at in range(0, fold.size, OPENED_ROWS):
                    rows = slice(at, at + OPENED_ROWS)
                    flat = np.ascontiguousarray(raw[:, rows].T).ravel()
                    values = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, len(raw)), pa.int32()), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([keys[rows], pa.array(fold[rows], mask=fold[rows] < 0), *[pa.array(v, mask=np.isnan(v)) for v in y[:, rows]], values],
                                                     names=[*names, "scores"])

    schema = T.StructType([key, T.StructField("fold", T.IntegerType()), *[T.StructField(y, T.DoubleType()) for y in labels],
                           T.StructField("scores", T.ArrayType(T.DoubleType()))])
    return state.mapInArrow(run, schema)


# ---------------------------------------------------------------------- engines
_STATE = T.StructType([T.StructField(c, T.BinaryType()) for c in (KEYS, *PACKED)])


class _Plain:
    """The state as a table, with the loops over its rows in numpy."""

    def __init__(self, state: DataFrame, n_labels: int, reducers: int):
        self.state, self.n_labels, self.reducers = stored(state, "boosting-state").persist(), n_labels, reducers

    @property
    def blocks(self) -> DataFrame:
        return self.state.select(*PACKED)

    def sums(self, work: _Work) -> dict[tuple[int, int], np.ndarray]:
        """(3, cells) sums by model and node, of the nodes that occur."""
        found = self.blocks.mapInArrow(_histograms(work, self.n_labels), _SUMS).repartition(self.reducers, "model").mapInArrow(_totals, _SUMS).collect()
        return {(r.model, r.node): np.frombuffer(r.sums).reshape(3, -1) for r in found}

    def ranks(self, work: _Work, models: list[int], prefix: dict | None, ranks: dict | None) -> dict[tuple[int, int], tuple[int, int]]:
        """By model and leaf, the 16-bit half of the residuals that holds the wanted rank, and the rank in it."""
        shares = {m: work.specs[m].quantile for m in models}
        counts = self.blocks.mapInArrow(_residual_counts(work, self.n_labels, models, prefix), _BUCKETS)
        found = counts.repartition(self.reducers, "model", "leaf").mapInArrow(_selected(ranks, shares), _RANKS).collect()
        return {(r.model, r.leaf): (r.at, r.rank) for r in found}

    def advance(self, work: _Work) -> None:
        before, self.state = self.state, stored(self.state.mapInArrow(_advanced(work, self.n_labels), self.state.schema), "boosting-state").persist()
        before.unpersist()

    def table(self) -> DataFrame:
        return self.state

    def close(self) -> None:
        self.state.unpersist()


class _Compiled:
    """The state as an RDD of blocks, kept by the executors in memory as far as there is room and else on their disks."""

    def __init__(self, state: DataFrame, n_labels: int, reducers: int):
        self.spark, self.n_labels, self.reducers = state.sparkSession, n_labels, reducers
        self.tool = native.tasks(self.spark)
        shared_dir(self.spark)   # where steps are written
        self.before: list = []
        self.written: list[str] = []
        self.steps = 0
        self._hold(state._jdf.toJavaRDD(), True)

    def _hold(self, rdd, write: bool) -> None:
        self.rdd = rdd.persist(self.spark.sparkContext._getJavaStorageLevel(StorageLevel.MEMORY_AND_DISK))
        if write:
            self.rdd.checkpoint()

    def _settled(self) -> None:
        """After a job over the current step the one before it is let go, on disk only when this one is written."""
        for rdd in self.before:
            rdd.unpersist()
        self.before = []
        if self.rdd.isCheckpointed() and (path := self.rdd.getCheckpointFile().get()) not in self.written:
            for old in self.written:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(old)
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            self.written = [path]

    def _records(self, rdd) -> list[bytes]:
        found = RDD(rdd, self.spark.sparkContext, NoOpSerializer()).collect()
        self._settled()
        return found

    def sums(self, work: _Work) -> dict[tuple[int, int], np.ndarray]:
        out = {}
        for record in self._records(self.tool.sums(self.rdd, _plan(work, self.n_labels), self.reducers)):
            m = int(np.frombuffer(record, np.int64, 1)[0])
            each = np.frombuffer(record, np.float64, offset=8).reshape(3, len(work.nodes[m]), -1)
            out |= {(m, node): each[:, i] for i, node in enumerate(work.nodes[m])}
        return out

    def ranks(self, work: _Work, models: list[int], prefix: dict | None, ranks: dict | None) -> dict[tuple[int, int], tuple[int, int]]:
        wanted = {m: [((prefix or {}).get((m, leaf), -1), (ranks or {}).get((m, leaf), 0)) for leaf in range(work.current[m].feature.size)] for m in models}
        found = self._records(self.tool.ranks(self.rdd, _plan(work, self.n_labels, wanted), self.reducers))
        return {(m, leaf): (at, rank) for m, leaf, at, rank in (np.frombuffer(r, np.int64).tolist() for r in found)}

    def advance(self, work: _Work) -> None:
        self.steps += 1
        self.before.append(self.rdd)
        self._hold(self.tool.advanced(self.rdd, _plan(work, self.n_labels)), self.steps % WRITTEN == 0)

    def table(self) -> DataFrame:
        java = self.spark._jsparkSession
        return DataFrame(java.createDataFrame(self.rdd, java.parseDataType(_STATE.json())), self.spark)

    def close(self) -> None:
        self._settled()
        self.rdd.unpersist()


def _ints(values) -> bytes:
    return struct.pack("<i", len(values)) + np.asarray(values, "<i4").tobytes()


def _plan(work: _Work, n_labels: int, wanted: dict[int, list[tuple[int, int]]] | None = None) -> bytearray:
    """What BlockTasks.Plan reads. ``wanted`` holds (upper half or -1, rank or 0) by leaf of the models whose residuals are counted."""
    def tree(t: Tree, columns: np.ndarray) -> bytes:
        column = np.where(t.feature >= 0, columns[np.maximum(t.feature, 0)], -1)
        return _ints(column) + t.cut.astype("<i4").tobytes() + t.value.astype("<f8").tobytes()

    salt = (work.number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    out = [struct.pack("<iQi", n_labels, salt, len(work.specs))]
    for m, spec in enumerate(work.specs):
        columns, sizes, rate = work.columns[m], np.diff(work.starts[m]).tolist(), work.rates[m]
        weights = (0.5 / rate, 0.5 / (1.0 - rate)) if spec.balanced else (1.0, 1.0)
        out += [struct.pack("<iii4d", ("log", "square", "quantile").index(spec.loss), work.labels[m], -1 if spec.held_out is None else spec.held_out,
                            spec.subsample, spec.quantile, *weights), _ints(work.starts[m]), _ints(work.nodes[m])]
        bundles = _groups(tuple(sizes), max(CELLS, WIDE_CELLS // max(1, len(work.nodes[m]))) if len(work.nodes[m]) < 3 else CELLS)
        out.append(struct.pack("<i", len(bundles)))
        for bundle in bundles:
            out += [_ints(bundle), np.asarray(columns[bundle], "<i4").tobytes(), np.asarray([sizes[j] for j in bundle], "<i4").tobytes()]
        out += [struct.pack("<i", len(work.pending[m])), *[tree(t, columns) for t in work.pending[m]], tree(work.current[m], columns)]
        own = (wanted or {}).get(m, [])
        out += [_ints([half for half, _ in own]), np.asarray([rank for _, rank in own], "<i8").tobytes()]
    return bytearray(b"".join(out))


def _engine(spark) -> type:
    try:
        native.tasks(spark)
        return _Compiled
    except Exception as error:   # whatever keeps a session from compiling or loading classes
        logging.getLogger(__name__).warning("trees are grown in numpy, which is slower: %s", error)
        return _Plain


# ------------------------------------------------------------------------ grow
def grow(df: DataFrame, specs: Sequence[Spec], numeric: Sequence[str], categories: Sequence[str], folds: int, key: str = "id",
         counted: Sequence[Counted] = (), snapshots: Sequence[int] = (), engine: type | None = None) -> Grown:
    """Fit all ``specs`` on ``df``, which has ``fold`` (0 to folds - 1) and the labels, and keep the scores of its rows."""
    specs = list(specs)
    labels = tuple(dict.fromkeys(s.label for s in specs))
    spark = df.sparkSession
    df = stored(df, "boosting-rows")
    sums = df.groupBy("fold").agg(F.count("*").alias("rows"), *[F.count(y).alias(f"n_{y}") for y in labels], *[F.sum(F.col(y).cast("double")).alias(f"s_{y}") for y in labels]).collect()
    totals = {y: tuple([float(sum((r[f"{p}_{y}"] or 0) for r in sums if r.fold == f)) for f in range(folds)] for p in ("n", "s")) for y in labels}
    layout = Layout(folds, tuple(numeric), tuple(categories), tuple(counted), labels, totals)
    tables = {c: stored(category_counts(df, c, labels, folds), "categories") for c in categories}
    encoded = stored(encode(df, layout, tables, key, labels), "boosting-values")
    layout.cuts = _cut_points(encoded, layout)
    rows = sum(r.rows for r in sums)
    tasks = max(1, min(spark.sparkContext.defaultParallelism, rows // SMALL_ROWS), math.ceil(rows / TASK_ROWS))
    reducers = max(1, min(math.ceil(len(specs) / 4), spark.sparkContext.defaultParallelism))
    packed = encoded.repartition(tasks, "h").mapInArrow(_binned(layout, labels, key), _STATE)
    state = (engine or _engine(spark))(packed, len(labels), reducers)

    rates = [(t := totals[s.label]) and sum(t[1][f] for f in range(folds) if f != s.held_out) / max(1.0, sum(t[0][f] for f in range(folds) if f != s.held_out)) for s in specs]
    columns = [_columns(s, layout) for s in specs]
    work = _Work(specs, columns, [labels.index(s.label) for s in specs], [min(max(r, 1e-6), 1 - 1e-6) for r in rates], [[] for _ in specs], [Tree.of(0) for _ in specs],
                 [[] for _ in specs], 0, [np.cumsum([0, *[len(layout.cuts[layout.key(c)]) + 1 for c in cols]]) for cols in columns])
    by_quantile = [m for m, s in enumerate(specs) if s.loss == "quantile"]

    def leaf_quantiles(models: list[int]) -> dict[tuple[int, int], float]:
        upper = state.ranks(work, models, None, None)
        lower = state.ranks(work, models, {k: at for k, (at, _) in upper.items()}, {k: rank for k, (_, rank) in upper.items()})
        return {k: _unordered((upper[k][0] << 16) | lower[k][0]) for k in lower}

    quantiles = leaf_quantiles(by_quantile) if by_quantile else {}
    base = []
    for m, s in enumerate(specs):
        r = work.rates[m]
        base.append(0.0 if s.loss == "log" and s.balanced else math.log(r / (1 - r)) if s.loss == "log" else rates[m] if s.loss == "square" else quantiles.get((m, 0), 0.0))
        root = Tree.of(0)
        root.value[0] = base[m]
        work.pending[m].append(root)

    trees: list[list[Tree]] = [[] for _ in specs]
    opened: dict[int, DataFrame] = {}
    key_field = encoded.schema[key]
    last = max(s.trees for s in specs)
    for number in range(last):
        growing = [m for m, s in enumerate(specs) if number < s.trees]
        work = replace(work, number=number, current=[Tree.of(s.depth) for s in specs])
        for m, tree in _grown_trees(state, work, growing).items():
            trees[m].append(tree)
            work.current[m] = tree
        refilled = [m for m in by_quantile if m in growing]
        if refilled:
            for (m, leaf), value in leaf_quantiles(refilled).items():
                work.current[m].value[leaf] = specs[m].step * value
        for m in growing:
            work.pending[m].append(work.current[m])
        if (number + 1) % EVERY == 0 or number + 1 == last or number + 1 in snapshots:
            state.advance(work)
            work = replace(work, pending=[[] for _ in specs])
            if number + 1 in snapshots:
                opened[number + 1] = stored(_opened(state.table(), labels, key_field), "boosting-scores")
    scores = opened.get(last)
    if scores is None:
        scores = stored(_opened(state.table(), labels, key_field), "boosting-scores")
    state.close()
    return Grown(specs, layout, tables, trees, base, key, scores, opened)


def _grown_trees(state: _Plain | _Compiled, work: _Work, growing: list[int]) -> dict[int, Tree]:
    """One tree of each growing model, level by level."""
    specs, trees = work.specs, {m: work.current[m] for m in growing}
    open_nodes: dict[tuple[int, int], tuple[int, np.ndarray] | None] = {(m, 0): None for m in growing}   # node -> sibling that is counted and the parent's sums
    counted = {(m, 0) for m in growing}
    while open_nodes:
        nodes: list[list[int]] = [[] for _ in specs]
        for m, node in sorted(counted):
            nodes[m].append(node)
        found = state.sums(replace(work, nodes=nodes))
        after: dict[tuple[int, int], tuple[int, np.ndarray] | None] = {}
        counted = set()
        for (m, node), rest in sorted(open_nodes.items()):
            if rest is not None:
                sibling, parent = rest
                sums = parent - found[m, sibling] if (m, sibling) in found else parent
            elif (m, node) in found:
                sums = found[m, node]
            else:
                continue
            tree, spec = trees[m], specs[m]
            gain, feature, cut, left, right = best_split(sums, work.starts[m])
            if feature < 0:
                g, d, _ = sums[:, :work.starts[m][1]].sum(1)
                tree.value[node] = -spec.step * g / (d + RIDGE)
                continue
            tree.feature[node], tree.cut[node], tree.gain[node] = feature, cut, gain
            children = [(2 * node + 1, left), (2 * node + 2, right)]
            for child, (g, d, _) in children:
                tree.value[child] = -spec.step * g / (d + RIDGE)
            (small, few), (large, many) = sorted(children, key=lambda c: (c[1][2], c[0]))
            if many[2] >= 2 * MIN_ROWS and 2 * large + 2 < tree.feature.size:
                after[m, large] = (small, sums)
                counted.add((m, small))
                if few[2] >= 2 * MIN_ROWS:
                    after[m, small] = None
        open_nodes = after
    return trees
