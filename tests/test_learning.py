"""Boosted trees against a plain grower, cross-fitted statistics, quantile leaves, the search, calibration and the model queries."""

import inspect
import math
import os
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from roadwatch.operators import boosting as B, calibration as K, evaluation as V, learning as L, neighbours as N, ranking
from roadwatch.plans import learning as P, registry


# ---------------------------------------------------------------- plain grower
def plain_statistic(rows, value, own, held_out, label):
    """Blended mean of a category over the rows whose fold is neither the row's own nor the one held out."""
    seen = [r for r in rows if r["fold"] not in (own, held_out) and r[label] is not None]
    prior = sum(r[label] for r in seen) / len(seen)
    hit = [r[label] for r in seen if r["cat"] == value]
    mean = sum(hit) / len(hit) if hit else prior
    return prior + (mean - prior) / (1 + math.exp(-(len(hit) - 20) / 20))


def plain_tree(rows, values, cuts, g, h, depth, step, min_rows=B.MIN_ROWS):
    """Greedy tree over lists; returns a function of one row's values."""
    G, H = sum(g), sum(h)
    best = (1e-9, None)
    if depth:
        for j, limits in enumerate(cuts):
            for c in limits:
                left = [i for i in range(len(rows)) if values[i][j] <= c]
                if min(len(left), len(rows) - len(left)) < min_rows:
                    continue
                gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                gain = gl ** 2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G ** 2 / (H + 1)
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, (j, c))
    if best[1] is None:
        return lambda v: -step * G / (H + 1)
    j, c = best[1]
    sides = []
    for right in (False, True):
        at = [i for i in range(len(rows)) if (values[i][j] > c) == right]
        sides.append(plain_tree([rows[i] for i in at], [values[i] for i in at], cuts, [g[i] for i in at], [h[i] for i in at], depth - 1, step))
    return lambda v: sides[v[j] > c](v)


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        cat, a, b = rng.choice("pqrs"), rng.randrange(12), rng.random()
        p = 0.15 + 0.4 * (cat == "p") + 0.3 * (a > 6) * (b < 0.5)
        rows.append({"id": i, "fold": rng.randrange(3), "cat": cat, "a": a, "b": round(b, 2), "y": int(rng.random() < p), "z": a + rng.gauss(0, 2) if i % 9 else None})
    return rows, spark.createDataFrame([tuple(r.values()) for r in rows], "id long, fold int, cat string, a int, b double, y int, z double").repartition(3)


@pytest.mark.parametrize("held_out, balanced, loss, label", [(1, True, "log", "y"), (None, False, "log", "y"), (2, False, "square", "z")])
def test_trees_equal_a_plain_grower(made, held_out, balanced, loss, label):
    rows, df = made
    grown = B.grow(df, [B.Spec("m", label, loss, held_out, trees=3, depth=3, balanced=balanced)], ["a", "b"], ["cat"], 3)
    values = [[r["a"], r["b"], plain_statistic(rows, r["cat"], r["fold"], held_out, label)] for r in rows]
    cuts = [grown.layout.cuts[c] for c in ("a", "b", f"cat:{label}")]
    used = [i for i, r in enumerate(rows) if r["fold"] != held_out and r[label] is not None]
    rate = sum(rows[i][label] for i in used) / len(used)
    base = 0.0 if balanced else rate if loss == "square" else math.log(rate / (1 - rate))
    score = [base] * len(rows)
    for _ in range(3):
        g, h = [], []
        for i in used:
            y = rows[i][label]
            p = 1 / (1 + math.exp(-score[i])) if loss == "log" else score[i]
            w = (0.5 / rate if y else 0.5 / (1 - rate)) if balanced else 1.0
            g.append(w * (p - y))
            h.append(w * p * (1 - p) if loss == "log" else 1.0)
        tree = plain_tree(used, [values[i] for i in used], cuts, g, h, 3, 0.1)
        score = [s + tree(v) for s, v in zip(score, values)]
    got = {r.id: r.scores[0] for r in grown.state.collect()}
    assert max(abs(got[r["id"]] - s) for r, s in zip(rows, score)) < 1e-9
    assert any((t.feature >= 0).any() for t in grown.trees[0])


def test_models_grow_alone_as_together_and_prefixes_hold(made):
    _, df = made
    slow = [B.Spec("a", "y", held_out=f, trees=6, depth=2, subsample=0.7) for f in range(3)]
    other = [B.Spec("b", "y", trees=2, depth=4, step=0.3), B.Spec("q", "z", "quantile", trees=3, quantile=0.8)]
    whole = B.grow(df, slow + other, ["a", "b"], ["cat"], 3, snapshots=[2])
    alone = B.grow(df, [B.Spec("a", "y", held_out=1, trees=2, depth=2, subsample=0.7)], ["a", "b"], ["cat"], 3)
    early = {r.id: r.scores for r in whole.snapshots[2].collect()}
    single = {r.id: r.scores[0] for r in alone.state.collect()}
    assert max(abs(early[i][1] - s) for i, s in single.items()) < 1e-9
    last = {r.id: r.scores for r in whole.state.collect()}
    assert all(early[i][3] == last[i][3] for i in last) and any(early[i][0] != last[i][0] for i in last)


def test_saved_models_score_alike(spark, made, tmp_path):
    _, df = made
    grown = B.grow(df, [B.Spec("m", "y", trees=4)], ["a", "b"], ["cat"], 3)
    grown.save(f"{tmp_path}/m")
    again = B.Grown.load(spark, f"{tmp_path}/m")
    new = spark.createDataFrame([(1, "p", 3, 0.5), (2, "unseen", None, None), (3, None, 100, -1.0)], "id long, cat string, a int, b double")
    scores = [sorted((r.id, r.p) for r in g.score(new, {"m": "p"}).collect()) for g in (grown, again)]
    assert scores[0] == scores[1] and all(0 < p < 1 for _, p in scores[0])
    # training rows keep their fold and get the scores of the fit
    fit = {r.id: 1 / (1 + math.exp(-r.scores[0])) for r in grown.state.collect()}
    assert all(abs(fit[r.id] - r.p) < 1e-12 for r in grown.score(df, {"m": "p"}).collect())
    assert abs(sum(v for _, v in grown.importances("m")) - 1) < 1e-9


def test_quantile_leaves_are_exact(made):
    rows, df = made
    grown = B.grow(df, [B.Spec("q", "z", "quantile", trees=2, depth=2, quantile=0.9, step=0.5)], ["a", "b"], [], 3)
    known = [r for r in rows if r["z"] is not None]
    order = lambda x: np.sort(np.array(x, np.float32))[max(1, math.ceil(0.9 * len(x))) - 1]
    assert grown.base[0] == order([r["z"] for r in known])
    columns = grown.columns(0)
    bins = B._bin(np.array([[r["a"], r["b"]] for r in known], float), grown.layout)
    score = np.full(len(known), grown.base[0])
    for tree in grown.trees[0]:
        leaf = tree.leaves(bins, columns)
        assert len(set(leaf.tolist())) > 1
        residual = np.array([r["z"] for r in known]) - score
        for at in set(leaf.tolist()):
            assert tree.value[at] == 0.5 * float(order(residual[leaf == at]))
        score = score + tree.value[leaf]


def test_leaf_counts_hold_only_what_occurs():
    """Counting residuals of 32 leaves takes memory for the buckets that occur, not 65,536 cells a leaf, and one batch a model."""
    rng = np.random.default_rng(3)
    n, models = 2000, 6
    tree = B.Tree.of(5)
    tree.feature[:31], tree.cut[:31] = np.arange(31) % 5, rng.integers(10, 50, 31)
    tree.value[:] = rng.normal(size=63)
    specs = [B.Spec("q", "z", "quantile", held_out=f, quantile=0.7) for f in range(models)]
    work = B._Work(specs, [np.arange(5)] * models, [0] * models, [0.5] * models, [[tree]] * models, [tree] * models, [[]] * models, 0)
    bins, y, fold = rng.integers(0, 64, (n, 5)).astype(np.uint8), rng.normal(size=n), rng.integers(0, models, n)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(fold, pa.int32()), pa.array(np.arange(n)), pa.array(y), B._binary(bins),
                                        B._binary(np.zeros((n, models)))], names=["id", "fold", "h", "z", "bins", "raw"])
    half = [batch.slice(0, 700), batch.slice(700)]
    tracemalloc.start()
    upper = list(B._residual_counts(work, 1, list(range(models)), None)(half))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(upper) == models and peak < 8_000_000
    shares = dict.fromkeys(range(models), 0.7)
    first = [r for b in B._selected(None, shares)(upper) for r in b.to_pylist()]
    prefix, ranks = ({(r["model"], r["leaf"]): r[c] for r in first} for c in ("at", "rank"))
    lower = B._residual_counts(work, 1, list(range(models)), prefix)(half)
    found = {(r["model"], r["leaf"]): r["at"] for b in B._selected(ranks, shares)(lower) for r in b.to_pylist()}
    leaf = tree.leaves(bins, np.arange(5))
    rows = np.flatnonzero(fold != 2)
    assert (tree.leaves(bins, np.arange(5), rows) == leaf[rows]).all() and len(set(leaf.tolist())) > 10
    residual = (y - tree.value[leaf]).astype(np.float32)
    for m, at in found:
        own = np.sort(residual[(fold != m) & (leaf == at)])
        assert B._unordered(prefix[m, at] << 16 | found[m, at]) == own[max(1, math.ceil(0.7 * own.size)) - 1]


@pytest.mark.parametrize("loss, subsample", [("log", 1.0), ("log", 0.6), ("square", 1.0), ("quantile", 1.0)])
def test_block_sums_equal_plain_sums(loss, subsample):
    """Whole columns at a time: places are leaves, and the sums of several batches are those of a loop over rows."""
    rng = np.random.default_rng(5)
    n, columns = 900, np.array([3, 0, 4])
    current, before = B.Tree.of(3), B.Tree.of(6)
    for tree, inner in ((current, [0, 1]), (before, range(63))):
        tree.feature[list(inner)], tree.cut[list(inner)] = rng.integers(0, 3, len(inner)), rng.integers(10, 50, len(inner))
        tree.value[:] = rng.normal(size=tree.value.size)
    spec = B.Spec("m", "z", loss, held_out=1, subsample=subsample, quantile=0.8)
    starts, nodes = np.array([0, 64, 128, 192]), [2, 3]
    work = B._Work([spec], [columns], [0], [0.4], [[before, before]], [current], [nodes], 7, [starts])
    bins, fold, h = rng.integers(0, 64, (n, 6)).astype(np.uint8), rng.integers(0, 3, n), rng.integers(0, 1 << 62, n)
    y = np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 2, n) if loss == "log" else rng.normal(size=n))
    raw = rng.normal(size=(n, 1))
    assert (before.places(B._turned(bins), columns) == before.leaves(bins, columns)).all()
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(fold, pa.int32()), pa.array(h), pa.array(y), B._binary(bins), B._binary(raw)],
                                       names=["id", "fold", "h", "z", "bins", "raw"])
    got = {r["node"]: np.frombuffer(r["sums"]).reshape(3, -1) for b in B._histograms(work, 1)([batch.slice(0, 400), batch.slice(400)]) for r in b.to_pylist()}
    wanted = {node: np.zeros((3, 192)) for node in nodes}
    leaf, score = current.leaves(bins, columns), raw[:, 0] + 2 * before.value[before.leaves(bins, columns)]
    g, d = work.gradient(0, y, score)
    drawn = work.drawn(0, h) if subsample < 1 else np.full(n, True)
    for i in np.flatnonzero((fold != 1) & ~np.isnan(y) & drawn):
        if leaf[i] in wanted:
            for j, c in enumerate(columns):
                wanted[leaf[i]][:, 64 * j + bins[i, c]] += (g[i], d[i], 1)
    assert set(got) == set(nodes) and all(np.allclose(got[k], wanted[k], atol=1e-9) and wanted[k][2].any() for k in nodes)


def test_missing_counts_are_zero():
    column = pa.array([[1.0, 2.0], None, [3.0, 4.0]])
    assert B._counts(column, 2).tolist() == [[1, 2], [0, 0], [3, 4]] and B._counts(column.slice(1), 2).tolist() == [[0, 0], [3, 4]]


def test_a_hundred_thousand_stations(spark):
    """A column with 100,000 values fits in 64 bins and is the feature that counts; a column of pure names gains nothing held out."""
    n = 400_000
    strong = F.pmod(F.xxhash64(F.col("station")), F.lit(10)) < 3
    df = spark.range(n).select("id", F.concat(F.lit("s"), F.col("id") % 100_000).alias("station"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)).cast("int").alias("fold"),
                               (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(7))).alias("noise"))
    df = df.withColumn("y", (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(100)) < F.when(strong, 80).otherwise(20)).cast("int"))
    grown = B.grow(df, [B.Spec("m", "y", held_out=0, trees=2, depth=2)], ["noise"], ["station"], 4)
    assert len(grown.layout.cuts["station:y"]) < B.BINS
    assert grown.importances("m", 0)[0][0] == "station"
    held = grown.state.where("fold = 0").select("y", F.col("scores")[0].alias("p")).withColumn("p", 1 / (1 + F.exp(-F.col("p"))))
    assert V.auc(held, "p", "y").first().auc > 0.65
    names = df.withColumn("y", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(2)).cast("int"))
    grown = B.grow(names, [B.Spec("m", "y", held_out=0, trees=2, depth=2)], ["noise"], ["station"], 4)
    held = grown.state.where("fold = 0").select("y", F.col("scores")[0].alias("p")).withColumn("p", 1 / (1 + F.exp(-F.col("p"))))
    assert abs(V.auc(held, "p", "y").first().auc - 0.5) < 0.02


# ----------------------------------------------------------------- calibration
def max_min(points):
    """Isotonic values of sorted (score, sum, weight) by the max-min formula."""
    n = len(points)
    mean = lambda a, b: sum(p[1] for p in points[a:b + 1]) / sum(p[2] for p in points[a:b + 1])
    return [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


def test_isotonic_equals_the_max_min_formula(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(4), round(rng.random(), 2)) for i in range(900)]
    rows = [(i, f, s, int(rng.random() < s * s)) for i, f, s in rows]
    df = spark.createDataFrame(rows, "id long, fold int, p double, y int").repartition(5)
    calibrated = {r.id: r.c for r in K.apply(df, K.fit(df, "p", "y"), "p", "c").collect()}
    crossed = {r.id: r.c for r in K.apply(df, K.fit_other_folds(df, "p", "y", 4), "p", "c", F.col("fold")).collect()}
    assert len(calibrated) == len(crossed) == len(rows)

    def fitted(used):
        points = [(s, sum(r[3] for r in used if r[2] == s), sum(r[2] == s for r in used)) for s in sorted({r[2] for r in used})]
        return [p[0] for p in points], max_min(points)

    xs, ys = fitted(rows)
    assert all(abs(calibrated[r[0]] - ys[xs.index(r[2])]) < 1e-12 for r in rows)
    for fold in range(4):
        xs, ys = fitted([r for r in rows if r[1] != fold])
        for r in rows:
            if r[1] == fold:    # scores the fit has not seen lie on the line between their neighbours
                assert abs(crossed[r[0]] - np.interp(r[2], xs, ys)) < 1e-12


def test_calibration_edges(spark):
    df = spark.createDataFrame([(1, 0.4, 1), (2, 0.4, 0), (3, None, 1), (4, 0.9, None)], "id long, p double, y int")
    out = {r.id: r.c for r in K.apply(df, K.fit(df, "p", "y"), "p", "c").collect()}
    assert out == {1: 0.5, 2: 0.5, 3: None, 4: 0.5}
    assert K.apply(df, K.fit(df.limit(0), "p", "y"), "p", "c").where("c is null").count() == 4


def test_nearby_counts_per_fold(spark):
    rng = random.Random(8)
    rows = [(i, 12.9 + rng.randrange(30) * 0.002, 77.5 + rng.randrange(30) * 0.002, rng.randrange(3), rng.randrange(2)) for i in range(250)]
    rows += [(1000 + i, 13.1, 77.6, i % 3, 1) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, fold int, y int")

    def metres(a, b):
        la, lb = math.radians(a[1]), math.radians(b[1])
        x = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6_371_000 * math.atan2(math.sqrt(x), math.sqrt(1 - x))

    got = {r.id: (list(r.n), list(r.s)) for r in N.nearby_fold_counts(df, "y", 3, "n", "s").collect()}
    for a in rows[::7]:
        near = [b for b in rows if metres(a, b) <= 500]
        assert got[a[0]] == ([sum(b[3] == f for b in near) for f in range(3)], [sum(b[4] for b in near if b[3] == f) for f in range(3)])


# --------------------------------------------------------------------- queries
def test_registered_models_have_all_trees_and_configurations():
    assert P.TREES == 100 == inspect.signature(B.Spec).parameters["trees"].default and P.CONFIGURATIONS == 20
    assert len(set(L.configurations())) == 20 and {p[0] for p in L.configurations()} == {20, 50, 100}


def test_search_is_ranked_by_held_out_auc(spark, made):
    rows, df = made
    found = L.random_search(df.drop("fold"), "y", n=6, iterations=(2, 4), numeric=["a", "b"], categories=["cat"]).collect()
    assert len(found) == 6 and all(0.5 < r.mean_auc < 1 for r in found)
    assert [r.mean_auc for r in found] == sorted((r.mean_auc for r in found), reverse=True)
    best = found[0]
    folded = ranking.stratified_folds(df.drop("fold"), "y", k=3)
    again = B.grow(folded, [B.Spec("m", "y", held_out=f, trees=best.iterations, step=best.step, depth=best.depth, subsample=best.subsample, balanced=True) for f in range(3)],
                   ["a", "b"], ["cat"], 3)
    per_fold = V.auc(again.held_out("m", "p"), "p", "y", by=["fold"]).agg(F.avg("auc")).first()[0]
    assert abs(per_fold - best.mean_auc) < 1e-9


@pytest.fixture(scope="module")
def short(spark):
    """The registered models with few trees, and artefacts of their own."""
    patch = pytest.MonkeyPatch()
    patch.setattr(P, "TREES", 6)
    patch.setattr(P, "CONFIGURATIONS", 3)
    patch.setattr(registry, "_ARTEFACTS", {})
    patch.setattr(L, "configurations", lambda n, iterations, seed: [(5, 0.1, 3, 1.0), (5, 0.05, 3, 0.7), (10, 0.1, 4, 1.0)][:n])
    yield "/root/testdata/sf0.001"
    patch.undo()


MODEL_QUERIES = ["closure_model", "oof_predictions", "isotonic_calibration", "priority_model", "priority_restricted", "priority_calibration", "predict_impact"]


@pytest.mark.parametrize("name", MODEL_QUERIES)
def test_one_row_per_incident(spark, short, name):
    out = E.queries()[name](spark, short).persist()
    ids = spark.read.parquet(f"{short}/events.parquet").count()
    assert out.count() == ids == out.select("id").distinct().count()
    for c in [c for c in out.columns if c.endswith(("_p", "_probability"))]:
        assert out.where(F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) > 1)).isEmpty()


def test_quality_queries(spark, short):
    run = lambda name: E.queries()[name](spark, short)
    cause = run("cause_only_auc").first().mean_auc
    assert run("closure_oof_quality").first().auc > cause - 0.05 and run("tuned_closure_auc").first().auc > 0.5
    assert {r.model for r in run("nearby_feature_gain").collect()} == {"closure", "closure without nearby"}
    assert 0.8 < run("duration_p90").first().coverage < 0.97
    loss = run("duration_pinball").first()
    assert loss.p90_loss < loss.conformal_p90_loss * 1.1 and loss.n > 100
    assert run("duration_p50").first().n == loss.n
    for name in ("feature_importance", "priority_importance", "duration_importance"):
        found = run(name).collect()
        assert abs(sum(r.importance for r in found) - 1) < 1e-9 and [r.importance for r in found] == sorted((r.importance for r in found), reverse=True)
    assert "nearby_closure_rate" in {r.feature for r in run("feature_importance").collect()}
    top, full = run("top_features").collect(), run("feature_importance").collect()
    assert [round(100 * r.importance, 2) for r in full[:12]] == [r.importance for r in top]
    same = run("save_models").first()
    assert same.n == same.same > 0


# ----------------------------------------------------------------- packed rows
def test_packed_blocks_count_like_loose_rows():
    """A record of the state table is a block of rows, ordered by fold with unlabelled rows last; features of few bins are counted together."""
    rng = np.random.default_rng(9)
    n, sizes = 700, [2, 3, 64, 2, 24, 7]
    columns, starts, nodes = np.arange(6), np.cumsum([0, *sizes]), [1, 2]
    assert len(B._bundles(tuple(sizes))) < len(sizes)
    tree = B.Tree.of(2)
    tree.feature[0], tree.cut[0] = 2, 30
    specs = [B.Spec("a", "z", held_out=1), B.Spec("b", "z", "square", held_out=0, subsample=0.5), B.Spec("q", "z", "quantile")]
    work = B._Work(specs, [columns] * 3, [0] * 3, [0.4] * 3, [[]] * 3, [tree] * 3, [nodes] * 3, 4, [starts] * 3)
    fold, h = np.sort(rng.integers(-1, 3, n)).astype(np.int32), rng.integers(0, 1 << 62, n)
    y = np.where(np.arange(n) >= 600, np.nan, rng.integers(0, 2, n))
    bins, raw = np.stack([rng.integers(0, s, n) for s in sizes], 1).astype(np.uint8), rng.normal(size=(n, 3))
    loose = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(fold, mask=fold < 0), pa.array(h), pa.array(y), B._binary(bins), B._binary(raw)],
                                       names=["id", "fold", "h", "z", "bins", "raw"])
    records = [pa.RecordBatch.from_arrays(B._packed(fold[s], h[s], y[None, s], bins.T[:, s], raw.T[:, s]), names=list(B.PACKED)) for s in (slice(0, 450), slice(450, n))]
    packed = [pa.Table.from_batches(records).combine_chunks().to_batches()[0]]
    found = [{(r["model"], r["node"]): np.frombuffer(r["sums"]) for b in B._histograms(work, 1)(x) for r in b.to_pylist()} for x in ([loose], packed)]
    assert len(found[0]) == 6 and found[0].keys() == found[1].keys()
    assert all(np.allclose(v, found[1][k], atol=1e-9) for k, v in found[0].items())
    for (m, node), sums in found[1].items():
        use = ~np.isnan(y) & (fold != specs[m].held_out) & (work.drawn(m, h) if m == 1 else True) & ((bins[:, 2] > 30) == (node == 2))
        assert all(np.array_equal(sums.reshape(3, -1)[2, starts[j]:starts[j + 1]], np.bincount(bins[use, j], minlength=s)) for j, s in enumerate(sizes))
    counts = [[r for b in B._residual_counts(work, 1, [2], None)(x) for r in b.to_pylist()] for x in ([loose], packed)]
    assert counts[0] == counts[1] and sum(np.frombuffer(r["n"], "<i8").sum() for r in counts[1]) == 600


def test_state_rows_come_back_whole(spark, made):
    """Keys may repeat, folds and labels may be missing: every row comes back once, with its own fold and label."""
    rows, df = made
    odd = df.withColumn("fold", F.when(F.col("id") % 7 != 0, F.col("fold"))).withColumn("id", F.expr("if(id < 3, 1, id)"))
    grown = B.grow(odd, [B.Spec("q", "z", "square", held_out=0, trees=1), B.Spec("m", "y", trees=1)], ["a", "b"], ["cat"], 3)
    got = grown.state.select("id", "fold", "z", "y")
    wanted = odd.select("id", "fold", "z", F.col("y").cast("double").alias("y"))
    assert got.exceptAll(wanted).isEmpty() and wanted.exceptAll(got).isEmpty()


# -------------------------------------------------------------- compiled loops
_ODD = [("c", dict(label="y", held_out=1, balanced=True, depth=4)), ("d", dict(label="y", subsample=0.6, depth=6)), ("s", dict(label="z", loss="square", held_out=2, trees=3)),
        ("q", dict(label="z", loss="quantile", quantile=0.8, held_out=0)), ("f", dict(label="y", features=("a", "cat")))]


@pytest.fixture(scope="module")
def both(spark, made):
    """The same models grown by the compiled loops and by those in numpy; folds and labels may be missing."""
    _, df = made
    odd = df.withColumn("fold", F.when(F.col("id") % 7 != 0, F.col("fold")))
    specs = [B.Spec(name, **{"trees": 7} | more) for name, more in _ODD]
    assert B._engine(spark) is B._Compiled
    return [B.grow(odd, specs, ["a", "b"], ["cat"], 3, snapshots=[3], engine=e) for e in (B._Compiled, B._Plain)]


def test_compiled_loops_grow_the_trees_of_numpy(both):
    fast, plain = both
    for own, other in zip(fast.trees, plain.trees):
        assert len(own) == len(other) and any((t.feature >= 0).sum() > 2 for t in own)
        for a, b in zip(own, other):
            assert np.array_equal(a.feature, b.feature) and np.array_equal(a.cut, b.cut) and np.abs(a.value - b.value).max() < 1e-12
    for a, b in ((fast.state, plain.state), (fast.snapshots[3], plain.snapshots[3])):
        x, y = ({r.id: r for r in t.collect()} for t in (a, b))
        assert len(x) == 400 and all((x[i].fold, x[i].y, x[i].z) == (y[i].fold, y[i].y, y[i].z) for i in x)
        assert max(abs(p - q) for i in x for p, q in zip(x[i].scores, y[i].scores)) < 1e-12


def test_only_the_smaller_child_is_counted(made):
    """Of two children one reaches the tasks, the one with fewer rows, and superseded steps leave the checkpoint folder."""
    _, df = made
    asked, written = [], []

    class Watched(B._Compiled):
        def sums(self, work):
            asked.append(work.nodes[0])
            found = super().sums(work)
            written.append(list(self.written))
            rows = {node: s[2, :work.starts[0][1]].sum() for (_, node), s in found.items()}
            assert 2 * sum(rows.values()) <= 400 or work.nodes[0] == [0]
            return found

    grown = B.grow(df, [B.Spec("m", "y", trees=B.EVERY * B.WRITTEN * 2 + 1, depth=3)], ["a", "b"], ["cat"], 3, engine=Watched)
    assert asked[0] == [0] and all(len({(n - 1) // 2 for n in nodes}) == len(nodes) for nodes in asked)
    assert all(len(w) <= 1 for w in written) and len({w[0] for w in written if w}) == 3
    local = [w[0].removeprefix("file:") for w in written if w]
    assert [os.path.exists(p) for p in dict.fromkeys(local)] == [False, False, True]
    assert (grown.trees[0][0].feature >= 0).sum() > 3
