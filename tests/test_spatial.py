"""Spatial operators against brute force on small fixtures, hot cells included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadwatch.operators import clusters, neighbours as N

R = 6_371_000.0


def haversine(a, b):
    p1, p2 = np.radians(a[:, None, 0]), np.radians(b[None, :, 0])
    dl = np.radians(b[None, :, 1] - a[:, None, 1])
    x = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(dl / 2) ** 2
    return 2 * R * np.arctan2(np.sqrt(x), np.sqrt(1 - x))


def fixture(seed, n=400, hot=200, spread=0.06):
    """Scattered points, a third of all rows in one 30 m spot, and many exact copies."""
    rng = np.random.default_rng(seed)
    pts = np.column_stack([12.9 + spread * rng.random(n), 77.5 + spread * rng.random(n)])
    spot = np.column_stack([12.93 + 0.0003 * rng.random(hot), 77.53 + 0.0003 * rng.random(hot)])
    copies = np.repeat(pts[:3], 40, axis=0)
    out = np.vstack([pts, spot, copies])
    return out[rng.permutation(len(out))]


def table(spark, pts, **extra):
    rows = [(i, float(p[0]), float(p[1])) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "id bigint, lat double, lon double")
    for name, col in extra.items():
        df = df.withColumn(name, col)
    return df


def reference_dbscan(pts, eps=500.0, k=5):
    near = haversine(pts, pts) <= eps
    core = near.sum(1) >= k
    label = np.full(len(pts), -1)
    cid = 0
    for i in range(len(pts)):
        if label[i] != -1 or not core[i]:
            continue
        stack = [i]
        label[i] = cid
        while stack:
            j = stack.pop()
            if core[j]:
                for m in np.flatnonzero(near[j] & (label == -1)):
                    label[m] = cid
                    stack.append(m)
        cid += 1
    return label


@pytest.mark.parametrize("limit", [65536, 40])
def test_nearby_share_and_rate(spark, limit, monkeypatch):
    monkeypatch.setattr(N, "PAIR_LIMIT", limit)
    monkeypatch.setitem(N.radius_totals.__kwdefaults__, "limit", limit)
    pts = fixture(1)
    closure = np.arange(len(pts)) % 7 == 0
    df = table(spark, pts, closure=(F.col("id") % 7 == 0).cast("int"))
    near = haversine(pts, pts) <= 500.0
    share = {r.id: r.historical_nearby_closure_rate for r in N.nearby_closure_share(df).collect()}
    rate = {r.id: r.nearby_closure_rate for r in N.nearby_closure_rate(df).collect()}
    want_share = near[:, closure].sum(1) / closure.sum()
    want_rate = (near * closure[None, :]).sum(1) / near.sum(1)
    assert len(share) == len(pts)
    for i in range(len(pts)):
        assert share[i] == pytest.approx(want_share[i], abs=1e-12)
        assert rate[i] == pytest.approx(want_rate[i], abs=1e-12)


def test_rate_without_self(spark):
    pts = fixture(2, n=120, hot=20)
    df = table(spark, pts, closure=(F.col("id") % 3 == 0).cast("int"))
    got = {r.id: r.nearby_closure_rate for r in N.nearby_closure_rate(df, exclude_self=True).collect()}
    near = haversine(pts, pts) <= 500.0
    np.fill_diagonal(near, False)
    flag = np.arange(len(pts)) % 3 == 0
    for i in range(len(pts)):
        n = near[i].sum()
        assert got[i] == (pytest.approx((near[i] & flag).sum() / n) if n else None)


@pytest.mark.parametrize("seed,limit", [(3, 65536), (4, 30)])
def test_dbscan_equals_sequential_walk(spark, seed, limit):
    pts = fixture(seed, n=500, hot=250, spread=0.12)
    got = clusters.dbscan(table(spark, pts), limit=limit).select("id", "cluster_id").collect()
    labels = np.full(len(pts), -9)
    for r in got:
        labels[r.id] = r.cluster_id
    assert len(got) == len(pts)
    assert (labels == reference_dbscan(pts)).all()


def test_dbscan_two_hot_cells_that_touch(spark):
    """Two dense neighbouring cells: the link must be found by splitting, not by all pairs."""
    rng = np.random.default_rng(9)
    a = np.column_stack([12.9000 + 0.0005 * rng.random(300), 77.5 + 0.0005 * rng.random(300)])
    b = a + np.array([0.0046, 0.0])          # about 511 m north: only the rims are in reach
    c = a + np.array([0.0, 0.0101])          # out of reach
    pts = np.vstack([a, b, c])
    got = {r.id: r.cluster_id for r in clusters.dbscan(table(spark, pts), limit=50).collect()}
    assert [got[i] for i in range(len(pts))] == list(reference_dbscan(pts))
    assert len(set(got.values())) == 2


def test_worlds_do_not_touch(spark):
    pts = fixture(5, n=200, hot=60)
    df = table(spark, pts, time_band=F.when(F.col("id") % 2 == 0, "evening").otherwise("off_peak"))
    got = {r.id: r.cluster_id for r in clusters.temporal_dbscan(df).collect()}
    for parity in (0, 1):
        ids = np.arange(len(pts))[np.arange(len(pts)) % 2 == parity]
        assert [got[i] for i in ids] == list(reference_dbscan(pts[ids]))


@pytest.mark.parametrize("limit", [256, 5])
def test_nearest_distance(spark, limit):
    targets, rng = fixture(6, n=150, hot=100), np.random.default_rng(7)
    points = np.vstack([
        np.column_stack([12.88 + 0.1 * rng.random(60), 77.48 + 0.1 * rng.random(60)]), targets[:5], [[13.2, 77.7]]])
    out = N.nearest_distance(table(spark, points), table(spark, targets), limit=limit)
    got = {(r.lat, r.lon): r.distance_m for r in out.collect()}
    want = haversine(points, targets).min(1)
    for p, d in zip(points, want):
        assert got[(p[0], p[1])] == pytest.approx(d, abs=1e-6)


def test_strict_radius(spark):
    nodes = table(spark, np.array([[12.9, 77.5], [12.95, 77.5]])).withColumnRenamed("id", "node")
    inc = table(spark, np.array([[12.8999, 77.5]])).withColumns(
        {"end_lat": F.lit(12.9001), "end_lon": F.lit(77.5), "has_end_coord": F.lit(True)})
    assert [r.node for r in N.blocked_nodes(nodes, inc).collect()] == [0]


def test_no_side_of_a_grid_join_is_gathered_in_the_driver(spark):
    """However small the cells look, they are met by sorting, and nothing is cached in all its shuffle partitions."""
    points = spark.createDataFrame([(i, 12.9 + i * 0.001, 77.5 + i % 7 * 0.002) for i in range(60)], "id long, lat double, lon double")
    cells = N.prepared(points, {"n": F.count("*")})
    for out in (N.nearest_distance(points, points), N.radius_totals(cells, cells, 500.0, {"n": "sum"}), N.radius_totals(cells, cells, 500.0, {"n": "sum"}, limit=1)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan and "InMemoryTableScan" not in plan
    assert {r.distance_m for r in N.nearest_distance(points, points).collect()} == {0.0}
