"""Ranking, quantiles, evaluation, density, forest and streaming on small fixtures."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadwatch import settings as S
from roadwatch.operators import anomaly as A, density as D, evaluation as V, learning as L, ranking as K
from roadwatch.operators.cleaning import spatial_view
from roadwatch.sources.incidents import INCIDENT_SCHEMA, conform, missing_columns, scan_incidents
from roadwatch.streaming import replay


def test_quantiles_match_numpy_with_a_hot_value(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.exponential(3, 500), np.full(300, 2.5)])
    g = np.array(["a"] * 600 + ["b"] * 200)
    df = spark.createDataFrame([(str(a), float(b)) for a, b in zip(g, x)], "g string, x double")
    got = {r.g: r for r in K.exact_quantiles(df, ["g"], "x", {"m": 0.5, "p": 0.95}, 0.01).collect()}
    for key in "ab":
        assert got[key].m == pytest.approx(np.percentile(x[g == key], 50), abs=1e-12)
        assert got[key].p == pytest.approx(np.percentile(x[g == key], 95), abs=1e-12)
    whole = K.exact_quantiles(df, [], "x", {"m": 0.25}, 0.01).first().m
    assert whole == pytest.approx(np.percentile(x, 25), abs=1e-12)


def test_folds_are_balanced(spark):
    df = spark.range(1003).withColumn("y", (F.col("id") % 9 == 0).cast("int"))
    sizes = K.stratified_folds(df, "y").groupBy("y", "fold").count().collect()
    for y in (0, 1):
        counts = [r["count"] for r in sizes if r.y == y]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_global_row_number(spark):
    df = spark.createDataFrame([(i, (i * 37) % 11 / 10) for i in range(50)], "id int, s double")
    got = K.global_row_number(df, -F.round(F.col("s") * 10).cast("long"), [F.desc("s"), "id"]).orderBy("row_number").collect()
    want = sorted(((i, (i * 37) % 11 / 10) for i in range(50)), key=lambda r: (-r[1], r[0]))
    assert [r.id for r in got] == [w[0] for w in want] and [r.row_number for r in got] == list(range(1, 51))


def test_auc_and_average_precision(spark):
    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.3).astype(int)
    s = np.round(np.clip(0.4 * y + 0.5 * rng.random(400), 0, 1), 2)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert V.auc(df, "s", "y").first().auc == pytest.approx(want)
    assert V.auc(df.withColumn("s", F.lit(0.5)), "s", "y").first().auc == pytest.approx(0.5)
    cuts = np.unique(s)[::-1]
    tp = np.array([((s >= c) & (y == 1)).sum() for c in cuts])
    pp = np.array([(s >= c).sum() for c in cuts])
    step = np.diff(np.concatenate([[0], tp])) / y.sum()
    assert V.average_precision(df, "s", "y").first().average_precision == pytest.approx((step * tp / pp).sum())
    sweep = {round(r.threshold, 2): r for r in V.threshold_sweep(df, "s", "y").collect()}
    assert len(sweep) == 91
    for c in (0.05, 0.33, 0.5, 0.95):
        hit = s >= c - 1e-12
        f1 = 2 * (hit & (y == 1)).sum() / (hit.sum() + y.sum())
        assert sweep[c].f1 == pytest.approx(f1, abs=0.02 if c == 0.33 else 1e-9)


def test_density_equals_the_dense_sum(spark):
    rng = np.random.default_rng(2)
    n = 150
    lat, lon = 12.9 + 0.05 * rng.standard_normal(n), 77.55 + 0.04 * rng.standard_normal(n)
    lat[:40], lon[:40] = lat[0], lon[0]          # a third of the rows on one spot
    score = rng.integers(1, 11, n)
    rows = [(float(a), float(b), int(s), "evening", "accident") for a, b, s in zip(lat, lon, score)]
    sp = spark.createDataFrame(rows, "lat double, lon double, impact_score int, time_band string, cause string")
    w = score / score.sum()
    pts = np.vstack([lat, lon])
    mean = (pts * w).sum(1, keepdims=True)
    cov = ((pts - mean) * w) @ (pts - mean).T / (1 - (w**2).sum())
    h = cov * S.KDE_FACTOR**2
    inv, norm = np.linalg.inv(h), 2 * np.pi * np.sqrt(np.linalg.det(h))
    gy, gx = np.linspace(S.LAT_MIN, S.LAT_MAX, 200), np.linspace(S.LON_MIN, S.LON_MAX, 200)
    dy, dx = gy[:, None, None] - lat, gx[None, :, None] - lon
    dense = (w * np.exp(-0.5 * (inv[0, 0] * dy**2 + inv[1, 1] * dx**2 + 2 * inv[0, 1] * dy * dx))).sum(-1) / norm
    want = (dense - dense.min()) / (dense.max() - dense.min())
    grid = D.density_grid(sp).persist()
    kinds = {(r.filter_kind, r.filter_value): r.n for r in grid.groupBy(*D.SURFACE).agg(F.count("*").alias("n")).collect()}
    assert set(kinds.values()) == {40_000} and len(kinds) == 6
    got = np.zeros((200, 200))
    for r in grid.filter("filter_kind = 'full'").collect():
        got[r.lat_idx, r.lon_idx] = r.intensity
    assert np.abs(got - want).max() < 1e-9
    assert grid.filter("filter_value = 'late_night'").agg(F.max("intensity")).first()[0] == 0.0   # too few rows
    at = spark.createDataFrame([(1, float(lat[0]), float(lon[0])), (2, 13.25, 77.32)], "point_id int, lat double, lon double")
    res = {r.point_id: r.density_score for r in D.density_at_points(at, sp, D.peak_density(grid)).collect()}
    assert res[1] == 1.0 and res[2] == 0.0


def test_density_sums_of_a_task():
    """A task adds its points up itself: one row for each cell that a point of a surface reaches, also at and beyond the grid's edge."""
    rng = np.random.default_rng(4)
    kernels = {1: (9e4, 7e4, 2e4), 2: (4e6, 5e6, -1e6)}
    rows = [(int(rng.integers(1, 3)), rng.uniform(S.LAT_MIN - 0.02, S.LAT_MAX + 0.02), rng.uniform(S.LON_MIN - 0.02, S.LON_MAX + 0.02), float(rng.integers(1, 11))) for _ in range(300)]
    rows += [(1, S.LAT_MIN, S.LON_MAX, 2.0), (2, 12.95, 77.5, 0.0)]
    parts = []
    for sid, lat, lon, w in rows:
        pyy, pxx, pxy = kernels[sid]
        det = pyy * pxx - pxy * pxy
        parts.append((sid, lat, lon, w, pyy, pxx, pxy, 8 * math.sqrt(pxx / det), 8 * math.sqrt(pyy / det)))
    names = ["sid", "lat", "lon", "w", "pyy", "pxx", "pxy", "ry", "rx"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], names=names) for part in (parts[:130], parts[130:])]
    got = [r for b in D._spread(batches) for r in b.to_pylist()]
    wanted = {}
    y, x = np.arange(D.N) * D.DY + S.LAT_MIN, np.arange(D.N) * D.DX + S.LON_MIN
    for sid, lat, lon, w, pyy, pxx, pxy, *_ in parts:
        dy, dx = (y - lat)[:, None], (x - lon)[None, :]
        half = 0.5 * (dy * dy * pyy + dx * dx * pxx + 2 * dy * dx * pxy)
        for i, j in zip(*np.nonzero(half <= 32)):
            cell = sid * D.N * D.N + i * D.N + j
            wanted[cell] = wanted.get(cell, 0.0) + w * math.exp(-half[i, j])
    assert len(got) == len(wanted) and all(abs(r["density"] - wanted[r["cell"]]) < 1e-12 for r in got)


def test_density_is_summed_by_one_task_per_core(spark):
    """However many parts the points come in, no more tasks than cores write sums for cells."""
    rows = [(12.9 + 0.001 * (i % 37), 77.5 + 0.0013 * (i % 41), "off_peak", "c", 1 + i % 9) for i in range(300)]
    sp = spark.createDataFrame(rows, "lat double, lon double, time_band string, cause string, impact_score int").repartition(40)
    each = D.by_surface(D.merged_points(sp).repartition(40), D.surfaces(sp)).persist()
    sums = D.density_sums(each, D.kernels(D.weighted_moments(each)))
    assert "Coalesce" in sums._jdf.queryExecution().executedPlan().toString() and not sums.isEmpty()


def test_density_from_merged_points(spark, tmp_path):
    """Merged points stand in for rows, and the rows behind a density query are read once."""
    rows = [(i, 12.9 + 0.001 * (i % 37), 77.5 + 0.0013 * (i % 41), ("off_peak", "evening")[i % 2], "c", 1 + i % 9) for i in range(3200)]
    spark.createDataFrame(rows, "id int, lat double, lon double, time_band string, cause string, impact_score int").write.parquet(f"{tmp_path}/sp")
    sp = spark.read.parquet(f"{tmp_path}/sp")
    merged = D.merged_points(sp)
    assert merged.count() < 3200 and D.merged_points(merged) is merged
    assert sorted(D.surfaces(sp).collect()) == sorted(D.surfaces(merged).collect())
    at = spark.createDataFrame([(i, 12.9 + 0.002 * i, 77.5 + 0.002 * i) for i in range(20)], "point_id int, lat double, lon double")
    first, second = ({r.point_id: r.density_score for r in D.density_at_points(at, x, D.peak_density(D.density_grid(x, kinds=("full",)))).collect()} for x in (sp, merged))
    assert first == second and len(set(first.values())) > 5
    for table in (D.density_grid(sp), D.density_at_points(at, sp, F.lit(1.0))):
        assert f"{tmp_path}/sp" not in table._jdf.queryExecution().executedPlan().toString()


def test_density_without_spread(spark):
    rng = np.random.default_rng(5)
    usual = [(12.9 + 0.05 * rng.random(), 77.5 + 0.05 * rng.random(), 5, "evening", "usual") for _ in range(60)]
    spot = [(13.0, 77.6, 4, "late_night", "spot")] * 25
    line = [(12.9 + 0.002 * i, 77.4 + 0.003 * i, 3, "off_peak", "line") for i in range(30)]
    single = [(13.1, 77.7, 9, "evening", "single")]
    sp = spark.createDataFrame(usual + spot + line + single, "lat double, lon double, impact_score int, time_band string, cause string")
    status = {r.filter_value: (r.computed, r.reason) for r in D.surface_status(sp).collect()}
    for value in ("spot", "late_night", "line", "off_peak", "single"):
        assert status[value] == (False, "no spread")
    assert status["early_morning"] == (False, "too few rows") and status["all"] == status["usual"] == status["evening"] == (True, None)
    grid = D.density_grid(sp).groupBy("filter_value").agg(F.count("*").alias("n"), F.max("intensity").alias("top")).collect()
    assert all(r.n == 40_000 and r.top == (1.0 if status[r.filter_value][0] else 0.0) for r in grid) and len(grid) == 9
    at = spark.createDataFrame([(1, 13.0, 77.6)], "point_id int, lat double, lon double")
    only = sp.filter("cause = 'spot'")
    assert D.density_at_points(at, only, F.lit(0.0)).first().density_score == 0.0


def test_calibration_equals_pooled_means(spark):
    rng = np.random.default_rng(8)
    s = np.repeat(0.5 + 1e-6 * np.arange(40), 5)   # equal in four digits
    y = (rng.random(200) < np.repeat(np.arange(40) / 40, 5)).astype(float)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s0 double, y int")
    got = {r.s0: r.c for r in L.calibrate(df, L.fit_isotonic(df, "s0", "y"), "s0", "c").collect()}
    mean = y.reshape(40, 5).mean(1)
    for k, v in enumerate(np.unique(s)):
        want = max(min(mean[a:b + 1].mean() for b in range(k, 40)) for a in range(k + 1))
        assert got[v] == pytest.approx(want, abs=1e-6)
    coarse = L.calibrate(df, L.fit_isotonic(df, "s0", "y", digits=4), "s0", "c", digits=4)
    assert [r.c for r in coarse.select("c").distinct().collect()] == [pytest.approx(y.mean())]


def test_wide_category_stays_a_feature(spark):
    df = spark.range(3000).select(F.concat(F.lit("s"), F.col("id") % 1500).alias("station"), (F.col("id") % 1500 < 700).cast("int").alias("y"),
                                  (F.col("id") % 3).cast("double").alias("x"))
    sizes = L.usable_categories(df, ["station"])
    model = L.classifier("y", 1)(sizes, encoded=None, numeric=("x",)).fit(df)
    assert model.stages[-2].getInputCols() == ["station_idx", "x"] and model.stages[-1].featureImportances[0] > 0.9


def test_finished_stream_closes_every_hour(spark, sf, tmp_path):
    feed = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    src, out, state = (str(tmp_path / n) for n in ("feed", "out", "state"))
    replay.publish_feed(feed, src)
    replay.close_feed(spark, src)
    replay.run_to_end(replay.hourly_counts(replay.replay_source(spark, src)), out, state)
    assert spark.read.parquet(out).agg(F.sum("event_count")).first()[0] == feed.count()
    late = feed.limit(1).withColumn("ts", F.lit("2020-01-01 05:00:00").cast("timestamp_ntz"))
    replay.publish_feed(late, src)
    replay.run_to_end(replay.hourly_counts(replay.replay_source(spark, src)), out, state)
    assert spark.read.parquet(out).agg(F.sum("event_count")).first()[0] == feed.count()   # later than the delay: left out


def test_priority_rule_reaches_both_branches(spark):
    rows = spark.createDataFrame([(1, "vehicle_breakdown", None, "High"), (2, "accident", True, None)], "id int, event_cause string, requires_road_closure boolean, priority string")
    got = {r.incident_id: (r.predicted_priority, r.actual_priority, r.actual_closure) for r in A.predicted_vs_actual(rows).collect()}
    assert got == {1: ("High", "High", False), 2: ("Low", "Low", True)}


def test_forest_lookup_and_contamination(spark):
    rng = np.random.default_rng(3)
    counts = np.concatenate([rng.poisson(20, 470), rng.integers(60, 90, 30)])
    base = spark.createDataFrame([(f"c{i}", i % 24, int(c)) for i, c in enumerate(counts)], "corridor string, hour int, event_count bigint").persist()
    leaves = A.fit_forest(base).persist()
    table = leaves.toPandas()
    assert table.tree.nunique() == S.FOREST_TREES and set(table.sample_size) == {256}
    got = {r.event_count: r.mean_path for r in A.leaf_range_join(base, leaves).collect()}
    for v in (int(counts.min()), 20, 61, int(counts.max())):
        hit = table[(table.lo < v) & (v <= table.hi)]
        assert len(hit) == S.FOREST_TREES            # one leaf per tree and value
        if v in got:
            assert got[v] == pytest.approx(hit.path_len.mean(), abs=1e-9)
    flagged = A.forest_detect(base, leaves, A.forest_offset(base, leaves))
    share = flagged.agg(F.avg(F.col("is_anomaly").cast("int"))).first()[0]
    assert 0.02 <= share <= 0.06
    odd = flagged.filter("event_count >= 60").agg(F.avg(F.col("is_anomaly").cast("int")), F.min("confidence")).first()
    assert odd[0] > 0.5 and odd[1] > 0.4
    usual = flagged.filter("event_count = 20").agg(F.max(F.col("is_anomaly").cast("int"))).first()[0]
    assert usual == 0
    assert flagged.count() == len(counts)


def test_missing_columns_and_csv(spark, tmp_path):
    path = tmp_path / "incidents.csv"
    path.write_text("id,event_cause,latitude,longitude,start_datetime,priority\n"
                    "a1,Accident ,12.95,77.55,2024-03-01 12:54:44.007+00,High\n"
                    "a2,null,12.95,77.55,not a time,\n"
                    "a3,pot_holes,0.0,0.0,2024-03-01 01:00:00+00,Low\n")
    thin = spark.read.option("header", True).csv(str(path))
    assert "junction" in missing_columns(thin)
    rows = {r.id: r for r in spatial_view(conform(thin)).collect()}
    assert set(rows) == {"a1", "a2"}
    assert (rows["a1"].cause, rows["a1"].hour, rows["a1"].corridor, rows["a1"].is_high_priority) == ("accident", 12, "non-corridor", 1)
    assert (rows["a2"].cause, rows["a2"].hour, rows["a2"].dow, rows["a2"].priority) == ("unknown", 12, 0, "unknown")
    assert scan_incidents(spark, str(path), "csv", INCIDENT_SCHEMA).schema == INCIDENT_SCHEMA


def test_stream_equals_batch_and_resumes(spark, sf, tmp_path):
    feed = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    src, out, state = (str(tmp_path / n) for n in ("feed", "out", "state"))
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    replay.publish_feed(feed.filter(F.col("ts") < cut), src)
    replay.run_to_end(replay.replay_source(spark, src).select("id"), out, state)
    first = spark.read.parquet(out).count()
    assert first == feed.filter(F.col("ts") < cut).count()
    replay.publish_feed(feed.filter(F.col("ts") >= cut), src)
    replay.run_to_end(replay.replay_source(spark, src).select("id"), out, state)
    again = spark.read.parquet(out)
    assert again.count() == feed.count() == again.distinct().count()


def test_ranking_survives_an_empty_table(spark):
    empty = spark.createDataFrame([], "s double, y int")
    assert V.threshold_sweep(empty, "s", "y").count() == 91
    assert K.exact_quantiles(empty, [], "s", {"m": 0.5}, 0.1).count() == 0
