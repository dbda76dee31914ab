"""Periodic runs, exact top-k and ranked lexical search against brute force, with their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadwatch.llm import lexical, nearest, periodic, queries

VECTORS = "vec_id long, embedding array<float>, label int, v string, ring int, score long"
DOCS = "doc_id long, text string, number int, ids string, term string, runs string, length int"


# ---------------------------------------------------------------- periodic runs
def brute_runs(words, shortest=12):
    n, out = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(shortest, 2 * p) and j > i:
                out.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, length, p) for (s, length), p in out.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    """The contract of op11, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("shortest", [2, 3, 4, 12])
def test_runs_of_random_words(shortest):
    rng = random.Random(shortest)
    for _ in range(150):
        batch = []
        for _ in range(rng.randint(1, 5)):
            w = [str(rng.randrange(rng.choice([1, 2, 3, 50]))) for _ in range(rng.randint(0, 60))]
            if rng.random() < 0.6 and w:
                a = rng.randrange(len(w))
                p = rng.randint(1, len(w) - a)
                w = w[:a] + [w[a + i % p] for i in range(rng.randint(0, 80))] + w[a:]
            batch.append(w)
        assert periodic.find_runs(batch, shortest) == [brute_runs(w, shortest) for w in batch]


def test_ordered_positions(monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK", 4)
    rng = random.Random(3)
    numbers = rng.sample(range(10_000), 500)
    held, seen = periodic.Positions(numbers[0]), [numbers[0]]
    for x in numbers[1:]:
        below, above = [y for y in seen if y < x], [y for y in seen if y > x]
        assert held.add(x) == (max(below, default=-1), min(above, default=-1))
        seen.append(x)
    assert list(held) == sorted(numbers) and max(map(len, held.blocks)) <= 8


def test_long_runs():
    assert periodic.find_runs([["a"] * 100_000]) == [[(0, 100_000, 1)]]
    block = [f"w{i}" for i in range(3000)]
    assert periodic.find_runs([block * 9 + ["end"], [], ["x"]]) == [[(0, 27_000, 3000)], [], []]


def op11(docs):
    found = periodic.digests(periodic.collapse(periodic.with_repetitions(docs)))
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return collections.Counter(tuple(r[c] for c in names) for r in found.collect())


def test_op11_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    # the shorter texts: brute force takes a word's square
    docs = docs.where(F.length("text") < 4000)
    assert op11(docs) == collections.Counter(brute_row(r.doc_id, r.text) for r in docs.collect())


def test_op11_edges(spark):
    tens = [i for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (None, "x y " * 20), (4, "a " * 30), (4, "a " * 30), (5, "é\x1cb　c " * 12),
            (tens[0], "only"), (tens[1], " ".join(f"w{i}" for i in range(90))), (tens[2], None), (tens[3], "a b"),
            (tens[4], "é" * 3 + " " + " ".join(f"w{i % 7}" for i in range(40))), (tens[5], ""), (6, "one two")]
    docs = spark.createDataFrame([(i, t, 1, "x", "y", "z", 2) for i, t in rows], DOCS).repartition(3)
    assert op11(docs) == collections.Counter(brute_row(*r) for r in rows)
    assert not op11(docs.limit(0))
    named = spark.createDataFrame([("a", "x y z " * 6), ("b", None)], "doc_id string, text string")
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.collapse(named).collect()}
    assert got == {"a": (18, [(0, 18, 3)], "x y z"), "b": (0, [], "")}


# ------------------------------------------------------------------ exact top-k
def brute_top(rows, every=1, k=5):
    held = {}
    for i, e in rows:
        if i is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        held[(i, tuple(math.floor(256 * float(np.float32(x))) for x in e))] = None
    out = []
    for i, v in held:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in held if j != i)
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return collections.Counter(out)


def top(spark, rows, every=1, k=5):
    frame = spark.createDataFrame([(i, e, 0, "v", 1, 2) for i, e in rows], VECTORS).repartition(3)
    return collections.Counter(tuple(r) for r in nearest.top_k(frame, F.col("vec_id") % every == 0, k).collect())


def test_top_k_ties_copies_and_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(200)]                       # a third of all rows is one vector
    rows += [(600, None), (601, [1.0, None] + [0.0] * 6), (602, [float("nan")] * 8), (603, [float("inf")] + [0.0] * 7), (None, [9.0] * 8),
             (604, []), (605, [0.5]), (606, [0.0] * 8), (50, rows[50][1]), (50, rows[50][1]), (100, [0.25] * 9), (610, [3000.0] * 8)]
    assert top(spark, rows, 50) == brute_top(rows, 50)
    assert top(spark, rows, 10, 3) == brute_top(rows, 10, 3)


def test_top_k_small_tables(spark):
    assert not top(spark, [])
    assert not top(spark, [(50, [1.0, 2.0])])
    assert not top(spark, [(50, None), (100, [None])])
    assert top(spark, [(50, [1.0]), (51, [1.0])], 50) == collections.Counter([(50, 1, 51, 65536)])
    assert top(spark, [(i, [0.0]) for i in range(20)], 10) == brute_top([(i, [0.0]) for i in range(20)], 10)


def test_bounds_hold_and_annuli_cut():
    """No bound is below a score that it covers, and clustered vectors leave most annuli out."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 60, (40, 16))
    points = np.floor(centres[rng.integers(0, 40, 6000)] + rng.normal(0, 6, (6000, 16))).astype(np.int64)
    layout = nearest.Layout(points[:2000], 200_000)
    ring, dist = layout.place(points)
    norm = (points.astype(float) ** 2).sum(1)
    limits = np.array([(r, dist[ring == r].min(), dist[ring == r].max(), norm[ring == r].max()) for r in np.unique(ring)])
    q = points[::300]
    scores = nearest._products(q, points)
    reach = nearest._distances(q, layout.pivots)[:, layout.pivot_of[limits[:, 0].astype(int)]]
    bound = nearest._bound((q.astype(float) ** 2).sum(1)[:, None], limits[:, 3], reach, limits[:, 1], limits[:, 2])
    for at, r in enumerate(limits[:, 0].astype(int)):
        assert (scores[:, ring == r].max(1) <= bound[:, at]).all()
    sixth = -np.sort(-scores, axis=1)[:, 5]
    assert (bound >= sixth[:, None]).mean() < 0.5


def test_wide_components():
    x = np.array([3, -40_000, 1 << 40])
    assert nearest._encode(x)[0] == 8 and (nearest._matrix([nearest._encode(x), nearest._encode(x[:1])], 4) == [[3, -40_000, 1 << 40, 0], [3, 0, 0, 0]]).all()
    big = np.full((1, 2), 1 << 30)
    assert nearest._products(big, big)[0, 0] == 1 << 61


# --------------------------------------------------------------- lexical search
def brute_rank(docs, items, k=20):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [collections.Counter(split(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = collections.Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), c, size in zip(docs, counts, sizes):
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * (75 + 25 * size * n // total)))
                        for t, q in collections.Counter(split(text)).items() if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return collections.Counter(out)


def ranked(spark, docs, items, k=20, **limits):
    table = spark.createDataFrame([(i, t, 1, "x", "y", "z", 2) for i, t in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, score int")
    return collections.Counter(tuple(r) for r in lexical.rank(table, asked, k, **limits).collect())


def made_docs(rng, n):
    words = [f"w{i}" for i in range(60)]
    return [(i, " ".join(words[min(int(rng.expovariate(0.1)), 59)] for _ in range(rng.choice([0, 1, 3, 20, 200])))) for i in range(n)]


def test_lexical_against_brute_force(spark):
    docs = made_docs(random.Random(4), 400)
    docs += [(None, "w1 w2 w3 only null"), (None, None), (7, docs[7][1]), (7, docs[7][1]), (900, ""), (901, "É é W1-w1_w1.W1 \x1cw2　w3"),
             (902, "w59 " * 5000)] + [(1000 + i, "w5 w6 same text") for i in range(150)]
    items = [(1, "w1 w2 W2 w30"), (2, None), (3, ""), (4, "absent words"), (5, "w5 same"), (5, "w5 same"), (None, "É é w59 w0"),
             (6, " ".join(f"w{i}" for i in range(60)) * 3), (7, "null")]
    assert ranked(spark, docs, items) == brute_rank(docs, items)
    assert ranked(spark, docs, items, 3, item_bytes=40) == brute_rank(docs, items, 3)    # several passes
    assert not ranked(spark, docs, []) and not ranked(spark, [], items) and not ranked(spark, [(1, None)], items)


def test_shards_and_windows(monkeypatch):
    """Many small shards and windows give the same ranks, and bounds leave blocks packed."""
    monkeypatch.setattr(lexical, "WINDOW", 16)
    monkeypatch.setattr(lexical, "SHARD_DOCS", 100)
    docs = made_docs(random.Random(9), 700)
    items = [(1, "w40 w1"), (2, "w0 w1 w2 w3 w4 w58"), (3, "w0")]
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for _, x in items for t in lexical.terms(x)))}
    schema = T.StructType([*lexical._SHARD, T.StructField("ids", T.ArrayType(T.LongType()))])
    batch = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in docs], "text": [t for _, t in docs]})
    rows = [r for b in lexical._indexed(vocabulary, schema)([batch]) for r in b.to_pylist()]
    assert len(rows) >= 4 and max(len(r["ids"]) for r in rows) <= 100
    sizes = [len(lexical.terms(t)) for _, t in docs]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    assert (sum(r["n_docs"] for r in rows), sum(r["n_terms"] for r in rows)) == (n, total)
    df = collections.Counter(t for _, x in docs for t in set(lexical.terms(x)))
    shards, out = [lexical.Shard(r, n, total) for r in rows], []
    for item, text in items:
        weights = [(vocabulary[t], q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))) for t, q in collections.Counter(lexical.terms(text)).items()]
        found = sorted((-s, d) for shard in shards for d, s in shard.top(weights, 5))[:5]
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(found)]
    assert collections.Counter(out) == brute_rank(docs, items, 5)
    # a rare and a frequent term, one document wanted: blocks of the frequent one stay packed
    fresh = [lexical.Shard(r, n, total) for r in rows]
    for shard in fresh:
        shard.top([(vocabulary[b"w58"], 9000), (vocabulary[b"w0"], 10)], 1)
    wanted = {vocabulary[b"w58"], vocabulary[b"w0"]}
    assert 0 < sum(len(s.open) for s in fresh) < sum(int(np.isin(s.term, list(wanted)).sum()) for s in fresh) * 0.8


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_exact_topk", "op13_lexical_search"])
def test_registered(name):
    assert name in queries.QUERIES
