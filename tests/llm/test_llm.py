"""Text operators against brute force, and their edge cases: nulls, empty and long texts, repeats, clashing names, empty tables."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import xxhash
from check import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from roadwatch.llm import bpe, classifier, editing, licenses, lines, packing, quality, queries, repeats, simhash, urls
from roadwatch.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rk string, fp int, cover string, _stats string"
PASSAGE = " ".join(f"passage{i}" for i in range(40))
BLOCK = "\n".join(f"shared line {i} of a block" for i in range(12))
ROWS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "two words"), (None, "null id text " + PASSAGE), (7, "a" * 30_000),
    (8, ("word%d " * 4000) % tuple(range(4000))), (9, "head of nine " + PASSAGE + " tail"), (9, "head of nine " + PASSAGE + " tail"),
    (10, BLOCK), (11, "own start\n" + BLOCK + "\nown end"), (12, "é漢字😀 Σσς İ J̌ \x1c\x85 x\r\ny  z\n\n\nend "),
    (13, "Released under the MIT License.\nThen text, the Apache License and the GNU General Public License."),
    (14, "It " * 300), (19, "a <|endoftext|> b<|startoftext|> <|EndOfText|>"), (15, "sym### bol$$$ " * 40), (16, "A b C d e F g. " * 3 + "unique ending here"),
    (17, "tie of words one two three four five six seven"), (18, "tie of words one two three four five six seven"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "c", "q") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ROWS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def key(row):
    return (row[0] is not None, row[0] or 0, *map(str, row[1:]))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs_on_whole_table(spark, sf, name):
    table = "pages" if name.startswith("op2_") else "documents"
    ok, message, _ = compare(spark, connect(sf), sf, name, queries.QUERIES[name], queries.ORACLES.get(name))
    assert ok, message
    if not name.startswith(("op6_", "op12_", "op13_")):
        assert queries.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


# ---------------------------------------------------------------- 1

def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(odd):
    got = sorted((r.doc_id or -1, r.fingerprint) for r in simhash.near_duplicates(odd).collect())
    assert got == sorted((i or -1, f"{brute_fingerprint(t):016x}") for i, t in ROWS)


def test_links_connect_what_is_near(spark, monkeypatch):
    rng = random.Random(4)
    values = {0, (1 << 64) - 1}
    for _ in range(120):
        v = rng.getrandbits(64)
        for _ in range(4):
            values.add(v)
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                v ^= 1 << b
    values = sorted(values)
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    want = {frozenset(g) for g in _groups({v: find(v) for v in values}) if len(g) > 1}
    for limit in (simhash.MAX_RUN, 1):   # 1: every shared key is cut further
        monkeypatch.setattr(simhash, "MAX_RUN", limit)
        got = components(simhash.links(fps)).collect()
        assert {frozenset(g) for g in _groups({r.node % (1 << 64): r.root for r in got})} == want


def _groups(of):
    out = collections.defaultdict(set)
    for k, v in of.items():
        out[v].add(k)
    return out.values()


def test_long_chain_of_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 5000), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 5000: 1000}


def test_keep_one(odd, none):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and none.columns == simhash.keep_one(none).columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 1 in ids and 2 not in ids and 18 not in ids and {17, None} <= set(ids)


def test_keep_one_of_null_and_repeated_ids(spark):
    """The survivor is a row, not an id: clean texts under null or repeated ids stay, near copies go whatever their id."""
    own = [" ".join(f"{name}{i}" for i in range(60)) for name in "abcdef"]
    docs = [(None, own[0]), (None, own[1]), (None, own[1]), (3, own[2]), (3, own[3]), (5, own[4]), (None, own[4]), (5, own[5]), (6, own[5]), (5, own[5])]
    want = [(None, own[0]), (None, own[1]), (3, own[2]), (3, own[3]), (5, own[4]), (5, own[5])]
    for limit in (docs, docs[:2]):
        got = [(r.doc_id, r.text) for r in simhash.keep_one(frame(spark, limit).repartition(3)).collect()]
        assert sorted(got, key=key) == sorted((d for d in want if d in limit), key=key)


# ---------------------------------------------------------------- 2

@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("HTTP://A.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://x.org/de/", "x.org", "/de/", "org/", "allow"), ("http://x.org", "x.org", "", None, "allow"),
    ("http://x.com/de/a#b", "x.com", "/de/a", "com/de/", "block"), ("http://xcom/de/a", "xcom", "/de/a", None, None),
    ("http://h?a/b", "h", "", None, None), ("no scheme/x", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
    ("https://www.casino-jackpot.net/x", "www.casino-jackpot.net", "/x", None, "block"),
    ("https://www.city-library.net/x", "www.city-library.net", "/x", None, "allow"), ("://h/" + "p" * 5000, "h", "/" + "p" * 5000, None, None),
])
def test_urls(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "h", "x")], "page_id long, url string, host string, grams string")
    row = urls.judge(pages, queries.URL_RULES).first()
    assert (row.host, row.path, row.rule) == (host, path, rule) and verdict in (None, row.verdict)


def test_no_pages(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), []).count() == 0


# ---------------------------------------------------------------- 3

def test_line_dedup_edges(odd, none):
    rows = {(r.doc_id, r.n_lines): r for r in lines.dedup(odd).collect()}
    assert rows[10, 12].text == BLOCK
    assert rows[11, 14].n_removed_chunks > 0 and rows[11, 14].text.startswith("own start")
    clean = lines.clean(odd)
    assert clean.columns == odd.columns and clean.count() == len(ROWS) and lines.clean(none).count() == 0
    assert all(r.n_chars == len(r.text or "") for r in clean.collect())
    assert sorted(r.text or "" for r in clean.collect()) == sorted(r.text for r in lines.dedup(odd).collect())


def brute_lines(docs):
    """Texts without the chunks that stand at an earlier place, for (id, text) in order of id."""
    seen, out = set(), []
    for _, text in docs:
        all_, lost = (text or "").split("\n"), set()
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in all_]
        kinds = [(x % lines._PRIME * lines._FACTOR + y) % lines._PRIME % lines.SPREAD for x, y in zip(h, h[1:])]
        starts = [i for i in range(len(kinds)) if not i or kinds[i] != kinds[i - 1]]
        for a, b in zip(starts, [*starts[1:], len(kinds)]):
            body = tuple(all_[a:b + 1])
            if re.search(r"[^\x20\x09-\x0D]", "\n".join(body)):
                lost |= set(range(a, b + 1)) if body in seen else set()
                seen.add(body)
        out.append("\n".join(x for i, x in enumerate(all_) if i not in lost))
    return out


def repeated_runs(docs):
    """Per text, the lines in runs of two or more lines whose pairs all stand in an earlier text: a definition without hashes."""
    seen, out = set(), []
    for _, text in docs:
        all_ = (text or "").split("\n")
        pairs = list(zip(all_, all_[1:]))
        out.append({j for i, p in enumerate(pairs) if p in seen for j in (i, i + 1)})
        seen.update(pairs)
    return out


def test_line_dedup_brute_force(spark):
    """Random documents of few lines: the operator equals plain Python, finds repeated runs whatever their length and keeps
    every distinct line somewhere."""
    rng = random.Random(11)
    pool = [f"line {i}" for i in range(60)]
    blocks = [[f"block {b} line {i}" for i in range(rng.randrange(2, 9))] for b in range(40)]
    docs = []
    for d in range(300):
        own = [f"own {d} {i}" for i in range(rng.randrange(0, 6))]
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(own) + 1)
            own[at:at] = rng.choice(blocks)
        docs.append((d, "\n".join(own + rng.choices(pool, k=rng.randrange(0, 3)))))
    docs += [(900, "\n".join(["same"] * 50)), (901, "\n".join(["same"] * 50 + ["end"])), (902, "\n".join(["a", "b"] * 40)), (903, "\n".join(f"l{i}" for i in range(4000))),
             (904, "\n".join(f"l{i}" for i in range(4000)))]
    got = {r.doc_id: r.text for r in lines.dedup(frame(spark, docs).repartition(5)).collect()}
    assert [got[i] for i, _ in docs] == brute_lines(docs)
    assert {x for t in got.values() for x in t.split("\n")} >= {x for _, t in docs for x in t.split("\n")} - {""}
    assert len(got[904]) < 100 and len(got[902]) < 10   # equal documents lose everything, a period stays once
    wanted = repeated_runs(docs)
    held = sum(len(w) for w in wanted)
    left = 0
    for (i, t), w in zip(docs, wanted):
        stay = collections.Counter(got[i].split("\n"))
        left += sum(stay[x] >= n for x, n in collections.Counter(t.split("\n")[j] for j in w).items())
    assert held > 1000 and left < 0.05 * held


def test_line_dedup_hot_chunk(spark):
    """One block in 40 % of the rows: the first place keeps it, the others lose it but for a few edges of equal class."""
    docs = [(None, BLOCK)] + [(d, f"head {d}\n{BLOCK}\ntail {d}" if d % 5 < 2 else f"only {d}\nand {d}") for d in range(2000)]
    got = {r.doc_id: r.text for r in lines.dedup(frame(spark, docs).repartition(8)).collect()}
    assert [got[i] for i, _ in docs] == brute_lines(docs)
    clean = [got[d] == (f"head {d}\ntail {d}" if d % 5 < 2 else f"only {d}\nand {d}") for d in range(2000)]
    assert got[None] == BLOCK and sum(clean) >= 1990


# ---------------------------------------------------------------- 4

def test_quality_edges(odd, none):
    rows = {r.doc_id: r for r in quality.judge(odd).collect()}
    assert quality.judge(none).count() == 0
    assert rows[1].n_words == 0 and rows[1].base_failed and not rows[1].kept and rows[3].word_chars == 0
    assert rows[14].n_repeat_words == 300 and not rows[14].kept
    assert rows[15].n_symbols == 240 and not rows[15].kept
    assert rows[8].kept and rows[8].n_words == 4000


# ---------------------------------------------------------------- 5

def test_perfect_hash():
    keys = [bytes([a, b]) for a in range(40) for b in range(30)] + [b""]
    table = bpe.PerfectHash(keys)
    assert sorted(table.ids) == list(range(len(keys))) and all(table.get(k) == i for i, k in enumerate(keys))
    assert table.get(b"zzz") == -1


def test_bpe(odd, none):
    import tiktoken

    path = P.path(queries.RANKS)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted(bpe.digests(odd, path, P.PATTERN).collect(), key=key)
    want = []
    for i, t in ROWS:
        ids = encoding.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert list(map(tuple, got)) == sorted(want, key=key)
    encoded = bpe.encode(odd, path, P.PATTERN)
    assert sorted(bytes(r.data) for r in bpe.decode(encoded, path, P.PATTERN).collect()) == sorted((t or "").encode() for _, t in ROWS)
    assert bpe.digests(none, path, P.PATTERN).count() == 0
    encoder, rng = bpe._encoder(path, P.PATTERN), random.Random(1)
    for _ in range(1500):
        t = "".join(rng.choice("ab  \n\t éé漢字12'sllI'm.,!\x1c\x85😀 the and \0") for _ in range(rng.randrange(60)))
        assert encoder.encode(t).tolist() == encoding.encode_ordinary(t), repr(t)


# ---------------------------------------------------------------- 6

def test_word_tokenizer_equals_the_library():
    from tokenizers import Tokenizer

    path, rng = P.path(queries.TOKENIZER), random.Random(1)
    library, own = Tokenizer.from_file(path), packing.WordTokenizer(path, 1)
    letters = "aAbBzZéÉİıßǅǆſ²½Ⅷªº'’sStT.,;:!?#$ \t\n\x1c\x85　\u0301\u0307中Ωσς0123_<|>"
    texts = ["a <|endoftext|> b", "x<|startoftext|>y", "<|ENDOFTEXT|> A", "<|endoftext|>, <|startoftext|>.", "İ? é́! it's THE end..."]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        texts.append(text + rng.choice([*texts[:4], *[""] * 12]))
    assert [ids.tolist() for ids in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert library.encode(texts[0], add_special_tokens=False).ids[1] == 49407


def test_packing(odd, none):
    from tokenizers import Tokenizer

    path = P.path(queries.TOKENIZER)
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack(odd, path, keep_ids=True).collect()
    want = collections.Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in ROWS)
    sequences = collections.defaultdict(list)
    pieces = collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert ids.size == r.length and zlib.crc32(r.ids) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, ids.tolist(), r.doc_tokens))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    tokens = sum(len(ids) * n for (_, ids), n in want.items())
    filled = [sum(n for _, n in parts) for parts in sequences.values()]
    assert sum(filled) == tokens and sum(n if n & (n - 1) == 0 else 2048 for n in filled) <= 1.02 * tokens + 64
    for (doc, ids), n in want.items():
        own = sorted(pieces[doc])
        assert sum(len(p) for _, p, _ in own) == n * len(ids) and all(t == len(ids) for *_, t in own)
        assert all(tuple(p) == ids[s:s + len(p)] for s, p, _ in own)
    assert packing.pack(none, path).count() == 0


# ---------------------------------------------------------------- 7

def test_classifier(spark, sf, odd, none):
    docs, labels = (spark.read.parquet(f"{sf}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = classifier.score(docs, labels)
    tested = scored.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert tested > 0.95
    assert all(0 <= r.score <= 1 for r in classifier.score(odd, labels).collect())
    got = {r.doc_id: r.held_out for r in scored.limit(50).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in got.items())
    kept = classifier.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == scored.where("score >= 0.5").count()
    assert classifier.accepted(odd, labels).columns == odd.columns
    empty = labels.limit(0)
    assert classifier.score(none, empty).count() == 0 and {r.score for r in classifier.score(odd, empty).collect()} == {0.5}


# ---------------------------------------------------------------- 8

def test_licenses(odd, none):
    rows = {r.doc_id: r for r in licenses.scan(odd).collect()}
    for i, t in ROWS:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [k for p in licenses.PHRASES for k in range(len(words)) if words[k:k + len(p.split())] == p.split()]
        assert (rows[i].n_words, rows[i].n_base) == (len(words), len(places))
        assert (rows[i].first_word, rows[i].last_word) == (min(places, default=None), max(places, default=None))
    assert rows[13].base_labels == "apache,gpl,mit" and rows[13].score == 1.0 and rows[4].labels == ""
    assert licenses.scan(none).count() == 0


def test_matching_statistics():
    rng = random.Random(2)
    for _ in range(100):
        seqs = [[rng.choice(b"abc") for _ in range(rng.randrange(1, 12))] for _ in range(3)]
        auto = licenses.SuffixAutomaton(seqs)
        factors = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        for f in factors:
            state, _ = auto.walk(f)
            assert sorted(set(auto.ends[state])) == sorted((k, e) for k, s in enumerate(seqs) for e in range(len(s)) if tuple(s[e + 1 - len(f):e + 1]) == f and e + 1 >= len(f))


# ---------------------------------------------------------------- 9

def test_editing(odd, none, spark):
    rows = editing.classified(odd).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(rows) == len(ROWS) and editing.classified(none).count() == 0
    got = {r.doc_id: r for r in rows}
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[:len(t) - len(t) // 2] + following[:len(t) // 2]
        prints = editing._strings(editing.embed([editing.classes(t), editing.classes(edited)]))
        assert got[i].fingerprint == prints[0] and got[i].n_chars == len(t)
        if i != 9:   # two rows, of which one precedes the other
            assert got[i].edited_fingerprint == prints[1] and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert got[17].class_id == got[18].class_id == 17 and got[17].near_next == 1.0
    single = editing.fingerprints(frame(spark, [(5, "alone in the table")])).first()
    assert single.near_next == 1.0


def test_recall_of_near_classes(spark):
    """Pairs a little above the threshold, against brute force over all fingerprints."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 16, (400, editing.SLOTS), np.uint8)
    near = base.copy()
    for row in near:
        at = rng.choice(editing.SLOTS, rng.integers(1, 25), replace=False)
        row[at] = (row[at] + 1) % 16
    prints = np.concatenate([base, near])
    names = editing._strings(prints)
    alike = [(a, b) for a in range(len(prints)) for b in a + 1 + np.flatnonzero((prints[a + 1:] == prints[a]).mean(axis=1) >= editing.THRESHOLD)]
    table = spark.createDataFrame(list(enumerate(names)), "doc_id long, fingerprint string").withColumn("node", editing.node_of("fingerprint"))
    got = {r.fingerprint: r.class_id for r in table.join(editing.near_classes(table), "node").collect()}
    assert len(alike) == 400 and sum(got[names[a]] == got[names[b]] for a, b in alike) >= 0.95 * len(alike)
    linked = {i: got[n] for i, n in enumerate(names)}
    assert all(linked[i] in (i, i - 400) for i in linked)   # nothing else is in a class


def test_heavy_keys_are_cut_without_loss(spark, monkeypatch):
    """With MAX_RUN = 1 every shared key is cut further, and yet all pairs that share a band are verified, by brute force."""
    rng = np.random.default_rng(12)
    base = rng.integers(0, 16, (200, editing.SLOTS), np.uint8)
    base[100:, :64] = base[100, :64]   # half of them share bands without being near
    prints = [base]
    for _ in range(2):   # chains of three, 25 slots apart
        step = prints[-1].copy()
        for row in step:
            at = rng.choice(editing.SLOTS, 25, replace=False)
            row[at] = (row[at] + 1) % 16
        prints.append(step)
    prints = np.concatenate(prints)
    links = []
    for own in editing.band_slots():
        met = collections.defaultdict(list)
        for i, row in enumerate(prints):
            met[row[own].tobytes()].append(i)
        links += [(a, b) for run in met.values() for k, a in enumerate(run) for b in run[k + 1:] if (prints[a] != prints[b]).sum() <= 25]
    want = list(range(len(prints)))
    for _ in want:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    names = editing._strings(prints)
    table = spark.createDataFrame(list(enumerate(names)), "doc_id long, fingerprint string").withColumn("node", editing.node_of("fingerprint"))
    for limit in (1, 40, editing.MAX_RUN):
        monkeypatch.setattr(editing, "MAX_RUN", limit)
        got = {r.doc_id: r.class_id for r in table.join(editing.near_classes(table), "node").collect()}
        assert [got[i] for i in range(len(prints))] == want, limit


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_shared_keys(size):
    keys = sorted(random.Random(6).choices(range(30), k=40))
    rows = list(zip(keys, range(40)))
    parts = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i:i + size])], names=["key", "node"]) for i in range(0, 40, size)]
    got = [r for b in editing._shared(parts) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert got == [r for r in rows if keys.count(r[0]) > 1] and not list(editing._shared([]))


def test_walk_in_numpy_and_python_agree(monkeypatch):
    rng = random.Random(5)
    parts = [editing.classes("".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(0, 900)))) for _ in range(40)]
    together = editing.embed(parts)
    monkeypatch.setattr(editing, "_FEW", 100)
    assert (editing.embed(parts) == together).all()


# ---------------------------------------------------------------- 10

def brute_repeats(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[k:k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if seen[d[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        spans = sum(1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(d, gone) if not y)).hexdigest()))
    return out


def test_repeated_windows():
    rng = random.Random(3)
    for _ in range(150):
        n = rng.choice([7, 9, 12])
        strings = [bytes(rng.choice(b"ab\0c") for _ in range(rng.randrange(0, 60))) for _ in range(rng.randrange(1, 6))]
        seen = collections.Counter(s[i:i + n] for s in strings for i in range(len(s) - n + 1))
        for s, mask in zip(strings, repeats.repeated_starts(strings, n)):
            assert [seen[s[i:i + n]] > 1 for i in range(len(s) - n + 1)] == mask.tolist()


@pytest.mark.parametrize("variants", [repeats.MAX_VARIANTS, 3, 1])
def test_suffix_dedup(spark, sf, odd, variants):
    more = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id") + 100, "text").toDF("doc_id", "text").collect()]
    docs = [*ROWS, *more, (999, "xy" * 2000)]
    got = sorted((tuple(r) for r in repeats.dedup(frame(spark, docs).repartition(4), max_variants=variants).collect()), key=key)
    want = sorted(((i, *w) for (i, _), w in zip(docs, brute_repeats([t for _, t in docs]))), key=key)
    assert got == want


def test_long_text_in_pieces(monkeypatch):
    rng = random.Random(8)
    text = bytes(rng.choice(b"abcdefgh ") for _ in range(9000))
    monkeypatch.setattr(repeats, "PIECE", 1000)
    _, _, start, stop, _ = repeats._long_segments(text, 200)
    assert start[0] == 0 and stop[-1] == len(text) and sorted(w for a, b in zip(start, stop) for w in range(a, b - 199)) == list(range(len(text) - 199))


def test_rule_lines_are_few_short_variants():
    """A periodic segment of any size is cut into pieces, nearly all of them equal."""
    for text in (b"-" * 200_000, b"=-" * 100_000, b"head " + b"abc" * 70_000 + b" tail"):
        _, hashes, start, stop, own = repeats.segments([text])[0]
        assert (stop - start).max() <= repeats.CUT and len(set(hashes.tolist())) <= 16 and own.any()
        windows = np.concatenate([np.arange(a, b - 199) for a, b in zip(start, stop)])
        assert (windows == np.arange(len(text) - 199)).all()


def test_rule_lines(spark):
    """300 rule lines of 200 KB, a third of them equal: their bytes go whole, and of what stands before them what others share."""
    heads = [f"<{i}>" if i % 3 else "" for i in range(300)]
    ends = collections.Counter(h[k:] for h in heads for k in range(len(h)))
    rows = {r.doc_id: r for r in repeats.dedup(frame(spark, [(i, h + "-" * 200_000) for i, h in enumerate(heads)]).repartition(6)).collect()}
    for i, h in enumerate(heads):
        shared = max((len(h) - k for k in range(len(h)) if ends[h[k:]] > 1), default=0)
        assert (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans) == (200_000 + len(h), 200_000 + shared, 1)


def test_suffix_clean(odd, none):
    out = repeats.clean(odd)
    assert out.columns == odd.columns and out.count() == len(ROWS) and repeats.clean(none).count() == 0


# ---------------------------------------------------------------- pipeline

def without_repeats(texts, length=200):
    """Texts less every byte under a repeated string, by counting all windows."""
    data = [t.encode() for t in texts]
    seen = collections.Counter(d[k:k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = {b for k in range(len(d) - length + 1) if seen[d[k:k + length]] > 1 for b in range(k, k + length)}
        out.append(bytes(x for b, x in enumerate(d) if b not in gone).decode("utf-8", "ignore"))
    return out


def brute_survivors(docs, distance=4):
    """The smallest id of each group of linked fingerprints."""
    prints = [(i, brute_fingerprint(t)) for i, t in docs]
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, f) in enumerate(prints):
        for j, g in prints[:k]:
            if (f ^ g).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i, _ in prints}


def test_pipeline(spark, sf):
    """Every stage against plain Python on its own input: rows, texts and untouched columns; run() against the last texts."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    others = [c for c in columns if c not in ("text", "n_chars")]
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(stage(spark, steps[-1], sf).cache())
        assert steps[-1].columns == columns, name
    tables = [{r.doc_id: r for r in step.collect()} for step in steps]
    assert all(len(t) == s.count() for t, s in zip(tables, steps))
    first, judged, lined, single, cleaned = tables
    scores = classifier.score(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1")
    assert judged == {r.doc_id: first[r.doc_id] for r in scores.select("doc_id").collect()} and 0 < len(judged) < len(first)

    order = sorted(judged)
    expected = dict(zip(order, brute_lines([(i, judged[i].text) for i in order])))
    assert {i: r.text or "" for i, r in lined.items()} == expected and any(expected[i] != judged[i].text for i in order)
    assert set(single) == brute_survivors([(i, lined[i].text) for i in order]) and all(single[i] == lined[i] for i in single)
    order = sorted(single)
    assert {i: r.text or "" for i, r in cleaned.items()} == dict(zip(order, without_repeats([single[i].text or "" for i in order])))
    for before, after in ((judged, lined), (single, cleaned)):
        assert all(r.n_chars == len(r.text or "") or r == before[i] for i, r in after.items())
        assert all([r[c] for c in others] == [before[i][c] for c in others] for i, r in after.items())

    tokenizer = Tokenizer.from_file(P.path(corpus_pipeline.TOKENIZER))
    pieces = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(cleaned)
    for i, own in pieces.items():
        ids, at = tokenizer.encode(cleaned[i].text or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
