"""Cases of single operators that the general tests don't reach."""

import collections
import random
import re

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from roadwatch.llm import bpe, classifier, editing, licenses, queries, urls

MIT = licenses.TEMPLATES[1][1]


# ---------------------------------------------------------------- 2
def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path, rules):
    fitting = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fitting, key=lambda r: (len(r.text), len(r.host), r.text), default=None)


def test_hosts_paths_and_rules_against_plain_python(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    odd = [(-1, None), (-2, "no scheme"), (-3, "HTTP://A.Example.ORG/es/x?y#z"), (-4, "x://example.org/es"), (-5, "x://badexample.org/es/"), (-6, "://org"),
           (-7, "x://example.org/en/1"), (-8, "x://Example.org/en/12"), (-9, "x://m.example.com?de/"), (-10, "x://com/de/#"), (-11, ""), (-12, "x://É.com/fr/É")]
    table = pages.unionByName(spark.createDataFrame(odd, "page_id long, url string"))
    got = {r.page_id: r for r in urls.judge(table, queries.URL_RULES).collect()}
    rows = table.collect()
    assert len(got) == len(rows)
    for r in rows:
        host, path = plain_parts(r.url)
        rule = plain_rule(host, path, queries.URL_RULES)
        assert (got[r.page_id].host, got[r.page_id].path, got[r.page_id].rule) == (host, path, rule and rule.text)
        assert got[r.page_id].verdict == (rule.verdict if rule else "block" if got[r.page_id].score >= 0.5 else "allow")
    assert {r.rule for r in got.values()} >= {"org/", "example.org/es/", "example.org/en/1"}


def test_many_rules_meet_urls_in_joins(spark, monkeypatch):
    """Lists beyond the limit and tables of rules find the rule that plain Python finds; one host holds most URLs and rules."""
    rng = random.Random(2)
    hosts = ["org", "b.org", "a.b.org", "c.a.b.org", "xb.org", "net.", "", "b..org"]

    def path():
        return "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(0, 7)))

    rules = [urls.Rule(rng.choice(["allow", "block"]), rng.choice(hosts + ["b.org"] * 8) + (path() if rng.random() < 0.9 else "")) for _ in range(250)]
    first = {}
    for r in rules:
        first.setdefault(r.text, r)
    rows = [(i, f"x://{rng.choice(hosts + ['a.b.org'] * 8)}{path()}") for i in range(600)] + [(600, None), (601, "x://b.org"), (602, "x://b.org"), (None, "x://b.org/a")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    table = spark.createDataFrame([(r.verdict, r.text, 1) for r in first.values()] + [("allow", None, 1)], "verdict string, text string, host int")
    as_expression = sorted(map(str, urls.judge(pages, list(first.values())).collect()))
    monkeypatch.setattr(urls, "MAX_RULES", 10)
    for given in (rules, table):
        got = urls.judge(pages, given)
        assert sorted(map(str, got.collect())) == as_expression
    for r in got.collect():
        want = plain_rule(r.host, r.path, list(first.values()))
        assert r.rule == (want and want.text) and (not want or r.verdict == want.verdict)
    assert urls.judge(pages, table.limit(0)).where("rule IS NOT NULL").count() == 0


# ---------------------------------------------------------------- 5
def test_perfect_hash_skips_gaps():
    table = bpe.PerfectHash([b"a", b"", b"b", b"", b"", b"cd"])
    assert [table.get(k) for k in (b"a", b"b", b"cd", b"", b"x")] == [0, 2, 5, -1, -1]
    assert bpe.PerfectHash([]).get(b"a") == -1


def test_a_single_gap_is_no_token_of_an_empty_match():
    """A lone empty key is held by the table, but an empty pre-token has no ids."""
    tokens = [bytes([i]) for i in range(256)] + [b""]
    assert bpe.PerfectHash(tokens).get(b"") == 256
    assert bpe.Encoder(tokens, r"[a-z]|(?=\d)").encode("a1b").tolist() == [97, 98]


def test_other_patterns_match_whole_texts():
    tokens = bpe.read_ranks(P.path(queries.RANKS))
    encoder = bpe.Encoder(tokens, r"[a-z]+ [a-z]+|.")      # pre-tokens cross a blank
    assert not encoder.cut and bpe.Encoder(tokens, P.PATTERN, encoder.table).cut
    ids = encoder.encode("some words here").tolist()
    assert encoder.decode(ids) == b"some words here"
    assert ids == [*encoder.merge(b"some words"), *(encoder.table.get(c) for c in (b" ", b"h", b"e", b"r", b"e"))]


# ---------------------------------------------------------------- 7
def test_one_training_row_per_id(spark):
    docs = spark.createDataFrame([(i % 20, f"text number {i} of id {i % 20}") for i in range(400)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(0, 0)] * 5, "doc_id long, quality int")
    rows = classifier.training_rows(docs, labels).collect()
    wanted = {i for i in range(20) if not spark.range(1).select(classifier.held_out(F.lit(i))).first()[0]}
    assert collections.Counter(r.doc_id for r in rows) == dict.fromkeys(wanted, 1)
    again = classifier.training_rows(docs.repartition(7), labels).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_rules_are_the_paths_of_the_trees(spark):
    """Rows that meet the same conditions lie in the same leaf of the tree, others in others."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rng = random.Random(5)
    rows = [(rng.random(), rng.randrange(9), float(rng.random() < 0.5)) for _ in range(400)]
    names = ["a", "b"]
    table = VectorAssembler(inputCols=names, outputCol="features").transform(spark.createDataFrame(rows, "a double, b int, label double"))
    for tree in RandomForestClassifier(numTrees=3, maxDepth=3, seed=1).fit(table).trees:
        found = classifier.paths(tree.toDebugString, names)
        values = F.struct("a", "b")
        hits = table.select(F.array(*[classifier.condition(values, r).cast("int") for r in found]).alias("h"), *names)
        leaf_of = tree.setLeafCol("leaf").transform(table).select("leaf").collect()
        met = {(tuple(r.h), x.leaf) for r, x in zip(hits.collect(), leaf_of)}
        assert len(met) == len({h for h, _ in met}) == len({x for _, x in met}) > 1


# ---------------------------------------------------------------- 8
def test_every_notice_is_a_span():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES)
    n = len(licenses.words(MIT))
    twice = scanner.scan(f"{MIT} then other text of our own {MIT}")
    spans = sorted(s[1:3] for s in twice.spans if s[0] == "mit" and s[3] == 1.0)
    assert spans == [(0, n - 1), (n + 6, 2 * n + 5)]
    assert len(scanner.scan(" some words ".join([MIT] * 7)).spans) == 7
    assert scanner.scan("nothing of the kind").spans == [] and scanner.scan(None).score == 0.0
    half = " ".join(MIT.split()[:3])
    assert scanner.scan(half).spans == [] and 0 <= scanner.scan(half).score < 1


# ---------------------------------------------------------------- 9
def neighbours(rows):
    """Texts by id: their successor in ascending order, the first after the last."""
    order = sorted(rows)
    return {a[0]: b[1] for a, b in zip(order, order[1:] + order[:1])}


@pytest.mark.parametrize("kind", ["text", "dense"])
def test_successors_of_any_ids(spark, kind):
    rng = random.Random(11)
    ids = [f"doc-{i}" for i in range(3000)] if kind == "text" else [*range(10 ** 12, 10 ** 12 + 2990), -5, 0, 7, *range(10 ** 15, 10 ** 15 + 7)]
    rows = [(i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(12)) + f" {i}") for i in ids]
    df = spark.createDataFrame(rows, f"doc_id {'string' if kind == 'text' else 'long'}, text string").repartition(5)
    following = neighbours(rows)
    got = {r.doc_id: r for r in editing.fingerprints(df).select("doc_id", "n_chars", "edited_sha256").collect()}
    import hashlib

    assert len(got) == len(rows)
    for i, text in rows:
        half = len(text) // 2
        edited = text[:len(text) - half] + following[i][:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_buckets_are_even(spark):
    """Clustered ids, outliers, one id in a third of the rows and null ids fill buckets alike."""
    block = spark.range(40_000).select(F.when(F.col("id") < 13_000, 10 ** 9).when(F.col("id") < 20_000, None).when(F.col("id") == 39_999, 10 ** 17).otherwise(F.col("id")).alias("doc_id"),
                                       F.concat(F.lit("text "), "id").alias("text"))
    sizes = [r["count"] for r in editing._bucketed(block).groupBy("bucket").count().collect()]
    assert len(sizes) == 40 and max(sizes) <= 3 * sorted(sizes)[20]


def test_likeness_follows_edit_distance(spark):
    """More edits, less likeness; none, full likeness."""
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefghij klmnop") for _ in range(3000))

    def edited(n):
        chars = list(base)
        for at in rng.sample(range(len(chars)), n):
            chars[at] = rng.choice(["", "zz", "y"])
        return "".join(chars)

    prints = editing.embed([editing.classes(t) for t in [base, base, edited(3), edited(60), edited(900), base[::-1]]])
    alike = [(prints[0] == p).mean() for p in prints[1:]]
    assert alike[0] == 1.0 and alike[1] > alike[2] > alike[3] and alike[1] > 0.8 and alike[4] < 0.5
