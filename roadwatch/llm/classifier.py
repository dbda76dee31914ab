"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Trees fitted on the statistics give paths; every path from a root is a rule. A lasso logistic regression weighs the
rules, and those with a weight are compiled into one Spark column expression, so that scoring is a projection.

The statistics are functions of the text alone; ids, labels, language and source are never inputs. Null and empty texts
have statistics of zero and get a score like any other. Labels with null ids or qualities are ignored, repeated labels of
an id are averaged. Without labels of both kinds the score is the share of label 1 (0.5 without any). Each document
row stands alone, so repeated rows, null ids and extra columns are passed through; empty tables give empty results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadwatch.llm.common import bind, free_name, texts
from roadwatch.session import stored

#: labelled rows that training may use at most: those with the smallest hash of their id
MAX_TRAINING = 20_000
TREES, DEPTH, LASSO, SEED = 8, 3, 0.002, 17
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


STATISTICS = ("log_words chars_per_word distinct_words repeated_words words_per_line distinct_lines "
              "symbols digits capitals stops shouts").split()


def statistics(text: Column) -> Column:
    """The named statistics of a text as one struct of doubles; words and lines are split once."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def measured(parts: Column) -> Column:
        all_, lines, t = parts["words"], parts["lines"], parts["text"]
        same = F.transform(all_, lambda w, i: (i > 0) & (w == F.get(all_, i - 1)))
        n, size = F.greatest(F.size(all_), F.lit(1)), F.greatest(F.length(t), F.lit(1))
        values = [
            F.log1p(F.size(all_)), F.length(t) / n, F.size(F.array_distinct(all_)) / n, F.size(F.filter(same, lambda x: x)) / n,
            n / F.size(lines), F.size(F.array_distinct(lines)) / F.size(lines),
            _count(t, "#*$%&|<>{}[]=_~^\\") / n, _count(t, "0123456789") / size, _count(t, _UPPER) / size,
            _count(t, ".,;:?") / n, _count(t, "!") / n,
        ]
        return F.struct(*[v.cast("double").alias(name) for name, v in zip(STATISTICS, values)])

    return bind(F.struct(words.alias("words"), F.split(text, "\n", -1).alias("lines"), text.alias("text")), measured)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class Ensemble:
    """Weighted rules; a rule is a tuple of (statistic, is upper bound, threshold)."""

    intercept: float
    rules: tuple[tuple[float, tuple[tuple[str, bool, float], ...]], ...]

    def expression(self, stats: Column) -> Column:
        margin = F.lit(self.intercept)
        for weight, rule in self.rules:
            margin = margin + F.when(condition(stats, rule), weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-margin))


def condition(stats: Column, rule: tuple) -> Column:
    out = F.lit(True)
    for name, upper, threshold in rule:
        out = out & ((stats[name] <= threshold) if upper else (stats[name] > threshold))
    return out


_SPLIT = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def paths(tree: str, names: list[str]) -> list[tuple]:
    """Every path from the root of a printed tree; bounds on one statistic are merged into the tightest."""
    found, stack = [], []
    for line in tree.splitlines():
        m = _SPLIT.match(line)
        if not m:
            continue
        depth = len(m[1])
        stack = [s for s in stack if s[0] < depth] + [(depth, names[int(m[2])], m[3] == "<=", float(m[4]))]
        bounds: dict[tuple[str, bool], float] = {}
        for _, name, upper, threshold in stack:
            old = bounds.get((name, upper), threshold)
            bounds[name, upper] = min(old, threshold) if upper else max(old, threshold)
        found.append(tuple(sorted((name, upper, t) for (name, upper), t in bounds.items())))
    return found


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(stats, label) of at most MAX_TRAINING labelled documents that aren't held out."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAINING)
    rows = texts(docs).join(F.broadcast(sample), "doc_id")   # MAX_TRAINING rows of 16 bytes
    # an id with several rows trains with one of them, that of the smallest text hash
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64(F.coalesce("text", F.lit("")))).alias("text"))
    return rows.select("doc_id", "label", statistics(F.col("text")).alias("stats"))


def fit(docs: DataFrame, labels: DataFrame) -> Ensemble:
    rows = stored(training_rows(docs, labels), "training")
    names = STATISTICS
    total, ones = rows.agg(F.count("*"), F.sum("label")).first()
    if not total or ones in (0, total):
        rate = ones / total if total else 0.5
        return Ensemble(30.0 * (2 * rate - 1), ())
    # one ordered partition, so that neither trees nor weights depend on how the rows arrive
    flat = rows.select("doc_id", "label", "stats.*").coalesce(1).sortWithinPartitions("doc_id", *names)
    table = VectorAssembler(inputCols=names, outputCol="features").transform(flat).select("features", "label").cache()
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="0.5").fit(table)
    table.unpersist()
    rules = sorted({rule for tree in forest.trees for rule in paths(tree.toDebugString, names)})
    if not rules:
        share = ones / total
        return Ensemble(30.0 * (2 * share - 1), ())
    stats = F.struct(*[F.col(n) for n in names])
    marked = flat.select("label", F.array(*[condition(stats, r).cast("double") for r in rules]).alias("hits"))
    from pyspark.ml.functions import array_to_vector

    weights = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=100).fit(marked.select("label", array_to_vector("hits").alias("features")))
    return Ensemble(float(weights.intercept), tuple((float(w), r) for w, r in zip(weights.coefficients.toArray(), rules) if w))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    model = fit(docs, labels)
    rows = docs.select("doc_id", statistics(F.col("text")).alias("stats")).select("doc_id", model.expression(F.col("stats")).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, whose score reaches the threshold."""
    model = fit(docs, labels)
    stats, rating, row = (free_name(docs, c) for c in ("_stats", "_score", "_row"))
    # the row number keeps the filter above the projection; below it every rule would compute its statistics again
    rated = docs.withColumn(stats, statistics(F.col("text"))).withColumns({rating: model.expression(F.col(stats)), row: F.monotonically_increasing_id()})
    return rated.where((F.col(rating) >= threshold) & (F.col(row) >= 0)).select(*docs.columns)
