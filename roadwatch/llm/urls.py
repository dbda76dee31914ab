"""URL filter: hand-written rules first, else a logistic regression on hashed character n-grams of host and path.

Everything runs as DataFrame and Spark ML operations in the JVM. A null url, or one without ``://``, has
empty host and path; no rule fits it and the model's intercept decides. Repeated rows are judged alike, other columns
of the table are neither read nor returned. An empty table gives an empty result.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: rules that are compiled into one expression per row; more of them, or a table of rules, meet the URLs in joins
MAX_RULES = 2_000
SIZES = (3, 4, 5)
FEATURES = 1 << 16

#: the small labelled table: words of unwanted and of ordinary hosts, put into the same URL shapes by ``labelled_urls``
UNWANTED = ("ads ad-server adult bets betting banner-track bonus casino cheap-pills click-farm crack crypto-doubler escort "
            "fake-login free-bets free-money gambling hack-tool hot-dates jackpot keygen link-farm loan-shark lottery "
            "malware miracle-diet nude online-poker payday phishing pills pirate popup porn roulette scam sex-cam slots "
            "spam spam-farm spyware torrent track tracker viagra virus warez win-big xxx").split()
ORDINARY = ("academy airport archive art astronomy atlas bakery bank biology books bridge bus cafe camera chemistry "
            "cinema city clinic coast code college community cooking council courses culture daily dentist desk dictionary "
            "docs economy energy engineering events family farm-museum festival fields film forest forum garden geology "
            "gov guide harbour health heritage history home hospital house institute journal kitchen lake language law "
            "letters library lighthouse maps market math media medicine meeting museum music nature news notes observer "
            "open-data opera orchard orchestra paper park philosophy photo physics planet poetry press project radio "
            "railway recipes research review river school science shore society sports station stories studio summer "
            "teacher theatre the-herald times tools town trading trails training transport travel university valley "
            "building clothing drawing gardening hiking learning painting printing reading sailing singing spring swimming "
            "video village water weather weaving wiki winter writers yearbook zoo").split()
SHAPES = ("https://www.{0}.example.com/en/{1}", "http://{0}.example.org/de/{1}.html", "https://m.{0}.example.net/fr/{1}?page=2",
          "http://blog.{0}.example.com/es/{1}/")


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host with its subdomains and all paths that start with the rule's."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2] if "/" in self.text else ""


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    known = F.coalesce(url.contains("://"), F.lit(False))
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.when(known, lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))).otherwise("")
    path = F.when(known, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")
    return host, path


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null without one; of equally long ones that with the longer host."""
    text = verdict = None
    for rule in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text), reverse=True):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, rule.text) if text is None else text.when(fits, rule.text)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(verdict, text); of rules with one text the first."""
    first = {r.text: r.verdict for r in reversed(rules)}
    return spark.createDataFrame([(v, t) for t, v in first.items()], "verdict string, text string")


def rules_by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) for the distinct (host, path) that a rule of the table (verdict, text) fits, the same rule as
    ``rule_for``'s; of verdicts for one text the smallest.

    A host meets rules through its suffixes, a path through its prefixes of the lengths that rules of that suffix have, both by
    equality. So a host with very many rules, or very many URLs, forms no pairs beyond labels times lengths.
    """
    slash = F.instr("text", "/")
    table = rules.where("text IS NOT NULL").groupBy("text").agg(F.min("verdict").alias("verdict")).select(
        "text", "verdict", F.when(slash > 0, F.substr("text", F.lit(1), slash - 1)).otherwise(F.col("text")).alias("rule_host"),
        F.when(slash > 0, F.substr("text", slash)).otherwise("").alias("rule_path"))
    lengths = table.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = urls.select("host").distinct().select("host", F.explode(F.array_distinct(suffixes)).alias("rule_host")).join(lengths, "rule_host")
    prefixes = F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n")
    asked = urls.select("host", "path").distinct().join(hosts, "host").select("host", "path", "rule_host", prefixes)
    asked = asked.withColumn("rule_path", F.substr("path", F.lit(1), F.col("n"))).drop("n")
    best = F.max(F.struct(F.length("text"), F.length("rule_host"), "text", "verdict")).alias("best")
    return asked.join(table, ["rule_host", "rule_path"]).groupBy("host", "path").agg(best).select(
        "host", "path", F.col("best.text").alias("rule"), F.col("best.verdict").alias("verdict"))


def _grams(value: Column, mark: str) -> Column:
    """Hash input: the n-grams of one part, each behind its mark; a part shorter than n has none of that length."""
    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(value) - (n - 1))
        grams = F.transform(starts, lambda i: F.concat(F.lit(mark), F.substr(value, i, F.lit(n))))
        return F.when(F.length(value) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in SIZES])


def with_grams(df: DataFrame, host: Column, path: Column) -> DataFrame:
    """Adds ``grams``; digits of the path count as one character."""
    parts = df.withColumns({"_h": F.concat(F.lit("^"), host, F.lit("$")), "_p": F.regexp_replace(path, "[0-9]", "0")})
    return parts.withColumn("grams", F.concat(_grams(F.col("_h"), "h:"), _grams(F.col("_p"), "p:"))).drop("_h", "_p")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): 1 for unwanted. The words' order fixes the numbers in the paths."""
    rows = [(shape.format(word, 97 * i + 13 * k + 100), label) for label, words in ((1.0, UNWANTED), (0.0, ORDINARY))
            for i, word in enumerate(words) for k, shape in enumerate(SHAPES)]
    return spark.createDataFrame(rows, "url string, label double")


def fit(labelled: DataFrame) -> PipelineModel:
    """Hashing and regression, fitted on (url, label)."""
    host, path = host_and_path(F.col("url"))
    table = with_grams(labelled, host, path).coalesce(1)
    hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True)
    regression = LogisticRegression(regParam=0.02, standardization=False, maxIter=60)
    return PipelineModel([hashing, regression.fit(hashing.transform(table))])


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): score is the model's probability of an unwanted host. ``rules`` may also be
    a table (verdict, text) of any size."""
    spark = pages.sparkSession
    model = fit(labelled if labelled is not None else labelled_urls(spark))
    host, path = host_and_path(F.col("url"))
    table = pages.select("page_id", host.alias("host"), path.alias("path"))
    if isinstance(rules, list) and len(rules) <= MAX_RULES:
        text, verdict = rule_for(F.col("host"), F.col("path"), rules)
    else:
        known = rules_by_join(table, rules_table(spark, rules) if isinstance(rules, list) else rules)
        table = table.join(known.withColumnRenamed("verdict", "_verdict"), ["host", "path"], "left")
        text, verdict = F.col("rule"), F.col("_verdict")
    scored = model.transform(with_grams(table, F.col("host"), F.col("path")))
    score = vector_to_array("probability")[1]
    own = F.when(score >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, own).alias("verdict"), score.alias("score"))
