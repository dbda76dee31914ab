"""Named queries of the text operators, with their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadwatch.llm import bpe, classifier, editing, lexical, licenses, lines, nearest, packing, periodic, quality, repeats, simhash, urls
from roadwatch.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


TOKENIZER = "word_bpe_49k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"
URL_RULES = [urls.Rule("allow", "org/"), urls.Rule("block", "example.org/es/"), urls.Rule("block", "example.org/en/1"),
             urls.Rule("allow", "com/fr/"), urls.Rule("block", "com/de/")]


def op1_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf, "documents"))


def op2_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge(read(spark, sf, "pages"), URL_RULES)


def op3_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.dedup(read(spark, sf, "documents")).withColumn("kept_sha256", F.sha2("text", 256)).drop("text")


def op4_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(read(spark, sf, "documents"))


def op5_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(read(spark, sf, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(read(spark, sf, "documents"), public_tokenizers.path(TOKENIZER))


def op7_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return classifier.score(read(spark, sf, "documents"), read(spark, sf, "labels"))


def op8_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(read(spark, sf, "documents")).drop("spans")


def op9_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return editing.classified(read(spark, sf, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.dedup(read(spark, sf, "documents"))


def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return periodic.digests(periodic.collapse(periodic.with_repetitions(read(spark, sf, "documents"))))


def op12_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    return nearest.top_k(read(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op13_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.rank(read(spark, sf, "documents"), read(spark, sf, "benchmark"), k=20)


for _query in (op1_simhash, op2_url_filter, op3_line_dedup, op4_quality_rules, op5_byte_bpe, op6_packing,
               op7_quality_classifier, op8_license_scan, op9_fingerprints, op10_suffix_dedup,
               op11_periodic_runs, op12_exact_topk, op13_lexical_search):
    QUERIES[_query.__name__] = _query
ORACLES["op3_line_dedup"] = lines.oracle()
ORACLES["op4_quality_rules"] = quality.oracle()
ORACLES["op12_exact_topk"] = nearest.oracle()
ORACLES["op13_lexical_search"] = lexical.oracle()
