"""Corpus pipeline over documents: quality classifier, line dedup, SimHash near-dedup, suffix-array dedup, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents; the last returns the packed pieces.

Nulls, empty and very long texts, repeated rows, empty tables and extra columns are treated as the operators' modules say. The
stages neither cap nor sample; only the classifier is fitted on a bounded number of labelled rows (classifier.MAX_TRAINING).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadwatch.llm import classifier, lines, packing, repeats, simhash
from roadwatch.llm.common import read
from roadwatch.session import stored

TOKENIZER = "word_bpe_49k.json"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return classifier.accepted(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines are cut out of the texts; every document stays."""
    return lines.clean(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: four-word shingles, at most four differing bits."""
    return simhash.keep_one(docs, width=4, distance=4)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under repeated 200-byte strings are cut out of the texts; every document stays."""
    return repeats.clean(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 token ids, one row per piece."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("simhash near-dedup", simhash_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("packing", pack),
]

#: hashes, suffix arrays and tokenizers have no SQL form; tests/llm compares every stage with plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
