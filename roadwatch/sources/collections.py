"""JSON documents of any length, written in parallel.

A document is a head, entries in order and a tail. Tasks write ordered part files, whose lines joined in order of the
files' names are the document; nothing is gathered into one row. With ``by`` there is one document per value, each in a folder of
its own. Entries are counted while they are written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

_HEAD, _ENTRY, _TAIL = 0, 1, 2


def write_document(entries: DataFrame, entry: Column, order: Sequence[str], path: str, ends: DataFrame, by: str | None = None) -> int:
    """Write and return the number of entries. ``entry`` is the JSON text of a row, ``order`` names columns that no two rows of a
    document share; ``ends`` has one row per document with the texts ``head`` and ``tail`` (and ``by``)."""
    keys = [F.col(by) if by else F.lit("")]
    seen = Observation("entries")
    rows = entries.select(keys[0].alias("_by"), F.struct(*[F.col(c) for c in order]).alias("_order"), entry.alias("_text"))
    first = rows.groupBy("_by").agg(F.min("_order").alias("_first"))
    rows = rows.join(first, "_by").select(
        "_by", F.lit(_ENTRY).alias("_part"), "_order", F.when(F.col("_order") == F.col("_first"), F.col("_text")).otherwise(F.concat(F.lit(","), "_text")).alias("value"))
    edge = F.explode(F.array(F.struct(F.lit(_HEAD).alias("_part"), F.col("head").alias("value")), F.struct(F.lit(_TAIL).alias("_part"), F.col("tail").alias("value"))))
    none = F.lit(None).cast(rows.schema["_order"].dataType).alias("_order")
    edges = ends.select(keys[0].alias("_by"), edge.alias("e")).select("_by", "e._part", none, "e.value")
    ordered = rows.unionByName(edges).repartitionByRange("_by", "_part", "_order").sortWithinPartitions("_by", "_part", "_order")
    ordered = ordered.observe(seen, F.count_if(F.col("_part") == _ENTRY).alias("n"))
    if by:
        ordered.select(F.col("_by").alias(by), "value").write.partitionBy(by).text(path)
    else:
        ordered.select("value").write.text(path)
    return seen.get["n"]


def read_entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The entries of all documents below ``path`` as ``entry``, in parallel; heads and tails are not entries."""
    lines = spark.read.text(path)
    text = F.regexp_replace("value", "^,", "")
    entry = F.from_json(text, schema)
    whole = F.col("value").startswith("{") & F.col("value").endswith("}") | F.col("value").startswith(",")
    return lines.where(whole).select(*[c for c in lines.columns if c != "value"], entry.alias("entry"))


def read_tails(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The field ``key`` of each document's tail, which closes the list and the document: ``],"key":{...}}``."""
    lines = spark.read.text(path)
    return lines.where(F.col("value").startswith("]")).select(
        *[c for c in lines.columns if c != "value"], F.from_json(F.regexp_extract("value", f'^\\],"{key}":(.*)\\}}$', 1), schema).alias(key))
