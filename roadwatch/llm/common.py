"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, which ``bytes.split()`` also splits on
BLANKS = " \t\n\x0b\x0c\r"
#: one batch of texts that a Python worker holds at a time
BATCH_BYTES = 4 << 20


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Only the id and the text: other columns can't clash with what an operator adds."""
    return docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))


def id_field(docs: DataFrame) -> T.StructField:
    return T.StructField("doc_id", docs.schema["doc_id"].dataType)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches where their texts reach ``limit`` bytes (a longer text is a batch of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def map_texts(df: DataFrame, fn: Callable[[dict], dict], schema: T.StructType, column: str = "text") -> DataFrame:
    """Apply ``fn`` (dict of lists to dict of lists) to bounded batches of rows, row order kept."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def run(batches):
        for part in slices(batches, column):
            out = fn(part.to_pydict())
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rk, tk): 128 bits that name a row by id and text, so that joins need neither row numbers nor ids
    without nulls. Rows equal in both are one document to operators that join on them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return texts(docs).select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("rk"), F.xxhash64(text).alias("tk"))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once: an expression inside a lambda would be computed for every element."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))
