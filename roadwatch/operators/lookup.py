"""Joins that look a small table up from a large one whose key may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadwatch.session import stored

#: rows up to which a counted look-up table is broadcast
BROADCAST_ROWS = 50_000
#: tasks that one key of the large side is spread over beyond that
SALT = 32
_PLAIN = ("string", "boolean", "byte", "short", "integer", "long", "float", "double", "timestamp", "timestamp_ntz", "date")


def look_up(df: DataFrame, table: DataFrame, keys: list[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join on equal names. The look-up table is stored and counted, then broadcast, or met by salted keys.

    Null keys find nothing. The salt is a hash of the row, so a task that runs again deals its rows alike.
    """
    held = stored(table, "lookup")
    if held.count() <= limit:
        return df.join(F.broadcast(held), keys, how)
    plain = [f.name for f in df.schema if f.dataType.typeName() in _PLAIN]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(SALT)))
    copies = held.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
