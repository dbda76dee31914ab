"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A rolling hash over the hashes of two neighbouring lines gives each pair of lines one of SPREAD classes. A chunk is a maximal
stretch of pairs of one class: its boundaries lie where the class changes, so an inserted line shifts no later boundary, and
neighbouring chunks share a line. A repeat of two or more lines is missed only where a pair across its edge happens to have the
class of the pair within. Chunks that hold a character other than blanks and equal, byte for byte, an earlier chunk of the
corpus are removed; the first one by (doc_id, text hash, position) stays, but for lines that an earlier chunk repeats too.
So each removed line stands in the same company at an earlier place, and the first such place keeps it.

Null texts count as empty and have no chunk to remove; null ids come first. Rows equal in id and text are one document and
keep the same lines. A text may be left empty, its row stays. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadwatch.llm.common import bind, free_name, keyed

SPREAD = 1024
_FACTOR = 1_000_003
_PRIME = (1 << 31) - 1


def line_hash(line: Column) -> Column:
    """32 bits of the line's MD5, which other engines can compute too."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")


def chunks(text: Column) -> Column:
    """array of (pos, n, body): the first line's number from 0, how many lines, and the lines joined again."""
    lines = F.split(text, "\n", -1)

    def classes(all_: Column) -> Column:
        h, pairs = F.transform(all_, line_hash), F.size(all_) - 1
        rolled = F.zip_with(F.slice(h, 1, pairs), F.slice(h, 2, pairs), lambda x, y: (x % _PRIME * _FACTOR + y) % _PRIME % SPREAD)
        return F.struct(all_.alias("lines"), rolled.alias("classes"))

    def with_starts(parts: Column) -> Column:
        pairs = parts["classes"]
        at = F.transform(pairs, lambda x, i: F.when((i == 0) | (x != F.get(pairs, i - 1)), i))
        return F.struct(parts["lines"].alias("lines"), F.filter(at, lambda i: i.isNotNull()).alias("starts"))

    def cut(parts: Column) -> Column:
        at, all_ = parts["starts"], parts["lines"]

        def piece(start: Column, k: Column) -> Column:
            n = F.coalesce(F.get(at, k + 1), F.size(all_) - 1) - start + 1
            return F.struct(start.alias("pos"), n.alias("n"), F.array_join(F.slice(all_, start + 1, n), "\n").alias("body"))

        return F.transform(at, piece)

    return bind(bind(bind(lines, classes), with_starts), cut)


def _filled(text: Column) -> Column:
    return F.filter(chunks(text), lambda c: c["body"].rlike(r"[^\x20\x09-\x0D]"))


_KEY = ["rk", "tk"]


def removals(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """(rk, tk, gone) for documents that lose chunks; gone is an array of (pos, n). ``placed`` is ``rows`` partitioned by the key.

    Hashes find the candidates, so only texts with repeated hashes give their chunks to the comparison of bytes.
    Counts and first places are combined before each shuffle; joins on a hot chunk may be split.
    """
    found = rows.select(*_KEY, F.posexplode(_filled(F.col("text"))).alias("k", "c"))
    hashes = found.select(*_KEY, "k", F.xxhash64("c.body").alias("hash"))
    repeated = hashes.groupBy("hash").agg(F.count("*").alias("m")).where("m > 1").drop("m")
    wanted = hashes.join(repeated, "hash").groupBy(*_KEY).agg(F.collect_set("k").alias("wanted"))
    picked = bind(_filled(F.col("text")), lambda all_: F.transform("wanted", lambda k: F.get(all_, k)))
    held = placed.join(wanted, _KEY).select("doc_id", *_KEY, F.explode(picked).alias("c"))
    held = held.select(F.struct("doc_id", *_KEY, F.col("c.pos").alias("pos")).alias("place"), F.col("c.n").alias("n"), F.col("c.body").alias("body"))
    first = held.groupBy("body").agg(F.min("place").alias("first"))
    later = held.join(first, "body").where("place != first")
    return later.groupBy(F.col("place.rk").alias("rk"), F.col("place.tk").alias("tk")).agg(
        F.collect_set(F.struct(F.col("place.pos").alias("pos"), "n")).alias("gone"))


def _lost(gone: Column) -> Column:
    """Numbers of the lines in removed chunks, each once."""
    return F.array_distinct(F.flatten(F.transform(gone, lambda g: F.sequence(g["pos"], g["pos"] + g["n"] - 1))))


def _without(text: Column, gone: Column) -> Column:
    def kept(all_: Column) -> Column:
        numbers = F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), _lost(gone))
        return F.array_join(F.transform(numbers, lambda i: F.get(all_, i)), "\n")

    return F.when(gone.isNull(), text).otherwise(bind(F.split(text, "\n", -1), kept))


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed_lines, n_removed_chunks, text): the text without its removed chunks."""
    rows = keyed(docs)
    placed = rows.repartition(*_KEY)
    out = placed.join(removals(rows, placed), _KEY, "left")
    removed = F.coalesce(F.size(_lost(F.col("gone"))), F.lit(0))
    return out.select("doc_id", F.size(F.split("text", "\n", -1)).cast("bigint").alias("n_lines"), removed.cast("bigint").alias("n_removed_lines"),
                      F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed_chunks"), _without(F.col("text"), F.col("gone")).alias("text"))


def clean(docs: DataFrame) -> DataFrame:
    """The documents with all their columns and shortened texts; ``n_chars``, where there is one, follows the text."""
    rows = keyed(docs)
    gone = removals(rows, rows.repartition(*_KEY))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rk, tk, lost = (free_name(docs, c) for c in ("_rk", "_tk", "_gone"))
    named = docs.withColumns({rk: F.xxhash64(F.col("doc_id"), text), tk: F.xxhash64(text)})
    gone = gone.select(F.col("rk").alias(rk), F.col("tk").alias(tk), F.col("gone").alias(lost))
    out = named.join(gone, [rk, tk], "left").withColumn("text", F.when(F.col(lost).isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col(lost))))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(lost).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*docs.columns)


def oracle() -> str:
    """The same rows in DuckDB SQL, for ids without repeats."""
    return f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS i FROM base),
hashed AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM lines),
pairs AS (SELECT doc_id, i, line, lead(line) OVER w AS follower, ((h % {_PRIME}) * {_FACTOR} + lead(h) OVER w) % {_PRIME} % {SPREAD} AS class
  FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
starts AS (SELECT *, CAST(class IS DISTINCT FROM lag(class) OVER (PARTITION BY doc_id ORDER BY i) AS INT) AS s FROM pairs WHERE follower IS NOT NULL),
numbered AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS c FROM starts),
chunks AS (SELECT doc_id, count(*) + 1 AS n, min(i) AS pos, string_agg(line, chr(10) ORDER BY i) || chr(10) || arg_max(follower, i) AS body FROM numbered GROUP BY doc_id, c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS r FROM chunks WHERE regexp_matches(body, '[^\\x20\\x09-\\x0D]')),
gone AS (SELECT doc_id, pos, n FROM ranked WHERE r > 1),
lost AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS i FROM gone),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM lines ANTI JOIN lost USING (doc_id, i) GROUP BY doc_id),
n_lost AS (SELECT doc_id, count(*) AS lines FROM lost GROUP BY doc_id),
n_gone AS (SELECT doc_id, count(*) AS chunks FROM gone GROUP BY doc_id)
SELECT base.doc_id, CAST(len(string_split(base.t, chr(10))) AS BIGINT) AS n_lines, CAST(coalesce(n_lost.lines, 0) AS BIGINT) AS n_removed_lines,
  CAST(coalesce(n_gone.chunks, 0) AS BIGINT) AS n_removed_chunks, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM base LEFT JOIN kept USING (doc_id) LEFT JOIN n_lost USING (doc_id) LEFT JOIN n_gone USING (doc_id)"""
