"""Ranked lexical search by Block-Max MaxScore over compressed postings.

Documents are gathered into shards of a bounded number of documents and postings; a shard's postings of one term are cut at every
WINDOW documents into blocks of packed gaps and counts. Each block keeps the pairs (occurrences, document length) that no other of its
pairs beats; as a contribution grows with occurrences and falls with length, their best is the block's exact maximum
once the corpus statistics are known. For each item and shard, bounds over whole lists split the terms: lists whose bounds
together stay below the k-th best score are non-essential and never propose documents. Windows go by descending bound;
essential blocks are added up, and block maxima of the non-essential lists reject documents before those blocks are unpacked. Only
scores strictly below the k-th best are ever rejected, so ties are whole. The k best of all shards are merged per item.

Terms are maximal stretches of letters, digits and characters beyond ASCII, only A-Z lower-cased. Null and empty texts have no
terms; they are in no statistics and no result. Every row is a document: repeated rows rank side by side, null ids after all
others among equal scores. Each row of items is an item, repeated ones too; an item without terms, an empty table of items or of
documents gives no rows. Texts are read whole; other columns are ignored.

Item texts go to every task, ITEM_BYTES of them in one pass over the documents; more items take more passes.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadwatch.llm.common import id_field, slices, texts
from roadwatch.session import stored

#: documents of one block, of one shard, and postings that close a shard
WINDOW, SHARD_DOCS, SHARD_POSTINGS = 1024, 16_384, 1_000_000
#: UTF-8 bytes of item texts in one pass; one longer item is a pass of its own
ITEM_BYTES = 16 << 20
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


# ---------------------------------------------------------------------- index
def _pack(values: np.ndarray) -> bytes:
    """One byte of width, then the values."""
    top = int(values.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _unpack(data, at: int, n: int) -> tuple[np.ndarray, int]:
    width = data[at]
    return np.frombuffer(data, f"<u{width}", n, at + 1).astype(np.int64), at + 1 + n * width


_SHARD = [T.StructField("n_docs", T.LongType()), T.StructField("n_terms", T.LongType())] + [
    T.StructField(c, T.BinaryType()) for c in ("lengths", "term", "window", "size", "at", "edge", "edge_tf", "edge_n", "packed")]


def _shard(ids: list, lengths: list[int], term: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> list:
    """One shard's columns after its totals. Postings must be sorted by term, then document."""
    size = np.array(lengths, np.int64)
    window = doc // WINDOW
    start = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (window[1:] != window[:-1])]) if term.size else np.zeros(0, np.int64)
    count = np.diff(np.r_[start, term.size])
    packed, at = bytearray(), []
    for s, n in zip(start.tolist(), count.tolist()):
        at.append(len(packed))
        packed += _pack(np.diff(doc[s:s + n], prepend=window[s] * WINDOW)) + _pack(tf[s:s + n])
    # pairs that no pair of the same block beats: by falling occurrences, those shorter than all before
    block = np.repeat(np.arange(start.size), count)
    by = np.lexsort((size[doc], -tf, block))
    short = size[doc][by] - block[by] * (int(size.max(initial=0)) + 1)
    best = np.minimum.accumulate(short)
    keep = np.r_[True, short[1:] < best[:-1]] if by.size else np.zeros(0, bool)
    kept = by[keep]
    edge = np.flatnonzero(np.r_[True, block[kept][1:] != block[kept][:-1]]) if kept.size else np.zeros(0, np.int64)
    arrays = (size, term[start], window[start], count, np.array(at, np.int64), edge, tf[kept], size[doc][kept])
    return [ids, *[a.astype("<i8").tobytes() for a in arrays], bytes(packed)]


def _indexed(vocabulary: dict[bytes, int], schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def run(batches):
        ids: list = []
        lengths: list[int] = []
        held: list[tuple] = []
        postings = n_docs = n_terms = 0

        def flush():
            nonlocal ids, lengths, held, postings, n_docs, n_terms
            parts = [np.concatenate(c) for c in zip(*held)] if held else [np.zeros(0, np.int64)] * 3
            by = np.lexsort((parts[1], parts[0]))
            row = _shard(ids, lengths, *[p[by] for p in parts])
            out = pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip([n_docs, n_terms, *row[1:], row[0]], target)], schema=target)
            ids, lengths, held, postings, n_docs, n_terms = [], [], [], 0, 0, 0
            return out

        for piece in slices(batches):
            rows = piece.to_pydict()
            words = [terms(t) for t in rows["text"]]
            sizes = [len(w) for w in words]
            n_docs += sum(s > 0 for s in sizes)
            n_terms += sum(sizes)
            flat = np.fromiter(map(vocabulary.get, chain.from_iterable(words), repeat(-1)), np.int64, sum(sizes))
            hit = np.flatnonzero(flat >= 0)
            key, tf = np.unique(np.repeat(np.arange(len(words)), sizes)[hit] * len(vocabulary) + flat[hit], return_counts=True)
            doc, term = np.divmod(key, max(1, len(vocabulary)))
            holders, number = np.unique(doc, return_inverse=True)
            at = 0
            while at < holders.size:            # a piece may hold more documents than a shard takes
                take = holders[at:at + SHARD_DOCS - len(ids)].tolist()
                inside = (number >= at) & (number < at + len(take))
                held.append((term[inside], number[inside] - at + len(ids), tf[inside]))
                postings += int(inside.sum())
                ids += [rows["doc_id"][d] for d in take]
                lengths += [sizes[d] for d in take]
                at += len(take)
                if len(ids) >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield flush()
        if n_docs or ids:
            yield flush()

    return run


def index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Shards of the postings of all ``vocabulary`` terms, one row each, in the shared folder."""
    schema = T.StructType([*_SHARD, T.StructField("ids", T.ArrayType(id_field(docs).dataType))])
    return stored(texts(docs).mapInArrow(_indexed(vocabulary, schema), schema), "shards")


def _held(batches):
    """(term, documents) of each shard."""
    for batch in batches:
        for term, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids, at = np.unique(np.frombuffer(term, "<i8"), return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(np.bincount(at, np.frombuffer(size, "<i8"), ids.size).astype(np.int64))], names=["term", "df"])


# --------------------------------------------------------------------- search
class Shard:
    """One shard with corpus statistics applied: block maxima first, blocks unpacked when asked for."""

    def __init__(self, row: dict, n: int, total: int):
        length, self.term, self.window, self.size, self.at, edge, tf, size = (
            np.frombuffer(row[c], "<i8") for c in ("lengths", "term", "window", "size", "at", "edge", "edge_tf", "edge_n"))
        self.spread = lambda lengths: 100 - 25 + (25 * lengths * n) // total
        self.m, self.packed, self.ids = self.spread(length), row["packed"], row["ids"]
        self.best = np.maximum.reduceat(self.gain(tf, self.spread(size)), edge) if edge.size else edge
        self.windows = len(self.ids) // WINDOW + 1
        first = np.flatnonzero(np.r_[True, self.term[1:] != self.term[:-1]]) if self.term.size else edge
        self.lists = {int(t): (int(a), int(b)) for t, a, b in zip(self.term[first], first, np.r_[first[1:], self.term.size])}
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] if self.ids[i] is not None else 0))
        self.place = np.empty(len(by), np.int64)
        self.place[by] = np.arange(len(by))

    @staticmethod
    def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * tf) // (1000 * tf + 12 * m)

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents from the window's first, contributions) of a block, unpacked once."""
        if b not in self.open:
            gaps, at = _unpack(self.packed, int(self.at[b]), int(self.size[b]))
            tf, _ = _unpack(self.packed, at, int(self.size[b]))
            doc = np.cumsum(gaps)
            self.open[b] = doc, self.gain(tf, self.m[doc + int(self.window[b]) * WINDOW])
        return self.open[b]

    def top(self, weights: list[tuple[int, int]], k: int) -> list[tuple[object, int]]:
        """The k best (id, score) above zero for terms with their weights."""
        asked = [(self.lists[t], w) for t, w in weights if t in self.lists and w > 0]
        if not asked:
            return []
        bound = np.zeros((len(asked), self.windows), np.int64)
        where = np.full((len(asked), self.windows), -1, np.int64)
        for i, ((a, b), w) in enumerate(asked):
            bound[i, self.window[a:b]] = self.best[a:b] * w
            where[i, self.window[a:b]] = np.arange(a, b)
        by = np.argsort(bound.max(1), kind="stable")        # weakest lists first
        bound, where, factor = bound[by], where[by], [asked[i][1] for i in by]
        lists = np.cumsum(bound.max(1))
        whole = bound.sum(0)
        docs, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
        for w in np.argsort(-whole, kind="stable").tolist():
            if whole[w] < least:
                break
            essential = int(np.searchsorted(lists, least, "left"))      # lists before it sum up to less than the k-th best
            got = np.zeros(WINDOW, np.int64)
            for i in range(essential, len(factor)):
                if (b := int(where[i, w])) >= 0:
                    doc, gain = self.block(b)
                    got[doc] += gain * factor[i]
            rest = int(bound[:essential, w].sum())
            found = np.flatnonzero((got > 0) & (got + rest >= least))
            for i in sorted(range(essential), key=lambda i: -bound[i, w]):
                if not found.size or (b := int(where[i, w])) < 0:
                    break
                doc, gain = self.block(b)
                got[doc] += gain * factor[i]
                rest -= int(bound[i, w])
                found = found[got[found] + rest >= least]
            if found.size:
                docs, scores = np.r_[docs, found + w * WINDOW], np.r_[scores, got[found]]
                first = np.lexsort((self.place[docs], -scores))[:k]
                docs, scores = docs[first], scores[first]
                if docs.size == k:
                    least = int(scores[-1])
        return [(self.ids[d], s) for d, s in zip(docs.tolist(), scores.tolist())]


def _search(items: list[tuple[int, object, list]], n: int, total: int, k: int, schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                shard = Shard({c: batch.column(c)[at].as_py() for c in batch.schema.names}, n, total)
                rows = [(number, item, doc, score) for number, item, weights in items for doc, score in shard.top(weights, k)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), target)], schema=target)
    return run


def _one_pass(docs: DataFrame, items: list[tuple], k: int, schema: T.StructType) -> DataFrame:
    asked = [(number, item, Counter(terms(text))) for number, (item, text) in enumerate(items)]
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(chain.from_iterable(c for _, _, c in asked)))}
    shards = index(docs, vocabulary)
    n, total = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df = {r.term: r.df for r in shards.select("term", "size").mapInArrow(_held, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[i] + 1))) for t, i in vocabulary.items() if i in df}
    weighted = [(number, item, [(vocabulary[t], weight[t] * q) for t, q in c.items() if t in weight]) for number, item, c in asked]
    found = shards.mapInArrow(_search(weighted, n, total, k, schema), schema)
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 20, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): for every row of ``items`` (item_id, text) its k best documents with a score above 0."""
    asked = items.select("item_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([T.StructField("number", T.LongType()), T.StructField("item_id", asked.schema["item_id"].dataType),
                           id_field(docs), T.StructField("score", T.LongType())])
    held = stored(asked, "items")
    passes = max(1, math.ceil((held.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / item_bytes))
    results = []
    for i in range(passes):
        own = held if passes == 1 else held.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i)
        results.append(_one_pass(docs, [tuple(r) for r in own.collect()], k, schema))
    out = results[0]
    for other in results[1:]:
        out = out.unionByName(other)
    return out


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def oracle(k: int = 20) -> str:
    found = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {found} AS t FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS big_n, CAST(sum(len(t)) AS BIGINT) AS big_l FROM d WHERE len(t) > 0),
it AS (SELECT i, any_value(item_id) AS item_id, term, count(*) AS q FROM (SELECT row_number() OVER () AS i, item_id, unnest({found}) AS term FROM benchmark) GROUP BY i, term),
tf AS (SELECT r, any_value(doc_id) AS doc_id, term, any_value(n) AS n, count(*) AS tf
  FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) SEMI JOIN it USING (term) GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT i, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id,
  CAST(sum(q * CAST(floor(1000 * ln((2 * big_n + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * big_n) // big_l))))) AS BIGINT) AS score
  FROM it JOIN df USING (term) JOIN tf USING (term), st GROUP BY i, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= {k}"""
