"""Byte-level BPE: encoding and decoding with the ranks of a public vocabulary file.

Two tiers resolve a pre-token: a minimal perfect hash over the vocabulary finds those that are whole tokens; the
others are merged by a heap over linked bytes, lowest rank first, leftmost of equals. Stretches between plain single
spaces hold no pre-token across their ends, so their ids are kept in a bounded cache of the worker.

Null is the empty text: no ids, digests of the empty string. Special tokens are ordinary text. Rows stand alone: null
ids, repeated rows, extra columns and empty tables are passed through.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable
from functools import lru_cache
from hashlib import sha256

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadwatch.llm.common import id_field, map_texts, texts

#: entries per generation of a cache; two generations are held
CACHE = 200_000
#: the same for pre-tokens and stretches, whose merging costs more than the memory of a longer cache
MERGED = 500_000
_MIX = 0xBF58476D1CE4E5B9
_STEP = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def read_ranks(path: str) -> list[bytes]:
    """Tokens by id from lines of base64 and rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * (1 + max(int(r) for _, r in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def _slot(h: int, d: int, n: int) -> int:
    """``d`` is a displacement times ``_STEP``, as tables hold it."""
    return (((h ^ d) * _MIX & _ALL) >> 31) % n


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: one displacement per bucket, every slot taken once."""

    def __init__(self, keys: list[bytes]):
        """An empty key is held where it stands alone; repeated ones are the gaps of a rank file."""
        gaps = sum(not key for key in keys) > 1
        filled = [i for i, key in enumerate(keys) if key or not gaps]
        keys, numbers = [keys[i] for i in filled], filled
        self.n = max(1, len(keys))
        self.buckets = max(1, len(keys) // 4)
        groups: dict[int, list[tuple[int, int]]] = {}
        for i, key in enumerate(keys):
            h = xxhash.xxh64_intdigest(key)
            groups.setdefault(h % self.buckets, []).append((h, i))
        self.shift = [0] * self.buckets
        self.ids = [-1] * self.n
        taken = bytearray(self.n)
        free = 0
        for bucket, members in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
            if len(members) == 1:   # a bucket of one names its slot
                while taken[free]:
                    free += 1
                taken[free], self.ids[free], self.shift[bucket] = 1, members[0][1], -free - 1
                continue
            d = 0
            while True:
                slots = [_slot(h, d, self.n) for h, _ in members]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    break
                d = d + _STEP & _ALL
            self.shift[bucket] = d
            for s, (_, i) in zip(slots, members):
                taken[s], self.ids[s] = 1, i
        self.keys = [keys[i] if i >= 0 else None for i in self.ids]
        self.ids = [numbers[i] if i >= 0 else -1 for i in self.ids]

    def get(self, key: bytes) -> int:
        """The key's number, or -1 for a key that isn't held."""
        return self.finder()(key)

    def finder(self) -> Callable[[bytes], int]:
        """``get`` as one call with its tables at hand, for loops."""
        digest, shift, buckets, n, ids, keys = xxhash.xxh64_intdigest, self.shift, self.buckets, self.n, self.ids, self.keys

        def get(key: bytes) -> int:
            h = digest(key)
            d = shift[h % buckets]
            s = -d - 1 if d < 0 else (((h ^ d) * _MIX & _ALL) >> 31) % n
            return ids[s] if keys[s] == key else -1

        return get


class Ranks(dict):
    """Numbers of the byte strings asked for lately: merging asks for the same few again and again. Emptied when full."""

    def __init__(self, find: Callable[[bytes], int], limit: int = CACHE):
        self.find, self.limit = find, limit

    def __missing__(self, key: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.find(key)
        return value


class Cache:
    """Two generations of entries: what a full young one lacks is looked up in the old one before it is made anew."""

    def __init__(self, limit: int = CACHE):
        self.young: dict = {}
        self.old: dict = {}
        self.limit = limit

    def fill(self, keys, make) -> dict:
        """A mapping that has all keys; ``make`` is called with the list of those that neither generation has."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        missing = []
        for key in set(keys).difference(self.young):
            value = self.old.get(key)
            if value is None:
                missing.append(key)
            else:
                self.young[key] = value
        if missing:
            self.young.update(zip(missing, make(missing)))
        return self.young


_OTHER_BLANK = re.compile(r"[^\S \n]|\x00")


def stretches(text: str) -> list[str] | None:
    """Pieces that no pre-token crosses, or None where white space isn't plain enough to tell."""
    if _OTHER_BLANK.search(text) or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] == " " or text[-1] == " ":
        return None
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")


def _cuttable(pattern: str) -> bool:
    """Whether ``stretches`` holds: it is known of the public vocabulary's pattern; texts are matched whole by any other."""
    try:
        import public_tokenizers
    except ImportError:
        return False
    return pattern == public_tokenizers.PATTERN


class Encoder:
    """Ids of texts by vocabulary and pre-token pattern."""

    def __init__(self, tokens: list[bytes], pattern: str, table: PerfectHash | None = None):
        self.tokens = tokens
        self.table = table or PerfectHash(tokens)
        self.findall = regex.compile(pattern).findall
        self.cut = _cuttable(pattern)
        self.pieces = Cache(MERGED)
        self.stretched = Cache(MERGED)
        #: ranks of all pairs of bytes, with which every merge begins
        self.rank = Ranks(self.table.finder()).__getitem__
        self.pairs = [self.rank(bytes([a, b])) for a in range(256) for b in range(256)]
        self.decimal = [str(i) for i in range(len(tokens))]

    def merge(self, piece: bytes) -> list[int]:
        """Heap over linked bytes."""
        n, rank, pairs, push, pop = len(piece), self.rank, self.pairs, heapq.heappush, heapq.heappop
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i, (a, b) in enumerate(zip(piece, piece[1:])) if (r := pairs[a << 8 | b]) >= 0]
        heapq.heapify(heap)
        while heap:
            _, i, stop = pop(heap)
            j = after[i] if end[i] else n
            if j >= n or not end[i] or end[j] != stop:
                continue   # one of its sides has been merged meanwhile
            end[i], after[i], end[j] = stop, after[j], 0
            if after[j] < n:
                before[after[j]] = i
                far = end[after[i]]
                r = rank(piece[i:far])
                if r >= 0:
                    push(heap, (r, i, far))
            p = before[i]
            if p >= 0:
                r = rank(piece[p:stop])
                if r >= 0:
                    push(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(rank(piece[i:end[i]]))
            i = after[i]
        return out

    def _pieces(self, found: list[str]) -> list[bytes]:
        out, rank = [], self.rank
        for piece in found:
            data = piece.encode("utf-8", "replace")
            whole = rank(data) if data else -1
            out.append(np.array([whole] if whole >= 0 else self.merge(data), np.uint32).tobytes())
        return out

    def _join(self, text: str) -> bytes:
        found = self.findall(text)
        return b"".join(map(self.pieces.fill(found, self._pieces).__getitem__, found))

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        parts = stretches(text) if self.cut else None
        if parts is None:
            return np.frombuffer(self._join(text), np.uint32)
        known = self.stretched.fill(parts, lambda missing: [self._join(p) for p in missing])
        return np.frombuffer(b"".join(map(known.__getitem__, parts)), np.uint32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(2)
def _encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker process; the file lies on every machine, as its library does."""
    return Encoder(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): token ids of every whole text."""
    def run(rows):
        encoder = _encoder(path, pattern)
        return {"doc_id": rows["doc_id"], "ids": [encoder.encode(t).astype(np.int32) for t in rows["text"]]}

    return map_texts(texts(docs), run, T.StructType([id_field(docs), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data): the bytes of (doc_id, ids); null ids are an empty list."""
    def run(rows):
        encoder = _encoder(path, pattern)
        return {"doc_id": rows["doc_id"], "data": [encoder.decode(ids or ()) for ids in rows["ids"]]}

    table = encoded.select("doc_id", "ids", F.lit("").alias("_none"))
    return map_texts(table, run, T.StructType([id_field(encoded), T.StructField("data", T.BinaryType())]), "_none")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Number of ids, digest of the ids, and digest of the bytes that the ids decode to."""
    def run(rows):
        encoder = _encoder(path, pattern)
        out = {"doc_id": rows["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in rows["text"]:
            ids = encoder.encode(text).tolist()
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(sha256(",".join(map(encoder.decimal.__getitem__, ids)).encode()).hexdigest())
            out["decoded_sha256"].append(sha256(encoder.decode(ids)).hexdigest())
        return out

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return map_texts(texts(docs), run, T.StructType([id_field(docs), *fields]))
