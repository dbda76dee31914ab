"""Bounded-space packing of token ids into sequences of a fixed length.

Each partition keeps a fixed number of open windows. A piece goes to the window it fills best; where none fits and no
further window may be opened, the fullest is closed, topped up with the head of the piece if its room is worth a cut.
What stays open at the end of a partition is merged: the windows of a few partitions form one bounded group, are
laid end to end and cut, and the group's last tokens make sequences of powers of two, which need no padding.

Null is the empty text: its end id alone. Rows stand alone, so repeated rows and null ids are packed like
others; an empty table gives no pieces. Very long texts fill whole sequences first.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from roadwatch.llm.bpe import Cache
from roadwatch.llm.common import id_field, slices, texts
from roadwatch.session import stored

LENGTH = 2048
OPEN = 64
#: a window with at most this room is closed as it is
SLACK = 16
#: partitions whose open windows are merged together: OPEN * TOGETHER windows at most
TOGETHER = 16
_MERGED = 1 << 62

_RARE = re.compile("[\x1c-\x1f̀-\U0010ffff]")


#: words that are asked for in one text
JOINED = 256
_MARKS = ".,;:!?"


class WordTokenizer:
    """Ids by the tokenizers library, asked once per white-space separated word while the worker's cache holds it.

    The library splits words into runs of letters, digits and other characters and encodes each run alone, so a word of letters
    with marks behind it is the letters' ids and the marks' ids. Letters are asked for many words at a time: their
    last token, and no other, is one that ends a run.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.letters = Cache(), Cache()
        self.end = np.array([end_id], np.uint32).tobytes()
        self.closes = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.closes[[i for t, i in self.tokenizer.get_vocab(False).items() if t.endswith("</w>")]] = True
        # added tokens are found before case is folded, so texts with such a token in any case are not folded here
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or "(?!)", re.IGNORECASE)

    def _each(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, np.uint32).tobytes() for e in found]

    def _runs(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters."""
        out = []
        groups = [words[i:i + JOINED] for i in range(0, len(words), JOINED)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, np.uint32)
            cuts = (np.flatnonzero(self.closes[ids]) + 1).tolist()
            if len(cuts) == len(group) and cuts[-1] == ids.size:
                data, starts = ids.tobytes(), [0, *cuts]
                out += [data[4 * a:4 * b] for a, b in zip(starts, cuts)]
            else:       # letters that fold into more than letters
                out += self._each(group)
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        stems = [w.rstrip(_MARKS) for w in words]
        plain = [s.isalpha() and (s.isascii() or s.lower().isalpha() and not _RARE.search(s)) for s in stems]
        runs = self.letters.fill({s for s, p in zip(stems, plain) if p}, self._runs)
        rest = {w if not p else w[len(s):] for w, s, p in zip(words, stems, plain)} - {""}
        other = dict(zip(rest, self._each(list(rest))))
        other[""] = b""
        return [runs[s] + other[w[len(s):]] if p else other[w] for w, s, p in zip(words, stems, plain)]

    def split(self, text: str) -> list[str]:
        """The vocabulary folds case and drops white space, so words are independent. Below U+0300 nothing composes,
        and folding first saves entries; other texts are left to the library's own folding."""
        if _RARE.search(text) or self.added.search(text):
            return [w.decode() for w in text.encode("utf-8", "replace").split()]
        return text.lower().split()

    def encode(self, batch: list[str | None]) -> list[np.ndarray]:
        parts = [self.split(t or "") for t in batch]
        known = self.words.fill(set().union(*parts), self._words)
        return [np.frombuffer(b"".join([*map(known.__getitem__, p), self.end]), np.uint32) for p in parts]


@lru_cache(2)
def _tokenizer(path: str, end_id: int) -> WordTokenizer:
    return WordTokenizer(path, end_id)


class Packer:
    """Best fit over a fixed number of open windows. ``put`` returns the windows that it closes."""

    def __init__(self, length: int = LENGTH, windows: int = OPEN, slack: int = SLACK):
        self.length, self.windows, self.slack = length, windows, slack
        self.open: list[tuple[int, int, list]] = []   # (room, number, pieces), by room
        self.number = 0

    def _new(self) -> int:
        self.number += 1
        return self.number - 1

    def put(self, doc, ids: np.ndarray) -> list[tuple[int, list]]:
        closed, start = [], 0
        while ids.size - start >= self.length:
            closed.append((self._new(), [(doc, start, ids[start:start + self.length], ids.size)]))
            start += self.length
        while start < ids.size:
            need = ids.size - start
            at = bisect.bisect_left(self.open, (need,))
            if at < len(self.open):
                room, number, pieces = self.open.pop(at)
            elif len(self.open) < self.windows:
                room, number, pieces = self.length, self._new(), []
            else:
                room, number, pieces = self.open.pop(0)
                if room <= self.slack:
                    closed.append((number, pieces))
                    continue
            take = min(need, room)
            pieces.append((doc, start, ids[start:start + take], ids.size))
            start += take
            if take == room:
                closed.append((number, pieces))
            else:
                bisect.insort(self.open, (room - take, number, pieces), key=lambda w: w[:2])
        return closed


_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def _schema(docs: DataFrame) -> T.StructType:
    longs = [T.StructField(c, T.LongType()) for c in _COLUMNS[1:]]
    return T.StructType([id_field(docs), *longs, T.StructField("team", T.LongType()), T.StructField("ids", T.BinaryType())])


def _pack(path: str, end_id: int, schema: T.StructType, length: int, keep_ids: bool):
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), target)], schema=target)

    def run(batches):
        part = TaskContext.get().partitionId()
        tokenizer, packer = _tokenizer(path, end_id), Packer(length)

        def rows(windows, team=None):
            for number, pieces in windows:
                offset = 0
                for doc, start, ids, total in pieces:
                    kept = ids.astype("<u4").tobytes() if keep_ids or team is not None else None
                    yield doc, start, ids.size, _crc(ids), total, (part << 33) + number, offset, team, kept
                    offset += ids.size

        for piece in slices(batches):
            table = piece.to_pydict()
            out = []
            for doc, ids in zip(table["doc_id"], tokenizer.encode(table["text"])):
                out += rows(packer.put(doc, ids))
            if out:
                yield batch(out)
        rest = list(rows([(number, pieces) for _, number, pieces in packer.open], part // TOGETHER))
        if rest:
            yield batch(rest)

    return run


def _merge(length: int, keep_ids: bool, columns: list[str]):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["sequence_id", "offset"])
        total = int(group["length"].sum())
        sizes = [length] * (total // length) + [1 << b for b in range(length.bit_length(), -1, -1) if total % length >> b & 1]
        base = _MERGED + (int(group["team"].iloc[0]) << 31)
        out, number, room = [], 0, sizes[0]
        for row in group.itertuples(index=False):
            ids, at = np.frombuffer(row.ids, "<u4"), 0
            while at < ids.size:
                take = min(room, ids.size - at)
                part = ids[at:at + take]
                out.append((row.doc_id, row.start + at, take, _crc(part), row.doc_tokens, base + number, sizes[number] - room,
                            None, part.tobytes() if keep_ids else None))
                at, room = at + take, room - take
                if not room:
                    number += 1
                    room = sizes[number] if number < len(sizes) else 0
        frame = pd.DataFrame(out, columns=columns)
        frame["doc_id"] = frame["doc_id"].astype(group["doc_id"].dtype)
        return frame

    return run


def pack(docs: DataFrame, path: str, end_id: int = 1, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``keep_ids`` the ids.

    The first step is written once to the shared folder: both its parts must come from the same packing.
    """
    schema = _schema(docs)
    first = stored(texts(docs).mapInArrow(_pack(path, end_id, schema, length, keep_ids), schema), "packed")
    merged = first.where("team is not null").groupBy("team").applyInPandas(_merge(length, keep_ids, schema.names), schema)
    pieces = first.where("team is null").unionByName(merged)
    return pieces.select(*_COLUMNS, *(["ids"] if keep_ids else []))
