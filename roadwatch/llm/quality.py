"""Quality rules: base limits, symbols per word, and the share of characters inside duplicated n-grams and lines.

Words are runs of anything but ASCII white space. Polynomial rolling hashes over word values give all n-grams of several
lengths for a whole batch of texts at once. A duplicated n-gram equals an earlier one of its text; the
characters of all words that lie in such a window are measured against all word characters.

Null or empty texts have no words, fail the base limits and are not kept. Each row stands alone, so repeated rows, null ids,
extra columns and empty tables need no rule of their own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from roadwatch.llm.common import BLANKS, id_field, map_texts, texts

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: per cent of words in repeated 3-word windows above which the base fails
MAX_REPEAT = 50
#: n-gram length -> per cent of word characters that may lie in duplicated n-grams
MAX_DUPLICATED = {5: 30, 6: 29, 7: 28, 8: 27, 9: 26, 10: 25}
#: per cent of a text's characters that may lie in lines equal to an earlier one
MAX_LINE_CHARS = 30
#: symbols per hundred words
MAX_SYMBOLS = 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _duplicated(grams: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks over windows: equal to an earlier one of the document; found twice or more."""
    order = np.lexsort((grams, doc))   # stable: earlier windows of equal value come first
    same = (grams[order][1:] == grams[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    later, any_ = np.zeros(grams.size, bool), np.zeros(grams.size, bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return later, any_


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(batch: list[str | None]) -> dict[str, np.ndarray]:
    """The counts of a batch of texts, one array per column."""
    out = {c: np.zeros(len(batch), np.int64) for c in [*_COUNTS, "text_chars", *(f"dup_chars_{n}" for n in MAX_DUPLICATED)]}
    words: list[bytes] = []
    counts = np.zeros(len(batch), np.int64)
    for i, text in enumerate(batch):
        text = text or ""
        own = text.encode("utf-8", "replace").split()
        words += own
        counts[i] = len(own)
        out["text_chars"][i] = len(text)
        out["n_symbols"][i] = sum(map(text.count, SYMBOLS))
        out["word_chars"][i] = len(text) - sum(map(text.count, BLANKS))
        lines = text.split("\n")
        if len(set(lines)) < len(lines):
            seen: set[str] = set()
            for line in lines:
                if line in seen:
                    out["n_dup_lines"][i] += 1
                    out["dup_line_chars"][i] += len(line)
                elif line.strip(BLANKS):
                    seen.add(line)
    out["n_words"] = counts
    total = len(words)
    if not total:
        return out
    doc = np.repeat(np.arange(len(batch)), counts)
    buffer = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, total))
    points = np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80)])[ends]
    chars = np.diff(points, prepend=0)
    values = np.fromiter(map(hash, words), np.int64, total).view(np.uint64)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(_BASE, total), dtype=np.uint64)])
    undo = _powers(_INVERSE, total)
    for n in (3, *MAX_DUPLICATED):
        if total < n:
            continue
        inside = np.flatnonzero(doc[: total - n + 1] == doc[n - 1:])
        grams = (prefix[inside + n] - prefix[inside]) * undo[inside]
        later, twice = _duplicated(grams, doc[inside])
        if n == 3:
            out["n_repeat_words"] = np.bincount(doc[_covered(inside[twice], n, total)], minlength=len(batch))
        else:
            at = _covered(inside[later], n, total)
            out[f"dup_chars_{n}"] = np.bincount(doc[at], chars[at], len(batch)).astype(np.int64)
    return out


def verdicts(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) in whole numbers, so that no rounding decides."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT * m["n_words"])
    repeated = 100 * m["dup_line_chars"] > MAX_LINE_CHARS * m["text_chars"]
    repeated |= 100 * m["n_symbols"] > MAX_SYMBOLS * m["n_words"]
    for n, limit in MAX_DUPLICATED.items():
        repeated |= 100 * m[f"dup_chars_{n}"] > limit * m["word_chars"]
    return failed, ~failed & ~repeated


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: the counts, base_failed, kept, and the characters in duplicated lines and n-grams."""
    extra = [f"dup_chars_{n}" for n in MAX_DUPLICATED]

    def run(rows):
        m = measure(rows["text"])
        failed, kept = verdicts(m)
        return {"doc_id": rows["doc_id"], "base_failed": failed, "kept": kept} | {c: m[c] for c in [*_COUNTS, *extra]}

    longs = [T.StructField(c, T.LongType()) for c in [*_COUNTS, *extra]]
    flags = [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")]
    return map_texts(texts(docs), run, T.StructType([id_field(docs), *longs[:5], *flags, *longs[5:]]))


def oracle() -> str:
    """The same rows in DuckDB SQL, from all windows of every text."""
    lengths = [3, *MAX_DUPLICATED]
    windows = " UNION ALL ".join(
        f"SELECT k, i, {n} AS n, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - {n - 2})) AS i FROM words WHERE len(w) >= {n})"
        for n in lengths)
    shares = ", ".join(f"CAST(coalesce(sum(c) FILTER (n = {n}), 0) AS BIGINT) AS dup_chars_{n}" for n in MAX_DUPLICATED)
    limits = " AND ".join(f"100 * coalesce(dup_chars_{n}, 0) <= {limit} * word_chars" for n, limit in MAX_DUPLICATED.items())
    blank = "regexp_replace({}, '[\\x20\\x09-\\x0D]', '', 'g')"
    outs = ", ".join(f"coalesce(dup_chars_{n}, 0) AS dup_chars_{n}" for n in MAX_DUPLICATED)
    return f"""
WITH base AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT k, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM base),
windows AS ({windows}),
ranked AS (SELECT k, i, n, row_number() OVER (PARTITION BY k, n, g ORDER BY i) AS r, count(*) OVER (PARTITION BY k, n, g) AS m FROM windows),
hit AS (SELECT DISTINCT k, n, unnest(range(i, i + n)) AS p FROM ranked WHERE CASE WHEN n = 3 THEN m > 1 ELSE r > 1 END),
inside AS (SELECT hit.k, n, length(w[p]) AS c FROM hit JOIN words USING (k)),
grams AS (SELECT k, count(*) FILTER (n = 3) AS n_repeat_words, {shares} FROM inside GROUP BY k),
lines AS (SELECT k, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM base),
dups AS (SELECT k, count(*) AS n_dup_lines, sum(length(line)) AS dup_line_chars FROM (
  SELECT k, line, row_number() OVER (PARTITION BY k, line ORDER BY i) AS r FROM lines WHERE {blank.format('line')} <> '') WHERE r > 1 GROUP BY k),
counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length({blank.format('t')}) AS BIGINT) AS word_chars, length(t) AS text_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(dup_line_chars, 0) AS BIGINT) AS dup_line_chars, {outs}
  FROM base JOIN words USING (k) LEFT JOIN grams USING (k) LEFT JOIN dups USING (k)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM counts)
SELECT * EXCLUDE (text_chars), NOT base_failed AND 100 * dup_line_chars <= {MAX_LINE_CHARS} * text_chars
  AND 100 * n_symbols <= {MAX_SYMBOLS} * n_words AND {limits} AS kept FROM judged"""
