"""Operator 5, substring dedup: Rabin-Karp hashes of token windows, merged into intervals."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .exchange import found_elsewhere, mix, told_apart, with_places

WINDOW = 13
#: Words whose hashes a worker remembers.
CACHE_WORDS = 200_000
#: Bases of the two hashes of a window.
_BASE, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


class WordHashes(dict):
    """XXH64 of each word, worked out once."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = WordHashes()


def window_hashes(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rabin-Karp hash (modulo 2**64, over the words' 64-bit hashes), number of the text and
    place of its first word, and 32 bits of a Rabin-Karp hash to another base, for every window of
    `size` words within a text."""
    get, words = _hashes.__getitem__, []
    for t in texts:
        w = t.split()
        words.append(np.fromiter(map(get, w), np.uint64, len(w)))
    length = np.array([len(w) for w in words], np.int64)
    every = np.concatenate(words) if words else np.zeros(0, np.uint64)
    n = len(every) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    number = np.repeat(np.arange(len(texts)), length)
    h, other = every[:n].copy(), every[:n].copy()
    for j in range(1, size):
        h *= _BASE
        h += every[j : j + n]
        other *= _OTHER
        other += every[j : j + n]
    at = np.flatnonzero(number[:n] == number[size - 1 :])
    start = np.cumsum(length) - length
    return mix(h[at]), number[at], at - start[number[at]], (mix(other[at]) >> np.uint64(32)).astype(np.uint32)


def intervals(places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals [start, end) that the windows at ascending places cover; adjoining
    windows merge."""
    if not len(places):
        return places, places
    new = np.append(True, places[1:] > places[:-1] + size)
    return places[new], places[np.append(new[1:], True)] + size


def repeated_windows(rows: DataFrame, size: int = WINDOW) -> DataFrame:
    """A written table of the windows of told_apart() rows that also start in a document with a smaller doc_id. Windows
    are the same if 96 bits are: of n different windows any two are with probability n²/2⁹⁷, which
    is 0.001 for those of 100 TB, 1.5e13."""
    return found_elsewhere(rows, lambda t: window_hashes(t, size), name="windows", checked=True)


def removals(docs: DataFrame, size: int = WINDOW, with_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, starts and ends of the maximal intervals
    of removed words, and, with_text, kept: the words left, joined by one space.

    Null and blank texts have no words; a text of fewer than size words has no window; very long
    texts are taken whole; an empty table gives an empty result. Documents without doc_id neither
    lose words nor count as an earlier document. Rows that repeat a doc_id: equal ones get equal
    results, and of different texts neither is the earlier, and each loses what a smaller doc_id
    has of it. Other columns are not read.
    """

    def one(doc_id, text, places):
        words = text.split()
        a, b = intervals(np.unique(places), size)
        if len(a):
            out, at = [], 0
            for s, e in zip(a.tolist(), b.tolist(), strict=True):
                out += words[at:s]
                at = e
            left = out + words[at:]
        else:
            left = words
        kept = b" ".join(left)
        return {"doc_id": doc_id, "n_words": len(words), "n_removed": len(words) - len(left), "kept_sha256": hashlib.sha256(kept).hexdigest(), "starts": a, "ends": b, "kept": kept}

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, starts array<long>, ends array<long>" + ", kept binary" * with_text
    rows = told_apart(docs)
    return with_places(rows, repeated_windows(rows, size), one, schema)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
t as (select doc_id, words, unnest(range(1, len(words) + 1)) as i from w),
g as (select doc_id, i, array_to_string(words[i:i+12], ' ') as s from t where i + 12 <= len(words)),
f as (select s, min(doc_id) as first from g group by s having count(*) > 1),
hit as (select distinct doc_id, i + j as i from g join f using (s), (select unnest(range(13)) as j) where doc_id > first),
k as (select w.doc_id, len(w.words) as n_words, t.i, w.words[t.i] as word, h.i is not null as removed
      from w left join t on t.doc_id = w.doc_id left join hit h on h.doc_id = t.doc_id and h.i = t.i)
select doc_id, any_value(n_words)::bigint as n_words, count(*) filter (removed)::bigint as n_removed,
  sha256(coalesce(string_agg(word, ' ' order by i) filter (not removed and word is not null), '')) as kept_sha256
from k group by doc_id"""
