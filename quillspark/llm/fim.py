"""Operator 13, fill-in-the-middle: texts cut at two unit boundaries and put together anew.

A text is looked at in chunks that overlap by as many bytes as neighbouring bytes are compared.
What tells a boundary, a character or a marker is a predicate of adjacent bytes, so every chunk
is counted by itself; prefix sums of these counts tell which chunk holds the two cuts, and only
these chunks are looked at again."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytes_of import utf8
from .common import fresh, quoted, ship

#: Before the prefix, suffix and middle. All are of three characters, `<`, a letter and `>`.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Seed of the cuts; percentage of texts that are changed, and of these, with the suffix first.
SEED, RATE, SUFFIX_FIRST = 7, 100, 50
#: Bytes of a chunk, and chunks that are counted at a time.
CHUNK, CHUNKS_AT_ONCE = 4096, 1024
_OVERLAP = len(PREFIX) - 1
_NEWLINE, _OPEN, _CLOSE = 10, 60, 62
_LETTER = np.isin(np.arange(256), [ord(x[1]) for x in (PREFIX, SUFFIX, MIDDLE)])


def chunks(offsets: np.ndarray, size: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of the chunks of all texts, without their overlaps."""
    length = np.diff(offsets)
    n = (length + size - 1) // size
    text = np.repeat(np.arange(len(n)), n)
    begin = offsets[text] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * size
    return text, begin, np.minimum(begin + size, offsets[text + 1])


def unit_starts(raw: np.ndarray, low: int, high: int, text_begins: np.ndarray) -> np.ndarray:
    """Whether a unit (a line with its newline) begins at each byte from low to high: the byte
    before is a newline, or it is the first of its text."""
    out = np.empty(high - low, bool)
    out[1:] = raw[low : high - 1] == _NEWLINE
    out[:1] = low > 0 and raw[low - 1] == _NEWLINE
    out[text_begins - low] = True
    return out


def counted(offsets: np.ndarray, raw: np.ndarray, size: int = CHUNK) -> tuple[np.ndarray, ...]:
    """(text, begin, end, units, characters, marked) of each chunk: units that begin in it, its
    characters, and whether a marker begins in it that ends in the same text."""
    text, begin, end = chunks(offsets, size)
    units, chars, marked = (np.zeros(len(text), np.int64) for _ in range(3))
    for a in range(0, len(text), CHUNKS_AT_ONCE):
        b = min(a + CHUNKS_AT_ONCE, len(text))
        low, high = int(begin[a]), int(end[b - 1])
        at = begin[a:b] - low
        here = raw[low:high]
        units[a:b] = np.add.reduceat(unit_starts(raw, low, high, begin[a:b][begin[a:b] == offsets[text[a:b]]]), at, dtype=np.int64)
        chars[a:b] = np.add.reduceat((here & 0xC0) != 0x80, at, dtype=np.int64)
        over = raw[low : min(high + _OVERLAP, len(raw))]
        n = max(0, len(over) - _OVERLAP)
        found = np.flatnonzero((over[:n] == _OPEN) & _LETTER[over[1 : n + 1]] & (over[2 : n + 2] == _CLOSE))
        own = a + np.searchsorted(at, found, side="right") - 1
        own = own[low + found + _OVERLAP < offsets[text[own] + 1]]
        marked[own] = 1
    return text, begin, end, units, chars, marked


def cut_places(offsets: np.ndarray, raw: np.ndarray, first: np.ndarray, second: np.ndarray, size: int = CHUNK) -> tuple[np.ndarray, ...]:
    """For each text (n, prefix, middle, marked): its units, the characters of the first
    min(first % (n+1), second % (n+1)) units, those up to the larger of the two, and whether it
    holds a marker."""
    text, begin, end, units, chars, marked = counted(offsets, raw, size)
    rows = len(offsets) - 1
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in (units, chars, marked)]
    edge = np.searchsorted(text, np.arange(rows + 1))
    n, all_chars, n_marked = (s[edge[1:]] - s[edge[:-1]] for s in sums)
    ranks = [first % (n + 1), second % (n + 1)]
    places = []
    for rank in (np.minimum(*ranks), np.maximum(*ranks)):
        place = np.where(rank == n, all_chars, 0)
        inner = np.flatnonzero((rank > 0) & (rank < n))
        target = sums[0][edge[inner]] + rank[inner]  # over all texts, units before the cut
        owner = np.searchsorted(sums[0], target, side="right") - 1
        for i, c, t in zip(inner, owner, target, strict=True):
            low, high = int(begin[c]), int(end[c])
            starts = np.flatnonzero(unit_starts(raw, low, high, np.array([low]) if low == offsets[i] else np.zeros(0, np.int64)))
            until = low + starts[t - sums[0][c]]
            place[i] = sums[1][c] - sums[1][edge[i]] + np.count_nonzero((raw[low:until] & 0xC0) != 0x80)
        places.append(place)
    return n, places[0], places[1] - places[0], n_marked > 0


_CUTS = pa.struct([("n", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("marked", pa.bool_())])


def _cuts(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    found = cut_places(*utf8(text), first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False))
    return pa.StructArray.from_arrays([pa.array(x) for x in found], fields=list(_CUTS))


def chances(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits that the seed and the id fix."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """row (a struct of all columns of docs, of any name), n, form, prefix_chars, middle_chars,
    output of each row of docs.

    A text of n lines is cut after two numbers of lines that doc_id and the seed fix. form is psm
    (prefix, suffix, middle) or spm (suffix first); it is plain, and the output the text, where
    the text is null or empty, holds one of the markers, or is not among the `rate` percent that
    are changed. Cuts may be equal or lie at an end: that part is empty. A null doc_id counts as an
    empty one; equal doc_ids cut alike; repeated rows each give a row, and an empty table none.
    Texts are not shuffled, and a task holds one Arrow batch of them.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    cuts = F.arrow_udf(_cuts, "n long, prefix_chars long, middle_chars long, marked boolean")
    own, h = fresh(docs, 5), chances(F.col("doc_id"), seed)
    rows = docs.withColumns(dict(zip(own[1:], h, strict=True))).withColumn(own[0], cuts(text, F.col(own[1]), F.col(own[2])))
    cut = F.col(own[0])
    plain = (F.length(text) == 0) | cut["marked"] | (F.col(own[3]) % 100 >= rate)
    form = F.when(plain, "plain").when(F.col(own[4]) % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.select(F.struct(*quoted(docs)).alias("row"), text.alias("text"), cut["n"].alias("n"), form.alias("form"), cut["prefix_chars"].alias("a"), cut["middle_chars"].alias("m"))
    text, a, m = F.col("text"), F.col("a").cast("int"), F.col("m").cast("int")
    prefix, middle, suffix = F.substr(text, F.lit(1), a), F.substr(text, a + 1, m), F.substr(text, a + m + 1)
    output = (
        F.when(F.col("form") == "plain", text)
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    )
    shown = lambda c: F.when(F.col("form") != "plain", F.col(c))
    return rows.select("row", "n", "form", shown("a").alias("prefix_chars"), shown("m").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Cuts lie at line ends and a changed text holds no
    marker, so each marker stands in the output once."""

    def part(after: str, before: str | None) -> Column:
        begin = F.locate(after, output) + 3
        return F.substr(output, begin, F.locate(before, output) - begin) if before else F.substr(output, begin)

    spm = F.concat(part(PREFIX, MIDDLE), part(MIDDLE, None), part(SUFFIX, PREFIX))
    psm = F.concat(part(PREFIX, SUFFIX), part(MIDDLE, None), part(SUFFIX, MIDDLE))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, sha256('{SEED}:' || doc_id) as x from documents),
h as (select *, len(u) as n, ('0x' || x[1:8])::bigint as h1, ('0x' || x[9:16])::bigint as h2, ('0x' || x[17:24])::bigint as h3, ('0x' || x[25:32])::bigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when t = '' or contains(t, '{PREFIX}') or contains(t, '{SUFFIX}') or contains(t, '{MIDDLE}') or h3 % 100 >= {RATE} then 'plain' when h4 % 100 < {SUFFIX_FIRST} then 'spm' else 'psm' end as form from h),
p as (select *, array_to_string(u[:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end::bigint as prefix_chars, case when form <> 'plain' then length(m) end::bigint as middle_chars,
  sha256(case form when 'plain' then t when 'spm' then '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m else '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m end) as output_sha256, sha256(t) as restored_sha256 from p"""
