"""Operator 12, language identification: Bloom filters of n-grams, bit-sliced by language.

A slot of the filter is a bitmask of languages. The slots that an n-gram is hashed to, taken
together by AND, give all languages whose filter holds it; how often each language's bit is set
over a text, less what its filter would answer by chance, decides."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytes_of import blocks, utf8
from .common import fresh, give_back, quoted, ship, table
from .exchange import mix

#: Bytes of the n-grams. A language's filter holds those that are at least LEAST_SHARE of its
#: n-grams of their size, so it holds at most len(SIZES) / LEAST_SHARE of them, 40,000.
SIZES = (3, 4)
LEAST_SHARE = 5e-5
#: Slots for each n-gram that goes in (then up to a power of two), and slots that each is hashed to.
SLOTS, HASHES = 8, 4
#: Different n-grams that a task of the count holds before it sends them on.
HELD = 1 << 20
UNKNOWN = "und"

#: A byte as it counts: a-z and all beyond ASCII (parts of letters, mostly) as they are, A-Z as
#: a-z, the rest as a space.
_SPACE = 32
_READ = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else _SPACE for b in range(256)], np.uint8)


def spelled(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of the texts with one space before, between and after their words."""
    length, rows = np.diff(offsets), len(offsets) - 1
    wide = np.full(len(raw) + 2 * rows, _SPACE, np.uint8)
    begin = offsets[:-1] + 2 * np.arange(rows)
    wide[np.arange(len(raw)) + np.repeat(2 * np.arange(rows) + 1, length)] = _READ[raw]
    letter = wide != _SPACE
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[begin] = True
    text = np.repeat(np.arange(rows), length + 2)
    return np.concatenate([[0], np.cumsum(np.bincount(text[keep], minlength=rows))]).astype(np.int64), wide[keep]


def ngrams(offsets: np.ndarray, raw: np.ndarray, sizes: tuple[int, ...] = SIZES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, text, n-gram) for each size: the n-grams of all texts as numbers, byte by byte."""
    offsets, data = spelled(offsets, raw)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for size in sizes:
        n = max(0, len(data) - size + 1)
        gram = np.zeros(n, np.uint64)
        for k in range(size):
            gram |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
        inside = text[:n] == text[size - 1 : size - 1 + n]
        yield size, text[:n][inside], gram[inside]


def _keys(gram: np.ndarray, size: int) -> np.ndarray:
    return gram | np.uint64(size << 56)


def ngram_counts(training: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """(lang, size, gram, n) over all texts of training (text, lang) that have both."""
    if max(sizes) > 7:
        raise ValueError("n-grams of up to 7 bytes")
    ship(training.sparkSession)

    def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        lang, key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((key, lang))
        lang, key, n = lang[order], key[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (key[1:] != key[:-1])]))
        return lang[new], key[new], np.add.reduceat(n, new)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        held: list[tuple[np.ndarray, ...]] = []

        def sent() -> pa.RecordBatch:
            lang, key, n = held.pop()
            names = pa.array(list(codes), pa.string())
            return pa.RecordBatch.from_arrays([names.take(pa.array(lang)), pa.array((key >> np.uint64(56)).astype(np.int32)), pa.array((key & np.uint64((1 << 56) - 1)).astype(np.int64)), pa.array(n)], ["lang", "size", "gram", "n"])

        for b in batches:
            code = np.array([codes.setdefault(x, len(codes)) for x in b.column(1).to_pylist()], np.int64)
            for first, offsets, raw in blocks(*utf8(b.column(0))):
                for size, text, gram in ngrams(offsets, raw, sizes):
                    of = code[first + text]
                    for c in np.unique(of):
                        key, n = np.unique(_keys(gram[of == c], size), return_counts=True)
                        held.append((np.full(len(key), c), key, n.astype(np.int64)))
                if sum(len(x[1]) for x in held) > 4 * HELD:
                    held = [merged(held)]
                    if len(held[0][1]) > HELD:
                        yield sent()
        if held:
            held = [merged(held)]
            yield sent()
        give_back()

    rows = training.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    return rows.mapInArrow(count, "lang string, size int, gram long, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Filters:
    """The bit-sliced Bloom filter: slots has a row for each slot, of as many 64-bit words as the
    languages need; by_chance is each language's probability to hold an n-gram that it does not."""

    languages: list[str]
    sizes: tuple[int, ...]
    usual: int
    slots: np.ndarray
    by_chance: np.ndarray

    @staticmethod
    def of(languages: list[str], usual: int, code: np.ndarray, key: np.ndarray, sizes: tuple[int, ...], slots: int | None = None) -> Filters:
        """key[i] goes into the filter of languages[code[i]]."""
        m = 1 << max(6, (slots or SLOTS * max(1, len(np.unique(key))) - 1).bit_length())
        out = Filters(languages, sizes, usual, np.zeros((m, (len(languages) + 63) // 64), np.uint64), np.zeros(len(languages)))
        for at in out._places(key):
            np.bitwise_or.at(out.slots, (at, code // 64), np.uint64(1) << (code % 64).astype(np.uint64))
        fill = np.array([np.count_nonzero(out.slots[:, c // 64] >> np.uint64(c % 64) & np.uint64(1)) for c in range(len(languages))]) / m
        out.by_chance = fill**HASHES
        return out

    def _places(self, key: np.ndarray) -> Iterator[np.ndarray]:
        h = mix(key)
        low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        for k in range(HASHES):
            yield ((low + np.uint64(k) * high) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def masks(self, key: np.ndarray) -> np.ndarray:
        """A row for each key: the bitmask of the languages that hold it."""
        out = None
        for at in self._places(key):
            out = self.slots[at] if out is None else out & self.slots[at]
        return out

    def evidence(self, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """A row for each text, a column for each language: how many of the text's n-grams the
        language holds, less those expected by chance."""
        hits, total = np.zeros((len(offsets) - 1, len(self.languages))), np.zeros(len(offsets) - 1)
        for size, text, gram in ngrams(offsets, raw, self.sizes):
            if not len(text):
                continue
            bits = np.unpackbits(self.masks(_keys(gram, size)).view(np.uint8).reshape(len(text), -1)[:, : (len(self.languages) + 7) // 8], axis=1, bitorder="little")
            begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            hits[text[begin]] += np.add.reduceat(bits, begin, axis=0, dtype=np.int32)[:, : len(self.languages)]
            total += np.bincount(text, minlength=len(total))
        chance = np.minimum(self.by_chance, 1 - 1e-9)
        return np.maximum(0, (hits - total[:, None] * chance) / (1 - chance))

    def decide(self, offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language with most evidence, the first of equals, and its share of all
        evidence. Without any, the language that most was learned of, and 0."""
        found = self.evidence(offsets, raw)
        best, total = found.argmax(1), found.sum(1)
        most = np.take_along_axis(found, best[:, None], 1)[:, 0]
        return np.where(total > 0, best, self.usual), most / np.where(total > 0, total, 1)


def learn(training: DataFrame, sizes: tuple[int, ...] = SIZES, least_share: float = LEAST_SHARE) -> Filters:
    """Filters of all texts of training (text, lang). Of the counts only the totals of each
    language and its at most len(sizes) / least_share frequent n-grams reach the driver."""
    counts = table(ngram_counts(training, sizes), "ngrams")
    totals = counts.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    frequent = counts.join(F.broadcast(totals), ["lang", "size"]).where(F.col("n") >= F.col("total") * least_share).select("lang", "size", "gram")  # two rows for each language
    volume: dict[str, int] = {}
    for r in totals.collect():
        volume[r.lang] = volume.get(r.lang, 0) + r.total
    languages = sorted(volume)
    got = frequent.toArrow()
    number = {x: i for i, x in enumerate(languages)}
    code = np.array([number[x] for x in got.column("lang").to_pylist()], np.int64)
    key = got.column("gram").to_numpy().astype(np.uint64) | (got.column("size").to_numpy().astype(np.uint64) << np.uint64(56))
    usual = min(range(len(languages)), key=lambda i: (-volume[languages[i]], i)) if languages else 0
    return Filters.of(languages, usual, code, key, sizes)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """docs with lang_pred and score (0 to 1) added, from the text alone.

    und, with score 0, where the text is null or has no letter, and everywhere if nothing was
    learned. A text none of whose n-grams is known gets the language that most was learned of, and
    score 0. Ties go to the language that sorts first. Repeated rows are judged alike; an empty
    table gives an empty result; columns of any name stay.
    """
    ship(docs.sparkSession)

    def judge(text: pa.Array) -> pa.Array:
        names = pa.array(filters.languages or [UNKNOWN], pa.string())
        found = [filters.decide(offsets, raw) if filters.languages else (np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1)) for _, offsets, raw in blocks(*utf8(text))]
        best, share = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0))
        return pa.StructArray.from_arrays([names.take(pa.array(best)), pa.array(share)], ["lang", "score"])

    own = fresh(docs, 1)[0]
    judged = docs.withColumn(own, F.arrow_udf(judge, "lang string, score double")(F.coalesce(F.col("text"), F.lit(""))))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return judged.select(*quoted(docs), F.when(letters, F.col(own)["lang"]).otherwise(UNKNOWN).alias("lang_pred"), F.when(letters, F.col(own)["score"]).otherwise(0.0).alias("score"))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a null doc_id is not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    filters = learn(docs.where(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return identify(rows, filters).select("doc_id", "held_out", "lang_pred", "score")
