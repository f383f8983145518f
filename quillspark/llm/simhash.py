"""Operator 3, SimHash near-dedup: byte-position inverted index with count filtering."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, fresh, map_batches, quoted, table, texts

BYTES = 8
BLOCKS = 4


def fingerprint(text: bytes, size: int = 3) -> int:
    """64-bit SimHash of the size-word shingles (repeats count) of a UTF-8 text. A-Z are
    lower-cased, words are runs of bytes other than space and \\t-\\r, fewer words than size are
    one shingle, none give 0. Shingles hash by XXH64 with seed 42; a bit is 1 where more than
    half of the hashes have it."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, 42) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = 3, kind: str = "bigint") -> DataFrame:
    """doc_id (of the given type) and fp (the fingerprint as a signed long) of each row. A null text
    is empty."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, size) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return map_batches(texts(docs), run, f"doc_id {kind}, fp bigint")


def _mask(positions: tuple[int, ...]) -> int:
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


def tallied(fps: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b, matches) of the pairs a < b of different fingerprints (column fp, distinct) that share
    the bytes at 8 - distance positions at least, which pairs of `distance` differing bits must.

    Such a pair differs in `distance` of the four blocks of two bytes at most, so it has the same
    bytes in 4 - distance of them. These narrow the index: it posts a fingerprint by each choice of
    as many blocks, and drops those that share none with another. Within a choice the others are
    posted once more, by each of the 2 * distance positions left and the byte that stands there, and
    the postings that two have in common are tallied: `distance` of them, with those of the blocks,
    make the guaranteed count. A choice of blocks fixes 32 bits (at 2), so the lists stay short up
    to billions of fingerprints; beyond random matches there is a row for each near pair and byte.
    """
    blocks = list(combinations(range(BLOCKS), BLOCKS - distance))
    inside = [tuple(p for i in c for p in (2 * i, 2 * i + 1)) for c in blocks]
    each = F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("key")) for k, p in enumerate(inside)))
    first = fps.select("fp", F.inline(each).alias("k", "key"))
    shared = first.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1").select("k", "key")
    some = table(first.join(shared, ["k", "key"], "left_semi"), "candidates")
    left = F.array(*(F.array(*(F.lit(p) for p in range(BYTES) if p not in c)) for c in inside))
    posted = some.withColumn("position", F.explode(F.get(left, F.col("k")))).withColumn("byte", F.expr("shiftright(fp, 8 * position) & 255"))
    x = posted.select("k", "key", "position", "byte", F.col("fp").alias("a"))
    y = posted.select("k", "key", "position", "byte", F.col("fp").alias("b"))
    pairs = x.join(y, ["k", "key", "position", "byte"]).where("a < b")
    tally = pairs.groupBy("k", "a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= distance)
    # a pair that shares more blocks comes up in several choices, with the same total
    return tally.groupBy("a", "b").agg((F.max("n") + (BYTES - 2 * distance)).alias("matches"))


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Written table of the edges (a, b) between different fingerprints (column fp, distinct) of
    `distance` (1 to 3) or fewer differing bits: pairs that the tally retains, verified."""
    if distance not in (1, 2, 3):
        raise ValueError("the blocks are laid out for 1 to 3 differing bits")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return table(tallied(fps, distance).where(close).select("a", "b"), "links")


def _named(fps: DataFrame, distance: int) -> DataFrame:
    """fp, root and component_id (null where no document of the component has a doc_id)."""
    distinct = table(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), distance))
    grouped = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return grouped.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, size: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fp, component_id per row of docs: component_id is the smallest doc_id among the
    documents reachable over links, the document itself included.

    Null, empty and blank texts have fingerprint 0 and are linked like any other. Equal texts
    have equal fingerprints, which are indexed once, so a group of copies costs one entry; rows
    that repeat a doc_id are each returned. A null doc_id counts in no minimum. Other columns are
    not read; an empty table gives an empty result.
    """
    fps = table(fingerprints(docs, size), "fingerprints")
    return fps.join(_named(fps, distance), "fp").select("doc_id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row stays, that of least doc_id (null last) and then
    of least text hash. So rows are judged, not ids: of two texts under one doc_id the copy goes and
    the other stays; a row with null doc_id stays if it is the only one of its component. Of rows
    that repeat both doc_id and text any one stays. An empty table gives an empty one; all columns
    stay, of any name."""
    d, t = fresh(docs, 2)
    hashed = docs.withColumn(t, F.xxhash64("text"))
    prints = fingerprints(docs.select(F.struct("doc_id", F.xxhash64("text").alias("th")).alias("doc_id"), "text"), kind="struct<doc_id: bigint, th: bigint>")
    rows = table(prints.groupBy("doc_id.doc_id", "doc_id.th", "fp").agg(F.count("*").alias("n")), "fingerprints")
    named = _named(rows.select("doc_id", "fp"), 2)
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "th")
    first = rows.join(named, "fp").groupBy("root").agg(F.min(F.struct(order.alias("by"), "n")).alias("one"))
    keep = table(first.select(F.col("one.by.doc_id").alias(d), F.col("one.by.th").alias(t), (F.col("one.n") > 1).alias("many")), "kept")

    def matching(k: DataFrame) -> DataFrame:
        k = k.select(F.col(d), F.col(t).alias(t + "k"))
        return hashed.join(k, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(t) == F.col(t + "k")), "left_semi")

    return matching(keep.where("not many")).select(*quoted(docs)).unionByName(matching(keep.where("many")).dropDuplicates(["doc_id", t]).select(*quoted(docs)))
