"""Finds hashes that occur in several documents, without a shuffled row for each occurrence.

A map task hashes places of its documents, drops what a smaller document of the same batch
already answers, and packs the rest by hash bucket; a reduce task unpacks a bucket, compares the
documents of equal hashes, and packs the places found by document. About 11 bytes are moved for
each place, 15 where hashes are compared by 96 bits. A hash that a third of all documents hold reaches a bucket once from each batch.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, ship, table

#: A place is its position in the text and, from this bit on, which of the texts of its doc_id it is in.
VARIANT = 31
#: Bytes of text that a map task takes at a time.
BATCH_BYTES = 8 << 20
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_HEAD = struct.Struct("<IqBB")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which all bits depend on all."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def xxh64_long(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of 8-byte integers, as Spark's xxhash64 of one long."""

    def rot(v, r):
        return (v << np.uint64(r)) | (v >> np.uint64(64 - r))

    h = np.uint64((seed + int(_P5) + 8) % 2**64) ^ (rot(x.astype(np.int64).view(np.uint64) * _P2, 31) * _P1)
    h = rot(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def groups_of(spark: SparkSession) -> int:
    """Groups of documents: two for each shuffle partition, which whoever runs the job sizes to
    the data. A task holds the texts of one group at a time."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(rows: DataFrame, by: str) -> DataFrame:
    """rows with `part`, shuffled by it: as many of the numbered groups or buckets to each partition,
    where hashes of their numbers would give some partitions several times the rows of others.
    Grouping by part and `by` then needs no other shuffle."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumn("part", F.pmod(F.col(by), F.lit(n))).repartitionById(n, F.col("part"))


def bucket_bits(spark: SparkSession) -> int:
    """Bits of the number of hash buckets: as many buckets as shuffle partitions, and 256 or more.
    Each group of documents sends a row to each bucket."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length())


def doc_group(groups: int, doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.xxhash64(F.col(doc_id).cast("long")), F.lit(groups)), F.lit(0)).cast("int")


def _group_of(doc: np.ndarray, groups: int) -> np.ndarray:
    return (xxh64_long(doc).view(np.int64) % groups).astype(np.int32)


def _narrow(x: np.ndarray) -> tuple[int, bytes]:
    """Unsigned numbers in as few bytes each as the largest needs."""
    w = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return w, x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].tobytes()


def _wide(data: bytes, at: int, n: int, w: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :w] = np.frombuffer(data, np.uint8, n * w, at).reshape(n, w)
    return out.view("<u8")[:, 0]


def pack(doc: np.ndarray, pos: np.ndarray, h: np.ndarray | None = None, check: np.ndarray | None = None) -> bytes:
    """doc ascending; of h the low 56 bits are kept, of check 32."""
    wd, docs = _narrow(np.diff(doc).astype(np.uint64))
    wp, places = _narrow(pos)
    low = b"" if h is None else h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()
    more = b"" if check is None else check.astype("<u4").tobytes()
    return _HEAD.pack(len(doc), int(doc[0]) if len(doc) else 0, wd, wp) + docs + places + low + more


def unpack(data: bytes, with_hash: bool = False, with_check: bool = False) -> tuple[np.ndarray, ...]:
    n, first, wd, wp = _HEAD.unpack_from(data)
    at = _HEAD.size
    doc = np.full(n, first, np.int64)
    if n > 1:
        doc[1:] += np.cumsum(_wide(data, at, n - 1, wd).astype(np.int64))
    at += max(0, n - 1) * wd
    pos = _wide(data, at, n, wp).astype(np.int64)
    at += n * wp
    return (doc, pos, *([_wide(data, at, n, 7)] if with_hash else []), *([np.frombuffer(data, "<u4", n, at + 7 * n)] if with_check else []))


def unpack_all(payloads: list[bytes]) -> dict[int, np.ndarray]:
    """Places by document of payloads without hashes, in ascending order; a place may repeat."""
    if not payloads:
        return {}
    doc, pos = (np.concatenate(x) for x in zip(*map(unpack, payloads), strict=True))
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    cut = np.flatnonzero(np.diff(doc)) + 1
    return {int(doc[a]): pos[a:b] for a, b in zip([0, *cut], [*cut, len(doc)], strict=True) if b > a}


def _by(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.diff(key[order])) + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(key[part[0]]), part


def _compare(h: np.ndarray, doc: np.ndarray, order: np.ndarray, both: bool, check: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """order sorts by h, then doc. Whether each entry is of its hash's smallest document, and
    whether it is found: another document, a smaller one unless `both`, has its hash. With check a
    hash is h and check together; where one h has several checks, which is rare, all is sorted anew."""
    hs, ds = h[order], doc[order]
    new = np.ones(len(hs), bool)
    new[1:] = hs[1:] != hs[:-1]
    if check is not None:
        cs = check[order]
        if (~new[1:] & (cs[1:] != cs[:-1])).any():
            order = np.lexsort((doc, check, h))
            hs, ds, cs = h[order], doc[order], check[order]
            new[1:] = (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])
    start = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    least = ds == ds[start][group]
    found = ~least
    if both:
        several = np.zeros(len(start), bool)
        several[group[~least]] = True
        found = several[group]
    a, b = np.empty(len(hs), bool), np.empty(len(hs), bool)
    a[order], b[order] = least, found
    return a, b


def told_apart(docs: DataFrame) -> DataFrame:
    """doc_id, variant and text (UTF-8 bytes; a null text is empty) of each row. variant numbers the
    different texts of one doc_id from 0, by a 64-bit hash; where no doc_id has two, which one
    aggregation of hashes tells, it is 0 and nothing is joined."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    hashed = rows.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("th"))
    several = hashed.groupBy("doc_id").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a <> b").select("doc_id")
    nth = (F.row_number().over(Window.partitionBy("doc_id").orderBy("th")) - 1).cast("long")
    variants = table(hashed.join(several, "doc_id", "left_semi").distinct().select("doc_id", "th", nth.alias("variant")), "variants")
    if variants.isEmpty():
        return rows.select("doc_id", F.lit(0).cast("long").alias("variant"), "text")
    found = rows.withColumn("th", F.xxhash64("text")).join(variants, ["doc_id", "th"], "left")
    return found.select("doc_id", F.coalesce("variant", F.lit(0).cast("long")).alias("variant"), "text")


def of_variant(places: np.ndarray, variant: int, bit: int = VARIANT) -> np.ndarray:
    """Of the places found for a doc_id those in its variant, as plain positions."""
    return places[places >> bit == variant] & ((1 << bit) - 1)


Places = Callable[[list[bytes]], tuple[np.ndarray, ...]]


def found_elsewhere(rows: DataFrame, places: Places, both: bool = False, name: str = "found", checked: bool = False) -> DataFrame:
    """rows: told_apart(). places(texts) gives (hash, number of the text, place), in the order of the texts, and, where
    checked, 32 bits of another hash. Returns a written table (grp, payload): by doc_group, the
    packed (doc_id, place) whose hash a document of smaller doc_id has as well (both: any other
    document). Hashes are compared by 64 bits, where checked by all 96.
    Documents without doc_id have no places. Of two texts with one doc_id neither is the smaller, and
    the places of each are its own."""
    groups = groups_of(rows.sparkSession)
    bits = bucket_bits(rows.sparkSession) + 2  # so that partitions of one more bucket are hardly larger

    def hit_rows(doc: np.ndarray, pos: np.ndarray) -> Iterator[tuple[int, bytes]]:
        order = np.lexsort((pos, doc))
        doc, pos = doc[order], pos[order]
        for g, part in _by(_group_of(doc, groups)):
            yield g, pack(doc[part], pos[part])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column("doc_id").is_valid())
            b = b.sort_by("doc_id") if b.num_rows else b
            ids, variant, raw = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("variant").to_numpy(zero_copy_only=False), b.column("text").to_pylist()
            start, size = 0, 0
            for i in range(len(raw)):
                size += len(raw[i])
                if size < BATCH_BYTES and i + 1 < len(raw):
                    continue
                h, number, pos, *more = places(raw[start : i + 1])
                check = more[0] if checked else None
                doc = ids[start : i + 1][number] if len(number) else np.zeros(0, np.int64)
                pos = pos | variant[start : i + 1][number] << VARIANT if len(number) else pos
                start, size = i + 1, 0
                least, found = _compare(h, doc, np.argsort(h, kind="stable"), both, check)
                out = [(g % (1 << bits), g, p) for g, p in hit_rows(doc[found], pos[found])] if found.any() else []
                h, doc, pos, check = h[least], doc[least], pos[least], check[least] if checked else None
                out += [(k, -1, pack(doc[x], pos[x], h[x], check[x] if checked else None)) for k, x in _by((h >> np.uint64(64 - bits)).astype(np.int64))] if len(h) else []
                for j in range(0, len(out), 256):
                    k, g, p = zip(*out[j : j + 256], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(g, pa.int32()), pa.array(p, pa.binary())], ["bucket", "grp", "payload"])
                h = doc = pos = number = least = found = out = check = more = None
            b = ids = variant = raw = None
            give_back()

    def meet(t: pa.Table) -> pa.Table:
        g, p = t.column("grp").to_pylist(), t.column("payload").to_pylist()
        out = [(x, y) for x, y in zip(g, p, strict=True) if x >= 0]
        mine = [unpack(y, True, checked) for x, y in zip(g, p, strict=True) if x < 0]
        if mine:
            doc, pos, h, *more = (np.concatenate(x) for x in zip(*mine, strict=True))
            mine = None
            _, found = _compare(h, doc, np.lexsort((doc, h)), both, more[0] if checked else None)
            if found.any():
                out += hit_rows(doc[found], pos[found])
        g, p = zip(*out, strict=True) if out else ((), ())
        return pa.table({"grp": pa.array(g, pa.int32()), "payload": pa.array(p, pa.binary())})

    sent = rows.mapInArrow(send, "bucket int, grp int, payload binary")
    return table(dealt(sent, "bucket").groupBy("part", "bucket").applyInArrow(meet, "grp int, payload binary"), name)


def with_places(rows: DataFrame, found: DataFrame, f: Callable[[int | None, bytes, np.ndarray], dict], schema: str, bit: int = VARIANT) -> DataFrame:
    """f(doc_id, text, places) for each row of told_apart(), with the places that found has for it."""
    groups = groups_of(rows.sparkSession)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at = unpack_all(right.column("payload").to_pylist())
        none = np.zeros(0, np.int64)
        done = [f(d, t, of_variant(at[d], v, bit) if d in at else none) for d, v, t in zip(*(left.column(k).to_pylist() for k in ("doc_id", "variant", "text")), strict=True)]
        return pa.table({k: pa.array([r[k] for r in done], kind) for k, kind in kinds})

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    kinds = [(x.name, to_arrow_type(x.dataType)) for x in StructType.fromDDL(schema).fields]
    left = dealt(rows.withColumn("grp", doc_group(groups)), "grp").groupBy("part", "grp")
    return left.cogroup(dealt(found, "grp").groupBy("part", "grp")).applyInArrow(run, schema)
