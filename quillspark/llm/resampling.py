"""Operator 11, importance resampling towards a target distribution: hashed word features, found
and hashed by a vectorised automaton over the bytes of Arrow's text buffers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytes_of import blocks, utf8
from .common import fresh, give_back, quoted, ship, table
from .exchange import dealt

#: Longest run of words that is a feature; buckets that features are hashed to; seed of the draw;
#: share of the texts that is drawn, and words that a text needs to be drawn.
RUN, BUCKETS, SEED, PERCENT, LEAST_WORDS = 1, 10_000, 2024, 10, 20

#: What a byte is read as: A-Z as a-z. Bytes of words: digits, letters, and all that is not ASCII.
FOLDED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _shifted(crc: np.ndarray, bits: int) -> np.ndarray:
    for _ in range(bits):
        crc = np.where(crc & np.uint32(1), (crc >> np.uint32(1)) ^ np.uint32(0xEDB88320), crc >> np.uint32(1))
    return crc


_BYTE, _ALL = np.uint32(0xFF), np.uint32(0xFFFFFFFF)
#: A register's low byte to what it adds to the rest: one step of CRC-32.
STEP = _shifted(np.arange(256, dtype=np.uint32), 8)
#: Bytes that a lane takes; words longer than that are several lanes. PAST[k][b]: what byte k of a
#: register, being b, comes to after a whole lane of zeros.
LANE = 64
PAST = [_shifted(np.arange(256, dtype=np.uint32) << np.uint32(8 * k), 8 * LANE) for k in range(4)]


def words(offsets: np.ndarray, folded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of all texts begin and end, from the differences of neighbouring classes.
    A word ends where its text does."""
    inside = IN_WORD[folded]
    first = np.zeros(len(folded) + 1, bool)
    first[offsets] = True
    step = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    both = np.zeros(len(folded) + 1, bool)
    both[1:-1] = inside[:-1] & inside[1:] & first[1:-1]  # two texts meet in the middle of letters
    return np.flatnonzero((step > 0) | both), np.flatnonzero((step < 0) | both)


def _lanes(register: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Registers after length bytes from start, all advanced together; the longest come first, so
    those still under way are always the first ones."""
    order = np.argsort(-length, kind="stable")
    at, left, r = start[order], length[order], register[order]
    for j in range(int(left[0]) if len(left) else 0):
        k = int(np.searchsorted(-left, -j, side="left"))
        r[:k] = STEP[(r[:k] ^ data[at[:k] + j]) & _BYTE] ^ (r[:k] >> np.uint32(8))
    out = np.empty_like(r)
    out[order] = r
    return out


def advance(register: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 registers after length bytes (1 or more) from start. A long word is cut into lanes of
    LANE bytes, its first one shorter; as a register is linear in what it held before, the lanes
    run together and are then joined from left to right."""
    n = (length + LANE - 1) // LANE
    head = length - (n - 1) * LANE
    r = _lanes(register, data, start, head)
    if not len(n) or n.max() == 1:
        return r
    long = np.flatnonzero(n > 1)
    long = long[np.argsort(-n[long], kind="stable")]
    more = n[long] - 1
    place = np.cumsum(more) - more
    turn = np.arange(more.sum()) - np.repeat(place, more)
    began = np.repeat(start[long] + head[long], more) + turn * LANE
    lane = _lanes(np.zeros(len(began), np.uint32), data, began, np.full(len(began), LANE))
    x = r[long]
    for t in range(int(more[0])):
        k = int(np.searchsorted(-more, -t, side="left"))
        y = x[:k]
        x[:k] = PAST[0][y & _BYTE] ^ PAST[1][(y >> np.uint32(8)) & _BYTE] ^ PAST[2][(y >> np.uint32(16)) & _BYTE] ^ PAST[3][y >> np.uint32(24)] ^ lane[place[:k] + t]
    r[long] = x
    return r


def features(offsets: np.ndarray, raw: np.ndarray, run: int = RUN, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, text of each feature, bucket of each feature) of texts in one buffer."""
    folded = FOLDED[raw]
    start, end = words(offsets, folded)
    text = np.searchsorted(offsets, start, side="right") - 1
    n_words = np.bincount(text, minlength=len(offsets) - 1)
    register = advance(np.full(len(start), _ALL), folded, start, end - start)
    texts, found = [text], [(register ^ _ALL).astype(np.int64) % buckets]
    begun = np.arange(len(start))  # words at which a run of the length so far begins
    for size in range(2, run + 1):
        keep = begun + size - 1 < len(start)
        keep[keep] &= text[begun[keep]] == text[begun[keep] + size - 1]
        begun, register = begun[keep], register[keep]
        last = begun + size - 1
        register = STEP[(register ^ np.uint32(32)) & _BYTE] ^ (register >> np.uint32(8))
        register = advance(register, folded, start[last], (end - start)[last])
        texts.append(text[begun])
        found.append((register ^ _ALL).astype(np.int64) % buckets)
    return n_words, np.concatenate(texts), np.concatenate(found)


def bucket_counts(docs: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket, each task's summed up before the shuffle."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, offsets, raw in blocks(*utf8(b.column(0))):
                total += np.bincount(features(offsets, raw, run, buckets)[2], minlength=buckets)
        give_back()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(count, "bucket int, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket, a thousand times the logarithm of its smoothed share of the target's
    features over that of the documents', cut to a whole number. `buckets` rows of each side reach
    the driver."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, rows in ((s, docs), (t, target)):
        for r in bucket_counts(rows, run, buckets).collect():
            counts[r.bucket] = r.n
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((y + 1.0) * all_s / ((x + 1.0) * all_t))) for x, y in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def draw_of(doc_id: Column, seed: int = SEED) -> Column:
    """A thousandfold Gumbel variate, cut to a whole number, that the id and the seed fix."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5).cast("double")) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """docs with n_words, n_features, weight and score added, as the last columns."""
    value = gains(docs, target, run, buckets)
    ship(docs.sparkSession)
    kind = pa.struct([("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    @F.arrow_udf("n_words long, n_features long, weight long")
    def weigh(text: pa.Array) -> pa.Array:
        out = []
        for _, offsets, raw in blocks(*utf8(text)):
            n_words, of, bucket = features(offsets, raw, run, buckets)
            total = np.zeros(len(n_words), np.int64)
            np.add.at(total, of, value[bucket])
            n = np.bincount(of, minlength=len(n_words))
            out.append((n_words, n, total // np.maximum(n, 1)))
        parts = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in parts], fields=list(kind))

    own = fresh(docs, 1)[0]
    rows = docs.withColumn(own, weigh(F.coalesce(F.col("text"), F.lit(""))))
    return rows.select(*quoted(docs), f"{own}.*").withColumn("score", F.col("weight") + draw_of(F.col("doc_id"), seed))


def ranked(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """rows (a written table with doc_id, n_words, score, tie and place, the last different in each
    row) with rank: 1, 2, 3 for the highest scores among rows of least_words or more, as many as
    percent of these; null for all others.

    Scores are whole numbers between fixed bounds (some 110,000 values), so their counts tell the
    driver below which score no row is drawn. Only rows from there on are sorted, by ranges that
    are split by doc_id as well; a row's rank is its number in its range and the sizes of the
    ranges before."""
    spark = rows.sparkSession
    fit = F.col("n_words") >= least_words
    counts = sorted(rows.where(fit).groupBy("score").count().collect(), reverse=True)
    wanted = percent * sum(r["count"] for r in counts) // 100
    seen, cut = 0, None
    for r in counts:
        if seen < wanted:
            cut = r.score
        seen += r["count"]
    none = F.lit(None).cast("long").alias("rank")
    if cut is None:
        return rows.select("*", none)
    above = fit & (F.col("score") >= cut)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie"), F.asc("place")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = table(rows.where(above).repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "ranges")
    before, sizes = 0, []
    for r in sorted(top.groupBy("range").count().collect()):
        sizes.append((r.range, before))
        before += r["count"]
    from pyspark.sql.window import Window

    nth = F.row_number().over(Window.partitionBy("part", "range").orderBy(*order))
    base = F.broadcast(spark.createDataFrame(sizes, "range int, before long"))  # a row for each range
    numbered = dealt(top, "range").withColumn("nth", nth).drop("part").join(base, "range")
    rank = (F.col("nth") + F.col("before")).cast("long")
    return numbered.select(*rows.columns, F.when(rank <= wanted, rank).alias("rank")).unionByName(rows.where(~above).select("*", none))


def _numbers(docs: DataFrame, target: DataFrame, run: int, buckets: int, seed: int, *more: Column) -> DataFrame:
    rows = scored(docs.select("doc_id", "text"), target, run, buckets, seed)
    return rows.select("doc_id", "n_words", "n_features", "weight", "score", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place"), *more)


def importance(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_features, weight, score, rank.

    Features are runs of 1 to `run` words (of a-z, digits, and all characters beyond ASCII; A-Z
    count as a-z). weight is the mean gain of a text's features, cut down to a whole number, 0
    without any; score adds a Gumbel variate of doc_id, so that drawing the highest scores draws
    without replacement in proportion to the exponentials of the weights. rank is null where a text
    is not drawn. Null and empty texts have no words; a null doc_id counts as an empty one and
    comes last among equals. Equal scores go by doc_id, then by a hash of the text; rows that are
    equal in all of these share consecutive ranks. Empty documents give an empty result, an empty
    target gains that depend on the documents alone. Other columns are not read.
    """
    rows = table(_numbers(docs, target, run, buckets, seed), "weights")
    return ranked(rows, percent, least_words).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of docs that are drawn: row (a struct of all columns of docs, of any name), weight,
    score and rank. Nulls, ties, repeats and empty tables: as in importance()."""
    whole = docs.select(F.col("doc_id"), F.col("text"), F.struct(*quoted(docs)).alias("row"))
    rows = scored(whole, target, run, buckets, seed).withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    return ranked(table(rows.drop("text"), "weights"), percent, least_words).where("rank is not null").select("row", "weight", "score", "rank")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return importance(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
with tab as (select list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, x)) as tab),
d as (select doc_id, {_WORDS} as w from documents),
fd as (select doc_id, unnest(w) as w from d), ft as (select unnest({_WORDS}) as w from benchmark),
vocabulary as (select w, list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::bigint) as b from (select w from fd union select w from ft)),
hashed as (select w, xor(list_reduce(b, lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) % {BUCKETS} as bucket from vocabulary, tab),
cs as (select bucket, count(*) as s from fd join hashed using (w) group by bucket), ct as (select bucket, count(*) as t from ft join hashed using (w) group by bucket),
tot as (select coalesce((select sum(s) from cs), 0)::double as s_all, coalesce((select sum(t) from ct), 0)::double as t_all),
gain as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (s_all + {BUCKETS}) / ((s + 1)::double * (t_all + {BUCKETS}))))::bigint as gain from cs left join ct using (bucket), tot),
wt as (select doc_id, count(*) as n, floor(sum(gain)::double / count(*))::bigint as weight from fd join hashed using (w) join gain using (bucket) group by doc_id),
h as (select d.doc_id, len(d.w) as n_words, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight, ('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::bigint as h from d left join wt using (doc_id)),
sc as (select doc_id, n_words, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from h),
dr as (select doc_id, row_number() over (order by score desc, doc_id) as rank from sc where n_words >= {LEAST_WORDS})
select doc_id, n_features::bigint as n_features, weight, score, case when rank <= {PERCENT} * (select count(*) from dr) // 100 then rank end::bigint as rank from sc left join dr using (doc_id)"""
