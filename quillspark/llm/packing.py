"""Operator 9, best-fit packing: a grouping genetic algorithm on islands with elite migration."""

from __future__ import annotations

import random
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, ship, table
from .tokens import CACHE_WORDS, default_path, encoder

CAPACITY = 2048
#: Pieces that are packed together, on average; islands that evolve each such block; rounds of
#: evolution, with a migration of elites between two; children made in a round.
BLOCK_ITEMS = 4096
ISLANDS = 2
EPOCHS = 2
CHILDREN = 40
POPULATION = 5
#: Bins filled less than this are taken apart and packed again with those of other blocks.
FULL = 0.985

Bins = list[list[int]]


def lower_bound(lengths: Sequence[int], capacity: int) -> int:
    """No packing has fewer bins: from the sum, and from the items beside those over half."""
    large = [x for x in lengths if 2 * x > capacity]
    return max(-(-sum(lengths) // capacity), len(large))


def best_fit(items: list[int], lengths: Sequence[int], bins: Bins, capacity: int) -> Bins:
    """Place items, in their order, each in the fullest of bins that holds it, else in a new one.
    bins is changed. Open bins are kept by the room they have left."""
    room: dict[int, list[int]] = {}
    mask = 0
    for i, b in enumerate(bins):
        r = capacity - sum(map(lengths.__getitem__, b))
        if r:
            room.setdefault(r, []).append(i)
            mask |= 1 << r
    for x in items:
        n = lengths[x]
        m = mask >> n
        if m:
            r = n + (m & -m).bit_length() - 1
            stack = room[r]
            i = stack.pop()
            if not stack:
                mask ^= 1 << r
            bins[i].append(x)
            r -= n
        else:
            i, r = len(bins), capacity - n
            bins.append([x])
        if r:
            stack = room.setdefault(r, [])
            if not stack:
                mask |= 1 << r
            stack.append(i)
    return bins


def fitness(bins: Bins, lengths: Sequence[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: smaller is better."""
    return len(bins), -sum((sum(map(lengths.__getitem__, b)) / capacity) ** 2 for b in bins)


def cross(giver: Bins, taker: Bins, lengths: Sequence[int], capacity: int, rng: random.Random) -> Bins:
    """Inject whole well-filled bins of giver into taker: bins of taker that hold one of their
    items go, and what these held besides is placed by best fit, largest first."""
    fills = [sum(map(lengths.__getitem__, b)) for b in giver]
    order = sorted(range(len(giver)), key=lambda i: -fills[i] - rng.random() * capacity * 0.02)
    chosen = [giver[i] for i in order[: max(1, int(len(order) * rng.uniform(0.1, 0.6)))]]
    inside = {x for b in chosen for x in b}
    kept, displaced = [list(b) for b in chosen], []
    for b in taker:
        if inside.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [x for x in b if x not in inside]
    displaced.sort(key=lambda x: -lengths[x])
    return best_fit(displaced, lengths, kept, capacity)


def mutate(bins: Bins, lengths: Sequence[int], capacity: int, rng: random.Random) -> Bins:
    """Empty the least-filled bins and some others, and place their items anew."""
    order = sorted(range(len(bins)), key=lambda i: sum(map(lengths.__getitem__, bins[i])))
    out = set(order[: rng.randint(1, max(1, len(bins) // 50))]) | {rng.randrange(len(bins)) for _ in range(max(2, len(bins) // 30))}
    items = [x for i in out for x in bins[i]]
    items.sort(key=lambda x: -lengths[x] * rng.uniform(0.9, 1.1))
    return best_fit(items, lengths, [list(b) for i, b in enumerate(bins) if i not in out], capacity)


def evolve(lengths: Sequence[int], elites: list[Bins], capacity: int = CAPACITY, children: int = CHILDREN, population: int = POPULATION, seed: int = 0) -> Bins:
    """One round on one island: the best packing found from best fit by decreasing length, random
    orders, and the elites that came in. It ends early where the lower bound is met."""
    rng, score = random.Random(seed), lambda b: fitness(b, lengths, capacity)
    least = lower_bound(lengths, capacity)
    down = sorted(range(len(lengths)), key=lambda x: -lengths[x])
    if not elites:
        elites = [best_fit(down, lengths, [], capacity)]
    pool = sorted(((score(b), b) for b in elites), key=lambda p: p[0])
    if pool[0][0][0] <= least:
        return pool[0][1]
    while len(pool) < population:
        noisy = sorted(down, key=lambda x: -lengths[x] * rng.uniform(0.8, 1.25))
        b = best_fit(noisy, lengths, [], capacity)
        pool.append((score(b), b))
    for _ in range(children):
        pool.sort(key=lambda p: p[0])
        if pool[0][0][0] <= least:
            break
        giver, taker = (min(rng.sample(pool, 2), key=lambda p: p[0])[1] for _ in range(2))
        child = cross(giver, taker, lengths, capacity, rng) if giver is not taker else mutate(giver, lengths, capacity, rng)
        if rng.random() < 0.3:
            child = mutate(child, lengths, capacity, rng)
        s = score(child)
        if s < pool[-1][0] and all(s != p[0] for p in pool):
            pool[-1] = (s, child)
    return min(pool, key=lambda p: p[0])[1]


def _bins_of(assigned: bytes) -> Bins:
    a = np.frombuffer(assigned, "<u4")
    out: Bins = [[] for _ in range(int(a.max()) + 1 if len(a) else 0)]
    for x, b in enumerate(a.tolist()):
        out[b].append(x)
    return out


def _assigned(bins: Bins, n: int) -> bytes:
    a = np.zeros(n, "<u4")
    for i, b in enumerate(bins):
        a[b] = i
    return a.tobytes()


def blocks_of(count: int, block_items: int) -> int:
    return max(1, round(count / block_items))


def pack_level(items: DataFrame, count: int, capacity: int, block_items: int, islands: int, epochs: int, children: int, level: int) -> DataFrame:
    """items (uid, length) to a written table (uid, length, block, bin, fill, at)."""
    blocks = blocks_of(count, block_items)
    parts = min(blocks * islands, 4 * int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    one = items.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(blocks))).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("uid", "length"))).alias("items"))
    state = one.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("elites", F.array().cast("array<binary>"))

    def run(seed: int):
        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    lengths = [x["length"] for x in r["items"]]
                    best = evolve(lengths, [_bins_of(e) for e in r["elites"]], capacity, children, seed=hash((r["block"], r["island"], seed, level)))
                    r |= {"best": _assigned(best, len(lengths)), "bins": len(best), "score": fitness(best, lengths, capacity)[1]}
                    yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("block", "items", "island", "best", "bins", "score")}], schema)

        return f

    item = pa.list_(pa.struct([("uid", pa.int64()), ("length", pa.int32())]))
    schema = pa.schema([("block", pa.int64()), ("items", item), ("island", pa.int32()), ("best", pa.binary()), ("bins", pa.int32()), ("score", pa.float64())])
    for epoch in range(epochs):
        state = state.repartition(parts, "block", "island").mapInArrow(run(epoch), "block long, items array<struct<uid: long, length: int>>, island int, best binary, bins int, score double")
        state = table(state, "islands")
        if epoch + 1 < epochs:  # each island gets the elite of the one before it
            elites = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("best").alias("guest"))
            state = state.join(elites, ["block", "island"]).select("block", "items", "island", F.array("best", "guest").alias("elites"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                rows = []
                for i, members in enumerate(_bins_of(r["best"])):
                    at = 0
                    fill = sum(r["items"][x]["length"] for x in members)
                    for x in members:
                        rows.append((r["items"][x]["uid"], r["items"][x]["length"], r["block"], i, fill, at))
                        at += r["items"][x]["length"]
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["uid", "length", "block", "bin", "fill", "at"])

    best = state.groupBy("block").agg(F.min_by(F.struct("items", "best"), F.struct("bins", "score", "island")).alias("b")).select("block", "b.items", "b.best")
    return table(best.mapInArrow(place, "uid long, length int, block long, bin int, fill int, at int"), "packed")


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0, cache_words: int = CACHE_WORDS) -> DataFrame:
    """A written table of the pieces: uid, doc_id, piece, start, length, ids_crc32."""
    path = tokenizer or default_path("word_bpe_49k.json")
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = struct.pack("<I", end_id)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                some, rows = b.slice(i, 256), []
                for d, ids in zip(some.column("doc_id").to_pylist(), encoder(path, cache_words).encode(some.column("text").to_pylist()), strict=True):
                    ids += end
                    for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[a : a + 4 * capacity]
                        rows.append((d, k, a // 4, len(part) // 4, zlib.crc32(part)))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length int, ids_crc32 long")
    return table(rows.withColumn("uid", F.monotonically_increasing_id()), "pieces")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, block_items: int = BLOCK_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS, children: int = CHILDREN, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Pack the token ids of docs into sequences of at most capacity tokens: one row per piece
    with doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents longer than capacity are cut. A piece of full length is a sequence by itself.
    The others are dealt by hash into blocks of about block_items pieces; islands evolve each
    block apart and pass elites round a ring between rounds; of a block's islands the best counts.
    Bins that stay under FULL are packed again with those of all other blocks, until all that is
    left was packed as one block, or its bins are as few as their tokens can fill, or no bin at all
    was filled. Every island sees a bounded number of lengths, whatever the input;
    only counts reach the driver.

    Null and empty texts are one piece, the end id. Rows that repeat a doc_id are packed each by
    itself; null doc_ids are returned as such; an empty table gives an empty result; other columns
    are not read.
    """
    spark = docs.sparkSession
    every = pieces(docs, capacity, tokenizer, cache_words=cache_words)
    whole = every.where(F.col("length") == capacity).select("uid", (F.lit(1 << 62) + F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_items, done, level = every.where(F.col("length") < capacity).select("uid", "length"), [whole], 0
    n = open_items.count()
    while n:
        packed = pack_level(open_items, n, capacity, block_items, islands, epochs, children, level)
        here = packed.withColumn("sequence_id", F.lit(level << 52) + F.shiftleft(F.col("block"), 20) + F.col("bin"))
        loose = F.col("fill") < int(FULL * capacity)
        left, tokens, bins = here.where(loose).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.count_if(F.col("at") == 0)).first()
        last = blocks_of(n, block_items) == 1 or left == n or bins <= -(-tokens // capacity)
        done.append((here if last else here.where(~loose)).select("uid", "sequence_id", F.col("at").cast("long").alias("offset")))
        if last:
            break
        open_items, n, level = packed.where(loose).select("uid", "length"), left, level + 1
    assigned = done[0]
    for d in done[1:]:
        assigned = assigned.unionByName(d)
    return every.join(assigned, "uid").select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents left, packed; all else as in pack(). A worker keeps
    fewer words in memory, as it shares its executor with what the stages before have left."""
    return pack(docs, cache_words=CACHE_WORDS // 4)
