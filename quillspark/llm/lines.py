"""Operator 2, line dedup: MinHash over character shingles, in DataFrame functions alone."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, fresh, quoted, remove, settle, table, unchecked

#: Characters of a shingle; least Jaccard similarity of two lines. Every run of so many characters of
#: a line is a shingle, and a shorter line is one shingle as a whole. Characters are UTF-16 units, so
#: one beyond U+FFFF counts as two.
SHINGLE = 12
SIMILARITY = 0.8
#: Minima of a signature, and the bands: the minima that are hashed into one key each. The nine
#: minima, as a square, make a band of each row, column and diagonal, which may wrap round, so that
#: each serves four bands. A pair at 0.8 shares a band with probability 0.990, at 0.85 with 0.998.
HASHES = 9
BANDS = ((0, 1, 2), (3, 4, 5), (6, 7, 8), (0, 3, 6), (1, 4, 7), (2, 5, 8), (0, 4, 8), (1, 5, 6), (2, 3, 7), (2, 4, 6), (0, 5, 7), (1, 3, 8))
#: Longs of bits that a line carries to bound what it can share with another: a power of two. Those
#: of two lines and what is beside them stay under a hundred columns, up to which Spark compiles a join.
WORDS = 32
#: Shingles that one row of a line stands for: what is done for each row is shared by them. IN_SETS
#: where they are only gathered, IN_BITS where the code that Spark makes would be long.
STEP = 8
IN_SETS = 16
IN_BITS = 4
#: Lines of a bucket that one slice of the last round compares with all of the bucket.
SLICE = 1024
#: Leaders that a bucket gets in each round of leaders. After the rounds all pairs left are compared.
LEADERS = (3, 12)


def _functions(n: int) -> list[tuple[int, int]]:
    """What n hash functions multiply by (odd) and mix in, drawn independently; all of 31 bits."""
    rng = random.Random(20)
    return [(2 * rng.randrange(1 << 30) + 1, rng.randrange(1 << 31)) for _ in range(n)]


def _has_word(c: Column) -> Column:
    return F.ltrim(c, F.lit(" \t\n\x0b\x0c\r")) != ""


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, th (the text's hash), line_no, line for each \\n-split line that has a word."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).alias("line_no", "line"))
    return rows.where(_has_word(F.col("line")))


def _line_id(line: Column) -> Column:
    return F.xxhash64(line)


def _units(line: Column) -> Column:
    """The line in UTF-16, two bytes for each character."""
    return F.encode(line, "UTF-16BE")


def _last(shingle: int) -> Column:
    """Where the last shingle of a line u begins; a shorter line is one shingle as a whole."""
    return F.greatest(F.expr("int(length(u) / 2)") - shingle, F.lit(0))


def _shingle(at: Column, shingle: int) -> Column:
    """The hash of the shingle of u that begins there."""
    return F.xxhash64(F.substring(F.col("u"), at * 2 + 1, F.lit(2 * shingle)))


def _hashed(lines: DataFrame, shingle: int, step: int = STEP) -> DataFrame:
    """The columns of lines but u, and h0..: a row for every `step` shingles of u; in the last row of
    a line its last shingle is repeated."""
    names = [c for c in lines.columns if c != "u"]
    each = lines.select(*names, "u", _last(shingle).alias("last")).select(*names, "u", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(step))).alias("at"))
    with unchecked(lines.sparkSession):  # places in an array
        return each.select(*names, *(_shingle(F.least(F.col("at") + i, F.col("last")), shingle).alias(f"h{i}") for i in range(step)))


def signatures(docs: DataFrame, shingle: int = SHINGLE, hashes: int = HASHES) -> DataFrame:
    """lid and m0.., the minima of the hash functions over its shingles, for each different line."""
    each = occurrences(docs).select(_line_id(F.col("line")).alias("lid"), _units(F.col("line")).alias("u"))
    top = [F.shiftrightunsigned(f"h{i}", 33).alias(f"x{i}") for i in range(STEP)]
    # products of 31 bits and 31 bits
    value = lambda x, a, b: (F.col(x).bitwiseXOR(F.lit(b)) * F.lit(a)).bitwiseAND(F.lit((1 << 31) - 1))
    least = lambda a, b: F.least(*(value(f"x{i}", a, b) for i in range(STEP)))
    with unchecked(docs.sparkSession):
        return _hashed(each, shingle).select("lid", *top).groupBy("lid").agg(*(F.min(least(a, b)).alias(f"m{k}") for k, (a, b) in enumerate(_functions(hashes))))


def members(signed: DataFrame, bands: tuple[tuple[int, ...], ...] = BANDS) -> DataFrame:
    """(key, lid, n) of the buckets that hold two or more lines, n of them. One shuffle by key."""
    keys = F.array(*(F.xxhash64(F.lit(i), *(F.col(f"m{j}") for j in band)) for i, band in enumerate(bands)))
    each = signed.select("lid", F.explode(keys).alias("key"))
    return each.select("key", "lid", F.count("*").over(Window.partitionBy("key")).alias("n")).where("n > 1")


def _sketched(whole: DataFrame, shingle: int) -> DataFrame:
    """lid, n (shingles, repeats included), set (bits set), b0..: a bit for each value of the upper
    bits of the hashes of a line's shingles."""
    above = 65 - WORDS.bit_length()
    with unchecked(whole.sparkSession):
        each = _hashed(whole.select("lid", "u", (_last(shingle) + 1).alias("n")).repartition("lid"), shingle, IN_BITS)
        word = [F.shiftrightunsigned(f"h{i}", above).cast("int").alias(f"w{i}") for i in range(IN_BITS)]
        bit = [F.expr(f"shiftleft(1L, int(shiftrightunsigned(h{i}, {above - 6}) & 63))").alias(f"t{i}") for i in range(IN_BITS)]
        of = lambda k: _tree([F.when(F.col(f"w{i}") == k, F.col(f"t{i}")).otherwise(F.lit(0).cast("long")) for i in range(IN_BITS)], Column.bitwiseOR)
        rows = each.select("lid", "n", *word, *bit).groupBy("lid", "n").agg(*(F.bit_or(of(k)).alias(f"b{k}") for k in range(WORDS)))
        bits = _tree([F.bit_count(f"b{k}") for k in range(WORDS)], Column.__add__).cast("long")
        # a generated row keeps the optimizer from putting the sum in place of its name
        return rows.select("lid", "n", F.explode(F.array(F.struct(bits.alias("set"), *(f"b{k}" for k in range(WORDS))))).alias("k")).select("lid", "n", "k.*")


def _tree(terms: list[Column], both: Callable[[Column, Column], Column]) -> Column:
    while len(terms) > 1:  # a flat tree
        terms = [both(x, y) for x, y in zip(terms[::2], terms[1::2], strict=True)]
    return terms[0]


def _possible(similarity: float) -> Column:
    """Whether lines of n, set and b0.., and of m, set_c and c0.., can be similar. They share at most
    all shingles of the one that has fewer, and have at least as many as bits. Each bit that only
    one has stands for a shingle, at least, that the other lacks: with d such bits they share at most
    (n + m - d) / 2 and have d more, so (n + m) * (1 - similarity) is at least d * (1 + similarity).
    Repeats among n and m only weaken this: it drops no similar pair."""
    differ = _tree([F.bit_count(F.col(f"b{i}").bitwiseXOR(F.col(f"c{i}"))) for i in range(WORDS)], Column.__add__)
    n, m, little = F.col("n"), F.col("m"), 1e-6
    sized = (n + little >= similarity * F.col("set_c")) & (m + little >= similarity * F.col("set"))
    return sized & ((n + m) * (1 - similarity) + little >= differ * (1 + similarity))


def _verified(pairs: DataFrame, whole: DataFrame, sketches: DataFrame | None, shingle: int, similarity: float) -> DataFrame:
    """Of pairs (a, b) those whose shingle sets have at least this Jaccard similarity. whole: lid,
    u (units). Pairs that their sketches, if any, rule out get no sets. The sets are made for each
    pair, as written ones would take eight bytes for each character."""
    near = pairs
    if sketches is not None:
        other = [F.col("lid").alias("b"), F.col("n").alias("m"), F.col("set").alias("set_c"), *(F.col(f"b{i}").alias(f"c{i}") for i in range(WORDS))]
        with unchecked(pairs.sparkSession):
            near = pairs.join(sketches.withColumnRenamed("lid", "a"), "a").join(sketches.select(*other), "b").where(_possible(similarity)).select("a", "b")
    x = near.join(whole.select(F.col("lid").alias("a"), "u"), "a").select("b", "a", "u")
    y = x.withColumnRenamed("u", "ua").join(whole.select(F.col("lid").alias("b"), "u"), "b")
    # the lines of a pair are in one partition, so nothing is shuffled here
    sides = y.select("b", "a", F.explode(F.array(F.struct(F.lit(True).alias("of_a"), F.col("ua").alias("u")), F.struct(F.lit(False).alias("of_a"), "u"))).alias("s")).select("b", "a", "s.of_a", "s.u")
    hashes = F.array(*(f"h{i}" for i in range(IN_SETS)))
    of = lambda c: F.flatten(F.collect_list(F.when(c, hashes)))
    sets = _hashed(sides, shingle, IN_SETS).groupBy("b", "a").agg(of(F.col("of_a")).alias("x"), of(~F.col("of_a")).alias("y"))
    # a generated row keeps the sets from being made once for each use
    counts = F.struct(F.size(F.array_intersect("x", "y")).alias("both"), F.size(F.array_union("x", "y")).alias("any"))
    return sets.select("a", "b", F.explode(F.array(counts)).alias("k")).where(F.col("k.both") >= similarity * F.col("k.any")).select("a", "b")


def _near(left: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """(key, slice, a, b): the pairs of lines of left (key, lid, root) that share a bucket, are of different
    components and that their sketches do not rule out; a pair of several buckets is in that of the
    least key. The sketches go to the buckets and the bound is part of the join, so a pair that is
    ruled out is never a row. A large bucket is dealt out in slices of its lines b, and its lines a
    go to each: where Spark splits a large bucket by itself, its tasks grow with the square of it."""
    slices = left.groupBy("key").agg(F.expr(f"(count(*) + {SLICE - 1}) div {SLICE}").alias("slices"))
    lines = left.join(slices, "key").groupBy("lid", "root").agg(F.collect_list(F.struct("key", "slices")).alias("held")).join(sketches, "lid")
    rows = lines.select(F.explode("held").alias("of"), F.col("held.key").alias("keys"), "*").select("of.*", "keys", *lines.drop("held").columns)
    x = rows.withColumnsRenamed({"lid": "a", "root": "ra", "keys": "ka"}).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).drop("slices")
    y = rows.select("key", F.expr("pmod(lid, slices)").alias("slice"), F.col("lid").alias("b"), F.col("root").alias("rb"), F.col("keys").alias("kb"), F.col("n").alias("m"), F.col("set").alias("set_c"), *(F.col(f"b{i}").alias(f"c{i}") for i in range(WORDS)))
    once = F.array_min(F.array_intersect("ka", "kb")) == F.col("key")
    with unchecked(left.sparkSession):
        return _met(x, y).where(F.expr("a < b and ra != rb") & _possible(similarity) & once).select("key", "slice", "a", "b")


def _met(x: DataFrame, y: DataFrame) -> DataFrame:
    """x and y joined by slice of a bucket. Both are dealt out here, so Spark splits no slice again."""
    by = ["key", "slice"]
    return x.repartition(*by).join(y.repartition(*by), by)


def _linked(near: DataFrame, whole: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Of near (key, slice, a, b) the pairs (a, b) whose shingle sets have at least this Jaccard similarity.
    The set of a line is made once and goes to each of the slices of its buckets once, not to each of its pairs."""
    ids = near.select(F.col("a").alias("lid")).unionByName(near.select(F.col("b").alias("lid"))).distinct()
    hashes = F.array(*(f"h{i}" for i in range(IN_SETS)))
    sets = _hashed(whole.join(ids, "lid", "left_semi"), shingle, IN_SETS).groupBy("lid").agg(F.array_distinct(F.flatten(F.collect_list(hashes))).alias("s"))
    sets = table(sets, "sets")
    x = near.groupBy("key", "slice", F.col("a").alias("lid")).agg(F.collect_list("b").alias("others")).join(sets, "lid").select("key", "slice", F.col("lid").alias("a"), "others", F.col("s").alias("x"))
    y = near.select("key", "slice", F.col("b").alias("lid")).distinct().join(sets, "lid").select("key", "slice", F.col("lid").alias("b"), F.col("s").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    alike = both >= similarity * (F.size("x") + F.size("y") - both)
    found = table(_met(x, y).where(F.array_contains("others", F.col("b")) & alike).select("a", "b"), "edges")
    remove(near.sparkSession, sets)
    return found


def _labels(edges: DataFrame, steps: int = 3) -> DataFrame:
    """(lid, now): the least line within `steps` edges. Lines of one label are connected, which is
    all that a round of leaders needs; components() is left for the end."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    now = both.groupBy(F.col("a").alias("lid")).agg(F.least(F.min("b"), F.col("a")).alias("now"))
    for _ in range(steps - 1):
        now = both.join(now.withColumnRenamed("lid", "b"), "b").groupBy(F.col("a").alias("lid")).agg(F.least(F.min("now"), F.col("a")).alias("now"))
    return now


def similar_lines(docs: DataFrame, shingle: int = SHINGLE, hashes: int = HASHES, bands: tuple[tuple[int, ...], ...] = BANDS, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root): lines, by their hash, that are linked to others over pairs of at least this
    similarity; root is the least hash of the component.

    Each round verifies the lines of a bucket against some of them, its leaders, and joins those
    that are similar. Leaders are taken in order of how many others share a bucket with them, so the
    middle of a group of near copies comes first, and the group is joined without pairing it. A
    leader has then been compared with all of its bucket, and leaves it: a bucket is done when the
    lines left are of one component, which holds for most after the first round. After the rounds
    of leaders all pairs left of different components are compared. So every pair that shares a
    band is either verified or already joined, but for those that, by the numbers and the bits of
    their shingles, cannot be similar; only lines left after the first round get bits.
    """
    spark = docs.sparkSession
    found = table(members(signatures(docs, shingle, hashes), bands), "members")
    text = occurrences(docs).select(_line_id(F.col("line")).alias("lid"), "line")
    text = text.join(found.select("lid").distinct(), "lid", "left_semi").groupBy("lid").agg(F.first("line").alias("line"))
    whole = table(text.select("lid", _units(F.col("line")).alias("u")), "lines")
    # the lines that are left in each bucket
    state = found.select("key", "lid", F.sum("n").over(Window.partitionBy("lid")).alias("degree"), F.col("lid").alias("root"))
    edges = table(spark.createDataFrame([], "a long, b long"), "edges")
    by, done, sketches = Window.partitionBy("key"), [found], None
    for turn, count in enumerate((*LEADERS, 0)):
        one = [F.min("root").over(by).alias("least"), F.max("root").over(by).alias("most")]
        nth = F.row_number().over(by.orderBy(F.desc("degree"), "lid")).alias("nth")
        left = table(state.select("*", *one).where("least < most").select("key", "lid", "degree", "root", nth), "open")
        for old in done:
            remove(spark, old)
        settle(spark)
        done = [left]
        if sketches is None and (turn or not count):
            sketches = table(_sketched(whole.join(left.select("lid").distinct(), "lid", "left_semi"), shingle), "sketches")
        if count:
            leaders = left.where(F.col("nth") <= count).select("key", F.col("lid").alias("leader"), F.col("root").alias("of"))
            # lines of one component with a leader have been compared with it or are joined to it
            pairs = left.join(leaders, "key").where("root != of").select(F.least("leader", "lid").alias("a"), F.greatest("leader", "lid").alias("b")).distinct()
            edges = edges.unionByName(table(_verified(pairs, whole, sketches, shingle, similarity), "edges"))
            settle(spark)
            rest = left.where(F.col("nth") > count).select("key", "lid", "degree")
            state = rest.join(_labels(edges), "lid", "left").select("key", "lid", "degree", F.coalesce("now", "lid").alias("root"))
    near = table(_near(left.select("key", "lid", "root"), sketches, similarity), "near")
    edges = edges.unionByName(_linked(near, whole, shingle, similarity))
    for old in (left, near, whole, sketches):
        remove(spark, old)
    settle(spark)
    found = components(edges)
    settle(spark)
    return found


def dedup(docs: DataFrame, **how) -> DataFrame:
    """doc_id, th and removed (line numbers from 0, ascending) for each text that loses lines.

    Of the lines of a component, and of equal lines, the first stays: that of the smallest
    (doc_id, hash of the text, line number). Lines without a word are neither compared nor
    removed. Rows that repeat doc_id and text are one document. A null doc_id sorts before all
    others. A null text has no lines.
    """
    roots = similar_lines(docs, **how)
    places = occurrences(docs).select(_line_id(F.col("line")).alias("lid"), "doc_id", "th", "line_no")
    named = table(places.join(roots.withColumnRenamed("node", "lid"), "lid", "left").select(F.coalesce("root", "lid").alias("root"), "doc_id", "th", "line_no"), "places")
    # the first document by plain numbers, which combine before the shuffle; then, of the lines
    # that occur more than once, the first place in it
    known = F.coalesce("doc_id", F.lit(-(1 << 63)))
    least = named.groupBy("root").agg(F.count("*").alias("n"), F.min(known).alias("d")).where("n > 1").drop("n")
    many = table(named.join(least, "root"), "repeated")
    place = F.struct("th", "line_no")
    first = many.where(known == F.col("d")).groupBy("root").agg(F.min(place).alias("first"))
    gone = many.join(first, "root").where((known != F.col("d")) | (F.col("first") != place))
    return table(gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("line_no")).alias("removed")), "removed")


def deduped(docs: DataFrame, **how) -> DataFrame:
    """docs with the removed lines taken out of text; all rows and columns stay, of any name, also
    rows with null doc_id or text, and repeated ones."""
    d, t, gone = fresh(docs, 3)
    found = dedup(docs, **how).select(F.col("doc_id").alias(d), F.col("th").alias(t), F.col("removed").alias(gone))
    rows = docs.join(found, F.col(d).eqNullSafe(F.col("doc_id")) & (F.col(t) == F.xxhash64("text")), "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")
    return rows.withColumn("text", F.when(F.col(gone).isNotNull(), left).otherwise(F.col("text"))).select(*quoted(docs))


def line_dedup(docs: DataFrame, **how) -> DataFrame:
    """One row per row of docs: doc_id, n_lines (with a word), n_removed, removed (their numbers).
    Empty tables give empty results; extra columns are not read."""
    lines = F.size(F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1), _has_word)).cast("long")
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), lines.alias("n_lines"))
    gone = dedup(docs, **how).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "removed")
    out = rows.join(gone, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_t") == F.col("th")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of similar lines one stays; all documents stay, with the text left. Null ids
    and texts, repeated rows, empty tables and other columns: as in deduped() and dedup()."""
    return deduped(docs)
