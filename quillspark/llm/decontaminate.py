"""Operator 7, benchmark decontamination: a positional inverted index, in DataFrame functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, fresh, quoted, table

WINDOW = 10
#: Lists that are intersected for each window, from its rarest term on.
LISTS = 3
#: Terms that are looked up at a time. A block of so many is what gets broadcast, whatever the
#: number of test items; more terms are more blocks.
BLOCK_TERMS = 100_000
#: Places of a word that stand together. A word's list is dealt out in slices of about so many, and
#: what is looked up in it goes to each of them.
SLICE = 50_000
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of the text with A-Z lower-cased: runs of characters that are neither ASCII
    punctuation nor white space nor control characters. A null text has none."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(ascii_lower(t))
    return F.array_remove(F.split(low, _GAPS, -1), "")


def _looked_up(tokens: DataFrame, keys: DataFrame, block_terms: int) -> DataFrame:
    """tokens joined with keys (each word once), in blocks of keys of bounded size."""
    n = max(1, -(-keys.count() // block_terms))
    part = lambda i: keys.where(F.pmod(F.xxhash64("word"), F.lit(n)) == i) if n > 1 else keys
    return reduce(DataFrame.unionByName, (tokens.join(F.broadcast(part(i)), "word") for i in range(n)))


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Written table (phrase, item_id), each once: runs of `size` words of an item, or all words
    of a shorter one, joined by a space (no word holds one)."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    w = w.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))).alias("i"))
    return table(w.select("item_id", F.array_join(F.slice("w", F.col("i") + 1, size), " ").alias("phrase")).distinct(), "windows")


def _slices(count: Column) -> Column:
    """Slices of the list of a word that occurs so often."""
    return F.greatest(F.ceil(count / F.lit(SLICE)), F.lit(1)).cast("int")


def _rows(docs: DataFrame) -> DataFrame:
    """A row is known by its doc_id and the hash of its text."""
    return docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("w"))


def index(docs: DataFrame, phrases: DataFrame, size: int = WINDOW, lists: int = LISTS, block_terms: int = BLOCK_TERMS, *, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """The inverted index of docs for phrases, and what to look up in it, as written tables.

    postings: word, slice, doc_id, th, pos, and, for words that are the rarest of some phrase, the
    words around (context, from place base on), as far as a phrase can reach, and slop words more. chosen: phrase, n (its words), terms: its `lists`
    rarest words as (count, offset, word), rarest first, by how often they occur in all of docs;
    phrases with a word that docs lack are left out."""
    terms = table(phrases.select("phrase").distinct().select("phrase", F.posexplode(F.split("phrase", " ")).alias("offset", "word")), "terms")
    tokens = docs.select(F.explode(words(F.col("text"))).alias("word"))
    counts = _looked_up(tokens, terms.select("word").distinct(), block_terms).groupBy("word").agg(F.count("*").alias("count"))
    each = terms.join(table(counts, "counts"), "word", "left").groupBy("phrase").agg(F.count("*").alias("n"), F.count("count").alias("found"), F.array_sort(F.collect_list(F.struct("count", "offset", "word"))).alias("terms"))
    chosen = table(each.where("n = found").select("phrase", "n", F.slice("terms", 1, lists).alias("terms")), "chosen")
    keys = chosen.select(F.posexplode("terms").alias("rank", "t")).groupBy(F.col("t.word").alias("word")).agg((F.min("rank") == 0).alias("first"), _slices(F.max("t.count")).alias("slices"))
    each = _rows(docs).select("doc_id", "th", "w", F.posexplode("w").alias("pos", "word"))
    reach = size - 1 + slop
    base = F.greatest(F.col("pos") - reach, F.lit(0))
    found = _looked_up(each, table(keys, "keys"), block_terms)
    part = F.pmod(F.xxhash64("doc_id", "th", "pos"), F.col("slices")).cast("int")
    postings = found.select("word", part.alias("slice"), "doc_id", "th", "pos", base.alias("base"), F.when(F.col("first"), F.slice("w", base + 1, 2 * reach + 1)).alias("context"))
    return table(postings, "postings"), chosen


def matches(docs: DataFrame, items: DataFrame, size: int = WINDOW, slop: int = 0, lists: int = LISTS, block_terms: int = BLOCK_TERMS) -> tuple[DataFrame, DataFrame]:
    """(hits, phrases). hits: doc_id, th, start, n, phrase, exact, for every place where a phrase
    of an item occurs in a row of docs (each once); phrases: phrase, item_id.

    The postings of a phrase's rarest term, moved back by its offset, are intersected with those
    of the next rarest; what is left is compared with the words around the posting. With slop
    above 0 there are also rows with exact false: places, counted from an occurrence of the rarest
    term (by how often it occurs, then by its place in the phrase), where every term of the phrase
    stands within slop words of where the phrase would have it. start may be up to slop below 0."""
    phrases = windows(items, size)
    postings, chosen = index(docs, phrases, size, lists, block_terms, slop=slop)
    term = lambda i: F.get(F.col("terms"), F.lit(i))
    first = chosen.select("phrase", "n", "terms", term(0)["word"].alias("word"), term(0)["offset"].alias("offset"))
    first = first.withColumn("slice", F.explode(F.sequence(F.lit(0), _slices(term(0)["count"]) - 1)))
    begun = postings.where("context is not null").join(first, ["word", "slice"]).withColumn("start", F.col("pos") - F.col("offset")).drop("word", "slice")
    places = postings.select(F.col("word").alias("_w"), F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.col("pos").alias("_p"))
    here = begun.where("start >= 0")
    for i in range(1, lists):
        also = (F.col("_d").eqNullSafe(F.col("doc_id"))) & (F.col("_t") == F.col("th")) & (F.col("_w") == F.coalesce(term(i)["word"], term(0)["word"])) & (F.col("_p") == F.col("start") + F.coalesce(term(i)["offset"], term(0)["offset"]))
        here = here.join(places, also, "left_semi")
    same = F.array_join(F.slice("context", F.col("start") - F.col("base") + 1, F.col("n").cast("int")), " ") == F.col("phrase")
    hits = here.where(same).select("doc_id", "th", "start", "n", "phrase").distinct().withColumn("exact", F.lit(True))
    if slop > 0:
        cell = lambda p: F.floor(p / (2 * slop + 1))
        near = begun.where(F.col("start") >= -slop)
        for i in range(1, lists):
            want = F.col("start") + F.coalesce(term(i)["offset"], term(0)["offset"])
            spread = near.withColumns({"_want": want, "_cell": F.explode(F.array_distinct(F.array(cell(want - slop), cell(want + slop))))})
            also = (F.col("_d").eqNullSafe(F.col("doc_id"))) & (F.col("_t") == F.col("th")) & (F.col("_w") == F.coalesce(term(i)["word"], term(0)["word"])) & (F.col("_c") == F.col("_cell")) & (F.abs(F.col("_p") - F.col("_want")) <= slop)
            near = spread.join(places.withColumn("_c", cell(F.col("_p"))), also, "left_semi").drop("_want", "_cell").distinct()
        # of the words around, those within slop of each term's place
        around = lambda i: F.slice("context", F.greatest(F.col("start") + i - slop - F.col("base") + 1, F.lit(1)), F.greatest(F.col("start") + i + slop - F.col("base") + 1 - F.greatest(F.col("start") + i - slop - F.col("base"), F.lit(0)), F.lit(0)))
        near = near.where(F.forall(F.transform(F.split("phrase", " "), lambda t, i: F.array_contains(around(i), t)), lambda x: x))
        near = near.select("doc_id", "th", "start", "n", "phrase").distinct()
        keys = ["th", "start", "phrase"]
        taken = hits.select(F.col("doc_id").alias("_d"), *(F.col(k).alias(f"_{k}") for k in keys))
        both = F.col("_d").eqNullSafe(F.col("doc_id"))
        for k in keys:
            both = both & (F.col(f"_{k}") == F.col(k))
        hits = hits.unionByName(near.join(taken, both, "left_anti").withColumn("exact", F.lit(False)))
    return hits, phrases


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per row of docs: doc_id, th, n_words, n_hit (words inside an occurrence of a window of an
    item), n_items, item_ids (sorted as strings), contaminated.

    Null and empty texts, of documents or items, have no words; such items match nothing. Items
    and documents may repeat; equal rows get equal results, and rows of one doc_id with different
    texts are judged apart. Null doc_ids and item_ids are values like others (a null item counts
    in no list). Empty tables give no rows, or rows without hits. Other columns are not read.
    """
    hits, phrases = matches(docs, items, size)
    hits = table(hits.where("exact"), "hits")
    by = Window.partitionBy("doc_id", "th").orderBy("start")
    end = F.col("start") + F.col("n")
    ends = hits.groupBy("doc_id", "th", "start").agg(F.max("n").alias("n"))
    until = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(end - F.greatest(F.col("start"), F.coalesce(until, F.lit(0))), F.lit(0))
    covered = ends.select("doc_id", "th", new.alias("new")).groupBy("doc_id", "th").agg(F.sum("new").alias("n_hit"))
    named = hits.join(phrases, "phrase").select("doc_id", "th", F.col("item_id").cast("string").alias("item")).distinct()
    named = named.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    found = covered.join(named, covered["doc_id"].eqNullSafe(named["doc_id"]) & (covered["th"] == named["th"])).select(covered["doc_id"].alias("_d"), covered["th"].alias("_t"), "n_hit", "item_ids")
    every = _rows(docs).select("doc_id", "th", F.size("w").cast("long").alias("n_words"))
    out = every.join(found, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_t") == F.col("th")), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "th", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a window of a benchmark item go. Rows are judged one by
    one, also those with null or repeated doc_id; null and empty texts stay, as do all rows where
    there is no benchmark item; all columns stay, of any name."""
    d, t = fresh(docs, 2)
    hits, _ = matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = table(hits.where("exact").select(F.col("doc_id").alias(d), F.col("th").alias(t)).distinct(), "hits")
    return docs.join(bad, F.col(d).eqNullSafe(F.col("doc_id")) & (F.col(t) == F.xxhash64("text")), "left_anti").select(*quoted(docs))


SQL = """
with d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from benchmark),
bi as (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0),
p as (select distinct item_id, array_to_string(w[i:i+9], ' ') as phrase, len(w[i:i+9]) as n from bi),
dn as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from p) where len(w) >= n),
h as (select doc_id, i, p.n, item_id from dn join p on p.n = dn.n and p.phrase = array_to_string(w[i:i+dn.n-1], ' ')),
c as (select doc_id, count(distinct pos)::bigint as n_hit from (select doc_id, unnest(range(i, i + n)) as pos from h) group by doc_id),
g as (select doc_id, count(*)::bigint as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from h) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join g using (doc_id)"""
