"""Operator 8, quality rules: adaptive thresholds from mergeable quantile sketches."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, quoted, table

#: Relative error of the quantile sketch: values in ((1+e)/(1-e))**(i-1 .. i) share bucket i.
ERROR = 0.02
#: A threshold is q75 * (q75 / q25) ** SPREAD of its group, so the fence stands where the group's own
#: spread puts it. Into the group's sketch goes that of its language, weighing PRIOR documents, and
#: into this that of all documents, likewise; so small groups follow the larger ones, by degrees.
SPREAD = 3
PRIOR = 30
#: The sketches are of shares with this much added above and below, as if each text had so much more,
#: so that none is 0 and a group's fence never is.
FEATURES = {
    "symbols_per_word": ("n_symbols", 1, "n_words", 10),
    "upper_share": ("n_upper", 5, "n_letters", 50),
    "repeat_share": ("n_repeat_words", 5, "n_words", 200),
    "dup_line_share": ("n_dup_lines", 1, "n_lines", 10),
    "chars_per_word": ("word_chars", 1, "n_words", 1),
}
#: A text whose share is beyond the fence fails only if its count alone makes sure that it has more
#: than three quarters of its group: a count of a has an error of about sqrt(a), so it counts as
#: (sqrt(a) - SURE)**2, with nothing added, and that share must be above q75. A count of 0 or 1
#: never fails, however short the text.
SURE = 1
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")
WINDOW = 5

_SPACE = b" \t\n\r\x0b\x0c"
_NOT_CHARS = _SPACE + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))
_LETTERS = _CAPITALS + bytes(range(97, 123))


def repeated_words(hashes: list[np.ndarray], size: int = WINDOW) -> list[int]:
    """For each text, given the 64-bit hashes of its words: how many words lie in windows of
    `size` words that occur at least twice in that text."""
    out = [0] * len(hashes)
    if not hashes:
        return out
    lengths = np.array([len(h) for h in hashes])
    words, doc = np.concatenate(hashes), np.repeat(np.arange(len(hashes)), lengths)
    if len(words) < size:
        return out
    n = len(words) - size + 1
    x = np.zeros(n, np.uint64)
    for j in range(size):
        x = x * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])  # windows within one text
    x = x[at] * np.uint64(0xD1B54A32D192ED03) + doc[at].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    order = np.argsort(x)
    same = x[order][1:] == x[order][:-1]
    twice = np.zeros(len(x), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + size, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=len(hashes)).tolist()


def measure(texts: list[bytes]) -> list[list[int]]:
    """COUNTS of each UTF-8 text."""
    out, hashes = [], []
    for t in texts:
        words = t.split()
        hashes.append(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64))
        lines = [x for x in t.split(b"\n") if x and not x.isspace()]
        n = len(t)
        out.append([len(words), len(t.translate(None, _NOT_CHARS)), n - len(t.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), 0, len(lines), n - len(t.translate(None, _CAPITALS)), n - len(t.translate(None, _LETTERS))])
    for row, k in zip(out, repeated_words(hashes), strict=True):
        row[4] = k
    return out


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """row, a struct of the columns keep of docs, and a column for each of COUNTS; a null text is
    empty. Map only. What docs calls its columns does not matter, as they stay within row."""
    fields = [f for f in docs.schema.fields if f.name in keep or f.name == "text"]
    sent = docs.select(F.struct(*(c for c, f in zip(quoted(docs), docs.schema.fields, strict=True) if f in fields)).alias("row"))
    kept = [i for i, f in enumerate(fields) if f.name in keep]
    at = [f.name for f in fields].index("text")
    schema = T.StructType([T.StructField("row", T.StructType([fields[i] for i in kept])), *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[list[int]] = []
        parts = b.column(0).flatten()
        column, start, size = parts[at], 0, 0
        lengths = [len(x.as_buffer()) if x.is_valid else 0 for x in column]
        for i, k in enumerate(lengths):  # about a MB at a time
            size += k
            if size > 1 << 20 or i + 1 == len(lengths):
                rows += measure([(x or "").encode() for x in column.slice(start, i + 1 - start).to_pylist()])
                start, size = i + 1, 0
        values = np.array(rows, np.int64).reshape(-1, len(COUNTS))
        row = b.column(0) if len(kept) == len(parts) else pa.StructArray.from_arrays([parts[i] for i in kept], fields=[b.schema.field(0).type.field(i) for i in kept])
        return pa.RecordBatch.from_arrays([row, *(pa.array(values[:, i]) for i in range(len(COUNTS)))], names=["row", *COUNTS])

    return map_batches(sent, run, schema)


def _features() -> dict:
    return {k: (F.col(a) + F.lit(x)) / (F.col(b) + F.lit(y)).cast("double") for k, (a, x, b, y) in FEATURES.items()}


def _sure() -> dict:
    root = {k: F.sqrt(F.col(a).cast("double")) - SURE for k, (a, _, _, _) in FEATURES.items()}
    return {k: F.when((root[k] > 0) & (F.col(b) > 0), root[k] * root[k] / F.col(b).cast("double")) for k, (_, _, b, _) in FEATURES.items()}


def _group(c: str):
    return F.coalesce(F.col(f"row.{c}"), F.lit("\0null"))


def _bucket(x: Column, error: float = ERROR) -> Column:
    return F.ceil(F.log(x) / math.log((1 + error) / (1 - error))).cast("int")


def sketch(counted: DataFrame, error: float = ERROR) -> DataFrame:
    """Quantile sketches: rows (lang, source, feature, bucket, n). Two sketches merge by adding
    the n of equal buckets, which is what the aggregation does, before and after its shuffle.
    Buckets of a group: at most some hundreds."""
    each = F.array(*(F.struct(F.lit(k).alias("feature"), v.alias("x")) for k, v in _features().items()))
    rows = counted.select(_group("lang").alias("lang"), _group("source").alias("source"), F.inline(each).alias("feature", "x"))
    return rows.groupBy("lang", "source", "feature", _bucket(F.col("x"), error).alias("bucket")).agg(F.count("*").cast("double").alias("n"))


def _merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "feature", "bucket").agg(F.sum("n").alias("n"))


def _with_prior(own: DataFrame, by: list[str], wide: DataFrame, wide_by: list[str], prior: float) -> DataFrame:
    """The sketches `own`, into each of which that of its wider group is merged, scaled down to
    `prior` documents."""
    total = wide.groupBy(*wide_by, "feature").agg(F.sum("n").alias("total"))
    scaled = wide.join(total, [*wide_by, "feature"]).withColumn("n", F.col("n") * prior / F.col("total")).drop("total")
    added = own.select(*by, "feature").distinct().join(scaled, [*wide_by, "feature"]).select(*own.columns)
    return _merged(own.unionByName(added), by)


def _limits(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, feature, limit, usual): the last bucket within the fence, and that of q75. Of q75 / q25 the sketch tells
    just the buckets, so the spread is the most that these allow."""
    ordered = F.array_sort(F.collect_list(F.struct("bucket", "n")))
    one = sketches.groupBy(*by, "feature").agg(F.sum("n").alias("total"), ordered.alias("b"))

    def quantile(q: float) -> Column:
        reach = lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.coalesce(s["at"], F.when(s["seen"] + x["n"] >= F.col("total") * q - 1e-9, x["bucket"])).alias("at"))
        return F.aggregate("b", F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("int").alias("at")), reach)["at"]

    q25, q75 = quantile(0.25), quantile(0.75)
    return one.select(*by, "feature", (q75 + SPREAD * (q75 - q25 + 1)).alias("limit"), q75.alias("usual"))


def thresholds(sketches: DataFrame, prior: float = PRIOR) -> DataFrame:
    """One row per (lang, source) with columns limit_<feature>, the last bucket of the sketch that is
    kept, and usual_<feature>, the bucket of q75."""
    groups = ["lang", "source"]
    lang = _with_prior(_merged(sketches, ["lang"]), ["lang"], _merged(sketches, []), [], prior)
    limits = _limits(_with_prior(sketches, groups, lang, ["lang"], prior), groups)
    return limits.groupBy(*groups).agg(*(F.max(F.when(F.col("feature") == k, F.col(c))).alias(f"{c}_{k}") for k in FEATURES for c in ("limit", "usual")))


def judged(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """counted with base_failed and kept.

    limits has a row for each language and source. As a written table its size is known, and
    Spark broadcasts it if that is below autoBroadcastJoinThreshold; else it is a shuffled join,
    where AQE splits the partition of a hot source."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = counted.withColumns({"lang": _group("lang"), "source": _group("source")})
    over = F.lit(False)
    sure = _sure()
    for k, v in _features().items():
        over = over | ((_bucket(v) > F.col(f"limit_{k}")) & F.coalesce(_bucket(sure[k]) > F.col(f"usual_{k}"), F.lit(False)))
    return rows.join(limits, ["lang", "source"], "left").withColumns({"base_failed": failed, "kept": ~failed & ~F.coalesce(over, F.lit(False))})


def quality(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept.

    kept is false where base_failed (fewer than 10 words, or over 20 % of the words in repeated
    five-word windows), else false just if a share exceeds the threshold of its language and source,
    and the text's count makes sure that it is above what is usual there. Null language or source: a group of its own. Null, empty and blank texts have no
    words and fail the base rule. Repeated rows are each counted and judged; an empty table gives
    an empty result. Other columns are not read.
    """
    rows = table(with_counts(docs, ["doc_id", "lang", "source"]), "counts")
    limits = table(thresholds(table(sketch(rows), "sketches")), "thresholds")
    return judged(rows, limits).select("row.doc_id", *COUNTS[:5], "base_failed", "kept")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go; the others keep all columns, of any
    name. Nulls, repeated rows and empty tables: as in quality(). The counts are made twice, once
    for the sketches and once beside the text, so that no text is shuffled."""
    limits = table(thresholds(table(sketch(with_counts(docs, ["lang", "source"])), "sketches")), "thresholds")
    return judged(with_counts(docs, docs.columns), limits).where("kept").select("row.*")


def _sql() -> str:
    log = repr(math.log((1 + ERROR) / (1 - ERROR)))
    sure = lambda a, b: f"case when {a} > {SURE * SURE} and {b} > 0 then ceil(ln((sqrt({a}::double) - {SURE}) * (sqrt({a}::double) - {SURE}) / {b}::double) / {log})::int end"
    features = ", ".join(f"{{'feature': '{k}', 'bucket': ceil(ln(({a} + {x}) / ({b} + {y})::double) / {log})::int, 'sure': {sure(a, b)}}}" for k, (a, x, b, y) in FEATURES.items())
    return f"""
with d as (select doc_id, coalesce(lang, chr(1)) as lang, coalesce(source, chr(1)) as source, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from d),
wi as (select doc_id, i, array_to_string(w[i:i+{WINDOW - 1}], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from w)),
rp as (select doc_id, count(distinct i + j)::bigint as n from (select doc_id, i, count(*) over (partition by doc_id, s) as k from wi), (select unnest(range({WINDOW})) as j) where k > 1 group by doc_id),
c as (select doc_id, lang, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
  coalesce(rp.n, 0)::bigint as n_repeat_words, len(ls) as n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_upper, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) as n_letters from w left join rp using (doc_id)),
f as (select doc_id, lang, source, unnest([{features}], recursive := true) from c),
own as (select lang, source, feature, bucket, count(*)::double as n from f group by lang, source, feature, bucket),
la as (select lang, feature, bucket, sum(n) as n from own group by all), ev as (select feature, bucket, sum(n) as n from own group by all),
lm as (select lang, feature, bucket, sum(n) as n from (select * from la union all
  select g.lang, ev.feature, bucket, n * {PRIOR} / sum(n) over (partition by g.lang, ev.feature) from ev join (select distinct lang, feature from la) g using (feature)) group by all),
gm as (select lang, source, feature, bucket, sum(n) as n from (select * from own union all
  select g.lang, g.source, lm.feature, bucket, n * {PRIOR} / sum(n) over (partition by g.lang, g.source, lm.feature) from lm join (select distinct lang, source, feature from own) g using (lang, feature)) group by all),
cu as (select *, sum(n) over (partition by lang, source, feature order by bucket) as seen, sum(n) over (partition by lang, source, feature) as total from gm),
q as (select lang, source, feature, min(bucket) filter (seen >= total * 0.25 - 1e-9) as q25, min(bucket) filter (seen >= total * 0.75 - 1e-9) as q75 from cu group by all),
o as (select doc_id, bool_or(bucket > q75 + {SPREAD} * (q75 - q25 + 1) and coalesce(sure > q75, false)) as over_fence from f join q using (lang, source, feature) group by doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and not over_fence as kept from c join o using (doc_id)"""


SQL = _sql()
