"""Operator 6, URL filters: a weighted vocabulary of URL terms, and host/path rules above it."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, fresh, ship

#: Weights of URL terms. A term of weight STRICT or more rejects alone; lighter ones reject when
#: at least `min_soft` different ones of them occur.
STRICT = 1.0
VOCABULARY = {
    "porn": 1.0, "xxx": 1.0, "casino": 1.0, "viagra": 1.0, "malware": 1.0, "phishing": 1.0, "warez": 1.0, "spam-farm": 1.0, "cheap-pills": 1.0,
    "adult": 0.5, "bet": 0.5, "cheap": 0.5, "crack": 0.5, "escort": 0.5, "farm": 0.4, "free": 0.3, "loan": 0.5, "pills": 0.5, "poker": 0.5, "sex": 0.5, "spam": 0.5, "torrent": 0.5, "win": 0.3,
}
MIN_SOFT = 2

#: (host, path, verdict). A rule fits its host and all subdomains where the path begins with its own.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    return F.when(F.contains(url, F.lit("://")), ascii_lower(F.regexp_extract(after, "^[^/?#]*", 0))).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], what: str) -> Column:
    """The text ("rule") or verdict ("verdict") of the longest rule that fits, else null."""
    out = F
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), r[0], r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = out.when(fits, F.lit(h + p if what == "rule" else verdict))
    return out if rules else F.lit(None).cast("string")


def read_vocabulary(terms: DataFrame) -> dict[str, float]:
    """The vocabulary of a table (term, weight), for filter_urls(). Terms are lower-cased (A-Z); of
    equal ones the greatest weight counts; null, empty and weightless rows are left out. The
    vocabulary is a parameter: it reaches the driver and every worker as a whole, so it should have
    thousands of terms, not as many as the corpus."""
    rows = terms.select(ascii_lower(F.col("term")).alias("term"), F.col("weight").cast("double").alias("weight")).where("length(term) > 0 and weight > 0")
    return {r.term: r.weight for r in rows.groupBy("term").agg(F.max("weight").alias("weight")).orderBy("term").collect()}


def vocabulary_hits(vocabulary: Mapping[str, float]):
    """Arrow function url -> (strict, soft, weight): how many different terms of either kind stand in
    the lower-cased url with neither a letter nor a digit (ASCII) directly before or after them,
    and the sum of their weights. The automaton is built once for a task."""
    terms = dict(vocabulary)

    @F.pandas_udf("strict int, soft int, weight double")
    def hits(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for t in terms:
            automaton.add_word(t, t)
        if terms:
            automaton.make_automaton()
        lower, word = str.maketrans(UPPER, LOWER), set(LOWER + "0123456789")
        for urls in parts:
            out = []
            for url in urls:
                found = set()
                if url and terms:
                    u = url.translate(lower)
                    for end, t in automaton.iter(u):
                        start = end - len(t) + 1
                        if (start == 0 or u[start - 1] not in word) and (end + 1 == len(u) or u[end + 1] not in word):
                            found.add(t)
                strict = sum(terms[t] >= STRICT for t in found)
                out.append((strict, len(found) - strict, float(sum(terms[t] for t in sorted(found)))))
            yield pd.DataFrame(out, columns=["strict", "soft", "weight"])

    return hits


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, vocabulary: Mapping[str, float] = VOCABULARY, min_soft: int = MIN_SOFT, url: str = "url") -> DataFrame:
    """All columns of pages, and host, path, rule, strict, soft, weight, verdict.

    verdict: that of the longest rule that fits; else block if one strict term or at least
    min_soft different soft terms occur; else allow. A null or empty url has an empty host and
    path, no hits, and is allowed. Rows are judged one by one: repeated rows get equal results,
    an empty table an empty result. Columns of pages whose names clash with the new ones are
    replaced. A map over rows: no shuffle, nothing is broadcast but the vocabulary (a parameter).
    """
    ship(pages.sparkSession)
    u = F.coalesce(F.col(url), F.lit(""))
    hits = next(iter(fresh(pages, 1)))
    out = pages.withColumns({"host": url_host(u), "path": url_path(u), hits: vocabulary_hits(vocabulary)(u)})
    out = out.withColumns({"rule": rule_column(F.col("host"), F.col("path"), rules, "rule")} | {k: F.col(f"{hits}.{k}") for k in ("strict", "soft", "weight")}).drop(hits)
    by_terms = F.when((F.col("strict") >= 1) | (F.col("soft") >= min_soft), "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce(rule_column(F.col("host"), F.col("path"), rules, "verdict"), by_terms))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    low = f"translate(url, '{UPPER}', '{LOWER}')"
    has = lambda t: f"regexp_matches({low}, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::int"
    strict = " + ".join(has(t) for t, w in VOCABULARY.items() if w >= STRICT)
    soft = " + ".join(has(t) for t, w in VOCABULARY.items() if w < STRICT)
    ordered = sorted(RULES, key=lambda r: (-len(r[0]) - len(r[1]), r[0], r[1]))
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    rule = " ".join(f"when {fits(h, p)} then '{h}{p}'" for h, p, _ in ordered)
    verdict = " ".join(f"when {fits(h, p)} then '{v}'" for h, p, v in ordered)
    return f"""
with u as (select page_id, coalesce(url, '') as url from pages),
r as (select page_id, url, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from u),
h as (select page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r)
select page_id, host, path, case {rule} end as rule,
  case {verdict} when {strict} >= 1 or {soft} >= {MIN_SOFT} then 'block' else 'allow' end as verdict
from h"""


SQL = _sql()
