import random
import re

from quillspark.llm.url_filter import filter_urls, read_vocabulary


def verdicts(spark, urls, **more):
    rows = [(i, u, "h", 1) for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    return [tuple(r) for r in filter_urls(df, **more).orderBy("page_id").select("host", "path", "rule", "verdict").collect()]


def test_parts_and_rules(spark):
    got = verdicts(spark, [
        "https://WWW.Example.COM/en/1?x=/y", "http://a.example.com/en/70#t", "http://example.com/en/7", "https://b.example.net/de/8", "https://b.example.net/de/9",
        "http://q.org/es/", "http://q.org", "http://q.org?x", "nothing", None, "", "notexample.com://com/en/", "http://xcom/en/", "a://b://c/d",
    ])
    assert got == [
        ("www.example.com", "/en/1", "com/en/", "block"), ("a.example.com", "/en/70", "example.com/en/7", "allow"), ("example.com", "/en/7", "example.com/en/7", "allow"),
        ("b.example.net", "/de/8", "example.net/de/8", "block"), ("b.example.net", "/de/9", "net/de/", "allow"), ("q.org", "/es/", "org/es/", "block"),
        ("q.org", "", None, "allow"), ("q.org", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("com", "/en/", "com/en/", "block"), ("xcom", "/en/", None, "allow"), ("b:", "//c/d", None, "allow"),
    ]


def test_terms(spark):
    urls = ["http://x.io/porn", "http://x.io/pornish", "http://x.io/CASINO-1", "http://x.io/cheap", "http://x.io/cheap/cheap", "http://x.io/cheap.pills", "http://x.io/cheapspills", "http://spam-farm.x.io/", "é://x.io/éporné"]
    assert [v[3] for v in verdicts(spark, urls)] == ["block", "allow", "block", "allow", "allow", "block", "allow", "block", "block"]


def test_no_rules_no_terms_no_rows(spark):
    assert verdicts(spark, ["http://a.com/en/porn"], rules=(), vocabulary={}) == [("a.com", "/en/porn", None, "allow")]
    assert filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_clashing_columns(spark):
    """Columns that are named like results are replaced; all others stay."""
    df = spark.createDataFrame([(1, "http://x.io/porn", "old", 5, 6)], "page_id long, url string, host string, _hits int, _own0 int")
    r = filter_urls(df).first()
    assert (r.host, r._hits, r._own0, r.verdict) == ("x.io", 5, 6, "block")


def test_a_vocabulary_of_thousands_from_a_table(spark):
    """Against a search for each term by itself."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdef-9") for _ in range(rng.randrange(3, 7)))
    weights = {}
    for _ in range(3000):
        weights.setdefault(word(), rng.choice([0.2, 0.5, 1.0, 2.0]) if rng.random() < 0.01 else 0.4)
    rows = [(t.upper() if i % 3 else t, w) for i, (t, w) in enumerate(weights.items())] + [("abc", None), ("", 1.0), (None, 1.0), ("zero", 0.0)]
    vocabulary = read_vocabulary(spark.createDataFrame(rows + rows[:50], "term string, weight double").repartition(5))
    assert vocabulary == weights
    urls = ["http://h.x/" + rng.choice("/.?_").join(rng.choice([word(), rng.choice(list(weights)), "zz" + word() + "zz"]) for _ in range(rng.randrange(1, 5))) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").repartition(3)
    got = {r.page_id: (r.strict, r.soft, round(r.weight, 9), r.verdict) for r in filter_urls(df, rules=(), vocabulary=vocabulary).collect()}
    for i, u in enumerate(urls):
        found = [t for t in weights if t in (u or "") and re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", u)]
        strict = sum(weights[t] >= 1 for t in found)
        soft = len(found) - strict
        assert got[i] == (strict, soft, round(sum(weights[t] for t in found), 9), "block" if strict or soft >= 2 else "allow")
    assert len({v[3] for v in got.values()}) == 2
