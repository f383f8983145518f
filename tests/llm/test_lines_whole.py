import random

import pytest

from quillspark.llm import lines

ADDRESS = "https://example.com/"
APART = [
    (ADDRESS + "a", ADDRESS + "b"),
    ("International", "Internationalization"),
    ("MIIEpAIBAAKCAQEA" + "abcdefgh" * 6, "MIIEpAIBAAKCAQEA" + "stuvwxyz" * 6),
    ("See https://example.com/x/1", "See https://example.com/y/2"),
    ("".join(chr(0x1780 + i % 30) for i in range(80)), "".join(chr(0x1780 + (i if i < 12 else 7 * i) % 30) for i in range(80))),
]
LONG = "".join(chr(0x1780 + i * i % 97 % 50) for i in range(400))


@pytest.mark.parametrize("pair", APART)
def test_runs_without_spaces_are_compared_whole(spark, pair):
    """As their full shingles say: only of the addresses nine of eleven are shared."""
    docs = spark.createDataFrame(list(enumerate(pair)), "doc_id long, text string")
    a, b = ({x[i : i + 12] for i in range(len(x) - 11)} or {x} for x in pair)
    alike = len(a & b) >= 0.8 * len(a | b)
    assert alike == (pair == APART[0])
    assert [r.n_removed for r in lines.line_dedup(docs).orderBy("doc_id").collect()] == [0, int(alike)]


def test_long_runs_that_differ_at_their_heads_are_linked(spark):
    docs = spark.createDataFrame([(1, LONG), (2, "x" + LONG[1:])], "doc_id long, text string")
    assert [r.n_removed for r in lines.line_dedup(docs).orderBy("doc_id").collect()] == [0, 1]


def test_recall_at_the_least_similarity(spark):
    """Of pairs at 0.80, about 0.990 share a band (nine independent minima, twelve bands), and each is verified."""
    rng, n = random.Random(11), 600
    rows = []
    for d in range(n):
        line = "".join(rng.choice("abcdefghij") for _ in range(121))
        rows += [(2 * d, line), (2 * d + 1, line[:50] + "X" + line[51:])]
        a, b = ({x[i : i + 12] for i in range(len(x) - 11)} for _, x in rows[-2:])
        assert 0.8 <= len(a & b) / len(a | b) < 0.81
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    removed = {r.doc_id for r in lines.line_dedup(docs).collect() if r.n_removed}
    assert all(d % 2 for d in removed) and len(removed) >= 0.97 * n, len(removed) / n


SHORT = [("12 apples", "2 apples"), ("21000 words", "1000 words"), ("-5 degrees", "5 degrees"), ("not possible", "ot possible"), ("a", "A"), ("twelve chars", "twelve chars.")]


def test_short_lines_are_one_shingle(spark):
    """Each pair stays, and only the copy of its second line goes."""
    rows = [(3 * i + k, x) for i, pair in enumerate(SHORT) for k, x in enumerate([*pair, pair[1]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_removed for r in lines.line_dedup(docs).orderBy("doc_id").collect()] == [0, 0, 1] * len(SHORT)


def test_recall_on_the_test_tables(spark):
    """All pairs of different lines of sf0.001 by full shingles: none below 0.8 is joined on its own,
    and those that reach it are."""
    import re

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = sorted({x for r in docs.collect() for x in (r.text or "").split("\n") if re.search(r"[^ \t\n\x0b\x0c\r]", x)})
    shingles = [{x[i : i + 12] for i in range(max(1, len(x) - 11))} for x in texts]
    pairs = set()
    for i, a in enumerate(shingles):
        for j in range(i):
            b = shingles[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                pairs.add((j, i))
    from pyspark.sql import functions as F

    roots = {r.node: r.root for r in lines.similar_lines(docs).collect()}
    ids = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").orderBy("i").select(F.xxhash64("x")).collect()]
    joined = [p for p in pairs if roots.get(ids[p[0]], ids[p[0]]) == roots.get(ids[p[1]], ids[p[1]])]
    assert len(pairs) > 5 and len(joined) >= 0.95 * len(pairs)
    linked = {ids[k] for p in pairs for k in p}
    assert set(roots) <= linked, "no line without a similar one is in a component"
