"""Hashes, minima, bits and sets of a pair in DataFrame functions."""

import random
import re

from pyspark.sql import functions as F

from quillspark.llm import lines


def units(x, n=12):
    u = x.encode("utf-16-be")
    return {u[2 * i : 2 * (i + n)] for i in range(max(1, len(u) // 2 - n + 1))}


def made():
    rng = random.Random(5)
    out = []
    for i in range(120):
        x = "".join(rng.choice("abé漢 🎉x") for _ in range(rng.randrange(1, 90)))
        at = rng.randrange(len(x))
        out += [x, x[:at] + "Q" * rng.randrange(1, 4) + x[at + 1 :], x + x]
    return [*out, "x" * 5000, "x" * 12, "x" * 11, "abcdefghijkl", "abcdefghijk"]


def test_no_python_on_executors(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string").where("doc_id > 0")
    whole = docs.select(F.col("doc_id").alias("lid"), lines._units(F.col("text")).alias("u"))
    sketches = lines._sketched(whole, 12)
    pairs = docs.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    for df in (lines.signatures(docs), sketches, lines._verified(pairs, whole, sketches, 12, 0.8)):
        assert not re.search("InArrow|InPandas|EvalPython", df._jdf.queryExecution().executedPlan().toString())


def test_pairs_are_verified_exactly(spark):
    texts = made()
    rng = random.Random(6)
    pairs = {(i, j) for k in range(0, 360, 3) for i, j in ((k, k + 1), (k, k + 2), (k + 1, k + 2))}
    pairs |= {(360, 361), (360, 362), (361, 362), (363, 364)} | {(rng.randrange(300), 300 + rng.randrange(60)) for _ in range(100)}
    rows = spark.createDataFrame(list(enumerate(texts)), "lid long, line string")
    whole = rows.select("lid", lines._units(F.col("line")).alias("u"))
    sketches = lines._sketched(whole, 12)
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    want = {(i, j) for i, j in pairs if alike(units(texts[i]), units(texts[j]))}
    got = lines._verified(spark.createDataFrame(sorted(pairs), "a long, b long"), whole, sketches, 12, 0.8).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want and 20 < len(want) < len(pairs)


def test_sketches(spark):
    texts = made()
    rows = spark.createDataFrame(list(enumerate(texts)), "lid long, line string")
    got = {r.lid: r for r in lines._sketched(rows.select("lid", lines._units(F.col("line")).alias("u")), 12).collect()}
    assert len(got) == len(texts)
    for i, x in enumerate(texts):
        n = len(x.encode("utf-16-be")) // 2
        bits = sum((got[i][f"b{k}"] & (1 << 64) - 1).bit_count() for k in range(lines.WORDS))
        assert got[i].n == max(1, n - 11) and got[i].set == bits and 0.9 * len(units(x)) - 2 <= bits <= len(units(x))
