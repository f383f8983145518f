import itertools
import random

import xxhash
from pyspark.sql import functions as F

from quillspark.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """rows: (doc_id, fp)"""
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(rows, 2):
        if (x ^ y).bit_count() <= 2:
            r, s = sorted((find(a), find(b)))
            parent[s] = r
    return {d: find(d) for d, _ in rows}


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(300))
    texts = [None, "", " \t\n", "One", "one", "two Words", "a b c d", base, base, base.replace("w150 ", "x "), base.replace("w9 ", "y "), "ÉCOLE été " * 40, "x" * 200_000, "other words here now"]
    rows = [(i * 3, t, "en", "s") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).withColumn("u", F.col("fp")).collect()}
    want = [(d, brute_fingerprint(t)) for d, t, *_ in rows]
    assert {d: got[d].fp % (1 << 64) for d, _ in want} == dict(want)
    assert {d: got[d].component_id for d, _ in want} == brute_components(want)


def test_links_against_brute_force(spark):
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for x in list(fps)[:40]:
        for _ in range(6):
            y = x
            for _ in range(rng.randint(1, 4)):
                y ^= 1 << rng.randrange(64)
            fps.add(y)
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(20, 24)}
    rows = [(i, x) for i, x in enumerate(sorted(fps))]
    signed = [(x - (1 << 64) if x >> 63 else x,) for _, x in rows]
    ids = {s[0]: i for i, s in enumerate(signed)}
    df = spark.createDataFrame(signed, "fp long")
    edges = simhash.links(df)
    from quillspark.llm.common import components

    root = {r.node: r.root for r in components(edges).collect()}
    groups = {}
    for s, i in ids.items():
        groups.setdefault(root.get(s, s), set()).add(i)
    want = {}
    for i, r in brute_components(rows).items():
        want.setdefault(r, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    shared = lambda x, y: sum((x ^ y) >> (8 * i) & 255 == 0 for i in range(8))
    every = {(a[0], b[0]) for a, b in itertools.combinations(sorted(signed), 2)}
    for distance in (1, 2, 3):
        found = {(r.a, r.b) for r in simhash.links(df, distance).collect()}
        assert found == {(a, b) for a, b in every if bin((a ^ b) & (1 << 64) - 1).count("1") <= distance}
        # what the tally retains, before anything is verified: the pairs with enough bytes in common
        counted = {(r.a, r.b): r.matches for r in simhash.tallied(df, distance).collect()}
        assert counted == {(a, b): shared(a, b) for a, b in every if shared(a, b) >= 8 - distance} and len(counted) > len(found) - (distance == 1)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stage_keeps_first(spark):
    docs = spark.createDataFrame([(5, "a b c d"), (2, "a b c d"), (7, "z")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.stage(spark, docs, "").collect()) == [2, 7]


def test_stage_judges_rows(spark):
    rows = [(3, "a b c d", 1), (5, "a b c d", 2), (5, "quite another text here", 3), (5, "quite another text here", 3), (None, "a b c d", 4), (None, "the only one of its kind", 5), (9, None, 6), (10, "", 7)]
    names = ["_t", "_own0", "fp", "root", "node", "component_id", "doc_id2", "th", "a.b"]
    docs = spark.createDataFrame([(*r, *[r[2]] * len(names)) for r in rows], ["doc_id", "text", "lang", *names])
    out = simhash.stage(spark, docs, "")
    assert out.columns == docs.columns and sorted(r.lang for r in out.collect()) == [1, 3, 5, 6]
    assert simhash.stage(spark, docs.limit(0), "").count() == 0
