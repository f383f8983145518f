import random
import re

import pytest

from quillspark.llm import decontaminate


def split(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    phrases = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            phrases.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, names = split(t), set(), set()
        for p, ids in phrases.items():
            for s in range(len(w) - len(p) + 1):
                if tuple(w[s : s + len(p)]) == p:
                    hit |= set(range(s, s + len(p)))
                    names |= ids
        out.append((d, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


ITEMS = [(0, "The cat, sat on the MAT and then it went away again"), (1, "Short one"), (2, None), (3, "..."), (11, " ".join(f"q{i}" for i in range(25))), (12, "a a a a a a a a a a a a"), (13, "Short ONE"), (14, "École à Paris"), (0, "The cat, sat on the MAT and then it went away again")]


def made():
    rng = random.Random(2)
    docs = [(0, None), (1, ""), (2, "!!"), (3, "a " * 5000), (4, "a a a b a a a a a a a a a a b"), (5, "école à paris; École à Paris"), (6, "x short-one y short.one"), (6, "x short-one y short.one"), (6, "another short one"), (None, "Short one")]
    for d in range(20, 60):
        w = [rng.choice(["the", "a", "cat", "q3", "zz", f"w{rng.randrange(50)}"]) for _ in range(rng.randrange(60))]
        t = split(ITEMS[rng.choice([0, 4])][1])
        a = rng.randrange(len(t))
        w[rng.randrange(len(w) + 1) : 0] = t[a : a + rng.randrange(4, 25)]
        docs.append((d, " ".join(w)))
    return docs


@pytest.mark.parametrize("block_terms", [10, 100_000])
def test_against_brute_force(spark, block_terms, monkeypatch):
    docs = made()
    monkeypatch.setattr(decontaminate.index, "__defaults__", (10, 3, block_terms))
    monkeypatch.setattr(decontaminate.matches, "__defaults__", (10, 0, 3, block_terms))
    monkeypatch.setattr(decontaminate, "SLICE", 2 if block_terms == 10 else 50_000)
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, phrase string").repartition(4)
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in decontaminate.contamination(d, b).collect()), key=str)
    assert got == brute(docs, ITEMS)
    assert decontaminate.stage.__doc__


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contamination(d.limit(0), b).count() == 0
    assert [r.n_hit for r in decontaminate.contamination(d, b.limit(0)).collect()] == [0, 0]


def test_proximity(spark):
    b = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    texts = ["alpha beta gamma delta epsilon zeta eta theta iota kappa", "alpha beta gamma x delta epsilon zeta eta theta iota kappa", "kappa iota theta eta zeta epsilon delta gamma beta alpha", "alpha " + "x " * 30 + "beta gamma delta epsilon zeta eta theta iota kappa"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hits = decontaminate.matches(d, b, slop=2)[0].collect()
    assert {(r.doc_id, r.exact) for r in hits if r.exact} == {(0, True)}
    assert 1 in {r.doc_id for r in hits if not r.exact} and 3 not in {r.doc_id for r in hits}


def brute_near(docs, items, slop, size=10):
    """(doc_id, start, phrase) where, from an occurrence of the rarest term on, every term is within
    slop of its place."""
    texts = [(d, split(t)) for d, t in docs]
    count = {}
    for _, w in texts:
        for x in w:
            count[x] = count.get(x, 0) + 1
    out = set()
    phrases = {tuple(w[k : k + size]) for _, t in items for w in [split(t)] if w for k in range(max(1, len(w) - size + 1))}
    for p in phrases:
        if any(x not in count for x in p):
            continue
        _, offset, rarest = min((count[x], i, x) for i, x in enumerate(p))
        for d, w in texts:
            for at in (i for i, x in enumerate(w) if x == rarest):
                s = at - offset
                if s >= -slop and all(any(w[q] == x for q in range(max(0, s + i - slop), min(len(w), s + i + slop + 1))) for i, x in enumerate(p)):
                    out.add((d, s, " ".join(p)))
    return out


@pytest.mark.parametrize("slop", [1, 2])
def test_proximity_by_brute_force(spark, slop):
    rng = random.Random(slop)
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "alpha beta gamma delta"), (3, "a b a c a d a e a f a g")]
    docs = [(0, "alpha beta gamma no no no no no no no"), (1, items[0][1]), (2, "beta alpha gamma delta"), (3, "")]
    for d in range(4, 60):
        w = split(rng.choice(items)[1])
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w) - 1)
            how = rng.randrange(4)
            if how == 0:
                w[i], w[i + 1] = w[i + 1], w[i]
            elif how == 1:
                w.insert(i, rng.choice(["no", "alpha", "a"]))
            elif how == 2 and len(w) > 3:
                del w[i]
            else:
                w[i] = "no"
        docs.append((d, " ".join(["pre"] * rng.randrange(3) + w + ["post"] * rng.randrange(3))))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    hits = decontaminate.matches(d, spark.createDataFrame(items, "item_id long, text string"), slop=slop)[0].collect()
    want = brute_near(docs, items, slop)
    exact = {(r.doc_id, r.start, r.phrase) for r in hits if r.exact}
    near = {(r.doc_id, r.start, r.phrase) for r in hits if not r.exact}
    assert not exact & near and exact | near == want and not any(x[0] == 0 and x[2].startswith("alpha beta gamma delta epsilon") for x in want)
    assert len(near) > 10 and exact


def test_stage_keeps_rows_and_columns_of_any_name(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four"), (None, "never here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["_d", "_t", "_own0", "th", "w", "word", "a.b"]
    rows = [(None, "x one two three four", 1), (None, "clean", 2), (7, "One-two three FOUR", 3), (7, "clean too", 4), (7, "clean too", 4), (8, None, 5), (9, "", 6)]
    docs = spark.createDataFrame([(*r, *[r[2]] * len(names)) for r in rows], ["doc_id", "text", "lang", *names])
    out = decontaminate.stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(r.lang for r in out.collect()) == [2, 4, 4, 5, 6]
    assert decontaminate.stage(spark, docs.limit(0), str(tmp_path)).count() == 0
