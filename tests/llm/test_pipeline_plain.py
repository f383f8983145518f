"""The pipeline against a plain version of itself, and on odd tables."""

import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import test_decontaminate
import test_lines
import test_quality
import test_simhash
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def by_quality(rows):
    kept = test_quality.brute_kept([(i, t, lang, source) for i, (_, t, lang, source, *_) in enumerate(rows)])
    return [r for i, r in enumerate(rows) if kept[i]]


def without_lines(rows):
    th = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) if t is not None else 42
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    once = sorted({(r[0], r[1], signed(th(r[1]))) for r in rows}, key=lambda x: (x[0] is not None, x[0] or 0, x[2]))
    gone = defaultdict(set)
    for d, h, k in test_lines.brute(once):
        gone[d, h].add(k)
    cut = lambda d, t: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d, signed(th(t))])
    return [(r[0], cut(r[0], r[1]), *r[2:]) for r in rows]


def one_of_each_group(rows):
    distinct = sorted({test_simhash.brute_fingerprint(r[1]) for r in rows})
    component = test_simhash.brute_components([(fp, fp) for fp in distinct])
    best = {}
    for r in rows:
        c = component[test_simhash.brute_fingerprint(r[1])]
        if c not in best or (r[0] is None, r[0] or 0) < (best[c][0] is None, best[c][0] or 0):
            best[c] = r
    return list(best.values())


def without_benchmark(rows, items):
    hit = {i for i, _, n, _ in test_decontaminate.brute([(i, r[1]) for i, r in enumerate(rows)], items) if n}
    return [r for i, r in enumerate(rows) if i not in hit]


def made():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    line = lambda: " ".join(word() for _ in range(rng.randrange(14, 22)))
    boiler, item = [line() for _ in range(3)], " ".join(f"item{i}" for i in range(14))
    rows = []
    for d in range(160):
        lines = [line() for _ in range(rng.randrange(2, 7))]
        if rng.random() < 0.3:
            lines.insert(rng.randrange(len(lines)), rng.choice(boiler))
        if rng.random() < 0.1:
            lines.append(rng.choice(boiler) + "x")  # a similar line
        if rng.random() < 0.1:
            lines.append(item)
        if rng.random() < 0.1:
            lines = [x.replace(" ", " | ") for x in lines]
        rows.append((d * 3, "\n".join(lines), rng.choice(["en", "de", None]), rng.choice(["a", "b"]), d))
    for k in range(6):
        d, t, *rest = rows[k]
        rows.append((1000 + k, t.replace("\n", " "), *rest))  # the same words, other lines
    odd = [(None, line() + "\n" + line(), None, None, None), (None, "short", "en", "a", 1), (7000, None, "en", "a", 1), (7001, "", "en", "a", 1), (7002, "é " * 9, "de", "b", 1), rows[10], rows[10], (7003, "\n".join(line() for _ in range(400)), "en", "a", 1)]
    return rows + odd, [(1, item), (2, None), (3, "never to be found here at all")]


def test_whole_result_against_a_plain_version(spark, tmp_path):
    rows, items = made()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = [by_quality(rows)]
    want.append(without_lines(want[-1]))
    want.append(one_of_each_group(want[-1]))
    want.append(without_benchmark(want[-1], items))
    assert all(len(a) > len(b) for a, b in ((rows, want[0]), (want[1], want[2]), (want[2], want[3]))) and want[0] != want[1]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), rest in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        assert Counter(tuple(r) for r in docs.collect()) == Counter(rest), name
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = Counter((d, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for d, t, *_ in want[-1])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    size, places = defaultdict(int), defaultdict(list)
    for r in sorted(out, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.start)):
        assert r.length <= 2048 and (r.start == r.piece * 2048)
        size[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert Counter(size.items()) == tokens
    for at in places.values():
        at.sort()
        assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False)) and sum(at[-1]) <= 2048
    assert len(places) <= -(-sum(size.values()) // 2048) + 1


@pytest.mark.parametrize("case", ["empty corpus", "empty benchmark", "more columns"])
def test_odd_tables_go_through(spark, tmp_path, case):
    rng = random.Random(5)
    text = lambda: "\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(3))
    t = text()
    rows = [(1, t, "en", "s", 1), (1, t, "en", "s", 1), (1, text(), "en", "s", 1), (None, text(), None, None, None), (None, None, None, None, None), (2, text(), "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    if case == "empty corpus":
        docs = docs.limit(0)
    if case == "more columns":
        for c in ("row", "th", "lid", "_own0", "root", "fp", "sequence_id", "length", "kept", "a.b"):
            docs = docs.withColumn(c, F.lit(5))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items = spark.createDataFrame([(1, rows[-1][1])], "item_id long, text string")
    (items.limit(0) if case == "empty benchmark" else items).write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = {"empty corpus": [], "empty benchmark": [1, 1, 2, None], "more columns": [1, 1, None]}[case]
    assert sorted((r.doc_id for r in out), key=str) == sorted(want, key=str)
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)
