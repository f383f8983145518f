import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import bytes_of, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [None, "", " ,.;", "One", "one TWO three", "é ü 你好 #x Ébc", "a" * 64, "b" * 65 + " c", "漢字" * 3000, "x1 y2 " * 40, "-".join(f"w{i}" for i in range(50)), "ab\x00cd\x7fef"]


def brute_features(text, run=1):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(lowered)
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) for k in range(1, run + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, run=1, buckets=10_000, seed=2024, percent=10, least=20):
    """docs: (doc_id, text) of different doc_ids."""
    s = Counter(f % buckets for _, t in docs for f in brute_features(t, run)[1])
    t = Counter(f % buckets for x in target for f in brute_features(x, run)[1])
    a, b = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = {}
    for d, text in docs:
        n, f = brute_features(text, run)
        g = [math.floor(1000 * math.log((t[x % buckets] + 1.0) * a / ((s[x % buckets] + 1.0) * b))) for x in f]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
        out[d] = [n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    fit = sorted((d for d in out if out[d][0] >= least), key=lambda d: (-out[d][3], d))
    for i, d in enumerate(fit[: percent * len(fit) // 100]):
        out[d][4] = i + 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZ9 ,-é漢\n\x00\x7f"), max_size=200), max_size=6), st.integers(1, 3))
def test_features(texts, run):
    offsets, raw = bytes_of.utf8(pa.array(texts, pa.string()))
    n_words, of, bucket = resampling.features(offsets, raw, run, 1 << 32)
    for i, t in enumerate(texts):
        n, want = brute_features(t, run)
        assert n_words[i] == n and sorted(bucket[of == i].tolist()) == sorted(want)


def test_long_words_and_slices():
    texts = ["x" * n for n in (1, 63, 64, 65, 128, 129, 10_000)] + ["", "é" * 500 + " q"]
    column = pa.array(["before", *texts, None], pa.large_string()).slice(1)
    offsets, raw = bytes_of.utf8(column)
    seen = {}
    for first, o, r in bytes_of.blocks(offsets, raw, 100):
        _, of, bucket = resampling.features(o, r, 2, 1 << 32)
        for i, x in zip(of, bucket, strict=True):
            seen.setdefault(first + int(i), []).append(int(x))
    assert seen == {i: brute_features(t, 2)[1] for i, t in enumerate(texts) if t}
    assert [len(x) for x in bytes_of.utf8(pa.array([], pa.string()))] == [1, 0]


def as_rows(df):
    return {r.doc_id: [r.n_words, r.n_features, r.weight, r.score, r["rank"]] for r in df.collect()}


def test_brute_force(spark):
    rng = random.Random(3)
    voc = [f"w{i}" for i in range(80)]
    rows = [(i * 7, " ".join(rng.choices(voc, k=rng.randint(1, 60)))) for i in range(300)] + [(10_000 + i, t) for i, t in enumerate(TEXTS)]
    target = [" ".join(rng.choices(voc[:15], k=30)) for _ in range(20)] + ["", "漢字 b"]
    docs = spark.createDataFrame([(*r, "en", 5) for r in rows], "doc_id long, text string, rank string, score int").repartition(5)
    aim = spark.createDataFrame([(i, t) for i, t in enumerate([*target, None])], "item_id long, text string")
    for run, buckets, percent in ((1, 10_000, 10), (3, 97, 33)):
        want = brute(rows, target, run, buckets, percent=percent)
        got = as_rows(resampling.importance(docs, aim, run, buckets, percent=percent))
        assert got == want
        drawn = resampling.resample(docs, aim, run, buckets, percent=percent).collect()
        assert {r.row.doc_id: r["rank"] for r in drawn} == {d: x[4] for d, x in want.items() if x[4]}
        assert all(r.row["rank"] == "en" and r.row.text == dict(rows)[r.row.doc_id] for r in drawn)


def test_odd_tables(spark):
    words = " ".join(f"v{i}" for i in range(25))
    rows = [(None, words), (None, words + " more"), (1, words), (1, words), (1, words + " x"), (2, None)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    aim = spark.createDataFrame([(0, "v1 v2")], "item_id long, text string")
    got = resampling.importance(docs, aim, percent=50).collect()
    assert len(got) == 120 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 51))
    best = sorted((r for r in got if r.n_words >= 20), key=lambda r: -r.score)[49].score
    assert all(r["rank"] for r in got if r.n_words >= 20 and r.score > best) and all(r["rank"] is None for r in got if r.score < best)
    assert resampling.importance(docs.limit(0), aim).count() == 0
    assert resampling.importance(docs, aim.limit(0)).count() == 120
    short = spark.createDataFrame([(1, "too short"), (2, "")], "doc_id long, text string")
    assert [r["rank"] for r in resampling.importance(short, aim).collect()] == [None, None]


def test_draw_follows_the_weights(spark):
    """Texts like the target are drawn more often than others, and not only these."""
    rows = [(i, " ".join(["near" if i % 10 == 0 else "far"] + [f"c{j}" for j in range(20)])) for i in range(2000)]
    docs, aim = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, "near " * 400)], "item_id long, text string")
    drawn = [r.doc_id for r in resampling.importance(docs, aim).collect() if r["rank"]]
    share = np.mean([d % 10 == 0 for d in drawn])
    assert len(drawn) == 200 and 0.1 < share < 1
