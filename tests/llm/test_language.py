import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import bytes_of, language

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "erd", "öng", "ull"], "cc": ["que", "ille", "eau", "onc"]}


def brute_grams(text, sizes=language.SIZES):
    s = b" ".join([b"", *re.findall(rb"[a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())), b""])
    s = s if s != b"  " and len(s) > 1 else b" "
    return [(n, s[i : i + n]) for n in sizes for i in range(len(s) - n + 1)]


def as_bytes(size, gram):
    return size, int(gram).to_bytes(8, "little")[:size]


def made(rng, lang, words):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(words))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aBz ,-é漢\n9"), max_size=40), max_size=6), st.sampled_from([(3, 4), (1,), (2, 7)]))
def test_ngrams(texts, sizes):
    offsets, raw = bytes_of.utf8(pa.array(texts, pa.string()))
    got = defaultdict(Counter)
    for size, text, gram in language.ngrams(offsets, raw, sizes):
        for t, g in zip(text, gram, strict=True):
            got[int(t)][as_bytes(size, g)] += 1
    for i, t in enumerate(texts):
        assert got[i] == Counter(brute_grams(t, sizes))


def test_masks_hold_all_and_chance_is_as_told():
    """No language that holds an n-gram is ever missed, beyond 64 languages too; others answer as
    often as by_chance says."""
    rng = np.random.default_rng(2)
    key, code = rng.integers(0, 1 << 40, 15_000).astype(np.uint64), rng.integers(0, 70, 15_000)
    f = language.Filters.of([f"l{i}" for i in range(70)], 0, code, key, (4,), slots=1 << 10)
    masks = f.masks(key)
    assert all(int(masks[i, c // 64]) >> (c % 64) & 1 for i, c in enumerate(code.tolist()))
    other = f.masks(rng.integers(1 << 41, 1 << 50, 40_000).astype(np.uint64))
    for c in (0, 63, 64, 69):
        share = np.mean(other[:, c // 64] >> np.uint64(c % 64) & np.uint64(1))
        assert f.by_chance[c] > 0.003 and share == pytest.approx(f.by_chance[c], rel=0.35)


def training(spark, rng):
    rows = [(i, made(rng, lang, rng.randint(1, 40)), lang) for i, lang in enumerate(["aa"] * 150 + ["bb"] * 60 + ["cc"] * 20)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)


def test_counts_and_decisions_by_brute_force(spark):
    rng = random.Random(5)
    rows, docs = training(spark, rng)
    more = spark.createDataFrame([(900, None, "aa"), (901, "kalo", None), (902, "", "zz")], docs.schema)
    want = defaultdict(Counter)
    for _, t, lang in rows:
        want[lang].update(brute_grams(t))
    got = {(r.lang, *as_bytes(r["size"], r.gram)): r.n for r in language.ngram_counts(docs.unionByName(more)).collect()}
    assert got == {(lang, *g): n for lang, c in want.items() for g, n in c.items()}

    least = 0.004
    total = {(lang, s): sum(n for g, n in c.items() if g[0] == s) for lang, c in want.items() for s in language.SIZES}
    sets = {lang: {g for g, n in c.items() if n >= total[lang, g[0]] * least} for lang, c in want.items()}
    filters = language.learn(docs, least_share=least)
    assert filters.languages == ["aa", "bb", "cc"] and filters.usual == 0 and filters.by_chance.max() < 1e-2
    texts = [made(rng, rng.choice(list(sets)), rng.randint(1, 8)) for _ in range(200)] + ["kalo schque", "KALO!", "x", "wwww"]
    offsets, raw = bytes_of.utf8(pa.array(texts))
    exact = np.array([[sum(g in sets[lang] for g in brute_grams(t)) for lang in filters.languages] for t in texts])
    assert np.abs(filters.evidence(offsets, raw) - exact).max() <= 1.5, "but for what chance adds"
    best, share = filters.decide(offsets, raw)
    clear = np.sort(exact, 1)[:, -1] - np.sort(exact, 1)[:, -2] > 3
    assert clear.sum() > 150 and (best[clear] == exact.argmax(1)[clear]).all()
    assert best[-1] == 0 and share[-1] == 0, "nothing is known of it: what most was learned of"


def test_correction(spark):
    """A crowded filter, whose larger languages answer mostly by chance, still decides right."""
    rng = random.Random(6)
    keys = {lang: sorted({int.from_bytes(g, "little") | n << 56 for i in range(400) for n, g in brute_grams(made(rng, lang, 30))}) for lang in SYLLABLES}
    noise = np.random.default_rng(1).integers(0, 1 << 31, 900).astype(np.uint64) | np.uint64(4 << 56)
    code = np.concatenate([np.full(len(keys[k]), i) for i, k in enumerate(keys)] + [np.zeros(len(noise), np.int64)])
    key = np.concatenate([np.array(keys[k], np.uint64) for k in keys] + [noise])
    f = language.Filters.of(list(keys), 0, code, key, language.SIZES, slots=1 << 11)
    assert f.by_chance[0] > 0.15
    texts = [made(rng, "cc", 12) for _ in range(50)] + [made(rng, "aa", 12) for _ in range(50)]
    best, _ = f.decide(*bytes_of.utf8(pa.array(texts)))
    assert (best[:50] == 2).all() and (best[50:] == 0).all()


def test_odd_rows(spark):
    rng = random.Random(7)
    _, docs = training(spark, rng)
    filters = language.learn(docs)
    rows = [(1, None, 0.5, "x"), (2, "", 0.5, "x"), (3, "12 – 34 ¡!", 0.5, "x"), (None, made(rng, "bb", 9), 0.5, "x"), (4, made(rng, "cc", 40_000), 0.5, "x"), (4, "é", 0.5, "x"), (5, "Ω", None, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, own0 double, `lang.x` string")
    out = language.identify(odd, filters)
    assert out.columns == [*odd.columns, "lang_pred", "score"]
    got = out.collect()
    assert [r.lang_pred for r in got][:5] == ["und", "und", "und", "bb", "cc"] and [r.score for r in got][:3] == [0.0] * 3
    assert all(0 <= r.score <= 1 and r.lang_pred in ("aa", "bb", "cc") for r in got[3:])
    assert language.identify(odd.limit(0), filters).count() == 0
    nothing = language.learn(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in language.identify(odd, nothing).collect()} == {("und", 0.0)}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = language.op12_language(spark, sf).collect()
    truth = {r.doc_id: (r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    asked = [r for r in got if r.held_out and truth[r.doc_id][1] and re.search(r"[^\W\d_]", truth[r.doc_id][0] or "")]
    assert len(asked) > 200 and np.mean([r.lang_pred == truth[r.doc_id][1] for r in asked]) >= 0.99
    same = spark.read.parquet(f"{sf}/documents.parquet").withColumn("lang", F.when(~language.held_out(F.col("doc_id")), F.col("lang")))
    again = language.identify(same.select("doc_id", "text"), language.learn(same)).collect()
    assert {r.doc_id: r.lang_pred for r in again} == {r.doc_id: r.lang_pred for r in got}, "held-out labels are not seen"
