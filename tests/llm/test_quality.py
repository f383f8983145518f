import math
import random
from collections import Counter

from quillspark.llm import quality


def brute(text):
    t = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
    lines = [x for x in t.split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    hit = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))


TEXTS = [None, "", " \n\t", "a b c", "é ü 你好 #x", "a b c d e f " * 4, "x\nx\n x\n\n\ny\nx", " ".join(f"w{i}" for i in range(30)), "a b c d e q a b c d e " + " ".join(f"v{i}" for i in range(60)), "z " * 30000]


def test_counts(spark):
    rows = [(i, t, "en", "s", 3) for i, t in enumerate(TEXTS)] + [(3, "a b c", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")
    got = quality.quality(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(rows[r.doc_id][1])
        assert tuple(r)[1:6] == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_adaptive(spark):
    clean = [(i, " ".join(f"word{i}x{j}" for j in range(40)), "en", "a") for i in range(60)]
    loud = [(i + 100, " ".join(f"word{i}x{j}".upper() for j in range(40)), "en", "loud") for i in range(60)]
    odd = [(900, clean[0][1].upper(), "en", "a"), (901, clean[0][1].replace(" ", "$$$ "), "en", "a"), (902, clean[1][1].upper(), "en", "few")]
    docs = spark.createDataFrame(clean + loud + odd, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    assert [d for d, k in kept.items() if not k] == [900, 901] or sorted(d for d, k in kept.items() if not k) == [900, 901]
    assert kept[102], "upper case is usual in its source"


def test_stage_and_empty(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(30)), "en", "s", 7), (2, "short", None, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")
    out = quality.stage(spark, docs, "")
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == rows[:1]
    assert quality.quality(docs.limit(0)).count() == 0


def bucket(x):
    return math.ceil(math.log(x) / math.log(1.02 / 0.98))


def brute_kept(rows):
    """doc_id to kept: fences of exact weighted counts, in plain Python."""
    shares = {}
    for d, t, lang, source in rows:
        n_words, chars, symbols, dup, rep = brute(t)
        t = t or ""
        up, letters = sum("A" <= c <= "Z" for c in t), sum("A" <= c <= "Z" or "a" <= c <= "z" for c in t)
        n_lines = sum(bool(x.strip(" \t\r\x0b\x0c")) for x in t.split("\n"))
        x = ((symbols + 1) / (n_words + 10), (up + 5) / (letters + 50), (rep + 5) / (n_words + 200), (dup + 1) / (n_lines + 10), (chars + 1) / (n_words + 1))
        counts = ((symbols, n_words), (up, letters), (rep, n_words), (dup, n_lines), (chars, n_words))
        sure = [bucket((math.sqrt(a) - 1) * (math.sqrt(a) - 1) / b) if a > 1 and b else None for a, b in counts]
        shares[d] = (lang, source, [bucket(v) for v in x], sure, n_words < 10 or 100 * rep > 20 * n_words)

    def merged(own, wide, prior=30):
        total = sum(wide.values())
        out = Counter({b: float(n) for b, n in own.items()})
        for b, n in wide.items():
            out[b] += n * prior / total
        return out

    def reached(c, q):
        seen = 0.0
        for b in sorted(c):
            seen += c[b]
            if seen >= sum(c.values()) * q - 1e-9:
                return b

    kept = {d: not bad for d, (*_, bad) in shares.items()}
    for k in range(5):
        every = Counter(b[k] for *_, b, _, _ in shares.values())
        langs = {x: merged(Counter(b[k] for lang, _, b, _, _ in shares.values() if lang == x), every) for x in {v[0] for v in shares.values()}}
        for g in {v[:2] for v in shares.values()}:
            c = merged(Counter(b[k] for lang, source, b, _, _ in shares.values() if (lang, source) == g), langs[g[0]])
            q25, q75 = reached(c, 0.25), reached(c, 0.75)
            for d, (lang, source, b, sure, _) in shares.items():
                if (lang, source) == g and b[k] > q75 + 3 * (q75 - q25 + 1) and sure[k] is not None and sure[k] > q75:
                    kept[d] = False
    return kept


def test_kept_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for d in range(400):
        lang, source = rng.choice([("en", "a"), ("en", "b"), ("de", "a"), (None, "c"), ("de", None)])
        n = rng.randrange(1, 120)
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n)]
        if rng.random() < 0.15:
            w = [x + "#" * rng.randrange(3) for x in w]
        if rng.random() < 0.1:
            w = [x.upper() if rng.random() < 0.6 else x for x in w]
        if rng.random() < 0.2:
            w += w[: n // 5]
        rows.append((d, ("\n" if rng.random() < 0.3 else " ").join(w), lang, source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    want = brute_kept(rows)
    assert got == want and 20 < sum(not k for k in want.values()) < 380
    limits = quality.thresholds(quality.sketch(quality.with_counts(docs, ["lang", "source"]))).collect()
    assert all(len({r[f"limit_{k}"] for r in limits}) > 1 for k in ("symbols_per_word", "chars_per_word", "upper_share"))


def test_stage_keeps_columns_of_any_name(spark):
    names = ["limit_upper_share", "_q_n_words", "row", "n_words", "kept", "n", "a.b"]
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text, None, "s"), (1, text, "en", None), (1, text, "en", None), (2, None, "en", "s"), (3, "", None, None)]
    docs = spark.createDataFrame([(*r, *[i] * len(names)) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` int" for n in names))
    out = quality.stage(spark, docs, "")
    assert out.columns == docs.columns and sorted(r[-1] for r in out.collect()) == [0, 1, 2]
    assert quality.stage(spark, docs.limit(0), "").count() == 0


def test_short_texts_without_faults_are_kept(spark):
    """A group of long texts, and in it short ones with no symbol, repeat or repeated line."""
    words = lambda d, n: " ".join(f"{'abcdefgh'[(d + i) % 8]}word{d}x{i}" for i in range(n))
    rows = [(d, words(d, 400 + d), "en", "a") for d in range(200)] + [(1000 + n, words(1000 + n, n), "en", "a") for n in (10, 12, 20, 40, 80, 120, 200)]
    bad = [(2000 + n, " | ".join(words(2000 + n, n).split()), "en", "a") for n in (40, 400)]
    docs = spark.createDataFrame(rows + bad, "doc_id long, text string, lang string, source string")
    assert sorted(r.doc_id for r in quality.quality(docs).collect() if not r.kept) == [2040, 2400]
