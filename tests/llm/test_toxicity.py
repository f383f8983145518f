import random
import zlib

import numpy as np

from quillspark.llm import toxicity as T


def test_gradients():
    """Against differences of the loss."""
    rng = np.random.default_rng(0)
    net = T.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.standard_normal((5, 4, T.INPUT))
    mask = np.array([[1, 1, 1, 1], [1, 1, 1, 1], [1, 1, 0, 1], [1, 0, 0, 1], [0, 0, 0, 1.0]])
    y, weight = np.array([1, 0, 1, 0.0]), np.array([1, 2, 1, 0.5])
    _, g, dx = net.gradients(x, mask, y, weight)
    e = 1e-2  # states are kept in 32 bits
    for k in g:
        flat = net.p[k].reshape(-1)
        for i in rng.choice(flat.size, min(4, flat.size), replace=False):
            was = flat[i]
            flat[i] = was + e
            a = net.gradients(x, mask, y, weight)[0]
            flat[i] = was - e
            b = net.gradients(x, mask, y, weight)[0]
            flat[i] = was
            assert abs((a - b) / (2 * e) - g[k].reshape(-1)[i]) < 2e-4
    assert np.abs(dx[mask == 0]).max() == 0


def test_windows_cover_all():
    for n in (1, 31, 32, 33, 48, 49, 500):
        v = T._windows(np.arange(1, n + 1, dtype=np.int32))
        assert set(v.reshape(-1)) - {0} == set(range(1, n + 1)) and v.shape[1] == T.WINDOW
        assert n > T.WINDOW or len(v) == 1


def test_cached_gates_equal_inputs():
    net = T.Network(2)
    texts = [b"some words, here " * 30, b"", b"one", "été über".encode()]
    a = T.Scorer(net).logits(texts)
    s = T.Scorer(net)
    b = [s.logits([t])[0] for t in texts]
    assert [len(x) for x in a] == [len(x) for x in b] and len(a[1]) == 0
    assert all(np.allclose(x, y, atol=1e-5) for x, y in zip(a, b, strict=True))


def plain_logit(p, words):
    """One window, word by word and number by number: GRU both ways, attention, output."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h = T.STATE
    inputs = []
    for w in words:
        raw = b"^" + w + b"$"
        grams = [p["gram"][T.gram_slots([w])[0][i]] for i in range(len(raw) - 2)]
        inputs.append(p["word"][zlib.crc32(w) % T.WORDS] + sum(grams) / len(grams))
    states = []
    for d, order in (("f", range(len(words))), ("b", range(len(words) - 1, -1, -1))):
        (W, U, c), s = (p[f"{k}_{d}"].astype(float) for k in "WUc"), np.zeros(h)
        out = [None] * len(words)
        for t in order:
            g, u = inputs[t] @ W + c, s @ U
            r, z = sigmoid(g[:h] + u[:h]), sigmoid(g[h : 2 * h] + u[h : 2 * h])
            n = np.tanh(g[2 * h :] + r * u[2 * h :])
            s = (1 - z) * n + z * s
            out[t] = s
        states.append(out)
    both = [np.concatenate([states[0][t], states[1][t]]) for t in range(len(words))]
    e = np.array([np.tanh(x @ p["A"] + p["a"]) @ p["v"] for x in both])
    alpha = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
    return sum(a * x for a, x in zip(alpha, both, strict=True)) @ p["w"] + p["o"][0]


def test_scores_against_a_plain_forward_pass():
    rng = np.random.default_rng(4)
    net = T.Network(5)
    net.p = {k: (v + 0.3 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in net.p.items()}
    texts = [" ".join(f"{'abcdefgh'[i % 8]}{rng.integers(90)}é" for i in range(n)).encode() for n in (1, 5, 31, 32, 33, 47, 48, 49, 130)] + [b"(one), -- two!"]
    scorer = T.Scorer(net)
    for text, got in zip(texts, scorer.logits(texts), strict=True):
        w = T.tokens(text)
        want = [plain_logit(net.p, w[s : s + T.WINDOW]) for s in T.window_starts(len(w))]
        assert np.allclose(got, want, atol=2e-4)
        f = T.summary(got)
        top = sorted(np.clip(want, -1e9, 1e9), reverse=True)
        assert np.allclose(f, np.clip([top[0], np.mean(top[:3]), np.mean(top)], -20, 20), atol=5e-4)


def made(n=260, seed=0):
    rng = random.Random(seed)
    bad = ["blarg", "snorf", "grunk"]
    rows, labels = [], []
    for d in range(n):
        w = [f"{rng.choice('abcdefg')}{rng.randrange(300)}x" for _ in range(rng.randrange(20, 150))]
        toxic = d % 4 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((d, " ".join(w), "en", 1))
        labels.append((d, 1, int(toxic)))
    return rows, labels


def test_query(spark):
    rows, labels = made()
    rows += [(900, None, "en", 0), (901, "", None, 0), (902, "blarg " * 9000, "en", 0), (902, "blarg " * 9000, "en", 0), (None, "a", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    lab = spark.createDataFrame(labels + [(5000, 1, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = T.score(docs, lab).collect()
    assert len(got) == len(rows)
    truth = {d: t for d, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum((r.score >= 0.5) == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (900, 901)} == {0.0}
    assert T.score(docs.limit(0), lab).count() == 0
    assert len({r.score for r in T.score(docs, lab.limit(0)).collect()}) <= 2


def test_class_shares(spark):
    """The constant follows the share in all labels, however many of each class are fitted on."""
    labels = spark.createDataFrame([(d, int(d % 10 == 0)) for d in range(1000)], "doc_id long, toxic int")
    known = [d for d in range(1000) if zlib.crc32(str(d).encode()) % 5]
    assert abs(T.share(labels) - (sum(d % 10 == 0 for d in known) + 1) / (len(known) + 2)) < 1e-12
    odds = lambda p: np.log(p / (1 - p))
    for own in ([1] * 50 + [0] * 50, [1] * 10 + [0] * 90):
        beta = T.recentred(np.array([1.0, 2, 3, odds((sum(own) + 1) / 102)]), own, 0.1)
        assert np.allclose(beta, [1, 2, 3, odds(0.1)])
    assert T.share(labels.limit(0)) == 0.5
