import hashlib
import os
import random
import tempfile

import numpy as np
import pytest

from quillspark.llm import suffixes


def test_transform_against_sorting():
    rng = random.Random(0)
    for case in range(25):
        strings = [bytes(rng.choice(b"ab\xff" if case % 2 else b"abcdefgh") for _ in range(rng.randrange(0, 14))) for _ in range(rng.randrange(1, 9))]
        with tempfile.TemporaryDirectory() as folder:
            b = suffixes.ColumnBwt(strings, folder)
            b.build()
            bwt, lcp = b.load()
            rows = sorted(([*(1 + c for c in s[o:]), 0 if o == len(s) else -1], k, o) for k, s in enumerate(strings) for o in range(len(s) + 1))
            # an end sorts before all symbols; equal suffixes by number of the string
            rows = sorted(((tuple(1 + c for c in s[o:]), k, o) for k, s in enumerate(strings) for o in range(len(s) + 1)), key=lambda r: (r[0], r[1]))
            want = [0 if o == 0 else 1 + strings[k][o - 1] for _, k, o in rows]
            assert bwt.tolist() == want
            common = [0] + [len(os.path.commonprefix([x[0], y[0]])) for x, y in zip(rows, rows[1:])]
            assert lcp.tolist() == common
            at = {(k, o): i for i, (_, k, o) in enumerate(rows)}
            for j, s, p in b.suffixes():
                assert [at[k, len(strings[k]) - j] for k in s.tolist()] == p.tolist()


@pytest.mark.parametrize("length", [3, 4, 6])
def test_windows_of_either_width(length):
    rng = random.Random(length)
    for _ in range(20):
        strings = [bytes(rng.choice(b"ab\xff") for _ in range(rng.randrange(length, 15))) for _ in range(rng.randrange(1, 9))]
        windows = {}
        for s, o, c in suffixes.repeats(strings, length, tempfile.mkdtemp() + "/columns"):
            for k, i, x in zip(s.tolist(), o.tolist(), c.tolist()):
                assert (k, i) not in windows
                windows[k, i] = x
        assert set(windows) == {(k, i) for k, s in enumerate(strings) for i in range(len(s) - length + 1)}
        by = {}
        for (k, i), x in windows.items():
            by.setdefault(strings[k][i : i + length], set()).add(x)
        assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == len(by)


def test_anchors():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.choice([0, 10, 49, 50, 51, 300]))) for _ in range(40)]
    texts += [texts[-1] * 2, b"z" * 200]
    h, number, place, first, last = suffixes.anchors(texts, 50, 20)
    owner = {}
    for x, d, p, a, b in zip(h.tolist(), number.tolist(), place.tolist(), first.tolist(), last.tolist()):
        assert a <= b and b + 50 <= len(texts[d]) and a <= p <= a + 30 and b <= p + 0 + 30
        for s in range(a, b + 1):
            assert (d, s) not in owner and s <= p <= s + 30
            owner[d, s] = (x, p - s)
    assert set(owner) == {(d, s) for d, t in enumerate(texts) for s in range(len(t) - 49)}
    same = {}
    for (d, s), o in owner.items():
        assert same.setdefault(texts[d][s : s + 50], o) == o


def brute(rows, n=50):
    raw = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, t in raw:
        for i in range(len(t) - n + 1):
            first[t[i : i + n]] = min(first.get(t[i : i + n], d), d)
    out = []
    for d, t in raw:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - n + 1):
            if first[t[i : i + n]] < d:
                gone[i + 1 : i + n + 1] = True
        kept = bytes(c for c, g in zip(t, gone[1:]) if not g)
        out.append((d, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", block)
    rng = random.Random(3)
    passage = "".join(rng.choice("abcd é") for _ in range(400))
    rows = [(0, None), (1, ""), (2, "x" * 49), (3, "x" * 50), (4, "x" * 5000), (5, passage), (6, passage[:50]), (7, passage[10:59])]
    for d in range(8, 60):
        t = "".join(rng.choice("abcdefgh ij") for _ in range(rng.randrange(200)))
        for _ in range(rng.randrange(3)):
            a, k = rng.randrange(350), rng.randrange(len(t) + 1)
            t = t[:k] + passage[a : a + rng.randrange(20, 200)] + t[k:]
        rows.append((d * 2, t))
    rows += [(700 + i, rows[-1 - i % 4][1]) for i in range(8)]
    near = rows[20][1] + "tail" + passage
    rows += [(800 + i, near[: i * 7] + "!" + near[i * 7 :]) for i in range(20)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, kept string").repartition(4)
    got = sorted(tuple(r)[:5] for r in suffixes.removals(docs, with_text=False).collect())
    assert got == brute(rows)


def test_edges(spark):
    docs = spark.createDataFrame([(4, "ab" * 60), (4, "ab" * 60), (None, "ab" * 60), (9, "ab" * 60)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed, len(r.kept)) for r in suffixes.removals(docs).collect())
    assert got == [(-1, 0, 120), (4, 0, 120), (4, 0, 120), (9, 120, 0)]
    assert suffixes.removals(docs.limit(0)).count() == 0


def test_texts_of_one_doc_id_are_told_apart(spark):
    a, c, e = (" ".join(f"{x}é{i}" for i in range(20)) for x in "ace")
    rows = [(1, a), (2, a), (2, c), (2, "x " + a + " y"), (2, c), (3, c + " " + e), (3, e), (4, None), (4, e)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffixes.removals(docs).collect())
    want = []
    for d, t in rows:
        b = (t or "").encode()
        gone = {i + j for i in range(len(b) - 49) if any(x < d and b[i : i + 50] in (y or "").encode() for x, y in rows) for j in range(50)}
        want.append((d, len(b), len(gone), bytes(x for i, x in enumerate(b) if i not in gone)))
    assert got == sorted(want) and (2, len(c.encode()), 0, c.encode()) in got
