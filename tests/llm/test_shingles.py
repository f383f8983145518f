import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import shingles


def lines(seed=0):
    rng = random.Random(seed)
    made = ["".join(rng.choice("abé漢 🎉") for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    base = "abcdefghijkl"  # all orders of some of its letters
    swapped = ["".join(p) + base[4:] + "z" for p in itertools.permutations(base[:4])] + [base[i:] + base[:i] for i in range(12)]
    return made + swapped + ["x", "x" * 11, "x" * 12, "x" * 13, "y" * 5000, "abcdefghijkl", "abcdefghijk"] + made[:50]


def sets(line, size):
    u = line.encode("utf-16-be")
    n = len(u) // 2
    return [u[2 * i : 2 * (i + size)] for i in range(max(1, n - size + 1))]


def column(texts):
    return pa.array([t.encode("utf-16-be") for t in texts], pa.binary())


@pytest.mark.parametrize("size", [1, 2, 5, 7, 12])
def test_hashes_tell_shingles_apart(size, monkeypatch):
    monkeypatch.setattr(shingles, "STEP_BYTES", 700)
    texts, named = lines(), {}
    for first, offsets, units in shingles.steps(pa.array([b"before", *column(texts).to_pylist()], pa.binary()).slice(1)):
        begin, h = shingles.hashes(offsets, units, size)
        for i, part in enumerate(np.split(h, begin[1:])):
            want = sets(texts[first + i], size)
            assert len(part) == len(want)
            for s, x in zip(want, part.tolist(), strict=True):
                assert named.setdefault(s, x) == x
    assert len(set(named.values())) == len(named)


def test_minima_bits_and_shared():
    texts = lines(1)
    other = texts[::-1]
    _, offsets, units = next(shingles.steps(column(texts)))
    begin, h = shingles.hashes(offsets, units, 12)
    each = np.split(h, begin[1:])
    functions = [(5, 7), (123456789, 987654321)]
    got = shingles.minima(begin, h, functions)
    for i, x in enumerate(each):
        top = [v >> 32 for v in x.tolist()]
        assert got[i].tolist() == [min((v ^ b) * (2 * a + 1) % (1 << 32) for v in top) for a, b in functions]
    bits = shingles.bitmaps(begin, h, 64)
    for i, x in enumerate(each):
        want = {v >> 52 for v in x.tolist()}
        assert {64 * w + k for w in range(64) for k in range(64) if int(bits[i, w]) >> k & 1} == want
    n, m, k = shingles.shared(column(texts), column(other), 12)
    for i, (a, b) in enumerate(zip(texts, other, strict=True)):
        x, y = set(sets(a, 12)), set(sets(b, 12))
        assert (n[i], m[i], k[i]) == (len(x), len(y), len(x & y))


def test_bits_are_even(monkeypatch):
    """The upper bits of hashes of lines of few letters spread over all slots."""
    rng = random.Random(3)
    text = ["".join(rng.choice("ab ") for _ in range(400)) for _ in range(200)]
    _, offsets, units = next(shingles.steps(column(text)))
    _, h = shingles.hashes(offsets, units, 12)
    different = np.unique(h)
    got = np.bincount((different >> np.uint64(52)).astype(np.int64), minlength=4096)
    mean = len(different) / 4096
    assert got.max() < mean + 8 * mean**0.5 and abs(got.var() / mean - 1) < 0.2
    assert shingles.bitmaps(np.array([0]), different, 64).view("<u8").sum() != 0
