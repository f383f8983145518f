import hashlib
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import bytes_of, fim

UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def brute(doc_id, text, seed=7, rate=100, spm=50):
    t = text or ""
    u = UNIT.findall(t)
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(v % (len(u) + 1) for v in h[:2])
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, t
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(u), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet=st.sampled_from("a\n<PSM>é🎉"), max_size=60), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), max_size=6), st.sampled_from([1, 2, 3, 7, 4096]))
def test_chunks_of_any_size(rows, size):
    offsets, raw = bytes_of.utf8(pa.array([r[0] for r in rows], pa.string()))
    h1, h2 = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
    n, prefix, middle, marked = fim.cut_places(offsets, raw, h1, h2, size)
    for i, (t, x, y) in enumerate(rows):
        u = UNIT.findall(t)
        a, b = sorted((x % (len(u) + 1), y % (len(u) + 1)))
        want = len(u), len("".join(u[:a])), len("".join(u[a:b])), any(m in t for m in ("<P>", "<S>", "<M>"))
        assert (n[i], prefix[i], middle[i], marked[i]) == want


TEXTS = [None, "", "\n", "one line", "a\nb", "a\n\n\nb\n", "x <P> y\nz", "x <P\n> <S", "<M", ">", "<S\n<S\n<P", "é🎉\n" * 3000, "line\n" * 50_000, "long " * 40_000, "\r\n\r", "P>\nS>\nM>\n<", "<\n" * 9]


def test_brute_force(spark):
    rows = [(i * 11 + k, t, "s", 4) for k in range(8) for i, t in enumerate(TEXTS)] + [(None, "a\nb\nc\n", None, None), (5, "q\nr\n", "x", 1), (5, "q\nr\n", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, `n.a` int").repartition(3)
    for seed, rate, spm in ((7, 100, 50), (3, 40, 20)):
        out = fim.fill_in_middle(docs, seed, rate, spm)
        got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
        key = lambda r: tuple((x is not None, x) for x in r)
        assert sorted(((r.row.doc_id, r.row.text, r.row.form, r.row["n.a"], r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted(((*r, *brute(r[0], r[1], seed, rate, spm)) for r in rows), key=key)
        assert all(r.back == (r.row.text or "") for r in got)
        assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
