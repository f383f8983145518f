import random

import pytest

from quillspark.llm import lines


def sets(line, n=12):
    """All runs of n characters; of a shorter line, the line."""
    return {line[i : i + n] for i in range(max(1, len(line) - n + 1))}


def brute(rows):
    """(row number, removed) by all pairs of different lines."""
    places = [(d, th, k, x) for d, t, th in rows for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\r\x0b\x0c")]
    texts = sorted({p[3] for p in places})
    shingles = [sets(x) for x in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            inter = len(shingles[i] & shingles[j])
            if inter >= 0.8 * len(shingles[i] | shingles[j]):
                root[find(i)] = find(j)
    first = {}
    key = lambda p: (p[0] is not None, p[0] or 0, p[1], p[2])
    number = {x: find(i) for i, x in enumerate(texts)}
    for p in sorted(places, key=key):
        first.setdefault(number[p[3]], key(p))
    return {(p[0], p[1], p[2]) for p in places if key(p) != first[number[p[3]]]}


def made():
    rng = random.Random(7)
    base = [" ".join(f"word{rng.randrange(4000)}é" for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    rows = [(0, None), (1, ""), (2, "\n \n\t\n"), (3, "Of."), (4, "Of.\n\nOf.\nOg."), (None, "Of."), (5, "x" * 5000), (6, "x" * 4000 + "y" * 10), (4, "Of.\n\nOf.\nOg.")]
    rows += [(7, "".join(chr(0x4E00 + 37 * i) for i in range(60))), (8, "".join(chr(0x4E00 + 37 * i) for i in range(60)) + "\u4e01"), (9, " a  b\tc"), (9, "a b c")]
    for d in range(10, 70):
        out = []
        for _ in range(rng.randrange(1, 6)):
            w = rng.choice(base).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"new{rng.randrange(900)}"
            out.append(" ".join(w))
        rows.append((d, "\n".join(out)))
    return rows


FORTY = tuple((i, i + 1, i + 2) for i in range(0, 120, 3))


@pytest.mark.parametrize("leaders", [(), (1, 2), (3, 12)])
def test_against_brute_force(spark, leaders, monkeypatch):
    monkeypatch.setattr(lines, "LEADERS", leaders)
    rows = made()
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_lines int").repartition(3)
    from pyspark.sql import functions as F

    hashed = [(r.doc_id, r.text, r.th) for r in docs.select("doc_id", "text", F.xxhash64("text").alias("th")).collect()]
    want = brute(hashed)
    got = {(r.doc_id, r.th, k) for r in lines.dedup(docs, hashes=120, bands=FORTY).collect() for k in r.removed}
    assert got == want
    usual = {(r.doc_id, r.th, k) for r in lines.dedup(docs).collect() for k in r.removed}
    assert usual <= want and len(usual) >= 0.95 * len(want)


def test_large_group_and_text(spark):
    base = [f"w{i}" for i in range(120)]
    near = [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in range(100)]
    docs = spark.createDataFrame([(i, f"own line {i * 7919} {i}\n\n{x}", "en") for i, x in enumerate(near)], "doc_id long, text string, removed string")
    out = {r.doc_id: r.text for r in lines.deduped(docs).collect()}
    assert out[0].endswith(near[0]) and all(out[i].endswith("\n") and "changed" not in out[i] for i in range(1, 100))
    assert lines.deduped(docs).columns == docs.columns
    rows = {r.doc_id: (r.n_lines, r.n_removed, list(r.removed)) for r in lines.line_dedup(docs).collect()}
    assert rows[0] == (2, 0, []) and rows[5] == (2, 1, [2])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lines.line_dedup(docs).count() == 0 and lines.deduped(docs).count() == 0


def test_stage_keeps_rows_and_columns_of_any_name(spark):
    """Null ids and texts, repeated rows, and columns named like those that a stage makes."""
    line = " ".join(f"w{i}" for i in range(40))
    rows = [(None, line, 1), (1, line, 2), (1, line, 2), (2, None, 3), (3, "", 4), (4, line + "\nother line", 5)]
    names = ["_d", "_t", "_removed", "_own0", "_OWN1", "th", "removed", "lid", "line", "a.b"]
    docs = spark.createDataFrame([(*r, *[r[2]] * len(names)) for r in rows], ["doc_id", "text", "n_chars", *names])
    out = lines.stage(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted((tuple(r) for r in out.collect()), key=lambda r: r[2])
    assert [r[:3] for r in got] == [(None, line, 1), (1, "", 2), (1, "", 2), (2, None, 3), (3, "", 4), (4, "other line", 5)]
    assert all(set(r[3:]) == {r[2]} for r in got)
