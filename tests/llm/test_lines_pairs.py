"""The last round, over pairs of lines of different components."""

import random

from quillspark.llm import lines


def test_pairs_that_cannot_be_similar_are_no_rows(spark, monkeypatch):
    """200 lines that share half of their text and so many buckets: of their 19,900 pairs only the few
    that may be similar are made, each once, and those that are similar are linked."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = text(280)
    rows = [passage + text(120) for _ in range(200)]
    rows += [x[:-20] + text(20) for x in rows[:10]]
    made = {}
    real = lines.table

    def table(df, name):
        out = real(df, name)
        made.setdefault(name, []).append(out.count())
        if name == "members":
            x, y = out.withColumnRenamed("lid", "a"), out.withColumnRenamed("lid", "b")
            made["share"] = x.join(y, "key").where("a < b").select("a", "b").distinct().count()
        if name == "near":
            made["distinct"] = out.select("a", "b").distinct().count()
        return out

    monkeypatch.setattr(lines, "table", table)
    monkeypatch.setattr(lines, "LEADERS", ())
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = {r.doc_id for r in lines.line_dedup(docs).collect() if r.n_removed}
    assert out == set(range(200, 210))
    assert made["share"] > 2000
    assert 10 <= made["near"][0] == made["distinct"] < 50
