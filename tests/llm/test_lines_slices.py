"""Large buckets in the last round."""

import random

from quillspark.llm import lines


def test_slices_of_a_bucket_meet_all_of_it(spark, monkeypatch):
    """Each similar pair of a bucket of several slices is found once, and Spark splits no slice, which
    gave tens of thousands of tasks."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = text(280)
    rows = [passage + text(120) for _ in range(80)]
    rows += [x[:-20] + text(20) for x in rows[:10]]
    made = {}
    real = lines.table

    def table(df, name):
        made.setdefault(name, []).append(real(df, name))
        return made[name][-1] if name != "near" else made["near"].append(made["near"][-1].collect()) or real(df, name)

    monkeypatch.setattr(lines, "table", table)
    monkeypatch.setattr(lines, "LEADERS", ())
    monkeypatch.setattr(lines, "SLICE", 16)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.doc_id for r in lines.line_dedup(docs).collect() if r.n_removed} == set(range(80, 90))
    near = made["near"][-1]
    assert len({(r.a, r.b) for r in near}) == len(near) >= 10 and len({r.slice for r in near}) > 1
