"""The rounds of leaders."""

import random

from quillspark.llm import lines


def test_compared_pairs_are_not_compared_again(spark, monkeypatch):
    """Groups of three lines that share buckets and are not similar: their leaders settle all pairs in the
    first round, so no line is left for the second or the last, and none gets bits."""
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    rows = [passage + text(90) for passage in (text(300) for _ in range(60)) for _ in range(3)]
    made = {}
    real = lines.table

    def table(df, name):
        out = real(df, name)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(lines, "table", table)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert not any(r.n_removed for r in lines.line_dedup(docs).collect())
    assert made["members"][0] > 100 and made["open"][0] > 100
    assert made["open"][1:] == [0, 0] and made["sketches"] == [0]
