from quillspark.llm import simhash


def test_null_doc_id(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(1, base, "a"), (None, base, "b"), (None, "a text of its own", "c"), (None, "copied without id", "d"), (None, "copied without id", "d"), (None, "COPIED without id", "d"), (None, None, "e"), (None, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = simhash.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.lang for r in out.collect()) == ["a", "c", "d", "e"]
