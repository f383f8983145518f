import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(0)
    text = lambda: "\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(4))
    item = " ".join(f"item{i}" for i in range(14))
    clean = [(i, text(), "en", "s", 1) for i in range(40)]
    near = clean[0][1].split("\n")
    rows = clean + [
        (100, "too short", "en", "s", 1),
        (101, "spam spam spam spam spam spam " * 20, "en", "s", 1),
        (102, clean[1][1] + "\n" + clean[2][1].split("\n")[0], "en", "s", 1),
        (103, "\n".join(near), "en", "s", 1),
        (104, text() + "\n" + item, "en", "s", 1),
        (105, None, None, None, None),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        kept.append({r.doc_id: r.text for r in docs.collect()})
    assert set(kept[0]) == set(range(40)) | {102, 103, 104}
    assert set(kept[1]) == set(kept[0]) and kept[1][103] == "" and kept[1][5] == clean[5][1] and kept[1][102] == ""
    assert set(kept[2]) == set(range(40)) | {102, 104}
    assert set(kept[3]) == set(range(40)) | {102}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(kept[3]) and len({r.sequence_id for r in out}) >= 1
