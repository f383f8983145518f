"""Responses to groups in parts: no group of questions or answers is held in one row."""

import json

from pyspark.sql import functions as F

from quillspark.operators import evaluate
from quillspark.plans import catalog

N = 2000


def body(ids, tokens=5, **more):
    return json.dumps({"answers": {q: {"type": "noul", "noul": 0.9} for q in ids}, "usage": {"input_tokens": tokens, "output_tokens": 1}} | more)


def test_parts_count_together(spark):
    """A large group of two parts, and groups with a part that lacks, repeats or has no answers."""
    large = [f"q{i}" for i in range(N)]
    asked = {"large": large, "whole": ["a"], "twice": ["a", "b"], "lacking": ["a", "b"], "other": ["a", "b"], "broken": ["a"], "lost": ["a"], "none": ["a"], None: ["a"]}
    questions = spark.createDataFrame([(g, "noul", q, [], "true") for g, ids in asked.items() for q in ids], "group_id string, kind string, question_id string, labels array<string>, expected string").withColumn("expected", F.parse_json("expected"))
    told = [
        ("large", body(large[: N // 2]), 10.0), ("large", body(large[N // 2 :]), 30.0), ("whole", body(["a"]), 20.0), ("twice", body(["a", "b"]), 1.0), ("twice", body(["b"]), 1.0), ("lacking", body(["b"]), 1.0),
        ("other", body(["a", "b"]), 1.0), ("other", body(["c"]), 1.0), ("broken", body(["a"]), 1.0), ("broken", "[]", 1.0), ("lost", body(["a"]), 1.0), ("lost", None, 1.0), (None, body(["a"]), 1.0), ("unasked", body(["a"]), 1.0),
    ]
    rows = evaluate.evaluated(questions, spark.createDataFrame(told, "group_id string, body string, elapsed_ms double")).cache()
    got = {}
    for r in rows.collect():
        got.setdefault(r.group_id, []).append(r)
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in asked.items()}
    errors = {None: "no_response", "none": "no_response", "lost": "no_response", "broken": "no_answers", "twice": "question_ids_differ", "lacking": "question_ids_differ", "other": "question_ids_differ", "large": None, "whole": None}
    assert {k: {r.error for r in v} for k, v in got.items()} == {k: {e} for k, e in errors.items()}
    assert {(r.observed, r.value, r.matches_expected, r.input_tokens, r.elapsed_ms) for r in got["large"]} == {("true", 0.9, True, 10, 30.0)}
    s = evaluate.evaluation_summary(rows.where("group_id in ('large', 'whole')")).first()
    assert (s.requests, s.questions, s.errors, s.matches, s.input_tokens, s.output_tokens, s.total_ms) == (2, N + 1, 0, N + 1, 15, 3, 50.0)


def test_no_part_grows_with_the_table(spark):
    sizes = []
    for n in (1, 4):
        orders = spark.range(n * 60_000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 1201).alias("o_custkey"))
        path = catalog.tables.new_path(spark, "orders")
        orders.write.parquet(f"{path}/orders.parquet")
        sizes.append(catalog._answered(spark, path)[1].agg(F.max(F.length("body"))).first()[0])
    assert sizes[1] < 1.2 * sizes[0]
