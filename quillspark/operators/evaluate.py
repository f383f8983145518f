"""Evaluation: sets kept against sets expected, and graded answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_finite, word_count
from .asking import json_number
from .schema import TOKEN_PRICE_PER_MILLION, YES_AT_LEAST


def question_fanout(turns: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Each turn with each dimension; the few dimensions are literals, so nothing is joined."""
    return turns.select("*", F.explode(F.array(*map(F.lit, dimensions))).alias("dimension")).withColumn("question_id", F.concat_ws("_", "turn_id", "dimension"))


def label_turns(turns: DataFrame, must_keep: DataFrame) -> DataFrame:
    """turns with expected_keep: whether must_keep (meeting_id, turn_id; repeats count once) has them."""
    marks = must_keep.select("meeting_id", "turn_id").distinct().withColumn("expected_keep", F.lit(True))
    return turns.join(marks, ["meeting_id", "turn_id"], "left").withColumn("expected_keep", F.coalesce("expected_keep", F.lit(False)))


def recall_sets(turns: DataFrame) -> DataFrame:
    """Of turns with keep and expected_keep, per meeting: retained, missed and unnecessary turn
    ids, sorted and joined by commas, with their counts, and words before and after."""
    ids = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("turn_id"))))
    k, e, n = F.col("keep"), F.col("expected_keep"), word_count(F.col("text"), ascii_only=True)
    rows = turns.groupBy("meeting_id").agg(
        F.count_if(e).alias("expected"), ids(k & e).alias("retained"), ids(e & ~k).alias("missed"), ids(k & ~e).alias("unnecessary"),
        F.sum(n).alias("source_words"), F.sum(F.when(k, n).otherwise(0)).alias("kept_words"),
    )
    out = rows.withColumns({f"n_{c}": F.size(c).cast("long") for c in ("retained", "missed", "unnecessary")})
    out = out.withColumns({c: F.array_join(c, ",") for c in ("retained", "missed", "unnecessary")})
    return out.withColumn("word_reduction", 1 - F.try_divide(F.col("kept_words"), F.col("source_words")))


def answer_error(kind: Column) -> Column:
    """Why an answer (columns type, noul, choice, score, confidence, probabilities) to a question with
    labels cannot be graded as one of its kind, or null."""
    p, keys = F.map_values("probabilities"), F.map_keys("probabilities")
    inside = lambda c: is_finite(c) & (c >= 0) & (c <= 1)
    no = lambda c: ~F.coalesce(c, F.lit(False))
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    mean = F.aggregate(F.map_entries("probabilities"), F.lit(0.0), lambda s, x: s + x["key"].cast("double") * x["value"])
    noul, choice = kind == "noul", kind == "choice"
    return (
        F.when(no(F.col("type") == kind), "type_differs")
        .when(noul, F.when(no(inside(F.col("noul"))), "noul_out_of_range"))
        .when(no(F.forall(p, inside)), "probability_out_of_range")
        .when(F.abs(total - 1) > 0.02, "probabilities_do_not_sum_to_1")
        .when(no(inside(F.col("confidence"))), "confidence_out_of_range")
        .when((F.size(F.array_except(keys, "labels")) > 0) | (F.size(F.array_except("labels", keys)) > 0), "labels_differ")
        .when(choice, F.when(F.coalesce(F.try_element_at("probabilities", "choice"), F.lit(-1.0)) < F.array_max(p) - 1e-6, "choice_is_not_the_most_likely"))
        .when(no((F.col("score") >= 0) & (F.col("score") <= F.size("labels") - 1)), "score_out_of_range")
        .when(F.abs(F.col("score") - mean) > 0.03, "score_is_not_the_mean")
    )


def answer_errors(expected: DataFrame, answers: DataFrame, kind: str) -> DataFrame:
    """(group_id, question_id, error) of answers that cannot be graded; answers: group_id,
    question_id, type, noul, choice, score, confidence, probabilities (level or label to p).
    expected: group_id, question_id, labels (an array; the levels of a score as strings)."""
    e = expected.select("group_id", "question_id", "labels", F.lit(True).alias("asked"))
    rows = e.join(answers.withColumn("given", F.lit(True)), ["group_id", "question_id"], "full")
    error = F.when(F.col("asked").isNull() | F.col("given").isNull(), "question_ids_differ").otherwise(answer_error(F.lit(kind)))
    return rows.select("group_id", "question_id", error.alias("error")).where("error is not null")


def observed(kind: Column) -> tuple[Column, Column]:
    """What an answer says, as a string, and the number that goes with it. A score's level is the
    most likely one, the lowest of equals."""
    best = F.array_sort(F.transform(F.map_entries("probabilities"), lambda x: F.struct((-x["value"]).alias("p"), x["key"].try_cast("int").alias("level"))))
    says = F.when(kind == "noul", (F.col("noul") >= YES_AT_LEAST).cast("string")).when(kind == "choice", F.col("choice")).otherwise(F.get(best, F.lit(0))["level"].cast("string"))
    value = F.when(kind == "noul", F.col("noul")).when(kind == "choice", F.try_element_at("probabilities", "choice")).otherwise(F.col("score"))
    return says, value


def grade(expected: DataFrame, answers: DataFrame, kind: str) -> DataFrame:
    """(group_id, question_id, expected, observed, value, matches_expected); expected and observed
    are strings."""
    rows = expected.select("group_id", "question_id", F.col("expected").cast("string").alias("expected")).join(answers, ["group_id", "question_id"])
    says, value = observed(F.lit(kind))
    rows = rows.withColumns({"observed": says, "value": value})
    return rows.select("group_id", "question_id", "expected", "observed", "value", (F.col("observed") == F.col("expected")).alias("matches_expected"))


def evaluated(questions: DataFrame, responses: DataFrame) -> DataFrame:
    """One row per question of questions (group_id, kind, question_id, labels, expected: a variant), as
    responses (group_id, body, elapsed_ms) answer it: group_id, kind, question_id, error, expected,
    observed, value, matches_expected, and, of its group, input_tokens, output_tokens and elapsed_ms.

    The response to a group may come in parts, a row for each: their answers and tokens count
    together, and the group's time is that of its last part. Questions of all kinds are checked and
    graded in one pass, each by its own id, so no group is gathered. A group without a response, or
    of which a body is lacking or is no object with answers, or whose answers are not those of its
    questions, has that error in each of them; an answer with an error is not graded."""
    told = responses.select("group_id", "body", "elapsed_ms", F.try_parse_json("body").alias("v")).withColumn("answers", F.try_variant_get("v", "$.answers", "map<string,variant>"))
    item = F.struct("kind", "labels", F.try_variant_get("expected", "$", "string").alias("expected"))
    asked = questions.select("group_id", "question_id", item.alias("q"), F.lit(None).cast("variant").alias("a"))
    given = told.select("group_id", F.explode("answers").alias("question_id", "a")).select("group_id", "question_id", F.lit(None).cast(asked.schema["q"].dataType).alias("q"), "a")
    pairs = asked.unionByName(given).groupBy("group_id", "question_id").agg(F.collect_list("q").alias("items"), F.collect_list("a").alias("given"))
    differ = pairs.where((F.size("items") != 1) | (F.size("given") != 1)).groupBy("group_id").agg(F.lit(True).alias("differ"))
    tokens = lambda k: F.sum(F.coalesce(F.try_variant_get("v", f"$.usage.{k}", "bigint"), F.lit(0).cast("long"))).alias(k)
    groups = told.groupBy("group_id").agg(F.bool_and(F.col("body").isNotNull()).alias("told"), F.bool_and(F.col("answers").isNotNull()).alias("answered"), F.max("elapsed_ms").alias("elapsed_ms"), tokens("input_tokens"), tokens("output_tokens"))
    rows = pairs.select("group_id", "question_id", F.explode("items").alias("q"), F.get("given", F.lit(0)).alias("a")).select("group_id", "question_id", "q.*", "a").join(groups, "group_id", "left").join(differ, "group_id", "left")
    whole = F.when(~F.coalesce("told", F.lit(False)), "no_response").when(~F.col("answered"), "no_answers").when(F.col("differ"), "question_ids_differ")
    get = lambda k, kind: (json_number(F.try_variant_get("a", f"$.{k}", "variant")) if kind == "double" else F.try_variant_get("a", f"$.{k}", kind)).alias(k)
    none = F.lit(0).cast("long")
    each = rows.select("group_id", "kind", "question_id", "labels", "expected", whole.alias("whole"), *(F.coalesce(c, none).alias(c) for c in ("input_tokens", "output_tokens")), "elapsed_ms", get("type", "string"), get("noul", "double"), get("choice", "string"), get("score", "double"), get("confidence", "double"), get("probabilities", "map<string,double>"))
    kind = F.col("kind")
    says, value = observed(kind)
    each = each.withColumn("error", F.coalesce("whole", answer_error(kind)))
    fine = F.col("error").isNull()
    each = each.withColumns({"observed": F.when(fine, says), "value": F.when(fine, value)})
    return each.select("group_id", "kind", "question_id", "error", "expected", "observed", "value", (F.col("observed") == F.col("expected")).alias("matches_expected"), "input_tokens", "output_tokens", "elapsed_ms")


def evaluation_summary(rows: DataFrame) -> DataFrame:
    """One row of evaluated(): requests, questions, errors, matches, input_tokens, output_tokens, cost,
    total_ms and median_ms."""
    n = F.count("*").alias("questions")
    groups = rows.groupBy("group_id").agg(n, F.count("error").alias("errors"), F.count_if("matches_expected").alias("matches"), *(F.first(c).alias(c) for c in ("input_tokens", "output_tokens", "elapsed_ms")))
    sums = [F.sum(c).cast("long").alias(c) for c in ("questions", "errors", "matches", "input_tokens", "output_tokens")]
    out = groups.agg(F.count("*").alias("requests"), *sums, F.round(F.sum("elapsed_ms"), 2).alias("total_ms"), F.median("elapsed_ms").alias("median_ms"))
    return out.withColumn("cost", F.col("input_tokens") / F.lit(1e6) * TOKEN_PRICE_PER_MILLION)


def grade_summary(graded: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: questions, matches, tokens, cost and median latency of calls (input_tokens, elapsed_ms)."""
    g = graded.agg(F.count("*").alias("questions"), F.sum(F.col("matches_expected").cast("int")).alias("matches"))
    c = calls.agg(F.sum(F.coalesce("input_tokens", F.lit(0))).cast("long").alias("input_tokens"), F.median("elapsed_ms").alias("median_ms"))
    return g.join(c).withColumn("cost", F.col("input_tokens") / F.lit(1e6) * TOKEN_PRICE_PER_MILLION)
