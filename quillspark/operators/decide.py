"""Rules over scores, and the cutoff that a meeting's own scores suggest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import is_finite
from .schema import CHATTER_AT_LEAST, GAP_OVER_RUNNER_UP, GAP_OVER_TYPICAL, OTHERS_BELOW, PAYLOAD_CHARS, QUESTIONS


def pivot_scores(scores: DataFrame, by: list[str], questions: tuple[str, ...] = QUESTIONS) -> DataFrame:
    """(by, question, p) to a column for each question. The list is given, so one pass does it."""
    return scores.groupBy(*by).pivot("question", list(questions)).agg(F.first("p"))


def drop_rule(chatter: str, others: list[str]) -> Column:
    """Surely chatter and surely nothing else. A missing or NaN score keeps."""
    low = F.lit(True)
    for c in others:
        low = low & ~F.isnan(c) & (F.col(c) < OTHERS_BELOW)
    return F.coalesce(~F.isnan(chatter) & (F.col(chatter) >= CHATTER_AT_LEAST) & low, F.lit(False))


def screening(rows: DataFrame) -> DataFrame:
    """reason and keep of blocks with uncertain, payload_chars, error, and a column for each
    question: the first reason that applies; only a judged block can be dropped."""
    reason = (
        F.when(F.col("uncertain"), "explicit_transcription_uncertainty")
        .when(F.col("payload_chars") > PAYLOAD_CHARS, "oversized_keep_for_review")
        .when(F.col("error").isNotNull(), "service_error_keep_for_review")
        .otherwise("judged")
    )
    return rows.withColumn("reason", reason).withColumn("keep", ~((F.col("reason") == "judged") & drop_rule("chatter", [q for q in QUESTIONS if q != "chatter"])))


def gap_table(scores: DataFrame, by: str = "meeting_id") -> DataFrame:
    """(by, lower, upper, width, rank): gaps between neighbouring different scores, widest first,
    the lower of equals first. Null and non-finite scores are left out."""
    unique = scores.where(is_finite(F.col("p"))).select(by, "p").distinct()
    gaps = unique.withColumn("upper", F.lead("p").over(Window.partitionBy(by).orderBy("p"))).where("upper is not null")
    gaps = gaps.select(by, F.col("p").alias("lower"), "upper", (F.col("upper") - F.col("p")).alias("width"))
    return gaps.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("width"), "lower")))


def adaptive_threshold(scores: DataFrame, by: str = "meeting_id") -> DataFrame:
    """One row per group of scores (by, p): scored, unique_scores, the largest gap, runner_up and
    typical (the median) of the others, threshold, reason.

    The threshold is the middle of the largest gap where that is at least 3 times the typical and
    2 times the next gap, or, if it is the only gap, where there are 3 scores or more. Else it is
    null, and everything stays."""
    total = scores.groupBy(by).agg(F.count_if(is_finite(F.col("p"))).alias("scored"), F.count_distinct(F.when(is_finite(F.col("p")), F.col("p"))).alias("unique_scores"))
    ranked = gap_table(scores, by).withColumn("others", F.count("*").over(Window.partitionBy(by)) - 1)
    at = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    low, high = F.floor((F.col("others") + 1) / 2) + 1, F.floor((F.col("others") + 2) / 2) + 1
    gaps = ranked.groupBy(by).agg(
        at(1, "lower").alias("lower"), at(1, "upper").alias("upper"), at(1, "width").alias("width"), at(2, "width").alias("runner_up"),
        ((F.max(F.when((F.col("others") > 0) & (F.col("rank") == low), F.col("width"))) + F.max(F.when((F.col("others") > 0) & (F.col("rank") == high), F.col("width")))) / 2).alias("typical"),
    )
    rows = total.join(gaps, by, "left")
    single = F.col("unique_scores") == 2
    clear = F.when(single, F.col("scored") >= 3).otherwise((F.col("width") >= GAP_OVER_TYPICAL * F.col("typical")) & (F.col("width") >= GAP_OVER_RUNNER_UP * F.col("runner_up")))
    reason = F.when(F.col("unique_scores") < 2, "fewer_than_two_unique_scores").when(clear, "clear_gap_found").otherwise("no_clearly_isolated_gap")
    rows = rows.withColumn("reason", reason)
    return rows.withColumn("threshold", F.when(F.col("reason") == "clear_gap_found", (F.col("lower") + F.col("upper")) / 2))


def judgments(targets: DataFrame, scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(meeting_id, id, p, candidate_remove, reason) of every target; without a score it stays."""
    rows = targets.join(scores.select("meeting_id", "id", "p"), ["meeting_id", "id"], "left").join(thresholds.select("meeting_id", "threshold"), "meeting_id", "left")
    p, t = F.col("p"), F.col("threshold")
    scored = is_finite(p)
    remove = F.coalesce(scored & (p > t), F.lit(False))
    reason = (
        F.when(~F.coalesce(scored, F.lit(False)), "service_failure_keep")
        .when(t.isNull(), "no_clear_document_gap_keep")
        .when(remove, "above_document_adaptive_threshold")
        .otherwise("below_document_adaptive_threshold_keep")
    )
    return rows.withColumns({"candidate_remove": remove, "reason": reason}).drop("threshold")
