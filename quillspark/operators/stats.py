"""Summaries per meeting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stats_a(segments: DataFrame, records: DataFrame) -> DataFrame:
    """Of segments with restored, and block records with reason, responded, cache_hit and
    input_tokens: totals, characters, share of characters gone, requests, tokens, failures."""
    n = F.length("text")
    text = segments.groupBy("meeting_id").agg(
        F.count("*").alias("segments_total"), F.count_if("restored").alias("segments_selected"),
        F.sum(n).alias("source_characters"), F.sum(F.when(F.col("restored"), n).otherwise(0)).alias("selected_characters"),
    )
    fresh = F.col("responded") & ~F.coalesce("cache_hit", F.lit(False))
    calls = records.groupBy("meeting_id").agg(
        F.count_if(fresh).alias("requests"), F.sum(F.when(fresh, F.coalesce("input_tokens", F.lit(0))).otherwise(0)).cast("long").alias("input_tokens"),
        F.count_if(F.col("reason") == "service_error_keep_for_review").alias("failed_blocks"),
    )
    out = text.join(calls, "meeting_id", "left").na.fill(0, ["requests", "input_tokens", "failed_blocks"])
    return out.withColumn("character_reduction", 1 - F.col("selected_characters") / F.col("source_characters"))


def stats_b(segments: DataFrame, judged: DataFrame, log: DataFrame) -> DataFrame:
    """Of judgments, and a scorer log per parent with failed, attempts (a list), input_tokens, model."""
    n = F.length("text")
    rows = segments.join(judged.select("meeting_id", "id", "candidate_remove"), ["meeting_id", "id"])
    text = rows.groupBy("meeting_id").agg(
        F.count("*").alias("targets"), F.count_if(~F.col("candidate_remove")).alias("kept"), F.count_if("candidate_remove").alias("removed"),
        F.sum(n).alias("original_characters"), F.sum(F.when(F.col("candidate_remove"), n).otherwise(0)).alias("removed_characters"),
    )
    calls = log.groupBy("meeting_id").agg(
        F.count("*").alias("parents"), F.count_if(~F.col("failed")).alias("successes"), F.count_if("failed").alias("failures"), F.sum(F.size("attempts")).alias("attempts"),
        F.sum(F.coalesce("input_tokens", F.lit(0))).cast("long").alias("input_tokens"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"), F.max("n_targets").alias("largest_parent"),
    )
    return text.join(calls, "meeting_id").withColumn("character_reduction", F.col("removed_characters") / F.col("original_characters"))
