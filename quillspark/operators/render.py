"""Texts made of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clock, python_float, two_decimals
from .schema import FULL_HEADING, NOTHING_SELECTED, PROMPT, REPORT_DROPPED, REPORT_HEAD, REPORT_KEPT, REPORT_MATERIAL, REVIEW_NOTE, REVIEW_TITLE, SELECTED_HEADING


def segment_line() -> Column:
    return F.concat(F.lit("["), F.col("id"), F.lit(" "), clock(F.col("start")), F.lit("–"), clock(F.col("end")), F.lit("] "), F.col("source"), F.lit("\n"), F.col("text"))


def body(segments: DataFrame) -> DataFrame:
    """(meeting_id, body): the lines of a meeting in order, a blank line between two."""
    one = F.array_sort(F.collect_list(F.struct("start", "end", "ordinal", segment_line().alias("line"))))
    return segments.groupBy("meeting_id").agg(one.alias("o")).select("meeting_id", F.array_join(F.transform("o", lambda x: x["line"]), "\n\n").alias("body"))


def documents(meetings: DataFrame, segments: DataFrame, selected: bool) -> DataFrame:
    """(meeting_id, document) for each of meetings: prompt, heading and body. Where nothing is
    selected a sentence says so."""
    rows = meetings.select("meeting_id").distinct().join(body(segments), "meeting_id", "left")
    text = F.coalesce(F.when(F.length("body") > 0, F.col("body")), F.lit(NOTHING_SELECTED if selected else ""))
    return rows.select("meeting_id", F.concat(F.lit(PROMPT + (SELECTED_HEADING if selected else FULL_HEADING) + "\n\n"), text, F.lit("\n")).alias("document"))


def deletion_review(frame: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(meeting_id, review) for each meeting of thresholds: a title, the threshold, and for each
    removed segment a heading and the rows about it."""
    line = F.concat(F.when(F.col("is_target"), "- **候选删除** [").otherwise("- 上下文 ["), F.col("id"), F.lit("] "), F.col("text"))
    one = frame.groupBy("meeting_id", "target_id", "target_start", "target_end", "p").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("o"))
    head = F.concat(F.lit("## "), F.col("target_id"), F.lit(" · "), clock(F.col("target_start")), F.lit("–"), clock(F.col("target_end")), F.lit(" · P(removable)="), two_decimals(F.col("p")))
    part = F.concat(head, F.lit("\n\n"), F.array_join(F.transform("o", lambda x: x["line"]), "\n"), F.lit("\n"))
    rows = one.select("meeting_id", "target_start", "target_end", "target_id", part.alias("part"))
    parts = rows.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("target_start", "target_end", "target_id", "part"))).alias("o"))
    cut = F.coalesce(python_float(F.col("threshold")), F.lit("None"))
    top = F.concat(F.lit(REVIEW_TITLE + "\n\n" + REVIEW_NOTE[0]), cut, F.lit(REVIEW_NOTE[1] + "\n"))
    each = thresholds.select("meeting_id", "threshold").join(parts, "meeting_id", "left")
    return each.select("meeting_id", F.concat_ws("\n", top, F.transform("o", lambda x: x["part"])).alias("review"))


def score_report(turns: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """(meeting_id, report) of turns (meeting_id, turn_id, timestamp, speaker, text, keep, and a
    score for each dimension): a table of the scores, then the lines of the turns that are kept."""
    cells = F.concat_ws(" | ", *(two_decimals(F.col(d)) for d in dimensions))
    row = F.concat(F.lit("| "), F.col("turn_id"), F.when(F.col("keep"), f" | {REPORT_KEPT} | ").otherwise(f" | {REPORT_DROPPED} | "), cells, F.lit(" |"))
    line = F.when(F.col("keep"), F.concat(F.lit("["), F.col("turn_id"), F.lit(" "), F.col("timestamp"), F.lit("] "), F.col("speaker"), F.lit(": "), F.col("text")))
    one = turns.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("turn_id", row.alias("row"), line.alias("line")))).alias("o"))
    part = lambda k: F.filter(F.transform("o", lambda x: x[k]), lambda x: x.isNotNull())
    return one.select("meeting_id", F.concat(F.array_join(F.concat(F.array(F.lit(REPORT_HEAD)), part("row"), F.array(F.lit(""), F.lit(REPORT_MATERIAL), F.lit("")), part("line")), "\n"), F.lit("\n")).alias("report"))
