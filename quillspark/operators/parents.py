"""Tumbling parent windows with overlapping context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .schema import CONTEXT_SECONDS, PARENT_SECONDS


def _timed(segments: DataFrame) -> DataFrame:
    return segments.withColumns({"m": F.floor(F.col("start") / PARENT_SECONDS).cast("int"), "duration": F.max("end").over(Window.partitionBy("meeting_id"))})


def parent_windows(segments: DataFrame) -> DataFrame:
    """One row per window that has segments starting in it: m (from 0), parent_id, its core and
    context bounds, and the ids of these segments in order."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "end", "ordinal", "id")))
    rows = _timed(segments).groupBy("meeting_id", "m").agg(F.max("duration").alias("duration"), ordered.alias("o"))
    start = F.col("m") * PARENT_SECONDS
    end = F.least(start + PARENT_SECONDS, F.col("duration"))
    return rows.select(
        "meeting_id", "m", F.format_string("P%02d", F.col("m") + 1).alias("parent_id"), start.alias("core_start"), end.alias("core_end"),
        F.greatest(start - CONTEXT_SECONDS, F.lit(0.0)).alias("context_start"), F.least(start + PARENT_SECONDS + CONTEXT_SECONDS, F.col("duration")).alias("context_end"),
        F.transform("o", lambda x: x["id"]).alias("target_ids"),
    )


def parent_context(segments: DataFrame) -> DataFrame:
    """(meeting_id, m, id, is_target): segments that begin before the context ends and end at or
    after it begins. A range join as an equi-join: a segment is sent to the windows it can reach,
    then the exact bounds decide."""
    t = _timed(segments)
    lo = F.greatest(F.floor((F.col("start") - CONTEXT_SECONDS) / PARENT_SECONDS), F.lit(0))
    hi = F.floor((F.col("end") + CONTEXT_SECONDS) / PARENT_SECONDS)
    near = t.select("meeting_id", "id", "start", "end", F.col("m").alias("own"), F.explode(F.sequence(lo.cast("int"), F.greatest(lo, hi).cast("int"))).alias("m"))
    windows = parent_windows(segments).select("meeting_id", "m", "context_start", "context_end")
    inside = (F.col("start") < F.col("context_end")) & (F.col("end") >= F.col("context_start"))
    return near.join(windows, ["meeting_id", "m"]).where(inside).select("meeting_id", "m", "id", (F.col("own") == F.col("m")).alias("is_target"))


def layout_violations(segments: DataFrame) -> DataFrame:
    """(check, violations): each count must be 0."""
    parents, context = parent_windows(segments), parent_context(segments)
    targets = parents.select("meeting_id", "m", F.explode("target_ids").alias("id"))
    key = ["meeting_id", "id"]
    checks = {
        "segment_without_parent": segments.select(*key).join(targets, key, "left_anti"),
        "segment_in_two_parents": targets.groupBy(*key).count().where("count > 1"),
        "repeated_id": segments.groupBy(*key).count().where("count > 1"),
        "target_outside_context": targets.join(context, ["meeting_id", "m", "id"], "left_anti"),
        "context_without_segment": context.select(*key).join(segments.select(*key), key, "left_anti"),
    }
    out = None
    for name, df in checks.items():
        row = df.agg(F.lit(name).alias("check"), F.count("*").alias("violations"))
        out = row if out is None else out.unionByName(row)
    return out


def request_violations(segments: DataFrame, requests: DataFrame) -> DataFrame:
    """(check, violations) of requests (meeting_id, unit_id, asked: the targets in order, payload)
    against the segments they are about: each count must be 0.

    order_differs: meetings whose segments are not, in order, the targets of their requests, each
    once; text_changed: meetings whose segments' texts are not those asked about. Both sides of a
    meeting are brought to a digest in order and the digests compared. Within a request's payload:
    questions_differ, requests that do not ask about exactly their targets; target_not_in_context,
    targets that the transcript lacks; text_differs, targets whose question holds another text
    than the transcript."""
    v = F.parse_json("payload")
    said = requests.select("meeting_id", "unit_id", "asked", F.try_variant_get(v, "$.questions", "map<string,variant>").alias("q"), F.try_variant_get(v, "$.state.transcript", "map<string,string>").alias("t"))
    text = lambda x: F.try_variant_get(F.try_element_at("q", x), "$.instructions.target_text", "string")
    one = said.select(
        "meeting_id", "unit_id", "asked",
        F.when(F.array_sort(F.map_keys("q")) != F.array_sort("asked"), 1).otherwise(0).alias("questions"),
        F.size(F.filter("asked", lambda x: ~F.map_contains_key("t", x))).alias("outside"),
        F.size(F.filter("asked", lambda x: F.map_contains_key("t", x) & ~text(x).eqNullSafe(F.try_element_at("t", x)))).alias("texts"),
        F.transform("asked", lambda x: F.concat_ws(":", x, F.sha2(F.coalesce(text(x), F.lit("")), 256))).alias("hashes"),
    )
    digest = lambda c: F.sha2(F.array_join(c, ","), 256)
    in_turn = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "unit_id", c))), lambda x: x[c]))
    asked = one.withColumn("turn", F.regexp_extract("unit_id", "([0-9]+)$", 1).cast("int")).groupBy("meeting_id").agg(
        digest(in_turn("asked")).alias("asked"), digest(in_turn("hashes")).alias("asked_text"), F.sum("questions").alias("questions_differ"), F.sum("outside").alias("target_not_in_context"), F.sum("texts").alias("text_differs"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("start", "end", "ordinal", "id", F.concat_ws(":", "id", F.sha2("text", 256)).alias("hash"))))
    there = segments.groupBy("meeting_id").agg(ordered.alias("o")).select("meeting_id", digest(F.transform("o", lambda x: x["id"])).alias("ids"), digest(F.transform("o", lambda x: x["hash"])).alias("text"))
    rows = there.join(asked, "meeting_id", "full")
    checks = {
        "order_differs": F.count_if(~F.col("ids").eqNullSafe(F.col("asked"))), "text_changed": F.count_if(~F.col("text").eqNullSafe(F.col("asked_text"))),
        **{c: F.coalesce(F.sum(c), F.lit(0)).cast("long") for c in ("questions_differ", "target_not_in_context", "text_differs")},
    }
    total = rows.agg(*(n.alias(c) for c, n in checks.items()))
    return total.select(F.inline(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).alias("violations")) for c in checks))))
