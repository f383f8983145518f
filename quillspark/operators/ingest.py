"""Validation, defaults, order and numbers of segments; track selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import is_finite, strip
from .schema import DEFAULT_SOURCE, DEFAULT_TRACK


def violations(raw: DataFrame) -> DataFrame:
    """(meeting_id, ordinal, code) of each invalid row: missing, not_finite, negative_start or
    end_before_start, the first that applies. start and end are doubles."""
    s, e = F.col("start"), F.col("end")
    code = (
        F.when(s.isNull() | e.isNull() | F.col("text").isNull(), "missing")
        .when(~is_finite(s) | ~is_finite(e), "not_finite")
        .when(s < 0, "negative_start")
        .when(e < s, "end_before_start")
    )
    return raw.select("meeting_id", "ordinal", code.alias("code")).where("code is not null")


def first_violation(raw: DataFrame) -> DataFrame:
    """The row that a strict run names for each meeting."""
    return violations(raw).groupBy("meeting_id").agg(F.min(F.struct("ordinal", "code")).alias("v")).select("meeting_id", "v.ordinal", "v.code")


def normalize(raw: DataFrame, strict: bool = False) -> DataFrame:
    """meeting_id, ordinal, id, start, end, text, source, uncertain of the meetings whose rows are
    all valid: blank texts go, defaults are set, and ids number the rest by (start, end, input
    order). strict: a meeting with an invalid row, or with no text at all, raises."""
    bad = first_violation(raw).select("meeting_id", F.col("ordinal").alias("_bad"))
    rows = raw.withColumn("text", strip(F.col("text")))
    if strict:
        rows = rows.join(bad, "meeting_id", "left")
        rows = rows.where(F.when(F.col("_bad").isNotNull(), F.raise_error(F.format_string("segment %d is invalid", F.col("_bad") + 1)).cast("boolean")).otherwise(True))
    else:
        rows = rows.join(bad, "meeting_id", "left_anti")
    rows = rows.where(F.length("text") > 0)
    has = lambda c, kind: F.col(c) if c in raw.columns else F.lit(None).cast(kind)
    n = F.row_number().over(Window.partitionBy("meeting_id").orderBy("start", "end", "ordinal"))
    return rows.select("meeting_id", "ordinal", F.format_string("S%05d", n).alias("id"), "start", "end", "text", F.coalesce(has("source", "string"), F.lit(DEFAULT_SOURCE)).alias("source"), F.coalesce(has("uncertain", "boolean"), F.lit(False)).alias("uncertain"))


def empty_meetings(raw: DataFrame) -> DataFrame:
    """Meetings without any text."""
    return raw.groupBy("meeting_id").agg(F.max(F.length(strip(F.coalesce("text", F.lit(""))))).alias("n")).where("n = 0").select("meeting_id")


def track_specs(specs: DataFrame, tracks: int) -> DataFrame:
    """spec ("index:label") to audio_index, label and error: no_label, bad_index, out_of_range or
    duplicate (of media and index), the first that applies."""
    parts = F.split("spec", ":", 2)
    index, label = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    rows = specs.withColumns({"audio_index": F.when(F.trim(index).rlike("^[+-]?[0-9]+$"), F.trim(index).try_cast("int")), "label": strip(label)})
    many = F.count("audio_index").over(Window.partitionBy("media", "audio_index")) > 1
    error = (
        F.when(F.coalesce(F.length("label"), F.lit(0)) == 0, "no_label")
        .when(F.col("audio_index").isNull(), "bad_index")
        .when((F.col("audio_index") < 0) | (F.col("audio_index") >= tracks), "out_of_range")
        .when(many, "duplicate")
    )
    return rows.withColumn("error", error)


def default_specs(probed: DataFrame, specs: DataFrame) -> DataFrame:
    """specs (media, spec), and the first track for each media of probed that has none."""
    rest = probed.select("media").distinct().join(specs, "media", "left_anti")
    return specs.select("media", "spec").unionByName(rest.select("media", F.lit(DEFAULT_TRACK).alias("spec")))


def union_tracks(tracks: list[DataFrame]) -> DataFrame:
    """All tracks of a meeting as one: ordinal counts track by track, in their order."""
    rows = None
    for k, t in enumerate(tracks):
        t = t.withColumn("_track", F.lit(k))
        rows = t if rows is None else rows.unionByName(t)
    w = Window.partitionBy("meeting_id").orderBy("_track", "ordinal")
    return rows.withColumn("ordinal", F.row_number().over(w) - 1).drop("_track")
