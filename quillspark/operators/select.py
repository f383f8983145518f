"""What stays, what goes, and the rows around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .schema import REVIEW_ROWS


def _order(n: int):
    return Window.partitionBy("meeting_id").orderBy("start", "end", "ordinal").rowsBetween(-n, n)


def restore_neighbours(segments: DataFrame) -> DataFrame:
    """segments with kept, to which restored is added: kept itself or next to a kept one."""
    return segments.withColumn("restored", F.max("kept").over(_order(1)))


def split(segments: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Selected and removed segments."""
    rows = segments.join(judged.select("meeting_id", "id", "candidate_remove"), ["meeting_id", "id"])
    return rows.where("not candidate_remove").drop("candidate_remove"), rows.where("candidate_remove").drop("candidate_remove")


def review_frame(segments: DataFrame, judged: DataFrame, rows: int = REVIEW_ROWS) -> DataFrame:
    """(meeting_id, target_id, p, id, text, is_target, place) for the rows about each removed one."""
    nth = F.row_number().over(Window.partitionBy("meeting_id").orderBy("start", "end", "ordinal"))
    numbered = segments.select("meeting_id", "start", "end", "id", "text", nth.alias("nth"))
    gone = numbered.join(judged.where("candidate_remove").select("meeting_id", "id", "p"), ["meeting_id", "id"])
    about = gone.select("meeting_id", F.col("id").alias("target_id"), F.col("start").alias("target_start"), F.col("end").alias("target_end"), "p", F.col("nth").alias("own"), F.explode(F.sequence(F.greatest(F.col("nth") - rows, F.lit(1)), F.col("nth") + rows)).alias("nth"))
    each = about.join(numbered.select("meeting_id", "nth", "id", "text"), ["meeting_id", "nth"])
    place = F.col("nth") - F.greatest(F.col("own") - rows, F.lit(1))
    return each.select("meeting_id", "target_id", "target_start", "target_end", "p", place.alias("place"), "id", "text", (F.col("nth") == F.col("own")).alias("is_target"))


def output_violations(segments: DataFrame, selected: DataFrame, removed: DataFrame) -> DataFrame:
    """(check, violations): each count must be 0."""
    key = ["meeting_id", "id"]
    both = selected.select(*segments.columns).unionByName(removed.select(*segments.columns))
    checks = {"selected_and_removed": selected.select(*key).intersect(removed.select(*key)), "lost": segments.exceptAll(both), "changed_or_added": both.exceptAll(segments)}
    out = None
    for name, df in checks.items():
        row = df.agg(F.lit(name).alias("check"), F.count("*").alias("violations"))
        out = row if out is None else out.unionByName(row)
    return out
