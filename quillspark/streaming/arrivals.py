"""Screening of transcripts as they arrive (beyond batch: a meeting is judged when it is whole).

The cutoff needs all scores of a meeting, so a file of one meeting is the unit of arrival; a
micro-batch holds whole meetings and is screened by the batch operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import normalize
from ..operators.schema import TRANSCRIPT


def arriving(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of segments of the transcripts that come into a folder."""
    docs = spark.readStream.schema(TRANSCRIPT).option("multiLine", True).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return docs.select(F.input_file_name().alias("meeting_id"), F.posexplode("segments").alias("ordinal", "s")).select("meeting_id", "ordinal", "s.*").drop("id")


def screen_arrivals(stream: DataFrame, screen: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Normalize and screen each micro-batch; a batch that is run again replaces its own folder."""

    def one(batch: DataFrame, number: int) -> None:
        screen(normalize(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
