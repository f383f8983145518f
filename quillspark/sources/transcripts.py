"""Sources: transcripts, recognizer output, media descriptions; a sink that never overwrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import number, strip
from ..operators.schema import ASR, PROBE, SAID


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One row per segment of each JSON transcript: meeting_id (its file), ordinal, the segment's
    fields, and sha256 of the file. A file without segments, or that is no JSON object, raises."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("meeting_id"), F.sha2("content", 256).alias("sha256"), F.from_json(F.decode("content", "UTF-8"), SAID).alias("doc"))
    segments = F.when(F.col("doc.segments").isNull(), F.raise_error(F.concat(F.lit("no segments in "), F.col("meeting_id")))).otherwise(F.col("doc.segments"))
    return files.select("meeting_id", "sha256", F.posexplode(segments).alias("ordinal", "s")).select("meeting_id", "sha256", "ordinal", "s.*").withColumns({c: number(F.col(c)) for c in ("start", "end")})


def read_asr(spark: SparkSession, path: str) -> DataFrame:
    """meeting_id and transcription of each recognizer output."""
    return spark.read.schema(ASR).option("multiLine", True).json(path).select(F.input_file_name().alias("meeting_id"), "transcription")


def parse_asr(raw: DataFrame, source: str | Column) -> DataFrame:
    """meeting_id, ordinal, start, end (seconds), text, source of the parts that have text. A part
    without both offsets raises, blank or not; no transcription is no rows."""
    source = F.lit(source) if isinstance(source, str) else source
    part = raw.select("meeting_id", source.alias("source"), F.posexplode("transcription").alias("ordinal", "t"))
    lacks = F.col("t.offsets.from").isNull() | F.col("t.offsets.to").isNull()
    at = lambda k: F.when(lacks, F.raise_error(F.lit("a part has no offsets"))).otherwise(F.col(f"t.offsets.{k}")) / F.lit(1000).cast("double")
    rows = part.select("meeting_id", "ordinal", at("from").alias("start"), at("to").alias("end"), strip(F.coalesce("t.text", F.lit(""))).alias("text"), "source")
    return rows.where((F.length("text") > 0) | F.col("start").isNull())


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROBE).option("multiLine", True).json(path).withColumn("media", F.input_file_name())


def audio_tracks(probes: DataFrame) -> DataFrame:
    """media, duration_seconds, and each audio stream with its number among these."""
    audio = F.filter("streams", lambda s: s["codec_type"] == "audio")
    rows = probes.select("media", F.col("format.duration").alias("duration_seconds"), F.posexplode(audio).alias("audio_index", "s"))
    return rows.select("media", "duration_seconds", "audio_index", F.col("s.index").alias("stream_index"), F.col("s.codec_name").alias("codec"), F.col("s.channels").alias("channels"), F.col("s.sample_rate").alias("sample_rate"), F.col("s.tags").alias("tags"))


def write_new(df: DataFrame, path: str, kind: str = "json", by: tuple[str, ...] = ("meeting_id",)) -> None:
    """Write to a folder that must not exist yet; the committer makes it whole or absent."""
    df.write.mode("errorifexists").partitionBy(*by).format(kind).save(path)
