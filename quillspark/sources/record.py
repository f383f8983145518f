"""The record of a run: its units and requests, added as one, and responses as they come.

A run is there as a whole or not at all (see log). Responses are only ever added; what counts for
a request is the latest valid one, or, while there is none, the latest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asking
from . import log


class OtherInputs(ValueError):
    """What is recorded belongs to other inputs."""


def start(spark: SparkSession, path: str, units: DataFrame, requests: DataFrame) -> None:
    """Record units (without payloads) and requests (meeting_id, unit_id, digest, payload, asked: the
    ids it asks about). A path that holds a record already raises and stays as it is."""
    log.append(spark, path, {"units": units.drop("payload"), "requests": requests.select("meeting_id", "unit_id", "digest", "payload", "asked")}, first=True)


def requests(spark: SparkSession, path: str) -> DataFrame:
    found = log.read(spark, path, "requests")
    if found is None:
        raise FileNotFoundError(f"no run is recorded at {path}")
    return found.drop("added")


def units(spark: SparkSession, path: str) -> DataFrame:
    return log.read(spark, path, "units").drop("added")


def conflicts(spark: SparkSession, path: str, now: DataFrame) -> DataFrame:
    """(meeting_id, unit_id, recorded, digest) of units whose request is not the one recorded, or
    that only one side has."""
    old = requests(spark, path).select("meeting_id", "unit_id", F.col("digest").alias("recorded"))
    rows = old.join(now.select("meeting_id", "unit_id", "digest"), ["meeting_id", "unit_id"], "full")
    return rows.where(~F.col("recorded").eqNullSafe(F.col("digest")))


def check(spark: SparkSession, path: str, now: DataFrame) -> None:
    """Raise where now (meeting_id, unit_id, digest) are not the requests that are recorded."""
    bad = conflicts(spark, path, now).first()
    if bad is not None:
        raise OtherInputs(f"{path} was recorded for other inputs: {bad.meeting_id}, {bad.unit_id}")


def add(spark: SparkSession, path: str, responses: DataFrame) -> None:
    """Add responses (asking.RESPONSES). One to no recorded request raises, and none is added."""
    rows = responses.select("digest", "body", "attempts", "elapsed_ms")
    alien = rows.join(requests(spark, path).select("digest"), "digest", "left_anti").first()
    if alien is not None:
        raise OtherInputs(f"{path} has no request {alien.digest}")
    log.append(spark, path, {"responses": rows})


def answered(spark: SparkSession, path: str) -> DataFrame:
    """Each recorded request (meeting_id, unit_id, digest, payload, asked) with the columns of
    asking.answers() of the response that counts; all of these are null where none has come."""
    asked = requests(spark, path)
    got = log.read(spark, path, "responses")
    if got is None:
        got = spark.createDataFrame([], asking.RESPONSES + ", added string")
    by_digest = asked.groupBy("digest").agg(F.first("asked").alias("asked"))
    told = asking.answers(got.join(by_digest, "digest"), F.col("asked")).drop("asked")
    columns = [c for c in told.columns if c not in ("digest", "added")]
    best = told.groupBy("digest").agg(F.max_by(F.struct(*columns), F.struct(F.col("error").isNull().alias("valid"), "added")).alias("r"), F.count("*").alias("responses"))
    return asked.join(best, "digest", "left").select(*asked.columns, "r.*", F.coalesce("responses", F.lit(0)).alias("responses"))


def still_open(answers: DataFrame, failed_too: bool = True) -> DataFrame:
    """(digest, payload) of what answered() shows to be asked still, each digest once: requests
    without a valid response, or (not failed_too) without any."""
    lacking = F.col("responses") == 0
    if failed_too:
        lacking = lacking | F.col("error").isNotNull()
    return answers.where(lacking).groupBy("digest").agg(F.first("payload").alias("payload"))
