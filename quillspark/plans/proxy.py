"""Segments and scores made of the driver's tables, in DataFrame functions and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def chance(*parts: Column) -> Column:
    """0 to 16777215 from the md5 of parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 6), 16, 10).cast("long")


def raw_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting_id, ordinal, start, end, text, source, h: 15 characters are a second."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    n = F.length("text")
    ec = F.sum(n).over(Window.partitionBy("conv_id").orderBy("turn"))
    fifteen = F.lit(15).cast("double")
    return c.select(F.col("conv_id").alias("meeting_id"), F.col("turn").alias("ordinal"), ((ec - n) / fifteen).alias("start"), (ec / fifteen).alias("end"), "text", F.col("role").alias("source"), chance(F.col("conv_id"), F.col("turn"), F.col("text")).alias("h"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized: with id, uncertain and p as well."""
    n = F.row_number().over(Window.partitionBy("meeting_id").orderBy("start", "end", "ordinal"))
    return raw_segments(spark, sf_dir).select("*", F.format_string("S%05d", n).alias("id"), (F.col("h") % 17 == 0).alias("uncertain"), ((F.col("h") % 1000) / F.lit(1000).cast("double")).alias("p"))


#: The same in DuckDB's SQL, as the views raw and seg.
SQL = """
raw as (select conv_id as meeting_id, turn as ordinal, (ec - length(text)) / cast(15 as double) as s, ec / cast(15 as double) as e, text, role as source,
    ('0x' || substr(md5(concat_ws(':', conv_id, turn, text)), 1, 6))::bigint as h
  from (select *, sum(length(text)) over (partition by conv_id order by turn) as ec from conversations)),
seg as (select *, printf('S%05d', row_number() over (partition by meeting_id order by s, e, ordinal)) as id, h % 17 = 0 as uncertain, (h % 1000) / cast(1000 as double) as p from raw)"""


def block_scores(blocked: DataFrame, questions: tuple[str, ...]) -> DataFrame:
    """(meeting_id, block, question, p) for each block and question."""
    q = F.explode(F.array(*map(F.lit, questions))).alias("question")
    rows = blocked.select("meeting_id", "block").distinct().select("meeting_id", "block", q)
    return rows.withColumn("p", (chance(F.col("question"), F.col("meeting_id"), F.col("block")) % 1000) / F.lit(1000).cast("double"))


def sql_score(question: str, *parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {question}, {', '.join(parts)})), 1, 6))::bigint % 1000) / cast(1000 as double)"


def local_scorer(faults: int = 0, failing: tuple[int, ...] = tuple(range(7))) -> Callable[[str], tuple[int, str]]:
    """A scorer that answers from the digest of a payload alone. Digests fall into `faults` kinds; those
    of the failing kinds fail, each in another way, and with 0 faults none does."""

    def call(payload: str) -> tuple[int, str]:
        import hashlib
        import json

        digest = hashlib.sha256(payload.encode()).hexdigest()
        questions = sorted(json.loads(payload)["questions"])
        kind = int(digest[:2], 16) % faults if faults else -1
        kind = kind if kind in failing else -1
        p = {q: int(hashlib.md5(f"{q}:{digest}".encode()).hexdigest()[:6], 16) % 1000 / 1000 for q in questions}
        if "chatter" in p:
            p = {q: (0.95 if int(digest[2], 16) % 2 == 0 else v) if q == "chatter" else v / 4 for q, v in p.items()}
        answers = {q: {"type": "noul", "noul": v} for q, v in p.items()}
        if kind == 0:
            return 500, "oops"
        if kind == 1:
            return 200, "<html>"
        if kind == 2:
            return 200, json.dumps({"scores": answers})
        if kind == 3:
            answers[questions[0]]["noul"] = "0.5"
        if kind == 4:
            answers["more"] = {"type": "noul", "noul": 0.5}
        if kind == 5:
            answers[questions[-1]]["type"] = "score"
        if kind == 6:
            answers[questions[-1]]["noul"] = 1.5
        return 200, json.dumps({"model": "m1", "answers": answers, "usage": {"input_tokens": len(payload), "output_tokens": 5}})

    return call
