"""Asking a remote scorer: calls, their attempts, and what of an answer counts.

A call is a function of a payload that gives the status and the body of what came back. Whether a
body is an answer as asked for is decided afterwards, in the plan, from the body as it arrived; so
nothing that a scorer sends can fail a job."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import ship

Call = Callable[[str], tuple[int, str]]
RESPONSES = "digest string, body string, attempts array<struct<status: string, code: int>>, elapsed_ms double"
#: Statuses that are tried again, and seconds before the second and the third attempt.
BUSY, WAITS = (429, 503, 529), (2.0, 4.0)
#: Rows of a result batch.
_ROWS = 64


def attempted(call: Call, payload: str, busy: tuple[int, ...], waits: tuple[float, ...], pause: Callable[[float], None]) -> tuple[str | None, list[dict], float]:
    """Body (null after a failure), attempts, and milliseconds to one decimal."""
    began, attempts = time.perf_counter(), []
    body = None
    for wait in (*waits, None):
        try:
            status, got = call(payload)
            status = int(status)
        except Exception:  # noqa: BLE001  whatever a call raises, the unit has no answer and stays
            attempts.append({"status": "network_or_response_error", "code": None})
            break
        if status == 200:
            attempts.append({"status": "success", "code": None})
            body = got if isinstance(got, str) else None
            break
        attempts.append({"status": "http_error", "code": status})
        if status not in busy or wait is None:
            break
        pause(wait)
    return body, attempts, round((time.perf_counter() - began) * 1000, 1)


def ask(requests: DataFrame, call: Call, tasks: int = 1, at_once: int = 4, busy: tuple[int, ...] = BUSY, waits: tuple[float, ...] = WAITS, pause: Callable[[float], None] | None = None) -> DataFrame:
    """RESPONSES of requests (digest, payload), one row each.

    A task keeps up to at_once calls open and gives their results in the order of its requests; it
    reads no further than that. There are `tasks` tasks, so the whole job has at most
    tasks * at_once calls open. The calls are made whenever the result is computed: write it once
    and read that. A task that is run again asks again, which the digest makes harmless."""
    ship(requests.sparkSession)
    kind = pa.list_(pa.struct([("status", pa.string()), ("code", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(done: list[tuple]) -> pa.RecordBatch:
            digest, body, attempts, elapsed = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(digest, pa.string()), pa.array(body, pa.string()), pa.array(attempts, kind), pa.array(elapsed, pa.float64())], ["digest", "body", "attempts", "elapsed_ms"])

        with ThreadPoolExecutor(at_once) as pool:
            open_calls: deque = deque()
            done: list[tuple] = []
            for b in batches:
                for digest, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if len(open_calls) == at_once:
                        first, job = open_calls.popleft()
                        done.append((first, *job.result()))
                    open_calls.append((digest, pool.submit(attempted, call, payload, busy, waits, pause or time.sleep)))
                    if len(done) == _ROWS:
                        yield rows(done)
                        done = []
            done += [(digest, *job.result()) for digest, job in open_calls]
            if done:
                yield rows(done)

    return requests.select("digest", "payload").repartition(tasks, "digest").mapInArrow(run, RESPONSES)


def _parsed(body: Column) -> Column:
    """A body as a variant if it is one JSON value and nothing more, else null."""
    one = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    return F.when(F.try_variant_get(one, "$[1]", "variant").isNull(), F.try_variant_get(one, "$[0]", "variant"))


def _kind(value: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0), F.lit(""))


def json_number(value: Column) -> Column:
    """A JSON number as a double; true and false are 1 and 0, a string is none."""
    return F.when(_kind(value).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN"), F.try_variant_get(value, "$", "double"))


def answers(responses: DataFrame, asked: Column) -> DataFrame:
    """responses (body, attempts) with scores (question to p), error, input_tokens, output_tokens
    and answered_by, the model.

    scores is null, and error tells why, unless the body is a JSON object whose answers are an
    object of exactly the questions of `asked` (an array), each with type noul and a number noul
    from 0 to 1: http and its status, no_response, not_json, no_answers, question_ids_differ,
    type_differs, not_a_number or out_of_range, the first that applies. Of a response that is no
    answer the last attempt counts as network_or_response_error, and its tokens are not counted.
    Row by row: nothing is shuffled."""
    last = F.get("attempts", F.size("attempts") - 1)
    rows = responses.withColumn("_v", _parsed(F.col("body"))).withColumn("_a", F.try_variant_get("_v", "$.answers", "map<string,variant>"))
    given = F.map_values("_a")
    noul = lambda a: F.try_variant_get(a, "$.noul", "variant")
    typed = lambda a: F.coalesce((_kind(F.try_variant_get(a, "$.type", "variant")) == "STRING") & (F.try_variant_get(a, "$.type", "string") == "noul"), F.lit(False))
    inside = lambda a: F.coalesce((json_number(noul(a)) >= 0) & (json_number(noul(a)) <= 1), F.lit(False))
    error = (
        F.when(last["code"].isNotNull(), F.concat(F.lit("http "), last["code"].cast("string")))
        .when(F.col("body").isNull(), "no_response")
        .when(F.col("_v").isNull(), "not_json")
        .when(F.col("_a").isNull(), "no_answers")
        .when(F.array_sort(F.map_keys("_a")) != F.array_sort(asked), "question_ids_differ")
        .when(~F.forall(given, typed), "type_differs")
        .when(F.exists(given, lambda a: json_number(noul(a)).isNull()), "not_a_number")
        .when(~F.forall(given, inside), "out_of_range")
    )
    rows = rows.withColumn("error", error)
    good = F.col("error").isNull()
    tokens = lambda k: F.when(good, F.coalesce(F.try_variant_get("_v", f"$.usage.{k}", "bigint"), F.lit(0).cast("long")))
    failed = F.concat(F.slice("attempts", 1, F.greatest(F.size("attempts") - 1, F.lit(0))), F.array(F.struct(F.lit("network_or_response_error").alias("status"), F.lit(None).cast("int").alias("code"))))
    return rows.withColumns({
        "scores": F.when(good, F.transform_values("_a", lambda _, a: json_number(noul(a)))),
        "input_tokens": tokens("input_tokens"), "output_tokens": tokens("output_tokens"), "answered_by": F.when(good, F.try_variant_get("_v", "$.model", "string")),
        "attempts": F.when(~good & (last["status"] == "success"), failed).otherwise(F.col("attempts")),
    }).drop("_v", "_a")


def latency(responses: DataFrame) -> DataFrame:
    """One row over all calls: calls, attempts, total_ms (two decimals) and median_ms."""
    return responses.agg(F.count("*").alias("calls"), F.sum(F.size("attempts")).cast("long").alias("attempts"), F.round(F.sum("elapsed_ms"), 2).alias("total_ms"), F.median("elapsed_ms").alias("median_ms"))
