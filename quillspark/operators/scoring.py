"""The scorer: the one place where rows may leave the plan.

A scorer is a function of an iterator of pandas frames (meeting_id, unit_id, digest, payload) to
an iterator of frames of SCORES. It must not raise: a unit that cannot be scored has a null p and
an error, and stays. Nothing here opens a connection.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_finite, python_float, python_json
from .question_sets import DIMENSION_TEXTS, TURN_HEAD, TURN_TAIL
from .schema import PARENT_FALSE, PARENT_NOTE, PARENT_QUESTION, PARENT_RULE, PARENT_TRUE, PURPOSE, QUESTION_TEXTS

SCORES = "meeting_id string, unit_id string, digest string, question string, p double, input_tokens long, model string, attempts int, error string"
Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def _literal(value: object) -> Column:
    return F.lit(json.dumps(value, sort_keys=True, ensure_ascii=False))


def _object(*parts: tuple[str, Column]) -> Column:
    """A JSON object of keys, in the given order, and the JSON of their values."""
    out = [x for i, (k, v) in enumerate(parts) for x in (F.lit(("{" if not i else ", ") + json.dumps(k) + ": "), v)]
    return F.concat(*out, F.lit("}"))


def _list(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))


def _keyed(c: Column, key: str, value: Callable[[Column], Column]) -> Column:
    """A JSON object of an array of structs, by ascending key."""
    one = F.transform(F.array_sort(c), lambda x: F.concat(python_json(x[key]), F.lit(": "), value(x)))
    return F.concat(F.lit("{"), F.array_join(one, ", "), F.lit("}"))


def segment_json() -> Column:
    """A normalized segment, keys sorted."""
    flag = F.when(F.col("uncertain"), "true").otherwise("false")
    return _object(("end", python_float(F.col("end"))), ("id", python_json(F.col("id"))), ("source", python_json(F.col("source"))), ("start", python_float(F.col("start"))), ("text", python_json(F.col("text"))), ("uncertain", flag))


def block_payload(model: str, before: Column, target: Column, after: Column) -> Column:
    """JSON of a request about a block, keys sorted. The parts are arrays of segment_json()."""
    questions = {k: {"type": "noul", "instructions": q, "criteria": {"true": yes, "false": no}} for k, (q, yes, no) in QUESTION_TEXTS.items()}
    state = _object(("after", _list(after)), ("before", _list(before)), ("purpose", _literal(PURPOSE)), ("target", _list(target)))
    return _object(("model", _literal(model)), ("questions", _literal(questions)), ("state", state))


def parent_payload(model: str, targets: Column, context: Column) -> Column:
    """JSON of a request about a parent, keys sorted. The parts are arrays of structs (id, text)."""
    asked = lambda x: _object(("question", _literal(PARENT_QUESTION)), ("target_id", python_json(x["id"])), ("target_text", python_json(x["text"])))
    question = lambda x: _object(("criteria", _literal({"true": PARENT_TRUE, "false": PARENT_FALSE})), ("instructions", asked(x)), ("type", _literal("noul")))
    state = _object(("context_note", _literal(PARENT_NOTE)), ("screening_rule", _literal(PARENT_RULE)), ("transcript", _keyed(context, "id", lambda x: python_json(x["text"]))))
    return _object(("model", _literal(model)), ("questions", _keyed(targets, "id", question)), ("state", state))


def turns_payload(model: str, purpose: str, turns: Column) -> Column:
    """JSON of a request about all turns of a meeting, keys sorted. turns: an array of structs (id,
    speaker, text, timestamp); each is asked about in each dimension."""

    def asked(x: Column) -> Column:
        rows = []
        for name, (question, yes, no) in sorted(DIMENSION_TEXTS.items()):
            text = F.concat(F.lit(TURN_HEAD), x["id"], F.lit(f"`. {question} {TURN_TAIL}"))
            value = _object(("criteria", _literal({"true": yes, "false": no})), ("instructions", python_json(text)), ("type", _literal("noul")))
            rows.append(F.struct(F.concat(x["id"], F.lit("_" + name)).alias("id"), value.alias("json")))
        return F.array(*rows)

    told = lambda x: _object(("speaker", python_json(x["speaker"])), ("text", python_json(x["text"])), ("timestamp", python_json(x["timestamp"])))
    state = _object(("meeting_purpose", _literal(purpose)), ("turns", _keyed(turns, "id", told)))
    return _object(("model", _literal(model)), ("questions", _keyed(F.flatten(F.transform(turns, asked)), "id", lambda x: x["json"])), ("state", state))


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def cache_split(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers that the cache (a row per digest and question) holds, and requests that it lacks."""
    known = cache.select("digest").distinct()
    return requests.join(cache, "digest"), requests.join(known, "digest", "left_anti")


def _good(scores: DataFrame) -> Column:
    """Whether a row is an answer as asked for: 0 <= p <= 1, and its type, if told, is noul."""
    p = F.col("p")
    good = F.coalesce(is_finite(p) & (p >= 0) & (p <= 1), F.lit(False))
    return good & F.coalesce(F.col("type") == "noul", F.lit(False)) if "type" in scores.columns else good


def _ok(scores: DataFrame, questions: tuple[str, ...]) -> Column:
    """Over a unit's scores: whether exactly the questions are answered, each once and as asked for."""
    asked = F.array(*map(F.lit, sorted(questions)))
    return F.bool_and(_good(scores)) & (F.array_sort(F.collect_list("question")) == asked)


def valid_scores(scores: DataFrame, questions: tuple[str, ...], by: tuple[str, ...] = ("meeting_id", "unit_id")) -> DataFrame:
    """scores with ok: of its unit, exactly the questions are answered, each once and as asked for."""
    return scores.join(scores.groupBy(*by).agg(_ok(scores, questions).alias("ok")), list(by))


def unit_scores(scores: DataFrame, questions: tuple[str, ...], by: tuple[str, ...]) -> DataFrame:
    """One row per unit: ok as in valid_scores(), error, and a column for each question."""
    told = F.max("error") if "error" in scores.columns else F.lit(None).cast("string")
    each = [F.first(F.when(F.col("question") == q, F.col("p")), ignorenulls=True).alias(q) for q in questions]
    return scores.groupBy(*by).agg(_ok(scores, questions).alias("ok"), told.alias("error"), *each)


def valid_targets(targets: DataFrame, scores: DataFrame) -> DataFrame:
    """(meeting_id, id, p) of targets (meeting_id, parent_id, id). One answer that is lacking,
    repeated or not as asked for rejects all of its parent: p is null. Answers about other
    segments are left out and, where scores has parent_id, reject that parent as well."""
    parts = ["meeting_id", *(["parent_id"] if "parent_id" in scores.columns else []), "id"]
    given = scores.withColumn("good", _good(scores)).groupBy(*parts).agg(F.first("p").alias("p"), F.count("*").alias("n"), F.bool_and("good").alias("good"))
    rows = targets.select("meeting_id", "parent_id", "id").join(given, parts, "left")
    ok = rows.groupBy("meeting_id", "parent_id").agg(F.bool_and(F.coalesce(F.col("good") & (F.col("n") == 1), F.lit(False))).alias("ok"))
    if "parent_id" in parts:
        extra = given.join(targets, parts, "left_anti").select("meeting_id", "parent_id").distinct()
        ok = ok.join(extra.withColumn("extra", F.lit(True)), ["meeting_id", "parent_id"], "left").withColumn("ok", F.col("ok") & F.col("extra").isNull())
    return rows.join(ok, ["meeting_id", "parent_id"]).select("meeting_id", "id", F.when(F.col("ok"), F.col("p")).alias("p"))


def store_answers(cache: DataFrame, answers: DataFrame, questions: tuple[str, ...]) -> DataFrame:
    """The cache with the valid answers of a run added, each digest once; what it held comes first.
    Answers that are not valid are asked for again the next time."""
    fresh = valid_scores(answers, questions, ("digest",)).where("ok").select(*cache.columns)
    return cache.unionByName(fresh.join(cache.select("digest").distinct(), "digest", "left_anti").select(*cache.columns))


def resume_conflicts(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Units whose stored response was made for another request."""
    old = responses.select("meeting_id", "unit_id", F.col("digest").alias("stored")).distinct()
    return requests.join(old, ["meeting_id", "unit_id"]).where("stored <> digest").select("meeting_id", "unit_id")


def _probability(p: object) -> float:
    if not isinstance(p, (int, float)):
        raise TypeError("not a number")
    return float(p)


def retrying(call: Callable[[str], dict], codes: tuple[int, ...] = (429, 503, 529), waits: tuple[float, ...] = (2.0, 4.0), sleep: Callable[[float], None] | None = None) -> Scorer:
    """A scorer of call(payload) -> {status, scores, input_tokens, model}: a busy status is tried
    again after a wait, any other failure is final. A failure is a row without p."""

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        pause = sleep or time.sleep
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                error, got, tries = "", None, 0
                for wait in (*waits, None):
                    tries += 1
                    try:
                        got = call(r.payload)
                        status = got.get("status", 200)
                    except Exception as e:  # a scorer never raises: the unit stays
                        error, got = type(e).__name__, None
                        break
                    if status == 200:
                        break
                    error, got = f"status {status}", None
                    if status not in codes or wait is None:
                        break
                    pause(wait)
                base = (r.meeting_id, r.unit_id, r.digest)
                try:
                    rows += [(*base, str(q), _probability(p), int(got.get("input_tokens") or 0), got.get("model"), tries, None) for q, p in got["scores"].items()] if got is not None else [(*base, None, None, 0, None, tries, error)]
                except Exception as e:  # an answer of another shape is a failure as well
                    rows.append((*base, None, None, 0, None, tries, type(e).__name__))
            yield pd.DataFrame(rows, columns=["meeting_id", "unit_id", "digest", "question", "p", "input_tokens", "model", "attempts", "error"])

    return score


def run_scorer(requests: DataFrame, scorer: Scorer, parallel: int = 4) -> DataFrame:
    """At most `parallel` tasks call the scorer. requests: meeting_id, unit_id, digest, payload."""
    rows = requests.select(F.col("meeting_id").cast("string"), F.col("unit_id").cast("string"), "digest", "payload")
    return rows.repartition(parallel, "digest").mapInPandas(scorer, SCORES)


def table_scores(requests: DataFrame, scores: DataFrame) -> DataFrame:
    """The default scorer: a join with scores that are at hand; a unit without any stays."""
    return requests.join(scores, ["meeting_id", "unit_id"], "left")
