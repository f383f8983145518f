"""The flows from end to end: screening by blocks (A) and by parents (B), and evaluation of labelled
turns (C) and of graded answers (D)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asking, blocks, decide, evaluate, ingest, parents, render, scoring, select, stats
from ..operators.question_sets import TURNS_PURPOSE
from ..operators.schema import DIMENSIONS, PAYLOAD_CHARS, QUESTIONS
from ..sources import log, record
from ..sources.tables import written


def prepare(raw: DataFrame, scores: DataFrame | None = None, model: str = "model", strict: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Flow A: (segments with restored, block records). scores: meeting_id, block, question, p
    (and type, error). Without scores everything is kept, as when no filter is asked for. A block
    is kept where an answer is lacking, repeated or not as asked for, and where its request is too
    long to be sent."""
    rows = ingest.normalize(raw, strict)
    if scores is None:
        return rows.withColumns({"kept": F.lit(True), "restored": F.lit(True)}), None
    blocked = written(blocks.greedy_blocks(rows), "blocked")
    records = block_records(blocked, scores, model)
    kept = blocked.join(records.select("meeting_id", "block", F.col("keep").alias("kept")), ["meeting_id", "block"])
    return select.restore_neighbours(kept), records


def block_records(blocked: DataFrame, scores: DataFrame, model: str = "model") -> DataFrame:
    """One record per block: its ids and those about it, payload_chars, a column for each question,
    error, reason, keep."""
    key = ["meeting_id", "block"]
    given = scoring.unit_scores(scores, QUESTIONS, tuple(key))
    error = F.when(F.col("ok").isNull(), "no answer").otherwise(F.coalesce("error", F.when(~F.col("ok"), "invalid answer")))
    records = block_units(blocked, model).drop("payload", "digest", "chars").join(given, key, "left")
    return decide.screening(records.withColumn("error", error).drop("ok"))


def screen_parents(segments: DataFrame, scores: DataFrame) -> dict[str, DataFrame]:
    """Flow B of normalized segments and their scores (meeting_id, id, p, and type, parent_id):
    parents, context, thresholds, judgments, selected, removed, review. A parent with an answer
    that is lacking or not as asked for keeps all of its segments, and none of its scores counts."""
    windows = parents.parent_windows(segments)
    valid = scoring.valid_targets(windows.select("meeting_id", "parent_id", F.explode("target_ids").alias("id")), scores)
    return {"parents": windows, "context": parents.parent_context(segments)} | _judged(segments, valid)


def _judged(segments: DataFrame, valid: DataFrame) -> dict[str, DataFrame]:
    """What follows from valid (meeting_id, id, p), where p is null without a valid answer."""
    thresholds = decide.adaptive_threshold(valid)
    judged = decide.judgments(segments.select("meeting_id", "id"), valid, thresholds)
    selected, removed = select.split(segments, judged)
    return {"thresholds": thresholds, "judgments": judged, "selected": selected, "removed": removed, "review": select.review_frame(segments, judged)}


def review_parents(segments: DataFrame, call: asking.Call, path: str, model: str = "model", failed_too: bool = True, **how) -> dict[str, DataFrame]:
    """Flow B with a scorer, of normalized segments, recorded at path: what screen_parents() gives,
    and log (one row per parent) and stats.

    The first run records its parents and requests; a later one on the same inputs goes on from
    there and asks what has no valid response yet (or, not failed_too, no response at all), and one
    on other inputs raises. Responses are added once all of a run have come. A parent without a valid
    response keeps all of its segments."""
    spark = segments.sparkSession
    asked = written(parent_requests(segments, model), "requests")
    if log.exists(spark, path):
        record.check(spark, path, asked)
    else:
        record.start(spark, path, parents.parent_windows(segments), asked)
    wanted = written(record.still_open(record.answered(spark, path), failed_too), "wanted")
    fresh = written(asking.ask(wanted, call, **how), "responses")
    record.add(spark, path, fresh)
    return recorded(segments, path)


def recorded(segments: DataFrame, path: str) -> dict[str, DataFrame]:
    """The outcome of flow B by the responses that are recorded at path. Nothing is asked."""
    told = written(record.answered(segments.sparkSession, path), "answered")
    targets = told.select("meeting_id", F.explode("asked").alias("id"), "scores")
    valid = written(targets.select("meeting_id", "id", F.try_element_at("scores", "id").alias("p")), "valid")
    calls = told.select("meeting_id", F.col("unit_id").alias("parent_id"), F.size("asked").alias("n_targets"), F.coalesce(F.col("error"), F.when(F.col("responses") == 0, "not_asked")).alias("error"), F.coalesce("attempts", F.array()).alias("attempts"), "elapsed_ms", "input_tokens", "output_tokens", F.col("answered_by").alias("model")).withColumn("failed", F.col("error").isNotNull())
    out = _judged(segments, valid)
    out["judgments"] = written(out["judgments"], "judgments")
    out["selected"], out["removed"] = select.split(segments, out["judgments"])
    out["review"] = select.review_frame(segments, out["judgments"])
    return {"parents": record.units(segments.sparkSession, path), "context": parents.parent_context(segments), "log": calls, "stats": stats.stats_b(segments, out["judgments"], calls)} | out


def texts(segments: DataFrame, kept: DataFrame) -> DataFrame:
    """(meeting_id, name, document): the transcript, what is selected of it, both with the prompt."""
    plain = lambda s, name: _plain(segments, s, name)
    asked = lambda s, name, selected: render.documents(segments, s, selected).select("meeting_id", F.lit(name).alias("name"), "document")
    return plain(segments, "transcript").unionByName(plain(kept, "selected")).unionByName(asked(segments, "full_prompt", False)).unionByName(asked(kept, "selected_prompt", True))


def _plain(segments: DataFrame, some: DataFrame, name: str) -> DataFrame:
    """(meeting_id, name, document) for each meeting of segments: the lines of some of them."""
    rows = segments.select("meeting_id").distinct().join(render.body(some), "meeting_id", "left")
    return rows.select("meeting_id", F.lit(name).alias("name"), F.concat(F.coalesce("body", F.lit("")), F.lit("\n")).alias("document"))


def review_texts(segments: DataFrame, flow: dict[str, DataFrame]) -> DataFrame:
    """(meeting_id, name, document) of what screen_parents() gives: all segments, those selected,
    those removed, and the review of the removed ones."""
    out = _plain(segments, segments, "full")
    for name in ("selected", "removed"):
        out = out.unionByName(_plain(segments, flow[name], name))
    review = render.deletion_review(flow["review"], flow["thresholds"])
    return out.unionByName(review.select("meeting_id", F.lit("deletion_review").alias("name"), F.col("review").alias("document")))


def _json_list(segments: DataFrame, rows: DataFrame, order: list[str], columns: list[str], name: str, key: str | None) -> DataFrame:
    """(meeting_id, name, document): for each meeting of segments the JSON of its rows, in order;
    as an object with a version and `key`, or as a plain list."""
    item = F.struct(*(F.col(c).alias(f"_{i}") for i, c in enumerate(order)), F.struct(*columns).alias("row"))
    one = rows.groupBy("meeting_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["row"]).alias("rows"))
    each = segments.select("meeting_id").distinct().join(one, "meeting_id", "left")
    found = F.coalesce("rows", F.array())
    value = F.to_json(F.struct(F.lit(1).alias("schema_version"), found.alias(key)) if key else found, {"ignoreNullFields": "false"})
    return each.select("meeting_id", F.lit(name).alias("name"), F.concat(value, F.lit("\n")).alias("document"))


def _json_row(rows: DataFrame, name: str) -> DataFrame:
    value = F.to_json(F.struct(*(c for c in rows.columns if c != "meeting_id")), {"ignoreNullFields": "false"})
    return rows.select("meeting_id", F.lit(name).alias("name"), F.concat(value, F.lit("\n")).alias("document"))


SEGMENT_FIELDS, SEGMENT_ORDER = ["start", "end", "text", "source", "uncertain", "id"], ["start", "end", "ordinal"]


def block_outputs(flow: dict[str, DataFrame]) -> DataFrame:
    """JSON documents (meeting_id, name, document) of screen_blocks(): the transcript, what is
    selected of it, the record of each block, and the summary."""
    rows = flow["segments"]
    lists = lambda some, name: _json_list(rows, some, SEGMENT_ORDER, SEGMENT_FIELDS, name, "segments")
    records = flow["records"]
    told = [c for c in records.columns if c not in ("meeting_id", "responded", "chars", "before", "after", "digest")]
    return lists(rows, "transcript").unionByName(lists(rows.where("restored"), "selected")).unionByName(_json_list(rows, records, ["block"], told, "screening", None)).unionByName(_json_row(flow["stats"], "stats"))


def parent_outputs(segments: DataFrame, flow: dict[str, DataFrame]) -> DataFrame:
    """JSON documents (meeting_id, name, document) of review_parents(): what is selected and what
    removed, the judgments, the distribution of the scores and its cutoff, and the summary."""
    lists = lambda some, name: _json_list(segments, some, SEGMENT_ORDER, SEGMENT_FIELDS, name, "segments")
    judged = segments.select("meeting_id", "id", *SEGMENT_ORDER).join(flow["judgments"], ["meeting_id", "id"])
    parts = [lists(flow["selected"], "selected"), lists(flow["removed"], "removed"), _json_list(segments, judged, SEGMENT_ORDER, ["id", "p", "candidate_remove", "reason"], "judgments", None), _json_row(flow["thresholds"], "distribution"), _json_row(flow["stats"], "stats")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def evaluate_turns(turns: DataFrame, scores: DataFrame, dimensions: tuple[str, ...], drop: str) -> DataFrame:
    """Flow C: turns (meeting_id, turn_id, text, expected_keep) with scores (meeting_id, turn_id,
    question, p) to sets kept and missed."""
    wide = decide.pivot_scores(scores, ["meeting_id", "turn_id"], dimensions)
    rows = turns.join(wide, ["meeting_id", "turn_id"])
    return evaluate.recall_sets(rows.withColumn("keep", ~decide.drop_rule(drop, [d for d in dimensions if d != drop])))


def turn_requests(turns: DataFrame, model: str, purpose: str) -> DataFrame:
    """One request per meeting, about each of its turns (meeting_id, turn_id, timestamp, speaker, text)
    in each dimension: meeting_id, payload, payload_chars, digest, asked (the questions' ids)."""
    item = F.struct(F.col("turn_id").alias("id"), "speaker", "text", "timestamp")
    one = turns.groupBy("meeting_id").agg(F.collect_list(item).alias("t"))
    ids = F.flatten(F.transform("t", lambda x: F.array(*(F.concat(x["id"], F.lit(f"_{d}")) for d in DIMENSIONS))))
    rows = one.select("meeting_id", scoring.turns_payload(model, purpose, F.col("t")).alias("payload"), ids.alias("asked"))
    return rows.select("meeting_id", "payload", F.length("payload").alias("payload_chars"), scoring.digest(F.col("payload")).alias("digest"), "asked")


def review_turns(turns: DataFrame, call: asking.Call, model: str = "model", purpose: str = TURNS_PURPOSE, **how) -> dict[str, DataFrame]:
    """Flow C with a scorer, of turns with expected_keep: turns (with a score for each dimension, and
    keep), recall (the sets kept and missed), report, and log (a row per meeting). A meeting without a
    valid answer keeps all of its turns."""
    asked = written(turn_requests(turns, model, purpose), "requests")
    by_digest = asked.groupBy("digest").agg(F.first("payload").alias("payload"), F.first("asked").alias("asked"))
    told = written(asking.ask(by_digest, call, **how), "responses").join(by_digest.select("digest", "asked"), "digest")
    told = written(asking.answers(told, F.col("asked")).drop("asked"), "told")
    calls = asked.select("meeting_id", "digest").join(told, "digest")
    rows = turns.join(calls.select("meeting_id", "scores"), "meeting_id")
    rows = rows.withColumns({d: F.try_element_at("scores", F.concat("turn_id", F.lit(f"_{d}"))) for d in DIMENSIONS}).drop("scores")
    rows = written(rows.withColumn("keep", ~decide.drop_rule("nonbusiness", [d for d in DIMENSIONS if d != "nonbusiness"])), "turns")
    return {"turns": rows, "recall": evaluate.recall_sets(rows), "report": render.score_report(rows, DIMENSIONS), "log": calls.drop("scores")}


def evaluate_answers(questions: DataFrame, requests: DataFrame, call: asking.Call, **how) -> dict[str, DataFrame]:
    """Flow D: questions (see evaluate.evaluated) and one request (group_id, payload, digest) for each
    of their groups, asked of call, to answers (a row per question, checked and graded) and summary."""
    told = written(asking.ask(requests.dropDuplicates(["digest"]), call, **how), "responses")
    responses = requests.select("group_id", "digest").join(told, "digest")
    rows = written(evaluate.evaluated(questions, responses), "evaluated")
    return {"answers": rows, "summary": evaluate.evaluation_summary(rows)}


def block_units(blocked: DataFrame, model: str) -> DataFrame:
    """One row per block, with all that is asked or told of it: meeting_id, block, ids, before and
    after (the ids about it), chars, uncertain, payload, payload_chars, digest."""
    item = F.struct("start", "end", "ordinal", "id", scoring.segment_json().alias("json"))
    one = blocked.groupBy("meeting_id", "block").agg(F.array_sort(F.collect_list(item)).alias("o"), F.sum(F.length("text")).alias("chars"), F.bool_or("uncertain").alias("uncertain"))
    ends = one.withColumns({"head": F.slice("o", 1, 2), "tail": F.slice("o", F.greatest(F.size("o") - 1, F.lit(1)), 2)})
    rows = blocks.around(ends, 2, before=("tail", "last"), after=("head", "next"))
    of = lambda c, k: F.transform(c, lambda x: x[k])
    payload = scoring.block_payload(model, of("last", "json"), of("o", "json"), of("next", "json"))
    rows = rows.select("meeting_id", "block", of("o", "id").alias("ids"), of("last", "id").alias("before"), of("next", "id").alias("after"), "chars", "uncertain", payload.alias("payload"))
    return rows.withColumns({"payload_chars": F.length("payload"), "digest": scoring.digest(F.col("payload"))})


def requests(blocked: DataFrame, model: str) -> DataFrame:
    """A request for each block that may be sent: meeting_id, unit_id, payload, payload_chars,
    digest."""
    return sendable(block_units(blocked, model)).select("meeting_id", F.col("block").cast("string").alias("unit_id"), "payload", "payload_chars", "digest")


def sendable(units: DataFrame) -> DataFrame:
    """Units that may be asked about: those without a part that is marked as uncertain, and whose
    whole request is not too long. All others stay, and nothing of them is sent."""
    return units.where(~F.col("uncertain") & (F.col("payload_chars") <= PAYLOAD_CHARS))


def ask_once(units: DataFrame, call: asking.Call, cache: str, asked: tuple[str, ...] = QUESTIONS, **how) -> DataFrame:
    """Answers to units (meeting_id, block, digest, payload): meeting_id, block, cache_hit, and the
    columns of asking.answers().

    What the cache (a log of responses by digest) answers is not asked again; of units with the
    same request the first by meeting_id and block is asked, and its answer goes to all. The calls
    are made here, once, as their result is written before anything reads it. Valid answers are
    added to the cache; a failure is not, so it is asked again another time. Running again after
    a loss adds what is lacking: an answer that the cache holds by then stays as it is."""
    spark, questions = units.sparkSession, F.array(*map(F.lit, asked))
    known = cached(spark, cache)
    first = units.groupBy("digest").agg(F.min(F.struct("meeting_id", "block")).alias("first"), F.first("payload").alias("payload"))
    wanted = first if known is None else first.join(known.select("digest"), "digest", "left_anti")
    wanted = written(wanted, "wanted")
    fresh = written(asking.answers(asking.ask(wanted, call, **how), questions), "responses")
    log.append(spark, cache, {"responses": fresh.where("error is null").select("digest", "body", "attempts", "elapsed_ms")})
    told = fresh.join(wanted.select("digest", "first"), "digest")
    if known is not None:
        held = asking.answers(known.join(first.select("digest"), "digest", "left_semi"), questions).withColumn("first", F.lit(None).cast(wanted.schema["first"].dataType))
        told = told.unionByName(held.select(*told.columns))
    rows = units.select("meeting_id", "block", "digest").join(told, "digest")
    hit = ~F.coalesce((F.col("first.meeting_id") == F.col("meeting_id")) & (F.col("first.block") == F.col("block")), F.lit(False))
    return rows.withColumn("cache_hit", hit & F.col("error").isNull()).drop("first")


def cached(spark: SparkSession, cache: str) -> DataFrame | None:
    """The responses of a cache, one for each digest: the first that was added."""
    held = log.read(spark, cache, "responses")
    if held is None:
        return None
    columns = [c for c in held.columns if c not in ("digest", "added")]
    return held.groupBy("digest").agg(F.min_by(F.struct(*columns), "added").alias("r")).select("digest", "r.*")


def screen_blocks(raw: DataFrame, call: asking.Call, cache: str, model: str = "model", strict: bool = False, **how) -> dict[str, DataFrame]:
    """Flow A with a scorer: segments (with block, kept, restored), records, stats, texts.

    Segments are put into blocks once, and each block's request is made once; both are written
    before they are used. A block with an uncertain part, or whose request is too long, is not
    sent; what the cache holds is not sent; the rest goes to call (see ask_once). A block is dropped
    only for a valid answer that says so."""
    blocked = written(blocks.greedy_blocks(ingest.normalize(raw)), "blocked")
    units = written(block_units(blocked, model), "units")
    told = written(ask_once(sendable(units), call, cache, **how), "told")
    given = told.select("meeting_id", "block", "scores", "error", "cache_hit", "input_tokens", "attempts", "elapsed_ms", "answered_by")
    rows = units.drop("payload").join(given, ["meeting_id", "block"], "left")
    rows = rows.withColumns({q: F.col("scores")[q] for q in QUESTIONS}).drop("scores")
    records = written(decide.screening(rows).withColumn("responded", F.col("reason") == "judged"), "records")
    kept = blocked.join(records.select("meeting_id", "block", F.col("keep").alias("kept")), ["meeting_id", "block"])
    segments = written(select.restore_neighbours(kept), "restored")
    return {"segments": segments, "records": records, "stats": stats.stats_a(segments, records), "texts": texts(segments, segments.where("restored"))}


def parent_requests(segments: DataFrame, model: str) -> DataFrame:
    """One request per parent, about each of its targets: meeting_id, unit_id, payload,
    payload_chars, digest, asked (the targets' ids)."""
    rows = parents.parent_context(segments).join(segments.select("meeting_id", "id", "text"), ["meeting_id", "id"])
    item = F.struct("id", "text")
    one = rows.groupBy("meeting_id", "m").agg(F.collect_list(item).alias("context"), F.collect_list(F.when(F.col("is_target"), item)).alias("targets"))
    rows = one.select("meeting_id", F.format_string("P%02d", F.col("m") + 1).alias("unit_id"), scoring.parent_payload(model, F.col("targets"), F.col("context")).alias("payload"), F.array_sort(F.transform("targets", lambda x: x["id"])).alias("asked"))
    return rows.select("meeting_id", "unit_id", "payload", F.length("payload").alias("payload_chars"), scoring.digest(F.col("payload")).alias("digest"), "asked")
