import json
import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from quillspark.operators import asking, scoring
from quillspark.operators.schema import QUESTIONS
from quillspark.plans import pipelines
from quillspark.sources import log


def raw(spark, rows, meeting="m", uncertain=()):
    return spark.createDataFrame([(meeting, i, float(a), float(b), t, i in uncertain) for i, (a, b, t) in enumerate(rows)], "meeting_id string, ordinal int, start double, end double, text string, uncertain boolean")


def five(spark, meeting="m", uncertain=()):
    return raw(spark, [(61 * i, 61 * i + 5, f"turn {i}") for i in range(5)], meeting, uncertain)


def chatty(folder, answer=None, wanted="turn 2"):
    """A scorer that leaves a file for each call, and finds all but the wanted turn to be chatter."""

    def call(payload):
        target = json.loads(payload)["state"]["target"]
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write(",".join(s["text"] for s in target))
        if answer is not None:
            return answer(target)
        important = any(s["text"] == wanted for s in target)
        p = {"requirement": 0.01, "action": 0.99 if important else 0.01, "decision": 0.01, "unresolved": 0.01, "chatter": 0.01 if important else 0.99}
        return 200, json.dumps({"answers": {k: {"type": "noul", "noul": v} for k, v in p.items()}, "usage": {"input_tokens": 100}, "model": "m1"})

    return call


def calls(folder):
    return sorted(open(os.path.join(folder, f)).read() for f in os.listdir(folder))


def screened(flow):
    kept = [r.text for r in flow["segments"].where("restored").orderBy("start").collect()]
    return kept, {r.block: r for r in flow["records"].collect()}


def test_neighbours_are_restored_and_a_second_run_sends_nothing(spark, tmp_path):
    cache, seen = str(tmp_path / "cache"), tmp_path / "calls"
    seen.mkdir()
    flow = pipelines.screen_blocks(five(spark), chatty(str(seen)), cache)
    kept, records = screened(flow)
    assert kept == ["turn 1", "turn 2", "turn 3"] and calls(seen) == [f"turn {i}" for i in range(5)]
    assert all(r.reason == "judged" and not r.cache_hit and r.input_tokens == 100 for r in records.values())
    s = flow["stats"].first()
    assert (s.requests, s.input_tokens, s.failed_blocks, s.segments_selected) == (5, 500, 0, 3)
    again = pipelines.screen_blocks(five(spark), chatty(str(seen)), cache)
    assert screened(again)[0] == kept and len(calls(seen)) == 5 and again["stats"].first().requests == 0
    more = pipelines.screen_blocks(five(spark).unionByName(raw(spark, [(0, 5, "new")], "n")), chatty(str(seen)), cache)
    assert calls(seen)[:1] == ["new"] and len(calls(seen)) == 6 and more["records"].where("cache_hit").count() == 5


def test_uncertain_and_oversized_blocks_are_never_sent(spark, tmp_path):
    seen = tmp_path / "calls"
    seen.mkdir()
    rows = [(0, 5, "fifteen or fifty"), (61, 65, "turn 1"), (200, 210, "long " * 3600), (400, 410, "turn 3"), (600, 610, "turn 4")]
    kept, records = screened(pipelines.screen_blocks(raw(spark, rows, uncertain={0}), chatty(str(seen)), str(tmp_path / "cache")))
    assert calls(seen) == ["turn 4"], "two neighbours carry the long text as well"
    assert [records[b].reason for b in range(1, 6)] == ["explicit_transcription_uncertainty", "oversized_keep_for_review", "oversized_keep_for_review", "oversized_keep_for_review", "judged"]
    assert len(kept) == 5 and not records[5].keep, "the last is next to one that stays"
    asked = pipelines.requests(pipelines.blocks.greedy_blocks(pipelines.ingest.normalize(raw(spark, rows, uncertain={0}))), "model")
    assert [r.unit_id for r in asked.collect()] == ["5"]


BAD = ["not json", "[]", "null", "{}", '{"answers": 1}', '{"answers": {}}', '{"scores": "oops"}', None, 5, "status", "raises"]


def test_whatever_comes_back_keeps_its_text(spark, tmp_path):
    """A block for each kind of answer, one with a good one last."""
    seen = tmp_path / "calls"
    seen.mkdir()

    def answer(target):
        bad = [*BAD, json.dumps({"answers": {q: {"type": "noul", "noul": 0.5} for q in QUESTIONS}})][int(target[0]["text"].split()[-1])]
        if bad == "raises":
            raise OSError("no network")
        return (529, "") if bad == "status" else (200, bad)

    cache, n = str(tmp_path / "cache"), len(BAD)
    rows = raw(spark, [(61 * i, 61 * i + 5, f"Deliver on Friday {i}") for i in range(n + 1)])
    kept, records = screened(pipelines.screen_blocks(rows, chatty(str(seen), answer), cache, pause=lambda s: None))
    assert len(kept) == n + 1 and [records[b].reason for b in range(1, n + 2)] == ["service_error_keep_for_review"] * n + ["judged"]
    assert len(calls(seen)) == n + 1 + 2, "only the busy status was tried again, twice"
    assert pipelines.cached(spark, cache).count() == 1, "a failure is asked again another time"


def test_the_row_scorer_takes_any_shape(spark):
    scores = ["oops", None, 3, ["a"], {"action": "high"}, {"action": None}, {"action": "0.5"}]
    shapes = [{"status": 200, "scores": x} for x in scores] + [{"status": 200, "scores": {"action": 0.5}, "input_tokens": "many"}, "no dict", None, {"status": None}]
    requests = spark.createDataFrame([("m", str(i), f"d{i}", str(i)) for i in range(len(shapes))], "meeting_id string, unit_id string, digest string, payload string")
    got = scoring.run_scorer(requests, scoring.retrying(lambda payload: shapes[int(payload)], sleep=lambda s: None)).collect()
    assert sorted(int(r.unit_id) for r in got) == list(range(len(shapes))) and all(r.p is None and r.error for r in got)


def test_the_same_request_is_asked_once(spark, tmp_path):
    seen = tmp_path / "calls"
    seen.mkdir()
    both = five(spark, "a").unionByName(five(spark, "b")).unionByName(five(spark, "c"))
    flow = pipelines.screen_blocks(both, chatty(str(seen)), str(tmp_path / "cache"))
    assert len(calls(seen)) == 5
    assert {(r.meeting_id, r.cache_hit) for r in flow["records"].collect()} == {("a", False), ("b", True), ("c", True)}
    assert flow["segments"].where("restored").count() == 9


@pytest.mark.parametrize("tasks, at_once", [(1, 4), (2, 3), (1, 1)])
def test_calls_open_at_a_time_and_order(spark, tmp_path, tasks, at_once):
    folder = str(tmp_path)

    def call(payload):
        name = os.path.join(folder, "open-" + payload)
        open(name, "w").close()
        n = sum(f.startswith("open-") for f in os.listdir(folder))
        open(os.path.join(folder, f"seen-{n}-{payload}"), "w").close()
        time.sleep(0.02 + 0.03 * (int(payload) % 3))
        os.remove(name)
        return 200, payload

    rows = spark.createDataFrame([(f"d{i}", str(i)) for i in range(40)], "digest string, payload string").coalesce(1)
    got = asking.ask(rows, call, tasks, at_once).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(int(r.body) for r in got) == list(range(40))
    most = max(int(f.split("-")[1]) for f in os.listdir(folder) if f.startswith("seen-"))
    assert at_once <= most <= tasks * at_once
    for t in {r.task for r in got}:
        own = [int(r.body) for r in got if r.task == t]
        assert own == sorted(own)
    assert all(r.elapsed_ms >= 20 and round(r.elapsed_ms, 1) == r.elapsed_ms and [a.status for a in r.attempts] == ["success"] for r in got)


def test_attempts_and_latency(spark):
    def call(payload):
        import random

        if payload == "busy":
            return 429, ""
        if payload == "refused":
            return 401, ""
        if payload == "odd":
            return "x", random.random()
        return 200, "{}"

    waits = []
    assert asking.attempted(call, "busy", asking.BUSY, asking.WAITS, waits.append)[1] == [{"status": "http_error", "code": 429}] * 3 and waits == [2.0, 4.0]
    rows = spark.createDataFrame([(p, p) for p in ("busy", "refused", "odd", "fine")], "digest string, payload string")
    got = asking.ask(rows, call, pause=lambda s: None)
    tried = {r.digest: [(a.status, a.code) for a in r.attempts] for r in got.collect()}
    assert tried == {"busy": [("http_error", 429)] * 3, "refused": [("http_error", 401)], "odd": [("network_or_response_error", None)], "fine": [("success", None)]}
    told = {r.digest: r for r in asking.answers(got, F.array(*map(F.lit, QUESTIONS))).collect()}
    assert {k: r.error for k, r in told.items()} == {"busy": "http 429", "refused": "http 401", "odd": "no_response", "fine": "no_answers"}
    assert told["fine"].attempts[0].status == "network_or_response_error" and told["fine"].input_tokens is None
    fixed = spark.createDataFrame([([{"status": "success", "code": None}] * n, ms) for n, ms in ((1, 10.1), (3, 30.3), (1, 20.2), (2, 1.15))], "attempts array<struct<status: string, code: int>>, elapsed_ms double")
    r = asking.latency(fixed).first()
    assert (r.calls, r.attempts, r.total_ms) == (4, 7, 61.75) and abs(r.median_ms - 15.15) < 1e-9


def test_log_is_whole_or_absent(spark, tmp_path):
    path = str(tmp_path / "log")
    one = spark.createDataFrame([(1, "a")], "x int, s string")
    assert log.read(spark, path, "t") is None and not log.exists(spark, path)
    broken = one.withColumn("s", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        log.append(spark, path, {"t": one, "u": broken}, first=True)
    assert log.read(spark, path, "t") is None and os.listdir(f"{path}/data") == [], "the half that was written is gone"
    os.makedirs(f"{path}/data/left-behind/t")  # what a killed writer leaves
    log.append(spark, path, {"t": one, "u": one}, first=True)
    with pytest.raises(FileExistsError):
        log.append(spark, path, {"t": one}, first=True)
    log.append(spark, path, {"t": one.withColumn("x", F.lit(2))})
    assert [(r.x, r.s) for r in log.read(spark, path, "t").orderBy("added").collect()] == [(1, "a"), (2, "a")]
    assert log.read(spark, path, "u").count() == 1 and log.read(spark, path, "v") is None


def test_first_answer_of_a_digest_stays(spark, tmp_path):
    path = str(tmp_path / "cache")
    kind = "digest string, body string, attempts array<struct<status: string, code: int>>, elapsed_ms double"
    for body in ("old", "new"):
        log.append(spark, path, {"responses": spark.createDataFrame([("d", body, [], 1.0)], kind)})
    assert [(r.digest, r.body) for r in pipelines.cached(spark, path).collect()] == [("d", "old")]


def test_long_meeting_is_folded_batch_by_batch(spark):
    """Blocks of a meeting of many Arrow batches are those of the plain fold."""
    from quillspark.operators import blocks

    n = 60_000
    rows = spark.range(n).select(F.lit("m").alias("meeting_id"), F.col("id").cast("int").alias("ordinal"), F.format_string("S%05d", F.col("id") + 1).alias("id"), (F.col("id") * 1.5).alias("start"), (F.col("id") * 1.5 + F.col("id") % 7).alias("end"), F.repeat(F.lit("x"), (F.pmod(F.xxhash64("id"), F.lit(90)) + 1).cast("int")).alias("text")).repartition(7)
    got = {r.ordinal: r.block for r in blocks.greedy_blocks(rows).select("ordinal", "block").collect()}
    block, chars, first = 0, 0, 0.0
    for r in sorted(rows.collect(), key=lambda r: r.ordinal):
        if not block or chars + len(r.text) > 1400 or r.end - first > 60:
            block, chars, first = block + 1, 0, r.start
        chars += len(r.text)
        assert got[r.ordinal] == block
    assert len(got) == n and block > 1000
