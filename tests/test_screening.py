"""Golden cases of the operators."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import blocks, decide, evaluate, ingest, parents, render, scoring, select
from quillspark.operators.schema import DEFAULT_SOURCE, DIMENSIONS, NOTHING_SELECTED, QUESTIONS
from quillspark.plans import pipelines
from quillspark.sources import transcripts
from quillspark.streaming import arrivals

RAW = "meeting_id string, ordinal int, start double, end double, text string, source string, uncertain boolean"


def raw(spark, rows):
    return spark.createDataFrame([("m", i, *r, *[None] * (4 - len(r) + 1)) for i, r in enumerate(rows)], RAW)


def scores(spark, values, meeting="m"):
    return spark.createDataFrame([(meeting, f"S{i + 1:05d}", p) for i, p in enumerate(values)], "meeting_id string, id string, p double")


def test_tracks_in_time_order(spark):
    got = ingest.normalize(raw(spark, [(2.0, 4.0, "b", "me"), (1.0, 3.0, " a　", None)])).orderBy("id").collect()
    assert [(r.id, r.text, r.source, r.uncertain) for r in got] == [("S00001", "a", DEFAULT_SOURCE, False), ("S00002", "b", "me", False)]


@pytest.mark.parametrize(
    "row, code",
    [((-1.0, 2.0, "x"), "negative_start"), ((float("nan"), 2.0, "x"), "not_finite"), ((1.0, float("inf"), "x"), "not_finite"), ((2.0, 1.0, "x"), "end_before_start"), ((1.0, 2.0, None), "missing"), ((1.0, 1.0, "x"), None)],
)
def test_violations(spark, row, code):
    rows = raw(spark, [(0.0, 1.0, "ok"), row])
    assert [(r.ordinal, r.code) for r in ingest.violations(rows).collect()] == ([(1, code)] if code else [])
    assert ingest.normalize(rows).count() == (0 if code else 2)
    if code:
        with pytest.raises(Exception, match="segment 2 is invalid"):
            ingest.normalize(rows, strict=True).collect()


def test_blank_meetings(spark):
    assert ingest.empty_meetings(raw(spark, [(0.0, 1.0, " \t"), (1.0, 2.0, "")])).count() == 1


@pytest.mark.parametrize(
    "values, reason, threshold",
    [
        ([0.03, 0.06, 0.09, 0.15, 0.21, 0.67, 0.72, 0.83, 0.91, 0.96], "clear_gap_found", 0.44),
        ([i / 10 for i in range(1, 10)], "no_clearly_isolated_gap", None),
        ([0.1, 0.1, 0.1, 0.9, 0.9], "clear_gap_found", 0.5),
        ([0.1, 0.9], "no_clearly_isolated_gap", None),
        ([0.5, 0.5], "fewer_than_two_unique_scores", None),
        ([0.2, 0.2, 0.7], "clear_gap_found", 0.45),
        ([None, float("nan"), float("inf")], "fewer_than_two_unique_scores", None),
    ],
)
def test_threshold(spark, values, reason, threshold):
    r = decide.adaptive_threshold(scores(spark, values)).first()
    assert r.reason == reason and (r.threshold is None if threshold is None else abs(r.threshold - threshold) < 1e-12)


def test_threshold_ignores_repeats_and_order(spark):
    v = [0.03, 0.06, 0.09, 0.15, 0.21, 0.67, 0.72]
    a = decide.adaptive_threshold(scores(spark, v)).first()
    b = decide.adaptive_threshold(scores(spark, v[::-1] + v[:3])).first()
    assert (a.threshold, a.reason) == (b.threshold, b.reason)


@pytest.mark.parametrize("p, drop", [((0.02, 0.02, 0.02, 0.02, 0.89), False), ((0.02, 0.02, 0.21, 0.02, 0.99), False), ((0.19, 0.19, 0.19, 0.19, 0.90), True), ((0.02, 0.20, 0.02, 0.02, 0.99), False), ((0.02, float("nan"), 0.02, 0.02, 0.99), False), ((None, 0.0, 0.0, 0.0, 0.99), False)])
def test_drop_rule(spark, p, drop):
    df = spark.createDataFrame([p], ", ".join(f"{q} double" for q in QUESTIONS))
    assert df.select(decide.drop_rule("chatter", list(QUESTIONS[:4]))).first()[0] is drop


def five(spark):
    return raw(spark, [(61.0 * i, 61.0 * i + 5, f"turn {i}") for i in range(5)])


def answers(spark, wanted, error=None):
    rows = [("m", b, q, 0.99 if q == ("requirement" if b - 1 in wanted else "chatter") else 0.01, error) for b in range(1, 6) for q in QUESTIONS]
    return spark.createDataFrame(rows, "meeting_id string, block int, question string, p double, error string")


def test_neighbours_come_back(spark):
    got, records = pipelines.prepare(five(spark), answers(spark, {2}))
    assert [r.text for r in got.where("restored").orderBy("start").collect()] == ["turn 1", "turn 2", "turn 3"]
    assert {r.reason for r in records.collect()} == {"judged"}


def test_failure_keeps_all(spark):
    got, records = pipelines.prepare(five(spark), answers(spark, {2}, error="status 503"))
    assert got.where("restored").count() == 5 and {r.reason for r in records.collect()} == {"service_error_keep_for_review"}
    got, records = pipelines.prepare(five(spark), answers(spark, {2}).where("question <> 'action'"))
    assert got.where("restored").count() == 5 and records.where("keep").count() == 5


@pytest.mark.parametrize("bad", [1.5, -0.1, float("nan"), None, "type", "missing", "twice"])
def test_bad_answers_keep_their_block(spark, bad):
    """All blocks are surely chatter; block 2 has one answer that is not as asked for."""
    rows = []
    for b in range(1, 6):
        for q in QUESTIONS:
            hit = b == 2 and q == "chatter"
            p = 0.99 if q == "chatter" else 0.01
            if hit and bad == "missing":
                continue
            rows += [("m", b, q, bad if hit and not isinstance(bad, str) else p, "score" if hit and bad == "type" else "noul")] * (2 if hit and bad == "twice" else 1)
    given = spark.createDataFrame(rows, "meeting_id string, block int, question string, p double, type string")
    got, records = pipelines.prepare(five(spark), given)
    assert {r.block: r.reason for r in records.collect()} == {b: "service_error_keep_for_review" if b == 2 else "judged" for b in range(1, 6)}
    assert [r.text for r in got.where("restored").orderBy("start").collect()] == ["turn 0", "turn 1", "turn 2"]


def test_size_of_the_whole_request(spark):
    """The gate is on the request: the text, its neighbours, the questions and the JSON around."""
    empty = len(pipelines.requests(blocks.greedy_blocks(ingest.normalize(raw(spark, [(0.0, 1.0, "x")]))), "model").first().payload) - 1
    for n, reason in ((18000 - empty, "judged"), (18001 - empty, "oversized_keep_for_review")):
        given = answers(spark, set()).where("block = 1")
        _, records = pipelines.prepare(raw(spark, [(0.0, 1.0, "x" * n)]), given)
        r = records.first()
        assert (r.payload_chars, r.reason) == (empty + n, reason)


@pytest.mark.parametrize("bad", [1.7, float("nan"), "type", "missing", "twice", "extra"])
def test_a_bad_answer_rejects_its_parent(spark, bad):
    """Five segments a parent, two parents; S00007 is answered badly, so the second keeps all."""
    s = ingest.normalize(raw(spark, [(12.0 * i, 12.0 * i + 5, f"t{i}") for i in range(10)]))
    v = [0.03, 0.06, 0.9, 0.92, 0.05, 0.95, 0.96, 0.97, 0.98, 0.99]
    rows = []
    for i, p in enumerate(v):
        hit = i == 6
        if hit and bad == "missing":
            continue
        rows += [("m", "P01" if i < 5 else "P02", f"S{i + 1:05d}", bad if hit and not isinstance(bad, str) else p, "choice" if hit and bad == "type" else "noul")] * (2 if hit and bad == "twice" else 1)
    if bad == "extra":
        rows.append(("m", "P02", "S00001", 0.5, "noul"))
    out = pipelines.screen_parents(s, spark.createDataFrame(rows, "meeting_id string, parent_id string, id string, p double, type string"))
    reasons = {r.id: r.reason for r in out["judgments"].collect()}
    assert {reasons[f"S{i:05d}"] for i in range(6, 11)} == {"service_failure_keep"}
    assert sorted(r.id for r in out["removed"].collect()) == ["S00003", "S00004"] and out["thresholds"].first().scored == 5


def test_two_decimals_and_json(spark):
    from quillspark.functions import text as T

    values = [i / 1000 for i in range(1001)] + [0.125, 0.375, 1e-9, 2**-8, 0.005, 0.015, 0.995, 1 - 2**-53]
    got = spark.createDataFrame([(x,) for x in values], "p double").select("p", T.two_decimals(F.col("p")).alias("s")).collect()
    assert all(r.s == f"{r.p:.2f}" for r in got)
    strings = ["".join(map(chr, range(33))), 'a"b\\c', "é\u2028\x7f中"]
    got = spark.createDataFrame([(x,) for x in strings], "s string").select("s", T.python_json(F.col("s")).alias("j")).collect()
    assert all(r.j == json.dumps(r.s, ensure_ascii=False) for r in got)
    floats = [0.0, 1.25, 12345678.9, 0.0005, 1e15, 100.0]
    got = spark.createDataFrame([(x,) for x in floats], "x double").select("x", T.python_float(F.col("x")).alias("s")).collect()
    assert all(r.s == repr(r.x) for r in got)


def test_parent_requests_and_cache(spark):
    s = ingest.normalize(raw(spark, [(59.0, 61.0, "a"), (60.0, 63.0, 'b "q"')]))
    got = {r.unit_id: json.loads(r.payload) for r in pipelines.parent_requests(s, "model").collect()}
    assert set(got) == {"P01", "P02"} and list(got["P01"]["questions"]) == ["S00001"]
    assert got["P02"]["state"]["transcript"] == {"S00001": "a", "S00002": 'b "q"'} and got["P02"]["questions"]["S00002"]["instructions"]["target_text"] == 'b "q"'
    kind = "digest string, question string, p double"
    cache = spark.createDataFrame([("d0", "action", 0.1)], kind)
    run = spark.createDataFrame([("d0", "action", 0.9), ("d1", "action", 0.2), ("d2", "action", 1.2)], kind)
    assert sorted(map(tuple, scoring.store_answers(cache, run, ("action",)).collect())) == [("d0", "action", 0.1), ("d1", "action", 0.2)]


def test_texts(spark):
    s = ingest.normalize(five(spark))
    got = {r.name: r.document for r in pipelines.texts(s, s.where("start > 1e9")).collect()}
    assert got["selected"] == "\n" and "没有保留" in got["selected_prompt"] and got["full_prompt"].endswith(got["transcript"])


def test_uncertain_is_kept_unscored(spark):
    rows = five(spark).withColumn("uncertain", F.col("ordinal") == 4)
    _, records = pipelines.prepare(rows, answers(spark, set()))
    assert {r.block: r.reason for r in records.collect()}[5] == "explicit_transcription_uncertainty"


def test_blocks(spark):
    s = ingest.normalize(raw(spark, [(0.0, 1.0, "x" * 1400), (1.0, 2.0, "y"), (2.0, 61.0, "z"), (61.0, 61.5, "q"), (62.0, 63.0, "w" * 3000), (63.0, 64.0, "v")]))
    assert [r.block for r in blocks.greedy_blocks(s).orderBy("id").collect()] == [1, 2, 2, 3, 4, 5]
    c = {r.block: r for r in blocks.block_context(blocks.greedy_blocks(s)).collect()}
    assert c[1].before == [] and c[1].after == ["S00002", "S00003"] and c[3].before == ["S00002", "S00003"] and c[5].after == []


def test_segment_across_the_minute(spark):
    s = ingest.normalize(raw(spark, [(59.0, 61.0, "a"), (60.0, 63.0, "b")]))
    assert [r.target_ids for r in parents.parent_windows(s).orderBy("m").collect()] == [["S00001"], ["S00002"]]
    got = {}
    for r in parents.parent_context(s).collect():
        got.setdefault(r.m, set()).add(r.id)
    assert got == {0: {"S00001", "S00002"}, 1: {"S00001", "S00002"}}
    assert all(r.violations == 0 for r in parents.layout_violations(s).collect())


def test_zero_length_at_the_end_is_reported(spark):
    s = ingest.normalize(raw(spark, [(0.0, 50.0, "a"), (50.0, 50.0, "b")]))
    assert {r.check: r.violations for r in parents.layout_violations(s).collect()}["target_outside_context"] == 1


def test_flow_b(spark):
    """The segment without a score is alone in its parent."""
    s = ingest.normalize(raw(spark, [(i + 60.0 * (i >= 6) + 60.0 * (i > 6), i + 1.0 + 60.0 * (i >= 6) + 60.0 * (i > 6), f"t{i}") for i in range(10)]))
    v = [0.03, 0.06, 0.09, 0.15, 0.21, 0.67, None, 0.83, 0.91, 0.96]
    out = pipelines.screen_parents(s, scores(spark, v))
    assert sorted(r.text for r in out["removed"].collect()) == ["t5", "t7", "t8", "t9"]
    assert {r.id: r.reason for r in out["judgments"].collect()}["S00007"] == "service_failure_keep"
    assert all(r.violations == 0 for r in select.output_violations(s, out["selected"], out["removed"]).collect())
    review = render.deletion_review(out["review"], out["thresholds"]).first().review
    assert "\n\n## S00006 · 00:00:05–00:00:06 · P(removable)=0.67\n\n- 上下文 [S00002] t1\n" in review and "- **候选删除** [S00006] t5" in review and review.startswith("# ")


def test_render(spark):
    s = ingest.normalize(raw(spark, [(15.0, 19.0, "hello"), (359999.5, 360000.9, "late")]))
    text = render.documents(s, s, True).first().document
    assert f"[S00001 00:00:15–00:00:19] {DEFAULT_SOURCE}\nhello\n\n[S00002 99:59:59–100:00:00]" in text and text.endswith("late\n")
    assert NOTHING_SELECTED in render.documents(s, s.where("false"), True).first().document


def test_functions(spark):
    row = spark.createDataFrame([("　 é it's well-known \x1c", "1_000", "0x1p3", "key=abc abc")], "a string, b string, c string, d string")
    r = row.select(T.strip(F.col("a")), T.word_count(F.col("a")), T.number(F.col("b")), T.number(F.col("c")), T.redact(F.col("d"), F.lit("abc")), T.python_json(F.lit('q"\\\n'))).first()
    assert tuple(r) == ("é it's well-known", 3, 1000.0, None, "key=[REDACTED] [REDACTED]", '"q\\"\\\\\\n"')


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"schema_version": 1, "segments": [{"start": 1, "end": 2.5, "text": "一", "extra": 5}]}, ensure_ascii=False), encoding="utf-8")
    got = transcripts.read_transcripts(spark, str(tmp_path / "a.json")).collect()
    assert [(r.ordinal, r.start, r.end, r.text) for r in got] == [(0, 1.0, 2.5, "一")] and len(got[0].sha256) == 64
    (tmp_path / "b.json").write_text("{}")
    with pytest.raises(Exception, match="no segments"):
        transcripts.read_transcripts(spark, str(tmp_path / "b.json")).collect()
    (tmp_path / "asr").mkdir()
    (tmp_path / "asr" / "x.json").write_text(json.dumps({"transcription": [{"offsets": {"from": 1250, "to": 3800}, "text": " Do not ship on Friday. "}, {"offsets": {"from": 1, "to": 2}, "text": " "}]}))
    r = transcripts.parse_asr(transcripts.read_asr(spark, str(tmp_path / "asr")), "remote").collect()
    assert [(x.start, x.end, x.text, x.source) for x in r] == [(1.25, 3.8, "Do not ship on Friday.", "remote")]
    (tmp_path / "asr" / "x.json").write_text(json.dumps({"transcription": [{"offsets": {"from": 1}, "text": ""}]}))
    with pytest.raises(Exception, match="no offsets"):
        transcripts.parse_asr(transcripts.read_asr(spark, str(tmp_path / "asr")), "remote").collect()
    out = str(tmp_path / "out")
    transcripts.write_new(spark.createDataFrame([("m", 1)], "meeting_id string, x int"), out)
    with pytest.raises(Exception, match="(?i)exist"):
        transcripts.write_new(spark.createDataFrame([("m", 2)], "meeting_id string, x int"), out)
    assert spark.read.json(out).first().x == 1


def test_scorer(spark):
    requests = spark.createDataFrame([("m", str(i), f"d{i}", f"p{i}") for i in range(4)], "meeting_id string, unit_id string, digest string, payload string")

    def call(payload):
        if payload == "p1":
            return {"status": 400}
        if payload == "p2":
            return {"status": 503}
        if payload == "p3":
            raise RuntimeError("no")
        return {"status": 200, "scores": {"action": 0.5}, "input_tokens": 7, "model": "m1"}

    got = {r.unit_id: r for r in scoring.run_scorer(requests, scoring.retrying(call, sleep=lambda s: None)).collect()}
    assert (got["0"].p, got["0"].attempts, got["1"].attempts, got["1"].error, got["2"].attempts, got["2"].error, got["3"].error) == (0.5, 1, 1, "status 400", 3, "status 503", "RuntimeError")
    assert all(got[k].p is None for k in "123")
    ok = scoring.valid_scores(scoring.run_scorer(requests, scoring.retrying(call, sleep=lambda s: None)), ("action",))
    assert {r.unit_id: r.ok for r in ok.collect()} == {"0": True, "1": False, "2": False, "3": False}
    hit, miss = scoring.cache_split(requests, spark.createDataFrame([("d1", 0.1)], "digest string, p double"))
    assert hit.count() == 1 and miss.count() == 3
    stored = spark.createDataFrame([("m", "0", "other"), ("m", "1", "d1")], "meeting_id string, unit_id string, digest string")
    assert [r.unit_id for r in scoring.resume_conflicts(requests, stored).collect()] == ["0"]


def test_requests_are_stable(spark):
    blocked = blocks.greedy_blocks(ingest.normalize(five(spark)))
    a = pipelines.requests(blocked, "model").orderBy("unit_id").collect()
    b = pipelines.requests(blocked.repartition(3), "model").orderBy("unit_id").collect()
    state = json.loads(a[2].payload)["state"]
    assert a == b and [[x["text"] for x in state[k]] for k in ("before", "target", "after")] == [["turn 1"], ["turn 2"], ["turn 3"]]
    assert a[2].payload == json.dumps(json.loads(a[2].payload), sort_keys=True, ensure_ascii=False)


def test_grading(spark):
    ask = spark.createDataFrame([("g", "a", ["x", "y"], "x"), ("g", "b", ["x", "y"], "y"), ("g", "c", ["x", "y"], "x")], "group_id string, question_id string, labels array<string>, expected string")
    kind = "group_id string, question_id string, type string, noul double, choice string, score double, confidence double, probabilities map<string,double>"
    given = spark.createDataFrame([("g", "a", "choice", None, "x", None, 0.9, {"x": 0.7, "y": 0.3}), ("g", "b", "choice", None, "x", None, 0.9, {"x": 0.1, "y": 0.9}), ("g", "d", "choice", None, "x", None, 0.9, {"x": 1.0, "y": 0.0})], kind)
    assert {(r.question_id, r.error) for r in evaluate.answer_errors(ask, given, "choice").collect()} == {("b", "choice_is_not_the_most_likely"), ("c", "question_ids_differ"), ("d", "question_ids_differ")}
    level = spark.createDataFrame([("g", "a", "score", None, None, 1.0, 0.9, {"0": 0.4, "1": 0.2, "2": 0.4})], kind)
    want = spark.createDataFrame([("g", "a", ["0", "1", "2"], 0)], "group_id string, question_id string, labels array<string>, expected int")
    r = evaluate.grade(want, level, "score").first()
    assert (r.observed, r.matches_expected) == ("0", True) and evaluate.answer_errors(want, level, "score").count() == 0


def test_flow_c(spark):
    turns = spark.createDataFrame([("m", f"t{i:02d}", "some words here", 3 <= i <= 18) for i in range(1, 21)], "meeting_id string, turn_id string, text string, expected_keep boolean")
    s = spark.createDataFrame([("m", f"t{i:02d}", d, (0.95 if d == "nonbusiness" and i in (1, 2, 5) else 0.1)) for i in range(1, 21) for d in DIMENSIONS], "meeting_id string, turn_id string, question string, p double")
    r = pipelines.evaluate_turns(turns, s, DIMENSIONS, "nonbusiness").first()
    assert (r.expected, r.n_retained, r.missed, r.unnecessary) == (16, 15, "t05", "t19,t20") and abs(r.word_reduction - 0.15) < 1e-9


def test_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"schema_version": 1, "segments": [{"start": 0, "end": 1, "text": f"m{k}"}, {"start": 1, "end": 2, "text": " "}]}))
    q = arrivals.screen_arrivals(arrivals.arriving(spark, str(tmp_path / "in"), 2), lambda s: s, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["m0", "m1", "m2"]


def test_flow_b_texts(spark):
    s = spark.createDataFrame([("m", i, f"S{i:05d}", float(i), i + 1.0, f"t{i}", "x", False) for i in range(1, 5)], "meeting_id string, ordinal int, id string, start double, end double, text string, source string, uncertain boolean")
    scores = spark.createDataFrame([("m", f"S{i:05d}", p) for i, p in zip(range(1, 5), (0.1, 0.11, 0.12, 0.9), strict=True)], "meeting_id string, id string, p double")
    got = {r["name"]: r.document for r in pipelines.review_texts(s, pipelines.screen_parents(s, scores)).collect()}
    assert set(got) == {"full", "selected", "removed", "deletion_review"}
    assert "t4" in got["removed"] and "t4" not in got["selected"] and "t1" in got["selected"] and "S00004" in got["deletion_review"]
