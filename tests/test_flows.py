import io
import json
import re
import struct
import wave

import pytest
from pyspark.sql import functions as F

from quillspark.operators import decide, evaluate, ingest, parents, question_sets
from quillspark.operators.schema import DIMENSIONS
from quillspark.plans import pipelines
from quillspark.sources import media, transcripts


# --- flow D and the built-in sets ---------------------------------------------------------------


def right_answers(change=None):
    """A scorer that answers as expected, but for what change does to an answer."""

    def call(payload):
        request = json.loads(payload)
        assert "expected" not in payload
        answers = {}
        for q, asked in request["questions"].items():
            want = question_sets.EXPECTED[q]
            if asked["type"] == "noul":
                answers[q] = {"type": "noul", "noul": 0.9 if want else 0.1}
            else:
                labels = list(asked["criteria"]) if asked["type"] == "choice" else [str(i) for i in range(len(asked["criteria"]))]
                p = {k: 0.8 if k == str(want) else 0.2 / (len(labels) - 1) for k in labels}
                answers[q] = {"type": asked["type"], "probabilities": p, "confidence": 0.7} | ({"choice": want} if asked["type"] == "choice" else {"score": sum(int(k) * v for k, v in p.items())})
        if change:
            change(answers)
        return 200, json.dumps({"answers": answers, "usage": {"input_tokens": 1000, "output_tokens": 10}, "model": "m"})

    return call


def test_built_in_questions(spark):
    q = question_sets.questions(spark)
    assert sorted((r.kind, r.n) for r in q.groupBy("kind").agg(F.count("*").alias("n")).collect()) == [("choice", 5), ("noul", 6), ("score", 4)]
    flow = pipelines.evaluate_answers(q, question_sets.group_requests(spark, "model"), right_answers())
    rows = {r.question_id: r for r in flow["answers"].collect()}
    assert len(rows) == 15 and all(r.matches_expected and r.error is None for r in rows.values())
    assert (rows["c5"].observed, rows["s3"].observed, rows["n2"].observed, rows["n2"].value) == ("other_or_unknown", "2", "false", 0.1)
    s = flow["summary"].first()
    assert (s.requests, s.questions, s.errors, s.matches, s.input_tokens, s.output_tokens) == (3, 15, 0, 15, 3000, 30) and abs(s.cost - 3000 / 1e6 * 0.042) < 1e-15


def test_wrong_and_malformed_answers(spark):
    def change(answers):
        if "c1" in answers:
            answers["c1"]["choice"] = "sales"  # not the most likely
            answers["c2"]["probabilities"]["billing"] = 0.5  # more than 1 in all
            del answers["c3"]["probabilities"]["other_or_unknown"]
            answers["c4"]["confidence"] = "high"
            answers["c5"] = ["no", "object"]
        if "s1" in answers:
            answers["s1"]["score"] = 1.9
            answers["s2"] = {"type": "score", "score": 0.1, "confidence": 1, "probabilities": {"0": 0.9, "1": 0.1, "2": 0.0}}
            answers["s3"]["score"] = "2"
        if "n1" in answers:
            answers["more"] = answers["n1"]

    flow = pipelines.evaluate_answers(question_sets.questions(spark), question_sets.group_requests(spark, "model"), right_answers(change))
    got = {r.question_id: (r.error, r.matches_expected) for r in flow["answers"].collect()}
    assert got["c1"] == ("choice_is_not_the_most_likely", None) and got["c2"] == ("probabilities_do_not_sum_to_1", None)
    assert got["c3"][0] in ("labels_differ", "probabilities_do_not_sum_to_1") and got["c4"][0] == "confidence_out_of_range" and got["c5"][0] == "type_differs"
    assert got["s1"][0] == "score_is_not_the_mean" and got["s2"] == (None, False) and got["s3"][0] == "score_out_of_range" and got["s4"] == (None, True)
    assert {got[f"n{i}"] for i in range(1, 7)} == {("question_ids_differ", None)}
    s = flow["summary"].first()
    assert (s.questions, s.errors, s.matches) == (15, 13, 1)


def test_no_response_for_a_group(spark):
    call = right_answers()
    flow = pipelines.evaluate_answers(question_sets.questions(spark), question_sets.group_requests(spark, "model"), lambda p: (500, "") if "tickets" in p else call(p))
    got = {r.question_id: r.error for r in flow["answers"].collect()}
    assert {k for k, v in got.items() if v} == {f"c{i}" for i in range(1, 6)} and set(got.values()) == {None, "no_response"}


def test_built_in_turns(spark):
    turns = question_sets.turns(spark)
    rows = turns.orderBy("turn_id").collect()
    assert len(rows) == 20 and [r.turn_id for r in rows if not r.expected_keep] == ["t01", "t02", "t19", "t20"]
    asked = evaluate.question_fanout(turns, DIMENSIONS)
    assert asked.count() == 100
    chatter = F.col("turn_id").isin("t01", "t19", "t20")
    scores = asked.select("meeting_id", "turn_id", F.col("dimension").alias("question"), F.when(F.col("dimension") == "nonbusiness", F.when(chatter, 0.95).otherwise(0.1)).otherwise(F.when(chatter, 0.05).otherwise(0.6)).alias("p"))
    r = pipelines.evaluate_turns(turns, scores, DIMENSIONS, "nonbusiness").first()
    words = sum(len(re.findall(r"\b[\w'-]+\b", x.text)) for x in rows)
    assert (r.expected, r.n_retained, r.missed, r.unnecessary, r.source_words) == (16, 16, "", "t02", words)


# --- layout of requests ---------------------------------------------------------------------------


def test_request_layout(spark):
    rows = [("m", 0, 59.0, 61.0, "crosses"), ("m", 1, 60.0, 62.0, "next"), ("m", 2, 61.0, 61.0, "next"), ("n", 0, 0.0, 1.0, 'q "x"\n')]
    s = ingest.normalize(spark.createDataFrame(rows, "meeting_id string, ordinal int, start double, end double, text string"))
    asked = pipelines.parent_requests(s, "model")
    count = lambda df: {r.check: r.violations for r in df.collect()}
    assert set(count(parents.request_violations(s, asked)).values()) == {0}
    assert count(parents.request_violations(s, asked.where("meeting_id = 'm'")))["order_differs"] == 1, "a meeting without requests"
    assert count(parents.request_violations(s.withColumn("text", F.when(F.col("ordinal") == 2, "other").otherwise(F.col("text"))), asked)) == {"order_differs": 0, "text_changed": 1, "questions_differ": 0, "target_not_in_context": 0, "text_differs": 0}
    assert set(count(parents.request_violations(s.limit(0), asked.limit(0))).values()) == {0}


# --- reading ---------------------------------------------------------------------------------------


def test_times_may_be_strings(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"segments": [{"start": "1.5", "end": 2, "text": "a"}, {"start": " 3e0 ", "end": "4_0", "text": "b"}, {"start": "x", "end": 5, "text": "c"}, {"start": 5, "end": "inf", "text": "d"}, {"end": 5, "text": "e"}]}))
    got = transcripts.read_transcripts(spark, str(tmp_path)).orderBy("ordinal")
    assert [(r.start, r.end) for r in got.collect()] == [(1.5, 2.0), (3.0, 40.0), (None, 5.0), (5.0, float("inf")), (None, 5.0)]
    assert [(r.ordinal, r.code) for r in ingest.violations(got).orderBy("ordinal").collect()] == [(2, "missing"), (3, "not_finite"), (4, "missing")]


def wav(channels, width, rate, frames):
    f = io.BytesIO()
    with wave.open(f, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(b"\1" * (channels * width * frames))
    return f.getvalue()


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def mp4(*tracks, seconds=2.5, last=True):
    traks = []
    for kind, code, channels, rate in tracks:
        entry = struct.pack(">I4s6xH8xHHIHH", 36, code, 1, channels, 16, 0, rate, 0)
        traks.append(box(b"trak", box(b"tkhd", bytes(84)), box(b"mdia", box(b"mdhd", bytes(24)), box(b"hdlr", bytes(8), kind, bytes(12)), box(b"minf", box(b"stbl", box(b"stsd", struct.pack(">II", 0, 1), entry))))))
    moov = box(b"moov", box(b"mvhd", struct.pack(">B3xQQIQ", 1, 0, 0, 1000, int(seconds * 1000)), bytes(80)), *traks)
    data = box(b"mdat", bytes(5000))
    return box(b"ftyp", b"isom") + (data + moov if last else moov + data)


CASES = {
    "a.wav": (wav(2, 2, 44100, 441), 0.01, [(0, 0, "pcm_s16le", 2, 44100)]),
    "b.wav": (wav(1, 1, 8000, 8000), 1.0, [(0, 0, "pcm_u8", 1, 8000)]),
    "c.mp4": (mp4((b"vide", b"avc1", 0, 0), (b"soun", b"mp4a", 2, 48000), (b"soun", b"Opus", 1, 16000)), 2.5, [(0, 1, "aac", 2, 48000), (1, 2, "opus", 1, 16000)]),
    "d.m4a": (mp4((b"soun", b"alac", 6, 32000), last=False), 2.5, [(0, 0, "alac", 6, 32000)]),
    "silent.mp4": (mp4((b"vide", b"hev1", 0, 0)), 2.5, []),
    "x.txt": (b"no media", None, []),
    "cut.mp4": (mp4((b"soun", b"mp4a", 2, 48000))[:-150], None, None),
    "zero.mp4": (box(b"ftyp", b"isom") + struct.pack(">I4s", 4, b"moov"), None, []),
}


def test_tracks_from_headers(spark, tmp_path):
    for name, (content, *_) in CASES.items():
        (tmp_path / name).write_bytes(content)
    rows = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()] + [("null", None)], "media string, content binary").repartition(3)
    for tracks in (media.from_bytes(rows), media.probe(spark, str(tmp_path), 2).withColumn("media", F.element_at(F.split("media", "/"), -1))):
        found = {r.media: r for r in tracks.collect()}
        streams = {}
        for r in media.audio_streams(tracks).collect():
            streams.setdefault(r.media, []).append(tuple(r)[2:])
        for name, (_, seconds, want) in CASES.items():
            if want is not None:
                assert found[name].duration_seconds == seconds and sorted(streams.get(name, [])) == want, name
        assert found["x.txt"].error and found["zero.mp4"].error and found["cut.mp4"] is not None and not found["silent.mp4"].error


def test_only_headers_are_read():
    content, read = mp4((b"soun", b"mp4a", 2, 48000)), []

    def at(o, n):
        read.append(n)
        return content[o : o + n]

    seconds, streams, error = media.described(at, len(content))
    assert error is None and streams[0]["codec"] == "aac" and sum(read) < 1500 < len(content)
    many = box(b"ftyp", b"isom") + box(b"free") * (media.MOST_BOXES + 1)
    assert media.described(lambda o, n: many[o : o + n], len(many))[2] == "it has too many boxes"
    deep = b""
    for _ in range(3000):
        deep = box(b"trak", deep)
    deep = box(b"ftyp", b"isom") + box(b"moov", deep)
    assert media.described(lambda o, n: deep[o : o + n], len(deep))[1:] == ([], "maximum recursion depth exceeded")


def test_turn_requests_are_canonical(spark):
    r = pipelines.turn_requests(question_sets.turns(spark), "model", question_sets.TURNS_PURPOSE).first()
    said = json.loads(r.payload)
    assert r.payload == json.dumps(said, sort_keys=True, ensure_ascii=False)
    assert len(said["questions"]) == 100 and set(said["questions"]) == set(r.asked) and len(said["state"]["turns"]) == 20
    assert said["questions"]["t07_action"]["instructions"].startswith("Target turn: `turns.t07`. Does this turn convey an assignment")
    assert said["state"]["turns"]["t18"]["text"] == question_sets.TURNS[17][2]
