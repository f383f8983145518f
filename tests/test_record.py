import json
import os

import pytest
from pyspark.sql import functions as F

from quillspark.operators import ingest
from quillspark.plans import pipelines
from quillspark.sources import files, log, record, transcripts
from quillspark.sources.files import OneFileEach


def segments(spark, n=10, text="t"):
    rows = [("m", i, 12.0 * i, 12.0 * i + 5, f"{text}{i}") for i in range(n)]
    return ingest.normalize(spark.createDataFrame(rows, "meeting_id string, ordinal int, start double, end double, text string"))


def scorer(folder, answer=None, high=("S00003",)):
    """Scores 0.9 for what may go and about 0.1 for the rest, and leaves a file for each call."""

    def call(payload):
        asked = json.loads(payload)["questions"]
        with open(os.path.join(folder, f"{len(os.listdir(folder)):03d}-{min(asked)}"), "w"):
            pass
        if answer is not None and answer(asked):
            return answer(asked)
        return 200, json.dumps({"answers": {q: {"type": "noul", "noul": 0.9 if q in high else 0.1 + int(q[1:]) / 1000} for q in asked}, "usage": {"input_tokens": 11, "output_tokens": 2}, "model": "m1"})

    return call


def asked(folder):
    return sorted(f[4:] for f in os.listdir(folder))


@pytest.fixture
def calls(tmp_path):
    (tmp_path / "calls").mkdir()
    return str(tmp_path / "calls")


def test_run_resume_and_outcome(spark, tmp_path, calls):
    s, path = segments(spark), str(tmp_path / "run")
    refuse = lambda q: (500, "") if "S00007" in q else None
    flow = pipelines.review_parents(s, scorer(calls, refuse), path)
    assert asked(calls) == ["S00001", "S00006"]
    reasons = {r.id: r.reason for r in flow["judgments"].collect()}
    assert {reasons[f"S{i:05d}"] for i in range(6, 11)} == {"service_failure_keep"} and reasons["S00003"] == "above_document_adaptive_threshold"
    r = flow["stats"].first()
    assert (r.parents, r.successes, r.failures, r.attempts, r.input_tokens, r.models, r.removed, r.kept) == (2, 1, 1, 2, 11, "m1", 1, 9)
    again = pipelines.review_parents(s, scorer(calls), path)
    assert asked(calls) == ["S00001", "S00006", "S00006"], "only what failed is asked again"
    r = again["stats"].first()
    assert (r.successes, r.failures, r.kept) == (2, 0, 9)
    pipelines.review_parents(s, scorer(calls), path)
    assert len(asked(calls)) == 3
    with pytest.raises(record.OtherInputs):
        pipelines.review_parents(segments(spark, text="u"), scorer(calls), path)
    with pytest.raises(record.OtherInputs):
        pipelines.review_parents(segments(spark, n=3), scorer(calls), path)
    assert len(asked(calls)) == 3 and pipelines.recorded(s, path)["stats"].first().successes == 2
    assert "payload" not in record.units(spark, path).columns and record.requests(spark, path).count() == 2


def test_failures_may_count_as_answers(spark, tmp_path, calls):
    s, path = segments(spark), str(tmp_path / "run")
    fail = lambda q: (401, "")
    pipelines.review_parents(s, scorer(calls, fail), path)
    flow = pipelines.review_parents(s, scorer(calls), path, failed_too=False)
    assert len(asked(calls)) == 2 and {r.error for r in flow["log"].collect()} == {"http 401"} and flow["removed"].count() == 0


def test_a_broken_run_blocks_nothing(spark, tmp_path, calls, monkeypatch):
    s, path = segments(spark), str(tmp_path / "run")
    whole = log.Files.publish
    monkeypatch.setattr(log.Files, "publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        pipelines.review_parents(s, scorer(calls), path)
    assert not log.exists(spark, path) and asked(calls) == []
    with pytest.raises(FileNotFoundError):
        record.requests(spark, path)
    seen = []
    monkeypatch.setattr(log.Files, "publish", lambda self, name, text: seen.append(name) or (whole(self, name, text) if len(seen) < 2 else (_ for _ in ()).throw(OSError("lost"))))
    with pytest.raises(OSError, match="lost"):  # recorded, asked, but the responses were not added
        pipelines.review_parents(s, scorer(calls), path)
    assert record.still_open(record.answered(spark, path)).count() == 2
    monkeypatch.setattr(log.Files, "publish", whole)
    assert pipelines.review_parents(s, scorer(calls), path)["stats"].first().successes == 2


def test_the_latest_valid_response_counts(spark, tmp_path):
    path = str(tmp_path / "run")
    ask = spark.createDataFrame([("m", "P01", "d1", "{1}", ["a"]), ("m", "P02", "d2", "{2}", ["b"]), ("n", "P01", "d2", "{2}", ["b"]), ("n", "P02", "d3", "{3}", ["c"])], "meeting_id string, unit_id string, digest string, payload string, asked array<string>")
    record.start(spark, path, ask.select("meeting_id", "unit_id", "payload"), ask)
    with pytest.raises(FileExistsError):
        record.start(spark, path, ask.select("meeting_id"), ask)
    assert [r.responses for r in record.answered(spark, path).collect()] == [0] * 4
    body = lambda q, p: json.dumps({"answers": {q: {"type": "noul", "noul": p}}})
    kind = "digest string, body string, attempts array<struct<status: string, code: int>>, elapsed_ms double"
    for rows in ([("d1", body("a", 0.1)), ("d2", "bad")], [("d1", body("a", 0.2)), ("d2", body("b", 0.5))], [("d1", "bad"), ("d2", None)]):
        record.add(spark, path, spark.createDataFrame([(d, b, [{"status": "success", "code": None}], 1.0) for d, b in rows], kind))
    got = {(r.meeting_id, r.unit_id): r for r in record.answered(spark, path).collect()}
    assert {k: r.scores for k, r in got.items()} == {("m", "P01"): {"a": 0.2}, ("m", "P02"): {"b": 0.5}, ("n", "P01"): {"b": 0.5}, ("n", "P02"): None}
    assert [r.digest for r in record.still_open(record.answered(spark, path)).collect()] == ["d3"]
    with pytest.raises(record.OtherInputs, match="d9"):
        record.add(spark, path, spark.createDataFrame([("d9", "{}", [], 1.0)], kind))
    assert log.read(spark, path, "responses").count() == 6


def test_documents_and_json(spark, tmp_path, calls):
    s = segments(spark)
    flow = pipelines.review_parents(s, scorer(calls), str(tmp_path / "run"))
    md, js = str(tmp_path / "md"), str(tmp_path / "json")
    wanted = pipelines.review_texts(s, flow)
    files.write_documents(wanted, md)
    assert sorted(os.listdir(f"{md}/m")) == ["deletion_review.md", "full.md", "removed.md", "selected.md"]
    for r in wanted.collect():
        assert open(f"{md}/m/{r['name']}.md", encoding="utf-8", newline="").read() == r.document
    files.write_documents(pipelines.parent_outputs(s, flow), js, ".json")
    load = lambda name: json.load(open(f"{js}/m/{name}.json", encoding="utf-8"))
    assert [x["id"] for x in load("removed")["segments"]] == ["S00003"] and len(load("selected")["segments"]) == 9
    assert [x["id"] for x in load("judgments")] == [f"S{i:05d}" for i in range(1, 11)] and load("judgments")[2]["candidate_remove"]
    assert load("distribution")["reason"] == "clear_gap_found" and load("stats")["removed"] == 1
    with pytest.raises(FileExistsError):
        files.write_documents(wanted, md)


def test_block_outputs(spark, tmp_path):
    rows = [("m", 0, 0.0, 5.0, "é \"x\"\n", None, None), ("n", 0, 0.0, 5.0, "y", "s", True)]
    raw = spark.createDataFrame(rows, "meeting_id string, ordinal int, start double, end double, text string, source string, uncertain boolean")
    flow = pipelines.screen_blocks(raw, lambda payload: (200, json.dumps({"answers": {q: {"type": "noul", "noul": 0.99 if q == "chatter" else 0} for q in json.loads(payload)["questions"]}})), str(tmp_path / "cache"))
    got = {(r.meeting_id, r["name"]): json.loads(r.document) for r in pipelines.block_outputs(flow).collect()}
    assert set(got) == {(m, k) for m in "mn" for k in ("transcript", "selected", "screening", "stats")}
    assert got["m", "selected"] == {"schema_version": 1, "segments": []} and got["m", "transcript"]["segments"][0]["text"] == 'é "x"'
    assert got["m", "screening"][0]["reason"] == "judged" and got["n", "screening"][0]["reason"] == "explicit_transcription_uncertainty"
    assert got["m", "stats"]["segments_selected"] == 0 and got["n", "selected"]["segments"][0]["id"] == "S00001"


def test_files_are_exact_and_whole(spark, tmp_path):
    odd = [("m/1", "a.b", b"\xef\xbb\xbfbom\r\nline\r"), ("..", "x y+z%20", b"\n"), ("file:/é?#", "n", bytes(range(256)) * 100_000)]
    rows = spark.createDataFrame(odd, "folder string, name string, content binary")
    path = str(tmp_path / "out")
    files.write_files(rows, path)
    assert sorted(tuple(r) for r in files.read_files(spark, path).collect()) == sorted((a, b, bytearray(c)) for a, b, c in odd)
    for i, bad in enumerate((rows.unionByName(rows.limit(1)), rows.withColumn("content", F.lit(None).cast("binary")), rows.withColumn("name", F.when(F.col("folder") == "..", F.raise_error(F.lit("late"))).otherwise(F.col("name"))))):
        with pytest.raises(Exception):
            files.write_files(bad, str(tmp_path / f"bad{i}"))
    assert sorted(os.listdir(tmp_path)) == ["out"], "what failed leaves nothing"


def test_repeated_attempts_count_once(tmp_path):
    import pyarrow as pa

    batch = lambda x: iter([pa.RecordBatch.from_pydict({"folder": ["m", "n"], "name": ["a", "a"], "content": [x, x]})])
    w = OneFileEach(str(tmp_path / "out"))
    w.write(batch(b"first attempt, lost"))
    told = w.write(batch(b"second"))
    w.commit([told, None])
    assert sorted(os.listdir(tmp_path)) == ["out"] and (tmp_path / "out" / "m" / "a").read_bytes() == b"second"
    late = OneFileEach(str(tmp_path / "out"))
    with pytest.raises(FileExistsError):
        late.commit([late.write(batch(b"third"))])
    assert sorted(os.listdir(tmp_path)) == ["out"] and (tmp_path / "out" / "n" / "a").read_bytes() == b"second"


def test_sources_are_kept(spark, tmp_path):
    (tmp_path / "in").mkdir()
    texts = {"bom.json": b'\xef\xbb\xbf{"segments": []}', "crlf.json": b'{"segments":\r\n[]}\r\n', "bad.json": b'{"segments": "\xff\xfe"}', "same a.json": b"{}", "same+b.json": b"{}"}
    for name, content in texts.items():
        (tmp_path / "in" / name).write_bytes(content)
    kept = files.keep_sources(spark, str(tmp_path / "in"), str(tmp_path / "kept"))
    rows = {r.name: r for r in kept.collect()}
    assert set(rows) == set(texts)
    for name, content in texts.items():
        assert (tmp_path / "kept" / rows[name].sha256 / files.safe(name)).read_bytes() == content and rows[name].size == len(content)
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "t.json").write_text(json.dumps({"segments": [{"start": 0, "end": 1, "text": "x"}]}))
    read = transcripts.read_transcripts(spark, str(tmp_path / "one")).first()
    copy = files.keep_sources(spark, str(tmp_path / "one"), str(tmp_path / "kept2")).first()
    assert (copy.meeting_id, copy.sha256) == (read.meeting_id, read.sha256)
