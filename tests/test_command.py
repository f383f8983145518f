import json
import os
import sys

import pytest

from quillspark.__main__ import main

SCORER = '''
import json

def call(payload):
    request = json.loads(payload)
    if "meeting_purpose" in request["state"]:
        idle = ("t01", "t02", "t19", "t20")
        p = {k: (0.97 if k[:3] in idle else 0.1) if k.endswith("nonbusiness") else (0.05 if k[:3] in idle else 0.8) for k in request["questions"]}
    elif "target" in request["state"]:
        important = "ship" in request["state"]["target"][0]["text"]
        p = {k: 0.99 if (k == "action") == important and k in ("action", "chatter") else 0.01 for k in request["questions"]}
    else:
        p = {k: 0.95 if "hello" in q["instructions"]["target_text"] else 0.05 for k, q in request["questions"].items()}
    return 200, json.dumps({"answers": {k: {"type": "noul", "noul": v} for k, v in p.items()}, "usage": {"input_tokens": 3}, "model": "m1"})

def down(payload):
    return 500, ""
'''


@pytest.fixture
def place(tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    rows = [(0, 5, "hello there"), (70, 75, "do not ship on Friday"), (140, 145, "fine"), (210, 215, "bye"), (280, 285, "hello again")]
    (tmp_path / "in" / "a.json").write_text(json.dumps({"schema_version": 1, "segments": [{"start": a, "end": b, "text": t, "id": f"S{i + 1:05d}"} for i, (a, b, t) in enumerate(rows)]}))
    (tmp_path / "own_scorer.py").write_text(SCORER)
    monkeypatch.syspath_prepend(str(tmp_path))
    sys.modules.pop("own_scorer", None)
    return tmp_path


def listed(path):
    return sorted(f for _, _, names in os.walk(path) for f in names if not f.startswith((".", "_")))


def test_prepare(spark, place, capsys):
    out = place / "out"
    assert main(["prepare", str(place / "in"), "--out", str(out)], spark) == 0
    assert listed(out / "documents") == ["full_prompt.md", "selected.md", "selected_prompt.md", "transcript.md"] and listed(out / "sources") == ["a.json"]
    assert json.loads(capsys.readouterr().out)["segments_total"] == 5
    assert main(["prepare", str(place / "in"), "--out", str(out)], spark) == 1 and "exists" in capsys.readouterr().err
    asked = place / "asked"
    assert main(["prepare", str(place / "in"), "--out", str(asked), "--scorer", "own_scorer:call", "--cache", str(place / "cache")], spark) == 0
    assert json.loads(capsys.readouterr().out)["requests"] == 5
    (folder,) = os.listdir(asked / "documents")
    chosen = (asked / "documents" / folder / "selected.md").read_text()
    assert "ship" in chosen and "hello there" in chosen and "fine" in chosen and "bye" not in chosen
    assert listed(asked / "json") == ["screening.json", "selected.json", "stats.json", "transcript.json"]
    assert main(["prepare", str(place / "in"), "--out", str(place / "again"), "--scorer", "own_scorer:call", "--cache", str(place / "cache")], spark) == 0
    assert json.loads(capsys.readouterr().out)["requests"] == 0


def test_an_invalid_transcript_is_an_error(spark, place, capsys):
    (place / "in" / "b.json").write_text(json.dumps({"segments": [{"start": 1, "end": 0, "text": "x"}]}))
    assert main(["prepare", str(place / "in"), "--out", str(place / "out")], spark) == 1
    assert "error" in capsys.readouterr().err and not (place / "out" / "documents").exists()


def test_review_and_resume(spark, place, capsys):
    out = str(place / "out")
    assert main(["review", str(place / "in"), "--out", out], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"parents": 5, "targets": 5, "largest": 1}
    assert listed(place / "out" / "sources") == ["a.json"] and not os.path.exists(f"{out}/documents-1")
    assert main(["review", str(place / "in"), "--out", out], spark) == 1
    capsys.readouterr()
    assert main(["review", str(place / "in"), "--out", out, "--resume", "--scorer", "own_scorer:down"], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["failures"] == 5
    assert main(["review", str(place / "in"), "--out", out, "--resume", "--scorer", "own_scorer:call"], spark) == 0
    s = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert (s["successes"], s["failures"], s["removed"]) == (5, 0, 2)
    (folder,) = os.listdir(f"{out}/documents-2")
    assert "hello again" in open(f"{out}/documents-2/{folder}/removed.md").read()


def test_evaluate_and_inspect(spark, place, capsys):
    assert main(["evaluate", "--scorer", "own_scorer:down"], spark) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert len(rows) == 16 and {r["error"] for r in rows[:-1]} == {"no_response"} and rows[-1]["errors"] == 15
    assert main(["turns", "--scorer", "own_scorer:call"], spark) == 0
    out = capsys.readouterr().out.splitlines()
    r = json.loads(out[0])
    assert (r["expected"], r["n_retained"], r["n_missed"], r["n_unnecessary"]) == (16, 16, 0, 0)
    assert sum(x.startswith("| t") for x in out) == 20 and sum(x.startswith("[t") for x in out) == 16
    assert main(["inspect", str(place / "in")], spark) == 0
    assert "neither" in capsys.readouterr().out
