"""The flows from the command line: python -m quillspark prepare | review | turns | evaluate | inspect.

No text leaves the machine unless a scorer is named: a function module:name that takes a payload
and returns the status and the body of the answer."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import ingest, parents, question_sets
from .operators.asking import Call
from .plans import pipelines
from .sources import files, log, media, record, transcripts
from .sources.tables import qualified, written


def _scorer(name: str) -> Call:
    module, _, function = name.partition(":")
    found = importlib.import_module(module)
    cloudpickle.register_pickle_by_value(found)  # workers need not find its file
    return getattr(found, function)


def _show(rows: DataFrame) -> None:
    for r in rows.toJSON().collect():
        print(r)


def _new(spark: SparkSession, path: str) -> str:
    path = qualified(spark, path).rstrip("/")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise FileExistsError(f"{path} exists; choose a new --out")
    return path


def _raw(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.asr is not None:
        return transcripts.parse_asr(transcripts.read_asr(spark, args.source), args.asr)
    return transcripts.read_transcripts(spark, args.source)


def prepare(spark: SparkSession, args: argparse.Namespace) -> None:
    """Flow A: documents, their JSON, and the sources as they were, under a new folder."""
    out = _new(spark, args.out)
    raw = _raw(spark, args)
    if args.scorer:
        flow = pipelines.screen_blocks(raw, _scorer(args.scorer), args.cache or f"{out}/cache", args.model, strict=True, tasks=args.tasks, at_once=args.at_once)
        files.write_documents(pipelines.block_outputs(flow), f"{out}/json", ".json")
        texts = flow["texts"]
        _show(flow["stats"])
    else:
        segments = written(pipelines.prepare(raw, strict=True)[0], "segments")
        texts = pipelines.texts(segments, segments)
        _show(segments.groupBy("meeting_id").agg(F.count("*").alias("segments_total"), F.sum(F.length("text")).alias("source_characters")))
    files.write_documents(texts, f"{out}/documents")
    files.keep_sources(spark, args.source, f"{out}/sources")


def review(spark: SparkSession, args: argparse.Namespace) -> None:
    """Flow B. Without a scorer the requests are made, checked and recorded; with one they are
    asked. A run that is recorded at --out goes on with --resume."""
    out = qualified(spark, args.out).rstrip("/") if args.resume else _new(spark, args.out)
    segments = written(ingest.normalize(_raw(spark, args), strict=True), "segments")
    asked = written(pipelines.parent_requests(segments, args.model), "requests")
    faults = parents.request_violations(segments, asked).where("violations > 0").collect()
    if faults:
        raise ValueError(f"requests do not match their segments: {faults}")
    if not log.exists(spark, f"{out}/run"):
        record.start(spark, f"{out}/run", parents.parent_windows(segments), asked)
        files.keep_sources(spark, args.source, f"{out}/sources")
    _show(asked.agg(F.count("*").alias("parents"), F.sum(F.size("asked")).alias("targets"), F.max(F.size("asked")).alias("largest")))
    if not args.scorer:
        return
    flow = pipelines.review_parents(segments, _scorer(args.scorer), f"{out}/run", args.model, tasks=args.tasks, at_once=args.at_once)
    n = log.count(spark, f"{out}/run", "responses")
    files.write_documents(pipelines.review_texts(segments, flow), f"{out}/documents-{n}")
    files.write_documents(pipelines.parent_outputs(segments, flow), f"{out}/json-{n}", ".json")
    _show(flow["stats"])


def evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    """Flow D: the built-in questions, asked, checked and graded."""
    flow = pipelines.evaluate_answers(question_sets.questions(spark), question_sets.group_requests(spark, args.model), _scorer(args.scorer), at_once=args.at_once)
    _show(flow["answers"].orderBy("group_id", "question_id"))
    _show(flow["summary"])


def turns(spark: SparkSession, args: argparse.Namespace) -> None:
    """Flow C: the built-in labelled turns, asked; what was kept, and the report."""
    flow = pipelines.review_turns(question_sets.turns(spark), _scorer(args.scorer), args.model, at_once=args.at_once)
    _show(flow["recall"])
    print(flow["report"].first().report)


def inspect(spark: SparkSession, args: argparse.Namespace) -> None:
    """Audio tracks of media files, by their headers."""
    found = written(media.probe(spark, args.source), "tracks")
    _show(media.audio_streams(found).orderBy("media", "audio_index"))
    _show(found.where("error is not null").select("media", "error"))


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for f in (prepare, review, turns, evaluate, inspect):
        p = sub.add_parser(f.__name__, help=f.__doc__)
        p.set_defaults(run=f)
        if f not in (turns, evaluate):
            p.add_argument("source", help="a file, a folder or a pattern")
        if f is inspect:
            continue
        p.add_argument("--scorer", required=f in (turns, evaluate), help="module:function; what is asked goes to it")
        p.add_argument("--model", default="model")
        p.add_argument("--tasks", type=int, default=1, help="tasks that ask")
        p.add_argument("--at-once", type=int, default=4, help="calls that a task keeps open")
        if f not in (turns, evaluate):
            p.add_argument("--out", required=True, help="a new folder")
            p.add_argument("--asr", metavar="LABEL", help="the source is recognizer output, of this track")
    sub.choices["prepare"].add_argument("--cache", help="a folder of answers that several runs share")
    sub.choices["review"].add_argument("--resume", action="store_true", help="go on with the run recorded at --out")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("quillspark").getOrCreate()
    try:
        args.run(spark, args)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except Exception as e:  # noqa: BLE001  what Spark raises carries its own stack: the message will do
        print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
