"""All queries of the library by name, and the SQL that each must agree with."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import asking, blocks, decide, evaluate, ingest, parents, render, scoring, select, stats
from ..operators.question_sets import DIMENSION_TEXTS, TURN_HEAD, TURN_TAIL, TURNS_PURPOSE
from ..operators.schema import DEFAULT_SOURCE, DEFAULT_TRACK, DIMENSIONS, FULL_HEADING, NOTHING_SELECTED, PARENT_FALSE, PARENT_NOTE, PARENT_QUESTION, PARENT_RULE, PARENT_TRUE, PROMPT, PURPOSE, QUESTION_TEXTS, QUESTIONS, REPORT_DROPPED, REPORT_HEAD, REPORT_KEPT, REPORT_MATERIAL, REVIEW_NOTE, REVIEW_TITLE, SELECTED_HEADING
from ..sources import files, log, media, record, tables, transcripts
from . import pipelines, proxy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _with(*ctes: str) -> str:
    return "with recursive " + ",\n".join([proxy.SQL.strip(), *ctes]) + "\n"


def _times(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"start": "start_s", "end": "end_s"})


def _joined(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in cols})


# --- sources, validation, order -------------------------------------------------------------


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with blank texts, space about texts, and sources and flags left out."""
    r = proxy.raw_segments(spark, sf_dir)
    text = F.when(F.col("h") % 7 == 0, F.lit(" \t ")).otherwise(F.concat(F.lit("  "), "text", F.lit("\t\n")))
    return r.withColumns({"text": text, "source": F.when(F.col("h") % 3 > 0, F.col("source")), "uncertain": F.when(F.col("h") % 5 > 0, F.col("h") % 17 == 0)})


@query(_with("k as (select * from raw where h % 7 <> 0)") + f"""select meeting_id, ordinal, printf('S%05d', row_number() over (partition by meeting_id order by s, e, ordinal)) as id, s as start_s, e as end_s, text,
  case when h % 3 > 0 then source else '{DEFAULT_SOURCE}' end as source, case when h % 5 > 0 then h % 17 = 0 else false end as uncertain from k""")
def normalize_segments(spark, sf_dir):
    return _times(ingest.normalize(_dirty(spark, sf_dir)))


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("h")
    start = F.when(h % 11 == 0, -1.0).when(h % 13 == 0, F.lit(float("nan"))).otherwise(F.col("start"))
    end = F.when(h % 19 == 0, F.col("start") - 1).when(h % 23 == 0, F.lit(float("inf"))).otherwise(F.col("end"))
    return proxy.raw_segments(spark, sf_dir).withColumns({"start": start, "end": end})


_BROKEN = """bad as (select meeting_id, ordinal, text, case when h % 11 = 0 then -1.0::double when h % 13 = 0 then 'nan'::double else s end as s, case when h % 19 = 0 then s - 1 when h % 23 = 0 then 'inf'::double else e end as e from raw),
coded as (select meeting_id, ordinal, case when isnan(s) or isinf(s) or isnan(e) or isinf(e) then 'not_finite' when s < 0 then 'negative_start' when e < s then 'end_before_start' end as code from bad)"""


@query(_with(_BROKEN) + "select * from coded where code is not null")
def invalid_segments(spark, sf_dir):
    return ingest.violations(_broken(spark, sf_dir))


@query(_with(_BROKEN) + "select meeting_id, ordinal, code from coded where code is not null qualify row_number() over (partition by meeting_id order by ordinal) = 1")
def first_invalid(spark, sf_dir):
    return ingest.first_violation(_broken(spark, sf_dir))


@query(_with("b as (select meeting_id, ordinal, floor(s * 1000)::bigint as f, floor(e * 1000)::bigint as t, text, h from raw), n as (select *, row_number() over (partition by meeting_id order by ordinal) - 1 as k from b)") + "select meeting_id, k as ordinal, f / 1000.0::double as start_s, t / 1000.0::double as end_s, text, 'remote' as source from n where h % 7 <> 0")
def asr_parse(spark, sf_dir):
    r = proxy.raw_segments(spark, sf_dir)
    text = F.when(F.col("h") % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "text", F.lit(" ")))
    ms = lambda c: F.floor(F.col(c) * 1000).cast("long")
    part = F.struct("ordinal", F.struct(ms("start").alias("from"), ms("end").alias("to")).alias("offsets"), text.alias("text"))
    raw = r.groupBy("meeting_id").agg(F.array_sort(F.collect_list(part)).alias("transcription"))
    return _times(transcripts.parse_asr(raw, "remote"))


@query("select n_regionkey as media, 'd' || n_regionkey as duration_seconds, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as audio_index, n_nationkey as stream_index, n_name as codec from nation where n_nationkey % 3 <> 1")
def audio_tracks(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    stream = F.struct(F.col("n_nationkey").alias("index"), F.when(F.col("n_nationkey") % 3 != 1, "audio").otherwise("video").alias("codec_type"), F.col("n_name").alias("codec_name"), F.lit(2).alias("channels"), F.lit("48000").alias("sample_rate"), F.create_map(F.lit("k"), F.lit("v")).alias("tags"))
    probes = n.groupBy(F.col("n_regionkey").alias("media")).agg(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), stream.alias("s"))).alias("o"))
    probes = probes.select("media", F.struct(F.concat(F.lit("d"), "media").alias("duration")).alias("format"), F.transform(F.array_sort("o", lambda a, b: a["k"] - b["k"]), lambda x: x["s"]).alias("streams"))
    return transcripts.audio_tracks(probes).select("media", "duration_seconds", "audio_index", "stream_index", "codec")


_SPEC = "select n_regionkey as media, case when n_nationkey % 6 = 0 then 'x:' || n_name when n_nationkey % 6 = 1 then (n_nationkey % 4)::varchar || ': ' when n_nationkey % 6 = 2 then '9:' || n_name else (n_nationkey % 4)::varchar || ':' || n_name || ':b' end as spec from nation"


@query(f"""with s as ({_SPEC}), p as (select *, split_part(spec, ':', 1) as i, trim(substr(spec, instr(spec, ':') + 1)) as label from s),
c as (select *, case when regexp_full_match(i, '[0-9]+') then i::int end as audio_index from p)
select media, spec, audio_index, label, case when label = '' then 'no_label' when audio_index is null then 'bad_index' when audio_index >= 4 then 'out_of_range'
  when count(audio_index) over (partition by media, audio_index) > 1 then 'duplicate' end as error from c""")
def track_specs(spark, sf_dir):
    n, k = spark.read.parquet(f"{sf_dir}/nation.parquet"), F.col("n_nationkey")
    four = (k % 4).cast("string")
    spec = F.when(k % 6 == 0, F.concat(F.lit("x:"), "n_name")).when(k % 6 == 1, F.concat(four, F.lit(": "))).when(k % 6 == 2, F.concat(F.lit("9:"), "n_name")).otherwise(F.concat(four, F.lit(":"), "n_name", F.lit(":b")))
    return ingest.track_specs(n.select(F.col("n_regionkey").alias("media"), spec.alias("spec")), 4)


@query(f"select r_regionkey as media, case when r_regionkey % 2 = 0 then '0:' || r_name else '{DEFAULT_TRACK}' end as spec from region")
def default_specs(spark, sf_dir):
    """Every other region's track is named."""
    r = spark.read.parquet(f"{sf_dir}/region.parquet").withColumn("media", F.col("r_regionkey"))
    return ingest.default_specs(r, r.where("media % 2 = 0").select("media", F.concat(F.lit("0:"), "r_name").alias("spec")))


@query(_with("t as (select *, row_number() over (partition by meeting_id order by case when source = 'user' then 0 else 1 end, ordinal) - 1 as k from raw)") + "select meeting_id, k as ordinal, printf('S%05d', row_number() over (partition by meeting_id order by s, e, k)) as id, source, text from t")
def track_union(spark, sf_dir):
    r = proxy.raw_segments(spark, sf_dir)
    tracks = ingest.union_tracks([r.where("source = 'user'"), r.where("source <> 'user'")])
    return ingest.normalize(tracks).select("meeting_id", "ordinal", "id", "source", "text")


# --- blocks ----------------------------------------------------------------------------------

_BLOCKS = """ord as (select *, row_number() over (partition by meeting_id order by s, e, ordinal) as rn, length(text) as n from seg),
fold(meeting_id, rn, block, chars, first_s) as (
  select meeting_id, rn, 1, n::bigint, s from ord where rn = 1
  union all
  select o.meeting_id, o.rn, case when f.chars + o.n > 1400 or o.e - f.first_s > 60 then f.block + 1 else f.block end,
    case when f.chars + o.n > 1400 or o.e - f.first_s > 60 then o.n else f.chars + o.n end::bigint,
    case when f.chars + o.n > 1400 or o.e - f.first_s > 60 then o.s else f.first_s end
  from fold f join ord o on o.meeting_id = f.meeting_id and o.rn = f.rn + 1),
blk as (select o.*, f.block from ord o join fold f using (meeting_id, rn)),
bl as (select meeting_id, block, string_agg(id, ',' order by rn) as ids, sum(n)::bigint as chars, bool_or(uncertain) as uncertain from blk group by meeting_id, block)"""


def _blocked(spark, sf_dir):
    return blocks.greedy_blocks(proxy.segments(spark, sf_dir))


@query(_with(_BLOCKS) + "select meeting_id, id, block from blk")
def greedy_blocks(spark, sf_dir):
    return _blocked(spark, sf_dir).select("meeting_id", "id", "block")


@query(_with(_BLOCKS) + "select * from bl")
def block_uncertain(spark, sf_dir):
    return _joined(blocks.blocks(_blocked(spark, sf_dir)), "ids")


@query(_with(_BLOCKS, """r as (select *, row_number() over (partition by meeting_id, block order by rn) as a, row_number() over (partition by meeting_id, block order by rn desc) as z from blk)""") + """select bl.meeting_id, bl.block, bl.ids,
  coalesce((select string_agg(id, ',' order by rn) from r where r.meeting_id = bl.meeting_id and r.block = bl.block - 1 and z <= 2), '') as before,
  coalesce((select string_agg(id, ',' order by rn) from r where r.meeting_id = bl.meeting_id and r.block = bl.block + 1 and a <= 2), '') as after from bl""")
def block_context(spark, sf_dir):
    return _joined(blocks.block_context(_blocked(spark, sf_dir)), "ids", "before", "after").select("meeting_id", "block", "ids", "before", "after")


_QS = ", ".join(f"{proxy.sql_score(repr(q), 'meeting_id', 'block')} as {q}" for q in QUESTIONS)
_RULE = "(chatter >= 0.9 and requirement < 0.2 and action < 0.2 and decision < 0.2 and unresolved < 0.2)"
_SCORED = f"sc as (select *, {_QS} from bl), sc2 as (select * replace (case when block % 2 = 0 then 0.95::double else chatter end as chatter, requirement / 4 as requirement, action / 4 as action, decision / 4 as decision, unresolved / 4 as unresolved) from sc)"


def _block_scores(blocked):
    """A column per question; scores bent so that some blocks are dropped."""
    wide = decide.pivot_scores(proxy.block_scores(blocked, QUESTIONS), ["meeting_id", "block"])
    return wide.withColumns({q: F.col(q) / 4 for q in QUESTIONS if q != "chatter"} | {"chatter": F.when(F.col("block") % 2 == 0, F.lit(0.95)).otherwise(F.col("chatter"))})


@query(_with(_BLOCKS, f"sc as (select meeting_id, block, {_QS} from bl)") + "select * from sc")
def score_pivot(spark, sf_dir):
    return decide.pivot_scores(proxy.block_scores(_blocked(spark, sf_dir), QUESTIONS), ["meeting_id", "block"])


@query(_with(_BLOCKS, _SCORED) + f"select meeting_id, block, {_RULE} as dropped from sc2")
def drop_rule_a(spark, sf_dir):
    return _block_scores(_blocked(spark, sf_dir)).select("meeting_id", "block", decide.drop_rule("chatter", [q for q in QUESTIONS if q != "chatter"]).alias("dropped"))


def _records(blocked):
    """Block records with stand-ins for what a scorer would report."""
    b = blocks.blocks(blocked).join(_block_scores(blocked), ["meeting_id", "block"])
    k = F.col("meeting_id") * 31 + F.col("block")
    b = b.withColumns({"payload_chars": F.col("chars") * 60, "error": F.when(k % 9 == 0, "status 500"), "cache_hit": k % 4 == 0, "input_tokens": F.when(k % 5 > 0, F.col("chars"))})
    return decide.screening(b).withColumn("responded", F.col("reason") == "judged")


_RECORDS = f"""rec as (select *, case when uncertain then 'explicit_transcription_uncertainty' when chars * 60 > 18000 then 'oversized_keep_for_review'
   when (meeting_id * 31 + block) % 9 = 0 then 'service_error_keep_for_review' else 'judged' end as reason from sc2),
kp as (select *, not (reason = 'judged' and {_RULE}) as keep from rec),
ks as (select blk.*, keep from blk join kp using (meeting_id, block)),
rs as (select *, bool_or(keep) over (partition by meeting_id order by rn rows between 1 preceding and 1 following) as restored from ks)"""


@query(_with(_BLOCKS, _SCORED, _RECORDS) + "select meeting_id, block, ids, reason, keep from kp")
def screening_reason(spark, sf_dir):
    blocked = tables.written(_blocked(spark, sf_dir), "blocked")
    return _joined(_records(blocked), "ids").select("meeting_id", "block", "ids", "reason", "keep")


def _restored(blocked, records):
    kept = blocked.join(records.select("meeting_id", "block", F.col("keep").alias("kept")), ["meeting_id", "block"])
    return select.restore_neighbours(kept)


@query(_with(_BLOCKS, _SCORED, _RECORDS) + "select meeting_id, id, keep as kept, restored from rs")
def restore_neighbours(spark, sf_dir):
    blocked = tables.written(_blocked(spark, sf_dir), "blocked")
    return _restored(blocked, _records(blocked)).select("meeting_id", "id", "kept", "restored")


@query(_with(_BLOCKS, _SCORED, _RECORDS, """a as (select meeting_id, count(*) as segments_total, count(*) filter (restored) as segments_selected, sum(n)::bigint as source_characters, coalesce(sum(n) filter (restored), 0)::bigint as selected_characters from rs group by meeting_id),
c as (select meeting_id, count(*) filter (reason = 'judged' and (meeting_id * 31 + block) % 4 <> 0) as requests,
  coalesce(sum(case when (meeting_id * 31 + block) % 5 > 0 then chars else 0 end) filter (reason = 'judged' and (meeting_id * 31 + block) % 4 <> 0), 0)::bigint as input_tokens,
  count(*) filter (reason = 'service_error_keep_for_review') as failed_blocks from kp group by meeting_id)""") + "select a.*, requests, input_tokens, failed_blocks, 1 - selected_characters / source_characters::double as character_reduction from a join c using (meeting_id)")
def stats_a(spark, sf_dir):
    blocked = tables.written(_blocked(spark, sf_dir), "blocked")
    records = tables.written(_records(blocked), "records")
    return stats.stats_a(_restored(blocked, records), records)


# --- parents, threshold, judgments -----------------------------------------------------------

_PARENTS = """tm as (select *, floor(s / 60)::int as m, max(e) over (partition by meeting_id) as d from seg),
par as (select meeting_id, m, printf('P%02d', m + 1) as parent_id, m * 60.0::double as core_start, least(m * 60.0::double + 60, max(d)) as core_end, greatest(m * 60.0::double - 15, 0.0::double) as context_start, least(m * 60.0::double + 75, max(d)) as context_end,
  string_agg(id, ',' order by s, e, ordinal) as target_ids, count(*) as n from tm group by meeting_id, m),
ctx as (select par.meeting_id, par.m, tm.id, tm.m = par.m as is_target from par join tm on tm.meeting_id = par.meeting_id and tm.s < context_end and tm.e >= context_start)"""


@query(_with(_PARENTS) + "select meeting_id, m, parent_id, core_start, core_end, target_ids from par")
def parent_windows(spark, sf_dir):
    return _joined(parents.parent_windows(proxy.segments(spark, sf_dir)), "target_ids").select("meeting_id", "m", "parent_id", "core_start", "core_end", "target_ids")


@query(_with(_PARENTS) + "select meeting_id, parent_id, context_start, context_end from par")
def parent_bounds(spark, sf_dir):
    return parents.parent_windows(proxy.segments(spark, sf_dir)).select("meeting_id", "parent_id", "context_start", "context_end")


@query(_with(_PARENTS) + "select * from ctx")
def parent_context(spark, sf_dir):
    return parents.parent_context(proxy.segments(spark, sf_dir))


@query("select unnest(['segment_without_parent', 'segment_in_two_parents', 'repeated_id', 'target_outside_context', 'context_without_segment']) as \"check\", 0::bigint as violations")
def layout_violations(spark, sf_dir):
    return parents.layout_violations(proxy.segments(spark, sf_dir))


_TWICE = "sg2 as (select * from seg union all select * from seg where h % 10 = 0), sg3 as (select * replace (case when h % 8 = 0 then s else e end as e) from sg2)"


@query(_with(_TWICE, _PARENTS.replace("from seg)", "from sg3)"), """tg as (select meeting_id, m, id from tm)""") + """select 'segment_without_parent' as "check", 0::bigint as violations
union all select 'segment_in_two_parents', count(*) from (select 1 from tg group by meeting_id, id having count(*) > 1)
union all select 'repeated_id', count(*) from (select 1 from sg3 group by meeting_id, id having count(*) > 1)
union all select 'target_outside_context', count(*) from tg where not exists (select 1 from ctx where ctx.meeting_id = tg.meeting_id and ctx.m = tg.m and ctx.id = tg.id)
union all select 'context_without_segment', 0""")
def layout_faults(spark, sf_dir):
    """Some segments stand twice, and some end where they begin, the last of a meeting among them."""
    s = proxy.segments(spark, sf_dir)
    s = s.unionByName(s.where("h % 10 = 0"))
    return parents.layout_violations(s.withColumn("end", F.when(F.col("h") % 8 == 0, F.col("start")).otherwise(F.col("end"))))


def _threshold(scores: str) -> str:
    """CTEs over a view of (g, p)."""
    return f"""sx as (select g, p from {scores} where p is not null and not isnan(p) and not isinf(p)),
tot as (select g, count(*) as scored, count(distinct p) as unique_scores from sx group by g),
gp as (select g, p as lower, lead(p) over (partition by g order by p) as upper from (select distinct g, p from sx)),
rk as (select *, upper - lower as width, row_number() over (partition by g order by upper - lower desc, lower) as rank, count(*) over (partition by g) - 1 as others from gp where upper is not null),
ag as (select g, max(lower) filter (rank = 1) as lower, max(upper) filter (rank = 1) as upper, max(width) filter (rank = 1) as width, max(width) filter (rank = 2) as runner_up,
  (max(width) filter (others > 0 and rank = (others + 1) // 2 + 1) + max(width) filter (others > 0 and rank = (others + 2) // 2 + 1)) / 2 as typical from rk group by g),
th0 as (select tot.g, scored, unique_scores, lower, upper, width, runner_up, typical, case when unique_scores < 2 then 'fewer_than_two_unique_scores'
  when case when unique_scores = 2 then scored >= 3 else width >= 3.0::double * typical and width >= 2.0::double * runner_up end then 'clear_gap_found' else 'no_clearly_isolated_gap' end as reason from tot left join ag on tot.g = ag.g),
th as (select *, case when reason = 'clear_gap_found' then (lower + upper) / 2 end as threshold from th0)"""


_TH = _threshold("(select meeting_id as g, p from seg)")
_TH_COLS = "scored, unique_scores, lower, upper, width, runner_up, typical, reason, threshold"


@query(_with(_TH) + f"select g as meeting_id, {_TH_COLS} from th")
def adaptive_threshold(spark, sf_dir):
    return decide.adaptive_threshold(proxy.segments(spark, sf_dir).select("meeting_id", "p"))


@query("with " + _threshold("(select user_id as g, value / cast(500 as double) as p from events)") + f"select g as user_id, {_TH_COLS} from th")
def adaptive_threshold_events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", (F.col("value") / F.lit(500).cast("double")).alias("p"))
    return decide.adaptive_threshold(e, "user_id")


@query(_with(_TH) + "select g as meeting_id, lower, upper, width, rank from rk")
def gap_table(spark, sf_dir):
    return decide.gap_table(proxy.segments(spark, sf_dir).select("meeting_id", "p"))


_JUDGED = _TH + """,
jd as (select seg.*, case when h % 29 = 0 then null else p end as q, threshold from seg join th on g = meeting_id),
jg as (select *, coalesce(q > threshold, false) as gone, case when q is null then 'service_failure_keep' when threshold is null then 'no_clear_document_gap_keep' when q > threshold then 'above_document_adaptive_threshold' else 'below_document_adaptive_threshold_keep' end as reason from jd)"""


def _judged(spark, sf_dir):
    """Thresholds from all scores; then some scores are missing."""
    s = proxy.segments(spark, sf_dir)
    some = s.select("meeting_id", "id", F.when(F.col("h") % 29 != 0, F.col("p")).alias("p"))
    return s, decide.judgments(s.select("meeting_id", "id"), some, decide.adaptive_threshold(s.select("meeting_id", "p")))


@query(_with(_JUDGED) + "select meeting_id, id, q as p, gone as candidate_remove, reason from jg")
def judgments(spark, sf_dir):
    return _judged(spark, sf_dir)[1]


@query(_with(_JUDGED) + "select meeting_id, id, text from jg where not gone")
def selected(spark, sf_dir):
    return select.split(*_judged(spark, sf_dir))[0].select("meeting_id", "id", "text")


@query(_with(_JUDGED) + "select meeting_id, id, text from jg where gone")
def removed(spark, sf_dir):
    return select.split(*_judged(spark, sf_dir))[1].select("meeting_id", "id", "text")


_BAD_SPLIT = _JUDGED + """,
sl as (select meeting_id, id, case when h % 11 = 0 then text || '!' else text end as text from jg where (not gone or h % 7 = 0) and h % 13 <> 0), rm as (select meeting_id, id, text from jg where gone),
both_ as (select * from sl union all select * from rm), every as (select meeting_id, id, text from seg)"""


@query(_with(_BAD_SPLIT) + """select 'selected_and_removed' as "check", count(*) as violations from (select meeting_id, id from sl intersect select meeting_id, id from rm)
union all select 'lost', count(*) from (select * from every except all select * from both_) union all select 'changed_or_added', count(*) from (select * from both_ except all select * from every)""")
def output_violations(spark, sf_dir):
    """Some removed segments are selected as well, some lost, some changed."""
    s, j = _judged(spark, sf_dir)
    cols = ["meeting_id", "id", "text"]
    rows = s.join(j.select("meeting_id", "id", "candidate_remove"), ["meeting_id", "id"])
    kept = rows.where("(not candidate_remove or h % 7 = 0) and h % 13 <> 0").withColumn("text", F.when(F.col("h") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return select.output_violations(s.select(*cols), kept.select(*cols), rows.where("candidate_remove").select(*cols))


@query("select unnest(['selected_and_removed', 'lost', 'changed_or_added']) as \"check\", 0::bigint as violations")
def output_invariants(spark, sf_dir):
    s, j = _judged(spark, sf_dir)
    return select.output_violations(s, *select.split(s, j))


@query(_with(_JUDGED, "nb as (select *, row_number() over (partition by meeting_id order by s, e, ordinal) as rn from jg)") + """select a.meeting_id, a.id as target_id, a.q as p, b.id, b.text, b.id = a.id as is_target, (row_number() over (partition by a.meeting_id, a.id order by b.rn) - 1)::int as place
from nb a join nb b on b.meeting_id = a.meeting_id and b.rn between a.rn - 4 and a.rn + 4 where a.gone""")
def review_frame(spark, sf_dir):
    return select.review_frame(*_judged(spark, sf_dir)).drop("target_start", "target_end")


@query(_with(_JUDGED, _PARENTS, """lg as (select meeting_id, m, n, (meeting_id * 7 + m) % 6 = 0 as failed, 1 + (meeting_id + m) % 3 as tries, case when (meeting_id * 7 + m) % 6 <> 0 then n * 11 end as tokens, 'm' || (m % 2) as model from par),
t as (select meeting_id, count(*) as targets, count(*) filter (not gone) as kept, count(*) filter (gone) as removed, sum(length(text))::bigint as original_characters, coalesce(sum(length(text)) filter (gone), 0)::bigint as removed_characters from jg group by meeting_id),
c as (select meeting_id, count(*) as parents, count(*) filter (not failed) as successes, count(*) filter (failed) as failures, sum(tries)::bigint as attempts, coalesce(sum(tokens), 0)::bigint as input_tokens, string_agg(distinct model, ',' order by model) as models, max(n)::int as largest_parent from lg group by meeting_id)""") + "select t.*, parents, successes, failures, attempts, input_tokens, models, largest_parent, removed_characters / original_characters::double as character_reduction from t join c using (meeting_id)")
def stats_b(spark, sf_dir):
    s, j = _judged(spark, sf_dir)
    k = F.col("meeting_id") * 7 + F.col("m")
    log = parents.parent_windows(s).select(
        "meeting_id", F.size("target_ids").alias("n_targets"), (k % 6 == 0).alias("failed"), F.array_repeat(F.lit("busy"), (1 + (F.col("meeting_id") + F.col("m")) % 3).cast("int")).alias("attempts"),
        F.when(k % 6 != 0, F.size("target_ids") * 11).alias("input_tokens"), F.concat(F.lit("m"), F.col("m") % 2).alias("model"),
    )
    return stats.stats_b(s, j, log)


# --- texts -----------------------------------------------------------------------------------

_CLOCK = lambda x: f"printf('%02d:%02d:%02d', floor({x})::bigint // 3600, floor({x})::bigint // 60 % 60, floor({x})::bigint % 60)"
_LINES = f"ln as (select meeting_id, id, ordinal, s + meeting_id * 600 as s2, '[' || id || ' ' || {_CLOCK('s + meeting_id * 600')} || '–' || {_CLOCK('e + meeting_id * 600')} || '] ' || source || chr(10) || text as line from seg)"


def _late(spark, sf_dir):
    """Segments moved so that some meetings reach past an hour."""
    by = F.col("meeting_id") * 600
    return proxy.segments(spark, sf_dir).withColumns({"start": F.col("start") + by, "end": F.col("end") + by})


@query(_with(_LINES) + "select meeting_id, id, line from ln")
def segment_lines(spark, sf_dir):
    return _late(spark, sf_dir).select("meeting_id", "id", render.segment_line().alias("line"))


@query(_with(_LINES) + f"select meeting_id, '{PROMPT}{FULL_HEADING}' || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) order by s2, ordinal) || chr(10) as document from ln group by meeting_id")
def document_text(spark, sf_dir):
    s = _late(spark, sf_dir)
    return render.documents(s, s, False)


_REVIEW = f"""nb as (select *, row_number() over (partition by meeting_id order by s, e, ordinal) as rn from jg),
ab as (select a.meeting_id, a.id as tid, a.s as ts, a.e as te, a.q, string_agg(case when a.id = b.id then '- **候选删除** [' else '- 上下文 [' end || b.id || '] ' || b.text, chr(10) order by b.rn) as body
  from nb a join nb b on b.meeting_id = a.meeting_id and b.rn between a.rn - 4 and a.rn + 4 where a.gone group by all),
pa as (select meeting_id, string_agg('## ' || tid || ' · ' || {_CLOCK('ts')} || '–' || {_CLOCK('te')} || ' · P(removable)=' || printf('%.2f', q) || chr(10) || chr(10) || body || chr(10), chr(10) order by ts, te, tid) as parts from ab group by meeting_id)"""
_REVIEW_ROWS = f"""
select g as meeting_id, '{REVIEW_TITLE}' || chr(10) || chr(10) || '{REVIEW_NOTE[0]}' || coalesce(threshold::varchar, 'None') || '{REVIEW_NOTE[1]}' || chr(10) || coalesce(chr(10) || parts, '') as review from th left join pa on pa.meeting_id = g"""


@query(_with(_JUDGED, _REVIEW) + _REVIEW_ROWS)
def deletion_review(spark, sf_dir):
    s, j = _judged(spark, sf_dir)
    return render.deletion_review(select.review_frame(s, j), decide.adaptive_threshold(s.select("meeting_id", "p")))


@query(_with(_LINES, "lk as (select * from ln join seg using (meeting_id, id) where meeting_id % 3 > 0 and h % 2 = 0)") + f"""select g.meeting_id, '{PROMPT}{SELECTED_HEADING}' || chr(10) || chr(10) || coalesce(string_agg(line, chr(10) || chr(10) order by s2, lk.ordinal), '{NOTHING_SELECTED}') || chr(10) as document
from (select distinct meeting_id from seg) g left join lk using (meeting_id) group by g.meeting_id""")
def selected_document(spark, sf_dir):
    """Of each third meeting nothing is selected."""
    s = _late(spark, sf_dir)
    return render.documents(s, s.where("meeting_id % 3 > 0 and h % 2 = 0"), True)


_LINE = f"'[' || id || ' ' || {_CLOCK('s')} || '–' || {_CLOCK('e')} || '] ' || source || chr(10) || text"


@query(_with(_JUDGED, f"jl as (select *, {_LINE} as line from jg)", "nm as (select unnest(['full', 'selected', 'removed']) as name)") + """
select g.meeting_id, name, coalesce(string_agg(line, chr(10) || chr(10) order by s, e, ordinal) filter (name = 'full' or gone = (name = 'removed')), '') || chr(10) as document
from (select distinct meeting_id from seg) g cross join nm join jl on jl.meeting_id = g.meeting_id group by g.meeting_id, name""")
def review_texts(spark, sf_dir):
    """The fourth text is deletion_review()."""
    s, j = _judged(spark, sf_dir)
    chosen, gone = select.split(s, j)
    flow = {"selected": chosen, "removed": gone, "review": select.review_frame(s, j), "thresholds": decide.adaptive_threshold(s.select("meeting_id", "p"))}
    return pipelines.review_texts(s, flow).where("name <> 'deletion_review'")


@query("select conv_id as meeting_id, turn, coalesce(len(regexp_extract_all(text, '[A-Za-z0-9_''-]*[A-Za-z0-9_][A-Za-z0-9_''-]*')), 0)::int as words from conversations")
def word_counts(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select(F.col("conv_id").alias("meeting_id"), "turn", T.word_count(F.col("text"), ascii_only=True).alias("words"))


@query("select conv_id as meeting_id, turn, left(case when length(substr(text, 3, 4)) > 0 then replace(text, substr(text, 3, 4), '[REDACTED]') else text end, 40) as shown from conversations")
def log_redaction(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select(F.col("conv_id").alias("meeting_id"), "turn", T.redact(F.col("text"), F.substring("text", 3, 4), 40).alias("shown"))


# --- evaluation ------------------------------------------------------------------------------

_TURNS = "turns as (select meeting_id, id as turn_id, text, h % 3 <> 0 as expected_keep from seg)"


def _turns(spark, sf_dir):
    return proxy.segments(spark, sf_dir).select("meeting_id", F.col("id").alias("turn_id"), "text", (F.col("h") % 3 != 0).alias("expected_keep"))


@query(_with(_TURNS, f"dm as (select unnest({list(DIMENSIONS)!r}) as dimension)") + "select meeting_id, turn_id, dimension, turn_id || '_' || dimension as question_id from turns, dm")
def question_fanout(spark, sf_dir):
    return evaluate.question_fanout(_turns(spark, sf_dir).select("meeting_id", "turn_id"), DIMENSIONS)


_DIMS = ", ".join(f"{proxy.sql_score(repr(q), 'meeting_id', 'turn_id')}{'' if q == 'nonbusiness' else ' / 4'} as {q}" for q in DIMENSIONS)
_KEEP = f"ev as (select *, {_DIMS} from turns), ek as (select *, not (nonbusiness >= 0.9 and greatest(requirement, action, decision, unresolved) < 0.2) as keep from ev)"


def _kept_turns(spark, sf_dir):
    t = evaluate.question_fanout(_turns(spark, sf_dir), DIMENSIONS)
    p = (proxy.chance(F.col("dimension"), F.col("meeting_id"), F.col("turn_id")) % 1000) / F.lit(1000).cast("double")
    scores = t.select("meeting_id", "turn_id", F.col("dimension").alias("question"), F.when(F.col("dimension") == "nonbusiness", p).otherwise(p / 4).alias("p"))
    wide = decide.pivot_scores(scores, ["meeting_id", "turn_id"], DIMENSIONS)
    rows = _turns(spark, sf_dir).join(wide, ["meeting_id", "turn_id"])
    return rows.withColumn("keep", ~decide.drop_rule("nonbusiness", [d for d in DIMENSIONS if d != "nonbusiness"]))


@query(_with(_TURNS, _KEEP) + "select meeting_id, turn_id, keep from ek")
def rule_c(spark, sf_dir):
    return _kept_turns(spark, sf_dir).select("meeting_id", "turn_id", "keep")


_WORDS = "coalesce(len(regexp_extract_all(text, '[A-Za-z0-9_''-]*[A-Za-z0-9_][A-Za-z0-9_''-]*')), 0)"


@query(_with(_TURNS, _KEEP) + f"""select meeting_id, sum({_WORDS})::bigint as source_words, coalesce(sum({_WORDS}) filter (keep), 0)::bigint as kept_words, 1 - coalesce(sum({_WORDS}) filter (keep), 0) / nullif(sum({_WORDS}), 0)::double as word_reduction, count(*) filter (expected_keep) as expected, count(*) filter (keep and expected_keep) as n_retained, count(*) filter (expected_keep and not keep) as n_missed, count(*) filter (keep and not expected_keep) as n_unnecessary,
  coalesce(string_agg(turn_id, ',' order by turn_id) filter (keep and expected_keep), '') as retained, coalesce(string_agg(turn_id, ',' order by turn_id) filter (expected_keep and not keep), '') as missed, coalesce(string_agg(turn_id, ',' order by turn_id) filter (keep and not expected_keep), '') as unnecessary from ek group by meeting_id""")
def recall_sets(spark, sf_dir):
    return evaluate.recall_sets(_kept_turns(spark, sf_dir))



@query(_with(_TURNS) + "select meeting_id, turn_id, expected_keep from turns")
def expected_labels(spark, sf_dir):
    t = _turns(spark, sf_dir)
    return evaluate.label_turns(t.drop("expected_keep"), t.where("expected_keep")).select("meeting_id", "turn_id", "expected_keep")


_CELLS = " || ' | ' || ".join(f"printf('%.2f', {d})" for d in DIMENSIONS)


@query(_with(_TURNS, _KEEP, f"""rp as (select ek.*, '| ' || turn_id || case when keep then ' | {REPORT_KEPT} | ' else ' | {REPORT_DROPPED} | ' end || {_CELLS} || ' |' as row_,
  '[' || turn_id || ' ' || {_CLOCK('s')} || '] ' || source || ': ' || ek.text as line from ek join seg on seg.meeting_id = ek.meeting_id and seg.id = turn_id)""") + f"""
select meeting_id, '{REPORT_HEAD}' || chr(10) || string_agg(row_, chr(10) order by turn_id) || chr(10) || chr(10) || '{REPORT_MATERIAL}' || chr(10) || coalesce(chr(10) || string_agg(line, chr(10) order by turn_id) filter (keep), '') || chr(10) as report from rp group by meeting_id""")
def score_report(spark, sf_dir):
    s = proxy.segments(spark, sf_dir).select("meeting_id", F.col("id").alias("turn_id"), T.clock(F.col("start")).alias("timestamp"), F.col("source").alias("speaker"))
    return render.score_report(_kept_turns(spark, sf_dir).join(s, ["meeting_id", "turn_id"]), DIMENSIONS)


def _graded(spark, sf_dir, kind: str):
    """Questions from orders: three labels or levels, probabilities from two hashes."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"))
    h = proxy.chance(F.lit(kind), F.col("k"))
    a, b = (h % 40) / F.lit(100).cast("double"), (F.floor(h / 40) % 60) / F.lit(100).cast("double")
    c = F.round(1 - a - b, 2)
    names = ["low", "mid", "top"] if kind == "choice" else ["0", "1", "2"]
    probs = F.create_map(*(x for n, p in zip(names, (a, b, c), strict=True) for x in (F.lit(n), p)))
    best = F.when((a >= b) & (a >= c), names[0]).when(b >= c, names[1]).otherwise(names[2])
    rows = o.select(F.lit("g").alias("group_id"), F.col("k").alias("question_id"), h.alias("h"), probs.alias("probabilities"), F.when(h % 97 == 0, F.lit("none")).otherwise(best).alias("choice"), (b + 2 * c + F.when(h % 89 == 0, 0.5).otherwise(0.0)).alias("score"), (a + F.when(h % 83 == 0, 1.0).otherwise(0.0)).alias("confidence"), (h % 1000 / F.lit(1000).cast("double")).alias("noul"), F.when(h % 79 == 0, F.lit("other")).otherwise(F.lit(kind)).alias("type"))
    expected = rows.select("group_id", "question_id", F.array(*map(F.lit, names)).alias("labels"), (F.col("h") % 2 == 0 if kind == "noul" else F.get(F.array(*map(F.lit, names)), (F.col("h") % 3).cast("int"))).alias("expected"))
    return expected, rows.drop("h")


def _graded_sql(kind: str) -> str:
    names = ["low", "mid", "top"] if kind == "choice" else ["0", "1", "2"]
    return f"""with q as (select o_orderkey as question_id, ('0x' || substr(md5(concat_ws(':', '{kind}', o_orderkey)), 1, 6))::bigint as h from orders),
pr as (select *, (h % 40) / 100.0::double as a, (h // 40 % 60) / 100.0::double as b from q), pc as (select *, round(1 - a - b, 2) as c from pr),
gr as (select *, case when a >= b and a >= c then '{names[0]}' when b >= c then '{names[1]}' else '{names[2]}' end as best, ['{names[0]}', '{names[1]}', '{names[2]}'][h % 3 + 1] as want from pc) """


@query(_graded_sql("choice") + "select 'g' as group_id, question_id, want as expected, case when h % 97 = 0 then 'none' else best end as observed, case when h % 97 = 0 then null else greatest(a, b, c) end as value, (h % 97 <> 0 and best = want) as matches_expected from gr")
def grade_choice(spark, sf_dir):
    return evaluate.grade(*_graded(spark, sf_dir, "choice"), "choice")


@query(_graded_sql("score") + "select 'g' as group_id, question_id, want as expected, best as observed, b + 2 * c + case when h % 89 = 0 then 0.5::double else 0.0::double end as value, best = want as matches_expected from gr")
def grade_score(spark, sf_dir):
    return evaluate.grade(*_graded(spark, sf_dir, "score"), "score")


@query(_graded_sql("noul") + "select 'g' as group_id, question_id, (h % 2 = 0)::varchar as expected, (h % 1000 >= 500)::varchar as observed, (h % 1000) / 1000.0::double as value, (h % 2 = 0) = (h % 1000 >= 500) as matches_expected from gr")
def grade_noul(spark, sf_dir):
    return evaluate.grade(*_graded(spark, sf_dir, "noul"), "noul")


@query(_graded_sql("noul") + ", n as (select count(*) as questions, count(*) filter ((h % 2 = 0) = (h % 1000 >= 500))::bigint as matches from gr), c as (select sum(o_orderkey % 1000)::bigint as input_tokens, median((o_orderkey % 777)::double) as median_ms from orders) select questions, matches, input_tokens, median_ms, input_tokens / 1e6::double * 0.042::double as cost from n, c")
def grade_summary(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    calls = o.select((F.col("o_orderkey") % 1000).alias("input_tokens"), (F.col("o_orderkey") % 777).cast("double").alias("elapsed_ms"))
    return evaluate.grade_summary(grade_noul(spark, sf_dir), calls)


@query(_graded_sql("choice") + """select 'choice' as kind, question_id, case when h % 79 = 0 then 'type_differs' when a > 1 or b > 1 or c > 1 or c < 0 then 'probability_out_of_range' when a + case when h % 83 = 0 then 1 else 0 end > 1 then 'confidence_out_of_range' when h % 97 = 0 then 'choice_is_not_the_most_likely' end as error from gr
where h % 79 = 0 or a > 1 or b > 1 or c > 1 or c < 0 or a + case when h % 83 = 0 then 1 else 0 end > 1 or h % 97 = 0""")
def answer_checks(spark, sf_dir):
    return evaluate.answer_errors(*_graded(spark, sf_dir, "choice"), "choice").select(F.lit("choice").alias("kind"), "question_id", "error")


@query(_graded_sql("score") + """select question_id, case when h % 79 = 0 then 'type_differs' when a > 1 or b > 1 or c > 1 or c < 0 then 'probability_out_of_range' when a + case when h % 83 = 0 then 1 else 0 end > 1 then 'confidence_out_of_range' when b + 2 * c + case when h % 89 = 0 then 0.5 else 0 end > 2 then 'score_out_of_range' when h % 89 = 0 then 'score_is_not_the_mean' end as error from gr
where h % 79 = 0 or a > 1 or b > 1 or c > 1 or c < 0 or a + case when h % 83 = 0 then 1 else 0 end > 1 or h % 89 = 0""")
def answer_checks_score(spark, sf_dir):
    return evaluate.answer_errors(*_graded(spark, sf_dir, "score"), "score").select("question_id", "error")


@query(_graded_sql("noul") + """select question_id, case when h % 79 = 0 then 'type_differs' when h % 101 = 0 then 'noul_out_of_range' end as error from gr where h % 79 = 0 or h % 101 = 0""")
def answer_checks_noul(spark, sf_dir):
    expected, given = _graded(spark, sf_dir, "noul")
    return evaluate.answer_errors(expected, given.join(_planted(spark, sf_dir), "question_id").withColumn("noul", F.when(F.col("planted"), 1.5).otherwise(F.col("noul"))).drop("planted"), "noul").select("question_id", "error")


def _planted(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("question_id"))
    return o.withColumn("planted", proxy.chance(F.lit("noul"), F.col("question_id")) % 101 == 0)


# --- scorer ----------------------------------------------------------------------------------


_JSON_SEGMENT = """'{"end": ' || e || ', "id": "' || id || '", "source": ' || to_json(source) || ', "start": ' || s || ', "text": ' || to_json(text) || ', "uncertain": ' || uncertain || '}'"""
_QUESTIONS_JSON = json.dumps({k: {"type": "noul", "instructions": q, "criteria": {"true": yes, "false": no}} for k, (q, yes, no) in QUESTION_TEXTS.items()}, sort_keys=True, ensure_ascii=False).replace("'", "''")
_REQUESTS = f"""sj as (select meeting_id, block, {_JSON_SEGMENT} as j, row_number() over (partition by meeting_id, block order by rn) as a, row_number() over (partition by meeting_id, block order by rn desc) as z, rn from blk),
bj as (select meeting_id, block, string_agg(j, ', ' order by rn) as target, string_agg(j, ', ' order by rn) filter (a <= 2) as head, string_agg(j, ', ' order by rn) filter (z <= 2) as tail from sj group by meeting_id, block),
rq as (select meeting_id, block, '{{"model": "model", "questions": {_QUESTIONS_JSON}, "state": {{"after": [' || coalesce(lead(head) over w, '') || '], "before": [' || coalesce(lag(tail) over w, '') || '], "purpose": "{PURPOSE}", "target": [' || target || ']}}}}' as payload from bj window w as (partition by meeting_id order by block))"""


@query(_with(_BLOCKS, _REQUESTS) + "select meeting_id, block::varchar as unit_id, length(payload)::int as payload_chars, sha256(payload) as digest from rq")
def payload_digest(spark, sf_dir):
    return pipelines.block_units(_blocked(spark, sf_dir), "model").select("meeting_id", F.col("block").cast("string").alias("unit_id"), "payload_chars", "digest")


_PARENT_JSON = json.dumps({"true": PARENT_TRUE, "false": PARENT_FALSE}, sort_keys=True)


_PARENT_REQUESTS = f"""pj as (select ctx.meeting_id, ctx.m, '{{' || string_agg('"' || ctx.id || '": ' || to_json(seg.text), ', ' order by ctx.id) || '}}' as transcript,
  '{{' || string_agg('"' || ctx.id || '": {{"criteria": {_PARENT_JSON}, "instructions": {{"question": "{PARENT_QUESTION}", "target_id": "' || ctx.id || '", "target_text": ' || to_json(seg.text) || '}}, "type": "noul"}}', ', ' order by ctx.id) filter (is_target) || '}}' as questions from ctx join seg using (meeting_id, id) group by all),
pp as (select meeting_id, m, '{{"model": "model", "questions": ' || questions || ', "state": {{"context_note": "{PARENT_NOTE}", "screening_rule": "{PARENT_RULE.replace("'", "''")}", "transcript": ' || transcript || '}}}}' as payload from pj)"""


@query(_with(_PARENTS, _PARENT_REQUESTS) + "select meeting_id, printf('P%02d', m + 1) as unit_id, length(payload)::int as payload_chars, sha256(payload) as digest from pp")
def parent_requests(spark, sf_dir):
    return pipelines.parent_requests(proxy.segments(spark, sf_dir), "model").drop("payload", "asked")


_BAD_BLOCK = "(meeting_id * 13 + block) % 7"
_LONG = "seg as (select * exclude (text), case when h % 23 = 0 then text || repeat('x', 17000) else text end as text from seg0)"


def _with_long(*ctes: str) -> str:
    return "with recursive " + proxy.SQL.strip().replace("seg as (", "seg0 as (") + f", {_LONG},\n" + ",\n".join([_BLOCKS, *ctes]) + "\n"


def _long(spark, sf_dir):
    """Some segments are so long that a request about them is too long to be sent."""
    s = proxy.segments(spark, sf_dir)
    return s.withColumn("text", F.when(F.col("h") % 23 == 0, F.concat("text", F.lit("x" * 17000))).otherwise(F.col("text")))


@query(_with_long(_SCORED, _REQUESTS, f"""fr as (select sc2.*, length(payload) as payload_chars, case when uncertain then 'explicit_transcription_uncertainty' when length(payload) > 18000 then 'oversized_keep_for_review'
  when {_BAD_BLOCK} < 5 then 'service_error_keep_for_review' else 'judged' end as reason from sc2 join rq using (meeting_id, block))""") + f"select meeting_id, block, payload_chars::int as payload_chars, reason, not (reason = 'judged' and {_RULE}) as keep from fr")
def fail_open_blocks(spark, sf_dir):
    """Of seven blocks one has an answer above 1, one NaN, one of another type, one lacks a question,
    one has an error; some requests are too long."""
    blocked = tables.written(blocks.greedy_blocks(_long(spark, sf_dir)), "blocked")
    k = (F.col("meeting_id") * 13 + F.col("block")) % 7
    first = F.col("question") == "action"
    p = F.when(F.col("question") != "chatter", F.col("p") / 4).when(F.col("block") % 2 == 0, 0.95).otherwise(F.col("p"))
    given = proxy.block_scores(blocked, QUESTIONS).where(~(first & (k == 3))).withColumns({
        "p": F.when(first & (k == 0), 1.5).when(first & (k == 1), float("nan")).otherwise(p),
        "type": F.when(first & (k == 2), "score").otherwise("noul"), "error": F.when(k == 4, "status 500"),
    })
    return pipelines.block_records(blocked, given).select("meeting_id", "block", "payload_chars", "reason", "keep")


_BAD_PARENTS = _PARENTS + """,
fl as (select tm.*, bool_or(h % 31 in (0, 1, 2, 3)) over (partition by meeting_id, m) as bad from tm), vt as (select meeting_id, id, case when not bad then p end as p from fl)"""
_VALID_TH = _threshold("(select meeting_id as g, p from vt)")


@query("with recursive " + proxy.SQL.strip() + ",\n" + _BAD_PARENTS + ",\n" + _VALID_TH + """ select v.meeting_id, id, v.p, coalesce(v.p > threshold, false) as candidate_remove, case when v.p is null then 'service_failure_keep' when threshold is null then 'no_clear_document_gap_keep' when v.p > threshold then 'above_document_adaptive_threshold' else 'below_document_adaptive_threshold_keep' end as reason from vt v left join th on g = v.meeting_id""")
def fail_open_parents(spark, sf_dir):
    """Some answers are above 1, NaN, of another type or lacking: their parents keep all."""
    s = proxy.segments(spark, sf_dir)
    k = F.col("h") % 31
    given = s.where(k != 3).select("meeting_id", "id", F.when(k == 0, 1.7).when(k == 1, float("nan")).otherwise(F.col("p")).alias("p"), F.when(k == 2, "score").otherwise("noul").alias("type"))
    return pipelines.screen_parents(s, given)["judgments"]


@query(_with("rq as (select meeting_id, id, sha256(text) as digest, h from seg), ca as (select distinct digest from rq where h % 4 = 0)") + "select meeting_id, id, digest in (select digest from ca) as hit from rq")
def cache_split(spark, sf_dir):
    s = proxy.segments(spark, sf_dir).select("meeting_id", "id", F.sha2("text", 256).alias("digest"), "h")
    hit, miss = scoring.cache_split(s.drop("h"), s.where("h % 4 = 0").select("digest").distinct())
    return hit.select("meeting_id", "id", F.lit(True).alias("hit")).unionByName(miss.select("meeting_id", "id", F.lit(False).alias("hit")))


# --- the scoring loop --------------------------------------------------------------------------

_FAULTS = 9
_ERRORS = ("http 500", "not_json", "no_answers", "not_a_number", "question_ids_differ", "type_differs", "out_of_range")
_MD5 = lambda q: f"(('0x' || substr(md5('{q}:' || d), 1, 6))::bigint % 1000) / 1000.0::double"
_ASKED = f"""un as (select bl.meeting_id, bl.block, bl.uncertain, length(payload) as n, sha256(payload) as d from bl join rq on rq.meeting_id = bl.meeting_id and rq.block = bl.block),
an as (select *, not uncertain and n <= 18000 as sendable, ('0x' || substr(d, 1, 2))::bigint % {_FAULTS} as k, case when ('0x' || substr(d, 3, 1))::bigint % 2 = 0 then 0.95::double else {_MD5("chatter")} end as chatter, {", ".join(f"{_MD5(q)} / 4 as {q}" for q in QUESTIONS if q != "chatter")} from un),
al as (select *, case k {" ".join(f"when {i} then '{e}'" for i, e in enumerate(_ERRORS))} end as err, row_number() over (partition by d, sendable order by meeting_id, block) as turn from an)"""


def _spoken(spark, sf_dir):
    """Segments as a transcript brings them."""
    return _long(spark, sf_dir).select("meeting_id", "ordinal", "start", "end", "text", "source", "uncertain")


@query(_with_long(_REQUESTS, _ASKED, "held as (select distinct d from al where sendable and err is null and meeting_id % 3 = 0)") + f"""select meeting_id, block, case when sendable then err end as error, coalesce(sendable and err is null and (turn > 1 or d in (select d from held)), false) as cache_hit,
  case when uncertain then 'explicit_transcription_uncertainty' when n > 18000 then 'oversized_keep_for_review' when err is not null then 'service_error_keep_for_review' else 'judged' end as reason,
  case when sendable and err is null then n::bigint end as input_tokens, not (sendable and err is null and {_RULE}) as keep from al""")
def scoring_loop(spark, sf_dir):
    """Every third meeting has been screened before, with the same cache; of nine answers seven are
    failures, each of another kind."""
    raw, cache = _spoken(spark, sf_dir), tables.new_path(spark, "cache")
    scorer = proxy.local_scorer(_FAULTS)
    pipelines.screen_blocks(raw.where("meeting_id % 3 = 0"), scorer, cache)
    records = pipelines.screen_blocks(raw, scorer, cache)["records"]
    return records.select("meeting_id", "block", "error", F.coalesce("cache_hit", F.lit(False)).alias("cache_hit"), "reason", "input_tokens", "keep")


_RUNS = ("meeting_id % 3 = 0", "true", "true")


@query(_with_long(_REQUESTS, _ASKED, "rn as (select * from (values " + ", ".join(f"({i + 1})" for i in range(len(_RUNS))) + ") t(run))", f"""fi as (select d, min(case when {_RUNS[0]} then 1 else 2 end) as run from al where sendable group by d)""") + f"""
select run, count(*) as blocks, count(*) filter (sendable) as answered, count(distinct case when sendable and fi.run = rn.run then al.d end) as sent from rn join al on rn.run > 1 or {_RUNS[0]} left join fi on fi.d = al.d and sendable group by rn.run""".replace("select run", "select rn.run as run", 1))
def asked_by_run(spark, sf_dir):
    """Three runs with one cache and a scorer that never fails: one on every third meeting, two on
    all. The last sends nothing."""
    raw, cache, out = _spoken(spark, sf_dir), tables.new_path(spark, "cache"), None
    for i, which in enumerate(_RUNS):
        records = pipelines.screen_blocks(raw.where(which), proxy.local_scorer(), cache)["records"]
        row = records.agg(F.lit(i + 1).alias("run"), F.count("*").alias("blocks"), F.count_if("responded").alias("answered"), F.count_if(F.col("responded") & ~F.col("cache_hit")).alias("sent"))
        out = row if out is None else out.unionByName(row)
    return out


#: Bodies with the questions a and b, where {p} is a number; the error each gives; what b scores.
_BODIES = (
    ('{"answers": {"a": {"type": "noul", "noul": {p}}, "b": {"type": "noul", "noul": 1}}, "usage": {"input_tokens": 7}, "model": "m"}', None, "1"),
    ('{"answers": {"b": {"noul": {p}, "type": "noul"}, "a": {"type": "noul", "noul": {p}, "more": [1]}}}', None, "p"),
    ('{"answers": {"a": {"type": "noul", "noul": {p}}, "b": {"type": "noul", "noul": true}}, "usage": null}', None, "1"),
    ("no JSON {p}", "not_json", None),
    ('{"answers": {"a": {"type": "noul", "noul": {p}}, "b": {"type": "noul", "noul": 0}}} and {p}', "not_json", None),
    ('{"error": {p}}', "no_answers", None),
    ('{"answers": [{p}]}', "no_answers", None),
    ('["answers", {p}]', "no_answers", None),
    ('{"answers": {"a": {"type": "noul", "noul": {p}}}}', "question_ids_differ", None),
    ('{"answers": {"a": {"type": "noul", "noul": {p}}, "b": {"type": "noul", "noul": 0}, "c": {"type": "noul", "noul": 0}}}', "question_ids_differ", None),
    ('{"answers": {"a": {"type": "score", "noul": {p}}, "b": {"type": "noul", "noul": 0}}}', "type_differs", None),
    ('{"answers": {"a": {"noul": {p}}, "b": {"type": "noul", "noul": 0}}}', "type_differs", None),
    ('{"answers": {"a": {p}, "b": {"type": "noul", "noul": 0}}}', "type_differs", None),
    ('{"answers": {"a": {"type": "noul", "noul": "{p}"}, "b": {"type": "noul", "noul": 0}}}', "not_a_number", None),
    ('{"answers": {"a": {"type": "noul", "noul": {p}}, "b": {"type": "noul", "noul": null}}}', "not_a_number", None),
    ('{"answers": {"a": {"type": "noul", "noul": {p}}, "b": {"type": "noul", "noul": [0]}}}', "not_a_number", None),
    ('{"answers": {"a": {"type": "noul", "noul": {p}}, "b": {"type": "noul", "noul": 1.0001}}}', "out_of_range", None),
    ('{"answers": {"a": {"type": "noul", "noul": {p}}, "b": {"type": "noul", "noul": -1e-9}}}', "out_of_range", None),
)
_NB = len(_BODIES)


@query(f"""with o as (select o_orderkey as k, o_orderkey % {_NB + 2} as kind, (o_orderkey % 1001) / 1000.0::double as p from orders), e as (select *, case kind {" ".join(f"when {i} then '{e}'" for i, (_, e, _) in enumerate(_BODIES) if e)} when {_NB} then 'no_response' when {_NB + 1} then 'http 503' end as error from o)
select k as unit_id, error, case when error is null then p end as a, case when error is null then case kind {" ".join(f"when {i} then {b}" for i, (_, _, b) in enumerate(_BODIES) if b)} end::double end as b, case when error is null then case when kind = 0 then 7 else 0 end end::bigint as input_tokens, case when kind = 0 then 'm' end as answered_by, case when error is null then 'success' when kind = {_NB + 1} then 'http_error' else 'network_or_response_error' end as last_attempt, case when kind = {_NB + 1} then 3 else 1 end::int as attempts from e""")
def raw_answers(spark, sf_dir):
    """Bodies as a scorer may send them, right ones and others, to scores and errors."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("unit_id"))
    kind, p = F.col("unit_id") % (_NB + 2), ((F.col("unit_id") % 1001) / F.lit(1000).cast("double")).cast("string")
    body = F.replace(F.get(F.array(*(F.lit(b) for b, _, _ in _BODIES)), kind.cast("int")), F.lit("{p}"), p)
    tried = lambda status, code: F.struct(F.lit(status).alias("status"), F.lit(code).cast("int").alias("code"))
    attempts = F.when(kind == _NB + 1, F.array_repeat(tried("http_error", 503), 3)).when(kind == _NB, F.array(tried("network_or_response_error", None))).otherwise(F.array(tried("success", None)))
    got = asking.answers(o.select("unit_id", body.alias("body"), attempts.alias("attempts")), F.array(F.lit("a"), F.lit("b")))
    return got.select("unit_id", "error", F.col("scores")["a"].alias("a"), F.col("scores")["b"].alias("b"), "input_tokens", "answered_by", F.get("attempts", F.size("attempts") - 1)["status"].alias("last_attempt"), F.size("attempts").alias("attempts"))


# --- the record of a run -----------------------------------------------------------------------

_DIGESTS = """pd as (select meeting_id, m, sha256(payload) as d from pp), kd as (select *, ('0x' || substr(d, 1, 2))::bigint as x from pd)"""
_LOOP_TH = _threshold("(select meeting_id as g, p from vl)")


@query("with recursive " + proxy.SQL.strip() + ",\n" + ",\n".join([_PARENTS, _PARENT_REQUESTS, _DIGESTS, f"""vl as (select ctx.meeting_id, ctx.id, case when x % {_FAULTS} >= 7 then (('0x' || substr(md5(ctx.id || ':' || d), 1, 6))::bigint % 1000) / 1000.0::double end as p from ctx join kd on kd.meeting_id = ctx.meeting_id and kd.m = ctx.m where is_target)""", _LOOP_TH]) + """ select v.meeting_id, id, v.p, coalesce(v.p > threshold, false) as candidate_remove, case when v.p is null then 'service_failure_keep' when threshold is null then 'no_clear_document_gap_keep' when v.p > threshold then 'above_document_adaptive_threshold' else 'below_document_adaptive_threshold_keep' end as reason from vl v left join th on g = v.meeting_id""")
def parent_loop(spark, sf_dir):
    """Parents asked of a scorer of whose nine kinds of answers seven are failures."""
    s = tables.written(proxy.segments(spark, sf_dir), "segments")
    return pipelines.review_parents(s, proxy.local_scorer(_FAULTS), tables.new_path(spark, "run"))["judgments"]


@query(_with(_PARENTS, _PARENT_REQUESTS, _DIGESTS) + f"""select 1 as run, count(distinct d) as asked, count(distinct case when x % {_FAULTS} < 3 then d end) as failed from kd
union all select 2, count(distinct d), 0 from kd where x % {_FAULTS} < 3 union all select 3, 0, 0""")
def resumed_run(spark, sf_dir):
    """A run of which some calls fail, the same again with a scorer that has recovered, and once
    more: what each has asked, by the responses it has added."""
    s, path = tables.written(proxy.segments(spark, sf_dir), "segments"), tables.new_path(spark, "run")
    for scorer in (proxy.local_scorer(_FAULTS, (0, 1, 2)), proxy.local_scorer(), proxy.local_scorer()):
        pipelines.review_parents(s, scorer, path)
    got = log.read(spark, path, "responses").join(record.requests(spark, path).groupBy("digest").agg(F.first("asked").alias("asked")), "digest")
    runs = asking.answers(got, F.col("asked")).groupBy("added").agg(F.count("*").alias("asked"), F.count("error").alias("failed"))
    numbered = runs.withColumn("run", F.row_number().over(Window.orderBy("added"))).select("run", "asked", "failed")  # a row for each run
    return numbered.unionByName(spark.range(1).select(F.lit(3).alias("run"), F.lit(0).cast("long").alias("asked"), F.lit(0).cast("long").alias("failed")).join(numbered, "run", "left_anti"))


# --- documents as files ------------------------------------------------------------------------

_SOME = "meeting_id % 3 > 0 and h % 2 = 0"


@query(_with(_JUDGED, _REVIEW, f"jl as (select *, {_LINE} as line from jg)", f"""gg as (select meeting_id, string_agg(line, chr(10) || chr(10) order by s, e, ordinal) as every, coalesce(string_agg(line, chr(10) || chr(10) order by s, e, ordinal) filter ({_SOME}), '') as chosen,
  coalesce(string_agg(line, chr(10) || chr(10) order by s, e, ordinal) filter (not gone), '') as kept, coalesce(string_agg(line, chr(10) || chr(10) order by s, e, ordinal) filter (gone), '') as gone from jl group by meeting_id)""",
  f"""doc as (select 'blocks' as flow, meeting_id, 'transcript' as name, every || chr(10) as document from gg union all select 'blocks', meeting_id, 'selected', chosen || chr(10) from gg
  union all select 'blocks', meeting_id, 'full_prompt', '{PROMPT}{FULL_HEADING}' || chr(10) || chr(10) || every || chr(10) from gg
  union all select 'blocks', meeting_id, 'selected_prompt', '{PROMPT}{SELECTED_HEADING}' || chr(10) || chr(10) || case when chosen = '' then '{NOTHING_SELECTED}' else chosen end || chr(10) from gg
  union all select 'parents', meeting_id, 'full', every || chr(10) from gg union all select 'parents', meeting_id, 'selected', kept || chr(10) from gg union all select 'parents', meeting_id, 'removed', gone || chr(10) from gg
  union all select 'parents', meeting_id, 'deletion_review', review from ({_REVIEW_ROWS}))""") + "select flow, meeting_id::varchar as meeting_id, name || '.md' as name, strlen(document)::bigint as size, sha256(document) as sha256 from doc")
def named_documents(spark, sf_dir):
    """The eight documents of the two flows, written to a file each and read back."""
    s, j = _judged(spark, sf_dir)
    chosen, gone = select.split(s, j)
    flow = {"selected": chosen, "removed": gone, "review": select.review_frame(s, j), "thresholds": decide.adaptive_threshold(s.select("meeting_id", "p"))}
    out = None
    for name, documents in (("blocks", pipelines.texts(s, s.where(_SOME))), ("parents", pipelines.review_texts(s, flow))):
        path = tables.new_path(spark, name)
        files.write_documents(documents, path)
        got = files.read_files(spark, path).select(F.lit(name).alias("flow"), F.col("folder").alias("meeting_id"), "name", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))
        out = got if out is None else out.unionByName(got)
    return out


@query("select conv_id::varchar || '-' || turn as name, strlen(text)::bigint as size, sha256(text) as sha256, sha256(text) as kept_sha256 from conversations")
def kept_sources(spark, sf_dir):
    """Turns as files, copied byte for byte, and their hashes before and after."""
    c, path = spark.read.parquet(f"{sf_dir}/conversations.parquet"), tables.new_path(spark, "sources")
    files.write_files(c.select(F.col("conv_id").cast("string").alias("folder"), F.concat_ws("-", "conv_id", "turn").alias("name"), F.encode("text", "UTF-8").alias("content")), path)
    kept = files.keep_sources(spark, f"{path}/*", f"{path}-kept")
    copied = files.read_files(spark, f"{path}-kept").select("name", F.sha2("content", 256).alias("kept_sha256"))
    return kept.select("name", "size", "sha256").join(copied, "name")


# --- answers to groups of questions ------------------------------------------------------------

_KINDS = ("choice", "score", "noul")
_GROUPS = 40
#: Keys of orders in a part of the responses, so that none grows with the table.
_PART = 24_000


def _answered(spark, sf_dir):
    """Orders as questions of three kinds, and a response, in parts, for each group of them: some
    answers are not as asked for, some groups lack one, some have no answers, and some no response."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("question_id"), F.get(F.array(*map(F.lit, _KINDS)), (F.col("o_orderkey") % 3).cast("int")).alias("kind"), (F.col("o_custkey") % _GROUPS).alias("g"), F.floor(F.col("o_orderkey") / _PART).alias("part"))
    h = F.col("h")
    a, b = (h % 40) / F.lit(100).cast("double"), (F.floor(h / 40) % 60) / F.lit(100).cast("double")
    c = F.round(1 - a - b, 2)
    words, levels = F.array(*map(F.lit, ("low", "mid", "top"))), F.array(*map(F.lit, ("0", "1", "2")))
    of = lambda x: F.to_json(F.struct(*(v.alias(k) for k, v in x.items())))
    kind = F.when(h % 79 == 0, F.lit("other")).otherwise(F.col("kind"))
    best = F.when((a >= b) & (a >= c), "low").when(b >= c, "mid").otherwise("top")
    shares = lambda names: F.struct(*(p.alias(n) for n, p in zip(names, (a, b, c), strict=True)))
    sure = a + F.when(h % 83 == 0, 1.0).otherwise(0.0)
    answer = (
        F.when(F.col("kind") == "noul", of({"type": kind, "noul": F.when(h % 101 == 0, 1.5).otherwise(h % 1000 / F.lit(1000).cast("double"))}))
        .when(F.col("kind") == "choice", of({"type": kind, "choice": F.when(h % 97 == 0, F.lit("none")).otherwise(best), "confidence": sure, "probabilities": shares(("low", "mid", "top"))}))
        .otherwise(of({"type": kind, "score": b + 2 * c + F.when(h % 89 == 0, 0.5).otherwise(0.0), "confidence": sure, "probabilities": shares(("0", "1", "2"))}))
    )
    rows = o.withColumn("h", proxy.chance(F.col("kind"), F.col("question_id"))).withColumn("group_id", F.concat_ws("-", "kind", "g")).withColumn("answer", answer)
    expected = F.when(F.col("kind") == "noul", F.when(h % 2 == 0, "true").otherwise("false")).when(F.col("kind") == "choice", F.concat(F.lit('"'), F.get(words, (h % 3).cast("int")), F.lit('"'))).otherwise((h % 3).cast("string"))
    labels = F.when(F.col("kind") == "choice", words).when(F.col("kind") == "score", levels).otherwise(F.array().cast("array<string>"))
    questions = rows.select("group_id", "kind", "question_id", labels.alias("labels"), F.parse_json(expected).alias("expected"))
    # of every ninth group the answer with the least id is lacking; the output counts in the first part
    of_group = rows.groupBy("group_id").agg(F.min("question_id").alias("least"), F.min("part").alias("first"))
    lacking = (F.col("g") % 9 == 3) & (F.col("question_id") == F.col("least"))
    pair = F.struct("question_id", F.concat(F.lit('"'), "question_id", F.lit('": '), "answer").alias("json"))
    one = rows.join(of_group, "group_id").groupBy("group_id", "g", "part", "first").agg(F.array_sort(F.collect_list(F.when(~lacking, pair))).alias("o"), F.count("*").alias("n"))
    given = F.transform("o", lambda x: x["json"])
    body = F.concat(F.lit('{"answers": {'), F.array_join(given, ", "), F.lit('}, "usage": {"input_tokens": '), F.col("n") * 10, F.lit(', "output_tokens": '), F.when(F.col("part") == F.col("first"), 3).otherwise(0), F.lit("}}"))
    body = F.when(F.col("g") % 9 == 5, '{"error": "busy"}').when(F.col("g") % 9 != 7, body)
    return questions, one.select("group_id", body.alias("body"), (F.col("g") + F.lit(0.5)).cast("double").alias("elapsed_ms"))


_EVALUATED = f"""q as (select o_orderkey::varchar as question_id, [{', '.join(map(repr, _KINDS))}][o_orderkey % 3 + 1] as kind, o_custkey % {_GROUPS} as g from orders),
hq as (select *, kind || '-' || g as group_id, ('0x' || substr(md5(kind || ':' || question_id), 1, 6))::bigint as h from q),
pq as (select *, (h % 40) / 100.0::double as a, (h // 40 % 60) / 100.0::double as b, round(1 - (h % 40) / 100.0::double - (h // 40 % 60) / 100.0::double, 2) as c from hq),
bq as (select *, case when a >= b and a >= c then 0 when b >= c then 1 else 2 end as best, a + case when h % 83 = 0 then 1 else 0 end as sure, b + 2 * c + case when h % 89 = 0 then 0.5::double else 0.0::double end as score, case when h % 101 = 0 then 1.5::double else (h % 1000) / 1000.0::double end as noul from pq),
eq as (select *, case when g % 9 = 7 then 'no_response' when g % 9 = 5 then 'no_answers' when g % 9 = 3 then 'question_ids_differ' when h % 79 = 0 then 'type_differs' when kind = 'noul' then case when noul > 1 then 'noul_out_of_range' end
  when a > 1 or b > 1 or c > 1 or c < 0 then 'probability_out_of_range' when sure > 1 then 'confidence_out_of_range' when kind = 'choice' then case when h % 97 = 0 then 'choice_is_not_the_most_likely' end when score > 2 then 'score_out_of_range' when h % 89 = 0 then 'score_is_not_the_mean' end as error,
  case kind when 'noul' then (h % 2 = 0)::varchar when 'choice' then ['low', 'mid', 'top'][h % 3 + 1] else (h % 3)::varchar end as expected, case kind when 'noul' then (noul >= 0.5)::varchar when 'choice' then ['low', 'mid', 'top'][best + 1] else best::varchar end as says, case kind when 'noul' then noul when 'choice' then greatest(a, b, c) else score end as v from bq),
ev as (select group_id, g, kind, question_id, error, expected, case when error is null then says end as observed, case when error is null then v end as value, case when error is null then says = expected end as matches_expected from eq)"""


@query("with " + _EVALUATED + " select * exclude (g) from ev")
def evaluated_answers(spark, sf_dir):
    return evaluate.evaluated(*_answered(spark, sf_dir)).drop("input_tokens", "output_tokens", "elapsed_ms")


@query("with " + _EVALUATED + """, gr as (select group_id, g, count(*) as n, count(error) as errors, count(*) filter (matches_expected) as matches from ev group by group_id, g)
select count(*) as requests, sum(n)::bigint as questions, sum(errors)::bigint as errors, sum(matches)::bigint as matches, sum(case when g % 9 in (5, 7) then 0 else n * 10 end)::bigint as input_tokens, sum(case when g % 9 in (5, 7) then 0 else 3 end)::bigint as output_tokens, round(sum(g + 0.5::double), 2) as total_ms, median(g + 0.5::double) as median_ms, sum(case when g % 9 in (5, 7) then 0 else n * 10 end) / 1e6::double * 0.042::double as cost from gr""")
def evaluation_summary(spark, sf_dir):
    return evaluate.evaluation_summary(evaluate.evaluated(*_answered(spark, sf_dir)))


# --- whole layout, media -------------------------------------------------------------------------


@query(_with(_PARENTS, """pr as (select par.meeting_id, par.m, (par.meeting_id * 7 + par.m) % 11 as k, par.n from par)""") + """
select 'order_differs' as "check", count(distinct meeting_id) filter (k = 1 and n > 1 or k = 2)::bigint as violations from pr
union all select 'text_changed', count(distinct meeting_id) filter (k = 1 and n > 1 or k in (2, 3, 4)) from pr
union all select 'questions_differ', count(*) filter (k = 3) from pr
union all select 'target_not_in_context', count(*) filter (k = 5) from pr
union all select 'text_differs', count(*) filter (k in (3, 4)) from pr""")
def request_faults(spark, sf_dir):
    """Of eleven requests one has its targets in reverse, one lacks its first target, one does not ask
    about it, one asks about another text, and one lacks it in the transcript."""
    s = proxy.segments(spark, sf_dir)
    rows = parents.parent_context(s).join(s.select("meeting_id", "id", "text"), ["meeting_id", "id"])
    item = F.struct("id", "text")
    one = rows.groupBy("meeting_id", "m").agg(F.array_sort(F.collect_list(item)).alias("c"), F.array_sort(F.collect_list(F.when(F.col("is_target"), item))).alias("t"))
    k = (F.col("meeting_id") * 7 + F.col("m")) % 11
    rest = F.slice("t", 2, F.greatest(F.size("t"), F.lit(1)))
    first = F.get("t", F.lit(0))
    asked = F.when(k == 1, F.reverse("t")).when(k == 2, rest).otherwise(F.col("t"))
    told = F.when(k.isin(2, 3), rest).when(k == 4, F.concat(F.array(F.struct(first["id"].alias("id"), F.concat(first["text"], F.lit("!")).alias("text"))), rest)).otherwise(F.col("t"))
    context = F.when(k == 5, F.filter("c", lambda x: x["id"] != first["id"])).otherwise(F.col("c"))
    payload = scoring.parent_payload("model", told, context)
    return parents.request_violations(s, one.select("meeting_id", F.format_string("P%02d", F.col("m") + 1).alias("unit_id"), F.transform(asked, lambda x: x["id"]).alias("asked"), payload.alias("payload")))


@query(_with() + """select unnest(['order_differs', 'text_changed', 'questions_differ', 'target_not_in_context', 'text_differs']) as "check", 0::bigint as violations from (select count(*) from seg)""")
def request_layout(spark, sf_dir):
    """The requests that are made have none of these faults."""
    s = proxy.segments(spark, sf_dir)
    return parents.request_violations(s, pipelines.parent_requests(s, "model"))


@query("""with f as (select c_custkey::varchar as media, c_custkey % 4 as kind, 1 + c_custkey % 6 as channels, (8000 + 100 * (c_custkey % 411))::int as rate, c_custkey % 977 as n from customer)
select media, case kind when 0 then (n * 2 * channels) / (rate * 2 * channels)::double when 1 then n / 1000.0::double when 2 then n / 1000.0::double end as duration_seconds, 0 as audio_index, case when kind = 2 then 1 else 0 end as stream_index,
  case kind when 0 then 'pcm_s16le' else 'aac' end as codec, channels::int as channels, rate as sample_rate from f where kind < 3""")
def media_tracks(spark, sf_dir):
    """Customers as files: a WAV with a chunk before its format; an MP4 whose tracks come after its
    data; one with a video track before the sound; and what is no media file."""
    k = F.col("c_custkey")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.cast("string").alias("media"), (k % 4).alias("kind"), (1 + k % 6).alias("channels"), (8000 + 100 * (k % 411)).alias("rate"), (k % 977).alias("n"))
    # bytes of a file and how many they are; boxes of a fixed size have it as a literal
    hexed = lambda x, n: F.lpad(F.hex((F.lit(x) if isinstance(x, int) else x).cast("long")), 2 * n, "0")
    big = lambda x, n: (F.unhex(hexed(x, n)), n)
    little = lambda x, n: (F.unhex(F.array_join(F.reverse(F.regexp_extract_all(hexed(x, n), F.lit("(..)"), 1)), "")), n)
    text = lambda x: (F.lit(x).cast("binary"), len(x))
    zeros = lambda n: (F.unhex(F.lit("00" * n)), n)
    filled = lambda n: F.unhex(F.repeat(F.lit("FF"), n.cast("int")))
    join = lambda *x: (F.concat(*(c for c, _ in x)), sum(n for _, n in x))
    box = lambda kind, *x: join(big(sum(n for _, n in x) + 8, 4), text(kind), *x)
    n, channels, rate = F.col("n"), F.col("channels"), F.col("rate")
    form = join(little(1, 2), little(channels, 2), little(rate, 4), little(rate * channels * 2, 4), little(channels * 2, 2), little(16, 2))
    wave = F.concat(join(text("RIFF"), little(100, 4), text("WAVE"), text("LIST"), little(3, 4), text("abc\0"), text("fmt "), little(16, 4), form, text("data"), little(n * channels * 2, 4))[0], filled(n * channels * 2))
    entry = lambda kind, code, *x: box("trak", box("mdia", box("hdlr", zeros(8), text(kind), zeros(12)), box("minf", box("stbl", box("stsd", zeros(4), big(1, 4), big(36, 4), text(code), *x)))))
    sound = entry("soun", "mp4a", zeros(6), big(1, 2), zeros(8), big(channels, 2), big(16, 2), zeros(4), big(rate, 2), zeros(2))
    head = box("mvhd", zeros(12), big(1000, 4), big(n, 4), zeros(80))
    late = F.concat(join(box("ftyp", text("M4A "), zeros(4)), big(n + 8, 4), text("mdat"))[0], filled(n), box("moov", head, sound)[0])
    both = F.concat(join(box("ftyp", text("isom"), zeros(4)), box("moov", head, entry("vide", "avc1", zeros(28)), sound), big(1, 4), text("mdat"), big(n + 16, 8))[0], filled(n))
    content = F.when(F.col("kind") == 0, wave).when(F.col("kind") == 1, late).when(F.col("kind") == 2, both).otherwise(text("ID3 and so on")[0])
    return media.audio_streams(media.from_bytes(c.select("media", content.alias("content"))))


# --- requests about turns ------------------------------------------------------------------------

_esc = lambda x: x.replace("'", "''")
_TURN_QUESTION = " || ', ' || ".join(
    f"""'"' || id || '_{d}": {{"criteria": {_esc(json.dumps({"true": yes, "false": no}, sort_keys=True, ensure_ascii=False))}, "instructions": "{TURN_HEAD}' || id || '`. {_esc(q)} {_esc(TURN_TAIL)}", "type": "noul"}}'""" for d, (q, yes, no) in sorted(DIMENSION_TEXTS.items())
)
_TURN_REQUESTS = f"""tj as (select meeting_id, string_agg({_TURN_QUESTION}, ', ' order by id) as questions, string_agg('"' || id || '": {{"speaker": ' || to_json(source) || ', "text": ' || to_json(text) || ', "timestamp": "' || {_CLOCK('s')} || '"}}', ', ' order by id) as turns from seg group by meeting_id),
tp as (select meeting_id, '{{"model": "model", "questions": {{' || questions || '}}, "state": {{"meeting_purpose": "{TURNS_PURPOSE}", "turns": {{' || turns || '}}}}}}' as payload from tj)"""


def _spoken_turns(spark, sf_dir):
    return proxy.segments(spark, sf_dir).select("meeting_id", F.col("id").alias("turn_id"), T.clock(F.col("start")).alias("timestamp"), F.col("source").alias("speaker"), "text", (F.col("h") % 3 != 0).alias("expected_keep"))


@query(_with(_TURN_REQUESTS) + "select meeting_id, length(payload)::int as payload_chars, sha256(payload) as digest from tp")
def turn_requests(spark, sf_dir):
    return pipelines.turn_requests(_spoken_turns(spark, sf_dir), "model", TURNS_PURPOSE).drop("payload", "asked")


_TURN_P = lambda d: f"case when x % {_FAULTS} >= 3 then (('0x' || substr(md5(turn_id || '_{d}' || ':' || d), 1, 6))::bigint % 1000) / 1000.0::double end as {d}"


@query(_with(_TURN_REQUESTS, _TURNS, "td as (select meeting_id, sha256(payload) as d, ('0x' || substr(sha256(payload), 1, 2))::bigint as x from tp)", f"ts as (select turns.*, {', '.join(map(_TURN_P, DIMENSIONS))} from turns join td using (meeting_id))") + "select meeting_id, turn_id, nonbusiness, coalesce(not (nonbusiness >= 0.9 and greatest(requirement, action, decision, unresolved) < 0.2), true) as keep from ts")
def turn_loop(spark, sf_dir):
    """Turns asked of a scorer that fails for some meetings, which keep all of theirs."""
    flow = pipelines.review_turns(_spoken_turns(spark, sf_dir), proxy.local_scorer(_FAULTS, (0, 1, 2)))
    return flow["turns"].select("meeting_id", "turn_id", "nonbusiness", "keep")
