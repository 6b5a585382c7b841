"""Frames of `tidemark.plans.datasets` as DuckDB SQL, composed by name into the twins."""
import re

from tidemark.functions.text import STOPWORDS

DAY, HOUR = 86400, 3600


def iso(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%dT%H:%M:%S')"


def strip(expression: str) -> str:
    return f"regexp_replace({expression}, '^\\s+|\\s+$', '', 'g')"


def sig(expression: str) -> str:
    return f"cast(printf('%.5e', {expression}) as double)"


def clean(expression: str) -> str:
    """The cleaning rules without look-behind and back references."""
    rules = [
        (r"(https?://\S+|www\.\S+)", " ", "g"), (r"(^|[^0-9A-Za-z_])@[0-9A-Za-z_]+", r"\1 ", "g"),
        (r"^\s*rt\b\s*:?\s*", "", ""), ("&amp;", "&", "g"), ("#([0-9A-Za-z_]+)", r"\1", "g"),
        ("!{2,}", "!", "g"), (r"\?{2,}", "?", "g"), (r"\.{2,}", ".", "g"), (r"\s+", " ", "g"),
    ]
    text = f"lower({expression})"
    for pattern, replacement, option in rules:
        tail = f", '{option}'" if option else ""
        text = f"regexp_replace({text}, '{pattern}', '{replacement}'{tail})"
    return f"trim({text}, ' ')"


def order_key(seed, *parts: str, tie: str) -> str:
    return f"md5(concat_ws('#', '{seed}', {', '.join(parts)})) || '#' || {tie}"


WORDS = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS)


def agreement(reference="is_reference", first="driftlens_alarm", second="mcddd_alarm") -> str:
    return (f"case when coalesce({reference}, false) then 'reference' when {second} is null then 'mcddd_missing' "
            f"when {first} and {second} then 'both' when {first} then 'driftlens_only' "
            f"when {second} then 'mcddd_only' else 'neither' end")


OVERLAP = ("case when driftlens_alarm and coalesce(mcddd_alarm, false) then 'both_alarm' when driftlens_alarm then "
           "'driftlens_only' when coalesce(mcddd_alarm, false) then 'mcddd_only' else 'both_no_alarm' end")

SCENARIO = ("case event_type when 'click' then 'sudden' when 'view' then 'gradual' when 'signup' then 'volume' "
            "when 'error' then 'no_drift' when 'purchase' then 'natural' else 'other' end")


def _score_rows(volumes: str, scenario: str, order: str, seconds: int) -> str:
    return f"""
select {scenario} window_id, position, {iso(f"make_timestamp(window_id * {seconds} * 1000000)")} as window_start,
  driftlens_score, driftlens_score > 0.052 as driftlens_alarm, cast(0.052 as double) as threshold,
  mcddd_score, mcddd_score > 1.9 as mcddd_alarm,
  cast(case when mcddd_score is not null then 1.9 end as double) as mcddd_threshold,
  case when mcddd_score is not null then cast(1 + top % 10 as integer) end as mcddd_lag,
  n as n_posts, least(n, 10) as n_used, position < 14 as is_reference, processing_latency_ms,
  round(n::double / (processing_latency_ms / 1e3), 2) as throughput_posts_per_sec
from (select *, ((cents * 20 + n) // (2 * n))::double / 1e6 as driftlens_score,
    case when position >= 14 and cents % 7 <> 0 then {sig("top::double / (cents::double / n::double)")} end as mcddd_score,
    round(n::double * 0.31::double + 0.5::double, 2) as processing_latency_ms
  from (select *, cast(row_number() over ({order}) - 1 as integer) as position from ({volumes})))"""


def _volumes(seconds: int, extra: str = "", by: str = "") -> str:
    return (f"select {extra} cast(floor(epoch(ts) / {seconds}) as bigint) as window_id, count(*) as n, "
            "cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents, max(cast(round(value * 100) as bigint)) as top "
            f"from events group by {by} window_id")


FRAMES = {
    "event_texts": """
select e.*, d.text, substr(cast(e.ts as varchar), 1, 19) as stamp
from (select *, event_id % (select count(*) from documents) as doc_key from events) e
join documents d on d.doc_id = e.doc_key""",
    "raw_rows": """
select case when value < 1 then null when value < 2 then 'nan' else substr(stamp, 1, 10) end as created_at,
  case when value >= 2 and value < 3 then '  ' || chr(9) || ' ' else '  ' || text || chr(10) end as original_text,
  event_id as row_number, value from event_texts""",
    "raw_posts": """
select created_at, original_text, cast(row_number as varchar) as row_index from raw_rows
union all
select created_at, original_text, cast(row_number + (select count(*) from events) as varchar)
from raw_rows where value >= 98 and value < 99""",
    "message_rows": """
select case when value < 99.5 then 'post_' || event_id end as post_id,
  case when value < 1 then 'not-a-date' when event_type = 'click' then replace(stamp, ' ', 'T')
    when event_type = 'purchase' then substr(stamp, 1, 10) else stamp end as timestamp,
  case when value >= 1 and value < 3 then '@u1 http://t.co/abc'
    else case event_type when 'view' then 'RT @u5: ' when 'click' then 'http://t.co/x ' when 'signup' then '#tag '
      when 'error' then '!!! &amp; ' else '' end || text end as text,
  event_type as source, value from event_texts""",
    "messages": """
select post_id, timestamp, text, source from message_rows
union all
select post_id, timestamp, text, source from message_rows where value >= 98 and value < 99""",
    "cleaned": f"""
select post_id, timestamp, source, {clean("text")} as text,
  try_strptime(trim(timestamp, ' '), ['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d']) as event_time
from messages""",
    "valid": """
select post_id, event_time, text, source from cleaned
where post_id is not null and event_time is not null and length(trim(text, ' ')) > 0""",
    "posts": """
select distinct post_id, event_time, text, source, cast(floor(epoch(event_time) / 86400) as bigint) as window_id,
  date_trunc('day', event_time) as window_start, date_trunc('day', event_time) + interval 1 day as window_end
from valid""",
    "vectors": """
select cast(floor(epoch(ts) / 86400) as bigint) as window_id, substr(cast(ts as varchar), 1, 10) as window_start,
  'post_' || event_id as post_id, embedding, label
from (select *, event_id % (select count(*) from embeddings) as vec_key from events) e
join embeddings v on v.vec_id = e.vec_key""",
    "scores": _score_rows(_volumes(HOUR), "", "order by window_id", HOUR),
    "day_scores": _score_rows(_volumes(DAY), "", "order by window_id", DAY),
    "scenario_scores": _score_rows(_volumes(DAY, SCENARIO + " as scenario,", "scenario,"), "scenario,",
                                   "partition by scenario order by window_id", DAY),
    "truth": f"""
select scenario, case when scenario <> 'natural' then scenario in ('sudden', 'gradual') end as concept_drift,
  case when scenario in ('sudden', 'gradual') then 20 end as drift_start,
  case scenario when 'sudden' then 20 when 'gradual' then 24 end as drift_end,
  case when scenario = 'volume' then 20 end as volume_change, case when scenario = 'volume' then 3 end as volume_factor
from (select distinct {SCENARIO} as scenario from events)""",
    "labelled": """
select s.*, t.concept_drift, t.drift_start, t.drift_end, t.volume_change, t.volume_factor,
  coalesce(t.concept_drift and s.position >= t.drift_start and s.position >= 14, false) as ground_truth_drift
from scenario_scores s join truth t using (scenario)""",
    "alarms": """
select *, 'driftlens' as detector, driftlens_alarm as alarm from labelled
union all
select *, 'mcddd' as detector, coalesce(mcddd_alarm, false) as alarm from labelled""",
    "score_inputs": """
select case when n <> 3 then window_id end as window_id,
  case when even and n <> 7 then window_start end as window_start, case when not even then window_start end as timestamp,
  case when n = 4 then 'n/a' when n <> 5 then cast(driftlens_score as varchar) end as driftlens_score,
  case when n <> 6 then driftlens_alarm end as driftlens_alarm,
  case when even then threshold end as threshold, case when not even then threshold end as driftlens_threshold,
  mcddd_score, mcddd_alarm, mcddd_threshold, mcddd_lag, case when even then n end as n_posts,
  case when not even then n end as post_count, n_used, is_reference, processing_latency_ms,
  case when n % 4 <> 0 then throughput_posts_per_sec end as throughput_posts_per_sec,
  case when even then round(n::double * 1.25::double, 2) end as cpu_pct
from (select *, n_posts as n, window_id % 2 = 0 as even from scores)""",
    "reasons": """
select *, case when window_id is null then 'missing window_id' when driftlens_score is null then 'missing driftlens_score'
  when try_cast(driftlens_score as double) is null then 'non-numeric driftlens_score'
  when driftlens_alarm is null then 'missing driftlens_alarm'
  when coalesce(window_start, timestamp) is null then 'missing timestamp' end as reject_reason
from score_inputs""",
    "normalised": f"""
select *, round(driftlens_score / nullif(driftlens_threshold, 0), 4) as driftlens_ratio,
  round(mcddd_score / nullif(mcddd_threshold, 0), 4) as mcddd_ratio,
  case agreement when 'reference' then 0 when 'neither' then 1 when 'driftlens_only' then 2 when 'mcddd_only' then 3
    when 'both' then 4 when 'mcddd_missing' then 5 else 1 end as agreement_code,
  case when coalesce(given, 0) <= 0 and processing_latency_ms > 0 and post_count > 0
    then round(post_count::double / (processing_latency_ms / 1e3), 2) else given end as throughput_posts_per_sec
from (select window_id, coalesce(window_start, timestamp) as window_start, cast(driftlens_score as double) as driftlens_score,
    coalesce(threshold, driftlens_threshold) as driftlens_threshold, driftlens_alarm, mcddd_score, mcddd_threshold,
    mcddd_alarm, mcddd_lag, {agreement()} as agreement, coalesce(n_posts, post_count, 0) as post_count, n_used, is_reference,
    processing_latency_ms, throughput_posts_per_sec as given, cpu_pct, cast(null as double) as mem_mb, 'cdd-stream' as pipeline
  from reasons where reject_reason is null)""",
    "tokens": f"""
select window_id, term from (select window_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from posts)
where length(term) >= 3 and term not in ({WORDS}) and not regexp_full_match(term, '[0-9]+')""",
    "counts": "select window_id, term, count(*) as n from tokens group by all",
    "pairs": """
select window_id, coalesce(lag(window_id) over (order by window_id), window_id) as before_window_id
from (select distinct window_id from day_scores)""",
    "shifts": """
select p.window_id, coalesce(a.term, b.term) as term, b.n as n_before, a.n as n_after from pairs p
join counts a on a.window_id = p.window_id
left join counts b on b.window_id = p.before_window_id and b.term = a.term
union all
select p.window_id, b.term, b.n, null from pairs p join counts b on b.window_id = p.before_window_id
where not exists (select 1 from counts a where a.window_id = p.window_id and a.term = b.term)""",
    "keyword_rows": """
select *, row_number() over (partition by window_id, direction order by round(abs(diff), 9) desc, term) as rank
from (select *, case when diff > 0 and count_after >= 2 then 'emerging' when diff < 0 and count_before >= 2 then 'fading' end as direction
  from (select s.window_id, s.term, coalesce(s.n_before, 0) as count_before, coalesce(s.n_after, 0) as count_after,
      coalesce(s.n_after, 0)::double / greatest(coalesce(ta.n, 0), 1)::double
        - coalesce(s.n_before, 0)::double / greatest(coalesce(tb.n, 0), 1)::double as diff
    from shifts s join pairs p using (window_id)
    left join (select window_id, count(*) as n from posts group by all) ta on ta.window_id = p.window_id
    left join (select window_id, count(*) as n from posts group by all) tb on tb.window_id = p.before_window_id))
where direction is not null""",
}
for _name, _source in (("compared", "scores"), ("day_compared", "day_scores")):
    FRAMES[_name] = f"""
select window_id, window_start, n_posts, is_reference, driftlens_score, threshold as driftlens_threshold,
  round(driftlens_score / nullif(threshold, 0), 4) as driftlens_ratio, driftlens_alarm,
  mcddd_score, mcddd_threshold, round(mcddd_score / nullif(mcddd_threshold, 0), 4) as mcddd_ratio, mcddd_alarm, mcddd_lag,
  {agreement()} as agreement from {_source}"""


def frames_of(body: str, found: list[str]) -> list[str]:
    """Frames a statement names, dependencies first."""
    for name in FRAMES:
        if name not in found and re.search(rf"\b(from|join)\s+{name}\b", body):
            frames_of(FRAMES[name], found)
            if name not in found:
                found.append(name)
    return found


def compose(body: str) -> str:
    names = frames_of(body, [])
    if not names:
        return body.strip()
    heads = ",\n".join(f"{n} as ({FRAMES[n].strip()})" for n in names)
    text = body.strip()
    if text.lower().startswith("with "):
        return f"with {heads},\n{text[5:]}"
    return f"with {heads}\n{text}"
