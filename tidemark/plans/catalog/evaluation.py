"""Comparison, evaluation and metric records over score rows."""
from pyspark.sql import functions as F

from tidemark.functions import scoring as sc
from tidemark.operators import compare as cmp, evaluate as ev
from tidemark.plans import datasets as ds
from tidemark.plans.catalog import query
from tidemark.plans.catalog import sql as twin
from tidemark.plans.catalog.ingestion import scratch
from tidemark.sinks import files, metrics
from tidemark.sources import scores as src

N = ds.N_REFERENCE


def _compared(spark, sf_dir):
    return cmp.compare(ds.scores(spark, sf_dir))


def _labelled(spark, sf_dir):
    return ev.label_windows(ds.scenario_scores(spark, sf_dir), ds.truth(spark, sf_dir), N)


def _usable(spark, sf_dir):
    good, _ = cmp.validate_scores(ds.score_inputs(spark, sf_dir))
    return cmp.normalise_scores(good.withColumn("driftlens_score", F.col("driftlens_score").cast("double")))


@query(sql="select * from compared")
def compare(spark, sf_dir):
    return _compared(spark, sf_dir)


@query(sql="select window_id, driftlens_ratio, mcddd_ratio from compared")
def ratio(spark, sf_dir):
    return ds.scores(spark, sf_dir).select(
        "window_id", sc.ratio(F.col("driftlens_score"), F.col("threshold")).alias("driftlens_ratio"),
        sc.ratio(F.col("mcddd_score"), F.col("mcddd_threshold")).alias("mcddd_ratio"))


@query(sql="select window_id, agreement from compared")
def classify_agreement(spark, sf_dir):
    from tidemark.functions.text import register_sql

    register_sql(spark)
    return ds.scores(spark, sf_dir).select(
        "window_id", F.expr("classify_agreement(is_reference, driftlens_alarm, mcddd_alarm)").alias("agreement"))


@query(sql="select window_id, agreement, agreement_code from normalised")
def agreement_code(spark, sf_dir):
    return _usable(spark, sf_dir).select("window_id", "agreement", sc.agreement_code(F.col("agreement")).alias("agreement_code"))


@query(sql=f"select event_id, {twin.sig('value / 1e7')} as rounded from events")
def sig(spark, sf_dir):
    return ds.table(spark, sf_dir, "events").select("event_id", sc.sig(F.col("value") / F.lit(1e7)).alias("rounded"))


@query(sql="select window_id, round(n_posts::double / (processing_latency_ms / 1e3), 2) as throughput from scores")
def throughput(spark, sf_dir):
    return ds.scores(spark, sf_dir).select(
        "window_id", F.round(sc.throughput(F.col("n_posts"), F.col("processing_latency_ms")), 2).alias("throughput"))


@query(sql="select window_id, case when driftlens_ratio > 1.3 or mcddd_ratio > 1.3 then 'abrupt' else 'gradual' end as change_type from compared")
def change_type(spark, sf_dir):
    return _compared(spark, sf_dir).select(
        "window_id", sc.change_type(F.col("driftlens_ratio"), F.col("mcddd_ratio")).alias("change_type"))


@query(sql="""
select window_id, case when driftlens_alarm and mcddd_alarm then printf('Both detectors agreed on drift. DriftLens FDD score (%.4f) exceeded its threshold by %.1f%%, while MCD-DD discrepancy (%.4f) exceeded its threshold by %.1f%%.',
    driftlens_score, (driftlens_ratio - 1) * 100, mcddd_score, (mcddd_ratio - 1) * 100)
  when driftlens_alarm then printf('DriftLens alarmed (ratio: %.2f) due to cumulative distribution shift away from the fixed April 2020 baseline. MCD-DD did not alarm (ratio: %.2f <= 1.0) because its 10-window rolling context adapts to gradual transitions.',
    driftlens_ratio, coalesce(mcddd_ratio, 0.0::double))
  when mcddd_alarm then printf('MCD-DD alarmed (ratio: %.2f) due to high discrepancy against its immediate contrastive context windows. DriftLens remained quiet (ratio: %.2f <= 1.0) because the sample distribution remained within its conservative p99 baseline boundary.',
    mcddd_ratio, driftlens_ratio)
  else 'Neither detector observed significant distribution movement beyond normal random variation.' end as sentence from compared""")
def rationale(spark, sf_dir):
    return _compared(spark, sf_dir).select("window_id", sc.rationale().alias("sentence"))


@query(sql="""
select window_id, window_start, driftlens_score, driftlens_threshold, driftlens_ratio, driftlens_alarm, mcddd_score, mcddd_threshold,
  mcddd_ratio, mcddd_alarm, mcddd_lag, agreement, agreement_code, post_count, n_used, is_reference, processing_latency_ms,
  throughput_posts_per_sec, cpu_pct, pipeline from normalised""")
def normalise_scores(spark, sf_dir):
    return _usable(spark, sf_dir).drop("mem_mb")


@query(sql="select window_id, driftlens_score, coalesce(reject_reason, 'usable') as verdict from reasons")
def validate_scores(spark, sf_dir):
    good, bad = cmp.validate_scores(ds.score_inputs(spark, sf_dir))
    columns = ["window_id", "driftlens_score"]
    return good.select(*columns, F.lit("usable").alias("verdict")).unionByName(
        bad.select(*columns, F.col("reject_reason").alias("verdict")))


@query(sql="select * from compared where not is_reference")
def stream_only(spark, sf_dir):
    return cmp.stream_only(_compared(spark, sf_dir))


@query(sql="""
select a.window_id, a.driftlens_score, a.driftlens_alarm, b.mcddd_score, b.mcddd_alarm from scores a
left join (select window_id, mcddd_score, mcddd_alarm from scores where not is_reference) b using (window_id)""")
def score_both(spark, sf_dir):
    rows = ds.scores(spark, sf_dir)
    first = rows.select("window_id", "driftlens_score", "driftlens_alarm")
    return cmp.score_both(first, cmp.stream_only(rows).select("window_id", "mcddd_score", "mcddd_alarm"))


@query(sql="select agreement, count(*) as windows from compared where not is_reference group by agreement")
def agreement_counts(spark, sf_dir):
    return cmp.agreement_counts(_compared(spark, sf_dir))


_SUMMARY = """
select count(*) as stream_windows, count(*) filter (driftlens_alarm) as driftlens_alarms, count(*) filter (mcddd_alarm) as mcddd_alarms,
  count(*) filter (agreement = 'both') as both, count(*) filter (agreement = 'driftlens_only') as driftlens_only,
  count(*) filter (agreement = 'mcddd_only') as mcddd_only, count(*) filter (agreement = 'neither') as neither,
  count(*) filter (agreement = 'mcddd_missing') as mcddd_missing,
  round(count(*) filter (agreement in ('both', 'neither'))::double / nullif(count(*) filter (mcddd_alarm is not null), 0)::double, 4) as agreement_rate,
  count(*) filter (agreement = 'both') || '/' || count(*) filter (agreement in ('both', 'mcddd_only')) as mcddd_alarms_also_flagged_by_driftlens
from compared where not is_reference"""


@query(sql=_SUMMARY)
def comparison_summary(spark, sf_dir):
    return cmp.comparison_summary(_compared(spark, sf_dir))


@query(sql="""
select substr(coalesce(window_start, ''), 1, 7) as month, count(*) as windows, count(*) filter (driftlens_alarm) as driftlens_alarms,
  count(*) filter (mcddd_alarm) as mcddd_alarms, round(median(driftlens_score), 7) as median_driftlens_score
from compared where not is_reference group by 1""")
def by_month(spark, sf_dir):
    return cmp.by_month(_compared(spark, sf_dir)).withColumn("median_driftlens_score", F.round("median_driftlens_score", 7))


@query(sql="""
select window_id, window_start, coalesce(lag(window_id) over w, window_id) as before_window_id,
  coalesce(lag(window_start) over w, window_start) as before_window_start, coalesce(lag(n_posts) over w, n_posts) as before_posts
from compared window w as (order by window_id)""")
def with_previous(spark, sf_dir):
    return cmp.with_previous(_compared(spark, sf_dir)).select(
        "window_id", "window_start", "before_window_id", "before_window_start", "before_posts")


IMPORTANT = """
select window_id, agreement, reason, class_rank from (select *, row_number() over (partition by agreement order by priority desc, window_id) as class_rank
  from (select *, case agreement when 'mcddd_only' then coalesce(mcddd_ratio, 0) when 'both' then round(coalesce(driftlens_ratio, 0) + coalesce(mcddd_ratio, 0), 4)
      when 'driftlens_only' then coalesce(driftlens_ratio, 0) else 0 end as priority,
    case agreement when 'mcddd_only' then 'mcddd_only_disagreement' when 'both' then 'consensus_major_drift'
      when 'driftlens_only' then 'driftlens_only_gradual_drift' when 'neither' then 'consensus_normal_benchmark' end as reason
    from {source} where not is_reference) where reason is not null)
where agreement = 'mcddd_only' or class_rank <= case agreement when 'both' then 4 when 'driftlens_only' then 3 else 1 end"""


@query(sql=IMPORTANT.format(source="compared"))
def select_important(spark, sf_dir):
    return cmp.select_important(_compared(spark, sf_dir)).select(
        "window_id", "agreement", "reason", F.col("class_rank").cast("long").alias("class_rank"))


@query(sql="select scenario, position, window_id, concept_drift, drift_start, drift_end, volume_change, ground_truth_drift from labelled")
def label_windows(spark, sf_dir):
    return _labelled(spark, sf_dir).select(
        "scenario", "position", "window_id", "concept_drift", "drift_start", "drift_end", "volume_change", "ground_truth_drift")


_RATES = """
select scenario, detector, "TP", "TN", "FP", "FN", stream_windows, round(precision, 9) as precision, round(recall, 9) as recall,
  round(false_alarm_rate, 9) as false_alarm_rate,
  round(case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end, 9) as f1
from (select *, coalesce("TP"::double / nullif("TP" + "FP", 0), 0) as precision, coalesce("TP"::double / nullif("TP" + "FN", 0), 0) as recall,
    coalesce("FP"::double / nullif("FP" + "TN", 0), 0) as false_alarm_rate
  from (select scenario, detector, count(*) filter (ground_truth_drift and alarm) as "TP",
      count(*) filter (not ground_truth_drift and not alarm) as "TN", count(*) filter (not ground_truth_drift and alarm) as "FP",
      count(*) filter (ground_truth_drift and not alarm) as "FN", count(*) as stream_windows
    from alarms where position >= 14 group by scenario, detector))"""


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


@query(sql=_RATES)
def classification_metrics(spark, sf_dir):
    return _rounded(ev.classification_metrics(_labelled(spark, sf_dir), N), "precision", "recall", "f1", "false_alarm_rate")


_DELAY = """
select scenario, detector, min(case when concept_drift and alarm and position >= drift_start then position end) as first_alarm_position,
  min(case when concept_drift and alarm and position >= drift_start then position end) - max(drift_start) as detection_delay
from alarms group by scenario, detector"""


@query(sql=_DELAY)
def detection_delay(spark, sf_dir):
    return ev.detection_delay(_labelled(spark, sf_dir))


_MATRIX = f"""
select scenario, both_alarm, both_no_alarm, driftlens_only, mcddd_only, round((both_alarm + both_no_alarm)::double / n, 9) as agreement_rate,
  round((driftlens_only + mcddd_only)::double / n, 9) as disagreement_rate
from (select scenario, count(*) filter (overlap = 'both_alarm') as both_alarm, count(*) filter (overlap = 'both_no_alarm') as both_no_alarm,
    count(*) filter (overlap = 'driftlens_only') as driftlens_only, count(*) filter (overlap = 'mcddd_only') as mcddd_only, count(*) as n
  from (select *, {twin.OVERLAP} as overlap from scenario_scores where position >= 14) group by scenario)"""


@query(sql=_MATRIX)
def agreement_matrix(spark, sf_dir):
    return _rounded(ev.agreement_matrix(ds.scenario_scores(spark, sf_dir), N), "agreement_rate", "disagreement_rate")


@query(sql="""
select scenario, round(avg(processing_latency_ms), 6) as mean_latency_ms, round(median(processing_latency_ms), 6) as median_latency_ms,
  round(avg(throughput_posts_per_sec), 6) as mean_throughput_posts_sec, round(median(throughput_posts_per_sec), 6) as median_throughput_posts_sec
from scenario_scores where position >= 14 group by scenario""")
def performance(spark, sf_dir):
    rows = ev.performance(ds.scenario_scores(spark, sf_dir), N)
    return rows.withColumns({c: F.round(c, 6) for c in rows.columns if c != "scenario"})


@query(sql=f"""
select scenario, position, window_id, window_start, ground_truth_drift, driftlens_score, threshold as driftlens_threshold,
  round(driftlens_score / threshold, 9) as driftlens_ratio, driftlens_alarm, mcddd_score, mcddd_threshold,
  round(mcddd_score / mcddd_threshold, 9) as mcddd_ratio, coalesce(mcddd_alarm, false) as mcddd_alarm, {twin.OVERLAP} as agreement,
  processing_latency_ms as latency_ms, throughput_posts_per_sec as throughput_posts_sec from labelled""")
def window_comparison(spark, sf_dir):
    return _rounded(ev.window_comparison(_labelled(spark, sf_dir)), "driftlens_ratio", "mcddd_ratio")


def _wide(metric):
    return ", ".join(f"max({metric}) filter (detector = '{d}') as {d}_{metric}" for d in ev.DETECTORS)


@query(sql=f"""
with rates as ({_RATES}), delays as ({_DELAY}), agreed as ({_MATRIX})
select r.scenario, {", ".join(_wide(m) for m in ("precision", "recall", "f1", "false_alarm_rate", "detection_delay"))},
  max(agreement_rate) as agreement_rate, max(disagreement_rate) as disagreement_rate
from rates r join delays using (scenario, detector) join agreed on agreed.scenario = r.scenario group by r.scenario""")
def side_by_side(spark, sf_dir):
    labelled = _labelled(spark, sf_dir)
    table = ev.side_by_side(ev.detector_metrics(labelled, N), ev.agreement_matrix(labelled, N))
    return _rounded(table, *[c for c in table.columns if c != "scenario" and not c.endswith("_delay")])


_AROUND = """
select scenario, detector, cast(count(*) filter (stream and alarm) as integer) as alarms, cast(count(*) filter (stream) as integer) as stream_windows,
  round(count(*) filter (stream and alarm)::double / nullif(count(*) filter (stream), 0), 4) as alarm_rate,
  string_agg(cast(position as varchar), ',' order by position) filter (stream and alarm) as alarm_positions,
  case when max(drift_start) is not null then cast(count(*) filter (before and alarm) as integer) end as false_alarms_before_drift,
  round(count(*) filter (before and alarm)::double / nullif(count(*) filter (before), 0), 4) as false_alarm_rate_before_drift,
  min(position) filter (after and alarm) as first_alarm_after_drift,
  round(count(*) filter (after and alarm)::double / nullif(count(*) filter (after), 0), 4) as alarm_rate_after_drift,
  round(count(*) filter (vbefore and alarm)::double / nullif(count(*) filter (vbefore), 0), 4) as false_alarm_rate_before_volume_change,
  round(count(*) filter (vafter and alarm)::double / nullif(count(*) filter (vafter), 0), 4) as false_alarm_rate_after_volume_change,
  bool_or(alarm) filter (drift_start is null and position = volume_change) as alarm_at_volume_change,
  case when max(drift_start) is null and max(volume_change) is null and bool_and(concept_drift = false)
    then round(count(*) filter (stream and alarm)::double / nullif(count(*) filter (stream), 0), 4) end as false_alarm_rate,
  min(position) filter (after and alarm) - max(drift_start) as detection_delay,
  case when max(drift_start) is not null then coalesce(min(position) filter (after and alarm) - max(drift_start) <= 3 + max(drift_end) - max(drift_start), false) end
    as detected_within_tolerance
from (select *, position >= 14 as stream, coalesce(position >= 14 and position < drift_start, false) as before, coalesce(position >= drift_start, false) as after,
    coalesce(drift_start is null and position >= 14 and position < volume_change, false) as vbefore,
    coalesce(drift_start is null and position >= volume_change, false) as vafter from alarms) group by scenario, detector"""


@query(sql=f"select * replace (coalesce(alarm_positions, '') as alarm_positions) from ({_AROUND})")
def scenario_metrics(spark, sf_dir):
    rows = ev.scenario_metrics(_labelled(spark, sf_dir), N)
    return rows.withColumn("alarm_positions", F.array_join(F.col("alarm_positions").cast("array<string>"), ","))


_CELLS = f"""
select scenario, detector, case when drift_start is not null then 'drift at ' || drift_start || case when drift_end <> drift_start then '-' || drift_end else '' end
    when volume_change is not null then 'no drift (volume x' || volume_factor || ' at ' || volume_change || ')'
    when concept_drift = false then 'no drift' else 'unknown (real)' end as expected,
  alarms || '/' || stream_windows as stream_alarms,
  case when drift_start is not null then false_alarms_before_drift || ' (' || printf('%.0f%%', false_alarm_rate_before_drift * 100) || ')'
    when volume_change is not null then printf('%.0f%%', false_alarm_rate_before_volume_change * 100) else '-' end as false_alarms,
  case when drift_start is null then '-' when first_alarm_after_drift is null then 'none'
    else first_alarm_after_drift || ' (+' || detection_delay || ')' end as first_alarm,
  case when drift_start is not null then printf('%.0f%%', alarm_rate_after_drift * 100)
    when volume_change is not null then printf('%.0f%%', false_alarm_rate_after_volume_change * 100) || ' (any alarm is false)' else '-' end as alarm_rate_after
from ({_AROUND}) join truth using (scenario)
union all select 'planned', '-', '-', 'not run', '-', '-', '-'"""


def _planned(spark, sf_dir):
    """The ground truth with a scenario that no score stands for."""
    truth = ds.truth(spark, sf_dir)
    return truth.unionByName(truth.limit(1).withColumn("scenario", F.lit("planned")))


@query(sql=_CELLS)
def summary_rows(spark, sf_dir):
    return ev.summary_rows(ev.scenario_metrics(_labelled(spark, sf_dir), N), _planned(spark, sf_dir))


@query("summary_markdown", sql=f"""
select '| ' || concat_ws(' | ', scenario, detector, expected, stream_alarms, false_alarms, first_alarm, alarm_rate_after) || ' |' as line from ({_CELLS})""")
def summary_markdown(spark, sf_dir):
    return ev.markdown(ev.summary_rows(ev.scenario_metrics(_labelled(spark, sf_dir), N), _planned(spark, sf_dir)))


# Seven runs per scenario: the alarms of a window fire in a run when its volume allows it.
_RUNS = """
select t.scenario, seed, cast(count(*) filter (position >= 14 and fired) as integer) as alarms,
  case when max(drift_start) is not null then cast(count(*) filter (position >= 14 and position < drift_start and fired) as integer) end as false_alarms_before_drift,
  min(position) filter (position >= drift_start and fired) as first_alarm_after_drift,
  min(position) filter (position >= drift_start and fired) - max(drift_start) as detection_delay
from (select *, mcddd_alarm and n_posts % (seed + 2) <> 0 as fired from (select *, unnest(range(7)) as seed from scenario_scores)) s
join truth t using (scenario) group by t.scenario, seed"""


@query(sql=f"""
with runs as ({_RUNS}), spread as (select scenario, count(*) as n, count(first_alarm_after_drift) as found, bool_or(false_alarms_before_drift is not null) as drifts,
  replace(cast(median(alarms) as varchar), '.0', '') || ' [' || min(alarms) || '-' || max(alarms) || ']' as a,
  replace(cast(median(false_alarms_before_drift) as varchar), '.0', '') || ' [' || min(false_alarms_before_drift) || '-' || max(false_alarms_before_drift) || ']' as f,
  replace(cast(median(detection_delay) as varchar), '.0', '') || ' [' || min(detection_delay) || '-' || max(detection_delay) || ']' as d
  from runs group by scenario)
select scenario, a as stream_alarms, case when drifts then coalesce(f, '-') else a || ' (all false)' end as false_alarms,
  case when drifts then coalesce(d, '-') else '-' end as first_alarm_delay, case when drifts then found || '/' || n else '-' end as detected_runs from spread""")
def seed_spread(spark, sf_dir):
    """Spread of repeated runs; a run's alarms depend on the window volume."""
    rows = ds.scenario_scores(spark, sf_dir).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(6))))
    fired = F.coalesce(F.col("mcddd_alarm"), F.lit(False)) & (F.col("n_posts") % (F.col("seed") + 2) != 0)
    keyed = rows.withColumns({"run_scenario": F.col("scenario"), "mcddd_alarm": fired})
    per_run = keyed.withColumn("scenario", F.concat_ws("#", "scenario", "seed"))
    truth = ds.truth(spark, sf_dir).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn(
        "scenario", F.concat_ws("#", "scenario", "seed")).drop("seed")
    metrics = ev.scenario_metrics(ev.label_windows(per_run, truth, N), N).filter("detector = 'mcddd'")
    runs = metrics.withColumn("scenario", F.split("scenario", "#")[0])
    return ev.seed_spread(runs)


@query("all_scenarios", sql="select scenario, count(*) as windows, cast(sum(n_posts) as bigint) as posts, max(position) as last_position from scenario_scores group by scenario")
def all_scenarios(spark, sf_dir):
    """Score sets of all scenarios, written per scenario and read back as one partitioned dataset."""
    path = scratch(spark, "scenarios")
    ds.scenario_scores(spark, sf_dir).write.partitionBy("scenario").parquet(path)
    return spark.read.parquet(path).groupBy(F.col("scenario").cast("string").alias("scenario")).agg(
        F.count("*").alias("windows"), F.sum("n_posts").alias("posts"), F.max("position").alias("last_position"))


@query(sql="""
select scenario, count(*) filter (driftlens_alarm) as driftlens_alarms, count(*) filter (mcddd_alarm) as mcddd_alarms
from scenario_scores where position >= 14 group by scenario""")
def plot_alarms(spark, sf_dir):
    return ev.plot_alarms(ds.scenario_scores(spark, sf_dir), N)


@query(sql="""
select scenario, position, round(driftlens_score / threshold, 9) as driftlens_ratio, round(mcddd_score / mcddd_threshold, 9) as mcddd_ratio
from labelled where position >= 14""")
def plot_ratios(spark, sf_dir):
    return _rounded(ev.plot_ratios(_labelled(spark, sf_dir), N), "driftlens_ratio", "mcddd_ratio")


def _box(column, name):
    points = (("min", 0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("max", 1))
    return ", ".join(f"round(quantile_cont({column}, {p}), 6) as {name}_{label}" for label, p in points)


@query(sql=f"""
select scenario, {_box("processing_latency_ms", "latency")}, {_box("throughput_posts_per_sec", "throughput")}
from scenario_scores where position >= 14 group by scenario""")
def plot_distributions(spark, sf_dir):
    rows = ev.plot_distributions(ds.scenario_scores(spark, sf_dir), N)
    return rows.withColumns({c: F.round(c, 6) for c in rows.columns if c != "scenario"})


@query(sql="select window_id, window_start, driftlens_score, driftlens_threshold, mcddd_score, mcddd_threshold from compared")
def panel_scores(spark, sf_dir):
    return cmp.panel_scores(_compared(spark, sf_dir))


@query(sql="""
select window_id, window_start, agreement, case agreement when 'reference' then 0 when 'neither' then 1 when 'driftlens_only' then 2
  when 'mcddd_only' then 3 when 'both' then 4 else 5 end as agreement_code from compared""")
def panel_agreement(spark, sf_dir):
    return cmp.panel_agreement(_compared(spark, sf_dir))


@query(sql="select window_id, window_start, n_posts, n_used, processing_latency_ms, throughput_posts_per_sec from scores")
def panel_volume(spark, sf_dir):
    return cmp.panel_volume(ds.scores(spark, sf_dir))


_LINE = """
select window_id, 'drift_metrics,' || concat_ws(',', 'pipeline=' || pipeline, 'window_id=' || window_id, 'agreement=' || agreement,
    'driftlens_alarm_state=' || case when driftlens_alarm then 'drift' else 'normal' end, 'is_reference=' || case when is_reference then 'true' else 'false' end,
    'mcddd_alarm_state=' || case when mcddd_alarm then 'drift' when not mcddd_alarm then 'normal' end)
  || ' ' || concat_ws(',', 'driftlens_score=' || driftlens_score, 'driftlens_alarm=' || cast(driftlens_alarm as integer) || 'i',
    'agreement_code=' || agreement_code || 'i', 'processing_latency_ms=' || processing_latency_ms,
    'throughput_posts_per_sec=' || throughput_posts_per_sec, 'driftlens_threshold=' || driftlens_threshold, 'driftlens_ratio=' || driftlens_ratio,
    'mcddd_score=' || mcddd_score, 'mcddd_threshold=' || mcddd_threshold, 'mcddd_alarm=' || cast(mcddd_alarm as integer) || 'i',
    'mcddd_ratio=' || mcddd_ratio, 'mcddd_lag=' || mcddd_lag || 'i', 'cpu_pct=' || cpu_pct, 'post_count=' || post_count || 'i',
    'n_posts=' || post_count || 'i', 'n_used=' || n_used || 'i')
  || ' ' || cast(epoch(cast(window_start as timestamp)) as bigint) as line from normalised"""


@query(sql=_LINE)
def to_line_protocol(spark, sf_dir):
    return metrics.to_line_protocol(_usable(spark, sf_dir))


def _text(column, digits):
    return f"coalesce(cast(round({column}, {digits}) as varchar), '') as {column}"


_FLAT = f"""
select {twin.iso("cast(window_start as timestamp)")} || '+00:00' as timestamp, cast(window_id as varchar) as window_id,
  {_text("driftlens_score", 6)}, {_text("driftlens_threshold", 6)}, cast(cast(driftlens_alarm as integer) as varchar) as driftlens_alarm,
  {_text("driftlens_ratio", 4)}, {_text("mcddd_score", 6)}, {_text("mcddd_threshold", 6)},
  coalesce(cast(cast(mcddd_alarm as integer) as varchar), '') as mcddd_alarm, {_text("mcddd_ratio", 4)}, agreement,
  {_text("processing_latency_ms", 2)}, {_text("throughput_posts_per_sec", 2)}, {_text("cpu_pct", 2)}, '' as mem_mb,
  post_count as n_posts, n_used, cast(is_reference as integer) as is_reference, pipeline from normalised"""


@query(sql=_FLAT)
def to_flat(spark, sf_dir):
    return metrics.to_flat(_usable(spark, sf_dir))


@query(sql="select cast(window_id as varchar) as window_id from normalised group by window_id")
def deliver(spark, sf_dir):
    """Two overlapping deliveries and a retry leave every window once."""
    path = scratch(spark, "delivered")
    records = _usable(spark, sf_dir)
    metrics.deliver(records.filter("is_reference"), path, 1)
    metrics.deliver(records, path, 2)
    metrics.deliver(records, path, 2)
    return spark.read.option("header", True).csv(path).select(F.col("window_id").cast("string").alias("window_id"))


@query(sql=f"""
with marked as (select r.*, r.reject_reason is null as usable, {twin.agreement()} as agreement, d.window_id is not null as done from reasons r
    left join (select window_id from scores where is_reference) d on d.window_id = r.window_id),
  per_window as (select window_id, usable, count(*) as copies, min(agreement) as agreement, bool_or(done) as done from marked group by window_id, usable)
select cast(sum(copies) as bigint) as total, count(*) filter (usable and not done) as new_ingested,
  cast(sum(case when done then copies when usable then copies - 1 else 0 end) as bigint) as skipped_duplicate,
  cast(coalesce(sum(copies) filter (not usable and not done), 0) as bigint) as errors,
  count(*) filter (usable and not done and agreement = 'both') as both_windows,
  count(*) filter (usable and not done and agreement = 'driftlens_only') as driftlens_only_windows,
  count(*) filter (usable and not done and agreement = 'mcddd_only') as mcddd_only_windows,
  count(*) filter (usable and not done and agreement = 'neither') as neither_windows,
  count(*) filter (usable and not done and agreement = 'reference') as reference_windows from per_window""")
def delivery_summary(spark, sf_dir):
    delivered = ds.scores(spark, sf_dir).filter("is_reference").select("window_id")
    return cmp.delivery_summary(ds.score_inputs(spark, sf_dir), delivered)


@query(sql="select window_id, window_start, driftlens_score, driftlens_alarm, mcddd_score, n_posts from scores")
def read_scores(spark, sf_dir):
    """Scores written by two micro-batches and read back."""
    path = scratch(spark, "scores")
    rows = ds.scores(spark, sf_dir)
    files.write_scores(rows.filter("is_reference"), path, 0)
    files.write_scores(rows.filter("NOT is_reference"), path, 1)
    return src.read_scores(spark, path).select("window_id", "window_start", "driftlens_score", "driftlens_alarm", "mcddd_score", "n_posts")


@query(sql="select window_id, agreement, mcddd_lag from compared")
def write_comparison(spark, sf_dir):
    path = scratch(spark, "comparison")
    compared = _compared(spark, sf_dir)
    files.write_comparison(compared, cmp.comparison_summary(compared), path)
    return spark.read.schema(compared.schema).json(f"{path}/comparison").select("window_id", "agreement", "mcddd_lag")


@query(sql="select scenario, concept_drift, drift_start, drift_end, volume_change, volume_factor from truth")
def read_ground_truth(spark, sf_dir):
    """Nested scenario files written from the truth frame, read back flat."""
    path = scratch(spark, "truth")
    flat = ds.truth(spark, sf_dir)

    def point(column):
        return F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("position")))

    volume = F.when(F.col("volume_change").isNotNull(),
                    F.struct(F.col("volume_change").alias("position"), F.col("volume_factor").alias("factor")))
    nested = F.struct("concept_drift", point("drift_start").alias("drift_start"), point("drift_end").alias("drift_end"),
                      volume.alias("volume_change"))
    flat.select("scenario", nested.alias("ground_truth")).repartition(8, "scenario").write.json(path)
    return src.flatten_ground_truth(spark.read.schema(src.schemas.GROUND_TRUTH).json(path))


@query(sql="select window_id, window_start, driftlens_score from scores")
def write_csv(spark, sf_dir):
    path = scratch(spark, "table")
    files.write_csv(cmp.disagreement_table(ds.scores(spark, sf_dir)), path)
    stored = spark.read.option("header", True).csv(path)
    return stored.select(F.col("window_id").cast("long").alias("window_id"), "window_start", F.col("driftlens_score").cast("double").alias("driftlens_score"))
