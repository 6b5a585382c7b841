"""Keywords, examples, explanations and reports over daily windows."""
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import compare as cmp, explain as ex
from tidemark.plans import datasets as ds
from tidemark.plans.catalog import query
from tidemark.plans.catalog import sql as twin
from tidemark.plans.catalog.evaluation import IMPORTANT
from tidemark.plans.catalog.ingestion import joined


def _day_scores(spark, sf_dir):
    return ds.scores(spark, sf_dir, ds.DAY)


def _pairs(spark, sf_dir):
    return ex.window_pairs(cmp.compare(_day_scores(spark, sf_dir)))


@query(sql="""
select doc_id, md5(coalesce(array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'),
  lambda w: length(w) >= 3 and w not in ({words}) and not regexp_full_match(w, '[0-9]+')), ' '), '')) as tokens_md5
from documents""".replace("{words}", twin.WORDS))
def tokenize(spark, sf_dir):
    documents = ds.table(spark, sf_dir, "documents")
    return documents.select("doc_id", F.md5(joined(tx.tokenize(F.col("text")), " ")).alias("tokens_md5"))


@query(sql="select window_id, term, n from counts")
def term_counts(spark, sf_dir):
    return ex.term_counts(ds.posts(spark, sf_dir))


@query(sql="""
select window_id, term, cast(coalesce(n_before, 0) as bigint) as count_before, cast(coalesce(n_after, 0) as bigint) as count_after from shifts""")
def term_shift_join(spark, sf_dir):
    return ex.term_shift_join(ex.term_counts(ds.posts(spark, sf_dir)), _pairs(spark, sf_dir))


@query(sql="""
select window_id, direction, rank, term, round(diff * 100, 2) as score, count_before, count_after from keyword_rows where rank <= 8""")
def keyword_shift(spark, sf_dir):
    shifts = ex.keyword_shift(ds.uncleaned_posts(spark, sf_dir), _pairs(spark, sf_dir), prepare=tx.clean_text)
    return shifts.withColumn("rank", F.col("rank").cast("long"))


@query(sql="""
select window_id, post_id, cast(rank as bigint) as rank from
(select *, row_number() over (partition by window_id order by event_time, post_id) as rank from posts) where rank <= 4""")
def first_k(spark, sf_dir):
    rows = ex.first_k(ds.posts(spark, sf_dir).select("window_id", "event_time", "post_id"))
    return rows.select("window_id", "post_id", F.col("rank").cast("long").alias("rank"))


@query(sql="""
with centres as (select window_id, list(m order by i) as centre from (select window_id, i, avg(x) as m
    from (select window_id, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from vectors) group by window_id, i) group by window_id),
  near as (select window_id, post_id, round(list_cosine_similarity(embedding::double[], centre), 6) as similarity from vectors join centres using (window_id))
select window_id, post_id, similarity, rank from (select *, row_number() over (partition by window_id order by similarity desc, post_id) as rank from near) where rank <= 4""")
def centroid_k(spark, sf_dir):
    rows = ex.centroid_k(ds.vectors(spark, sf_dir).select("window_id", "post_id", "embedding"))
    return rows.withColumn("rank", F.col("rank").cast("long"))


@query(sql="""
select d.window_id, window_start, is_reference, driftlens_score, driftlens_threshold, driftlens_ratio, driftlens_alarm, mcddd_score, mcddd_threshold,
  mcddd_ratio, mcddd_alarm, agreement, n_posts, least(n_posts, 10) as n_used from compared d""")
def disagreement_table(spark, sf_dir):
    return cmp.disagreement_table(ds.scores(spark, sf_dir))


_EXPLAINED = """
select c.window_id, c.window_start, c.agreement, c.n_posts as after_volume, b.window_id as before_window_id, b.n_posts as before_volume,
  a.found is not null as post_data_available, a.found as after_examples, p.found as before_examples,
  coalesce(k.emerging, '') as emerging, coalesce(k.fading, '') as fading,
  'Window ' || c.window_id || ' demonstrates shifts with emerging terms: ' || coalesce(k.summary, '') || '.' as semantic_summary,
  case when c.driftlens_ratio > 1.3 or c.mcddd_ratio > 1.3 then 'abrupt' else 'gradual' end as change_type
from day_compared c join pairs on pairs.window_id = c.window_id join day_compared b on b.window_id = pairs.before_window_id
left join examples a on a.window_id = c.window_id left join examples p on p.window_id = b.window_id
left join (select window_id, string_agg(term, ',' order by rank) filter (direction = 'emerging') as emerging,
    string_agg(term, ', ' order by rank) filter (direction = 'emerging' and rank <= 4) as summary,
    string_agg(term, ',' order by rank) filter (direction = 'fading') as fading from keyword_rows where rank <= 8 group by window_id) k on k.window_id = c.window_id"""
_EXAMPLES = """
with examples as (select window_id, md5(string_agg(text, chr(1) order by place)) as found
  from (select *, row_number() over (partition by window_id order by event_time, post_id) as place from posts) where place <= 4 group by window_id)"""


def _explained(rows, *more):
    return rows.select(
        "window_id", "window_start", "agreement", "after_volume", "before_window_id", "before_volume", "post_data_available",
        F.md5(joined("after_examples")).alias("after_examples"), F.md5(joined("before_examples")).alias("before_examples"),
        F.coalesce(F.array_join("emerging_keywords.term", ","), F.lit("")).alias("emerging"),
        F.coalesce(F.array_join("fading_keywords.term", ","), F.lit("")).alias("fading"), "semantic_summary", "change_type", *more)


@query(sql=_EXAMPLES + _EXPLAINED)
def explain(spark, sf_dir):
    return _explained(ex.explain(_day_scores(spark, sf_dir), ds.uncleaned_posts(spark, sf_dir), prepare=tx.clean_text))


@query(sql=_EXAMPLES + f"select e.*, i.reason from ({_EXPLAINED}) e join ({IMPORTANT.format(source='day_compared')}) i using (window_id)")
def report(spark, sf_dir):
    return _explained(ex.report(_day_scores(spark, sf_dir), ds.uncleaned_posts(spark, sf_dir), prepare=tx.clean_text), "reason")


@query(sql=f"""
select count(*) as total_windows, count(*) filter (not is_reference) as stream_windows,
  (select count(*) from ({IMPORTANT.format(source="day_compared")})) as selected_windows,
  count(*) filter (not is_reference and agreement = 'both') as both, count(*) filter (not is_reference and agreement = 'driftlens_only') as driftlens_only,
  count(*) filter (not is_reference and agreement = 'mcddd_only') as mcddd_only, count(*) filter (not is_reference and agreement = 'neither') as neither,
  count(*) filter (not is_reference and agreement = 'mcddd_missing') as mcddd_missing from day_compared""")
def report_totals(spark, sf_dir):
    return ex.report_totals(_day_scores(spark, sf_dir))
