"""Sources, sinks, text expressions, validation and windows."""
import uuid

from pyspark.sql import Window, functions as F

from tidemark.functions import text as tx, timestamps as ts
from tidemark.operators import ingest as ig, ranking as rk, windowing as wd
from tidemark.plans import datasets as ds
from tidemark.plans.catalog import query
from tidemark.plans.catalog import sql as twin
from tidemark.session import shared_folder
from tidemark.sinks import files
from tidemark.sources.posts import read_posts_csv, with_row_index as number_rows
from tidemark.sources.windows import read_windows as load_windows


def scratch(spark, name: str) -> str:
    """A fresh folder on the storage all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def joined(array, separator: str = "\u0001"):
    return F.array_join(array, separator)


def _csv(spark, sf_dir):
    path = scratch(spark, "csv")
    files.write_csv(ds.raw_posts(spark, sf_dir), path)
    return path


# Quoted text read from CSV keeps its inner line breaks; only an all-blank cell and NULL look alike there.
_CSV_TEXT = "md5(regexp_replace(original_text, '\\s+', ' ', 'g')) as text_md5"


def _csv_digest():
    return F.md5(F.regexp_replace("original_text", r"\s+", " ")).alias("text_md5")


@query("read_posts_csv", sql=f"select created_at, {_CSV_TEXT}, row_index from raw_posts")
def read_csv(spark, sf_dir):
    return read_posts_csv(spark, _csv(spark, sf_dir)).select("created_at", _csv_digest(), "row_index")


@query("read_posts_csv_pruned", sql=f"select created_at, {_CSV_TEXT} from raw_posts")
def read_csv_pruned(spark, sf_dir):
    rows = read_posts_csv(spark, _csv(spark, sf_dir), columns=["created_at", "original_text"])
    return rows.select("created_at", _csv_digest())


EVENTS_IN_FILE = 20_000       # files whose texts span lines are read whole by a task


@query("csv_row_index", sql=f"select cast(row_number() over (order by cast(row_index as bigint)) - 1 as bigint) as place, created_at, {_CSV_TEXT} from raw_posts")
def csv_row_index(spark, sf_dir):
    """Row numbers over several files are dense, unique and stand beside their own rows, whatever the file sizes."""
    path = scratch(spark, "csv")
    number = F.col("row_index").cast("bigint")
    n_files = max(5, -(-ds.table(spark, sf_dir, "events").count() // EVENTS_IN_FILE))
    files.write_csv(ds.raw_posts(spark, sf_dir).repartitionByRange(n_files, number).sortWithinPartitions(number), path, "gzip")
    rows = read_posts_csv(spark, path, columns=["created_at", "original_text"])
    digests = rows.withColumn("text_md5", _csv_digest()).drop("original_text")        # numbering stores its rows
    return number_rows(digests).select(F.col("row_index").cast("bigint").alias("place"), "created_at", "text_md5")


@query(sql="select event_id, cast(row_number() over (order by ts, event_id) - 1 as bigint) as row_index from events")
def with_row_index(spark, sf_dir):
    """Global rank over a natural order (time, id) by range partitions and running totals."""
    return rk.global_rank(ds.table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "row_index")


@query(sql=f"""
select created_at, md5(original_text) as text_md5, row_index from raw_posts
where created_at is not null and lower(created_at) <> 'nan' and original_text is not null
  and lower(original_text) <> 'nan' and length({twin.strip("original_text")}) > 0""")
def validate(spark, sf_dir):
    return ig.validate(ds.raw_posts(spark, sf_dir)).select("created_at", F.md5("original_text").alias("text_md5"), "row_index")


_USABLE = f"""created_at is not null and lower(created_at) <> 'nan' and original_text is not null
  and lower(original_text) <> 'nan' and length({twin.strip("original_text")}) > 0"""


@query(sql=f"""
select row_index from (select row_index, row_number() over (partition by {twin.strip("created_at")}, {twin.strip("original_text")}
  order by cast(row_index as bigint)) as copy_no from raw_posts where {_USABLE}) where copy_no = 1""")
def dedup_signature(spark, sf_dir):
    return ig.dedup_signature(ig.validate(ds.raw_posts(spark, sf_dir))).select("row_index")


@query(sql=f"""
with firsts as (select *, row_number() over (partition by {twin.strip("created_at")}, {twin.strip("original_text")}
    order by cast(row_index as bigint)) as copy_no from raw_posts where {_USABLE})
select (select count(*) from raw_posts) as loaded, count(*) filter (copy_no = 1) as valid,
  (select count(*) from raw_posts) - count(*) as invalid, count(*) filter (copy_no > 1) as duplicates,
  min(created_at) as first_timestamp, max(created_at) as last_timestamp from firsts""")
def validation_summary(spark, sf_dir):
    return ig.validation_summary(ds.raw_posts(spark, sf_dir))


@query(sql=f"""
select 'tweet_' || row_index as post_id, {twin.strip("created_at")} as timestamp, md5({twin.strip("original_text")}) as text_md5,
  'twitter' as source from raw_posts where {_USABLE}""")
def standardize(spark, sf_dir):
    rows = ig.standardize(ig.validate(ds.raw_posts(spark, sf_dir)))
    return rows.select("post_id", "timestamp", F.md5("text").alias("text_md5"), "source")


@query(sql=f"""
select 'tweet_' || row_index as key, {twin.strip("created_at")} as timestamp, md5({twin.strip("original_text")}) as text_md5
from raw_posts where {_USABLE}""")
def publish(spark, sf_dir):
    """Published files read back: keys and the decoded values."""
    path = scratch(spark, "topic")
    files.publish(ig.standardize(ig.validate(ds.raw_posts(spark, sf_dir))), path)
    records = spark.read.schema("key string, value string, day string").json(path)
    value = F.from_json("value", "timestamp string, text string")
    return records.select("key", value.alias("v")).select("key", "v.timestamp", F.md5("v.text").alias("text_md5"))


@query(sql=f"""
select 'tweet_' || row_index as key, row_number() over (order by {twin.strip("created_at")}, cast(row_index as bigint)) as place
from raw_posts where {_USABLE} order by place limit 500""")
def publish_first(spark, sf_dir):
    """The first 500 records of the chronological order (the reference's record limit)."""
    order = Window.orderBy("timestamp", F.substring("key", 7, 30).cast("long"))
    first = ig.publish_frame(ig.standardize(ig.validate(ds.raw_posts(spark, sf_dir))), 500)
    keyed = first.select("key", F.get_json_object("value", "$.timestamp").alias("timestamp"))
    return keyed.select("key", F.row_number().over(order).cast("long").alias("place"))


@query(sql="""
with broken as (select case when source = 'error' and timestamp = 'not-a-date' then '{"post_id": "cut' else 'ok' end as kind, * from messages)
select case when kind = 'ok' then post_id end as post_id, case when kind = 'ok' then timestamp end as timestamp,
  case when kind = 'ok' then source end as source, md5(case when kind = 'ok' then text end) as text_md5,
  kind <> 'ok' as is_malformed from broken""")
def parse_value(spark, sf_dir):
    """Binary values back to fields; cut-off JSON keeps its row with NULL fields."""
    rows = ds.messages(spark, sf_dir)
    cut = (F.col("source") == "error") & (F.col("timestamp") == "not-a-date")
    value = F.when(cut, '{"post_id": "cut').otherwise(F.to_json(F.struct("post_id", "timestamp", "text", "source")))
    parsed = wd.parse_value(rows.select(value.cast("binary").alias("value")))
    return parsed.select("post_id", "timestamp", "source", F.md5("text").alias("text_md5"),
                         (F.col("raw_value") == '{"post_id": "cut').alias("is_malformed"))


@query(sql=f"select post_id, timestamp, {twin.iso('event_time')} as event_time from cleaned")
def add_event_time(spark, sf_dir):
    return wd.add_event_time(ds.messages(spark, sf_dir)).select("post_id", "timestamp", ts.iso(F.col("event_time")).alias("event_time"))


@query(sql="select post_id, md5(text) as text_md5, length(text) as n_chars from cleaned")
def clean_text(spark, sf_dir):
    cleaned = ds.messages(spark, sf_dir).withColumn("text", tx.clean_text(F.col("text")))
    return cleaned.select("post_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


@query("clean_text_sql", sql="select post_id, md5(text) as text_md5, length(text) as n_chars from cleaned")
def clean_text_function(spark, sf_dir):
    """The same rules through the registered SQL function."""
    tx.register_sql(spark)
    cleaned = ds.messages(spark, sf_dir).withColumn("text", F.expr("clean_text(text)"))
    return cleaned.select("post_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


@query(sql=f"""
select doc_id, md5(kept) as text_md5 from (select doc_id, {twin.strip("replace(text, chr(65533), '')")} as kept
from documents) where length(kept) > 0""")
def prepare_texts(spark, sf_dir):
    return wd.prepare_texts(ds.table(spark, sf_dir, "documents")).select("doc_id", F.md5("text").alias("text_md5"))


@query("window_id", sql="""
select event_id, cast(floor(epoch(ts) / 900) as bigint) as window_id, strftime(time_bucket(interval 15 minutes, ts), '%Y-%m-%dT%H:%M:%S') as window_start
from events""")
def window_ids(spark, sf_dir):
    events = ds.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("event_time"))
    return wd.assign_windows(events, "15 minutes").select("event_id", "window_id", ts.iso(F.col("window_start")).alias("window_start"))


@query(sql="select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as normal from events")
def normalise_ts(spark, sf_dir):
    """Epoch numbers, ISO text with zone and bare dates-with-time all reach the same instant."""
    events = ds.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", F.unix_seconds("ts").cast("string"))
        .when(kind == "view", F.concat(ts.iso(F.col("ts")), F.lit("Z")))
        .when(kind == "signup", F.concat(ts.iso(F.col("ts") + F.expr("interval 2 hours")), F.lit("+02:00")))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    )
    return events.select("event_id", ts.iso(ts.normalise_ts(text)).alias("normal"))


@query(sql=f"select post_id, {twin.iso('event_time')} as event_time, md5(text) as text_md5, source from valid")
def filter_valid(spark, sf_dir):
    rows = wd.filter_valid(wd.clean_records(ds.messages(spark, sf_dir)))
    return rows.select("post_id", ts.iso(F.col("event_time")).alias("event_time"), F.md5("text").alias("text_md5"), "source")


@query(sql="""
select count(*) as total, count(*) filter (post_id is null and text is null) as malformed_json,
  count(*) filter (text is not null and event_time is null) as invalid_timestamp,
  count(*) filter (event_time is not null and length(trim(text, ' ')) = 0) as empty_after_cleaning,
  count(*) filter (post_id is null and text is not null and event_time is not null and length(trim(text, ' ')) > 0) as other_rejected
from cleaned""")
def quality_counts(spark, sf_dir):
    return wd.quality_counts(wd.clean_records(ds.messages(spark, sf_dir)))


@query(sql=f"select post_id, {twin.iso('event_time')} as event_time, md5(text) as text_md5 from posts")
def dedup_posts(spark, sf_dir):
    rows = wd.dedup_posts(wd.filter_valid(wd.clean_records(ds.messages(spark, sf_dir))))
    return rows.select("post_id", ts.iso(F.col("event_time")).alias("event_time"), F.md5("text").alias("text_md5"))


@query(sql="select window_id, cast(count(*) as integer) as post_count from posts group by window_id")
def window_counts(spark, sf_dir):
    return wd.window_counts(ds.posts(spark, sf_dir)).select("window_id", "post_count")


_NESTED = f"""
select window_id, {{part}}{twin.iso("window_start")} as window_start, {twin.iso("window_end")} as window_end,
  md5(string_agg(text, chr(1) order by event_time, post_id)) as texts_md5,
  md5(string_agg({twin.iso("event_time")}, chr(1) order by event_time, post_id)) as timestamps_md5,
  string_agg(post_id, ',' order by event_time, post_id) as post_ids, cast(count(*) as integer) as post_count
from posts group by window_id, window_start, window_end"""


def _digest(windows, *extra):
    return windows.select(
        "window_id", *extra, "window_start", "window_end", F.md5(joined("texts")).alias("texts_md5"),
        F.md5(joined("timestamps")).alias("timestamps_md5"), joined("post_ids", ",").alias("post_ids"), "post_count")


@query(sql=_NESTED.format(part="0 as part, "))
def build_windows(spark, sf_dir):
    """Nested daily windows in output form (arrays as digests and text)."""
    return _digest(wd.to_output(wd.build_windows(ds.posts(spark, sf_dir))), "part")


@query(sql="""
select window_id, post_id, md5(text) as text_md5, cast(row_number() over (partition by window_id order by event_time, post_id) - 1 as integer) as idx,
  cast(count(*) over (partition by window_id) as integer) as post_count from posts""")
def build_windows_in_parts(spark, sf_dir):
    """Windows above a small bound come in parts; read back, every post has its place and its window's total."""
    parts = wd.build_windows(ds.posts(spark, sf_dir), max_part_rows=10)
    totals = parts.select("window_id", "post_count").distinct()
    return wd.explode_windows(parts).join(totals, "window_id").select("window_id", "post_id", F.md5("text").alias("text_md5"), "idx", "post_count")


@query(sql="""
select window_id, post_id, md5(text) as text_md5, cast(row_number() over (partition by window_id order by event_time, post_id) - 1 as integer) as idx
from posts""")
def explode_windows(spark, sf_dir):
    rows = wd.explode_windows(wd.build_windows(ds.posts(spark, sf_dir)))
    return rows.select("window_id", "post_id", F.md5("text").alias("text_md5"), "idx")


@query(sql=f"""
select window_id, {twin.iso("window_start")} as window_start, {twin.iso("window_end")} as window_end, cast(count(*) as integer) as post_count,
  md5(string_agg(text, chr(1) order by event_time, post_id) filter (place <= 5)) as texts_md5
from (select *, row_number() over (partition by window_id order by event_time, post_id) as place from posts)
group by window_id, window_start, window_end""")
def preview(spark, sf_dir):
    shown = wd.preview(wd.to_output(wd.build_windows(ds.posts(spark, sf_dir))), 5)
    return shown.select("window_id", "window_start", "window_end", "post_count", F.md5(joined("texts")).alias("texts_md5"))


@query(sql=_NESTED.format(part=""))
def read_windows(spark, sf_dir):
    """Windows written by two micro-batches and read back; the newer batch wins per window."""
    path = scratch(spark, "windows")
    windows = wd.build_windows(ds.posts(spark, sf_dir))
    files.write_windows_batch(windows.withColumn("texts", F.slice("texts", 1, 1)), 2, path)
    files.write_windows_batch(windows, 10, path)
    return _digest(load_windows(spark, path))


@query(sql="select cast(count(*) as bigint) as n_windows, cast(sum(n) as bigint) as n_posts from (select count(*) as n from posts group by window_id)")
def write_windows_batch(spark, sf_dir):
    """A retried micro-batch overwrites its own folder."""
    path = scratch(spark, "windows")
    windows = wd.build_windows(ds.posts(spark, sf_dir))
    for _ in range(2):
        files.write_windows_batch(windows, 7, path)
    stored = load_windows(spark, path)
    return stored.agg(F.count("*").alias("n_windows"), F.sum(F.size("texts")).alias("n_posts"))


@query(sql="""
select window_id, post_id from posts where window_id = (select cast(floor(epoch(max(ts)) / 86400) as bigint) - 1 from events)""")
def window_by_id(spark, sf_dir):
    last = ds.table(spark, sf_dir, "events").agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp")))).first()[0]
    return wd.window_by_id(ds.posts(spark, sf_dir), last // ds.DAY - 1).select("window_id", "post_id")


@query(sql="select window_id, post_id from posts where substr(cast(window_start as varchar), 1, 10) between '2024-01-05' and '2024-01-12'")
def in_period(spark, sf_dir):
    return wd.in_period(ds.posts(spark, sf_dir), "2024-01-05", "2024-01-12").select("window_id", "post_id")


@query(sql="""
select w.window_id, post_id, cast(position as integer) as position, position < 14 as is_reference from posts w
join (select window_id, row_number() over (order by window_id) - 1 as position from (select distinct window_id from posts)) p using (window_id)""")
def with_position(spark, sf_dir):
    return wd.with_position(ds.posts(spark, sf_dir), 14).select("window_id", "post_id", F.col("position").cast("int").alias("position"), "is_reference")


_FIRST = "(select window_id from (select distinct window_id from vectors) order by window_id limit {n})"


@query(sql=f"select window_id, post_id from vectors where window_id in {_FIRST.format(n=7)}")
def limit_windows(spark, sf_dir):
    return wd.limit_windows(ds.vectors(spark, sf_dir), 7).select("window_id", "post_id")


def _reference(spark, sf_dir):
    return wd.positions(ds.vectors(spark, sf_dir), 14).filter("is_reference")


@query(sql=f"select window_id, post_id from vectors where window_id in {_FIRST.format(n=14)}")
def reference_windows(spark, sf_dir):
    return wd.reference_windows(ds.vectors(spark, sf_dir), _reference(spark, sf_dir)).select("window_id", "post_id")


@query(sql=f"select window_id, post_id from vectors where window_id not in {_FIRST.format(n=14)}")
def unseen(spark, sf_dir):
    return wd.unseen(ds.vectors(spark, sf_dir), _reference(spark, sf_dir)).select("window_id", "post_id")


@query(sql=f"select window_id, post_id, window_id in {_FIRST.format(n=14)} as is_reference from vectors")
def flag_reference(spark, sf_dir):
    return wd.flag_reference(ds.vectors(spark, sf_dir), _reference(spark, sf_dir)).select("window_id", "post_id", "is_reference")


@query(sql=f"select distinct window_id from vectors where window_id not in {_FIRST.format(n=14)}")
def non_reference_ids(spark, sf_dir):
    return wd.non_reference_ids(ds.vectors(spark, sf_dir), _reference(spark, sf_dir))


@query(sql="select window_id, post_id, row_number() over (order by window_id, event_time, post_id) as place from posts")
def ordered(spark, sf_dir):
    """Posts in (window, event time, id) order; the place is the global rank of that order."""
    keys = ["window_id", "event_time", "post_id"]
    ranked = rk.global_rank(ds.posts(spark, sf_dir).select(*keys), keys, "place")
    return wd.ordered(ranked, ["place"]).select("window_id", "post_id", (F.col("place") + 1).alias("place"))


@query(sql="""
with digests as (select md5(concat_ws(chr(1), cast(window_id as varchar), post_id, text)) as d from posts)
select count(*) as n_rows, cast(sum(cast('0x' || substr(d, 1, 15) as ubigint)) as varchar) as sum_high,
  cast(sum(cast('0x' || substr(d, 16, 15) as ubigint)) as varchar) as sum_low from digests""")
def fingerprint(spark, sf_dir):
    return wd.fingerprint(ds.posts(spark, sf_dir), ["window_id", "post_id", "text"])
