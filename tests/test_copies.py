"""Equal texts are carried, cleaned and counted once, with the results of doing so for every post."""
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions import text as tx, timestamps as ts
from tidemark.operators import copies, explain as ex, windowing as wd

SCORES = ("window_id long, window_start string, n_posts long, is_reference boolean, driftlens_score double, threshold double, driftlens_alarm boolean, "
          "mcddd_score double, mcddd_threshold double, mcddd_alarm boolean, mcddd_lag int, n_used long")


def raw_messages(spark):
    """Three days; texts that come often, clean to nothing, clean to each other, are null; copies of a key; a missing id."""
    texts = ["Lockdown   at home", "lockdown at home", "RT @u: stay home\nlockdown", "@u http://x.y/z", None, "rt rt vaccine dose", "vaccine dose #vaccine", "1234 and the", "É côté"]
    rows = [(f"p{i}" if i % 11 else None, f"2024-01-0{1 + (i * i) % 3}" + ("", " 10:00:00", "T09:00:00", " bad")[i % 4], texts[(i * 7 + i % 3) % len(texts)], "s") for i in range(240)]
    rows += [rows[i] for i in (1, 2, 2, 50)] + [("p3", rows[3][1], "@u http://x.y/z", "s")]
    return spark.createDataFrame(rows, "post_id string, timestamp string, text string, source string").repartition(3, "post_id")


def scores(spark):
    rows = [(w, str(w), 5, False, 0.06, 0.05, True, 2.0 if w % 2 else None, 1.9, True, 1, 3) for w in (19723, 19724, 19725)]
    return spark.createDataFrame(rows, SCORES)


def sorted_rows(df):
    return sorted((str(r.asDict(True)) for r in df.collect()))


def test_texts_once(spark):
    texts = ["a", "b", "a", None, "a", "", None, "b"]
    rows = [(1 + i % 2, datetime(2024, 1, 1), f"p{i}", t) for i, t in enumerate(texts)]
    posts = spark.createDataFrame(rows, "window_id long, event_time timestamp, post_id string, text string").coalesce(1)
    kept = sorted(copies.texts_once(posts).collect(), key=lambda r: r["post_id"])
    assert [r["is_first"] for r in kept] == [True, True, False, True, False, True, False, False]
    assert [r["text"] for r in kept] == ["a", "b", None, None, None, "", None, None]
    text_of = {r["text_id"]: r["text"] for r in kept if r["is_first"]}
    assert [text_of[r["text_id"]] for r in kept] == texts and len(text_of) == 4
    assert [(r["window_id"], r["event_time"], r["post_id"]) for r in kept] == [r[:3] for r in rows]


def test_forgotten_texts_come_again(spark, monkeypatch):
    posts = spark.range(0, 400, 1, 1).select(F.lit(1).cast("long").alias("window_id"), F.lit(None).cast("timestamp").alias("event_time"),
                                             F.col("id").cast("string").alias("post_id"), (F.col("id") % 40).cast("string").alias("text"))
    batches = [b for start in range(0, 400, 50) for b in posts.filter(F.col("id").between(start, start + 49)).toArrow().to_batches()]
    monkeypatch.setattr(copies, "KNOWN_TEXTS", 60)
    monkeypatch.setattr(copies, "TaskContext", type("Here", (), {"get": staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 2})())}))
    kept = [r for b in copies._mark_first(iter(batches)) for r in b.to_pylist()]
    text_of = {r["text_id"]: r["text"] for r in kept if r["is_first"]}
    assert [text_of[r["text_id"]] for r in kept] == [str(i % 40) for i in range(400)]
    assert 40 < len(text_of) < 400 and min(text_of) == 2 << 40


def test_uncleaned_posts_are_the_posts(spark):
    found = wd.uncleaned_posts(raw_messages(spark), "1 day")
    cleaned = wd.keep_text(found, tx.clean_text(F.col("text")))
    want = wd.posts_from_messages(raw_messages(spark), "1 day")
    assert sorted_rows(cleaned.select(want.columns)) == sorted_rows(want) and want.count() > 100


def test_explanations_of_uncleaned_posts(spark):
    raw, posts = wd.uncleaned_posts(raw_messages(spark), "1 day"), wd.posts_from_messages(raw_messages(spark), "1 day")
    got = ex.explain(scores(spark), raw, prepare=tx.clean_text)
    want = ex.explain(scores(spark), posts)
    assert sorted_rows(got) == sorted_rows(want) and want.count() == 3
    pairs = want.select("window_id", "before_window_id")
    assert sorted_rows(ex.keyword_shift(raw, pairs, prepare=tx.clean_text)) == sorted_rows(ex.keyword_shift(posts, pairs))
    counts = ex.term_counts(posts).filter("window_id = 19724 AND term = 'lockdown'").first()["n"]
    plain = posts.filter("window_id = 19724").select(F.explode(tx.tokenize(F.col("text"))).alias("t")).filter("t = 'lockdown'").count()
    shift = want.filter("window_id = 19724").selectExpr("after_examples", "size(emerging_keywords) + size(fading_keywords) AS n").first()
    assert counts == plain and len(shift["after_examples"]) == 4 and shift["n"] > 0
    first = posts.filter("window_id = 19724").orderBy("event_time", "post_id").limit(4)
    assert shift["after_examples"] == [r["text"] for r in first.collect()]


def test_texts_are_cleaned_once_and_ranked_without(spark):
    """2,000 posts of 5 texts: what is stored and cleaned is 5 texts a task."""
    posts = spark.range(0, 2000, 1, 2).select(F.lit(19724).cast("long").alias("window_id"), F.lit(0).cast("timestamp").alias("event_time"),
                                              F.col("id").cast("string").alias("post_id"), F.concat(F.lit("Word"), F.col("id") % 5).alias("text"))
    kept = copies.texts_once(posts, tx.clean_text)
    assert kept.count() == 2000 and sorted(r["text"] for r in kept.filter("is_first").collect()) == sorted([f"word{i}" for i in range(5)] * 2)
    assert kept.filter("NOT is_first AND text IS NOT NULL").isEmpty()
    counts = {r["term"]: r["n"] for r in ex._counts_with_texts(kept).collect()}
    assert counts == {"": 2000, **{f"word{i}": 400 for i in range(5)}}


def test_event_times_of_every_format(spark):
    texts = ["2024-01-02 03:04:05", "2024-01-02T03:04:05", "2024-01-02t03:04:05", " 2024-01-02 ", "2024-01-02", "2024-01-02 03:04", "2024-01-02  03:04:05",
             "2024-01-02T03:04:05Z", "not-a-date", "t:", " : ", "", None, "2024-13-01", "2024-02-30 00:00:00", "2024-01-02 T03:04:05", "+2024-01-02"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    plain = F.coalesce(*(F.try_to_timestamp(F.trim("x"), F.lit(f)) for f in ts.EVENT_TIME_FORMATS))
    rows = df.select(plain.alias("plain"), ts.parse_event_time(F.col("x")).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["plain"] for r in rows]
    assert [r["got"] is not None for r in rows][:5] == [True] * 5
