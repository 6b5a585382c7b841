import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx, timestamps as ts
from tidemark.operators import ingest as ig, ranking as rk, sampling as sp, windowing as wd
from tidemark.sinks import files
from tidemark.sources import kafka
from tidemark.sources.posts import read_posts_csv, with_row_index
from tidemark.sources.windows import read_windows


def message(pid, when, text, source="twitter"):
    return json.dumps({"post_id": pid, "timestamp": when, "text": text, "source": source})


def cleaned(spark, *values):
    raw = spark.createDataFrame([(bytearray(v.encode()),) for v in values], "value binary")
    return wd.clean_records(wd.parse_value(raw))


def one_text(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(tx.clean_text(F.col("t"))).first()[0]


def test_validation_keeps_the_first_copy(spark):
    raw = spark.createDataFrame([
        ("2020-04-19", "text1", "0"), ("2020-04-19", "text1", "1"), (None, "text2", "2"), ("2020-04-20", " \t", "3"),
        ("2020-04-21", "text3", "4"), ("NaN", "text4", "5"), ("2020-04-21", "nan", "6"),
    ], "created_at string, original_text string, row_index string")
    assert [r["row_index"] for r in ig.dedup_signature(ig.validate(raw)).orderBy("row_index").collect()] == ["0", "4"]
    summary = ig.validation_summary(raw).first().asDict()
    assert summary == {"loaded": 7, "valid": 2, "invalid": 4, "duplicates": 1,
                       "first_timestamp": "2020-04-19", "last_timestamp": "2020-04-21"}


def test_standard_message_and_publish_order(spark):
    raw = spark.createDataFrame([("2020-04-20", " b ", "10"), ("2020-04-19", "a", "42"), ("2020-04-20", "c", "9")],
                                "created_at string, original_text string, row_index string")
    messages = ig.standardize(raw)
    assert messages.filter("post_id = 'tweet_42'").first().asDict() == {
        "post_id": "tweet_42", "timestamp": "2020-04-19", "text": "a", "source": "twitter"}
    records = ig.publish_frame(messages).collect()
    assert [r["key"] for r in records] == ["tweet_42", "tweet_9", "tweet_10"]
    assert json.loads(records[0]["value"])["text"] == "a"
    assert ig.publish_frame(messages, 2).count() == 2


@pytest.mark.parametrize("given, expected", [
    ("Masks SOLD out today http://shop.test/a?b=1 @a_clerk", "masks sold out today"),
    ("#Curfew tonight??? Take #care2", "curfew tonight? take care2"),
    ("RT @desk: tea &amp; rice", "tea & rice"),
    ("RTs are not a vote", "rts are not a vote"),
    ("mail a@b.org @@a", "mail a@b.org @"),
    ("a\t\n b??..", "a b?."),
    ("#tág", "tág"),
    ("http://shop.test/q @a_clerk", ""),
])
def test_cleaning(spark, given, expected):
    assert one_text(spark, given) == expected


def test_sql_function_cleans_alike(spark):
    tx.register_sql(spark)
    texts = [("RT @x: a &amp; b!! http://x.y #z",), ("  it's\tfine ... ",), (None,)]
    df = spark.createDataFrame(texts, "t string")
    rows = df.select(tx.clean_text(F.col("t")).alias("a"), F.expr("clean_text(t)").alias("b"),
                     tx.tokenize(F.col("t")).alias("c"), F.expr("tokenize(t)").alias("d")).collect()
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in rows)


def test_quality_counters(spark):
    df = cleaned(spark, message("a", "2021-02-03", " @a_clerk http://shop.test/q "), message("b", "2021-02-03", "Open till nine"),
                 message("c", "tomorrow", "Closed?"), '{"post_id": "d", "te', message(None, "2021-02-03", "who?"), message("e", "2021-02-03", None))
    assert [r["post_id"] for r in wd.filter_valid(df).collect()] == ["b"]
    assert wd.quality_counts(df).first().asDict() == {
        "total": 6, "malformed_json": 1, "invalid_timestamp": 1, "empty_after_cleaning": 1, "other_rejected": 2}


def test_filter_evaluates_the_cleaning_once(spark):
    plan = wd.filter_valid(cleaned(spark, message("a", "2020-04-19", "x")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("https?") == 1


def test_event_time_formats(spark):
    df = spark.createDataFrame([("2020-04-19",), ("2020-04-19 10:11:12",), (" 2020-04-19T10:11:12 ",), ("soon",), (None,)], "timestamp string")
    got = [r[0] for r in wd.add_event_time(df).select(ts.iso(F.col("event_time"))).collect()]
    assert got == ["2020-04-19T00:00:00", "2020-04-19T10:11:12", "2020-04-19T10:11:12", None, None]


def test_durations():
    assert [ts.duration_to_seconds(d) for d in ("15 minutes", "1 day", " 2 Weeks ", "30s".replace("s", " second"))] == [900, 86400, 1209600, 30]
    for bad in ("soon", "minutes", "1.5 hours", "", "3 fortnights"):
        with pytest.raises(ValueError):
            ts.duration_to_seconds(bad)


def test_windows_and_parts(spark):
    rows = [(f"p{i:03d}", f"2020-04-{19 + i % 2} 00:00:{i % 60:02d}", f"text {i}", "s") for i in range(90)]
    messages = spark.createDataFrame(rows + rows[:3], "post_id string, timestamp string, text string, source string")
    posts = wd.posts_from_messages(messages, "1 day")
    whole = {r["window_id"]: r for r in wd.build_windows(posts).collect()}
    assert sorted(whole) == [18371, 18372] and all(r["post_count"] == 45 and r["part"] == 0 for r in whole.values())
    first = whole[18371]
    assert list(zip(first["timestamps"], first["post_ids"])) == sorted(zip(first["timestamps"], first["post_ids"]))
    assert first["texts"][0] == "text 0" and first["post_ids"][:2] == ["p000", "p060"]
    plain = wd.build_windows(posts)
    for bound in ({"max_part_rows": 10}, {"max_part_bytes": 60}):
        parts = wd.build_windows(posts, **bound)
        rows = parts.collect()
        assert len(rows) > 2 and all(r["post_count"] == 45 for r in rows) and max(len(r["texts"]) for r in rows) <= 10
        for read in (wd.explode_windows, lambda df: wd.preview(df, 3), lambda df: wd.preview(df, 12)):
            assert sorted(map(str, (r.asDict() | {"part": 0} for r in read(parts).collect()))) == \
                sorted(map(str, (r.asDict() | {"part": 0} for r in read(plain).collect())))


def test_windows_round_trip_newest_batch_wins(spark, tmp_path):
    messages = spark.createDataFrame([("a", "2020-04-21", "x", "s"), ("b", "2020-04-19", "y", "s")],
                                     "post_id string, timestamp string, text string, source string")
    windows = wd.build_windows(wd.posts_from_messages(messages, "1 day"))
    path = str(tmp_path / "w")
    files.write_windows_batch(windows, 9, path)
    files.write_windows_batch(windows.withColumn("texts", F.array(F.lit("new"))), 10, path)
    rows = read_windows(spark, path).orderBy("window_id").collect()
    assert [r["window_id"] for r in rows] == [18371, 18373] and all(r["texts"] == ["new"] for r in rows)
    assert wd.window_by_id(read_windows(spark, path), 18373).count() == 1


def test_prepared_texts(spark):
    df = spark.createDataFrame([("a �b",), ("��",), ("  padded\t",)], "text string")
    assert [r["text"] for r in wd.prepare_texts(df).collect()] == ["a b", "padded"]


def test_csv_sources(spark, tmp_path):
    (tmp_path / "b.csv").write_text('created_at,original_text,extra\n2020-01-02,"two\nlines, ""quoted""",z\n2020-01-03,  three  ,z\n')
    (tmp_path / "a.csv").write_text("created_at,original_text\n2020-01-01,one\n,empty date\n")
    df = with_row_index(read_posts_csv(spark, str(tmp_path)))
    rows = {r["row_index"]: r for r in df.collect()}
    assert rows["0"]["original_text"] == "one" and rows["1"]["created_at"] is None
    assert rows["2"]["original_text"] == 'two\nlines, "quoted"' and rows["3"]["original_text"] == "  three  "
    assert read_posts_csv(spark, str(tmp_path), columns=["created_at"]).columns[0] == "created_at"
    assert read_posts_csv(spark, str(tmp_path / "a.csv")).count() == 2
    with pytest.raises(ValueError):
        read_posts_csv(spark, str(tmp_path / "missing"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        read_posts_csv(spark, str(tmp_path / "empty"))


def test_kafka_options():
    options = kafka.read_options("host:9092", "posts", max_offsets_per_trigger=20000)
    assert options["subscribe"] == "posts" and options["failOnDataLoss"] == "false"
    assert options["startingOffsets"] == "earliest" and options["maxOffsetsPerTrigger"] == "20000"
    assert "maxOffsetsPerTrigger" not in kafka.read_options("host:9092", "posts")


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows, two thirds of them in one window."""
    n = F.col("id")
    window = F.when(n % 3 > 0, F.lit(7)).otherwise(n % 11).cast("long")
    return spark.range(3000).select(window.alias("window_id"), F.concat(F.lit("p"), n.cast("string")).alias("post_id")).cache()


def expected_order(rows, seed):
    import hashlib

    def key(r):
        return hashlib.md5(f"{seed}#{r['window_id']}#{r['post_id']}".encode()).hexdigest() + "#" + r["post_id"]

    groups = {}
    for r in rows:
        groups.setdefault(r["window_id"], []).append(r)
    return {w: [r["post_id"] for r in sorted(g, key=key)] for w, g in groups.items()}


def test_samples_match_brute_force(skewed):
    order = expected_order(skewed.collect(), 5)
    got = {}
    for r in sp.sample_per_window(skewed, 100, 5).orderBy("rn").collect():
        got.setdefault(r["window_id"], []).append(r["post_id"])
    assert got == {w: ids[:100] for w, ids in order.items()}


def test_splits_match_brute_force(skewed):
    order = expected_order(skewed.collect(), 5)
    got = {r["post_id"]: r["is_heldout"] for r in sp.holdout_split(skewed, 0.35, 5).collect()}
    for ids in order.values():
        n = round(len(ids) * 0.35)
        assert [got[i] for i in ids] == [True] * n + [False] * (len(ids) - n)
    pooled = sp.split_reference(skewed, 0.5, 5)
    assert pooled.filter("is_threshold").count() == 1500
    assert sp.split_reference(skewed, 0.0, 5).filter("is_threshold").count() == 0
    assert sp.split_reference(skewed, 1.0, 5).filter("is_threshold").count() == 3000


def test_null_groups_and_unlimited_samples(spark):
    rows = [(w, f"p{i}") for i, w in enumerate([1] * 30 + [None] * 20 + [2] * 5)]
    df = spark.createDataFrame(rows, "window_id bigint, post_id string")
    for n, expected in ((7, {1: 7, None: 7, 2: 5}), (0, {1: 30, None: 20, 2: 5}), (-1, {1: 30, None: 20, 2: 5})):
        got = sp.sample_per_window(df, n, 3).collect()
        assert {w: sum(r["window_id"] == w for r in got) for w in (1, None, 2)} == expected
        assert sorted(r["rn"] for r in got if r["window_id"] is None) == list(range(1, expected[None] + 1))
    marked = sp.holdout_split(df, 0.4, 3).collect()
    assert {w: sum(r["is_heldout"] for r in marked if r["window_id"] == w) for w in (1, None, 2)} == {1: 12, None: 8, 2: 2}
    assert len(marked) == 55


def test_ranks_are_permutations(skewed):
    keyed = skewed.withColumn("order_key", rk.order_key(5, "window_id", "post_id", tie="post_id"))
    order = expected_order(skewed.collect(), 5)
    for r in rk.rank_by_hash(keyed, ["window_id"]).collect():
        assert order[r["window_id"]][r["rank"]] == r["post_id"]
    natural = rk.global_rank(skewed, ["window_id", "post_id"], "place", partitions=7)
    assert [(r["window_id"], r["post_id"]) for r in natural.orderBy("place").collect()] == sorted(
        (r["window_id"], r["post_id"]) for r in skewed.collect())
    assert sorted(r["place"] for r in natural.collect()) == list(range(3000))
    assert sorted(r["rank"] for r in rk.permute(skewed, 3, "post_id").collect()) == list(range(3000))


def test_fingerprint_ignores_order_and_sees_changes(spark, skewed):
    a = wd.fingerprint(skewed, ["window_id", "post_id"]).first()
    b = wd.fingerprint(skewed.orderBy(F.rand(1)).repartition(5), ["window_id", "post_id"]).first()
    changed = wd.fingerprint(skewed.withColumn("post_id", F.when(F.col("post_id") == "p5", "q").otherwise(F.col("post_id"))),
                             ["window_id", "post_id"]).first()
    assert a == b and a != changed


def test_samples_are_cut_before_the_shuffle(skewed):
    plan = sp.sample_per_window(skewed, 1000, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_period_filter_reaches_the_scan(spark, tmp_path):
    rows = spark.createDataFrame([("2020-04-19T00:00:00", 1), ("2020-05-31T23:00:00", 2), ("2020-06-01T00:00:00", 3)], "window_start string, n int")
    rows.write.parquet(str(tmp_path / "p"))
    kept = wd.in_period(spark.read.parquet(str(tmp_path / "p")), "2020-04-19", "2020-05-31")
    assert [r["n"] for r in kept.orderBy("n").collect()] == [1, 2]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(window_start,2020-04-19)" in plan and "LessThan(window_start,2020" in plan


def test_texts_of_keys_that_come_once_are_not_shuffled(spark):
    rows = [("a", "2024-01-01 10:00:00", "x", "s"), ("a", "2024-01-01 10:00:00", "x", "s"), ("b", "2024-01-01", "y", "s"),
            ("b", "2024-01-01T00:00:00", "y", "s"), ("c", "2024-01-02 00:00:00", "z", "s"), (None, "2024-01-02", "n", "s"),
            (None, "2024-01-02", "n", "s"), ("d", "bad", "t", "s"), ("d", "bad", "t", "s"), ("e", "2024-01-02", "#", None)]
    messages = spark.createDataFrame(rows, "post_id string, timestamp string, text string, source string")
    posts = wd.posts_from_messages(messages, "1 day")
    assert sorted((r["post_id"], r["text"], r["window_id"]) for r in posts.collect()) == [
        ("a", "x", 19723), ("b", "y", 19723), ("c", "z", 19724), ("e", "#", 19724)]
    single = wd.posts_from_messages(messages.filter("post_id = 'c'"), "1 day")
    plan = single._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan
    assert plan.index("Union") < plan.index("Aggregate")              # only the branch of repeated keys is deduplicated


def test_part_search_counts_like_a_filter(spark):
    begins = [3, 5, 8, 13, 21]
    rows = spark.createDataFrame([(k, begins[:n] if n >= 0 else None) for k in range(25) for n in range(-1, 6)], "here int, begins array<int>")
    plain = F.greatest(F.coalesce(F.size(F.filter("begins", lambda b: b <= F.col("here"))), F.lit(0)), F.lit(0))
    assert rows.filter(wd._part_of(F.col("begins"), F.col("here")) != plain).count() == 0


def test_marks_never_change_a_cleaning(spark):
    texts = [None, "", "  RT @u: Hi", "see HTTP://x.y www.z", "#a ##b # c", "wow!!! ?? . ..", "x &amp;amp; y", "a\t\n b\x0b\fc\rd", " x  y", "@@a @"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.lower("text")
    for pattern, replacement in tx.CLEANING_RULES:
        plain = F.regexp_replace(plain, pattern, replacement)
    assert rows.filter(~F.trim(plain).eqNullSafe(tx.clean_text(F.col("text")))).count() == 0
    assert len(tx.RULE_MARKS) == len(tx.CLEANING_RULES)


def test_many_csv_files_need_one_header_job_for_each_header(spark, tmp_path, monkeypatch):
    from tidemark.sources import posts
    for k in range(12):
        names = "a,b" if k % 2 else "b,a"
        (tmp_path / f"p{k:02d}.csv").write_text(("\n" if k == 4 else "") + f'{names}\n"x\n{k}",y\n')
    asked, header = [], posts._header
    monkeypatch.setattr(posts, "_header", lambda spark, file: asked.append(file) or header(spark, file))
    rows = posts.read_posts_csv(spark, str(tmp_path)).select("a", "b").collect()
    assert len(asked) == 2 and sorted(r["a"] for r in rows if r["b"] == "y") == sorted(f"x\n{k}" for k in range(1, 12, 2))
    assert sum(r["a"] == "y" for r in rows) == 6


def test_published_files_are_compressed(spark, tmp_path):
    rows = spark.createDataFrame([("tweet_2", "2020-01-02", "b", "s"), ("tweet_1", "2020-01-01", "a", "s")], "post_id string, timestamp string, text string, source string")
    files.publish(rows, str(tmp_path / "t"))
    assert [p.parent.name for p in sorted(tmp_path.glob("t/day=*/*.json.gz"))] == ["day=2020-01-01", "day=2020-01-02"]
    assert {r["key"] for r in spark.read.json(str(tmp_path / "t")).collect()} == {"tweet_1", "tweet_2"}
