"""What queries and operators keep on disk and on the driver."""
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.operators import concept as cd, injection as inj, training as tr, windowing as wd
from tidemark.plans.catalog import ingestion, streams, vectors
from tidemark.sinks import files
from tidemark.sources.posts import read_posts_csv, with_row_index


@pytest.fixture
def tables(spark, tmp_path):
    """A folder with small tables `events` and `documents`."""
    start = datetime(2024, 1, 1)
    kinds = ["click", "view", "signup", "error", "purchase"]
    events = [(i, start + timedelta(hours=12 * i), i % 7, kinds[i % 5], float(i % 100) + 3.5, "{}") for i in range(58)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(
        f"{tmp_path}/tables/events.parquet")
    documents = [(i, f'text "{i}"\nof, more\nlines', "en", "s", 20) for i in range(11)]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/tables/documents.parquet")
    return f"{tmp_path}/tables"


def into(tmp_path, monkeypatch, module):
    """Scratch folders of the module's queries lie in a folder of the test."""
    monkeypatch.setattr(module, "scratch", lambda spark, name: f"{tmp_path}/scratch/{name}")


def test_late_messages_are_stored_compressed(spark, tables, tmp_path, monkeypatch):
    into(tmp_path, monkeypatch, streams)
    assert streams.late_rows(spark, tables).count() == 1
    stored = list((tmp_path / "scratch/messages").glob("part-*"))
    assert stored and all(p.name.endswith(".json.gz") for p in stored)


def test_csv_row_index_stores_no_plain_texts(spark, tables, tmp_path, monkeypatch):
    into(tmp_path, monkeypatch, ingestion)
    rows = ingestion.csv_row_index(spark, tables).collect()
    assert sorted(r["place"] for r in rows) == list(range(len(rows))) and len(rows) >= 58
    stored = list((tmp_path / "scratch/csv").glob("part-*"))
    assert stored and all(p.name.endswith(".csv.gz") for p in stored)


def test_compressed_csv_is_read_as_plain_csv_is(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-0{i}", f' quoted "text", {i}\nnext line ') for i in range(1, 7)], "created_at string, original_text string").coalesce(1)
    files.write_csv(rows, f"{tmp_path}/plain")
    files.write_csv(rows, f"{tmp_path}/packed", "gzip")
    found = [{tuple(r) for r in with_row_index(read_posts_csv(spark, f"{tmp_path}/{name}")).collect()} for name in ("plain", "packed")]
    assert found[0] == found[1] and len(found[0]) == 6


def stored_columns(monkeypatch, module):
    """Columns of every table that the module stores from here on."""
    store, seen = module.cut_lineage, []

    def kept(df, *args, **more):
        seen.append(df.columns)
        return store(df, *args, **more)

    monkeypatch.setattr(module, "cut_lineage", kept)
    return seen


def test_injected_texts_are_not_stored(spark, monkeypatch):
    params = inj.StreamParams(n_windows=12, reference_windows=3, window_size=20, change_point=5, gradual_length=3, volume_factor=2)
    rows = [(pool, f"{pool}{k}", f"{pool} text {k}", k % 4) for pool in ("old", "new") for k in range(400)]
    pools = spark.createDataFrame(rows, "pool string, post_id string, text string, source_window_id long").repartition(3)
    seen = stored_columns(monkeypatch, inj)
    injected = inj.inject_drift(pools, inj.injection_plan(spark, params), params)
    parts = inj.injected_windows(injected, max_part_rows=15).collect()
    assert seen and not any("text" in columns for columns in seen)
    whole = {(r["scenario"], r["position"]): r for r in inj.injected_windows(injected).collect()}
    assert len(parts) > len(whole) == 48 and max(len(r["texts"]) for r in parts) <= 15
    for key, row in whole.items():
        mine = sorted((r for r in parts if (r["scenario"], r["position"]) == key), key=lambda r: r["part"])
        assert [t for r in mine for t in r["texts"]] == row["texts"]
        assert [r["part_offset"] for r in mine] == [sum(len(q["texts"]) for q in mine[:i]) for i in range(len(mine))]


def test_injected_rows_of_one_order_key_stay_in_one_part(spark):
    rows = [("volume", 8, "stream", 20, "2020-01-21", "2020-01-22", f"p{k}", f"text {k} {copy}", f"{k:03d}") for k in range(10) for copy in range(3)]
    frame = spark.createDataFrame(rows, "scenario string, position int, phase string, window_id long, window_start string, window_end string, post_id string, text string, order_key string")
    parts = sorted(inj.injected_windows(frame, max_part_rows=4).collect(), key=lambda r: r["part"])
    assert [r["part"] for r in parts] == list(range(len(parts))) and len(parts) > 1
    assert [r["part_offset"] for r in parts] == [sum(len(q["texts"]) for q in parts[:i]) for i in range(len(parts))]
    assert [t for r in parts for t in r["texts"]] == [r[7] for r in sorted(rows, key=lambda r: (r[8], r[6], r[7]))]


def posts_of_days(spark, n):
    rows = [(f"p{i:03d}", f"2020-04-{19 + i % 2} 00:00:{i % 60:02d}", f"text {i}", "s") for i in range(n)]
    return wd.posts_from_messages(spark.createDataFrame(rows, "post_id string, timestamp string, text string, source string"), "1 day")


def test_small_parts_need_no_long_list_of_their_beginnings(spark, monkeypatch):
    posts = posts_of_days(spark, 90)
    assert wd._layout(posts, 2, wd.MAX_PART_BYTES).filter("begins IS NOT NULL").isEmpty()
    plain = {r["window_id"]: r for r in wd.build_windows(posts).collect()}
    monkeypatch.setattr(wd, "MAX_PART_ROWS", 20)       # a stretch is six parts of three posts
    assert {len(r["begins"]) for r in wd._layout(posts, 3, wd.MAX_PART_BYTES).collect()} == {2}
    parts = wd.build_windows(posts, max_part_rows=3).collect()
    for window_id, whole in plain.items():
        mine = sorted((r for r in parts if r["window_id"] == window_id), key=lambda r: r["part"])
        assert [(r["part"], r["part_offset"], len(r["texts"])) for r in mine] == [(i, 3 * i, 3) for i in range(15)]
        assert [i for r in mine for i in r["post_ids"]] == whole["post_ids"] and [t for r in mine for t in r["texts"]] == whole["texts"]


@pytest.mark.parametrize("limit", [0, tr.BROADCAST_BYTES])
def test_training_leaves_nothing_on_the_driver(spark, frame, monkeypatch, limit):
    sent, send = [], type(spark.sparkContext).broadcast

    def remembered(self, value):
        sent.append(send(self, value))
        return sent[-1]

    rng = np.random.default_rng(3)
    params = cd.ConceptParams(hidden_dim=8, output_dim=4, n_encoders=2, sample_set_size=5, k_pairs=2, train_epochs=3)
    rows = frame({w: rng.standard_normal((30, 6)) for w in range(4)})
    pool = tr.training_pool(cd.sub_windows(rows, 5), np.zeros(6), np.ones(6), params.seed)
    pool = tr.TrainingPool(pool.frame, pool.groups, pool.counts, pool.width, limit=limit)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", remembered)
    tr.train_encoder(rows, np.zeros(6), np.ones(6), cd.init_weights(6, params), params, pool)
    assert len(sent) >= 3 and not any(b._jbroadcast.isValid() for b in sent)


def test_cached_embedding_cleans_its_posts_once(spark, tables, tmp_path, monkeypatch):
    into(tmp_path, monkeypatch, vectors)
    seen = stored_columns(monkeypatch, vectors)
    row = vectors.embed_cached(spark, tables).first()
    assert seen == [["post_id", "event_time", "text"]]
    assert row["n_posts"] == row["n_matched"] > 40 and 0 < row["n_cached"] <= 55
