"""Lexical search and nearest neighbours against brute force, and their edge cases."""
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidemark.llm import lexical, neighbours


def plain_search(docs, items):
    """item -> [(doc_id, score)] by scoring every document."""
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    counts = [(i, Counter(terms(t))) for i, t in docs]
    total, length = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = {}
    for item, own in wanted.items():
        scored = []
        for i, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * total) // max(1, length)
            scored.append((sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if c[t]), i))
        best = sorted((-s, i is None, i) for s, i in scored if s > 0)[:10]
        out[item] = [(i, -s) for s, _, i in best]
    return {k: v for k, v in out.items() if v}


def found_by(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        out.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(out[r["item_id"]])
    return out


def test_lexical_equals_brute_force(spark, docs, answer):
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    assert found_by(answer("op12_lexical")) == plain_search(docs, items)


def test_lexical_with_small_buckets_and_rounds(spark, monkeypatch):
    """Pruning at work: many buckets and blocks, several rounds of items; hot copies, nulls, ties, ids that are text."""
    for name, value in (("BUCKET_ROWS", 8), ("BLOCK_TERMS", 200), ("ITEM_BYTES", 60)):
        monkeypatch.setattr(lexical, name, value)
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(40)] + ["É", "日本", "x1"]
    rows = [(f"d{k:03d}", " ".join(rng.choice(words, rng.integers(0, 30)))) for k in range(300)] + [("copy", "W1 w2, w3!")] * 40
    rows += [(None, "w1 w1 w2"), ("blank", " .\n"), ("none", None), ("long", "w7 " * 5000 + "w8")]
    items = [(1, "w1 w2 W3 w3"), (2, "É w9-w10"), (2, "w11"), (3, None), (4, ""), (5, "absent"), (None, "w8 w7"), (6, "日本 x1 w30 w31")]
    frame = spark.createDataFrame([(*r, None) for r in rows], "doc_id string, text string, score double").repartition(5)
    found = lexical.search(frame, spark.createDataFrame([(*r, "x") for r in items], "item_id int, text string, rank string")).collect()
    assert found_by(found) == plain_search(rows, items)


def test_lexical_of_empty_tables(spark):
    docs, items = (spark.createDataFrame([], f"{c} bigint, text string") for c in ("doc_id", "item_id"))
    one = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert lexical.search(docs, one.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert lexical.search(one, items).count() == 0
    assert lexical.search(one, one.withColumnRenamed("doc_id", "item_id").withColumn("text", F.lit("?"))).count() == 0


def exact(ids, vectors, query, own, k=20):
    scores = [(sum(float(a) * float(b) for a, b in zip(query, v)), i) for i, v in zip(ids, vectors) if i != own]
    return sorted({(-s, i) for s, i in scores})[:k]


def test_neighbours_reach_their_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 64)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16)) * 0.4).astype(np.float32)
    frame = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(6)
    found, hits = {}, 0
    for r in neighbours.search(frame, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = r
    assert set(found) == set(range(0, 3000, 20))
    for q, by_rank in found.items():
        assert sorted(by_rank) == list(range(1, 21))
        scores = neighbours.inner(x.astype(float), x[q].astype(float))
        best = np.lexsort((np.arange(3000), -scores))
        hits += len({int(i) for i in best[best != q][:20]} & {r["vec_id"] for r in by_rank.values()})
        rows = [by_rank[k] for k in range(1, 21)]
        assert [r["score"] for r in rows] == [scores[r["vec_id"]] for r in rows]
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
    assert hits >= 0.9 * 20 * len(found)


def test_neighbours_of_odd_vectors(spark):
    """A third are equal; nulls, zeros, non-finite and short vectors take no part; repeated rows count once."""
    rng = np.random.default_rng(6)
    rows = [(k, rng.integers(-3, 4, 4).astype(float).tolist()) for k in range(60)] + [(100 + k, [1.0, 2.0, 0.0, 0.0]) for k in range(40)]
    rows = [(i, v) for i, v in rows if any(v)]
    odd = [(200, None), (220, [0.0] * 4), (240, [1.0, None, 2.0, 3.0]), (260, [float("nan"), 1.0, 1.0, 1.0]), (280, [float("inf"), 1.0, 1.0, 1.0]),
           (300, [1.0, 2.0]), (320, []), (None, [1.0, 1.0, 1.0, 1.0]), rows[0], rows[0]]
    frame = spark.createDataFrame([(*r, None) for r in rows + odd], "vec_id bigint, embedding array<double>, score string").repartition(4)
    found = {}
    for r in neighbours.search(frame, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"], r["rank"]))
    ids, vectors = [i for i, _ in rows], [v for _, v in rows]
    assert set(found) == {i for i in ids if i % 20 == 0}
    for q, got in found.items():
        got.sort(key=lambda r: r[2])
        assert [r[:2] for r in got] == exact(ids, vectors, dict(rows)[q], q)


def test_neighbours_of_few_and_no_rows(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (20, [-1.0])], "vec_id bigint, embedding array<double>")
    rows = neighbours.search(frame, F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, rows)) == [(0, 1, 1, 2.0), (0, 2, 20, -1.0), (20, 1, 0, -1.0), (20, 2, 1, -2.0)]
    assert neighbours.search(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.search(frame.where("vec_id = 1"), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.search(frame.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_visits_widen_with_the_recall():
    rng = np.random.default_rng(7)
    tree = neighbours.Tree(rng.normal(size=(2000, 8)), 40)
    assert tree.n_leaves == 40 and set(tree.assign(rng.normal(size=(500, 8)))) <= set(range(40))
    queries = rng.normal(size=(30, 8))
    assert all(sorted(v) == list(range(40)) for v in tree.visits(queries, 40))
    leaves = [[int(x) for x in rng.integers(0, 40, 20)] for _ in queries]
    few, many, full = (neighbours.calibrated(tree, queries, leaves, r) for r in (0.3, 0.8, 1.0))
    assert few < many <= full <= 40
