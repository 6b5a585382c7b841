"""Nulls, blanks, long texts, ties, repeated rows, clashing columns and empty tables, for operators and stages."""
import public_tokenizers
import pytest
from conftest import SF

import corpus_pipeline
from tidemark.llm import bpe, contamination, html, chat, langid, lm, minhash, quality, suffixes, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")
ITEM = "the same sentence stands here again and again"
OPERATORS = {
    "bpe": lambda d, s: bpe.encode(d, PATH),
    "contamination": lambda d, s: contamination.contaminated(d, s.createDataFrame([(1, ITEM), (2, None), (None, "x"), (3, ""), (1, ITEM), (4, "one")], "item_id bigint, text string")),
    "langid": lambda d, s: langid.predict(d, langid.fit(d)),
    "lm": lambda d, s: lm.score(d, d),
    "minhash": lambda d, s: minhash.near_duplicates(d),
    "quality": lambda d, s: quality.quality(d),
    "suffixes": lambda d, s: suffixes.repeated_spans(d),
    "without": lambda d, s: suffixes.without_repeats(d),
    "toxicity": lambda d, s: toxicity.score(d, toxicity.fit(d, d.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(name, odd, spark):
    rows = [r.asDict(recursive=True) for r in OPERATORS[name](odd, spark).collect()]
    if name == "contamination":
        assert {(r["doc_id"], r["item_id"]) for r in rows} == {(5, 1), (6, 1), (8, 4)}
        return
    if name == "without":                     # blank texts and copies have no word left
        assert {7, 8, None} <= {r["doc_id"] for r in rows} <= {4, 7, 8, None}
        return
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd.collect())
    of = {r["doc_id"]: r for r in rows}
    if name == "bpe":
        assert of[1]["n_tokens"] == of[2]["n_tokens"] == of[3]["n_tokens"] == 0 and of[4]["n_tokens"] > 60_000
    if name == "langid":
        assert of[1]["lang_pred"] == of[3]["lang_pred"] == "und"
    if name == "lm":
        assert of[1]["n_tokens"] == of[2]["n_tokens"] == 1 and of[4]["n_tokens"] == 60_001
    if name == "minhash":
        assert of[5]["component_id"] == of[6]["component_id"] == 5 and not of[6]["kept"] and not of[None]["kept"]
        assert of[1]["n_shingles"] == 0 and of[1]["kept"]
    if name == "quality":
        assert of[1]["n_words"] == of[3]["n_words"] == 0 and of[1]["base_failed"] and of[4]["n_words"] == 60_000
    if name == "suffixes":
        assert of[1]["n_bytes"] == 0 and of[1]["removed"] == [] and of[6]["kept_bytes"] == b"" and of[8]["kept_bytes"] == b"one"
    if name == "toxicity":
        assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, odd, spark):
    assert OPERATORS[name](odd.where("false"), spark).collect() == []


def test_empty_pages_and_conversations(spark):
    assert html.extract(spark.createDataFrame([], "page_id bigint, url string, html string, text string, host string")).collect() == []
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string, formatted int")
    assert chat.read_conversations(chat.format_conversations(empty)).collect() == []


def test_odd_conversations(spark):
    rows = [(None, 1, "user", "a"), (1, None, None, None), (1, 1, "user", "b"), (1, 1, "user", "b"), (2, 0, "user", "x " * 200_000)]
    found = {r["conv_id"]: r for r in chat.read_conversations(chat.format_conversations(
        spark.createDataFrame([(*r, 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted int"))).collect()}
    assert [len(found[c]["turns"]) for c in (None, 1, 2)] == [1, 3, 1]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns(name, stage, odd, spark):
    for frame in (odd, odd.where("false")):
        out = stage(spark, frame, SF)
        assert out.columns == frame.columns
        rows = out.collect()
        ids = [r["doc_id"] for r in frame.collect()]
        assert {r["doc_id"] for r in rows} <= set(ids)
        stays = {"near-duplicates": [None, 1, 2, 3, 4, 5, 7, 8], "benchmark items": ids}.get(name)
        if stays and ids:
            assert sorted(str(r["doc_id"]) for r in rows) == sorted(map(str, stays))
        if name == "repeated passages" and ids:
            assert {None, 7, 8} <= {r["doc_id"] for r in rows}


@pytest.mark.parametrize("kind", ["bigint", "int", "string"])
def test_rows_without_id_stay_once(spark, kind):
    """Different texts without an id all stay, copies among them once, and none beside a document with an id."""
    texts = [" ".join(f"{a}{k}" for k in range(30)) for a in "abcd"]
    rows = [(None, texts[0]), (None, texts[0]), (9, texts[1]), (None, texts[1]), (None, texts[2]), (10, texts[3]), (2, texts[3] + " more"), (None, None), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr(f"cast(doc_id as {kind}) doc_id", "text", "1 as __key")
    found = corpus_pipeline.near_duplicates(spark, frame, SF)
    assert found.columns == frame.columns and found.schema["doc_id"].dataType == frame.schema["doc_id"].dataType
    least = (10, texts[3]) if kind == "string" else (2, texts[3] + " more")           # "10" comes before "2"
    want = [(None, texts[0]), (9, texts[1]), (None, texts[2]), least, (None, None)]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in found.collect()))) == sorted(
        str((i if i is None or kind != "string" else str(i), t)) for i, t in want)


def test_text_ids_link_like_numbers(spark):
    rows = [(k, " ".join(f"w{(k // 3 * 50) + j}" for j in range(20 + k % 3))) for k in range(12)] + [(None, "w0 w1 w2")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    plain = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.near_duplicates(frame, 2).collect()}
    named = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.near_duplicates(frame.selectExpr("'d' || lpad(doc_id, 3, '0') doc_id", "text"), 2).collect()}
    assert named == {k if k is None else f"d{k:03d}": (c if c is None else f"d{c:03d}", kept) for k, (c, kept) in plain.items()}
    assert {c for c, _ in plain.values()} == {0, 3, 6, 9, None}


def test_last_stage(odd, spark):
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).count() == odd.count()
