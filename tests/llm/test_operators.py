"""Registered queries against plain versions on whole small tables."""
import hashlib
import math
import zlib
from collections import Counter

import brute
import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from conftest import SF
from tokenizers import Tokenizer


def by_id(rows, key="doc_id"):
    return {r[key]: r for r in rows}


def test_bpe_equals_the_library(docs, answer):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = by_id(answer("op3_bpe"))
    assert len(found) == len(docs)
    for i, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_on_every_character_and_on_random_texts():
    from tidemark.llm.bpe import WordBpe

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), WordBpe(path)
    rng = np.random.default_rng(1)
    letters = list("abcdeés'tlmrevS  \n12#!日🙂Σσ<|>İ")
    texts = [f"ab{c}ba {c}1{c}'{c}" for c in map(chr, range(0, 0x110000, 7)) if not 0xD800 <= ord(c) < 0xE000]
    texts += ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(3000)]
    texts += ["aaaaaaaaaaaaa", "the" * 5000, "<|endoftext|><|startoftext|>a<|endoftext|", "!" * 3001, "", "o'reilly's 'll'd ''s"]
    for text, (ids, decoded), known in zip(texts, own.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == known.ids, text
        assert decoded.decode() == own.decode(ids) == library.decode(known.ids, skip_special_tokens=False)


@pytest.mark.parametrize("name", ["op5_contamination", "op6_chat"])
def test_sql_twins(name, answer):
    from tidemark.llm.queries import TWINS

    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    left, right = pd.DataFrame(answer(name)), db.sql(TWINS[name]).df()
    columns = sorted(right.columns)
    assert sorted(left.columns) == columns
    left, right = (x[columns].sort_values(columns).reset_index(drop=True) for x in (left, right))
    pd.testing.assert_frame_equal(left, right, check_dtype=False)


def test_repeats_equal_brute_force(docs, answer):
    found, expected = by_id(answer("op7_suffix")), brute.repeats(docs, 200)
    assert {i: tuple(found[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i, _ in docs} == expected


def test_repeats_in_made_texts(spark):
    """Short strings, so that edges, overlaps, periods and multi-byte characters are met often."""
    from tidemark.llm.suffixes import repeated_spans

    rng = np.random.default_rng(2)
    passage = "".join(rng.choice(list("abcdé"), 60))
    texts = ["ab" * 40, "a" * 30, passage, "xx" + passage[3:50] + "yy" + passage[:20], passage[10:] + "zz" + passage[:47], "é" * 9]
    texts += ["".join(rng.choice(list("ab"), 40)) + passage[int(k):int(k) + 25] for k in rng.integers(0, 30, 40)]
    rows = list(enumerate(texts))
    found = repeated_spans(spark.createDataFrame(rows, "doc_id bigint, text string"), 12, 4).collect()
    expected = brute.repeats(rows, 12)
    for r in found:
        spans = [(s["start"], s["end"]) for s in r["removed"]]
        assert (r["n_bytes"], sum(b - a for a, b in spans), len(spans), hashlib.sha256(r["kept_bytes"]).hexdigest()) == expected[r["doc_id"]]


def test_boundary_runs(spark, monkeypatch):
    """One passage in most texts fills many buckets; the runs that splitters cut are put together again."""
    from tidemark.llm import suffixes

    monkeypatch.setattr(suffixes, "BUCKET_ROWS", 40)
    rng = np.random.default_rng(3)
    common = "".join(rng.choice(list("abcdef"), 90))
    rows = [(i, "".join(rng.choice(list("abcdef"), 30)) + (common if i % 3 else "") + "".join(rng.choice(list("abcdef"), 30))) for i in range(120)]
    found = suffixes.repeated_spans(spark.createDataFrame(rows, "doc_id bigint, text string"), 20, 8).collect()
    expected = brute.repeats(rows, 20)
    for r in found:
        assert (r["n_bytes"], sum(s["end"] - s["start"] for s in r["removed"])) == expected[r["doc_id"]][:2]


def test_near_duplicates_equal_all_pairs(docs, answer):
    found = by_id(answer("op9_minhash"))
    expected = brute.near_components(docs, 2, 80)
    assert {i: (found[i]["n_shingles"], found[i]["component_id"]) for i, _ in docs} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found.values())


def test_near_duplicates_in_a_chain(spark):
    """Ends of a chain of edits are far apart, yet links reach from one to the other."""
    from tidemark.llm.minhash import near_duplicates

    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in rng.integers(0, 10_000, 200)]
    rows = []
    for i in range(40):
        rows.append((100 - i, " ".join(words)))
        for k in rng.integers(0, 200, 6):
            words[k] = f"v{rng.integers(0, 10_000)}"
    rows += [(1000 + i, " ".join(f"u{k}" for k in rng.integers(0, 10_000, 50))) for i in range(20)]
    found = by_id(r.asDict() for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 2, 80).collect())
    assert {i: found[i]["component_id"] for i, _ in rows} == {i: c for i, (_, c) in brute.near_components(rows, 2, 80).items()}


def test_quality_counts_and_verdicts(docs, answer):
    found = by_id(answer("op10_quality"))
    for i, text in docs:
        r = found[i]
        n, chars, symbols, dup, repeat = expected = brute.quality_base(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n)
        assert not (r["base_failed"] and r["kept"])
    labels = duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall()
    judged = [(q, found[i]["kept"]) for i, q in labels if not found[i]["base_failed"]]
    assert np.mean([bool(q) == k for q, k in judged]) > 0.95


def test_quality_expression_equals_the_posterior(spark):
    from pyspark.sql import functions as F
    from tidemark.llm import quality

    patterns = np.random.default_rng(5).integers(0, 3, (50, len(quality.rules())))
    bad, votes = quality.fit_votes(patterns, np.arange(1.0, 51))
    frame = spark.createDataFrame([("".join(map(str, p)),) for p in patterns], "votes string")
    found = [r[0] for r in frame.select(quality._posterior(bad, votes)).collect()]
    np.testing.assert_allclose(found, quality.posterior_good(patterns, bad, votes), rtol=1e-9)


def test_language_model(docs, answer):
    found = by_id(answer("op4_lm"))
    counts = Counter()
    for i, text in docs:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*brute.words(text), "\n"])
    total, distinct = sum(counts.values()), len(counts)
    for i, text in docs:
        words, r = [*brute.words(text), "\n"], found[i]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1)
    seen = [r for r in found.values() if not r["held_out"]]
    assert sum(r["score"] for r in seen) > sum(r["base_score"] for r in seen)


def test_network_gradients_and_total_probability():
    from tidemark.llm import gru

    layout = gru.Layout(20, 5, 2, 3)
    rng = np.random.default_rng(6)
    flat = layout.initial(np.ones(5), np.ones((2, 3))).astype(np.float64) + rng.normal(0, 0.1, sum(int(np.prod(s)) for s in layout.shapes().values()))
    ids, classes = rng.integers(0, 20, (6, 4)), rng.integers(0, 5, (6, 4))
    inside = np.where(classes < 2, rng.integers(0, 3, (6, 4)), -1)
    live = np.arange(6)[:, None] < np.array([6, 5, 3, 1])
    w = layout.unpack(flat)
    g, _ = gru.gradients(w, ids, classes, inside, live, np.zeros((4, gru.HIDDEN)))
    grad = np.concatenate([g[k].ravel() for k in layout.shapes()])

    def loss(x):
        # Every column is a document whose inputs lag its tokens by one; the opening symbol stands for the first.
        v = layout.unpack(x)
        table, h, total = v["emb"] @ v["wx"] + v["b"], np.zeros((4, gru.HIDDEN)), 0.0
        for t in range(6):
            after = gru.step(v, table, ids[t], h)[0]
            h = np.where(live[t][:, None], after, h)
            for k in np.flatnonzero(live[t]):
                total -= np.log(gru._softmax(h[k:k + 1] @ v["wc"] + v["bc"]))[0, classes[t, k]]
                if inside[t, k] >= 0:
                    total -= np.log(gru._softmax(h[k:k + 1] @ v["wu"][classes[t, k]] + v["bu"][classes[t, k]]))[0, inside[t, k]]
        return total / live.sum()

    for k in rng.choice(len(flat), 60, replace=False):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        assert grad[k] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-6)


@pytest.mark.parametrize("size", [0, 1, 30, 1000])
def test_model_probabilities_sum_to_one(spark, size):
    """Over all words of a vocabulary, the unknown word and the end, the first token of a text sums to 1."""
    import pyarrow as pa
    from tidemark.llm import gru, lm
    from tidemark.llm.scratch import Scratch

    words = [f"w{k}" for k in range(size)]
    texts = [(i, " ".join(words[:-(-(i + 1) * size // 30)])) for i in range(30)] if size else []
    model, _ = lm.fit(spark.createDataFrame(texts, "doc_id bigint, text string"), Scratch(spark))
    hashes = np.r_[lm.tokens(pa.array(["unseen " + " ".join(words)]))[0]]
    at, inputs, classes, inside = model.words.symbols(hashes)
    own = gru.log_likelihood(model.words.layout, model.weights, inputs, classes, inside, np.ones(len(hashes), np.int64))
    # Inside a class without places the counts decide; the unknown word has a count of a half.
    count = np.where(at >= 0, model.words.counts[at] if size else 0, 0) + 0.5
    plain = (inside < 0) & (hashes != lm.END)
    own[plain] += np.log(count[plain] / model.words.masses[classes[plain]])
    assert np.exp(own).sum() == pytest.approx(1, abs=1e-5)


def test_language(docs, answer):
    found = by_id(answer("op8_langid"))
    known = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    held = [i for i in found if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in found if found[i]["held_out"]} == set(held)
    assert np.mean([found[i]["lang_pred"] == known[i] for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_toxicity(answer):
    found = by_id(answer("op2_toxicity"))
    labels = duckdb.sql(f"select doc_id, toxic from '{SF}/labels.parquet'").fetchall()
    assert {i for i in found if found[i]["held_out"]} == {i for i in found if zlib.crc32(str(i).encode()) % 5 == 0}
    for held, least in ((False, 0.9), (True, 0.7)):
        own = [(found[i]["predicted"], t) for i, t in labels if found[i]["held_out"] == held]
        caught, toxic, called = sum(p and t for p, t in own), sum(t for _, t in own), sum(p for p, _ in own)
        assert caught >= least * toxic and caught >= least * called, (held, caught, toxic, called)


def test_glued_and_long_runs(spark):
    """Marks that glue words together and runs longer than the automaton hide no term; a calm run has no hit."""
    from tidemark.llm import toxicity

    terms = ("idiot", "moron", "rée*")
    model = toxicity.Model(terms, (True, True, False), (*[3.0] * (2 * len(terms) + 2), -2.0))
    texts = ["you idiot moron", "you are a idiot/moron", "you-idiot-moron-" + "x" * 80, "z" * 100 + "idiot" + "y" * 100, "a" * 59 + "moron",
             "calm " * 5, "z" * 500, "calm-and/quiet", "x-réeux_y", "idi0t...mor0n", "a" * 27 + "idiot" + "b" * 80]
    found = [r["predicted"] for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).orderBy("doc_id").collect()]
    assert found == [1, 1, 1, 1, 1, 0, 0, 0, 1, 1, 1]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_trie_automaton_equals_edit_distance():
    from tidemark.llm.toxicity import Trie, allowed_edits

    terms = ["idiot", "idiom", "scum", "cat", "disgusting", "abc*", "zz*"]
    rng = np.random.default_rng(7)
    words = ["", "idiot", "id1ot", "idot", "idioot", "scam", "cats", "cat", "disgustng", "dsgustng", "abcd", "abc", "ab", "zz", "x" * 80]
    for term in terms * 40:
        letters = list(term.rstrip("*"))
        for _ in range(rng.integers(0, 4)):
            k = int(rng.integers(0, len(letters) + 1))
            letters[k:k + int(rng.integers(0, 2))] = list(rng.choice(list("abcdios"), rng.integers(0, 2)))
        words.append("".join(letters))
    found, cost = Trie(terms).match(words)
    for w, t, k in zip(words, found, cost):
        near = []
        for number, term in enumerate(terms):
            if term.endswith("*"):
                near += [(0, -len(term), number)] if w.startswith(term[:-1]) else []
            elif edits(w, term) <= allowed_edits(term):
                near.append((edits(w, term), -len(term), number))
        assert (t, k if t >= 0 else 0) == ((min(near)[2], min(near)[0]) if near else (-1, 0)), w


def test_quotation_counts_less(spark):
    from tidemark.llm import toxicity

    model = toxicity.fit(spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, toxic int"))
    rows = [(1, "you are an idiot and a moron"), (2, 'the word "idiot" and the word "moron" are insults'), (3, "you are an idi0t and a morron"), (4, "a quiet text")]
    found = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    assert found[1] > 0.5 > found[2] >= found[4] and found[3] > 0.5


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="with-sidebar">
<header><a href=/>Home</a></header><nav><ul><li>Menu<li>More</ul></nav><div id="cookie-notice">We use cookies</div><!-- <p>hidden</p> -->
<main><article><h1>Title %d</h1><p>First &amp; <b>bold</b>&nbsp;word %d<br>next   line<p>Second &lt;%d&gt; paragraph<div class="ad">Buy</div>
<ul><li>item %d<li>last</ul><section class="comments"><p>Reader says no</p></section></article></main><aside>Side</aside><form>Search<input></form><footer>Foot</footer>"""


def test_html(spark, answer):
    from tidemark.llm import html

    rows = [(i, f"http://h.example/{i}", PAGE % (i, i, i, i)) for i in range(6)]
    shared = "<html><body><div><p>Same notice on every page</p><div><p>Own text number %d of this page, rather long</p></div><p>Same end</p></div></body></html>"
    rows += [(100 + i, f"http://t.example/{i}", shared % i) for i in range(8)]
    rows += [(200, None, None), (201, "http://x", ""), (202, "http://[bad", "plain text only"), (203, "http://y/", "<p>a < b <unclosed"), (203, "http://y/", "<p>a < b <unclosed")]
    found = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert found[3] == "Title 3\n\nFirst & bold word 3 next line\n\nSecond <3> paragraph\n\nitem 3\n\nlast"
    assert found[102] == "Own text number 2 of this page, rather long"
    assert (found[200], found[201], found[202]) == ("", "", "plain text only")
    whole = by_id(answer("op1_html"), "page_id")
    for page, text in duckdb.sql(f"select page_id, html from '{SF}/pages.parquet'").fetchall():
        article = text[text.index("<article>"):text.index("</article>")]
        import html as decode
        import re

        assert whole[page]["text"].split() == decode.unescape(re.sub("<[^>]*>", " ", article)).split()
        assert whole[page]["n_chars"] == len(whole[page]["text"])


def test_chat_round_trip_and_order(spark):
    from tidemark.llm import chat

    talks = {1: [("user", "a<|im_end|>\\<|"), ("assistant", "<\\|<\\\\| b<")], 2: [("assistant", "x")], 3: [("odd\nrole\\", "t"), (None, None)],
             4: [("system", ""), ("user", "q"), ("assistant", "r")], 5: [("user", "q"), ("user", "q")]}
    rows = [(c, t, r, x) for c, turns in talks.items() for t, (r, x) in enumerate(turns)]
    read = {r["conv_id"]: r for r in chat.read_conversations(chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()}
    for c, turns in talks.items():
        assert [(t["role"], t["text"]) for t in read[c]["turns"]] == [(r or "", x or "") for r, x in turns]
        assert "".join(s["text"] for s in read[c]["segments"]) == read[c]["formatted"]
        assert [chat.unescape(s["text"]) for s in read[c]["segments"] if s["loss"]] == [x or "" for r, x in turns if r == "assistant"]
    assert {c for c in read if read[c]["valid"]} == {1, 4}
