"""The pipeline against plain versions of its stages, one after another on what the stage before kept."""
import hashlib

import brute
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
from conftest import SF
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import quality


def accepted(docs):
    """Quality verdicts: votes by plain comparisons, the posterior of the fitted vote tables."""
    f = quality.text_features(pa.array([t for _, t in docs]))

    def share(part, whole):
        return f[part] / np.maximum(f[whole], 1)

    n, enough = f["n_words"], f["n_words"] >= 5
    capital = f["n_upper"] / np.maximum(f["n_upper"] + f["n_lower"], 1)
    length = share("word_chars", "n_words")
    rules = [
        (share("n_symbols", "n_words") > 0.3, share("n_symbols", "n_words") < 0.1),
        (share("n_marked", "n_words") > 0.2, share("n_marked", "n_words") < 0.08),
        (enough & (capital > 0.5), capital < 0.3),
        (enough & (share("n_loud", "n_words") > 0.25), share("n_loud", "n_words") < 0.05),
        (enough & (share("n_next_words", "n_words") > 0.25), share("n_next_words", "n_words") < 0.1),
        (share("n_repeat_words", "n_words") > 0.3, share("n_repeat_words", "n_words") < 0.1),
        ((n >= 40) & (share("n_new_words", "n_words") < 0.2), (n >= 40) & (share("n_new_words", "n_words") > 0.4)),
        ((f["n_lines"] >= 4) & (share("n_dup_lines", "n_lines") > 0.45), share("n_dup_lines", "n_lines") < 0.35),
        (enough & ((length > 15) | (length < 2)), (length >= 3) & (length <= 12)),
        (enough & (share("n_digits", "word_chars") > 0.5), share("n_digits", "word_chars") < 0.2),
    ]
    votes = np.stack([np.where(bad, 2, np.where(good, 0, 1)) for bad, good in rules], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    p = quality.posterior_good(votes, *quality.fit_votes(patterns, counts.astype(float)))
    return [d for d, g, words, again in zip(docs, p, n, f["n_repeat_words"]) if g >= 0.5 and words >= 20 and 100 * again <= 30 * words]


def without_repeats(docs, length):
    from collections import Counter

    data = {i: t.encode() for i, t in docs}
    seen = Counter(b[p:p + length] for b in data.values() for p in range(len(b) - length + 1))
    out = []
    for i, text in docs:
        b, gone = data[i], bytearray(len(data[i]))
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        kept, at = [], 0
        for c in text:
            size = len(c.encode())
            if not all(gone[at:at + size]):
                kept.append(c)
            at += size
        if brute.words("".join(kept)):
            out.append((i, "".join(kept)))
    return out


def test_pipeline_equals_plain_stages(spark, docs):
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    left = accepted(docs)
    groups = brute.near_components(left, 5, 80)
    left = [(i, t) for i, t in left if groups[i][1] == i]
    left = without_repeats(left, 200)
    items = [s for s in (brute.shingle_set(t, 5) for t, in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()) if s]
    left = [(i, t) for i, t in left if not any(100 * len(s & brute.shingle_set(t, 5)) >= 80 * len(s) for s in items)]
    assert sorted(found) == sorted(i for i, _ in left)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, text in left:
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
