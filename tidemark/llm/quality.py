"""Quality filtering by weak supervision: rules vote, EM weighs them, a posterior decides.

Every rule looks at one property of a text and votes good, bad or abstains. Texts are grouped by their votes
(at most 3 ** rules patterns, whatever the corpus), expectation-maximisation over the pattern counts estimates
how often each rule votes which way on good and on bad texts, and the posterior probability of being good
replaces a filter that all rules must pass. No labels are used.
"""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm import blocks as tb
from tidemark.llm.folds import prefix_for

WINDOW = 8
MIN_WORDS = 20
_EXACT = tb.SpanHash(21)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[ord("A"):ord("Z") + 1] = True
_LOWER[ord("a"):ord("z") + 1] = True
_DIGIT[ord("0"):ord("9") + 1] = True
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_next_words",
            "n_new_words", "n_upper", "n_lower", "n_loud", "n_marked", "n_digits"]
# The prior of the vote tables: a rule seldom votes bad on a good text, and most bad texts have one kind of fault
# only. Its weight is a share of the corpus, so it acts alike at every size.
PRIOR_WEIGHT = 0.25
PRIOR_BAD = 0.1
# (good, abstain, bad) votes expected on good and on bad texts before any data are seen.
PRIOR_GOOD_VOTES = (0.88, 0.11, 0.01)
PRIOR_BAD_VOTES = (0.70, 0.10, 0.20)


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _again(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value was there earlier in its row, and whether its row has it twice or more."""
    order = np.lexsort((np.arange(len(values)), values, rows))
    v, r = values[order], rows[order]
    same = np.zeros(len(v) + 1, bool)
    same[1:-1] = (v[1:] == v[:-1]) & (r[1:] == r[:-1])
    earlier, twice = np.empty(len(v), bool), np.empty(len(v), bool)
    earlier[order] = same[:-1]
    twice[order] = same[:-1] | same[1:]
    return earlier, twice


def text_features(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts of every text; words are runs of characters other than ASCII white space."""
    flat, offsets = tb.utf8(column)
    n = len(column)
    starts, ends, rows = tb.word_spans(flat, offsets)
    prefix = _EXACT.prefixes(flat)
    words = _EXACT.spans(prefix, starts, ends)
    first = tb.counted(rows, n)[1]
    char = tb.code_points(flat)
    out = {"n_words": first[1:] - first[:-1], "word_chars": _sums(char & ~tb.WHITE[flat], offsets), "n_symbols": _sums(_SYMBOLS[flat], offsets)}
    # Lines: from a text's start or a line feed to the next line feed or the text's end.
    feeds = np.flatnonzero(flat == 10)
    full = offsets[1:] > offsets[:-1]
    line_start = np.sort(np.concatenate([offsets[:-1][full], (feeds + 1)[~np.isin(feeds + 1, offsets)]]))
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    line_end = np.concatenate([line_start[1:], [len(flat)]])[:len(line_start)]
    line_end = line_end - ((line_end > line_start) & (flat[np.maximum(line_end - 1, 0)] == 10) if len(flat) else 0)
    ink = np.concatenate([[0], np.cumsum(~tb.WHITE[flat], dtype=np.int64)])
    has = ink[line_end] > ink[line_start]
    line_start, line_end, line_row = line_start[has], line_end[has], line_row[has]
    earlier, _ = _again(_EXACT.spans(prefix, line_start, line_end), line_row)
    out["n_dup_lines"] = np.bincount(line_row, weights=earlier, minlength=n).astype(np.int64)
    # Words covered by windows that the text has twice or more.
    window = tb.chained(words, WINDOW)
    at = np.flatnonzero(np.arange(len(window)) + WINDOW <= first[rows[:len(window)] + 1]) if len(window) else np.zeros(0, np.int64)
    _, twice = _again(window[at], rows[at])
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(rows, weights=np.cumsum(cover[:-1]) > 0, minlength=n).astype(np.int64)
    out["n_lines"] = np.bincount(line_row, minlength=n)
    next_same = np.zeros(len(words), bool)
    next_same[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    out["n_next_words"] = np.bincount(rows, weights=next_same, minlength=n).astype(np.int64)
    out["n_new_words"] = np.bincount(rows, weights=~_again(words, rows)[0], minlength=n).astype(np.int64)
    out["n_upper"], out["n_lower"] = _sums(_UPPER[flat], offsets), _sums(_LOWER[flat], offsets)
    bangs = np.concatenate([[0], np.cumsum(flat == ord("!"))])
    marks = np.concatenate([[0], np.cumsum(_SYMBOLS[flat])])
    out["n_loud"] = np.bincount(rows, weights=bangs[ends] > bangs[starts], minlength=n).astype(np.int64)
    out["n_marked"] = np.bincount(rows, weights=marks[ends] > marks[starts], minlength=n).astype(np.int64)
    out["n_digits"] = _sums(_DIGIT[flat], offsets)
    return out


def _measure(mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.blocks(batches, "text", tb.SMALL_BLOCK_BYTES):
            found = text_features(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(found[f], pa.int64()) for f in FEATURES)], names=[*batch.schema.names, *(mark + f for f in FEATURES)])

    return run


def rules(mark: str = "") -> dict[str, tuple[Column, Column]]:
    """Name -> (votes bad, votes good) over the counts, named with `mark` before; a rule abstains where neither holds."""
    def col(name: str) -> Column:
        return F.col(mark + name)

    def share(part: str, whole: str) -> Column:
        return col(part) / F.greatest(col(whole), F.lit(1))

    enough = col("n_words") >= 5
    letters = col("n_upper") / F.greatest(col("n_upper") + col("n_lower"), F.lit(1))
    length = share("word_chars", "n_words")
    return {
        "symbols": (share("n_symbols", "n_words") > 0.3, share("n_symbols", "n_words") < 0.1),
        "marked_words": (share("n_marked", "n_words") > 0.2, share("n_marked", "n_words") < 0.08),
        "capitals": (enough & (letters > 0.5), letters < 0.3),
        "loud_words": (enough & (share("n_loud", "n_words") > 0.25), share("n_loud", "n_words") < 0.05),
        "next_words": (enough & (share("n_next_words", "n_words") > 0.25), share("n_next_words", "n_words") < 0.1),
        "repeats": (share("n_repeat_words", "n_words") > 0.3, share("n_repeat_words", "n_words") < 0.1),
        "vocabulary": ((col("n_words") >= 40) & (share("n_new_words", "n_words") < 0.2), (col("n_words") >= 40) & (share("n_new_words", "n_words") > 0.4)),
        "lines": ((col("n_lines") >= 4) & (share("n_dup_lines", "n_lines") > 0.45), share("n_dup_lines", "n_lines") < 0.35),
        "word_length": (enough & ((length > 15) | (length < 2)), length.between(3, 12)),
        "digits": (enough & (share("n_digits", "word_chars") > 0.5), share("n_digits", "word_chars") < 0.2),
    }


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Share of bad texts and P(vote | class) [rule, class, vote] by maximum a posteriori EM.

    patterns: votes 0 good, 1 abstain, 2 bad, a line for each pattern. Without patterns the prior is the result.
    """
    n_rules = patterns.shape[1]
    prior = np.tile(np.array([PRIOR_GOOD_VOTES, PRIOR_BAD_VOTES]), (n_rules, 1, 1))
    bad, votes = PRIOR_BAD, prior.copy()
    total = counts.sum()
    one_hot = patterns[:, :, None] == np.arange(3)
    for _ in range(rounds if total else 0):
        p = posterior_good(patterns, bad, votes)
        before = bad
        weights = np.stack([p, 1 - p]) * counts
        for c in range(2):
            seen = np.einsum("p,prv->rv", weights[c], one_hot)
            strength = PRIOR_WEIGHT * weights[c].sum() + 1
            votes[:, c] = (seen + strength * prior[:, c]) / (weights[c].sum() + strength)
        bad = (weights[1].sum() + PRIOR_WEIGHT * total * PRIOR_BAD + 1e-3) / (total * (1 + PRIOR_WEIGHT) + 1e-2)
        if abs(bad - before) < 1e-9:
            break
    return float(bad), votes


def posterior_good(patterns: np.ndarray, bad: float, votes: np.ndarray) -> np.ndarray:
    at = np.arange(patterns.shape[1])
    good_log = np.log(1 - bad) + np.log(votes[at, 0, patterns]).sum(1)
    bad_log = np.log(bad) + np.log(votes[at, 1, patterns]).sum(1)
    return 1 / (1 + np.exp(np.clip(bad_log - good_log, -500, 500)))


def quality(docs: DataFrame) -> DataFrame:
    """All columns of `docs` (with text) plus the counts, the votes, p_good, base_failed and kept.

    A null or blank text has zero counts and fails the base rule. Names of `docs` that clash with the added
    columns are replaced. The corpus is read twice: to count vote patterns and to filter.
    """
    mark = prefix_for(docs)
    named = rules(mark)
    added = {*FEATURES, "votes", "p_good", "base_failed", "kept"}
    own = [c for c in docs.columns if c not in added]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema] + [f"{mark}{f} bigint" for f in FEATURES])
    measured = docs.select(*own).mapInArrow(_measure(mark), schema)
    vote = [F.when(bad, "2").when(good, "0").otherwise("1") for bad, good in named.values()]
    voted = measured.withColumn("votes", F.concat(*vote))
    failed = (F.col(f"{mark}n_words") < MIN_WORDS) | (100 * F.col(f"{mark}n_repeat_words") > 30 * F.col(f"{mark}n_words"))
    only = docs.select("text").mapInArrow(_measure(mark), "text string, " + ", ".join(f"{mark}{f} bigint" for f in FEATURES)) \
        .select(F.concat(*vote).alias("votes"))
    seen = only.groupBy("votes").count().collect()          # one row for each pattern at most
    patterns = np.array([[int(v) for v in r["votes"]] for r in seen], np.int64).reshape(-1, len(named))
    bad, votes = fit_votes(patterns, np.array([r["count"] for r in seen], float))
    return voted.withColumn("p_good", _posterior(bad, votes)).select(
        *own, *(F.col(mark + f).alias(f) for f in FEATURES), "votes", "p_good", failed.alias("base_failed"),
        (~failed & (F.col("p_good") >= 0.5)).alias("kept"))


def _posterior(bad: float, votes: np.ndarray) -> Column:
    """The same posterior as an expression over the vote string."""
    odds = F.lit(float(np.log(bad) - np.log(1 - bad)))
    ratio = np.log(votes[:, 1]) - np.log(votes[:, 0])
    for k, line in enumerate(ratio):
        digit = F.substring("votes", k + 1, 1)
        odds = odds + F.when(digit == "0", float(line[0])).when(digit == "1", float(line[1])).otherwise(float(line[2]))
    return 1 / (1 + F.exp(odds))

