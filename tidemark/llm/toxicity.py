"""Toxicity by a learned lexicon, misspellings included, and the context of every hit.

A lexicon (seed terms, and words and word beginnings that toxic training texts use far more often) is a trie. For
each distinct word of a block the Levenshtein automaton runs over the trie: its states are bit masks over the
word's places, one for each number of edits, and a whole array of words takes a trie edge at once; words without a
live state leave the subtree. Every hit is weighed by its context window: a hit inside quotation marks or beside
words of report counts little, one that addresses the reader counts fully. A logistic regression over the weighed
hits gives the score.
"""
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import blocks as tb
from tidemark.llm.folds import remainder, thinned

# Terms known before training, and the words that mark report and address.
SEED_TERMS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting",
              "imbecile", "dumbass", "asshole", "bastard", "bitch", "retard", "vermin", "filth")
REPORT = frozenset("said says say saying called calls wrote writes quote quoted quotes word words term terms phrase cited cites reported reads".split())
ADDRESS = frozenset("you your you're youre u ur yourself".split())
# Training texts of each label at most (expected); further labelled texts are left out by a hash of their id.
TRAIN_TEXTS = 6_000
LEXICON_SIZE = 400
PREFIX = 3
MAX_WORD = 60                  # letters an automaton holds; longer pieces are walked in windows
OVERLAP = 32                   # letters that windows share: the longest term of the lexicon and its edits
EVIDENCE = 30.0                # least log-likelihood ratio of a term that enters the lexicon
CONTEXT = 8
FUZZY_WEIGHT, QUOTED_WEIGHT, REPORT_WEIGHT = 0.8, 0.1, 0.5
_STRIP = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
_PIECES = regex.compile(r"[\p{L}\p{N}]+")
_WORDS = tb.SpanHash(51)


def bare(word: str) -> str:
    """Lower case, without marks at its ends."""
    return _STRIP.sub("", word.lower())


def pieces(word: str) -> list[str]:
    """Runs of letters and digits inside a bare word, if it is not one itself: what marks glue together."""
    found = _PIECES.findall(word)
    return found if len(found) > 1 else []


def windows(piece: str) -> list[str]:
    """A piece longer than the automaton as overlapping stretches."""
    return [piece[a:a + MAX_WORD] for a in range(0, max(1, len(piece) - OVERLAP), MAX_WORD - OVERLAP)]


def allowed_edits(term: str) -> int:
    return 0 if term.endswith("*") or len(term) < 4 else 1 if len(term) < 8 else 2


class Trie:
    """Lexicon terms; a term with `*` at its end stands for all words that begin so."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for number, term in enumerate(terms):
            node = 0
            for c in term.rstrip("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                node = self.children[node][c]
            self.ends[node].append(number)
        self.edits = [0] * len(self.children)
        for node in reversed(range(len(self.children))):       # a child has a greater number than its parent
            self.edits[node] = max([*(allowed_edits(terms[t]) for t in self.ends[node]), *(self.edits[c] for c in self.children[node].values()), 0])

    def match(self, words: list[str], anywhere: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Term of each word (-1: none) and its edits: the nearest term, then the longest, then the first.

        anywhere: a term may begin and end anywhere in the word; it must then stand there without an edit.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        best = np.full(len(words), np.iinfo(np.int64).max)
        fits = np.flatnonzero((sizes > 0) & (sizes <= MAX_WORD))
        letters: dict[str, np.ndarray] = {}
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        place = (np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint64)
        owner = np.repeat(np.arange(len(words)), sizes)

        def masks(c: str) -> np.ndarray:
            if c not in letters:
                at = np.flatnonzero((points == ord(c)) & (place < 63))
                found = np.zeros(len(words), np.uint64)
                np.bitwise_or.at(found, owner[at], np.uint64(1) << place[at])
                letters[c] = found
            return letters[c]

        one = np.uint64(1)
        start = [np.full(len(fits), (1 << (MAX_WORD if anywhere else k + 1)) - 1, np.uint64) for k in range(1 if anywhere else self.edits[0] + 1)]
        stack = [(0, fits, start)]
        while stack:
            node, alive, rows = stack.pop()
            for number in self.ends[node]:
                term = self.terms[number]
                for k in range(1 if anywhere else allowed_edits(term) + 1):
                    if anywhere and len(term.rstrip("*")) < 4:
                        continue
                    if term.endswith("*") or anywhere:
                        hit = rows[0] > 0
                    else:
                        hit = (rows[k] >> sizes[alive].astype(np.uint64)) & one > 0
                    value = (k * 1000 + 999 - min(999, len(term))) * (len(self.terms) + 1) + number
                    best[alive[hit]] = np.minimum(best[alive[hit]], value)
            for c, child in self.children[node].items():
                here = masks(c)[alive]
                after = []
                for k in range(1 if anywhere else self.edits[child] + 1):
                    state = (rows[k] & here) << one
                    if k:
                        state = state | rows[k - 1] | (rows[k - 1] << one) | (after[k - 1] << one)
                    after.append(state)
                live = np.flatnonzero(np.logical_or.reduce([s > 0 for s in after]))
                # States past the word's end are no states.
                bound = (one << (sizes[alive[live]].astype(np.uint64) + one)) - one
                after = [s[live] & bound for s in after]
                inside = np.logical_or.reduce([s > 0 for s in after])
                if inside.any():
                    stack.append((child, alive[live][inside], [s[inside] for s in after]))
        found = best < np.iinfo(np.int64).max
        return np.where(found, best % (len(self.terms) + 1), -1), np.where(found, best // (len(self.terms) + 1) // 1000, 0)


@dataclass(frozen=True)
class Model:
    """Terms, which of them also count when misspelt, and the regression's weights (bias last)."""

    terms: tuple[str, ...]
    fuzzy: tuple[bool, ...]
    weights: tuple[float, ...] = field(default=())


@lru_cache(maxsize=8)
def _matcher(terms: tuple[str, ...]) -> "Matcher":
    return Matcher(terms)


class Matcher:
    """Hits of the lexicon in texts; distinct words that were matched once are kept up to a bound."""

    KEPT = 300_000

    def __init__(self, terms: tuple[str, ...]):
        self.trie = Trie(list(terms))
        self._forget()

    def _forget(self) -> None:
        self.known, self.first, self.counts, self.codes = (np.zeros(0, k) for k in (np.uint64, np.int64, np.int64, np.int64))

    def codes_of(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, term * 4 + edits) of every hit: one of the whole word, or those of the pieces that it glues together."""
        hashes = _WORDS.spans(_WORDS.prefixes(flat), starts, ends)
        unique, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > self.KEPT:
            self._forget()
        at = np.minimum(np.searchsorted(self.known, unique), max(0, len(self.known) - 1))
        new = np.flatnonzero(self.known[at] != unique) if len(self.known) else np.arange(len(unique))
        if len(new):
            data = flat.tobytes()
            found = self._matched([bare(data[a:b].decode(errors="replace")) for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist())])
            sizes = np.array([len(f) for f in found], np.int64)
            first = len(self.codes) + np.cumsum(sizes) - sizes
            self.codes = np.concatenate([self.codes, np.array([c for f in found for c in f], np.int64)])
            self.known, self.first, self.counts = (np.concatenate(x) for x in ((self.known, unique[new]), (self.first, first), (self.counts, sizes)))
            order = np.argsort(self.known)
            self.known, self.first, self.counts = self.known[order], self.first[order], self.counts[order]
            at = np.searchsorted(self.known, unique)
        sizes = self.counts[at][back]
        begin = np.repeat(self.first[at][back] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return np.repeat(np.arange(len(starts)), sizes), self.codes[begin]

    def _matched(self, words: list[str]) -> list[list[int]]:
        """Codes of the hits in every word; a whole word that is a hit counts once."""
        term, edits = self.trie.match(words)
        found = [[t * 4 + e] if t >= 0 else [] for t, e in zip(term.tolist(), edits.tolist())]
        parts = [(k, p) for k, w in enumerate(words) if not found[k] and w for p in (pieces(w) or ([w] if len(w) > MAX_WORD else []))]
        short = [(k, p) for k, p in parts if len(p) <= MAX_WORD]
        long = [(k, w) for k, p in parts if len(p) > MAX_WORD for w in windows(p)]
        for owners, inside in ((short, False), (long, True)):
            if owners:
                term, edits = self.trie.match([p for _, p in owners], inside)
                for (k, _), t, e in zip(owners, term.tolist(), edits.tolist()):
                    if t >= 0 and (not inside or t * 4 + e not in found[k]):
                        found[k].append(t * 4 + e)
        return found

    def hits(self, column: pa.Array) -> tuple[np.ndarray, ...]:
        """Row, term, edits and context weight of every hit, and the number of words of every row."""
        flat, offsets = tb.utf8(column)
        starts, ends, rows = tb.word_spans(flat, offsets)
        n_words = np.bincount(rows, minlength=len(column))
        at, codes = self.codes_of(flat, starts, ends) if len(starts) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        # A place is quoted if its line has an odd number of straight marks before it, or more opened than closed.
        straight = np.concatenate([[0], np.cumsum(flat == 0x22)])
        curly = flat == 0x9C
        curly[2:] &= (flat[1:-1] == 0x80) & (flat[:-2] == 0xE2)
        close = flat == 0x9D
        close[2:] &= (flat[1:-1] == 0x80) & (flat[:-2] == 0xE2)
        balance = np.concatenate([[0], np.cumsum(curly.astype(np.int64) - close)])
        feeds = np.flatnonzero(flat == 10)
        line = np.concatenate([[0], feeds + 1])[np.searchsorted(feeds, starts[at])] if len(at) else at
        line = np.maximum(line, offsets[rows[at]])
        inner = np.minimum(starts[at] + 3, ends[at])             # a mark that opens the word itself counts
        quoted = ((straight[inner] - straight[line]) % 2 == 1) | (balance[inner] > balance[line])
        weight = np.where(quoted, QUOTED_WEIGHT, 1.0)
        first = tb.counted(rows, len(column))[1]
        data = flat.tobytes()
        for k, i in enumerate(at.tolist()):
            if not quoted[k]:
                a, b = max(first[rows[i]], i - CONTEXT), min(first[rows[i] + 1], i + CONTEXT + 1)
                near = {bare(w.decode()) for w in data[starts[a]:ends[b - 1]].split()}
                if near & REPORT and not near & ADDRESS:
                    weight[k] = REPORT_WEIGHT
        return rows[at], codes // 4, codes % 4, weight, n_words


def features(model: Model, column: pa.Array) -> np.ndarray:
    """A line for each text: weighed hits of each term as log count and as log rate, their sums, and 1."""
    rows, term, edits, weight, n_words = _matcher(model.terms).hits(column)
    fuzzy = np.array(model.fuzzy, bool)
    weight = weight * np.where(edits == 0, 1.0, np.where(fuzzy[term] if len(term) else False, FUZZY_WEIGHT, 0.0))
    n, m = len(column), len(model.terms)
    hits = np.bincount(rows * m + term, weights=weight, minlength=n * m).reshape(n, m)
    size = np.maximum(n_words, 20)[:, None]
    total = hits.sum(1, keepdims=True)
    return np.hstack([np.log1p(hits), np.log1p(100 * hits / size), np.log1p(total), np.log1p(100 * total / size), np.ones((n, 1))])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> occurrences of words and word beginnings in toxic and other texts, summed for a batch."""
    for block in tb.blocks(batches, "text"):
        seen: dict[str, list[int]] = {}
        for text, toxic in zip(block.column("text").to_pylist(), block.column("toxic").to_pylist()):
            counts: Counter = Counter()
            for word, n in Counter(bare(w) for w in (text or "").split()).items():
                for part in [w for p in [word, *pieces(word)] for w in windows(p)] if word else ():
                    counts[part] += n
                    for k in range(PREFIX, min(len(part), OVERLAP)):
                        counts[part[:k] + "*"] += n
            for term, n in counts.items():
                line = seen.setdefault(term, [0, 0, 0, 0])
                line[toxic] += 1
                line[2 + toxic] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in range(4))],
            names=["term", "other_texts", "toxic_texts", "other_count", "toxic_count"])


def _regression(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method with a ridge; the last column (bias) is free."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from (doc_id, text) and (doc_id, toxic); rows with a null in them are left out.

    Of each label about TRAIN_TEXTS texts at most are read, chosen by a hash of doc_id. The sampled ids are few, so they
    are broadcast. Without examples of both labels the seed terms score alone.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(thinned(known, "toxic", TRAIN_TEXTS)), "doc_id").select("text", "toxic")
    stats = sample.mapInArrow(_term_counts, "term string, other_texts bigint, toxic_texts bigint, other_count bigint, toxic_count bigint") \
        .groupBy("term").agg(*(F.sum(c).alias(c) for c in ("other_texts", "toxic_texts", "other_count", "toxic_count")))
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_other = n.get(1, 0), n.get(0, 0)
    lift = ((F.col("toxic_count") + 0.5) / (n_toxic + 1)) / ((F.col("other_count") + 0.5) / (n_other + 1))
    # Few texts are enough where the words in them are many more than chance gives.
    ratio = 2 * F.col("toxic_count") * (F.log(lift) - 1 + 1 / lift)
    enough = (F.col("toxic_texts") >= max(2, n_toxic // 100)) & (ratio >= EVIDENCE)
    rows = stats.where(enough & (lift >= 8) & (F.length("term") <= OVERLAP - 2)).withColumn("lift", lift) \
        .orderBy(F.desc(F.col("toxic_texts") * F.log("lift")), "term").limit(20 * LEXICON_SIZE).collect() if n_toxic and n_other else []
    chosen: dict[str, float] = {t: 0.0 for t in SEED_TERMS}
    found = {r["term"]: r for r in rows}
    # Short beginnings first: a longer one or a word under a chosen beginning adds nothing, unless it is far stronger.
    for r in sorted(rows, key=lambda r: (len(r["term"].rstrip("*")), r["term"])):
        term = r["term"]
        stem = term.rstrip("*")
        whole = found.get(stem) if term.endswith("*") else None
        under = [chosen[stem[:k] + "*"] for k in range(PREFIX, len(stem) + (not term.endswith("*"))) if stem[:k] + "*" in chosen]
        if len(chosen) >= LEXICON_SIZE or stem in SEED_TERMS or any(s.startswith(stem) for s in SEED_TERMS if term.endswith("*")):
            continue
        if under and r["lift"] < 3 * max(under):
            continue
        if whole is not None and whole["toxic_count"] >= 0.9 * r["toxic_count"]:
            continue
        chosen[term] = r["lift"]
    terms = tuple(chosen)
    model = Model(terms, tuple(allowed_edits(t) > 0 for t in terms))
    if not rows:
        weights = np.zeros(2 * len(terms) + 3)
        weights[:len(SEED_TERMS)], weights[-1] = 3.0, -2.0
        return Model(model.terms, model.fuzzy, tuple(weights))

    def near_misses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, "text"):
            rows_, term, edits, _, _ = _matcher(terms).hits(block.column("text"))
            toxic = block.column("toxic").to_numpy(zero_copy_only=False)[rows_]
            keep = edits > 0
            yield pa.RecordBatch.from_arrays([pa.array(term[keep], pa.int64()), pa.array(toxic[keep], pa.int64())], names=["term", "toxic"])

    # A term whose misspellings stand in other texts as often is matched exactly only.
    plain = {r["term"] for r in sample.mapInArrow(near_misses, "term bigint, toxic bigint").groupBy("term").agg(
        F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o")).collect()
        if (r["t"] + 0.5) / (n_toxic + 1) < 4 * (r["o"] - 0.5) / (n_other + 1)}
    model = Model(terms, tuple(f and k not in plain for k, f in enumerate(model.fuzzy)))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, "text"):
            x = features(model, block.column("text"))
            r, c = np.nonzero(x)
            yield pa.RecordBatch.from_arrays([block.column("toxic").cast(pa.int32()), tb.lists(c, r, len(x), pa.int32()), tb.lists(x[r, c], r, len(x), pa.float64())],
                                             names=["toxic", "at", "value"])

    made = sample.mapInArrow(lines, "toxic int, at array<int>, value array<double>").toArrow()
    x = np.zeros((made.num_rows, 2 * len(terms) + 3))
    for k, (at, value) in enumerate(zip(made["at"].to_pylist(), made["value"].to_pylist())):
        x[k, at] = value
    order = np.lexsort(x.T)                                  # sums do not depend on the order of rows
    return Model(model.terms, model.fuzzy, tuple(_regression(x[order], made["toxic"].to_numpy()[order].astype(float))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> (doc_id, score, predicted); a null text counts as empty and gets the score of no hits."""
    weights = np.array(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, "text"):
            p = 1 / (1 + np.exp(-np.clip(features(model, block.column("text")) @ weights, -700, 700)))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def held_out(df: DataFrame) -> DataFrame:
    """Adds held_out: whether a row is of the fold that training does not see."""
    return df.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)))
