"""Log-likelihood of whole documents under a gated recurrent language model.

Counts of all training tokens give the base score, the classes of the model's class-factored softmax and the word
probabilities inside its large classes. A word's class says in which kind of document it occurs most (documents fall
into CLUSTERS kinds by their byte pairs) and how frequent it is; the most frequent words form small head classes whose
words the network tells apart. The network reads class or head word and predicts the next class.

Counts of frequent words (TABLE at most) go to every task. Words beyond the table are one class, so their class needs
no count; their counts are joined by shuffle and enter the document's sum afterwards, exactly.

The network learns from every training document once, whatever their number: in each of ROUNDS rounds every shard of
that round's documents learns by itself from the same weights and Spark averages the results.
"""
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import blocks as tb, gru
from tidemark.llm.folds import remainder
from tidemark.llm.scratch import Scratch

TABLE = 1 << 18                 # words whose counts every task holds (16 bytes each)
HEAD_SIZE = 32                  # words of a head class; there are more such classes the more words there are
CLUSTERS, BANDS = 6, 12
NEAR = 16                       # centres by which a task, or a group of tasks, reports its documents
SHARD_TEXTS = 2_400             # documents that learn one after another (expected)
ROUNDS = 2                      # parts of the training documents between which the shards' weights are averaged
BATCH_BYTES = 16 << 20          # texts that the network scores side by side
BLOCK_BYTES = tb.BLOCK_BYTES
_WORDS = tb.SpanHash(81, tb.LOWER)
END = np.uint64(0x656E64)       # the end mark; a word's 64-bit hash equals it with a chance of 5e-20
RARE, STOP = 0, gru.OPENING     # classes and input symbols: words beyond the table, the end mark


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of every text, each text closed by END, and their rows."""
    flat, offsets = tb.utf8(column)
    starts, ends, rows = tb.word_spans(flat, offsets)
    hashes = _WORDS.spans(_WORDS.prefixes(flat), starts, ends)
    at = np.searchsorted(rows, np.arange(len(column)), "right")
    return np.insert(hashes, at, END), np.insert(rows, at, np.arange(len(column)))


def pair_shares(column: pa.Array) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs of every text; zero for an empty one."""
    flat, offsets = tb.utf8(column)
    low = tb.LOWER[flat].astype(np.int64)
    rows = np.repeat(np.arange(len(column)), np.diff(offsets))
    key = (low[:-1] * 31 + low[1:] * 7) & 255 if len(low) > 1 else low[:0]
    found = np.bincount(rows[:-1] * 256 + key, minlength=256 * len(column)).reshape(-1, 256) if len(low) > 1 else np.zeros((len(column), 256))
    return np.sqrt(found / np.maximum(found.sum(1, keepdims=True), 1))


def centres(lines: np.ndarray, mass: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k centres of weighted lines (fewer for fewer lines) and their masses: k-means from farthest-first starts."""
    if len(lines) <= k:
        return lines, mass
    found = [np.average(lines, axis=0, weights=mass)]
    away = np.full(len(lines), np.inf)
    for _ in range(k):
        away = np.minimum(away, ((lines - found[-1]) ** 2).sum(1))
        found.append(lines[np.argmax(away)])
    found = np.array(found[1:])
    for _ in range(6):
        share = (nearest(lines, found)[:, None] == np.arange(k)) * mass[:, None]
        sums, weight = share.T @ lines, share.sum(0)
        found = np.where(weight[:, None] > 0, sums / np.maximum(weight, 1e-300)[:, None], found)
    return found[weight > 0], weight[weight > 0]


def nearest(lines: np.ndarray, found: np.ndarray) -> np.ndarray:
    return np.argmin((found * found).sum(1) - 2 * lines @ found.T, 1)


def kinds_of(docs: DataFrame) -> np.ndarray:
    """Centres of CLUSTERS kinds of documents, from every document.

    A task folds its documents, block by block, into NEAR weighted centres; groups of tasks fold theirs again, and what
    is left, NEAR lines for each of at most NEAR groups, makes the kinds.
    """
    schema = "line array<float>, mass double"

    def folded(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        lines, mass = np.zeros((0, 256)), np.zeros(0)
        for more, weight in blocks:
            lines, mass = centres(np.vstack([lines, more]), np.r_[mass, weight], NEAR)
        if len(lines):
            yield pa.RecordBatch.from_arrays([pa.array(list(lines.astype(np.float32)), pa.list_(pa.float32())), pa.array(mass)], names=["line", "mass"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return folded((pair_shares(b.column("text")), np.ones(b.num_rows)) for b in tb.blocks(batches, "text", BLOCK_BYTES))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return folded((b.column("line").flatten().to_numpy().reshape(-1, 256).astype(float), b.column("mass").to_numpy()) for b in batches if b.num_rows)

    first = docs.select("text").mapInArrow(own, schema)
    last = first.repartition(NEAR).mapInArrow(again, schema).toArrow()
    lines = np.array(last["line"].to_pylist(), float).reshape(-1, 256)
    order = np.lexsort(lines.T)
    found = centres(lines[order], last["mass"].to_numpy()[order], CLUSTERS)[0]
    return found if len(found) else np.zeros((1, 256))


@dataclass(frozen=True)
class Vocabulary:
    """Counts of table words (sorted by hash), their class, input symbol and place in a head class, and class sums."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    inputs: np.ndarray
    inside: np.ndarray
    masses: np.ndarray          # sum of (count + 0.5) by class
    head_masses: np.ndarray
    total: int                  # N
    distinct: int               # V

    @property
    def layout(self) -> gru.Layout:
        heads = len(self.head_masses) - 2
        return gru.Layout(len(self.masses) + heads * HEAD_SIZE, len(self.masses), heads + 2, HEAD_SIZE)

    @property
    def denominator(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash in the table, -1 for words beyond it."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def symbols(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place, input symbol, class and place in a head class of each token."""
        at = self.places(hashes)
        end = hashes == END
        classes = np.where(at >= 0, self.classes[at] if len(self.hashes) else RARE, RARE)
        inputs = np.where(at >= 0, self.inputs[at] if len(self.hashes) else RARE, RARE)
        inside = np.where(at >= 0, self.inside[at] if len(self.hashes) else -1, -1)
        return tuple(x.astype(np.int32) for x in (at, np.where(end, STOP, inputs), np.where(end, STOP, classes), np.where(end, -1, inside)))


def vocabulary(counted: DataFrame) -> Vocabulary:
    """From (h, c, kind): the most frequent words by a count threshold that leaves TABLE words at most."""
    level = F.floor(F.log2("c") * 16).cast("int")
    levels = counted.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).orderBy(F.desc("level")).collect()
    total, distinct = sum(r["c"] for r in levels), sum(r["n"] for r in levels)
    held, least = 0, 1 << 30
    for r in levels:                                   # some hundred levels, whatever the corpus
        if held + r["n"] > TABLE:
            break
        held, least = held + r["n"], r["level"]
    rows = counted.where(level >= least).toArrow().sort_by([("c", "descending"), ("h", "ascending")])
    h, c, kind = (rows[k].to_numpy() for k in ("h", "c", "kind"))
    h = h.astype(np.int64).view(np.uint64)
    words = h != END
    h, c, kind = h[words], c[words], kind[words]
    heads = max(4, round(distinct ** 0.25 / 2))
    n_heads = heads * HEAD_SIZE
    band = np.minimum(np.log2(np.maximum(c, 1)).astype(int), BANDS - 1)
    classes = 2 + heads + kind * BANDS + band
    inputs, inside = n_heads + classes, np.full(len(h), -1)
    # Head words of one kind share classes as far as they fill them.
    head = np.arange(min(len(h), n_heads))
    head = head[np.argsort(kind[head], kind="stable")]
    classes[head], inside[head], inputs[head] = 2 + np.arange(len(head)) // HEAD_SIZE, np.arange(len(head)) % HEAD_SIZE, 2 + np.arange(len(head))
    n_classes = 2 + heads + CLUSTERS * BANDS
    masses = np.bincount(classes, weights=c + 0.5, minlength=n_classes).astype(float)
    ends = total - int(c.sum()) - sum(int(r["c"]) for r in levels if r["level"] < least)
    rare = [r for r in levels if r["level"] < least]
    masses[RARE] = sum(r["c"] + 0.5 * r["n"] for r in rare) + 0.5
    masses[STOP] = max(0, ends) + 0.5
    head_masses = np.zeros((heads + 2, HEAD_SIZE))
    head_masses[classes[head], inside[head]] = c[head] + 0.5
    order = np.argsort(h)
    return Vocabulary(h[order], c[order], classes[order], inputs[order], inside[order], masses, head_masses, int(total), int(distinct))


def _learn(words: Vocabulary, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = []

        def learned():
            flat = gru.learn(words.layout, weights, documents)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat.astype(float))], names=["at", "value"])

        for block in tb.blocks(batches, "text", BLOCK_BYTES):
            hashes, rows = tokens(block.column("text"))
            at, inputs, classes, inside = words.symbols(hashes)
            # Half of the words that occur once stand for the words that do not: so the network learns when those come.
            once = (at >= 0) & (hashes & np.uint64(1) == 0) & (words.counts[at] == 1) if len(words.counts) else np.zeros(len(at), bool)
            inputs[once], classes[once], inside[once] = RARE, RARE, -1
            cuts = tb.counted(rows, block.num_rows)[1]
            for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                documents.append((inputs[a:b], classes[a:b], inside[a:b]))
        if documents:
            yield learned()

    return run


@dataclass(frozen=True)
class Model:
    words: Vocabulary
    weights: np.ndarray


def fit(docs: DataFrame, scratch: Scratch) -> tuple[Model, DataFrame]:
    """The model of (doc_id, text) and the counts (h, c) of all its tokens. A null text is a document with an end only."""
    docs = docs.select("doc_id", "text")
    n_docs = docs.count()
    kinds = kinds_of(docs)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, "text", BLOCK_BYTES):
            hashes, rows = tokens(block.column("text"))
            shares_ = pair_shares(block.column("text"))
            near = nearest(shares_, kinds)[rows]
            order = np.lexsort((near, hashes))
            hashes, near = hashes[order], near[order]
            first = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (near[1:] != near[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64)), pa.array(near[first], pa.int64()),
                                              pa.array(np.diff(np.r_[first, len(hashes)]), pa.int64())], names=["h", "kind", "c"])

    by_kind = docs.select("text").mapInArrow(counts, "h bigint, kind bigint, c bigint").groupBy("h", "kind").agg(F.sum("c").alias("c"))
    counted = scratch.keep("counts", by_kind.groupBy("h").agg(F.sum("c").alias("c"), F.max(F.struct("c", "kind")).alias("m")).select("h", "c", F.col("m.kind").alias("kind")))
    words = vocabulary(counted)
    weights = words.layout.initial(words.masses, words.head_masses)
    # A shard is a fixed number of documents, so a larger corpus has more shards of the same work.
    shards = max(1, round(n_docs / ROUNDS / SHARD_TEXTS))
    turn = F.pmod(F.xxhash64("doc_id", "text", F.lit(4)), F.lit(ROUNDS))
    for k in range(ROUNDS if n_docs else 0):
        shard = docs.where(turn == k).repartition(shards, F.xxhash64("doc_id", "text")).sortWithinPartitions("doc_id", "text").select("text")
        learned = shard.mapInArrow(_learn(words, weights), "at int, value double").groupBy("at").agg(F.avg("value").alias("value")).toArrow()
        if not learned.num_rows:
            continue
        weights = weights.copy()
        weights[learned["at"].to_numpy()] = learned["value"].to_numpy()
    return Model(words, weights), counted.select("h", "c")


def _score(model: Model):
    words = model.words
    log_masses = np.log10(np.maximum(words.masses, 0.5))

    def scored(texts: list[pa.Array]):
        found = [tokens(t) for t in texts]
        n = [len(t) for t in texts]
        hashes = np.concatenate([h for h, _ in found])
        rows = np.concatenate([(r + sum(n[:k])).astype(np.int32) for k, (_, r) in enumerate(found)])
        at, inputs, classes, inside = (np.concatenate(x) for x in zip(*(words.symbols(h) for h, _ in found)))
        sizes = np.bincount(rows, minlength=sum(n))
        score = gru.log_likelihood(words.layout, model.weights, inputs, classes, inside, sizes) / np.log(10)
        end = hashes == END
        table = at >= 0
        count = np.where(table, words.counts[at] if len(words.counts) else 0, 0)
        count = np.where(end, round(float(words.masses[STOP] - 0.5)), count)
        own = np.log10(count + 0.5)
        plain = table & (inside < 0)
        score += np.bincount(rows, weights=np.where(plain, own - log_masses[classes], 0), minlength=len(sizes))
        rare = ~table & ~end
        score -= np.bincount(rows, weights=rare * log_masses[RARE], minlength=len(sizes))
        base = np.bincount(rows, weights=np.where(rare, 0, own), minlength=len(sizes)) - sizes * np.log10(words.denominator)
        known = np.bincount(rows, weights=(table | end) & (count > 0), minlength=len(sizes)).astype(np.int64)
        h, r = hashes[rare], rows[rare]
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]) if len(h) else np.zeros(0, int)
        times = np.diff(np.r_[first, len(h)])
        return sizes, known, base, score, tb.lists(h[first].view(np.int64), r[first], len(sizes), pa.int64()), tb.lists(times, r[first], len(sizes), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 40
        for batch in tb.blocks(batches, "text", BATCH_BYTES):
            small = list(tb.blocks([batch], "text", BLOCK_BYTES))
            sizes, known, base, score, rare, times = scored([b.column("text") for b in small])
            yield pa.RecordBatch.from_arrays([
                pa.array(serial + np.arange(len(sizes)), pa.int64()), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()),
                pa.array(base), pa.array(score), rare, times], names=["row", "doc_id", "n_tokens", "n_known", "base", "score", "rare", "times"])
            serial += len(sizes)

    return run


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_tokens, n_known, train_tokens, base_score, score), base-10 logarithms.

    Tokens are words (runs of characters other than ASCII white space, A-Z lower-cased) and one end for each document;
    a null text has the end only. base_score is the smoothed unigram score of the training counts, score the model's.
    All words never seen in training are one unknown word. Rows that repeat are scored each.
    """
    scratch = Scratch(docs.sparkSession)
    model, counts = fit(training, scratch)
    kind = docs.schema["doc_id"].dataType.simpleString()
    done = scratch.keep("scored", docs.select("doc_id", "text").mapInArrow(
        _score(model), f"row bigint, doc_id {kind}, n_tokens bigint, n_known bigint, base double, score double, rare array<bigint>, times array<int>"))
    rare = done.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("h"), F.col("w.times").alias("times"))
    log = F.log10(F.coalesce("c", F.lit(0)) + 0.5) * F.col("times")
    late = rare.join(counts, "h", "left").groupBy("row").agg(
        F.sum(log).alias("log"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).cast("bigint").alias("seen"))
    zero = F.lit(0.0)
    return done.drop("rare", "times").join(late, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(model.words.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("log", zero)).alias("base_score"), (F.col("score") + F.coalesce("log", zero)).alias("score"))


def held_out(df: DataFrame) -> DataFrame:
    """Adds held_out: whether a row is of the fold that training does not see."""
    return df.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 5) == 1, F.lit(False)))
