"""Ranked lexical search: the best documents of every item by integer impacts, pruned by vector lengths.

A document is the vector of its terms' impacts, an item the vector of its terms' weights; the score is their inner
product. Only coordinates that some item has are kept. Vectors are ordered by length and cut into buckets: a bucket whose
greatest length times the item's length stays below the item's tenth best score so far is left out (Cauchy-Schwarz).
Inside a bucket the item's heaviest coordinates decide: as few of them as make the rest too short to reach that score
alone. A vector without any of them can't reach it; the others are held to their exact part on these coordinates
plus the product of what is left of both lengths. Whatever passes is scored in 64-bit integers.

The longest vectors of all documents are searched first; the scores found there are the bounds for the rest.
"""
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm import blocks as tb
from tidemark.llm.scratch import Scratch

TOP = 10
BUCKET_ROWS = 2_048            # vectors in a bucket of a task's block
BLOCK_TERMS = 1 << 20          # coordinates a task holds at a time, about
HEAD = 32                      # one vector in so many, the longest, are searched first
ITEM_BYTES = 4 << 20           # items are searched in rounds of about this much text
STEP = np.log(1.02)            # lengths are counted in steps of 2 %
_TERMS = tb.SpanHash(21, tb.LOWER)
_NOT_A_TERM = np.ones(256, bool)
_NOT_A_TERM[0x80:] = False
for _low, _high in (("0", "9"), ("A", "Z"), ("a", "z")):
    _NOT_A_TERM[ord(_low):ord(_high) + 1] = False


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of every text, in order, and their rows."""
    flat, offsets = tb.utf8(column)
    starts, ends, rows = tb.runs(~_NOT_A_TERM[flat], offsets)
    return _TERMS.spans(_TERMS.prefixes(flat), starts, ends), rows


def _counted(vocabulary: np.ndarray, schema: pa.Schema):
    """doc_id, n, the numbers of its terms in the vocabulary and how often it holds each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, "text"):
            hashes, rows = terms(block.column("text"))
            n = np.bincount(rows, minlength=block.num_rows)
            at = np.minimum(np.searchsorted(vocabulary, hashes), max(0, len(vocabulary) - 1))
            hit = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
            keys, counts = np.unique(rows[hit] * np.int64(max(1, len(vocabulary))) + at[hit], return_counts=True)
            owner = keys // max(1, len(vocabulary))
            yield pa.RecordBatch.from_arrays([
                block.column("doc_id"), pa.array(n, pa.int64()),
                tb.lists((keys - owner * max(1, len(vocabulary))).astype(np.int32), owner, block.num_rows, pa.int32()),
                tb.lists(counts, owner, block.num_rows, pa.int64())], schema=schema)

    return run


def impacts(tf: np.ndarray, n: np.ndarray, total: int, length: int) -> np.ndarray:
    """Integer impact of a term that stands tf times in a document of n terms."""
    m = 100 - 90 + (90 * n * total) // max(1, length)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _measured(total: int, length: int, schema: pa.Schema):
    """doc_id, norm step, terms and impacts of every document that has a coordinate."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64)
            tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(batch.num_rows), sizes)
            p = impacts(tf, batch.column("n").to_numpy(zero_copy_only=False)[rows], total, length)
            norm = np.sqrt(np.bincount(rows, weights=p.astype(float) ** 2, minlength=batch.num_rows))
            step = np.floor(np.log(np.maximum(norm, 1.0)) / STEP).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(step), batch.column("terms"), tb.lists(p, rows, batch.num_rows, pa.int64())], schema=schema)

    return run


class Items:
    """Weight vectors of a round of items, with the bound each has to reach."""

    def __init__(self, names: list, coordinates: list[np.ndarray], weights: np.ndarray, bounds: dict | None = None):
        self.names = names
        self.terms, self.weights, self.left, self.norms = [], [], [], []
        for own in coordinates:
            own = own[np.argsort(-weights[own], kind="stable")]
            w = weights[own]
            squares = np.cumsum((w.astype(float) ** 2)[::-1])[::-1]
            self.terms.append(own)
            self.weights.append(w)
            self.left.append(np.sqrt(np.r_[squares, 0.0]))      # length of what is left after the first k coordinates
            self.norms.append(self.left[-1][0])
        self.bounds = [(bounds or {}).get(k, 1) for k in range(len(names))]

    def search(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
        """(item, doc ids, scores) of the TOP best vectors of every item; bounds rise as vectors are found."""
        bounds, best = list(self.bounds), {}
        for batch in _regrouped(batches):
            block = _Block(batch)
            for low in range(0, len(block.norm), BUCKET_ROWS):
                norm = block.norm[low:low + BUCKET_ROWS]
                for k in range(len(self.names)):
                    if norm[0] * self.norms[k] * (1 + 1e-9) + 1 < bounds[k]:
                        continue
                    rows = self._candidates(k, bounds[k], block, low, norm)
                    scores = block.scores(rows, np.sort(self.terms[k]), self.weights[k][np.argsort(self.terms[k])])
                    rows, scores = rows[scores >= bounds[k]], scores[scores >= bounds[k]]
                    if len(rows):
                        keep = np.lexsort((block.place[rows], -scores))[:TOP]
                        best[k] = _merged(best.get(k), block.ids.take(pa.array(block.longest[rows[keep]])), scores[keep])
                        if len(best[k][1]) == TOP:
                            bounds[k] = max(bounds[k], int(best[k][1][-1]))
        yield from ((k, *found) for k, found in best.items())

    def _candidates(self, k: int, bound: int, block: "_Block", low: int, norm: np.ndarray) -> np.ndarray:
        """Places of a bucket's vectors that may reach the bound, by the item's heaviest coordinates."""
        left = self.left[k]
        focus = int(np.argmax(left * norm[0] * (1 + 1e-9) + 1 < bound)) if bound > 1 else len(self.terms[k])
        at, value, sizes = block.postings(self.terms[k][:focus], low, low + len(norm))
        part = np.bincount(at, weights=np.repeat(self.weights[k][:focus], sizes) * value, minlength=len(norm))
        square = np.bincount(at, weights=value * value, minlength=len(norm))
        rest = np.sqrt(np.maximum(norm * norm * (1 + 1e-9) - square, 0)) * left[focus]
        return np.flatnonzero((square > 0) & ((part + rest) * (1 + 1e-9) + 1 >= bound)) + low


class _Block:
    """Vectors ordered by length: by rows, and as postings of every coordinate in which longer vectors come first."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids, n = batch.column("doc_id"), batch.num_rows
        sizes = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64)
        self.coordinate = batch.column("terms").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.p = batch.column("impacts").flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(n), sizes)
        norm = np.sqrt(np.bincount(owner, weights=self.p.astype(float) ** 2, minlength=n))
        self.longest = np.argsort(-norm, kind="stable")
        self.norm, self.sizes = norm[self.longest], sizes[self.longest]
        self.first = np.r_[0, np.cumsum(sizes)][:-1][self.longest]
        place = np.empty(n, np.int64)                           # order of the ids, for ties; a null id is last
        place[pc.sort_indices(self.ids, null_placement="at_end").to_numpy()] = np.arange(n)
        self.place = place[self.longest]
        rank = np.empty(n, np.int64)
        rank[self.longest] = np.arange(n)
        keys = self.coordinate * n + rank[owner]
        order = np.argsort(keys, kind="stable")
        self.keys, self.values, self.n = keys[order], self.p[order].astype(float), n

    def postings(self, own: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places (from `low` on) and impacts of the vectors low to high that have these coordinates, and how many have each."""
        starts, ends = np.searchsorted(self.keys, own * self.n + low), np.searchsorted(self.keys, own * self.n + high)
        at = _ranges(starts, ends - starts)
        return self.keys[at] - np.repeat(own * self.n + low, ends - starts), self.values[at], ends - starts

    def scores(self, rows: np.ndarray, own: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Integer scores of these vectors under an item; `own` is sorted."""
        at = _ranges(self.first[rows], self.sizes[rows])
        found = np.minimum(np.searchsorted(own, self.coordinate[at]), max(0, len(own) - 1))
        hit = own[found] == self.coordinate[at] if len(own) else np.zeros(len(at), bool)
        return np.add.reduceat(np.where(hit, weights[found] * self.p[at], 0), np.r_[0, np.cumsum(self.sizes[rows])[:-1]]) if len(rows) else np.zeros(0, np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of all stretches, one after another."""
    return np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else starts, sizes) + np.arange(int(sizes.sum()))


def _merged(held: tuple | None, ids: pa.Array, scores: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The TOP best of both, best first, ties by id."""
    if held:
        ids, scores = pa.concat_arrays([held[0], ids]), np.r_[held[1], scores]
    place = np.empty(len(ids), np.int64)
    place[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
    keep = np.lexsort((place, -scores))[:TOP]
    return ids.take(pa.array(keep)), scores[keep]


def _regrouped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about BLOCK_TERMS coordinates; rows without coordinates are not there."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column("terms").flatten())
        if size >= BLOCK_TERMS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _searched(items: Items, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, ids, scores in items.search(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), k), pa.int32()), ids, pa.array(scores, pa.int64())], schema=schema)

    return run


def _best(found: DataFrame) -> DataFrame:
    ranked = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= TOP)


def _round(scratch: Scratch, docs: DataFrame, names: list, texts: list[list[str]], mark: str) -> DataFrame:
    """Best documents of some items, by their numbers."""
    id_type, arrow = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)
    hashes, rows = terms(pa.array([t for own in texts for t in own], pa.string()))
    owner = np.repeat(np.arange(len(texts)), [len(own) for own in texts])[rows]
    vocabulary = np.unique(hashes)
    coordinates = [np.unique(np.searchsorted(vocabulary, hashes[owner == k])) for k in range(len(texts))]
    counted = scratch.keep(f"counted-{mark}", docs.mapInArrow(
        _counted(vocabulary, pa.schema([("doc_id", arrow), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])),
        f"doc_id {id_type}, n bigint, terms array<int>, tfs array<bigint>"))
    stats = counted.agg(F.count(F.when(F.col("n") > 0, 1)).alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for row in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toLocalIterator():
        weights[row["term"]] = int(np.floor(1000 * np.log((2 * stats["total"] + 2) / (2 * row["df"] + 1))))
    measured = scratch.keep(f"measured-{mark}", counted.where(F.size("terms") > 0).mapInArrow(
        _measured(stats["total"], stats["length"], pa.schema([("doc_id", arrow), ("step", pa.int32()), ("terms", pa.list_(pa.int32())), ("impacts", pa.list_(pa.int64()))])),
        f"doc_id {id_type}, step int, terms array<int>, impacts array<bigint>"))
    scratch.drop(f"counted-{mark}")
    steps = sorted((tuple(r) for r in measured.groupBy("step").count().collect()), reverse=True)
    wanted, edge = sum(n for _, n in steps) // HEAD, 0
    for edge, n in steps:
        wanted -= n
        if wanted <= 0:
            break
    schema = pa.schema([("item", pa.int32()), ("doc_id", arrow), ("score", pa.int64())])

    def search(part: DataFrame, bounds: dict | None = None) -> DataFrame:
        items = Items(names, coordinates, weights, bounds)
        return part.mapInArrow(_searched(items, schema), f"item int, doc_id {id_type}, score bigint")

    head = scratch.keep(f"head-{mark}", _best(search(measured.where(F.col("step") >= edge))).drop("rank"))
    bounds = {r["item"]: r["bound"] for r in head.groupBy("item").agg(F.min("score").alias("bound"), F.count("*").alias("n")).where(F.col("n") == TOP).collect()}
    # No vector shorter than this can reach any item's bound.
    shortest = min((bounds.get(k, 1) / norm for k, norm in enumerate(Items(names, coordinates, weights).norms) if norm), default=np.inf)
    lowest = int(np.floor(np.log(max(shortest, 1.0)) / STEP)) - 1 if np.isfinite(shortest) else edge
    rest = search(measured.where((F.col("step") < edge) & (F.col("step") >= lowest)), bounds)
    found = scratch.keep(f"found-{mark}", _best(head.union(rest)))
    scratch.drop(f"measured-{mark}", f"head-{mark}")
    return found


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text) and (item_id, text) -> item_id, rank, doc_id, score: the TOP best documents of every item.

    Terms are the runs of ASCII letters, digits and other than ASCII characters, lower-cased in A-Z. N documents have a
    term, L terms in all; a term weighs floor(1000 ln((2 N + 2) / (2 df + 1))), and a document of n terms that holds
    it tf times adds the weight times 10^9 tf div (1000 tf + 8 m), m = 10 + 90 n N div L. Scores of 0 do not count;
    equal ones go by doc_id, null ids last. Every row of `docs` is a document, also rows with equal ids; rows of `items` with the
    same item_id are one item. Null and blank texts have no terms. Empty tables give no rows; other columns are ignored.

    Items are searched in rounds of about ITEM_BYTES, each over all documents; a round's terms and weights are what
    tasks get, and all that the driver holds.
    """
    docs, items = docs.select("doc_id", "text"), items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    scratch, spark = Scratch(docs.sparkSession), docs.sparkSession
    size = items.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    n_rounds, out = -(-size // ITEM_BYTES), []
    item_type = items.schema["item_id"].dataType
    for k in range(n_rounds):
        texts: dict = {}
        for row in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_rounds)) == k).toLocalIterator():
            texts.setdefault(row["item_id"], []).append(row["text"])
        if texts:
            found = _round(scratch, docs, list(texts), list(texts.values()), str(k))
            names = spark.createDataFrame(list(enumerate(texts)), f"item int, item_id {item_type.simpleString()}")
            out.append(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], f"item_id {item_type.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score bigint")
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result
