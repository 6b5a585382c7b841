"""Approximate nearest neighbours by largest inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted by k-means of k-means on a sample of at most SAMPLE vectors; every vector is then put into a leaf.
A query walks the tree with a priority queue: the node whose centre has the largest inner product with it is opened
next, and leaves come out in the order of visit. How many leaves a query visits is widened until the exact nearest
vectors of CALIBRATION queries, found by brute force over all vectors, lie in the visited leaves with a share of RECALL.

Equal vectors are one entry with their smallest ids, as many as a result can show; equal queries are searched once.
A leaf is searched in chunks, of its vectors and of the queries that visit it, so no leaf has to fit a task.
"""
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm import blocks as tb
from tidemark.llm.scratch import Scratch

SAMPLE = 1 << 16         # vectors that the tree is fitted on, at most
LEAF = 512               # entries of a leaf, about, up to MOST_LEAVES leaves
MOST_LEAVES = 1 << 13
BRANCHES = 16
ROUNDS = 8               # of Lloyd's algorithm at each node
CALIBRATION = 128        # queries that set the number of leaves to visit
RECALL = 0.95            # their share of exact neighbours in visited leaves
LEAST_CHUNK, MOST_CHUNK = 512, 8_192     # a chunk is twice the mean leaf, within these
FIRST = 8                # one visit in so many comes first and bounds the others' results
AT_ONCE = 256            # queries compared with a chunk at a time


def usable(embedding: Column) -> Column:
    """Whether a vector takes part: not null, not zero, all components finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & finite & F.exists(embedding, lambda x: x != 0)


def inner(matrix: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed from the first component to the last, so equal vectors have equal scores everywhere."""
    return np.add.accumulate(matrix * query, axis=-1)[..., -1]


class Tree:
    """Centres of all nodes; node k has children first[k] to first[k] + count[k] - 1 and is leaf leaf[k] without any."""

    def __init__(self, sample: np.ndarray, n_leaves: int):
        self.centres, self.first, self.count, self.leaf = [sample.mean(0)], [0], [0], [0]
        rng = np.random.default_rng(13)
        size, waiting, leaves = len(sample), [(-len(sample), 0, np.arange(len(sample)))], 1
        # The largest node is split next, so leaves end with similar shares of the sample.
        while waiting and leaves < n_leaves:
            _, node, rows = heapq.heappop(waiting)
            k = min(BRANCHES, n_leaves - leaves + 1, len(rows))
            centres, owner = _k_means(sample[rows], k, rng)
            if len(centres) < 2:
                continue
            self.first[node], self.count[node] = len(self.centres), len(centres)
            for c in range(len(centres)):
                heapq.heappush(waiting, (-int((owner == c).sum()), len(self.centres), rows[owner == c]))
                self.centres.append(centres[c])
                self.first.append(0)
                self.count.append(0)
            leaves += len(centres) - 1
        self.centres = np.array(self.centres)
        self.first, self.count = np.array(self.first), np.array(self.count)
        self.leaf = np.where(self.count == 0, np.cumsum(self.count == 0) - 1, -1)
        self.n_leaves, self.size = int((self.count == 0).sum()), size

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of every vector: the nearest child at every node."""
        node = np.zeros(len(vectors), np.int64)
        while True:
            inside = self.count[node] > 0
            if not inside.any():
                return self.leaf[node]
            for k in np.unique(node[inside]):
                rows, own = np.flatnonzero(node == k), slice(self.first[k], self.first[k] + self.count[k])
                node[rows] = self.first[k] + _nearest(vectors[rows], self.centres[own])

    def visits(self, queries: np.ndarray, n: int) -> list[list[int]]:
        """First n leaves of every query, best bin first."""
        out = []
        for near in queries @ self.centres.T:
            queue, found = [(-near[0], 0)], []
            while queue and len(found) < n:
                _, node = heapq.heappop(queue)
                if self.count[node] == 0:
                    found.append(int(self.leaf[node]))
                for child in range(self.first[node], self.first[node] + self.count[node]):
                    heapq.heappush(queue, (-near[child], child))
            out.append(found)
        return out


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres ** 2).sum(1) - 2 * vectors @ centres.T, axis=1)


def _k_means(vectors: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Centres without empty ones, and the owner of every vector."""
    centres = np.unique(vectors[rng.choice(len(vectors), k, replace=False)], axis=0)
    for _ in range(ROUNDS):
        owner = _nearest(vectors, centres)
        used, owner = np.unique(owner, return_inverse=True)
        centres = np.stack([np.bincount(owner, weights=vectors[:, j], minlength=len(used)) for j in range(vectors.shape[1])], 1) / np.bincount(owner)[:, None]
    owner = _nearest(vectors, centres)
    used, owner = np.unique(owner, return_inverse=True)
    return centres[used], owner


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def compared(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, place, score) of the k best vectors of each query, best first, equal scores by id; AT_ONCE queries at a time.

    A matrix product finds what may be among them, to within its rounding; the summed score decides.
    """
    slack = 1e-12 * np.sqrt((queries ** 2).sum(1)) * np.sqrt((vectors ** 2).sum(1).max()) * queries.shape[1]
    for low in range(0, len(queries), AT_ONCE):
        rough = queries[low:low + AT_ONCE] @ vectors.T
        cut = max(0, rough.shape[1] - k)
        least = np.partition(rough, cut, axis=1)[:, cut] - slack[low:low + AT_ONCE]
        query, near = np.nonzero(rough >= least[:, None])
        scores = inner(vectors[near], queries[low + query])
        order = np.lexsort((ids[near], -scores, query))
        counts, first = tb.counted(query, len(rough))
        order = order[np.arange(len(order)) - first[query] < k]
        yield low + query[order], near[order], scores[order]


def _assigned(tree: Tree, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.assign(_matrix(batch.column("embedding")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], schema=schema)

    return run


def _exact(queries: np.ndarray, keys: list[tuple[int, int]], k: int):
    """Leaves of the exact best vectors of some queries: (query, score, id, leaf), k for each query and task."""
    schema = pa.schema([("query", pa.int32()), ("score", pa.float64()), ("id", pa.int64()), ("leaf", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in keys]
        for batch in batches:
            vectors = _matrix(batch.column("embedding"))
            ids, leaf = batch.column("ids").flatten().to_numpy()[batch.column("ids").offsets.to_numpy()[:-1]], batch.column("leaf").to_numpy()
            own = np.stack([batch.column("h1").to_numpy(), batch.column("h2").to_numpy()], 1)
            for query, near, scores in compared(queries, vectors, ids, k + 1) if len(vectors) else ():
                other = (own[near] != np.array(keys)[query]).any(1)
                query, near, scores = query[other], near[other], scores[other]
                for q in np.unique(query):
                    mine = query == q
                    found = [np.r_[a, b] for a, b in zip(held[q], (scores[mine], ids[near[mine]], leaf[near[mine]]))]
                    keep = np.lexsort((found[1], -found[0]))[:k]
                    held[q] = tuple(x[keep] for x in found)
        sizes = [len(h[0]) for h in held]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(keys)), sizes), pa.int32()), *(
            pa.array(np.concatenate([h[c] for h in held]), schema.field(c + 1).type) for c in range(3))], schema=schema)

    return run


def _visited(tree: Tree, n: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, AT_ONCE) for k in range(0, batch.num_rows, AT_ONCE)):
                leaves = tree.visits(_matrix(part.column("embedding")), n)
                rows = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in leaves]))
                nth = np.concatenate([np.arange(len(x)) for x in leaves])
                yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in part.columns), pa.array(np.concatenate(leaves), pa.int32()), pa.array(nth, pa.int32())], schema=schema)

    return run


def _met(k: int):
    """Best entries of a chunk for each query that visits it, as far as they reach the query's bound."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("scores", pa.list_(pa.float64())), ("ids", pa.list_(pa.list_(pa.int64())))])

    def run(_, entries: pa.Table, queries: pa.Table) -> pa.Table:
        if not entries.num_rows or not queries.num_rows:
            return schema.empty_table()
        ids = entries.column("ids").combine_chunks()
        least = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
        found = list(compared(_matrix(queries.column("embedding").combine_chunks()), _matrix(entries.column("embedding").combine_chunks()), least, k))
        query, near, scores = (np.concatenate(x) for x in zip(*found))
        good = scores >= queries.column("bound").to_numpy()[query]
        query, near, scores = query[good], near[good], scores[good]
        cuts = pa.array(tb.counted(query, queries.num_rows)[1], pa.int32())
        return pa.table([queries.column("h1"), queries.column("h2"), pa.ListArray.from_arrays(cuts, pa.array(scores)),
                         pa.ListArray.from_arrays(cuts, ids.take(pa.array(near)))], schema=schema)

    return run


def calibrated(tree: Tree, queries: np.ndarray, leaves: list[list[int]], recall: float = RECALL) -> int:
    """Least number of visits after which that share of the leaves' entries, counted over all queries, is reached."""
    if not any(leaves):
        return tree.n_leaves
    place = [{leaf: k for k, leaf in enumerate(order)} for order in tree.visits(queries, tree.n_leaves)]
    needed = np.sort([place[q][leaf] + 1 for q, own in enumerate(leaves) for leaf in own])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score: the k vectors found nearest to every row of `is_query`.

    Nearness is the inner product in double precision; equal scores go by vec_id. Candidates are all rows but those of the
    query's own vec_id. Rows without vec_id, with a null, empty or zero vector, a null or non-finite component, or another
    length than most vectors (of equally many: the greater) take no part, as query or candidate. A row that repeats another counts once; a
    vec_id with two vectors is two queries. An empty table gives no rows; other columns are ignored.

    Every row is indexed; the tree is fitted on at most about SAMPLE vectors chosen by a hash. With at most LEAF
    different vectors the result is exact.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    kind, arrow = vectors.schema["embedding"].dataType.simpleString(), to_arrow_type(vectors.schema["embedding"].dataType)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("asked")).where(
        F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    width = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.col("count").desc(), F.col("width").desc()).first()
    if width is None:
        return empty
    rows = rows.where(F.size("embedding") == width["width"]).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(7), "embedding")})
    # Of equal vectors only the k + 1 smallest ids can be in a result; Spark limits them before the shuffle.
    order = Window.partitionBy("h1", "h2").orderBy("vec_id")
    entries = rows.withColumn("nth", F.dense_rank().over(order)).where(F.col("nth") <= k + 1).groupBy("h1", "h2").agg(
        F.first("embedding").alias("embedding"), F.sort_array(F.collect_set("vec_id")).alias("ids"))
    entries = scratch.keep("entries", entries)
    asked = rows.where("asked").select("h1", "h2", F.col("vec_id").alias("query_id")).distinct()
    queries = scratch.keep("queries", entries.join(asked.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("h1", "h2", "embedding"))
    n, n_queries = entries.count(), queries.count()
    if not n_queries:
        return empty

    def chosen(df: DataFrame, limit: int, total: int) -> DataFrame:
        return df.where(F.pmod(F.xxhash64("h1", F.lit(3)), F.lit(1 << 30)) < int(min(1.0, limit / total) * (1 << 30)))

    tree = Tree(_matrix(chosen(entries, SAMPLE, n).select("embedding").toArrow().column(0).combine_chunks()), min(MOST_LEAVES, -(-n // LEAF)))
    base = [("h1", pa.int64()), ("h2", pa.int64()), ("embedding", arrow)]
    placed = scratch.keep("placed", entries.mapInArrow(
        _assigned(tree, pa.schema([*base, ("ids", pa.list_(pa.int64())), ("leaf", pa.int32())])),
        f"h1 bigint, h2 bigint, embedding {kind}, ids array<bigint>, leaf int"))
    scratch.drop("entries")
    trial = chosen(queries, CALIBRATION, n_queries).toArrow()
    trial_vectors = _matrix(trial.column("embedding").combine_chunks()) if trial.num_rows else np.zeros((0, width["width"]))
    trial_keys = list(zip(trial.column("h1").to_pylist(), trial.column("h2").to_pylist()))
    nearest = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    leaves: list[list[int]] = [[] for _ in trial_keys]
    for row in placed.mapInArrow(_exact(trial_vectors, trial_keys, k), "query int, score double, id bigint, leaf int").withColumn(
            "nth", F.row_number().over(nearest)).where(F.col("nth") <= k).select("query", "leaf").collect() if trial_keys else ():
        leaves[row["query"]].append(row["leaf"])
    n_visits = calibrated(tree, trial_vectors, leaves)
    visits = scratch.keep("visits", queries.mapInArrow(
        _visited(tree, n_visits, pa.schema([*base, ("leaf", pa.int32()), ("nth", pa.int32())])), f"h1 bigint, h2 bigint, embedding {kind}, leaf int, nth int"))
    chunk = min(MOST_CHUNK, max(LEAST_CHUNK, 2 * n // tree.n_leaves))
    ranked = Window.partitionBy("h1", "h2").orderBy(F.col("score").desc(), "vec_id")

    def met(calls: DataFrame) -> DataFrame:
        """(h1, h2, score, vec_id) of the best entries in the leaves that these visits call on."""
        sizes = placed.groupBy("leaf").count().withColumnRenamed("count", "n").join(calls.groupBy("leaf").count().withColumnRenamed("count", "m"), "leaf")
        sizes = F.broadcast(spark.createDataFrame([(r["leaf"], -(-r["n"] // chunk), -(-r["m"] // chunk)) for r in sizes.collect()], "leaf int, n int, m int"))

        def part(of: str) -> Column:
            return F.pmod(F.xxhash64("h2", F.lit(5)), F.col(of)).cast("int")

        def every(of: str) -> Column:
            return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

        left = placed.join(sizes, "leaf").select("leaf", part("n").alias("own"), every("m").alias("other"), "embedding", "ids")
        right = calls.join(sizes, "leaf").select("leaf", every("n").alias("own"), part("m").alias("other"), "h1", "h2", "embedding", "bound")
        both = left.groupBy("leaf", "own", "other").cogroup(right.groupBy("leaf", "own", "other")).applyInArrow(
            _met(k + 1), "h1 bigint, h2 bigint, scores array<double>, ids array<array<bigint>>")
        return both.select("h1", "h2", F.explode(F.arrays_zip("scores", "ids")).alias("z")).select(
            "h1", "h2", F.col("z.scores").alias("score"), F.explode("z.ids").alias("vec_id"))

    # The first visits bound a query's results from below, so the rest report what reaches that bound only.
    n_first = -(-n_visits // FIRST)
    first = scratch.keep("first", met(visits.where(F.col("nth") < n_first).withColumn("bound", F.lit(float("-inf")))).withColumn(
        "nth", F.row_number().over(ranked)).where(F.col("nth") <= k + 1))
    bounds = first.where(F.col("nth") == k + 1).select("h1", "h2", F.col("score").alias("bound"))
    rest = met(visits.where(F.col("nth") >= n_first).join(bounds, ["h1", "h2"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf")))))
    lists = first.drop("nth").unionByName(rest).withColumn("nth", F.row_number().over(ranked)).where(F.col("nth") <= k + 1).groupBy("h1", "h2").agg(
        F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("found"))
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return asked.join(lists, ["h1", "h2"]).select("query_id", F.posexplode(others).alias("place", "x")).select(
        "query_id", (F.col("place") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
