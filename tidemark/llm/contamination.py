"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

Items are partitioned by their number of shingles (powers of two). Each item has `n_hashes` MinHash values:
the shingle that is least under each of as many hash functions. A least shingle lies in a document with
probability |item and document| / |item|, the containment, however long the document is; so the share of an
item's values that a document's shingles hit estimates containment without a sketch of the long side, and an
item of containment t is missed with probability (1 - t) ** n_hashes (7e-12 at 0.8 with 16). Size partitions
prune the other way: a document with fewer shingles than the threshold's share of a partition's least size
never meets that partition. Candidates are verified by exact shingle containment.
"""
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import cut_lineage

SPLIT = "[ \\t\\n\\u000B\\f\\r]+"
# Sketches of items below this many bytes (rows are 40 bytes) are sent to every executor; beyond, Spark shuffles.
BROADCAST_BYTES = 64 << 20


def shingle_hashes(text: Column, n: int) -> Column:
    """Hashes of all n-word shingles in order; of the whole sequence for a text of fewer words; empty without words."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lowered, SPLIT), lambda w: w != "")
    # A one-element transform binds the hashed words once for all uses below.
    return F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), lambda h: F.when(
        F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*(h[i + k] for k in range(n)))))
        .when(F.size(h) > 0, F.array(F.aggregate(h, F.lit(17).cast("bigint"), lambda a, x: F.xxhash64(a, x))))
        .otherwise(F.array().cast("array<bigint>")))[0]


def item_sketches(items: DataFrame, n: int, n_hashes: int) -> DataFrame:
    """(item_id, size, least_size, h): the MinHash values of every item, each value once."""
    seeds = F.array(*(F.lit(k) for k in range(n_hashes)))
    least = F.transform(seeds, lambda k: F.array_min(F.transform("shingles", lambda s: F.struct(F.xxhash64(s, k).alias("o"), s.alias("s"))))["s"])
    return items.withColumn("size", F.size("shingles")).where("size > 0").select(
        "item_id", "size", F.pow(F.lit(2), F.floor(F.log2("size"))).cast("bigint").alias("least_size"),
        F.explode(F.array_distinct(least)).alias("h"))


def contaminated(docs: DataFrame, items: DataFrame, n: int = 5, threshold_percent: int = 80, n_hashes: int = 16) -> DataFrame:
    """(doc_id, text), (item_id, text) -> (doc_id, item_id, n_shingles, n_common, containment), a row for each pair
    of which at least `threshold_percent` of the item's distinct shingles are in the document.

    Words are lower-cased in A-Z and split at ASCII white space. Null and blank texts match nothing; rows without
    an id match nothing; an item shorter than n words matches a document that consists of the same words. Rows
    that repeat an id count as one text each and give one row for each pair of ids (the best).
    """
    items = cut_lineage(items.where("item_id is not null").select("item_id", F.array_distinct(shingle_hashes(F.col("text"), n)).alias("shingles"))
                        .where(F.size("shingles") > 0).dropDuplicates(["item_id", "shingles"]))
    sketches = cut_lineage(item_sketches(items, n, n_hashes))
    small = sketches.count() * 40 <= BROADCAST_BYTES
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    probe = docs.select("doc_id", shingle_hashes(F.col("text"), n).alias("shingles")) \
        .select("doc_id", F.size("shingles").alias("n_all"), F.explode("shingles").alias("h"))
    met = probe.join(F.broadcast(sketches) if small else sketches, "h") \
        .where(100 * F.col("n_all") >= threshold_percent * F.col("least_size"))
    candidates = cut_lineage(met.select("doc_id", "item_id").distinct())
    chosen = docs.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi") \
        .select("doc_id", shingle_hashes(F.col("text"), n).alias("in_doc"))
    pairs = candidates.join(items.withColumnRenamed("shingles", "in_item"), "item_id").join(chosen, "doc_id")
    return pairs.select("doc_id", "item_id", F.size("in_item").cast("bigint").alias("n_shingles"),
                        F.size(F.array_intersect("in_item", "in_doc")).cast("bigint").alias("n_common")) \
        .where(100 * F.col("n_common") >= threshold_percent * F.col("n_shingles")) \
        .withColumn("containment", F.col("n_common") / F.col("n_shingles")) \
        .groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_shingles", "n_common")).alias("best")) \
        .select("doc_id", "item_id", "best.n_shingles", "best.n_common", "best.containment")


def decontaminate(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """The rows of `docs` that hold no item."""
    hits = contaminated(docs, items, **settings).select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(hits, docs["doc_id"] == hits["_hit"], "left_anti")
