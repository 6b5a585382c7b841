"""Near-duplicate documents by min-max hashing, confirmed on the full shingle sets.

Every permutation is evaluated once over a document's shingles and gives two signature values, its minimum
and its maximum (192 evaluations, 384 values). Six values make a band; two documents with 80 % of their
shingles in common miss all 64 bands with a probability of 4e-9. Two bits of each of the first 128 values go along with a
bucket's members: a pair whose bits agree in fewer places than a similarity of 80 % gives but once in 10^9 is not compared further.

Documents with equal sets collapse into a class first, so a group of copies of any size is one candidate.
In a bucket every member is compared with one centre (the member that shares most buckets) and, once that has
made components, with the members of other components, so no bucket is expanded into all its pairs and no
link between components is lost.
"""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm import blocks as tb
from tidemark.llm.graph import components
from tidemark.llm.scratch import Scratch

N_PERMUTATIONS, BAND = 192, 6
SKETCHED = 128               # signature values whose last two bits are sketched
SKETCH = ["s0", "s1", "s2", "s3"]
_WORDS = tb.SpanHash(11, tb.LOWER)
_rng = np.random.default_rng(12)
_FACTORS = _rng.integers(0, 2**63, N_PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 2**64, N_PERMUTATIONS, dtype=np.uint64)


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within the text, and their rows."""
    flat, offsets = tb.utf8(column)
    starts, ends, rows = tb.word_spans(flat, offsets)
    words = _WORDS.spans(_WORDS.prefixes(flat), starts, ends)
    return tb.distinct(*tb.shingles(words, rows, len(column), n))


def signatures(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have shingles, and a line of minima and maxima for each."""
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    out = np.empty((len(first), 2 * N_PERMUTATIONS), np.uint64)
    for k in range(N_PERMUTATIONS if len(first) else 0):
        permuted = values * _FACTORS[k] + _SHIFTS[k]
        out[:, 2 * k] = np.minimum.reduceat(permuted, first)
        out[:, 2 * k + 1] = np.maximum.reduceat(permuted, first)
    return rows[first], out


def sketch_bits(lines: np.ndarray) -> list[np.ndarray]:
    """Four 64-bit words for each line: last bits of the first SKETCHED values, then the bits before them."""
    place = np.arange(64, dtype=np.uint64)
    return [np.bitwise_or.reduce(((lines[:, a:a + 64] >> np.uint64(bit)) & np.uint64(1)) << place, axis=1) if len(lines) else np.zeros(0, np.uint64)
            for bit in (0, 1) for a in range(0, SKETCHED, 64)]


def _alike(left: str, right: str, percent: int) -> Column:
    """Whether two sketches agree as often as sets of that similarity do, less six standard deviations."""
    differ = sum((F.bit_count((F.col(f"{left}{k}").bitwiseXOR(F.col(f"{right}{k}"))).bitwiseOR(
        F.col(f"{left}{k + 2}").bitwiseXOR(F.col(f"{right}{k + 2}")))) for k in range(2)), F.lit(0))
    agree = percent / 100 + (1 - percent / 100) / 4
    most = SKETCHED * (1 - agree) + 6 * (SKETCHED * agree * (1 - agree)) ** 0.5
    return differ <= int(most) + 1


def _sketch(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, "text", tb.SMALL_BLOCK_BYTES):
            values, rows = shingle_sets(block.column("text"), n)
            owners, lines = signatures(values, rows)
            bands = np.full((len(owners), 2 * N_PERMUTATIONS // BAND), 7, np.uint64) + np.arange(2 * N_PERMUTATIONS // BAND, dtype=np.uint64)
            for k in range(BAND):
                bands = tb.mix(bands * np.uint64(0x9E3779B97F4A7C15) + lines[:, k::BAND])
            counts, first = tb.counted(rows, block.num_rows)
            digests = [np.zeros(block.num_rows, np.uint64) for _ in range(2)]
            for d, factor in zip(digests, (0xD6E8FEB86659FD93, 0xA24BAED4963EE407)):
                if len(owners):
                    d[owners] = np.add.reduceat(tb.mix(values ^ np.uint64(factor)) * np.uint64(factor), first[owners])
            words = [np.zeros(block.num_rows, np.uint64) for _ in SKETCH]
            for w, found in zip(words, sketch_bits(lines)):
                w[owners] = found
            yield pa.RecordBatch.from_arrays([
                block.column("doc_id"), pa.array(counts, pa.int64()),
                *(pa.array(d.view(np.int64), mask=counts == 0) for d in digests),
                tb.lists(bands.view(np.int64).ravel(), np.repeat(owners, bands.shape[1]), block.num_rows, pa.int64()),
                *(pa.array(w.view(np.int64)) for w in words),
            ], names=["doc_id", "n_shingles", "d1", "d2", "bands", *SKETCH])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, "text", tb.SMALL_BLOCK_BYTES):
            values, rows = shingle_sets(block.column("text"), n)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), tb.lists(values.view(np.int64), rows, block.num_rows, pa.int64())], names=["doc_id", "shingles"])

    return run


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with the sizes of both sets, what is common, what only a has, and whether they link."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select(
        "a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"),
        F.array_except("sa", "sb").alias("added"))
    return both.withColumn("links", 100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common")))


def _around(measured: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one centre, in different components, that may still link.

    measured: (centre, doc, n, common with the centre, added, component, component of the centre). Two members have in
    common what both share with the centre and what both added to it. So a pair that added nothing in common has at most
    the smaller of their shares with the centre, which suffices only for a member shorter than the centre; all other
    pairs meet in an added shingle. Members that link with the centre are not compared with each other.
    """
    outer = measured.where("component <> home")

    def side(df: DataFrame, x: str) -> DataFrame:
        return df.select("centre", F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("common").alias(f"c{x}"), F.col("component").alias(f"k{x}"), "added")

    def near() -> Column:
        return (F.col("ka") != F.col("kb")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def added(df: DataFrame, x: str) -> DataFrame:
        return side(df, x).withColumn("shingle", F.explode("added")).drop("added")

    met = added(outer, "a").join(added(measured, "b"), ["centre", "shingle"]).where(near()).select("a", "b")
    # A pair without a common addition: percent * (na + nb) <= (100 + percent) * least(ca, cb).
    reach = F.floor((100 + percent) * F.col("common") / percent) - F.col("n")
    short = measured.groupBy("centre").agg(F.min("n").alias("least"))
    far = outer.withColumn("reach", reach).join(short, "centre").where("reach >= least").drop("least")
    limit = far.groupBy("centre").agg(F.max("reach").alias("limit"))
    small = measured.join(limit, "centre").where("n <= limit").drop("limit")
    rest = side(far, "a").drop("added").join(side(small, "b").drop("added"), "centre").where(
        near() & (percent * (F.col("na") + F.col("nb")) <= (100 + percent) * F.least("ca", "cb"))).select("a", "b")
    return met.union(rest).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, component_id, kept) for every row of `docs`.

    Words are runs of characters other than ASCII white space, lower-cased in A-Z; a set holds the distinct
    n-word shingles, or the whole sequence of a shorter text. Documents link when the common shingles are at
    least `percent` of the union; component_id is the smallest doc_id that links reach.

    Ids may be of any type that has an order; they come back as they are. A null or blank text has an empty set and links with nothing. A row without doc_id links as an exact copy
    only and is never kept; rows that repeat a doc_id share its component (kept is then true for each of the
    smallest). Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    scratch = Scratch(docs.sparkSession)
    sketch = scratch.keep("sketch", docs.mapInArrow(
        _sketch(n), f"doc_id {kind}, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, " + ", ".join(f"{c} bigint" for c in SKETCH)))
    classes = scratch.keep("classes", sketch.where("d1 is not null").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("copies")).where("copies > 1 and class_id is not null"))
    classed = sketch.join(classes, ["d1", "d2"], "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    member = scratch.keep("member", classed.select("doc_id", "n_shingles", "class_id"))
    # One row of each class goes on; repeated rows of its doc_id have equal bands or another text under the same id.
    first = classed.where("doc_id = class_id and n_shingles > 0").select("doc_id", "n_shingles", "bands", *SKETCH)
    entries = first.select("doc_id", F.explode("bands").alias("bucket"))
    shared = scratch.keep("shared", entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    hits = scratch.keep("plain-hits", entries.join(shared, "bucket"))
    rank = scratch.keep("rank", hits.groupBy("doc_id").agg(F.sum("size").alias("rank")).join(first.drop("bands"), "doc_id"))
    hits = scratch.keep("hits", hits.join(rank, "doc_id").select("bucket", "doc_id", "n_shingles", "rank", *SKETCH))
    scratch.drop("sketch", "classes", "shared", "plain-hits")
    centres = scratch.keep("centres", hits.groupBy("bucket").agg(
        F.max(F.struct("rank", F.xxhash64("doc_id").alias("tie"), "doc_id", "n_shingles", *SKETCH)).alias("c"))
        .select("bucket", F.col("c.doc_id").alias("b"), F.col("c.n_shingles").alias("nb"), *(F.col(f"c.{c}").alias(f"b{c}") for c in SKETCH)))

    def close(na, nb):
        return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)

    star = scratch.keep("star", hits.join(centres, "bucket").where(
        (F.col("doc_id") != F.col("b")) & close(F.col("n_shingles"), F.col("nb")) & _alike("s", "bs", percent))
        .select(F.col("doc_id").alias("a"), "b").distinct())
    wanted = scratch.keep("wanted", rank.select("doc_id").distinct())
    sets = scratch.keep("sets", docs.join(wanted, "doc_id", "left_semi").mapInArrow(
        _sets(n), f"doc_id {kind}, shingles array<bigint>"))
    measured = scratch.keep("measured", _compared(star, sets, percent))
    links = scratch.keep("links", measured.where("links").select("a", "b"))
    found = components(links).withColumnRenamed("node", "doc_id")

    def placed(df: DataFrame, doc: str, component: str) -> DataFrame:
        named = found.select(F.col("doc_id").alias(doc), F.col("component").alias(component))
        return df.join(named, doc, "left").withColumn(component, F.coalesce(component, doc))

    around = placed(placed(measured.select(F.col("b").alias("centre"), F.col("a").alias("doc"), F.col("na").alias("n"), "common", "added"),
                           "doc", "component"), "centre", "home")
    around = scratch.keep("around", around)
    # Members that were not compared with their bucket's centre meet the others in the bucket, by their sketches.
    seen = star.select(F.col("a").alias("doc_id"), "b", F.lit(True).alias("seen"))
    spread = placed(hits.join(centres.select("bucket", "b"), "bucket").where("doc_id <> b").join(seen, ["doc_id", "b"], "left"), "doc_id", "component")
    loose = spread.where("seen is null").select("bucket").distinct()
    spread = scratch.keep("spread", spread.join(loose, "bucket", "left_semi"))

    def side(df: DataFrame, x: str) -> DataFrame:
        return df.select("bucket", F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("component").alias(f"c{x}"),
                         F.coalesce("seen", F.lit(False)).alias(f"seen{x}"), *(F.col(c).alias(x + c) for c in SKETCH))

    unseen = side(spread.where("seen is null"), "a").join(side(spread, "b"), "bucket").where(
        (F.col("ca") != F.col("cb")) & (F.col("seenb") | (F.col("a") < F.col("b"))) & close(F.col("na"), F.col("nb")) & _alike("as", "bs", percent))
    rest = scratch.keep("rest", _around(around, percent).union(
        unseen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct())
    more = scratch.keep("more", _compared(rest, sets, percent).where("links").select("a", "b"))
    edges = scratch.keep("edges", links.union(more))
    scratch.drop("sets", "hits", "centres", "star", "measured", "links", "around", "spread", "rest", "more", "wanted")
    found = components(edges)
    return member.select("doc_id", "n_shingles", "class_id").join(
        found.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
