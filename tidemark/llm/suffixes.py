"""Repeated byte strings by a distributed sort of suffixes.

A byte is removed when a `LENGTH`-byte string that covers it starts anywhere else in the corpus too.

Suffixes. Sorting one suffix for each byte would move the corpus LENGTH times. Instead a text is cut where its
content says (winnowing): of the GRAM-byte strings inside any LENGTH-byte window the one with the least hash is
the window's anchor, so equal windows have equal anchors at the same offset. An anchor serves a run of windows,
and the bytes under that run are its segment. About one anchor in 70 bytes is a suffix of the first sort, with
two leading tokens: its gram and its whole segment (64-bit hashes).

Sort. `repartitionByRange` samples splitters and deals the suffixes out by their leading tokens (and, among equal
ones, by document, so a passage that a third of all documents hold fills many buckets). A task sorts its bucket
by multikey quicksort (runs that tie on one token are sorted by the next) and compares neighbours. Equal suffixes
may lie on both sides of a splitter, so every bucket gives its first and last runs to a small table of boundary
runs, two rows for each bucket, and those decide what a bucket cannot see.

A segment that occurs twice repeats in all its windows. A gram that occurs in different segments (the edge of a
repeated passage, or the place of an edit) sends one of each kind into the second sort, whose suffixes are blocks of
RUN windows, laid out from the anchor, with two tokens again: the bytes that all windows of the full block share, and
the block's own bytes. A block that occurs twice repeats; where only the shared bytes do, one block of each kind goes
into the third sort as single windows (first eight bytes, hash of the window).
"""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import blocks as tb
from tidemark.llm.folds import prefix_for, protected
from tidemark.llm.scratch import Scratch

LENGTH, GRAM, RUN = 200, 64, 8
BUCKET_ROWS = 1_000_000
BLOCK_BYTES = tb.BLOCK_BYTES
# Windows that one step of the anchor search takes, and the low bits that hold a place inside a step.
_STEP, _PLACE = 1 << 16, np.uint64((1 << 18) - 1)
_GRAMS, _SEGMENTS = tb.SpanHash(41), tb.SpanHash(42)


def _places(hashes: np.ndarray, n: int, width: int) -> np.ndarray:
    """For each of n windows the place of the least of its `width` hashes, the last one of equal ones."""
    out = np.empty(n, np.int64)
    for a in range(0, n, _STEP):
        m = min(_STEP, n - a)
        part = hashes[a:a + m + width - 1]
        least = (part & ~_PLACE) | (_PLACE - np.arange(len(part), dtype=np.uint64))
        reach = 1
        while reach < width:
            step = min(reach, width - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        out[a:a + m] = a + (_PLACE - (least & _PLACE)).astype(np.int64)
    return out


class Anchors:
    """Anchors of the texts of a block: row, first and last window, gram and segment (hashes)."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
        self.length, self.flat = length, flat
        n = max(0, len(flat) - length + 1)
        self.prefix = _SEGMENTS.prefixes(flat)
        sizes = np.diff(offsets)
        rows = np.repeat(np.arange(len(sizes)), sizes)[:n]
        inside = np.flatnonzero(np.arange(n) + length <= offsets[rows + 1])
        if not len(inside):
            self.rows = self.lo = self.hi = self.place = np.zeros(0, np.int64)
            self.gram = self.segment = np.zeros(0, np.uint64)
            return
        prefix = _GRAMS.prefixes(flat)
        hashes = tb.mix((prefix[gram:] - prefix[:-gram]) * tb.POWERS.inverses[:len(flat) - gram + 1])
        place = _places(hashes, n, length - gram + 1)[inside]
        rows = rows[inside]
        head = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (rows[1:] != rows[:-1])])
        self.rows, self.lo, self.hi = rows[head], inside[head], inside[np.r_[head[1:], len(inside)] - 1]
        self.place, self.gram = place[head], hashes[place[head]]
        whole = _SEGMENTS.spans(self.prefix, self.lo, self.hi + length)
        # The same bytes around another anchor place are another segment.
        self.segment = tb.mix(whole + (self.place - self.lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def blocks(self, chosen: np.ndarray, run: int) -> tuple[np.ndarray, ...]:
        """Anchor, first and last window, shared bytes and own bytes (hashes) of the chosen anchors' blocks.

        Blocks of `run` windows are laid out from the anchor's place and end with its windows, so a window is in one
        block. The bytes that a full block's windows share lie in the text even where the block is cut short.
        """
        run = min(run, self.length)
        low, high = -((self.place - self.lo)[chosen] // run) - 1, (self.hi - self.place)[chosen] // run
        sizes = high - low + 1
        anchor = np.repeat(chosen, sizes)
        begin = self.place[anchor] + run * (np.arange(len(anchor)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes))
        first, last = np.maximum(begin, self.lo[anchor]), np.minimum(begin + run - 1, self.hi[anchor])
        some = first <= last
        anchor, begin, first, last = anchor[some], begin[some], first[some], last[some]
        shared = _GRAMS.spans(_GRAMS.prefixes(self.flat), begin + run - 1, begin + self.length) if len(begin) else np.zeros(0, np.uint64)
        own = _SEGMENTS.spans(self.prefix, first, last + self.length)
        return anchor, first, last, shared, tb.mix(own + (first - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def windows(self, starts: np.ndarray) -> np.ndarray:
        return _SEGMENTS.spans(self.prefix, starts, starts + self.length)

    def repeated_inside(self) -> np.ndarray:
        """True where a text has the same segment twice or more."""
        order = np.lexsort((self.segment, self.rows))
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = (np.diff(self.segment[order]) == 0) & (np.diff(self.rows[order]) == 0)
        out = np.empty(len(order), bool)
        out[order] = same[:-1] | same[1:]
        return out


def multikey_order(tokens: list[np.ndarray]) -> np.ndarray:
    """Order of suffixes by their tokens: sort by one token, then every run of ties by the next."""
    order = np.argsort(tokens[0], kind="stable")
    run = np.zeros(len(order), np.int64)
    for depth, token in enumerate(tokens[1:], 1):
        before = tokens[depth - 1][order]
        starts = np.r_[True, (before[1:] != before[:-1]) | (run[1:] != run[:-1])] if len(order) else np.zeros(0, bool)
        run = np.cumsum(starts)
        alone = starts & np.r_[starts[1:], True] if len(order) else starts
        tied = np.flatnonzero(~alone)
        inner = order[tied]
        order[tied] = inner[np.lexsort((token[inner], run[tied]))]
    return order


_SUFFIX = "doc bigint, t0 bigint, t1 bigint, copies bigint"


def _suffixes(length: int, gram: int):
    """(doc, text) -> one row for each distinct segment of a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, "text", BLOCK_BYTES):
            a = Anchors(*tb.utf8(block.column("text")), length, gram)
            order = np.lexsort((a.segment, a.rows))
            new = np.r_[True, (np.diff(a.segment[order]) != 0) | (np.diff(a.rows[order]) != 0)][:len(order)]
            first = np.flatnonzero(new)
            copies = np.minimum(2, np.diff(np.r_[first, len(order)]))
            one = order[first]
            doc = block.column("doc").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([
                pa.array(doc[a.rows[one]], pa.int64()), pa.array(a.gram[one].view(np.int64)), pa.array(a.segment[one].view(np.int64)),
                pa.array(copies, pa.int64())], names=["doc", "t0", "t1", "copies"])

    return run


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort one bucket and compare neighbours. Rows that neither repeat nor may do so beyond the bucket's ends go.

    copies: rows of the run of both tokens (2: two or more); many: the first token occurs with different second ones;
    one: first row of its run; open: the first token is the bucket's first or last.
    """
    table = pa.Table.from_batches([b for b in batches], schema=pa.schema([(c, pa.int64()) for c in ("doc", "t0", "t1", "copies", "extra")]))
    cols = {c: table.column(c).to_numpy() for c in table.column_names}
    if not len(cols["doc"]):
        return
    order = multikey_order([cols["t0"], cols["t1"]])
    doc, t0, t1, copies, extra = (cols[c][order] for c in ("doc", "t0", "t1", "copies", "extra"))
    outer = np.r_[True, t0[1:] != t0[:-1]]
    inner = outer | np.r_[True, t1[1:] != t1[:-1]]
    starts = np.flatnonzero(inner)
    sizes = np.diff(np.r_[starts, len(t0)])
    total = np.repeat(np.minimum(2, np.add.reduceat(copies, starts)), sizes)
    kinds = np.add.reduceat(inner, np.flatnonzero(outer)) > 1
    many = kinds[np.cumsum(outer) - 1]
    open_ = (t0 == t0[0]) | (t0 == t0[-1])
    # Rows that were known to repeat before (extra below zero) are there to be compared with; one of a run goes on.
    keep = np.flatnonzero(((total > 1) & (extra >= 0)) | (many & inner) | open_)
    for a in range(0, len(keep), 100_000):
        k = keep[a:a + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(x[k]) for x in (doc, t0, t1, total, extra, many, inner, open_)],
                                         names=["doc", "t0", "t1", "copies", "extra", "many", "one", "open"])


def sorted_suffixes(scratch: Scratch, name: str, suffixes: DataFrame) -> DataFrame:
    """(doc, t0, t1, copies, extra) -> the same with copies (1, or 2 for two or more in the corpus), many and one."""
    spark = scratch.spark
    rows = scratch.keep(f"{name}-suffixes", suffixes)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BUCKET_ROWS))
    found = scratch.keep(f"{name}-sorted", rows.repartitionByRange(buckets, "t0", "t1", "doc", "extra").mapInArrow(
        _bucket, "doc bigint, t0 bigint, t1 bigint, copies bigint, extra bigint, many boolean, one boolean, open boolean"))
    scratch.drop(f"{name}-suffixes")
    # What a bucket cannot see: `open` rows, summed to one row for each token pair.
    edge = found.where("open and one")
    ends = scratch.keep(f"{name}-ends", edge.groupBy("t0", "t1").agg(F.sum("copies").alias("sum")))
    kinds = scratch.keep(f"{name}-kinds", edge.groupBy("t0").agg((F.min("t1") != F.max("t1")).alias("kinds")))
    settled = found.where("open").join(ends, ["t0", "t1"]).join(kinds, "t0").select(
        "doc", "t0", "t1", F.least(F.lit(2), F.col("sum")).cast("bigint").alias("copies"), "extra", F.col("kinds").alias("many"), "one")
    return found.where("not open").select("doc", "t0", "t1", "copies", "extra", "many", "one").union(settled)


def _listed(block: pa.RecordBatch, a: Anchors, key: np.ndarray, rows: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Places in `key` (a value for each piece of the texts, `rows` their texts) that column `listed` names, each value
    of a text once, and the copies listed with them."""
    lists = block.column("listed")
    owner = np.repeat(np.arange(block.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    wanted, copies = flat.field(name).to_numpy(), flat.field("copies").to_numpy()
    both = np.concatenate([rows, owner]), np.concatenate([key, wanted])
    order = np.lexsort((np.r_[np.ones(len(rows), int), np.zeros(len(owner), int)], both[1], both[0]))
    r, k = both[0][order], both[1][order]
    group = np.cumsum(np.r_[True, (r[1:] != r[:-1]) | (k[1:] != k[:-1])]) - 1 if len(r) else r
    is_wanted = order >= len(rows)
    value = np.zeros(group[-1] + 1 if len(group) else 0, np.int64)
    np.maximum.at(value, group[is_wanted], copies[order[is_wanted] - len(rows)])
    hit = ~is_wanted & (value[group] > 0) if len(group) else is_wanted
    first = np.unique(group[hit], return_index=True)[1]
    at = order[np.flatnonzero(hit)[first]]
    return at, value[group[np.flatnonzero(hit)[first]]]


def _pieces(length: int, gram: int, run: int):
    """(doc, text, listed segments) -> their blocks; extra is the block's place, -1 - place in segments known to repeat."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, "text", BLOCK_BYTES):
            flat, offsets = tb.utf8(block.column("text"))
            a = Anchors(flat, offsets, length, gram)
            chosen, copies = _listed(block, a, a.segment.view(np.int64), a.rows, "t1")
            known = np.zeros(len(a.rows), np.int64)
            known[chosen] = copies
            anchor, first, _, shared, own = a.blocks(np.sort(chosen), run)
            place = first - offsets[a.rows[anchor]]
            doc = block.column("doc").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([
                pa.array(doc[a.rows[anchor]], pa.int64()), pa.array(shared.view(np.int64)), pa.array(own.view(np.int64)),
                pa.array(known[anchor], pa.int64()), pa.array(np.where(known[anchor] > 1, -1 - place, place), pa.int64())],
                names=["doc", "t0", "t1", "copies", "extra"])

    return task


def _windows(length: int, gram: int, run: int):
    """(doc, text, listed blocks) -> their windows; extra as for blocks."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, "text", BLOCK_BYTES):
            flat, offsets = tb.utf8(block.column("text"))
            a = Anchors(flat, offsets, length, gram)
            anchor, first, last, _, _ = a.blocks(np.arange(len(a.rows)), run)
            rows = a.rows[anchor]
            chosen, copies = _listed(block, a, first - offsets[rows], rows, "place")
            sizes = last[chosen] - first[chosen] + 1
            at = np.repeat(first[chosen] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            owner, known = np.repeat(rows[chosen], sizes), np.repeat(copies, sizes)
            lead = np.zeros(len(at), np.uint64)
            for k in range(min(8, length)):
                lead = (lead << np.uint64(8)) | flat[at + k]
            place = at - offsets[owner]
            doc = block.column("doc").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([
                pa.array(doc[owner], pa.int64()), pa.array(lead.view(np.int64)), pa.array(a.windows(at).view(np.int64)),
                pa.array(known, pa.int64()), pa.array(np.where(known > 1, -1 - place, place), pa.int64())],
                names=["doc", "t0", "t1", "copies", "extra"])

    return task


def _among(rows: np.ndarray, values: np.ndarray, named_rows: np.ndarray, named: np.ndarray) -> np.ndarray:
    """True where a (row, value) is among the named ones."""
    if not len(named) or not len(values):
        return np.zeros(len(values), bool)
    kind = [("row", np.int64), ("value", np.int64)]
    left, right = np.empty(len(values), kind), np.empty(len(named), kind)
    left["row"], left["value"], right["row"], right["value"] = rows, values, named_rows, named
    return np.isin(left, right)


def _cut(length: int, gram: int, run_length: int, mark: str):
    """(..., text, segments, starts; the last two under `mark`) -> removed spans and the bytes that stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tb.blocks(batches, "text", BLOCK_BYTES):
            flat, offsets = tb.utf8(block.column("text"))
            a = Anchors(flat, offsets, length, gram)
            gone = a.repeated_inside()
            edges = np.zeros(len(flat) + 1, np.int64)
            segments, starts = block.column(f"{mark}segments"), block.column(f"{mark}starts")
            owner = np.repeat(np.arange(block.num_rows), pc.fill_null(segments.value_lengths(), 0).to_numpy(zero_copy_only=False))
            gone |= _among(a.rows, a.segment.view(np.int64), owner, segments.flatten().to_numpy(zero_copy_only=False))
            # A place names a block if its bytes are the block's, a window if they are the window's.
            owner = np.repeat(np.arange(block.num_rows), pc.fill_null(starts.value_lengths(), 0).to_numpy(zero_copy_only=False))
            if len(owner):
                at, named = starts.flatten().field("extra").to_numpy() + offsets[owner], starts.flatten().field("t1").to_numpy()
                _, first, last, _, own = a.blocks(np.arange(len(a.rows)), run_length)
                whole = _among(first, own.view(np.int64), at, named)
                single = at[at + length <= offsets[owner + 1]], named[at + length <= offsets[owner + 1]]
                single = single[0][a.windows(single[0]).view(np.int64) == single[1]]
                for low, high in ((first[whole], last[whole]), (single, single)):
                    np.add.at(edges, low, 1)
                    np.add.at(edges, high + length, -1)
            np.add.at(edges, a.lo[gone], 1)
            np.add.at(edges, a.hi[gone] + length, -1)
            removed = np.cumsum(edges[:-1]) > 0
            turn = removed.copy()
            turn[1:] = removed[1:] != removed[:-1]
            bounds = offsets[(offsets > 0) & (offsets < len(flat))]
            turn[bounds] = removed[bounds]
            span_starts = np.flatnonzero(turn & removed)
            last = np.append(removed[1:] != removed[:-1], True)[:len(removed)] if len(removed) else removed
            last[bounds - 1] = True
            span_ends = np.flatnonzero(last & removed) + 1
            owner = np.searchsorted(offsets, span_starts, "right") - 1
            kind = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            spans = pa.StructArray.from_arrays([pa.array(span_starts - offsets[owner], pa.int64()), pa.array(span_ends - offsets[owner], pa.int64())], fields=list(kind))
            stay, stays = flat[~removed], np.concatenate([[0], np.cumsum(~removed)])[offsets]
            data = stay.tobytes()
            own = [c for c in block.schema.names if c not in (f"{mark}segments", f"{mark}starts")]
            yield pa.RecordBatch.from_arrays([
                *(block.column(c) for c in own), pa.array(np.diff(offsets), pa.int64()),
                pa.ListArray.from_arrays(pa.array(tb.counted(owner, block.num_rows)[1], pa.int32()), spans),
                pa.array([data[x:y] for x, y in zip(stays.tolist(), stays[1:].tolist())], pa.binary()),
            ], names=[*own, "n_bytes", "removed", "kept_bytes"])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, run: int = RUN) -> DataFrame:
    """All columns of `docs` plus n_bytes, removed (array of byte spans, maximal and in order) and kept_bytes.

    Texts count as UTF-8 bytes, a null text as empty; strings never cross texts. Every row is a text of its own, so
    rows that repeat an id and text repeat each other. Texts shorter than `length` bytes lose nothing. Columns of
    `docs` named like an added one are replaced.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark)
    own = [f for f in docs.schema.fields if f.name not in ("n_bytes", "removed", "kept_bytes")]
    texts = docs.select(F.xxhash64(*[f"`{f.name}`" for f in own if f.name in ("doc_id", "text")]).alias("doc"), "text")

    def level(name: str, suffixes: DataFrame) -> DataFrame:
        found = scratch.keep(name, sorted_suffixes(scratch, name, suffixes))
        scratch.drop(*(f"{name}-{part}" for part in ("sorted", "ends", "kinds")))
        return found

    first = level("segments", texts.mapInArrow(_suffixes(length, gram), _SUFFIX).withColumn("extra", F.lit(0).cast("bigint")))
    listed = first.where("many and one").groupBy("doc").agg(F.collect_set(F.struct("t1", "copies")).alias("listed"))
    second = level("blocks", texts.join(listed, "doc").mapInArrow(_pieces(length, gram, run), _SUFFIX + ", extra bigint"))
    place = F.when(F.col("extra") < 0, -1 - F.col("extra")).otherwise(F.col("extra")).alias("place")
    listed = second.where("many and one").groupBy("doc").agg(F.collect_set(F.struct(place, "copies")).alias("listed"))
    third = level("windows", texts.join(listed, "doc").mapInArrow(_windows(length, gram, run), _SUFFIX + ", extra bigint"))
    repeated = [found.where("copies > 1 and extra >= 0").select("doc", "extra", "t1") for found in (second, third)]
    mark = prefix_for(docs)
    key = f"{mark}doc"
    segments = first.where("copies > 1").groupBy(F.col("doc").alias(key)).agg(F.collect_set("t1").alias(f"{mark}segments"))
    starts = repeated[0].union(repeated[1]).groupBy(F.col("doc").alias(key)).agg(F.collect_set(F.struct("extra", "t1")).alias(f"{mark}starts"))
    names = [f"`{f.name}`" for f in own]
    keyed = docs.select(*names, F.xxhash64(*[n for n in names if n in ("`doc_id`", "`text`")]).alias(key))
    joined = keyed.join(segments.join(starts, key, "full_outer"), key, "left").select(*names, f"{mark}segments", f"{mark}starts")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
    return joined.mapInArrow(_cut(length, gram, run, mark), schema + ", n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept_bytes binary")


def _whole_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., text, removed) -> text without the characters whose bytes all lie in removed spans."""
    for block in tb.blocks(batches, "text", BLOCK_BYTES):
        flat, offsets = tb.utf8(block.column("text"))
        spans = block.column("removed")
        owner = np.repeat(np.arange(block.num_rows), spans.value_lengths().to_numpy(zero_copy_only=False))
        found = spans.flatten()
        edges = np.zeros(len(flat) + 1, np.int64)
        np.add.at(edges, found.field("start").to_numpy() + offsets[owner], 1)
        np.add.at(edges, found.field("end").to_numpy() + offsets[owner], -1)
        stay = np.cumsum(edges[:-1]) == 0
        if len(flat):
            head = np.flatnonzero(tb.code_points(flat))
            stay = np.repeat(np.maximum.reduceat(stay, head), np.diff(np.r_[head, len(flat)]))
        ends = np.concatenate([[0], np.cumsum(stay)])[offsets]
        data = flat[stay].tobytes()
        texts = pa.array([data[x:y] for x, y in zip(ends.tolist(), ends[1:].tolist())], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([texts if c == "text" else block.column(c) for c in block.schema.names], names=block.schema.names)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """`docs` with its columns, its texts without repeated strings; rows whose text has no word left go.

    A character goes if all its bytes do, so texts stay valid. n_chars, if `docs` has it, counts the new text.
    """
    safe, back = protected(docs, ["n_bytes", "removed", "kept_bytes"])
    found = repeated_spans(safe, length, gram).drop("n_bytes", "kept_bytes")
    cut = found.mapInArrow(_whole_characters, found.schema).where(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return back(cut)
