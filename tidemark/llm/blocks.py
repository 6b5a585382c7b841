"""Texts of Arrow batches as flat byte arrays: bounded blocks, word spans, hashes of any substring."""
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = (1 << 20) - 1       # tables of powers for it have 2**20 entries
SMALL_BLOCK_BYTES = (1 << 18) - 1      # for steps with many arrays beside a text
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts hold at most `limit` bytes together; a longer text comes alone.

    What Arrow holds of earlier batches goes back to the system, for the worker shares an executor's memory.
    """
    for batch in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(start, end - start)
            start = end
        del batch, total
        pa.default_memory_pool().release_unused()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another and their n + 1 offsets; a null is an empty text."""
    column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, width)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_spans(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word: a longest run of bytes other than ASCII white space."""
    return runs(~WHITE[flat], offsets)


def runs(ink: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every longest run of bytes that `ink` marks; runs end with their text."""
    bounds = offsets[(offsets > 0) & (offsets < len(ink))]
    opens, closes = ink.copy(), ink.copy()
    if len(ink):
        opens[1:] &= ~ink[:-1]
        closes[:-1] &= ~ink[1:]
        opens[bounds] = ink[bounds]
        closes[bounds - 1] = ink[bounds - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def counted(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many items each of n rows has, and the offset of its first item; `rows` is sorted."""
    counts = np.bincount(rows, minlength=n)
    return counts, np.concatenate([[0], np.cumsum(counts)])


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (the published splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, one table for all hashes of a process."""

    BASE = 0x5851F42D4C957F2D        # odd, and 5 modulo 8, so its powers have the greatest period

    def __init__(self):
        self.powers = self.inverses = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.powers):
            n = 1 << (n - 1).bit_length()
            for name, base in (("powers", self.BASE), ("inverses", pow(self.BASE, -1, 2**64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


POWERS = Powers()


class SpanHash:
    """Polynomial hash modulo 2**64: after one prefix sum the hash of any span costs two look-ups.

    Bytes map to random 64-bit values, other ones for each seed, so hashes of different seeds are independent. Spans
    with equal bytes have equal hashes in every block, task and run.
    """

    def __init__(self, seed: int, table: np.ndarray | None = None):
        self.values = np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64)
        if table is not None:
            self.values = self.values[table]

    def prefixes(self, flat: np.ndarray) -> np.ndarray:
        POWERS.grow(len(flat) + 1)
        out = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(self.values[flat] * POWERS.powers[:len(flat)], out=out[1:])
        return out

    def spans(self, prefixes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((prefixes[ends] - prefixes[starts]) * POWERS.inverses[starts])


def chained(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from every position on that has n words after it."""
    out = words[:max(0, len(words) - n + 1)].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k:k + len(out)])
    return out


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles and their rows; a row with fewer words has its whole sequence as one."""
    counts, first = counted(rows, n_rows)
    inside = np.flatnonzero(np.arange(len(words)) + n <= first[rows + 1])
    found, owners = [chained(words, n)[inside]], [rows[inside]]
    for m in range(1, n):
        short = np.flatnonzero(counts == m)
        if len(short):
            found.append(chained(words, m)[first[short]])
            owners.append(short)
    found, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return found[order], owners[order]


def distinct(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values sorted within their row, each once."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[keep], rows[keep]


def code_points(flat: np.ndarray) -> np.ndarray:
    """True at the first byte of every code point."""
    return (flat & 0xC0) != 0x80


def lists(values: np.ndarray, rows: np.ndarray, n_rows: int, kind: pa.DataType) -> pa.ListArray:
    """One list for each row; `rows` is sorted."""
    return pa.ListArray.from_arrays(pa.array(counted(rows, n_rows)[1], pa.int32()), pa.array(values, kind))
