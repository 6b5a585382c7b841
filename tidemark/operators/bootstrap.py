"""Bootstrap draws from a reference pool, all keys and draws in one job.

A draw is a formula, not a list: slot j of a draw of `span` rows takes one row of the j-th of `span` equal
stretches of the pool's hash order, at a place hashed from (draw, j), and the whole draw is turned by a shift of
its own. No row comes twice, the size is exact, every row is equally likely, and mean and spread of a drawn mean
are those of a simple draw without replacement, because the stretches of a hash order are random sets.

So a block of the pool knows by itself which rows it serves to which draw. Blocks are stretches of pool positions,
bounded in rows and bytes; each folds its share of every draw, a draw that lies in one block is finished there, and
only folded shares of the others are shuffled. The pool is never collected or broadcast, and no drawn row is listed.
"""
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.operators.ranking import rank_by_hash
from tidemark.operators.selection import exact_percentile
from tidemark.operators.vectors import matrix_of
from tidemark.session import cut_lineage, sized

BLOCK_ROWS, BLOCK_BYTES = 16_384, 32 << 20
BATCH_BYTES = 16 << 20     # folded shares that a task holds before it hands them on
MAX_KEYS = 100_000        # distinct keys (sample sizes, context lengths) that one call may calibrate
PRIME = (1 << 31) - 1


@dataclass
class Pool:
    """Reference rows `(grp, order_key, vec)` with the row count of every group.

    Position of a row = rows of the earlier groups (in id order) + its hash rank inside the group.
    """
    frame: DataFrame
    groups: np.ndarray
    counts: np.ndarray
    width: int
    block_rows: int = BLOCK_ROWS
    cache: dict = field(default_factory=dict)

    @property
    def size(self) -> int:
        return int(self.counts.sum())

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts)[:-1]]).astype(np.int64)

    @property
    def dtype(self):
        return np.float32 if dict(self.frame.dtypes)["vec"] == "array<float>" else np.float64

    @property
    def rows_in_block(self) -> int:
        return max(min(self.block_rows, BLOCK_BYTES // (self.width * np.dtype(self.dtype).itemsize)), 1)

    def positioned(self) -> DataFrame:
        """(pos, vec)."""
        if "positioned" not in self.cache:
            kept = cut_lineage(self.frame)          # ranked by counts and by rows: both must see the same table
            ranked = rank_by_hash(kept, ["grp"])
            sizes = kept.groupBy("grp").agg(F.count("*").alias("rows"))
            starts = sizes.select(     # one row per reference window
                "grp", (F.sum("rows").over(Window.orderBy("grp")) - F.col("rows")).alias("start"))
            self.cache["positioned"] = cut_lineage(ranked.join(sized(starts), "grp").select(
                (F.col("start") + F.col("rank")).alias("pos"), "vec"))
        return self.cache["positioned"]


def make_pool(frame: DataFrame, width: int, sizes: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> Pool:
    """Pool over a deterministic frame of materialised rows.

    The layout is one number per reference window; `sizes` may give the same rows without their vectors.
    """
    rows = (frame if sizes is None else sizes).groupBy("grp").agg(F.count("*").alias("rows")).orderBy("grp").toPandas()
    return Pool(frame, rows["grp"].to_numpy(), rows["rows"].to_numpy(np.int64), width, block_rows)


@dataclass(frozen=True)
class Draw:
    """`size` rows out of the pool positions first .. first + rows - 1: slots begin, begin + step, ... of `span`.

    Draws with the same salt, range and span share no row if they share no slot. With `span` 0 rows may repeat.
    """
    salt: str
    first: int
    rows: int
    size: int
    span: int
    begin: int = 0
    step: int = 1

    def positions(self, low: int, high: int) -> np.ndarray:
        """The drawn positions in [low, high), in slot order."""
        if high <= self.first or low >= self.first + self.rows:
            return np.empty(0, dtype=np.int64)
        numbers = [int(self.digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
        if not self.span:
            slots = np.arange(self.size, dtype=np.int64)
            found = self.first + _hashed(slots, numbers) % self.rows
            return found[(found >= low) & (found < high)]
        shift = numbers[3] % self.rows
        index = self._slots_near(low - self.first, high - self.first, shift)
        slots = self.begin + self.step * index
        start, end = slots * self.rows // self.span, (slots + 1) * self.rows // self.span
        found = self.first + (start + _hashed(slots, numbers) % (end - start) + shift) % self.rows
        return found[(found >= low) & (found < high)]

    @property
    def digest(self) -> str:
        return md5(self.salt.encode()).hexdigest()

    def _slots_near(self, low: int, high: int, shift: int) -> np.ndarray:
        """Indexes of the slots whose stretch, turned by the shift, may reach into [low, high) of the range."""
        low, high = max(low, 0), min(high, self.rows)
        if low >= high:
            return np.empty(0, dtype=np.int64)
        if high - low == self.rows:
            return np.arange(self.size, dtype=np.int64)
        start, length = (low - shift) % self.rows, high - low
        pieces = [(start, min(start + length, self.rows)), (0, start + length - self.rows)]
        wanted = []
        for begin, end in pieces:
            if begin < end:
                one, other = begin * self.span // self.rows, -(-end * self.span // self.rows)
                wanted.append(np.arange(max((one - self.begin) // self.step - 1, 0),
                                        min((other - self.begin) // self.step + 2, self.size), dtype=np.int64))
        return np.unique(np.concatenate(wanted))


def _hashed(slots: np.ndarray, numbers: list[int]) -> np.ndarray:
    """Polynomial of degree two over the slot number modulo a prime: three-wise independent places."""
    x = slots + 1
    return ((numbers[2] % PRIME * x % PRIME + numbers[1] % PRIME) % PRIME * x + numbers[0] % PRIME) % PRIME


def distinct_choice(salt: str, n: int, k: int) -> np.ndarray:
    """k of 0 .. n - 1 without repeats, ascending, by the same formula."""
    return np.sort(Draw(salt, 0, n, k, k).positions(0, n))


def run_draws(keys: DataFrame, n_draws: int, pool: Pool, sets_of: Callable, fold: Callable, finish: Callable,
              prepare: Callable = lambda rows: rows) -> DataFrame:
    """Every key (bigint columns) with `draw` 0 .. n_draws - 1 and the `statistic` of each draw.

    sets_of(key: dict, draw) -> the draw's sets; prepare(rows) maps pool rows one by one;
    fold(list of prepared rows, one entry a set; whether the draw lies in this block) -> matrix of bounded size;
    finish(key: dict, list of shares) -> float.
    """
    spark, names = keys.sparkSession, keys.columns
    wanted = [tuple(map(int, row)) for row in keys.distinct().limit(MAX_KEYS + 1).collect()]    # bounded below
    if len(wanted) > MAX_KEYS:
        raise ValueError(f"more than {MAX_KEYS} keys to calibrate in one call")
    shared = spark.sparkContext.broadcast(sorted(wanted))
    step, dtype, total = pool.rows_in_block, pool.dtype, pool.size
    # A pool of few blocks goes to several tasks, each with a part of the draws; copies never exceed the cores.
    parts = int(min(max(-(-spark.sparkContext.defaultParallelism // max(-(-total // step), 1)), 1), max(n_draws, 1)))
    key_schema = ", ".join(f"{k} bigint" for k in names)

    columns = {**dict.fromkeys([*names, "draw"], pa.int64()), "statistic": pa.float64(), "width": pa.int64(),
               "share": pa.list_(pa.float64())}

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        block, part = table.column("block")[0].as_py(), table.column("part")[0].as_py()
        low, high = block * step, min((block + 1) * step, total)
        found = matrix_of(table.column("vec"), dtype)
        rows = np.empty((high - low, found.shape[1]), dtype)
        rows[table.column("pos").to_numpy() - low] = found
        ready, waiting, held = prepare(rows), [], 0
        for values in shared.value:
            key = dict(zip(names, values))
            for draw in range(part, n_draws, parts):
                sets = sets_of(key, draw)
                served = [s.positions(low, high) - low for s in sets]
                count = sum(map(len, served))
                if not count:
                    continue
                whole = count == sum(s.size for s in sets)
                share = fold([ready[s] for s in served], whole)
                if whole:
                    waiting.append((*values, draw, finish(key, [share]), None, None))
                else:
                    waiting.append((*values, draw, None, share.shape[1], share.ravel()))
                    held += share.nbytes
                if held > BATCH_BYTES or len(waiting) >= 10_000:
                    yield _as_batch(waiting, columns)
                    waiting, held = [], 0
        yield _as_batch(waiting, columns)

    copies = pool.positioned().select(
        F.floor(F.col("pos") / F.lit(step)).alias("block"), "pos", "vec",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    served = cut_lineage(copies.groupBy("block", "part").applyInArrow(
        serve, f"{key_schema}, draw bigint, statistic double, width bigint, share array<double>"))

    def join_shares(table: pa.Table) -> pa.Table:
        key = {name: table.column(name)[0].as_py() for name in names}
        shares = [np.asarray(v.as_py()).reshape(-1, w.as_py()) for v, w in zip(table.column("share"), table.column("width"))]
        return pa.table({**{name: [value] for name, value in key.items()}, "draw": [table.column("draw")[0].as_py()],
                         "statistic": pa.array([finish(key, shares)], pa.float64())})

    output = f"{key_schema}, draw bigint, statistic double"
    split = served.filter("share IS NOT NULL").drop("statistic").groupBy(*names, "draw").applyInArrow(join_shares, output)
    return served.filter("share IS NULL").select(*names, "draw", "statistic").unionByName(split)


def _as_batch(rows: list[tuple], columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({name: pa.array([row[i] for row in rows], kind)
                                       for i, (name, kind) in enumerate(columns.items())})


def p_threshold(scores: DataFrame, by: list[str], percentile: float, value: str = "statistic") -> DataFrame:
    """Percentile with linear interpolation per key; no key's values are gathered."""
    return exact_percentile(scores, by, value, percentile / 100.0, "threshold")
