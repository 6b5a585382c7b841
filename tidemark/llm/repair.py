"""Repair of conversation structure by a Viterbi search whose survivors coalesce.

The turns of a conversation are read in order; four states say what has been put out so far (nothing, a system turn,
a user turn, an assistant turn). Every state keeps its cheapest edits so far, of equal ones the ASCII-least. The
survivors are the leaves of a tree of backpointers: a node holds the edits between two forks and goes as soon as one
reference to it is left, and so do survivors that another one beats whatever follows; once all share an ancestor, the edits above it are final and leave the tree. Equal
costs are settled by the complete edits that are not final yet, up to the fork of the two.

A conversation may be larger than a task. Turns are dealt out by ranges of their order; where a range border cuts a
conversation, each piece is searched from all four states first, and the 4 x 4 costs and ranks of the pieces, at most
two pieces of other conversations for each range, tell in which state each piece begins and ends.
"""
import hashlib
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.scratch import Scratch

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)                 # state after one more user or assistant turn
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEPT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
CLOSING = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}    # what a conversation still lacks at its end
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SOUND, CUT, GONE = range(3)                          # a turn as it should be, truncated, or to be deleted
# What it costs at most to do from the row's state whatever may follow in the column's state: a missing turn is inserted,
# a system turn deleted that only a beginning can keep. A survivor dearer than that by any other is hopeless.
DETOUR = ((0, 0, 3, 0), (6, 0, 3, 6), (7, 3, 0, 3), (4, 0, 3, 0))
PART_BYTES = 1 << 20                                 # repaired text goes out in parts of about this size
WHITE = " \t\n\x0b\x0c\r"


def _moves(initial: str, fault: int) -> list[list[tuple[int, int, bytes]]]:
    """For each state the states a turn of that kind can lead to: (state, cost, edits), each in the best way.

    Turns are inserted before kept or changed ones only: "DI" costs what "ID" does and comes before it.
    """
    out = []
    for start in range(4):
        best = {start: (DELETE, b"D")}
        state, inserted = start, b""
        for _ in range(3 if fault != GONE else 0):
            cost = INSERT * len(inserted) + (TRUNCATED if fault == CUT else 0)
            ways = [(NEXT[state], cost + REROLE, inserted + b"R")]
            if state in KEPT.get(initial, ()):
                ways.append((KEPT[initial][state], cost, inserted + b"K"))
            for to, *way in ways:
                best[to] = min(best.get(to, tuple(way)), tuple(way))
            state, inserted = NEXT[state], inserted + b"I"
        out.append([(to, cost, edits) for to, (cost, edits) in sorted(best.items())])
    return out


MOVES = {(i, fault): _moves(i, fault) for i in ("s", "u", "a", "") for fault in (SOUND, CUT, GONE)}


class Node:
    """Edits between two forks. `kids` are the references to it; a node without kids is a survivor."""

    __slots__ = ("parent", "edits", "kids")

    def __init__(self, parent: "Node | None", edits: bytes):
        self.parent, self.edits, self.kids = parent, bytearray(edits), []


def _before(a: Node, more_a: bytes, b: Node, more_b: bytes) -> bool:
    """Whether the edits of survivor a, and then more_a, are ASCII-less than those of b; compared from their fork on."""
    above, node = {}, a
    while node:
        above[id(node)] = len(above)
        node = node.parent
    right, node = [more_b], b
    while id(node) not in above:
        right.append(node.edits)
        node = node.parent
    left, fork, node = [more_a], node, a
    while node is not fork:
        left.append(node.edits)
        node = node.parent
    return b"".join(reversed(left)) < b"".join(reversed(right))


class Search:
    """Survivors of one piece of a conversation from a given state on; `final` gathers the edits that are settled."""

    def __init__(self, state: int = NOTHING):
        self.root = Node(None, b"")
        self.survivors = {state: (0, self.root)}
        self.final = bytearray()

    def step(self, initial: str, fault: int) -> None:
        moves, best = MOVES[initial if initial in KEPT else "", fault], {}
        for state, (cost, node) in self.survivors.items():
            for to, extra, edits in moves[state]:
                held = best.get(to)
                if held is None or cost + extra < held[0] or cost + extra == held[0] and _before(node, edits, held[1], held[2]):
                    best[to] = (cost + extra, node, edits)
        costs = [(state, held[0]) for state, held in best.items()]
        best = {to: held for to, held in best.items() if all(held[0] <= cost + DETOUR[state][to] for state, cost in costs)}
        heirs: dict[int, int] = {}
        for _, node, _ in best.values():
            heirs[id(node)] = heirs.get(id(node), 0) + 1
        grown = {}
        for to, (cost, node, edits) in best.items():
            if heirs[id(node)] == 1:
                node.edits += edits
                grown[to] = (cost, node)
            else:
                child = Node(node, edits)
                node.kids.append(child)
                grown[to] = (cost, child)
        for _, node in self.survivors.values():
            if id(node) not in heirs:
                self._release(node)
        self.survivors = grown
        self._settle()

    def _release(self, node: Node) -> None:
        parent = node.parent
        parent.kids.remove(node)
        if len(parent.kids) == 1 and parent.parent:
            only = parent.kids[0]
            only.edits[:0] = parent.edits
            only.parent = parent.parent
            parent.parent.kids[parent.parent.kids.index(parent)] = only

    def _settle(self) -> None:
        while len(self.root.kids) == 1:
            self.final += self.root.edits
            self.root = self.root.kids[0]
            self.root.parent = None
        self.final += self.root.edits
        self.root.edits.clear()

    def ranked(self) -> list[tuple[int, int]]:
        """(state, cost) of all survivors, those with ASCII-least edits first."""
        order: list[tuple[int, int, Node]] = []
        for state, (cost, node) in self.survivors.items():
            at = next((k for k, (_, _, other) in enumerate(order) if _before(node, b"", other, b"")), len(order))
            order.insert(at, (state, cost, node))
        return [(state, cost) for state, cost, _ in order]

    def close(self, state: int | None) -> int:
        """Settle everything: the survivor of `state`, or the best one at the end of a conversation. Returns its cost."""
        if state is None:
            ranked = [(cost + INSERT * len(CLOSING[s]), k, s) for k, (s, cost) in enumerate(self.ranked())]
            cost, _, state = min(ranked)
            tail = CLOSING[state].encode()
        else:
            cost, tail = self.survivors[state][0], b""
        path, node = [tail], self.survivors[state][1]
        while node:
            path.append(node.edits)
            node = node.parent
        self.final += b"".join(reversed(path))
        return cost


def ways_through(pieces: list[list[list[tuple[int, int]]]]) -> list[tuple[int, int | None]]:
    """First and last state of every piece on the best way through a conversation cut into pieces.

    pieces: for each piece and each state it may begin in, (state, cost) of the survivors at its end, ASCII-least first.
    Edits that end with the same turn are never the beginning of one another, so ranks compare whole edits.
    """
    costs, ranks, back = {NOTHING: 0}, {NOTHING: 0}, []
    for piece in pieces:
        best: dict[int, tuple] = {}
        for first, cost in costs.items():
            for k, (last, extra) in enumerate(piece[first]):
                best[last] = min(best.get(last, (cost + extra, ranks[first], k, first)), (cost + extra, ranks[first], k, first))
        order = sorted(best, key=lambda s: best[s][1:3])
        costs, ranks = {s: best[s][0] for s in best}, {s: k for k, s in enumerate(order)}
        back.append({s: best[s][3] for s in best})
    last = min(costs, key=lambda s: (costs[s] + INSERT * len(CLOSING[s]), ranks[s]))
    out: list[tuple[int, int | None]] = []
    end: int | None = None
    for step in reversed(back):
        out.append((step[last], end))
        last = end = step[last]
    return out[::-1]


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Turns of one piece of one conversation after another, read as they come: ((piece, conversation), turns)."""
    def rows():
        for batch in batches:
            for block in (batch.slice(k, 1000) for k in range(0, batch.num_rows, 1000)):
                yield from zip(*(c.to_pylist() for c in block.columns))

    stream = rows()
    row = next(stream, None)
    while row is not None:
        key = row[:2]

        def own():
            nonlocal row
            while row is not None and row[:2] == key:
                yield row[2:]
                row = next(stream, None)

        turns = own()
        yield key, turns
        for _ in turns:
            pass


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, piece, last initial, states, costs) of every piece, from each state."""
    for (piece, conv), turns in _groups(batches):
        searches, last = [Search(k) for k in range(4)], ""
        for role, _, fault, copies in turns:
            last = role[:1]
            for search in searches:
                search.step(last, fault)
                for _ in range(copies - 1):
                    search.step(last, GONE)
                search.final.clear()
        ranked = [s.ranked() for s in searches]
        yield conv, piece, last, [[s for s, _ in r] for r in ranked], [[c for _, c in r] for r in ranked]


def _written(batches: Iterator[pa.RecordBatch], plan: dict) -> Iterator[tuple]:
    """Repaired text and edits of every piece, in parts: (conversation, piece, part, whole, illegal, cost, audit, repaired)."""
    for (piece, conv), turns in _groups(batches):
        first, last, before = plan.get((piece, conv), (NOTHING, None, ""))
        search, state, part, illegal = Search(first), first, 0, 0
        waiting: deque[tuple[str, str]] = deque()
        audit, lines, size, opening = [], [], 0, first == NOTHING
        whole = (piece, conv) not in plan

        def put_out():
            nonlocal state, size
            for edit in search.final.decode():
                audit.append(edit)
                role, text = waiting.popleft() if edit != "I" else ("", "")
                if edit == "D":
                    continue
                state = KEPT[role[:1]][state] if edit == "K" else NEXT[state]
                lines.append(f"{role if edit == 'K' else ROLE[state]}:{text}")
                size += len(lines[-1])
            search.final.clear()

        def flush(whole: bool, cost: int):
            nonlocal size, part, opening, illegal
            body = ("" if opening or not lines else "\n") + "\n".join(lines)
            row = (conv, piece, part, whole, illegal, cost, "".join(audit), body)
            opening, part, size, illegal = opening and not lines, part + 1, 0, 0
            audit.clear()
            lines.clear()
            return row

        for role, text, fault, copies in turns:
            for k in range(copies):
                illegal += bool(before) and before + role[:1] not in ("su", "ua", "au")
                before = role[:1] or "?"
                waiting.append((role, "" if fault == GONE or k else text))
                search.step(role[:1], GONE if k else fault)
            if search.final:
                put_out()
            if size + len(audit) > PART_BYTES:
                whole = False
                yield flush(False, 0)
        cost = search.close(last)
        put_out()
        yield flush(whole, cost)


def _arrow(rows: Iterable[tuple], schema: pa.Schema, limit: int = 4 * PART_BYTES) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, str))
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Parts of conversations in order -> one row each; the text passes through the digest and is never held."""
    for (_, conv), parts in _groups(batches):
        digest, audit, illegal, cost = hashlib.sha256(), [], 0, 0
        for wrong, price, edits, text in parts:
            digest.update(text.encode())
            audit.append(edits)
            illegal, cost = illegal + wrong, cost + price
        yield conv, illegal, cost, "".join(audit), digest.hexdigest()


def _place() -> Column:
    return F.struct(F.col("turn").isNotNull().alias("known"), "turn")


def marked(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, text) -> the same with `copies` and `kind`: the first fault, or null.

    Turns equal in all four fold into one row; `kind` is that of the first of them, the others are duplicates unless
    blank. Contents that stand at several places of a conversation are found by their digests alone.
    """
    ink = F.translate("text", WHITE, "") != ""
    ends = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1).isin(".", "!", "?")
    folded = turns.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn(
        "content", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    seen = folded.where(ink).groupBy(F.col("conv").alias("c"), F.col("content").alias("d")).agg(
        F.min(_place()).alias("first"), F.count("*").alias("places")).where("places > 1")
    joined = folded.join(seen, folded["conv"].eqNullSafe(seen["c"]) & (folded["content"] == seen["d"]), "left")
    again = F.coalesce(_place() > F.col("first"), F.lit(False))
    return joined.select("conv", "turn", "role", "text", "copies", F.when(~ink, "blank").when(again, "duplicate").when(~ends, "truncated").alias("kind"))


def _pieces(scratch: Scratch, turns: DataFrame) -> DataFrame:
    """Turns in the order of conversations, written with the number of the range each lies in."""
    order = ["conv", F.col("turn").asc_nulls_first(), "role"]
    # Long texts must not become range bounds: equal beginnings lie in one range.
    ranged = turns.repartitionByRange(*order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text")
    return scratch.keep("pieces", ranged.withColumn("piece", F.spark_partition_id()))


def _in_order(pieces: DataFrame) -> DataFrame:
    fault = F.when(F.col("kind").isin("blank", "duplicate"), GONE).when(F.col("kind") == "truncated", CUT).otherwise(SOUND)
    return pieces.repartition("piece").sortWithinPartitions("piece", "conv", F.col("turn").asc_nulls_first(), "role", "text").select(
        "piece", "conv", "role", "text", fault.alias("fault"), "copies")


def _plan(pieces: DataFrame) -> dict:
    """{(piece, conversation): (first state, last state, initial before it)} of conversations that lie in several ranges."""
    spans = pieces.groupBy("conv").agg(F.min("piece").alias("low"), F.max("piece").alias("high")).where("low < high")
    cut = pieces.join(F.broadcast(spans.withColumnRenamed("conv", "c")), F.col("conv").eqNullSafe(F.col("c")), "left_semi")
    kind = pieces.schema["conv"].dataType.simpleString()
    schema = pa.schema([("conv", _arrow_type(pieces)), ("piece", pa.int32()), ("last", pa.string()),
                        ("states", pa.list_(pa.list_(pa.int32()))), ("costs", pa.list_(pa.list_(pa.int64())))])
    found: dict = {}
    for row in _in_order(cut).mapInArrow(lambda b: _arrow(_survivors(b), schema),
                                         f"conv {kind}, piece int, last string, states array<array<int>>, costs array<array<bigint>>").collect():
        found.setdefault(row["conv"], []).append((row["piece"], row["last"], [list(zip(*x)) for x in zip(row["states"], row["costs"])]))
    plan = {}
    for conv, rows in found.items():
        rows.sort(key=lambda r: r[0])
        before = ""
        for (piece, last, _), (first, end) in zip(rows, ways_through([r[2] for r in rows])):
            plan[piece, conv] = (first, end, before)
            before = last or "?"
    return plan


def _arrow_type(df: DataFrame) -> pa.DataType:
    return to_arrow_type(df.schema["conv"].dataType)


def repaired(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> parts (conv, piece, part, whole, illegal, cost, audit, repaired) of every conversation.

    Turns go by `turn` (nulls first), then role and text; a null role or text is one space, a null conv_id a conversation.
    audit: an initial for each edit (keep, rerole, delete, insert); repaired: lines `role:text` that put together in the
    order of (piece, part) are the whole text. `whole` marks the only part of a conversation, which nearly all have;
    longer ones come in parts of about PART_BYTES. An empty table gives no parts.
    """
    scratch = Scratch(turns.sparkSession)
    return _repaired(scratch, _pieces(scratch, marked(_named(turns))))


def _named(turns: DataFrame) -> DataFrame:
    return turns.select(F.col("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
                        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def _repaired(scratch: Scratch, pieces: DataFrame) -> DataFrame:
    plan, kind = _plan(pieces), pieces.schema["conv"].dataType.simpleString()
    schema = pa.schema([("conv", _arrow_type(pieces)), ("piece", pa.int32()), ("part", pa.int64()), ("whole", pa.bool_()),
                        ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired", pa.string())])
    return scratch.keep("parts", _in_order(pieces).mapInArrow(
        lambda b: _arrow(_written(b, plan), schema),
        f"conv {kind}, piece int, part bigint, whole boolean, illegal bigint, cost bigint, audit string, repaired string"))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with the faults that crc32 of `conv_id:turn`, modulo 20, deals out: 0 drops a turn, 1 empties its text,
    2 takes its end marks, 3 repeats it, 4 makes it the user's. Nulls count as one space, in that key too."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    dealt = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("dealt")).where("dealt <> 0")
    return dealt.select(
        "conv_id", "turn", F.when(F.col("dealt") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("dealt") == 1, "").when(F.col("dealt") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("dealt") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def repair(turns: DataFrame, everyone: DataFrame | None = None) -> DataFrame:
    """One row for every conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    everyone: a frame with the conv_id of conversations that have a row even if no turn of them is in `turns`; such a
    row has zeros, an empty audit and the digest of nothing. Edge cases as in `repaired`.
    """
    scratch = Scratch(turns.sparkSession)
    pieces = _pieces(scratch, marked(_named(turns)))
    parts = _repaired(scratch, pieces)
    kind = pieces.schema["conv"].dataType.simpleString()
    schema = pa.schema([("conv", _arrow_type(pieces)), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("digest", pa.string())])
    long = parts.where("not whole").repartition("conv").sortWithinPartitions("conv", "piece", "part").select(
        F.lit(0).alias("all"), "conv", "illegal", "cost", "audit", "repaired").mapInArrow(
        lambda b: _arrow(_hashed(b), schema), f"conv {kind}, illegal bigint, cost bigint, audit string, digest string")
    edits = parts.where("whole").select("conv", "illegal", "cost", "audit", F.sha2("repaired", 256).alias("digest")).unionByName(long)
    kinds = {"blank": F.when(F.col("kind") == "blank", F.col("copies")),
             "duplicate": F.when(F.col("kind") == "duplicate", F.col("copies")).when(F.col("kind") == "blank", 0).otherwise(F.col("copies") - 1),
             "truncated": F.when(F.col("kind") == "truncated", 1)}
    counts = pieces.groupBy("conv", "turn").agg(*(F.sum(c).alias(k) for k, c in kinds.items()))
    wide = "decimal(20,0)"
    gaps = F.max("turn").cast(wide) - F.min("turn").cast(wide) + 1 - F.count("turn").cast(wide)
    counts = counts.groupBy("conv").agg(F.coalesce(gaps, F.lit(0)).cast("bigint").alias("gaps"), *(F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated")))
    rows = counts.unionByName(edits, allowMissingColumns=True)
    if everyone is not None:
        rows = rows.unionByName(everyone.select(F.col("conv_id").alias("conv")).distinct(), allowMissingColumns=True)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return rows.groupBy("conv").agg(
        *(F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias(c) for c in numbers), F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("repaired_sha256")).withColumnRenamed("conv", "conv_id")
