"""Chat formatting: a finite-state machine over roles and a declarative template.

The template names the control strings, the role transitions and the roles that are trained on. Formatting emits
text segments with a loss flag each; joined, they are the formatted conversation. Control strings inside a text
are escaped reversibly (a backslash goes between `<` and `|`), so a reader finds exactly the turns that were
written.
"""
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SEGMENTS = "array<struct<text:string,loss:boolean>>"


@dataclass(frozen=True)
class Template:
    """Control strings and the machine: state -> {role: next state}; a conversation may end in `final` states."""

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>"
    after_turn: str = "\n"
    trained: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })
    final: frozenset[str] = frozenset({"answered"})


CHATML = Template()


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """A role stands on a line of its own, so its line feeds are escaped too."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: list[tuple[str, str]], template: Template) -> tuple[list[tuple[str, bool]], str | None]:
    """Segments of the turns (role, text), and what is wrong with their order (None: nothing).

    Every turn is written, also where the order is wrong.
    """
    state, wrong, out = template.start, None, []
    for number, (role, text) in enumerate(turns):
        if wrong is None:
            following = template.moves.get(state, {}).get(role)
            if following is None:
                wrong = f"turn {number}: {role!r} after state {state!r}"
            else:
                state = following
        out += [(template.open + escape_role(role) + template.after_role, False), (escape(text), role in template.trained),
                (template.close + template.after_turn, False)]
    if wrong is None and state not in template.final:
        wrong = f"ends in state {state!r}"
    return out, wrong


def read_turns(formatted: str, template: Template) -> list[tuple[str, str]]:
    """Turns of a formatted conversation; what `format_turns` wrote comes back unchanged."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(template.open, at):
            raise ValueError(f"no turn begins at {at}")
        line = formatted.index(template.after_role, at)
        end = formatted.index(template.close, line)
        turns.append((unescape_role(formatted[at + len(template.open):line]), unescape(formatted[line + len(template.after_role):end])))
        at = end + len(template.close) + len(template.after_turn)
    return turns


def format_conversations(rows: DataFrame, template: Template = CHATML) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, segments, formatted, valid, violation), a row for each conversation.

    Turns are ordered by turn (nulls first), then role and text; equal rows are separate turns. A null role or
    text is empty. Rows without conv_id make one conversation with a null id. A conversation that breaks the
    turn order is formatted all the same and marked. A conversation is one output value and so must fit in a task.
    """
    turns = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")) \
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")) \
        .select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                made = [format_turns(list(zip(r, t)), template) for r, t in zip(part.column("roles").to_pylist(), part.column("texts").to_pylist())]
                yield pa.RecordBatch.from_arrays([
                    part.column("conv_id"), pa.array([[{"text": t, "loss": l} for t, l in s] for s, _ in made], kind),
                    pa.array(["".join(t for t, _ in s) for s, _ in made], pa.string()),
                    pa.array([w is None for _, w in made], pa.bool_()), pa.array([w for _, w in made], pa.string()),
                ], names=["conv_id", "segments", "formatted", "valid", "violation"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return turns.mapInArrow(run, f"conv_id {kind}, segments {SEGMENTS}, formatted string, valid boolean, violation string")


def read_conversations(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """Columns of `format_conversations` plus turns (array of role and text) read back from `formatted`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                turns = [[{"role": r, "text": t} for r, t in read_turns(f, template)] for f in part.column("formatted").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(turns, kind)], names=[*part.schema.names, "turns"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in formatted.schema)
    return formatted.mapInArrow(run, f"{schema}, turns array<struct<role:string,text:string>>")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")
