"""Byte-pair encoding and decoding by batched NumPy merge rounds.

The words of many texts lie in one flat symbol array. A round looks up every neighbouring pair by binary search
in the sorted pair keys, finds the lowest rank of each word and merges all places of that pair; finished words
leave the array. Every token is made by one merge only, so a merge never opens a pair of lower rank and a round
may merge all places of a pair at once. Words are found by 64-bit hashes of their bytes, so each distinct word
of a block is merged once and kept for later blocks.
"""
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from tidemark.llm import blocks as tb

# Distinct words that a Python worker keeps encoded; beyond, it starts anew. It changes speed, not results.
CACHED_WORDS = 250_000
# The white space characters of Unicode.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BLANK, LETTER, NUMBER, OTHER = range(4)
# The word ends that the vocabulary's pattern cuts off at an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


def gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces pool[start:start + size], one after another."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(maxsize=1)
def characters() -> tuple[np.ndarray, np.ndarray]:
    """Class of every code point, and which ones this Python's Unicode does not know yet.

    Those few thousand characters are classed by the tokenizer library, whose Unicode is newer.
    """
    first = [unicodedata.category(chr(c)) for c in range(0x110000)]
    table = np.array([{"L": LETTER, "N": NUMBER}.get(c[0], OTHER) for c in first], np.uint8)
    newer = [c for c in regex.findall(r"\P{Cn}", "".join(chr(c) for c, k in enumerate(first) if k == "Cn"))]
    for kind, name in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        split = pre_tokenizers.Split(Regex(name), "removed")
        table[[ord(c) for c in newer if not split.pre_tokenize_str(c)]] = kind
    table[WHITE_SPACE] = BLANK
    unknown = np.zeros(0x110000, bool)
    unknown[[ord(c) for c in newer]] = True
    return table, unknown


class WordBpe:
    """A word-level BPE vocabulary file (`tokenizers` JSON format) with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        if [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"] != [PATTERN]:
            raise ValueError(f"{path} splits words by another pattern than {PATTERN}")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.classes, self.unknown = characters()
        self.library = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int64)
        self.size = 1 + max(max(vocab.values()), max(self.special.values(), default=0))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.strings = {i: s for s, i in chain(vocab.items(), self.special.items())}
        # Token strings with a space behind, as one pool.
        table = [(self.strings.get(i, "") + " ").encode() for i in range(self.size)]
        self.string_sizes = np.fromiter(map(len, table), np.int64, self.size)
        self.string_starts = np.cumsum(self.string_sizes) - self.string_sizes
        self.string_pool = np.frombuffer(b"".join(table), np.uint8)
        self.hash = tb.SpanHash(31)
        self._forget()

    def _forget(self) -> None:
        """Empty word cache but for the special tokens, which are words of one token."""
        parts = [s.encode() for s in self.special]
        flat = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.cumsum([len(p) for p in parts]).astype(np.int64)
        starts = ends - np.array([len(p) for p in parts], np.int64)
        self.known = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.tokens, self.first = np.zeros(0, np.int64), np.zeros(1, np.int64)
        ids = np.array(list(self.special.values()), np.int64)
        self._remember(self.hash.spans(self.hash.prefixes(flat), starts, ends), ids, np.arange(len(ids) + 1))

    def _remember(self, hashes: np.ndarray, ids: np.ndarray, first: np.ndarray) -> None:
        self.slots = np.concatenate([self.slots, len(self.first) - 1 + np.arange(len(hashes))])
        self.known = np.concatenate([self.known, hashes])
        order = np.argsort(self.known)
        self.known, self.slots = self.known[order], self.slots[order]
        self.first = np.concatenate([self.first, self.first[-1] + first[1:]])
        self.tokens = np.concatenate([self.tokens, ids])

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if self.unknown[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            return self.library.normalize_str(text)
        text = unicodedata.normalize("NFC", text)
        # Lower case is a mapping of single characters here; str.lower() looks at the context of a sigma.
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of the normalised texts, and start, end and text number of every word."""
        parts, sizes, marks = [], [], []
        at = 0
        for text in texts:
            size = 0
            for part in self.cut(text) if "<|" in text else (text,):
                if part in self.special:
                    marks.append((at + size, len(part)))
                else:
                    part = self.normal(part)
                parts += [part, "\n"]
                size += len(part) + 1
            sizes.append(size)
            at += size
        joined = "".join(parts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        flat = np.frombuffer(joined.encode(), np.uint8)
        kind = self.classes[points]
        begins = kind != BLANK
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        # An apostrophe that opens a run of other characters may open an ending.
        quotes = np.flatnonzero(begins & (points == ord("'")))
        padded = np.concatenate([points, np.zeros(3, np.uint32)])
        for ending in ENDINGS:
            hits = quotes[np.logical_and.reduce([padded[quotes + 1 + k] == ord(c) for k, c in enumerate(ending)])]
            for k in range(len(ending)):
                begins[hits + 1 + k] = False
            after = hits + 1 + len(ending)
            after = after[after < len(points)]
            begins[after] = kind[after] != BLANK
        for place, length in marks:
            begins[place] = True
            begins[place + 1:place + length] = False
        starts = np.flatnonzero(begins)
        # A word ends where the next begins or at the first white space.
        blank = np.flatnonzero(kind == BLANK)
        ends = np.minimum(np.append(starts[1:], len(points)), blank[np.searchsorted(blank, starts)] if len(starts) else starts)
        offsets = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
        return flat, offsets[starts], offsets[ends], np.searchsorted(np.cumsum(sizes), starts, "right")

    def merge(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words (their bytes one after another), and the n + 1 offsets."""
        ends = np.cumsum(sizes)
        symbols, owner = self.inner[raw], np.repeat(np.arange(len(sizes)), sizes)
        symbols[ends - 1] = self.last[raw[ends - 1]]
        nothing = len(self.keys)
        done_symbols, done_owners = [symbols[:0]], [owner[:0]]
        while len(symbols):
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), nothing - 1)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], nothing)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(symbols)])
            low = np.repeat(np.minimum.reduceat(np.r_[rank, nothing], starts), lengths)
            ready = low == nothing
            done_symbols.append(symbols[ready])
            done_owners.append(owner[ready])
            keep = ~ready
            places = np.flatnonzero((rank == low[:-1]) & (rank < nothing))
            if len(places):
                # In a row of touching places every second one merges, from the left.
                head = np.r_[True, np.diff(places) > 1]
                run = np.maximum.accumulate(np.where(head, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - run) % 2 == 0]
                symbols[places] = self.made[at[places]]
                keep[places + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owners)
        return symbols[np.argsort(owner, kind="stable")], tb.counted(owner, len(sizes))[1]

    def look_up(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the words in the cache; words not seen yet are merged together."""
        if len(self.known) > CACHED_WORDS:
            self._forget()
        hashes = self.hash.spans(self.hash.prefixes(flat), starts, ends)
        unique, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, unique), len(self.known) - 1)
        new = where[self.known[at] != unique]
        if len(new):
            sizes = ends[new] - starts[new]
            self._remember(hashes[new], *self.merge(gathered(flat, starts[new], sizes), sizes))
            at = np.searchsorted(self.known, unique)
        return self.slots[at][back]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bytes]]:
        """Ids and decoded UTF-8 text of every text."""
        flat, starts, ends, owner = self.words(texts)
        number = self.look_up(flat, starts, ends) if len(starts) else np.zeros(0, np.int64)
        sizes = self.first[number + 1] - self.first[number]
        ids = gathered(self.tokens, self.first[number], sizes)
        cuts = np.concatenate([[0], np.cumsum(np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64))])
        string_ends = np.concatenate([[0], np.cumsum(self.string_sizes[ids])])
        decoded = gathered(self.string_pool, self.string_starts[ids], self.string_sizes[ids]).tobytes()
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            yield ids[a:b], decoded[string_ends[a]:max(string_ends[a], string_ends[b] - 1)]

    def decode(self, ids) -> str:
        """Token strings with one space between, special tokens too; the vocabulary file names no decoder."""
        return " ".join(self.strings[int(i)] for i in ids)


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """All columns of `docs` plus n_tokens, ids (little-endian unsigned 32-bit integers) and decoded (text).

    path: vocabulary file, found at the same place on every machine. A null text counts as empty and has no
    tokens. Columns of `docs` named like an added one are replaced. Rows are never split, sampled or merged.
    """
    own = [f for f in docs.schema.fields if f.name not in ("n_tokens", "ids", "decoded")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for block in tb.blocks(batches, "text"):
            found = list(tokenizer.encode([t or "" for t in block.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([
                *block.columns, pa.array([len(i) for i, _ in found], pa.int64()),
                pa.array([i.astype("<u4").tobytes() for i, _ in found], pa.binary()),
                pa.array([d for _, d in found], pa.binary()).cast(pa.string()),
            ], names=[*block.schema.names, "n_tokens", "ids", "decoded"])

    return docs.select(*(f"`{f.name}`" for f in own)).mapInArrow(run, f"{schema}, n_tokens bigint, ids binary, decoded string")
