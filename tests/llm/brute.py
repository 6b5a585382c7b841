"""Plain versions of the operators, a document or a pair at a time."""
import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text, lower=True):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def shingle_set(text, n):
    w = words(text)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_components(docs, n, percent):
    """{doc_id: (n_shingles, component)} from all pairs that share a shingle."""
    sets = {i: shingle_set(t, n) for i, t in docs}
    owners = {}
    for i, s in sets.items():
        for x in s:
            owners.setdefault(x, []).append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    # Two sets that are similar enough share one of their rarest shingles (prefix filter), so only those are looked at.
    order = {x: (len(o), x) for x, o in owners.items()}
    index = {}
    for i in sorted(sets, key=lambda i: len(sets[i])):
        s = sets[i]
        prefix = sorted(s, key=order.get)[:len(s) - -(-percent * len(s) // 100) + 1]
        for j in {j for x in prefix for j in index.get(x, ())}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for x in prefix:
            index.setdefault(x, []).append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def repeats(docs, length):
    """{doc_id: (n_bytes, n_removed, n_spans, digest)}: bytes under a `length`-byte string that starts twice."""
    data = {i: (t or "").encode() for i, t in docs}
    seen = Counter(b[p:p + length] for b in data.values() for p in range(len(b) - length + 1))
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def quality_base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text, lower=False)
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)
