"""A gated recurrent language model in NumPy: class-factored softmax, truncated backpropagation, carried state."""
from dataclasses import dataclass

import numpy as np

EMBEDDING, HIDDEN = 12, 16
WINDOW = 24                  # steps that gradients go back
STREAMS = 384                # documents that learn side by side
SEGMENT = 1_024              # tokens of a document that learn one after another; a longer one goes in several streams
RATE, CLIP = 0.01, 1.0
OPENING = 1                  # the input symbol before a document's first token: the end mark


@dataclass(frozen=True)
class Layout:
    """Sizes: inputs (symbols that are fed), classes, and the words of each head class (0 for other classes).

    A head class is a class whose words the network tells apart; inside other classes the word counts do.
    """

    n_inputs: int
    n_classes: int
    n_heads: int
    head_size: int

    def shapes(self) -> dict[str, tuple[int, ...]]:
        return {"emb": (self.n_inputs, EMBEDDING), "wx": (EMBEDDING, 3 * HIDDEN), "b": (3 * HIDDEN,), "wh": (HIDDEN, 3 * HIDDEN),
                "wc": (HIDDEN, self.n_classes), "bc": (self.n_classes,), "wu": (max(1, self.n_heads), HIDDEN, self.head_size),
                "bu": (max(1, self.n_heads), self.head_size)}

    def unpack(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes().items():
            size = int(np.prod(shape))
            out[name] = flat[at:at + size].reshape(shape)
            at += size
        return out

    def initial(self, class_mass: np.ndarray, head_mass: np.ndarray) -> np.ndarray:
        """Weights that score like the counts: random inside, biases at the logarithms of the masses.

        Classes and places without mass have a bias of minus infinity, so they never get a share, nor a gradient.
        """
        rng = np.random.default_rng(71)
        size = sum(int(np.prod(s)) for s in self.shapes().values())
        flat = np.zeros(size, np.float32)
        w = self.unpack(flat)
        w["emb"][:] = rng.normal(0, 0.3, w["emb"].shape)
        w["wx"][:] = rng.normal(0, EMBEDDING ** -0.5, w["wx"].shape)
        w["wh"][:] = rng.normal(0, 0.5 * HIDDEN ** -0.5, w["wh"].shape)
        w["wc"][:] = rng.normal(0, 0.02, w["wc"].shape)
        with np.errstate(divide="ignore"):
            w["bc"][:] = np.log(class_mass)
            w["bu"][:len(head_mass)] = np.log(head_mass)
        return flat


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def step(w: dict, table: np.ndarray, ids: np.ndarray, h: np.ndarray):
    """One time step for a batch; table: input part of the gates for every input symbol."""
    gx, gh = table[ids], h @ w["wh"]
    gates = sigmoid(gx[:, :2 * HIDDEN] + gh[:, :2 * HIDDEN])
    r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
    inner = gh[:, 2 * HIDDEN:]
    n = np.tanh(gx[:, 2 * HIDDEN:] + r * inner)
    return (1 - z) * n + z * h, r, z, n, inner


def _softmax(x: np.ndarray) -> np.ndarray:
    """In place; a row of scores becomes its probabilities."""
    x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


def _log_shares(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log probability of one place in each row of scores; overwrites them."""
    x -= x.max(1, keepdims=True)
    own = x[np.arange(len(x)), target]
    return own - np.log(np.exp(x, out=x).sum(1))


def _by_head(classes: np.ndarray, inside: np.ndarray) -> list[np.ndarray]:
    """Places of the tokens of every head class that occurs."""
    heads = np.flatnonzero(inside >= 0)
    heads = heads[np.argsort(classes[heads], kind="stable")]
    return np.split(heads, np.flatnonzero(np.diff(classes[heads])) + 1) if len(heads) else []


def log_likelihood(layout: Layout, flat: np.ndarray, inputs: np.ndarray, classes: np.ndarray, inside: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log likelihood of whole documents, the words inside head classes included.

    inputs, classes, inside: for all tokens of the documents, one after another, the input symbol, the class and the
    place in a head class (-1: counts decide). Every document opens after an end mark. Documents go
    side by side, longest first, and the state is carried from window to window until each ends.
    """
    w = layout.unpack(flat)
    table = (w["emb"] @ w["wx"] + w["b"]).astype(np.float32)
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    length = sizes[order]
    total = np.zeros(len(sizes))
    h = np.zeros((len(sizes), HIDDEN), np.float32)
    for t0 in range(0, int(length[0]) if len(length) else 0, WINDOW):
        live = int(np.searchsorted(-length, -t0, "left"))
        h = h[:live]
        states, rows, places = [], [], []
        for t in range(t0, min(t0 + WINDOW, int(length[0]))):
            live = int(np.searchsorted(-length, -t, "left"))
            at = first[:live] + t
            # Before its first token a document has read nothing but its opening mark.
            ids = inputs[at - 1] if t else np.full(live, OPENING)
            h = step(w, table, ids, h[:live])[0]
            states.append(h)
            rows.append(np.arange(live))
            places.append(at)
        hidden, row, place = np.concatenate(states), np.concatenate(rows), np.concatenate(places)
        found = np.empty(len(row))
        for a in range(0, len(row), 4_096):
            part = slice(a, a + 4_096)
            scores = hidden[part] @ w["wc"]
            scores += w["bc"]
            found[part] = _log_shares(scores, classes[place[part]])
        own, where = classes[place], inside[place]
        for mine in _by_head(own, where):
            k = own[mine[0]]
            found[mine] += _log_shares(hidden[mine] @ w["wu"][k] + w["bu"][k], where[mine])
        total[:len(states[0])] += np.bincount(row, weights=found, minlength=len(states[0]))
    out = np.empty(len(sizes))
    out[order] = total
    return out


def gradients(w: dict, ids: np.ndarray, classes: np.ndarray, inside: np.ndarray, live: np.ndarray, h0: np.ndarray):
    """Loss gradients of one window [time, document] and the state behind it; `live` marks real tokens."""
    steps, n = ids.shape
    table = w["emb"] @ w["wx"] + w["b"]
    h, kept = h0, []
    for t in range(steps):
        before = h
        h, r, z, c, inner = step(w, table, ids[t], before)
        if not live[t].all():
            h = np.where(live[t][:, None], h, before)
        kept.append((before, r, z, c, inner))
    hidden = np.stack([k[0] for k in kept[1:]] + [h]).reshape(-1, HIDDEN)
    mask, target, place = live.ravel(), classes.ravel(), inside.ravel()
    count = max(1, mask.sum())
    g = {k: np.zeros_like(v) for k, v in w.items()}
    back = np.empty_like(hidden)
    scale = (mask / count).astype(hidden.dtype)
    for a in range(0, len(hidden), 2_048):
        part = slice(a, a + 2_048)
        p = hidden[part] @ w["wc"]
        p += w["bc"]
        p = _softmax(p)
        p[np.arange(len(p)), target[part]] -= 1
        p *= scale[part, None]
        g["wc"] += hidden[part].T @ p
        g["bc"] += p.sum(0)
        back[part] = p @ w["wc"].T
    for mine in _by_head(target, np.where(mask, place, -1)):
        k = target[mine[0]]
        q = _softmax(hidden[mine] @ w["wu"][k] + w["bu"][k])
        q[np.arange(len(q)), place[mine]] -= 1
        q /= count
        g["wu"][k], g["bu"][k] = hidden[mine].T @ q, q.sum(0)
        back[mine] += q @ w["wu"][k].T
    back = back.reshape(steps, n, HIDDEN)
    later = np.zeros((n, HIDDEN), np.float32)
    befores = np.stack([k[0] for k in kept])
    dgx = np.empty((steps, n, 3 * HIDDEN), back.dtype)
    inners = np.empty((steps, n, HIDDEN), back.dtype)
    whole = live.all(1)
    for t in reversed(range(steps)):
        before, r, z, c, inner = kept[t]
        dh = back[t] + later
        passed = 0
        if not whole[t]:
            on = live[t][:, None]
            passed = np.where(on, 0, dh)
            dh = np.where(on, dh, 0)
        here = dgx[t]
        dn = dh * (1 - z) * (1 - c * c)
        here[:, :HIDDEN] = dn * inner * r * (1 - r)
        here[:, HIDDEN:2 * HIDDEN] = dh * (before - c) * z * (1 - z)
        here[:, 2 * HIDDEN:] = dn
        np.multiply(dn, r, out=inners[t])
        later = here[:, :2 * HIDDEN] @ w["wh"][:, :2 * HIDDEN].T + inners[t] @ w["wh"][:, 2 * HIDDEN:].T + dh * z + passed
    # All steps' weight gradients at once.
    befores, dgx, inners = befores.reshape(-1, HIDDEN), dgx.reshape(-1, 3 * HIDDEN), inners.reshape(-1, HIDDEN)
    g["wh"][:, :2 * HIDDEN], g["wh"][:, 2 * HIDDEN:] = befores.T @ dgx[:, :2 * HIDDEN], befores.T @ inners
    order = np.argsort(ids, axis=None, kind="stable")
    symbols = ids.ravel()[order]
    first = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
    table_grad = np.add.reduceat(dgx[order], first, axis=0)
    fed = w["emb"][symbols[first]]
    g["wx"], g["b"] = fed.T @ table_grad, table_grad.sum(0)
    g["emb"][symbols[first]] = table_grad @ w["wx"].T
    return g, h


def learn(layout: Layout, flat: np.ndarray, documents: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weights after one pass over whole documents (inputs, classes, inside) by Adam, from given weights.

    STREAMS segments of like length go side by side; each window starts from the state the one before left behind, and
    segments leave as they end. A document's further segments begin with the token before them.
    """
    flat = flat.copy()
    w = layout.unpack(flat)
    first, second, rounds = np.zeros_like(flat), np.zeros_like(flat), 0
    parts = []
    for i, c, p in documents:
        fed = np.concatenate([[OPENING], i[:-1]])
        parts += [(fed[a:a + SEGMENT], c[a:a + SEGMENT], p[a:a + SEGMENT]) for a in range(0, len(c), SEGMENT)]
    parts.sort(key=lambda d: -len(d[0]))
    groups = [parts[a:a + STREAMS] for a in range(0, len(parts), STREAMS)]
    for number in np.random.default_rng(72).permutation(len(groups)):
        group = groups[number]
        sizes = np.array([len(d[0]) for d in group])
        ids, classes, inside = (np.zeros((sizes[0], len(group)), np.int64) for _ in range(3))
        for k, (i, c, p) in enumerate(group):
            ids[:len(i), k], classes[:len(i), k], inside[:len(i), k] = i, c, p
        h = np.zeros((len(group), HIDDEN), np.float32)
        for t in range(0, int(sizes[0]), WINDOW):
            n = int(np.searchsorted(-sizes, -t, "left"))
            part = slice(t, t + WINDOW), slice(0, n)
            live = np.arange(t, t + len(ids[part]))[:, None] < sizes[:n]
            g, h = gradients(w, ids[part], classes[part], inside[part], live, h[:n])
            grad = np.concatenate([g[k].ravel() for k in layout.shapes()]).astype(np.float32)
            grad *= min(1.0, CLIP / max(1e-9, float(np.sqrt((grad * grad).sum()))))
            rounds += 1
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            flat -= RATE * (first / (1 - 0.9 ** rounds)) / (np.sqrt(second / (1 - 0.99 ** rounds)) + 1e-6)
    return flat
