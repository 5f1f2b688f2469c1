"""A small gated recurrent network over token numbers with a class-factored softmax, in numpy.

A token of the short list is drawn as class, then word within the class; all
other tokens are one more class, whose inner probabilities come from counts
elsewhere. ``Gru.score`` runs many texts side by side as lanes, each lane
one text after the other with the state carried through the whole text.
``train`` runs truncated backpropagation over windows.
"""

from __future__ import annotations

import heapq

import numpy as np

WORDS_PER_CLASS = 32
CLASSES = 64
SHORT = WORDS_PER_CLASS * CLASSES  # short list, the end token at 0
TAIL = SHORT
HIDDEN = 16
BLOCK = 24_000  # tokens whose outputs are computed together
_NAMES = ("x", "u", "c", "cb", "w", "wb")


def fresh(counts: np.ndarray, tail: float) -> dict[str, np.ndarray]:
    """Parameters whose first predictions are the unigram shares. counts: of the short list; tail: of the rest."""
    rng = np.random.default_rng(11)
    share = np.zeros(SHORT)
    share[: len(counts)] = counts
    by_class = share.reshape(CLASSES, WORDS_PER_CLASS) + 1e-3
    classes = np.append(by_class.sum(1), tail + 1.0)
    scale = 0.3 / np.sqrt(HIDDEN)
    out = {
        "x": rng.normal(0, 0.1, (SHORT + 1, 3 * HIDDEN)), "u": rng.normal(0, scale, (HIDDEN, 3 * HIDDEN)),
        "c": rng.normal(0, 0.01, (HIDDEN, CLASSES + 1)), "cb": np.log(classes / classes.sum()),
        "w": rng.normal(0, 0.01, (CLASSES, HIDDEN, WORDS_PER_CLASS)), "wb": np.log(by_class / by_class.sum(1, keepdims=True)),
    }
    out["x"][:, :HIDDEN] += 1.0  # long memory at first
    return {k: v.astype(np.float32) for k, v in out.items()}


def packed(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in _NAMES])


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    h, c = HIDDEN, CLASSES
    shapes = ((SHORT + 1, 3 * h), (h, 3 * h), (h, c + 1), (c + 1,), (c, h, WORDS_PER_CLASS), (c, WORDS_PER_CLASS))
    out, at = {}, 0
    for name, shape in zip(_NAMES, shapes, strict=True):
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return out


class _Steps:
    """Steps of lanes that are columns, so that every part of a state is contiguous; what ``size`` steps gave is kept."""

    def __init__(self, p: dict, size: int, lanes: int):
        n, kind = HIDDEN, p["u"].dtype
        half = np.array([0.5] * 2 * n + [1.0] * n, kind)[:, None]  # a gate is (tanh(a / 2) + 1) / 2
        self.ut, self.xt = (np.multiply(p[k].T, half, order="C") for k in ("u", "x"))
        self.v, self.gates = np.empty((size, 3 * n, lanes), kind), np.empty((size, 2 * n, lanes), kind)
        self.new, self.states = np.empty((size, n, lanes), kind), np.empty((size + 1, n, lanes), kind)

    def inputs(self, before: np.ndarray) -> np.ndarray:
        return np.take(self.xt, before, axis=1)

    def advance(self, t: int, x: np.ndarray) -> None:
        """State ``t + 1`` from state ``t``."""
        n, h, v, gates, new, out = HIDDEN, self.states[t], self.v[t], self.gates[t], self.new[t], self.states[t + 1]
        np.matmul(self.ut, h, out=v)
        np.add(x[: 2 * n], v[: 2 * n], out=gates)
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        np.multiply(gates[n:], v[2 * n :], out=new)
        new += x[2 * n :]
        np.tanh(new, out=new)
        np.subtract(h, new, out=out)
        out *= gates[:n]
        out += new


def _step(p: dict, ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of lanes that are rows: the state, both gates, the new part."""
    steps = _Steps(p, 1, len(ids))
    steps.states[0] = h.T
    steps.advance(0, steps.inputs(ids))
    return steps.states[1].T, steps.gates[0].T, steps.new[0].T


def _exp(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """exp of each row less a shift, the sums, and the shift: 0, or the largest where a sum would leave the range."""
    with np.errstate(over="ignore"):
        e = np.exp(a)
    ones = np.ones(a.shape[1], a.dtype)
    total = e @ ones
    if len(a) and not (np.isfinite(total).all() and total.min() > 1e-30):
        shift = a.max(1)
        e = np.exp(a - shift[:, None])
        return e, e @ ones, shift
    return e, total, 0.0


def _picked(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Entries ``at`` of the log softmax of each row."""
    _e, total, shift = _exp(a)
    return a[np.arange(len(a)), at] - shift - np.log(total)


def _less_one_hot(a: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Softmax of each row less 1 at ``at``, times the row's weight."""
    e, total, _shift = _exp(a)
    e *= (weight / total)[:, None]
    e[np.arange(len(e)), at] -= weight
    return e


def _by_class(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the targets by class, their classes in it, and the edges of the classes."""
    cls = np.minimum(target.astype(np.int16) // WORDS_PER_CLASS, CLASSES)
    order = np.argsort(cls, kind="stable")
    cls = cls[order]
    return order, cls, np.searchsorted(cls, np.arange(CLASSES + 1))


def _with_one(h: np.ndarray) -> np.ndarray:
    """States with a column of ones, which a bias is the weight of."""
    out = np.ones((len(h), HIDDEN + 1), h.dtype)
    out[:, :HIDDEN] = h
    return out


def _weights(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the classes and of the words within each, biases as the last row."""
    return np.concatenate((p["c"], p["cb"][None])), np.concatenate((p["w"], p["wb"][:, None]), 1)


def _within(w: np.ndarray, h: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """What the words of each row's class are measured by; rows in order of classes."""
    out = np.empty((edges[-1], WORDS_PER_CLASS), h.dtype)
    for k in np.flatnonzero(np.diff(edges)):
        np.matmul(h[edges[k] : edges[k + 1]], w[k], out=out[edges[k] : edges[k + 1]])
    return out


def log_probs(p: dict, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log probability of each target: of its class, and of the word within it."""
    order, cls, edges = _by_class(target)
    h, target, (c, w) = _with_one(h[order]), target[order], _weights(p)
    out = _picked(h @ c, cls).astype(np.float64)
    near = edges[-1]
    out[:near] += _picked(_within(w, h, edges), target[:near] % WORDS_PER_CLASS)
    back = np.empty(len(out))
    back[order] = out
    return back


def _lanes(lengths: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Lane and first step of each text, longest first to the emptiest lane, and the longest lane."""
    lane, first = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    heap = [(0, i) for i in range(lanes)]
    for i in np.argsort(-lengths, kind="stable"):
        used, k = heap[0]
        lane[i], first[i] = k, used
        heapq.heapreplace(heap, (used + int(lengths[i]), k))
    return lane, first, max(u for u, _ in heap)


def score(p: dict, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Natural log probability of each text. ids: targets of all texts in order, each text's end included."""
    n = len(counts)
    total = np.zeros(n)
    if not n:
        return total
    lanes = int(np.clip(len(ids) // max(int(counts.max()), 1), 1, 1024))
    lane, first, steps = _lanes(counts, lanes)
    target = np.full((steps, lanes), -1, np.int16)
    text = np.zeros((steps, lanes), np.int32)
    start = np.zeros((steps, lanes), bool)
    begin = np.cumsum(counts) - counts
    for i in range(n):
        s = slice(first[i], first[i] + counts[i])
        target[s, lane[i]] = ids[begin[i] : begin[i] + counts[i]]
        text[s, lane[i]] = i
        start[first[i], lane[i]] = True
    block = max(1, BLOCK // lanes)
    walk, last = _Steps(p, min(block, steps), lanes), np.zeros((1, lanes), np.int16)
    walk.states[0] = 0
    for t in range(0, steps, block):
        size = min(block, steps - t)
        before = np.maximum(np.concatenate((last, target[t : t + size - 1])), 0)
        before[start[t : t + size]] = 0
        last = target[t + size - 1 : t + size]
        x = walk.inputs(before)
        opens = start[t : t + size].any(1)
        states = np.empty((size, lanes, HIDDEN), np.float32)
        for j in range(size):
            if opens[j]:
                walk.states[j][:, start[t + j]] = 0
            walk.advance(j, x[:, j])
            states[j] = walk.states[j + 1].T
        walk.states[0] = walk.states[size]
        goal = target[t : t + size].ravel()
        live = np.flatnonzero(goal >= 0)
        logs = log_probs(p, states.reshape(-1, HIDDEN)[live], goal[live])
        total += np.bincount(text[t : t + size].ravel()[live], logs, minlength=n)
    return total


def _gradient(p: dict, before: np.ndarray, target: np.ndarray, mask: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradient of one window (steps x lanes) of the mean loss, and the last state; the first state is fixed."""
    n, (steps, lanes), kind = HIDDEN, target.shape, p["u"].dtype
    walk = _Steps(p, steps, lanes)
    walk.states[0] = h.T
    x = walk.inputs(before)
    for t in range(steps):
        walk.advance(t, x[:, t])
    goal, weight = target.ravel(), (mask.ravel() / max(mask.sum(), 1)).astype(kind)
    order, cls, edges = _by_class(goal)
    goal, weight, (c, w) = goal[order], weight[order], _weights(p)
    flat = _with_one(walk.states[1:].transpose(0, 2, 1).reshape(-1, n)[order])
    d = _less_one_hot(flat @ c, cls, weight)
    gc, gw = flat.T @ d, np.zeros(w.shape, kind)
    sorted_out = d @ p["c"].T
    near = edges[-1]
    e = _less_one_hot(_within(w, flat, edges), goal[:near] % WORDS_PER_CLASS, weight[:near])
    own = np.empty((near, n), kind)
    turned, back = flat.T, p["w"].transpose(0, 2, 1)
    for k in np.flatnonzero(np.diff(edges)):
        lo, hi = edges[k], edges[k + 1]
        np.matmul(turned[:, lo:hi], e[lo:hi], out=gw[k])
        np.matmul(e[lo:hi], back[k], out=own[lo:hi])
    sorted_out[:near] += own
    out = np.empty_like(sorted_out)
    out[order] = sorted_out
    out = np.ascontiguousarray(out.reshape(steps, lanes, n).transpose(0, 2, 1))
    z, r, new, last, v = walk.gates[:, :n], walk.gates[:, n:], walk.new, walk.states[:-1], walk.v[:, 2 * n :]
    to_new, to_z, to_r = (1 - z) * (1 - new * new), (last - new) * z * (1 - z), v * r * (1 - r)
    dh, dx, dv = np.zeros((n, lanes), kind), np.empty((steps, 3 * n, lanes), kind), np.empty((steps, 3 * n, lanes), kind)
    for t in reversed(range(steps)):
        dh += out[t]
        dnew = np.multiply(dh, to_new[t], out=dx[t, 2 * n :])
        np.multiply(dh, to_z[t], out=dx[t, :n])
        np.multiply(dnew, to_r[t], out=dx[t, n : 2 * n])
        dv[t, : 2 * n] = dx[t, : 2 * n]
        np.multiply(dnew, r[t], out=dv[t, 2 * n :])
        dh *= z[t]
        dh += p["u"] @ dv[t]
    gu = np.matmul(last, dv.transpose(0, 2, 1)).sum(0)
    ids = before.ravel().astype(np.int16)
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.append(True, np.diff(ids) != 0))
    gx = np.zeros(p["x"].shape, kind)
    gx[ids[first]] = np.add.reduceat(dx.transpose(0, 2, 1).reshape(-1, 3 * n)[order], first)
    return {"x": gx, "u": gu, "c": gc[:-1], "cb": gc[-1], "w": gw[:, :-1], "wb": gw[:, -1]}, walk.states[-1].T


class Trainer:
    """Adam over windows; segments of fixed length are collected into batches of lanes."""

    def __init__(self, p: dict, rate: float, lanes: int = 128, window: int = 16):
        self.p, self.rate, self.lanes, self.window = p, rate, lanes, window
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.s = {k: np.zeros_like(v) for k, v in p.items()}
        self.turn, self.tokens = 0, 0

    def _move(self, k: str, g: np.ndarray, fix: float) -> None:
        """One step of the parameters ``k``, without further arrays than one."""
        m, s = self.m[k], self.s[k]
        step = g - m
        step *= 0.1
        m += step
        np.multiply(g, g, out=step)
        step -= s
        step *= 0.001
        s += step
        np.sqrt(s, out=step)
        step += 1e-8
        np.divide(m, step, out=step)
        step *= fix
        self.p[k] -= step

    def batch(self, before: np.ndarray, target: np.ndarray) -> None:
        """One batch, steps x lanes; a target below 0 is padding."""
        h = np.zeros((target.shape[1], HIDDEN), np.float32)
        for t in range(0, len(target), self.window):
            goal = target[t : t + self.window]
            mask = goal >= 0
            if not mask.any():
                break
            g, h = _gradient(self.p, before[t : t + self.window], np.maximum(goal, 0), mask, h)
            self.turn += 1
            fix = float(self.rate * np.sqrt(1 - 0.999**self.turn) / (1 - 0.9**self.turn))
            for k in _NAMES:
                self._move(k, g[k], fix)
        self.tokens += int((target >= 0).sum())
