"""Character-level bidirectional LSTM with a conditional random field on top, in numpy.

A character is a row of weights plus one of its kind (digit, lower, upper, blank, mark, other).
All windows have ``WINDOW`` characters, short ones are filled with 0. Tags are outside, and begin
and inside of each kind of span. Training is Adam on the log-likelihood, with gradients through
the field's forward-backward sums and both LSTM directions; it is deterministic by its seed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW, HIDDEN, LETTERS = 96, 24, 128
_F = np.float32


def _kinds() -> np.ndarray:
    codes = np.arange(LETTERS)
    out = np.full(LETTERS, 4)
    for kind, (lo, hi) in enumerate(((48, 57), (97, 122), (65, 90))):
        out[(codes >= lo) & (codes <= hi)] = kind
    out[[9, 10, 13, 32]] = 3
    out[[0, 1]] = 5
    return out


#: Kind of each letter code; 0 fills windows, 1 stands for all characters beyond ASCII.
KINDS = _kinds()


def codes(text: str) -> np.ndarray:
    """Letter codes of the characters of ``text``."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < LETTERS, np.maximum(points, 1), 1).astype(np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return _F(0.5) * (np.tanh(_F(0.5) * x) + _F(1))


@dataclass
class Tagger:
    """Weights by name; ``tags`` of them come out."""

    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, tags: int, seed: int = 0, hidden: int = HIDDEN) -> Tagger:
        rng = np.random.default_rng(seed)
        near = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0] if len(shape) > 1 else 1)).astype(_F)
        out = {}
        for side in "fb":
            out[f"letter_{side}"], out[f"kind_{side}"] = near(LETTERS, 4 * hidden) * _F(2), near(int(KINDS.max()) + 1, 4 * hidden)
            out[f"kind_{side}"][:, hidden : 2 * hidden] += 1  # the forget gate starts open
            out[f"loop_{side}"] = near(hidden, 4 * hidden)
        out |= {"out": near(2 * hidden, tags), "base": np.zeros(tags, _F), "moves": np.zeros((tags, tags), _F), "start": np.zeros(tags, _F)}
        return cls(out)

    def _run(self, side: str, letters: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states by (time, window) in reading order of ``side``, and what backpropagation needs."""
        w = self.weights
        table, loop = w[f"letter_{side}"] + w[f"kind_{side}"][KINDS], w[f"loop_{side}"]
        n, size, hidden = letters.shape[1], letters.shape[0], loop.shape[0]
        h, c, kept = np.zeros((n, hidden), _F), np.zeros((n, hidden), _F), []
        out = np.empty((size, n, hidden), _F)
        for t in range(size) if side == "f" else range(size - 1, -1, -1):
            z = table[letters[t]] + h @ loop
            gates, new = _sigmoid(z[:, : 3 * hidden]), np.tanh(z[:, 3 * hidden :])
            i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
            before_h, before_c = h, c
            c = f * c + i * new
            bent = np.tanh(c)
            h = o * bent
            out[t] = h
            if keep:
                kept.append((t, i, f, o, new, bent, before_h, before_c))
        return out, kept

    def emissions(self, letters: np.ndarray) -> np.ndarray:
        """Scores by (time, window, tag); ``letters`` are (time, window)."""
        both = np.concatenate([self._run(s, letters, False)[0] for s in "fb"], axis=2)
        return both @ self.weights["out"] + self.weights["base"]

    def chances(self, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Tag marginals by (time, window, tag), expected moves, and the sum of log partition values."""
        size, n, tags = emit.shape
        top = emit.max(axis=2, keepdims=True)
        odds, move = np.exp(emit - top), np.exp(self.weights["moves"])
        ahead, back = np.empty_like(odds), np.empty_like(odds)
        scale = np.empty((size, n, 1), _F)
        a = odds[0] * np.exp(self.weights["start"])
        for t in range(size):
            if t:
                a = (ahead[t - 1] @ move) * odds[t]
            scale[t] = a.sum(axis=1, keepdims=True)
            ahead[t] = a / scale[t]
        back[-1] = 1
        for t in range(size - 2, -1, -1):
            back[t] = ((back[t + 1] * odds[t + 1]) @ move.T) / scale[t + 1]
        right = (back[1:] * odds[1:] / scale[1:]).reshape(-1, tags)
        moves = (ahead[:-1].reshape(-1, tags).T @ right) * move
        return ahead * back, moves, float(np.log(scale).sum(dtype=np.float64) + top.sum(dtype=np.float64))

    def slope(self, letters: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of ``gold`` tags by window, and its gradients."""
        w, size, n = self.weights, *letters.shape
        runs = {s: self._run(s, letters, True) for s in "fb"}
        both = np.concatenate([runs[s][0] for s in "fb"], axis=2)
        emit = both @ w["out"] + w["base"]
        chance, moves, total = self.chances(emit)
        at = np.arange(size)[:, None], np.arange(n)
        score = emit[(*at, gold)].sum(dtype=np.float64) + w["moves"][gold[:-1], gold[1:]].sum(dtype=np.float64) + w["start"][gold[0]].sum(dtype=np.float64)
        tags = len(w["base"])
        seen = np.bincount(gold[:-1].ravel() * tags + gold[1:].ravel(), minlength=tags * tags).reshape(tags, tags)
        first = np.bincount(gold[0], minlength=tags)
        out = {"moves": (moves - seen) / n, "start": (chance[0].sum(axis=0) - first) / n}
        up = chance.copy()
        up[(*at, gold)] -= 1
        up /= n
        out["out"] = both.reshape(-1, both.shape[2]).T @ up.reshape(-1, tags)
        out["base"] = up.sum(axis=(0, 1))
        down = up @ w["out"].T
        hidden = both.shape[2] // 2
        for k, side in enumerate("fb"):
            loop, into = w[f"loop_{side}"], down[:, :, k * hidden : (k + 1) * hidden]
            dz = np.empty((size, n, 4 * hidden), _F)
            d_loop, dh, dc = np.zeros_like(loop), np.zeros((n, hidden), _F), np.zeros((n, hidden), _F)
            for t, i, f, o, new, bent, before_h, before_c in reversed(runs[side][1]):
                dh = dh + into[t]
                dc = dc + dh * o * (1 - bent * bent)
                z = dz[t]
                z[:, :hidden] = dc * new * i * (1 - i)
                z[:, hidden : 2 * hidden] = dc * before_c * f * (1 - f)
                z[:, 2 * hidden : 3 * hidden] = dh * bent * o * (1 - o)
                z[:, 3 * hidden :] = dc * i * (1 - new * new)
                d_loop += before_h.T @ z
                dh, dc = z @ loop.T, dc * f
            flat = dz.reshape(-1, 4 * hidden)
            hot = np.zeros((size * n, LETTERS), _F)
            hot[np.arange(size * n), letters.ravel()] = 1
            out[f"letter_{side}"] = hot.T @ flat
            kinds = np.zeros((int(KINDS.max()) + 1, 4 * hidden), _F)
            np.add.at(kinds, KINDS, out[f"letter_{side}"])
            out[f"kind_{side}"], out[f"loop_{side}"] = kinds, d_loop
        return (total - score) / n, out

    def fit(self, letters: np.ndarray, gold: np.ndarray, epochs: int, batch: int, rate: float, seed: int = 0) -> list[float]:
        """Adam over shuffled batches of windows, (window, time) both; the mean loss of each epoch."""
        rng, losses, step = np.random.default_rng(seed), [], 0
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for epoch in range(epochs):
            order, total, seen = rng.permutation(len(letters)), 0.0, 0
            for a in range(0, len(order), batch):
                some = order[a : a + batch]
                loss, grads = self.slope(np.ascontiguousarray(letters[some].T), np.ascontiguousarray(gold[some].T))
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                step += 1
                speed = rate * (0.5 ** (epoch * 3 // epochs)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in grads.items():
                    g = g * _F(min(1.0, 5.0 / (norm + 1e-9)))
                    first[k] = _F(0.9) * first[k] + _F(0.1) * g
                    second[k] = _F(0.999) * second[k] + _F(0.001) * g * g
                    self.weights[k] = (self.weights[k] - _F(speed) * first[k] / (np.sqrt(second[k]) + _F(1e-8))).astype(_F)
                total, seen = total + loss * len(some), seen + len(some)
            losses.append(total / max(seen, 1))
        return losses


def best_paths(scores: list[np.ndarray], legal: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """By stretch of (time, tag) log scores, the best sequence of tags whose moves are all legal."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    for a in range(0, len(order), 256):
        some = [i for i in order[a : a + 256] if len(scores[i])]
        if not some:
            continue
        lens = np.array([len(scores[i]) for i in some])
        came, value = [], np.stack([scores[i][0] for i in some]) + start
        for t in range(1, int(lens[0])):
            live = int(np.searchsorted(-lens, -t, "left"))
            step = value[:live, :, None] + legal
            back = step.argmax(axis=1).astype(np.int8)
            came.append(back)
            value[:live] = np.take_along_axis(step, back[:, None].astype(np.int64), 1)[:, 0] + np.stack([scores[i][t] for i in some[:live]])
        at = value.argmax(axis=1)
        paths = [np.empty(n, np.int64) for n in lens]
        for t in range(int(lens[0]) - 1, -1, -1):
            live = int(np.searchsorted(-lens, -t, "left"))
            for k in range(live):
                paths[k][t] = at[k]
            if t:
                at[:live] = came[t - 1][np.arange(live), at[:live]]
        for i, path in zip(some, paths, strict=True):
            out[i] = path
    return out
