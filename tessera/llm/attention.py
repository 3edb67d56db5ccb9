"""A small causal self-attention model in numpy: one head over WINDOW tokens, trained by Adam, scored in overlapping windows.

A token comes in as the mean of the embeddings of its pieces, such as a word's subword ids, and goes out as one of g groups.
"""

from __future__ import annotations

import numpy as np

WINDOW, STRIDE, WIDTH, RATE = 32, 16, 16, 8e-3
#: Rows of embeddings; one more stands before a text's first token.
ROWS = 4096
SHAPES = {"embed": lambda g: (ROWS + 1, WIDTH), "place": lambda g: (WINDOW, WIDTH), "q": lambda g: (WIDTH, WIDTH), "k": lambda g: (WIDTH, WIDTH), "v": lambda g: (WIDTH, WIDTH), "own": lambda g: (WIDTH, WIDTH), "out": lambda g: (WIDTH, g), "bias": lambda g: (g,)}
_SEEN = np.tril(np.ones((WINDOW, WINDOW), np.float32))
#: Logits beyond are cut, so that exponentials stay within single precision.
_MOST = np.float32(40)


def softmax(x: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
    """Along the last axis, in place; seen: what may have any weight."""
    np.exp(np.clip(x, -_MOST, _MOST, out=x), out=x)
    if seen is not None:
        x *= seen
    x /= x @ np.ones((x.shape[-1], 1), np.float32)
    return x


class Pieces:
    """The rows of embeddings that each token of a list has, end to end."""

    def __init__(self, rows: np.ndarray, counts: np.ndarray) -> None:
        self.rows, self.counts, self.starts = rows, counts, np.cumsum(counts) - counts

    def of(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the given tokens end to end, where each token's begin, and how many each has."""
        n = self.counts[tokens]
        ends = np.cumsum(n)
        return self.rows[np.repeat(self.starts[tokens] - ends + n, n) + np.arange(ends[-1])], ends - n, n


class Attention:
    """Predicts the group, 0 to g - 1, of token t from the tokens before it."""

    def __init__(self, g: int, weights: np.ndarray | None = None, shares: np.ndarray | None = None) -> None:
        self.g = g
        shapes = {k: f(g) for k, f in SHAPES.items()}
        if weights is None:
            rng = np.random.default_rng(9)
            parts = {k: rng.normal(0, 0.3 if k in ("embed", "place") else 0.25, s).astype(np.float32) for k, s in shapes.items()}
            parts["out"][:] = 0  # at first the prediction is the shares alone
            parts["bias"] = np.log(np.maximum(shares, 1e-9)).astype(np.float32)
            weights = np.concatenate([p.ravel() for p in parts.values()])
        self.flat = np.array(weights, np.float32)
        self.w: dict[str, np.ndarray] = {}
        at = 0
        for k, s in shapes.items():
            n = int(np.prod(s))
            self.w[k] = self.flat[at : at + n].reshape(s)
            at += n

    def embedded(self, pieces: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        rows, starts, n = pieces
        embed, most = self.w["embed"], int(n.max())
        if most > 16:
            return np.add.reduceat(embed[rows], starts, axis=0) / n[:, None].astype(np.float32)
        out = embed[rows[starts]]
        for j in range(1, most):
            more = np.flatnonzero(n > j)
            out[more] += embed[rows[starts[more] + j]]
        out /= n[:, None].astype(np.float32)
        return out

    def _forward(self, x: np.ndarray, first: int = 0) -> tuple:
        """Hidden states of the positions from first on, and what the gradient needs. x: batch x WINDOW x WIDTH, embedded tokens."""
        w = self.w
        x = x + w["place"]
        flat = x.reshape(-1, WIDTH)
        k, v = ((flat @ w[n]).reshape(x.shape) for n in ("k", "v"))
        tail = np.ascontiguousarray(x[:, first:])
        q = (tail.reshape(-1, WIDTH) @ w["q"]).reshape(tail.shape)
        q *= np.float32(WIDTH**-0.5)
        s = softmax(q @ k.transpose(0, 2, 1), _SEEN[first:])
        mixed = s @ v
        h = np.tanh(mixed.reshape(-1, WIDTH) + tail.reshape(-1, WIDTH) @ w["own"])
        return x, q, k, v, s, mixed, h

    def train_step(self, inputs: np.ndarray, targets: np.ndarray, real: np.ndarray, state: dict, rate: float = RATE, pieces: Pieces | None = None) -> float:
        """One step of Adam over a batch; real marks the positions that hold tokens. Returns the mean loss before it.

        inputs are tokens of pieces, or rows of embeddings themselves; targets are groups.
        """
        w, (b, n) = self.w, inputs.shape
        rows, starts, counts = (pieces or IDENTITY).of(inputs.ravel())
        x, q, k, v, s, mixed, h = self._forward(self.embedded((rows, starts, counts)).reshape(b, n, WIDTH))
        p = softmax(h @ w["out"] + w["bias"])
        keep = real.ravel().astype(np.float32)
        count = max(1.0, float(keep.sum()))
        t = targets.ravel()
        loss = -float((np.log(p[np.arange(len(t)), t] + 1e-12) * keep).sum()) / count
        d = p
        d[np.arange(len(t)), t] -= 1
        d *= (keep / count)[:, None]
        grad = {"out": h.T @ d, "bias": d.sum(0)}
        dh = (d @ w["out"].T) * (1 - h * h)
        flat = x.reshape(-1, WIDTH)
        grad["own"] = flat.T @ dh
        dm = dh.reshape(b, n, WIDTH)
        dv = s.transpose(0, 2, 1) @ dm
        da = dm @ v.transpose(0, 2, 1)
        da -= (dm * mixed) @ np.ones((WIDTH, 1), np.float32)
        ds = np.multiply(s, da, out=da)
        dq, dk = ds @ k * np.float32(WIDTH**-0.5), ds.transpose(0, 2, 1) @ q
        dx = dh @ w["own"].T
        for name, g in (("q", dq), ("k", dk), ("v", dv)):
            g = g.reshape(-1, WIDTH)
            grad[name] = flat.T @ g
            dx += g @ w[name].T
        dx = dx.reshape(x.shape)
        grad["place"] = dx.sum(0)
        each = dx.reshape(-1, WIDTH) / counts[:, None].astype(np.float32)
        spots = (rows[:, None] * WIDTH + np.arange(WIDTH)).ravel()
        grad["embed"] = np.bincount(spots, np.repeat(each, counts, axis=0).ravel(), minlength=w["embed"].size).astype(np.float32)
        step = np.concatenate([grad[name].ravel() for name in SHAPES]).astype(np.float32)
        if not state:
            state.update(n=0, m=np.zeros_like(step), r=np.zeros_like(step))
        state["n"] = i = state["n"] + 1
        m, r = state["m"], state["r"]
        m *= np.float32(0.9)
        m += np.float32(0.1) * step
        step *= step
        r *= np.float32(0.99)
        r += np.float32(0.01) * step
        np.sqrt(r, out=step)
        step += np.float32(1e-8)
        np.divide(m, step, out=step)
        step *= np.float32(rate / (1 - 0.9**i) * np.sqrt(1 - 0.99**i))
        self.flat -= step
        return loss

    def score(self, tokens: np.ndarray, lengths: np.ndarray, groups: np.ndarray | None = None, pieces: Pieces | None = None) -> np.ndarray:
        """Natural logarithm of the probability of each token's group; tokens of all texts in a row, lengths of the texts, none 0.

        groups: the group of each token (the token itself where none are given). The last of the pieces stands before a text.
        """
        groups = tokens if groups is None else groups
        before = self.g if pieces is None else len(pieces.counts) - 1
        table = self.w["embed"] if pieces is None else self.embedded((pieces.rows, pieces.starts, pieces.counts))
        inputs, at, first = windows(tokens, lengths, before)
        out = np.zeros(len(tokens), np.float32)
        for head in (True, False):
            rows = np.flatnonzero(first == head)
            begin = 0 if head else WINDOW - STRIDE
            for i in range(0, len(rows), 1024):
                part = rows[i : i + 1024]
                h = self._forward(table[inputs[part]], begin)[-1]
                spots = at[part, begin:].ravel()
                real = spots >= 0
                h, spots = h[real], spots[real]
                p = softmax(h @ self.w["out"] + self.w["bias"])
                out[spots] = np.log(np.maximum(p[np.arange(len(spots)), groups[spots]], np.float32(1e-30)))
        return out


IDENTITY = Pieces(np.arange(ROWS + 1), np.ones(ROWS + 1, np.int64))


def windows(tokens: np.ndarray, lengths: np.ndarray, before: int, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """inputs (windows x WINDOW), the index of the token that each position predicts or -1, and which windows are a text's first.

    Windows of a text start stride apart. The first scores all its positions, later ones their last stride, so each token is scored
    once, with WINDOW - stride tokens before it at least where the text has them.
    """
    shifted = np.empty(len(tokens), np.int64)
    shifted[1:] = tokens[:-1]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    shifted[starts] = before
    per = 1 + np.maximum(0, -(-(lengths - WINDOW) // stride))
    text = np.repeat(np.arange(len(lengths)), per)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    at = (starts[text] + turn * stride)[:, None] + np.arange(WINDOW)
    real = at < ends[text][:, None]
    inputs = np.where(real, shifted[np.minimum(at, max(0, len(tokens) - 1))], before)
    return inputs, np.where(real, at, -1), turn == 0
