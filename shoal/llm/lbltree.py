"""A hierarchical log-bilinear language model (Mnih and Hinton, 2009) in numpy, trained by noise-contrastive estimation.

The tokens are the leaves of a tree of three levels with up to ``FAN`` children a node. The vectors of the
two tokens before, each weighted by its position, add up to a predicted vector; at each level its products
with the vectors of a node's children, plus their biases, are a softmax over these children. The product of
the three is the token's probability, so probabilities add up to 1 over all leaves.

Training draws noise (Mnih and Teh, 2012): at each level, ``NOISE`` children a token, by their shares of
the corpus; the tokens of a batch that share a node share its drawn children, so that all is matrix products.
Steps are scaled by the root of each row's summed squares (AdaGrad).
"""

from __future__ import annotations

import numpy as np

FAN, LEVELS, DIM, NOISE, RATE, PART = 32, 3, 32, 8, 0.2, 2048
MOST_LEAVES = FAN**LEVELS
_ONES, _MOST, _LEAST = np.ones(FAN, np.float32), 80, 1e-30


def order_leaves(follows: np.ndarray) -> np.ndarray:
    """follows [token, context]: how often each token came after each context -> all tokens, alike ones next to each other.

    Halves, again and again, by the leading axis of the logarithms of (smoothed) ratios to what is usual.
    """
    usual = follows.sum(axis=0) + 1e-9
    usual /= usual.sum()
    x = np.log((follows + 4 * usual) / ((follows.sum(axis=1, keepdims=True) + 4) * usual)).astype(np.float32)
    out, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= FAN:
            out.append(at)
            continue
        own = x[at] - x[at].mean(axis=0)
        spread = own.T @ own
        axis = np.linspace(1, 2, x.shape[1], dtype=np.float32)
        for _ in range(12):  # power iteration
            axis = spread @ axis
            axis /= np.linalg.norm(axis) + 1e-12
        at = at[np.argsort(own @ axis, kind="stable")]
        unit = FAN if len(at) <= 2 * FAN**2 else FAN**2
        half = max(unit, round(len(at) / 2 / unit) * unit)
        todo += [at[half:], at[:half]]
    return np.concatenate(out)


class Model:
    """``x``: a vector a leaf as context, then one a child at each level from the leaves up, then two of weights by position.
    ``b``: the children's biases, in the same rows. ``s``: the summed squares of vectors and biases."""

    def __init__(self, counts: np.ndarray, seed: int = 7):
        """``counts`` of the leaves in order; the model starts as their shares."""
        if not 0 < len(counts) <= MOST_LEAVES:
            raise ValueError(f"the tree has 1 to {MOST_LEAVES} leaves")
        self.leaves = len(counts)
        self.share: list[np.ndarray] = []
        level = counts + 0.5
        for _ in range(LEVELS):
            full = np.zeros(-(-len(level) // FAN) * FAN)
            full[: len(level)] = level
            full = full.reshape(-1, FAN)
            level = full.sum(axis=1)
            self.share.append(full / level[:, None])
        ends = np.cumsum([self.leaves, *(x.size for x in self.share), 2])
        self.x, self.b, self.s = np.zeros((ends[-1], DIM), np.float32), np.zeros(ends[-1], np.float32), np.full((2, ends[-1]), 1e-6, np.float32)
        self.x[: self.leaves] = np.random.default_rng(seed).normal(0, DIM**-0.5, (self.leaves, DIM))
        with np.errstate(divide="ignore"):
            for k, x in enumerate(self.share):
                self.b[ends[k] : ends[k + 1]] = np.maximum(np.log(x.ravel()), -1e30)  # children that aren't there
        self.x[-2], self.x[-1] = 0.5, 1.0
        self.first = ends[:-1].tolist()

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Vectors [node, child, dim] and biases [node, child], as views."""
        rows = slice(self.first[k], self.first[k + 1])
        return self.x[rows].reshape(-1, FAN, DIM), self.b[rows].reshape(-1, FAN)

    def predicted(self, two: np.ndarray, one: np.ndarray) -> np.ndarray:
        return self.x.take(two, axis=0) * self.x[-2] + self.x.take(one, axis=0) * self.x[-1]

    def log_probs(self, two: np.ndarray, one: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of leaves ``to`` after ``two`` and ``one``."""
        order = np.argsort(to.astype(np.uint16), kind="stable")
        sums, levels = np.zeros(len(to)), _levels(to[order])
        whole = [np.ascontiguousarray(np.concatenate([q, b[:, :, None]], axis=2).transpose(0, 2, 1)) for q, b in map(self.level, range(LEVELS))]
        for a in range(0, len(to), PART):
            at = order[a : a + PART]
            h, total = np.ones((len(at), DIM + 1), np.float32), sums[a : a + PART]  # the last column is that of the biases
            h[:, :DIM] = self.predicted(two[at], one[at])
            each, s, e = np.arange(len(at)), *np.empty((2, len(at), FAN), np.float32)
            for k, level in enumerate(levels):
                for p, _, i, j in level.parts(a, a + len(at)):
                    np.dot(h[i:j], whole[k][p], out=s[i:j])
                if s.max() > _MOST:  # exponentials would leave the range of numbers
                    s -= s.max(axis=1, keepdims=True)
                all_ = np.exp(s, out=e) @ _ONES
                if all_.min() < _LEAST:
                    s -= s.max(axis=1, keepdims=True)
                    all_ = np.exp(s, out=e) @ _ONES
                total += s[each, level.child[a : a + PART]]
                total -= np.log(all_)
        out = np.empty(len(to))
        out[order] = sums
        return out


class _Level:
    """Leaves in order, seen from one level of the tree: all that share a node stand together."""

    def __init__(self, node: np.ndarray):
        self.child, parent = node % FAN, node // FAN
        self.first = np.flatnonzero(np.diff(parent, prepend=-1))
        self.used, self.size = parent[self.first], np.diff(self.first, append=len(node))
        self.group = np.repeat(np.arange(len(self.used)), self.size)

    def parts(self, a: int, z: int):
        """(node, group, from, to) of what lies between places a and z, counted from a."""
        lo, hi = int(self.group[a]), int(self.group[z - 1]) + 1
        cuts = [0, *(self.first[lo + 1 : hi] - a).tolist(), z - a]
        return zip(self.used[lo:hi].tolist(), range(lo, hi), cuts, cuts[1:], strict=False)


def _levels(leaves: np.ndarray) -> list[_Level]:
    return [_Level(leaves // FAN**k) for k in range(LEVELS)]


class Trainer:
    """Changes ``model`` in place; ``touched`` counts the examples that moved each row."""

    def __init__(self, model: Model, rng: np.random.Generator, rate: float = RATE, noise: int = NOISE):
        self.m, self.rng, self.rate, self.noise = model, rng, rate, noise
        self.touched = np.zeros(len(model.x))
        with np.errstate(divide="ignore"):
            self.expected = [np.maximum(np.log(noise * x), -1e30).astype(np.float32) for x in model.share]

    def _move(self, rows: np.ndarray, d: np.ndarray, n: np.ndarray) -> None:
        """Vectors of these rows along their gradients."""
        square = self.m.s[0, rows] + np.einsum("ij,ij->i", d, d) / DIM
        self.m.s[0, rows] = square
        self.m.x[rows] += d * (self.rate / np.sqrt(square))[:, None]
        self.touched[rows] += n

    def _move_biases(self, rows: np.ndarray, d: np.ndarray) -> None:
        square = self.m.s[1, rows] + d * d
        self.m.s[1, rows] = square
        self.m.b[rows] += d * (self.rate / np.sqrt(square))

    def step(self, two: np.ndarray, one: np.ndarray, to: np.ndarray) -> None:
        """One step along the gradient of a batch. Sorted by leaf, its tokens share nodes in runs at each level; they are
        gone through in parts that stay in the processor's cache."""
        m, n = self.m, len(to)
        order = np.argsort(to.astype(np.uint16), kind="stable")
        two, one, levels = two[order], one[order], _levels(to[order])
        drawn = [(-self.rng.multinomial(v.size * self.noise, m.share[k][v.used]) / v.size[:, None]).astype(np.float32) for k, v in enumerate(levels)]
        less = [np.empty((len(v.used), DIM + 1, FAN), np.float32) for v in levels]  # vectors and biases of the used nodes' children, negated
        for (q, b), e, v, x in zip(map(m.level, range(LEVELS)), self.expected, levels, less, strict=True):
            np.negative(q.take(v.used, axis=0).transpose(0, 2, 1), out=x[:, :DIM])
            np.subtract(e.take(v.used, axis=0), b.take(v.used, axis=0), out=x[:, DIM])
        grads = [np.zeros((len(v.used), FAN, DIM + 1), np.float32) for v in levels]
        towards, places = np.empty((DIM, 2 * n), np.float32), np.zeros((2, DIM), np.float32)
        for a in range(0, n, PART):
            z = min(a + PART, n)
            each = np.arange(z - a)
            far, near = m.x.take(two[a:z], axis=0), m.x.take(one[a:z], axis=0)
            h = np.ones((z - a, DIM + 1), np.float32)  # the last column is that of the biases
            np.multiply(far, m.x[-2], out=h[:, :DIM])
            h[:, :DIM] += near * m.x[-1]
            back, down, s = np.zeros((z - a, DIM), np.float32), np.empty((z - a, DIM), np.float32), np.empty((z - a, FAN), np.float32)
            for k, level in enumerate(levels):
                q, parts = m.level(k)[0], list(level.parts(a, z))
                for _, i_group, i, j in parts:
                    np.dot(h[i:j], less[k][i_group], out=s[i:j])
                with np.errstate(over="ignore"):
                    np.exp(s, out=s)
                s += 1
                odds = np.reciprocal(s, out=s)  # that a child is data and not noise
                own = each, level.child[a:z]
                right = 1 - odds[own]
                if len(parts) < 16:
                    for _, i_group, i, j in parts:
                        odds[i:j] *= drawn[k][i_group]
                else:
                    odds *= drawn[k].take(level.group[a:z], axis=0)
                g = odds
                g[own] += right
                for p, i_group, i, j in parts:
                    if i and j < z - a:  # all tokens of the node
                        np.matmul(g[i:j].T, h[i:j], out=grads[k][i_group])
                    else:
                        grads[k][i_group] += g[i:j].T @ h[i:j]
                    np.dot(g[i:j], q[p], out=down[i:j])
                back += down
            towards[:, a:z], towards[:, n + a : n + z] = (back * m.x[-2]).T, (back * m.x[-1]).T
            places += np.stack([np.einsum("ij,ij->j", back, far), np.einsum("ij,ij->j", back, near)])
        for k, level in enumerate(levels):
            rows = (m.first[k] + level.used[:, None] * FAN + np.arange(FAN)).ravel()
            self._move_biases(rows, grads[k][:, :, DIM].ravel())
            self._move(rows, grads[k][:, :, :DIM].reshape(-1, DIM), np.repeat(level.size, FAN))
        met = np.bincount(np.concatenate([two, one]), minlength=m.leaves)
        rows = np.flatnonzero(met)
        ids = (np.cumsum(met > 0) - 1)[np.concatenate([two, one])]
        self._move(rows, np.stack([np.bincount(ids, weights=towards[d]) for d in range(DIM)], axis=1).astype(np.float32), met[rows])
        self._move(np.array([len(m.x) - 2, len(m.x) - 1]), places, np.array([n, n]))
