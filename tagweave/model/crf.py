"""Linear-chain conditional random field in numpy.

Sequences are padded into one (sequence, position, label) block per length
class, so that the recursions run over positions only and each step is one
vectorised operation over all sequences of the block.  Training minimises the
penalised negative log-likelihood with limited-memory BFGS; with ``c1 > 0`` the
orthant-wise variant is used.  The same object decodes (Viterbi, n-best) and
gives marginals; ``to_rows``/``from_rows`` turn it into plain weight tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

Item = dict[str, float]


def _logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def as_item(features: dict | Sequence[str]) -> Item:
    """Feature dict -> name -> value; strings become ``name=value`` with 1."""
    if not isinstance(features, dict):
        return {f: 1.0 for f in features}
    out: Item = {}
    for name, value in features.items():
        if value is None:
            continue
        if isinstance(value, bool):
            out[name] = float(value)
        elif isinstance(value, (int, float)):
            out[name] = float(value)
        else:
            out[f"{name}={value}"] = 1.0
    return out


class Packed:
    """Sequences as index arrays over a feature vocabulary."""

    def __init__(self, X: Sequence[Sequence[dict | Sequence[str]]], vocabulary: dict[str, int], grow: bool = False) -> None:
        index, value, starts, lengths = [], [], [0], []
        for seq in X:
            lengths.append(len(seq))
            for features in seq:
                for name, v in as_item(features).items():
                    i = vocabulary.setdefault(name, len(vocabulary)) if grow else vocabulary.get(name)
                    if i is not None and v:
                        index.append(i)
                        value.append(v)
                starts.append(len(index))
        self.index = np.array(index, np.int64)
        self.value = np.array(value, np.float64)
        self.starts = np.array(starts, np.int64)
        self.lengths = np.array(lengths, np.int64)
        self.token = np.repeat(np.arange(len(starts) - 1), np.diff(self.starts))
        self.first = np.r_[0, np.cumsum(self.lengths)]
        self.plain = bool((self.value == 1).all())
        #: the same cells by feature, for gradients
        self.by_feature = np.argsort(self.index, kind="stable")
        found = self.index[self.by_feature]
        self.feature_starts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else np.zeros(0, np.int64)
        self.features = found[self.feature_starts]

    def scores(self, W: np.ndarray) -> np.ndarray:
        """Sum of the weights of each token's features."""
        out = np.zeros((len(self.starts) - 1, W.shape[1]))
        some = np.flatnonzero(np.diff(self.starts) > 0)
        if len(some):
            rows = W[self.index] if self.plain else W[self.index] * self.value[:, None]
            out[some] = np.add.reduceat(rows, self.starts[some], axis=0)
        return out

    def expectation(self, tokens: np.ndarray, n_features: int) -> np.ndarray:
        """Sum of the tokens' rows for each feature."""
        out = np.zeros((n_features, tokens.shape[1]))
        if len(self.index):
            rows = tokens[self.token[self.by_feature]]
            if not self.plain:
                rows = rows * self.value[self.by_feature][:, None]
            out[self.features] = np.add.reduceat(rows, self.feature_starts, axis=0)
        return out

    def blocks(self) -> list[np.ndarray]:
        """Sequence numbers grouped so that padding at most doubles the work."""
        order = np.argsort(self.lengths, kind="stable")
        order = order[self.lengths[order] > 0]
        out, at = [], 0
        while at < len(order):
            top = self.lengths[order[at]]
            end = at + int(np.searchsorted(self.lengths[order[at:]], max(top * 2, 4), side="right"))
            out.append(order[at:end])
            at = end
        return out

    def padded(self, seqs: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = self.lengths[seqs]
        at = self.first[seqs][:, None] + np.arange(n.max())
        mask = np.arange(n.max()) < n[:, None]
        at = np.where(mask, at, 0)
        return scores[at], mask, at


def _step(x: np.ndarray, E: np.ndarray) -> np.ndarray:
    """log(exp(x) @ E), row by row in range."""
    top = x.max(axis=1, keepdims=True)
    return np.log(np.exp(x - top) @ E + 1e-300) + top


def forward_backward(S: np.ndarray, mask: np.ndarray, T: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log Z, marginals (n, t, L), expected transitions (L, L))."""
    n, t, L = S.shape
    E = np.exp(T)
    alpha = np.empty_like(S)
    alpha[:, 0] = S[:, 0]
    for i in range(1, t):
        alpha[:, i] = np.where(mask[:, i, None], _step(alpha[:, i - 1], E) + S[:, i], alpha[:, i - 1])
    z = _logsumexp(alpha[:, -1], 1)
    beta = np.zeros_like(S)
    pairs = np.zeros((L, L))
    for i in range(t - 2, -1, -1):
        live = mask[:, i + 1]
        if live.any():
            inner = S[live, i + 1] + beta[live, i + 1]
            beta[live, i] = _step(inner, E.T)
            a, b = alpha[live, i], inner
            ta, tb = a.max(1, keepdims=True), b.max(1, keepdims=True)
            pairs += E * ((np.exp(a - ta) * np.exp(ta + tb - z[live, None])).T @ np.exp(b - tb))
    marginal = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
    return z, marginal, pairs


class LinearChainCRF:
    def __init__(self, c1: float = 0.5, c2: float = 0.05, max_iterations: int = 50, tolerance: float = 1e-5, pairs: bool = True) -> None:
        """``pairs``: whether pairs of labels have weights."""
        self.c1, self.c2, self.max_iterations, self.tolerance, self.pairs = c1, c2, max_iterations, tolerance, pairs
        self.vocabulary: dict[str, int] = {}
        self.labels: list[str] = []
        self.history: list[float] = []

    # -- training ---------------------------------------------------------
    def fit(self, X: Sequence, y: Sequence[Sequence[str]], dev: tuple[Sequence, Sequence] | None = None, score: Callable | None = None) -> "LinearChainCRF":
        if len(X) != len(y) or any(len(a) != len(b) for a, b in zip(X, y)):
            raise ValueError("X and y must have equal lengths")
        self.vocabulary = {}
        data = Packed(X, self.vocabulary, grow=True)
        self.labels = sorted({t for seq in y for t in seq}) or ["O"]
        code = {t: i for i, t in enumerate(self.labels)}
        gold = np.array([code[t] for seq in y for t in seq], np.int64)
        F, L = len(self.vocabulary), len(self.labels)
        empirical = np.zeros((F, L))
        np.add.at(empirical, (data.index, gold[data.token]), data.value)
        empirical_t = np.zeros((L, L))
        inside = np.ones(len(gold), bool)
        inside[data.first[:-1][data.lengths > 0]] = False
        at = np.flatnonzero(inside)
        np.add.at(empirical_t, (gold[at - 1], gold[at]), 1)
        blocks = data.blocks()

        def objective(theta: np.ndarray) -> tuple[float, np.ndarray]:
            W, T = theta[: F * L].reshape(F, L), theta[F * L :].reshape(L, L)
            scores = data.scores(W)
            value = -float(scores[np.arange(len(gold)), gold].sum() + (T * empirical_t).sum())
            expected = np.zeros((len(gold), L))
            expected_t = np.zeros((L, L))
            for seqs in blocks:
                S, mask, where = data.padded(seqs, scores)
                z, marginal, pairs = forward_backward(S, mask, T)
                value += float(z.sum())
                expected[where[mask]] = marginal[mask]
                expected_t += pairs
            grad = data.expectation(expected, F)
            g = np.r_[(grad - empirical).ravel(), (expected_t - empirical_t).ravel() * self.pairs]
            return value + self.c2 * float(theta @ theta), g + 2 * self.c2 * theta

        theta = minimise(objective, np.zeros(F * L + L * L), self.c1, self.max_iterations, self.tolerance, self.history)
        self.W, self.T = theta[: F * L].reshape(F, L), theta[F * L :].reshape(L, L)
        if dev and score:
            self.dev_score = score(dev[1], self.predict(dev[0]))
        return self

    def objective_at(self, X: Sequence, y: Sequence) -> float:
        """Negative log-likelihood without penalty."""
        data = Packed(X, self.vocabulary)
        code = {t: i for i, t in enumerate(self.labels)}
        scores, total = data.scores(self.W), 0.0
        for s, seq in enumerate(y):
            if len(seq):
                ids = np.array([code[t] for t in seq])
                S = scores[data.first[s] : data.first[s + 1]]
                z, _, _ = forward_backward(S[None], np.ones((1, len(seq)), bool), self.T)
                total += float(z[0] - S[np.arange(len(ids)), ids].sum() - self.T[ids[:-1], ids[1:]].sum())
        return total

    # -- use ---------------------------------------------------------------
    def predict(self, X: Sequence) -> list[list[str]]:
        data = Packed(X, self.vocabulary)
        scores = data.scores(self.W)
        out: list[list[str]] = [[] for _ in range(len(data.lengths))]
        for seqs in data.blocks():
            S, mask, _ = data.padded(seqs, scores)
            best = viterbi(S, mask, self.T)
            for row, s in zip(best, seqs):
                out[s] = [self.labels[k] for k in row[: data.lengths[s]]]
        return out

    def marginals(self, X: Sequence) -> list[np.ndarray]:
        data = Packed(X, self.vocabulary)
        scores = data.scores(self.W)
        out: list[np.ndarray] = [np.zeros((0, len(self.labels))) for _ in range(len(data.lengths))]
        for seqs in data.blocks():
            S, mask, _ = data.padded(seqs, scores)
            _, marginal, _ = forward_backward(S, mask, self.T)
            for row, s in zip(marginal, seqs):
                out[s] = row[: data.lengths[s]]
        return out

    def predict_n_best(self, X: Sequence, n: int) -> list[list[list[str]]]:
        """Up to ``n`` best label sequences each, best first."""
        data = Packed(X, self.vocabulary)
        scores = data.scores(self.W)
        return [[[self.labels[k] for k in path] for path in n_best(scores[data.first[s] : data.first[s + 1]], self.T, n)] for s in range(len(data.lengths))]

    # -- tables ------------------------------------------------------------
    def to_rows(self) -> tuple[list[tuple[str, str, float]], list[tuple[str, str, float]]]:
        names = list(self.vocabulary)
        state = [(names[f], self.labels[k], float(self.W[f, k])) for f, k in zip(*np.nonzero(self.W))]
        return state, [(a, b, float(self.T[i, j])) for i, a in enumerate(self.labels) for j, b in enumerate(self.labels)]

    @classmethod
    def from_rows(cls, state: Sequence[tuple[str, str, float]], transition: Sequence[tuple[str, str, float]]) -> "LinearChainCRF":
        crf = cls()
        crf.labels = sorted({a for a, _, _ in transition})
        code = {t: i for i, t in enumerate(crf.labels)}
        for f, _, _ in state:
            crf.vocabulary.setdefault(f, len(crf.vocabulary))
        crf.W, crf.T = np.zeros((len(crf.vocabulary), len(code))), np.zeros((len(code), len(code)))
        for f, t, w in state:
            crf.W[crf.vocabulary[f], code[t]] = w
        for a, b, w in transition:
            crf.T[code[a], code[b]] = w
        return crf


def viterbi(S: np.ndarray, mask: np.ndarray, T: np.ndarray) -> np.ndarray:
    n, t, L = S.shape
    best, back = S[:, 0].copy(), np.zeros((n, t, L), np.int64)
    for i in range(1, t):
        step = best[:, None, :] + T.T
        top = step.argmax(2)
        back[:, i] = np.where(mask[:, i, None], top, np.arange(L))
        best = np.where(mask[:, i, None], np.take_along_axis(step, top[:, :, None], 2)[:, :, 0] + S[:, i], best)
    out = np.zeros((n, t), np.int64)
    out[:, -1] = best.argmax(1)
    for i in range(t - 1, 0, -1):
        out[:, i - 1] = back[np.arange(n), i, out[:, i]]
    return out


def n_best(S: np.ndarray, T: np.ndarray, n: int) -> list[list[int]]:
    """List Viterbi: each state keeps its ``n`` best partial paths."""
    if not len(S):
        return [[]]
    t, L = S.shape
    best = np.full((L, n), -np.inf)
    best[:, 0] = S[0]
    back = np.zeros((t, L, n), np.int64)
    for i in range(1, t):
        options = (best[:, :, None] + T[:, None, :]).reshape(L * n, L)
        order = np.argsort(-options, axis=0, kind="stable")[:n]
        back[i] = order.T
        best = np.take_along_axis(options, order, axis=0).T + S[i][:, None]
    flat = best.reshape(-1)
    out = []
    for end in np.argsort(-flat, kind="stable")[:n]:
        if flat[end] == -np.inf:
            break
        path, state = [], int(end)
        for i in range(t - 1, -1, -1):
            label, rank = divmod(state, n)
            path.append(label)
            state = int(back[i, label, rank]) if i else 0
        out.append(path[::-1])
    return out


def n_best_rows(S: np.ndarray, mask: np.ndarray, T: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`n_best` of padded sequences: paths ``(sequence, rank, position)``
    and which ranks there are.  The lists of the states before are merged, each
    by its head; equal ones in the order of states and ranks."""
    m, t, L = S.shape
    best = np.full((m, L, n), -np.inf)
    best[:, :, 0] = S[:, 0]
    back = np.zeros((m, t, L, n), np.int32)
    to = np.arange(L)
    back[:] = np.arange(L * n).reshape(L, n)
    for i in range(1, t):
        live = np.flatnonzero(mask[:, i])
        rows = np.arange(len(live))[:, None]
        before = np.concatenate([best[live], np.full((len(live), L, 1), -np.inf)], axis=2)
        head = before[:, None, :, 0] + T.T
        rank = np.zeros(head.shape, np.int8 if n < 127 else np.int32)
        for r in range(n):
            state = head.argmax(2)
            best[live, :, r] = head[rows, to, state] + S[live, i]
            at = rank[rows, to, state].astype(np.int64)
            back[live, i, :, r] = state * n + np.minimum(at, n - 1)
            if r + 1 < n:
                at = np.minimum(at + 1, n)
                head[rows, to, state] = before[rows, state, at] + T[state, to]
                rank[rows, to, state] = at
    flat = best.reshape(m, L * n)
    ends = np.argsort(-flat, axis=1, kind="stable")[:, :n]
    there = np.take_along_axis(flat, ends, 1) > -np.inf
    paths, which = np.zeros((m, ends.shape[1], t), np.int64), np.arange(m)[:, None]
    for i in range(t - 1, -1, -1):
        paths[:, :, i] = ends // n
        if i:
            ends = back[which, i, ends // n, ends % n]
    return paths, there


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, c1: float, iterations: int, tolerance: float, history: list[float], memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS; orthant-wise for ``c1 > 0``."""

    def pseudo(x: np.ndarray, g: np.ndarray) -> np.ndarray:
        if not c1:
            return g
        at_zero = np.where(g + c1 < 0, g + c1, np.where(g - c1 > 0, g - c1, 0.0))
        return np.where(x != 0, g + c1 * np.sign(x), at_zero)

    value, g = f(x)
    total = value + c1 * np.abs(x).sum()
    history[:] = [total]
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(iterations):
        p = pseudo(x, g)
        norm = float(np.sqrt(p @ p))
        if norm < tolerance * max(1.0, float(np.sqrt(x @ x))):
            break
        d = -p
        alphas = []
        for s, q, rho in reversed(steps):
            a = rho * float(s @ d)
            alphas.append(a)
            d = d - a * q
        if steps:
            s, q, _ = steps[-1]
            d = d * float(s @ q) / float(q @ q)
        for (s, q, rho), a in zip(steps, reversed(alphas)):
            d = d + s * (a - rho * float(q @ d))
        if c1:
            d = np.where(d * -p > 0, d, 0.0)
        slope = float(d @ p)
        if slope >= 0:
            d, slope, steps = -p, -norm * norm, []
        orthant = np.where(x != 0, np.sign(x), -np.sign(p))
        size = 1.0 if steps else 1.0 / max(norm, 1e-12)
        for _ in range(30):
            new = x + size * d
            if c1:
                new = np.where(new * orthant > 0, new, 0.0)
            new_value, new_g = f(new)
            new_total = new_value + c1 * np.abs(new).sum()
            if new_total <= total + 1e-4 * size * slope:
                break
            size *= 0.5
        else:
            break
        s, q = new - x, new_g - g
        curve = float(s @ q)
        if curve > 1e-10:
            steps = [*steps[-memory + 1 :], (s, q, 1.0 / curve)]
        done = abs(total - new_total) < tolerance * max(1.0, abs(total))
        x, g, total = new, new_g, new_total
        history.append(total)
        if done:
            break
    return x
