import itertools

import numpy as np
import pytest

from tagweave.model.crf import LinearChainCRF, forward_backward, minimise, n_best, viterbi


def brute(S, T):
    n, L = S.shape
    paths = {p: S[np.arange(n), list(p)].sum() + sum(T[a, b] for a, b in zip(p, p[1:])) for p in itertools.product(range(L), repeat=n)}
    return paths


def test_recursions_against_enumeration():
    rnd = np.random.default_rng(1)
    for n in range(1, 6):
        S, T = rnd.normal(size=(n, 3)), rnd.normal(size=(3, 3))
        paths = brute(S, T)
        pad = np.concatenate([S, rnd.normal(size=(2, 3))])[None]
        mask = (np.arange(n + 2) < n)[None]
        z, marginal, pairs = forward_backward(pad, mask, T)
        total = np.logaddexp.reduce(list(paths.values()))
        assert np.isclose(z[0], total)
        want = np.zeros((n, 3))
        for p, s in paths.items():
            want[np.arange(n), list(p)] += np.exp(s - total)
        assert np.allclose(marginal[0, :n], want) and np.isclose(pairs.sum(), n - 1)
        best = sorted(paths, key=lambda p: -paths[p])
        assert tuple(viterbi(pad, mask, T)[0, :n]) == best[0]
        assert [tuple(p) for p in n_best(S, T, 4)] == best[:4]


def toy(n=60, seed=0):
    rnd = np.random.default_rng(seed)
    X, y = [], []
    for _ in range(n):
        tags = rnd.choice(["O", "B-X", "I-X"], rnd.integers(1, 8), p=[0.6, 0.2, 0.2])
        X.append([{"w": f"{t}{rnd.integers(3)}" if rnd.random() < 0.9 else "noise", "bias": 1} for t in tags])
        y.append([str(t) for t in tags])
    return X, y


@pytest.mark.parametrize("c1", [0.0, 0.3])
def test_training_learns_and_objective_falls(c1):
    X, y = toy()
    crf = LinearChainCRF(c1=c1, c2=0.01, max_iterations=60).fit(X, y)
    assert all(a >= b - 1e-9 for a, b in zip(crf.history, crf.history[1:]))
    Xt, yt = toy(40, 9)
    right = sum(a == b for p, q in zip(crf.predict(Xt), yt) for a, b in zip(p, q))
    assert right / sum(map(len, yt)) > 0.85
    if c1:
        assert (crf.W == 0).mean() > 0.05
    again = LinearChainCRF.from_rows(*crf.to_rows())
    assert again.predict(Xt) == crf.predict(Xt)
    assert abs(again.objective_at(Xt, yt) - crf.objective_at(Xt, yt)) < 1e-6
    assert [b[0] for b in crf.predict_n_best(Xt, 3)] == crf.predict(Xt)


def test_gradient_by_finite_differences():
    X, y = toy(8, 3)
    crf = LinearChainCRF(c1=0, c2=0.1, max_iterations=3).fit(X, y)
    base = crf.objective_at(X, y)
    grads = {}
    marg = crf.marginals(X)
    for f, k in [(0, 0), (1, 1), (2, 2)]:
        name, label = list(crf.vocabulary)[f], crf.labels[k]
        expected = sum(m[i, k] for s, m in zip(X, marg) for i, item in enumerate(s) if (f"w={item['w']}" == name or name == "bias"))
        gold = sum(t == label for s, ts in zip(X, y) for item, t in zip(s, ts) if (f"w={item['w']}" == name or name == "bias"))
        grads[f, k] = expected - gold
        crf.W[f, k] += 1e-5
        assert np.isclose((crf.objective_at(X, y) - base) / 1e-5, grads[f, k], atol=1e-3)
        crf.W[f, k] -= 1e-5


def test_edge_cases():
    crf = LinearChainCRF().fit([[], [{"a": 1}]], [[], ["O"]])
    assert crf.predict([[], [{"zz": "new"}], [{}]]) == [[], ["O"], ["O"]] and crf.predict([]) == []
    with pytest.raises(ValueError):
        LinearChainCRF().fit([[{"a": 1}]], [["O", "O"]])
    assert np.allclose(minimise(lambda x: (float(((x - 2) ** 2).sum()), 2 * (x - 2)), np.zeros(3), 0.0, 50, 1e-9, []), 2)
