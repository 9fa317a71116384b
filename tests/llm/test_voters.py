"""Correlations of many voters without a table of all pairs."""

import numpy as np

from framelake.llm import toxicity


def dense(row, voter, n, q, rates):
    v = np.zeros((n, len(rates)))
    v[row, voter] = 1
    left = v - np.outer(1 - q, rates[:, 0]) - np.outer(q, rates[:, 1])
    both = left.T @ left
    scale = np.sqrt(np.maximum(np.diag(both), 1e-9))
    return both / np.outer(scale, scale)


def test_correlations_equal_the_whole_table():
    rng = np.random.default_rng(1)
    n, m = 700, 40
    v = rng.random((n, m)) < rng.uniform(0, 0.3, m)
    v[:, 7] = v[:, 3]
    v[:, 11] = False
    row, voter = np.nonzero(v)
    q = rng.random(n)
    rates = toxicity._rates(row, voter, n, m, np.stack([1 - q, q], 1))
    shuffled = rng.permutation(len(row))
    i, j, got = toxicity._correlations(row[shuffled], voter[shuffled], n, q, rates)
    want = dense(row, voter, n, q, rates)
    assert np.allclose(got, want[i, j]) and (i < j).all()
    together = v.T.astype(int) @ v.astype(int)
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a in range(m) for b in range(a + 1, m) if together[a, b]}
    assert want[np.triu_indices(m, 1)][together[np.triu_indices(m, 1)] == 0].max() < toxicity.RELATED


def test_groups_are_connected_components():
    rng = np.random.default_rng(2)
    for m, k in ((1, 0), (50, 30), (300, 280)):
        i, j = rng.integers(0, m, (2, k))
        want = list(range(m))
        for a, b in zip(i.tolist(), j.tolist()):
            x, y = sorted((want[a], want[b]))
            want = [x if g == y else g for g in want]
        assert toxicity._groups(m, i, j).tolist() == want


def test_more_voters_than_any_table_of_pairs_would_hold():
    rng = np.random.default_rng(3)
    n, m = 6_000, 60_000
    y = rng.random(n) < 0.3
    votes = [(r, v) for r in range(n) for v in {int(x) for x in rng.integers(0, m // 2, 12) + (m // 2 if y[r] else 0)}]
    row, voter = np.array(votes).T
    start = np.tile([1e-4, 2e-4], (m, 1))
    start[: m // 2] = start[: m // 2, ::-1]
    rates, share, q = toxicity.label_model(row, voter, n, start, 0.3, rounds=5)
    assert rates.shape == (m, 2) and ((q > 0.5) == y).mean() > 0.9


def test_no_votes_and_one_vote():
    none = np.zeros(0, np.int64)
    i, j, got = toxicity._correlations(none, none, 3, np.full(3, 0.5), np.full((2, 2), 0.1))
    assert len(i) == len(j) == len(got) == 0
    assert toxicity.label_model(np.array([1]), np.array([0]), 3, np.array([[0.1, 0.4]]), 0.3)[2].shape == (3,)
