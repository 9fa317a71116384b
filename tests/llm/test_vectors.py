"""Whitening against numpy's eigenvectors and sort-means against plain k-means."""

import hashlib
import math

import numpy as np
import pytest

from framelake.llm import sort_means, whitening

NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, n int").repartition(3)


def odd_rows(rng, n, d):
    """Rows that count, and rows that don't."""
    fine = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, d)]) for i in range(n)]
    fine += [fine[3], fine[3], (None, fine[4][1]), (n + 1, fine[2][1])]
    bad = [(900, None), (901, []), (902, [0.5] * (d - 1)), (903, [0.5] * (d - 1) + [None]), (904, [NAN] + [0.1] * (d - 1)), (905, [0.1] * (d - 1) + [INF]), (906, [-INF] * d), (907, [0.5] * (d + 2))]
    return fine, bad


# ---- block Lanczos


def symmetric(rng, values):
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize(
    "values, wanted",
    [
        (np.linspace(1, 64, 64), 32),
        (0.7 ** np.arange(300) * 50, 12),
        ([9.0] * 12 + [5.0] * 20 + [1.0] * 8, 16),  # multiplicity beyond the block's width
        ([7.0] * 3 + [0.0] * 37, 10),  # a breakdown after the first block
        ([0.0] * 9, 4),
        ([2.0], 5),
        ([3.0] * 200, 20),
    ],
)
def test_block_lanczos_equals_dense(values, wanted):
    rng = np.random.default_rng(1)
    m = symmetric(rng, np.array(values))
    passes = []

    def times(q):
        passes.append(q.shape[1])
        return m @ q

    e, y = whitening.block_lanczos(times, len(m), wanted)
    want = np.sort(values)[::-1][:wanted]
    assert np.abs(e - want).max() <= 1e-11 * max(1, want[0])
    assert np.abs(y.T @ y - np.eye(len(e))).max() < 1e-12
    assert np.abs(m @ y - y * e).max() <= 1e-10 * max(1, want[0])
    if len(values) == 300:
        assert sum(passes) < 200  # it stops by residuals, before the basis is whole


@pytest.mark.parametrize("d, n", [(10, 40), (48, 200)])
def test_whitening_equals_numpy(spark, d, n):
    fine, bad = odd_rows(np.random.default_rng(d), n, d)
    got = whitening.whiten(table(spark, fine + bad)).toPandas()
    x = np.array([[math.floor(64 * v) + 1_000_000 for v in row] for _, row in fine], object)
    total, rows = x.sum(0), len(x)
    k = min(32, d)
    assert len(got) == rows * k and (got.n == rows).all() and set(got.component) == set(range(1, k + 1))
    dev = ((rows * x - total) ** 2).sum(1)
    z = (x - total / rows).astype(float)
    v = z.T @ z / rows
    e, y = np.linalg.eigh(v)
    e, y = e[::-1][:k], y[:, ::-1][:, :k]
    w = z @ y / np.sqrt(e)
    ours = {}
    for r in got.itertuples():
        ours.setdefault((None if np.isnan(r.vec_id) else int(r.vec_id), r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    sign = np.zeros(k)
    for (i, _), row, deviation in zip(fine, w, dev):
        mine = [ours[i, deviation][c + 1][0] for c in range(k)]
        sign = np.where(sign == 0, np.sign(np.array(mine) * row), sign)
        assert np.allclose(np.array(mine) * sign, row, atol=1e-9)
    shares = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(shares, e / np.trace(v), rtol=1e-9) and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_whitening_of_few_rows(spark):
    fine, bad = odd_rows(np.random.default_rng(0), 6, 12)
    assert whitening.whiten(table(spark, bad[:2])).count() == 0
    assert whitening.whiten(table(spark, fine).where("false")).count() == 0
    assert whitening.whiten(table(spark, [(1, [0.5, 0.25])] * 4)).count() == 0
    got = whitening.whiten(table(spark, fine[:4])).toPandas()  # three directions carry all spread
    assert set(got.component) == {1, 2, 3} and got.identity_error[0] < 1e-9 and abs(got[got.vec_id == 0].explained.sum() - 1) < 1e-9


def test_deviations_beyond_a_long_are_null_and_the_shares_stay_right(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(0, 1e9, 4)]) for i in range(50)]
    got = whitening.whiten(table(spark, rows)).toPandas()
    assert got.deviation.isna().all() and len(got) == 200 and abs(got[got.vec_id == 0].explained.sum() - 1) < 1e-6 and got.identity_error[0] < 1e-6


# ---- sort-means


def whole(v):
    return int(v) * 1024 if abs(v) >= 2**53 else math.floor(v * 1024)


def plain(rows, k=8, rounds=10):
    x = [(i, [whole(c) for c in v]) for i, v in rows]
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [r[1] for r in sorted(x, key=key)[:k]]
    for r in range(rounds + 1):
        at = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in x]
        if r < rounds:
            for j in range(len(centroids)):
                mine = [v for (_, v), (_, c) in zip(x, at) if c == j]
                if mine:
                    centroids[j] = [sum(col) // len(mine) for col in zip(*mine)]
    of = [sum(d for d, c in at if c == j) for j in range(len(centroids))]
    fit = lambda v: v if v < 2**63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, fit(d), fit(of[c]), fit(sum(of)), sha[c]) for (i, _), (d, c) in zip(x, at)), key=str)


def ours(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("n, scale", [(150, 1), (150, 0.01), (5, 1), (60, 1e6), (40, 1e12), (40, 1e30)])
def test_sort_means_equals_plain_k_means(spark, n, scale):
    """Small scales make ties, large ones integers beyond a long; the odd rows count as the contract says."""
    fine, bad = odd_rows(np.random.default_rng(n), n, 64)
    fine = [(i, [float(np.float32(x * scale)) for x in v]) for i, v in fine]
    bad = [b for b in bad if b[0] != 907] + [(907, [0.5] * 66)]
    assert ours(sort_means.digest(table(spark, fine + bad))) == plain(fine)


def test_sort_means_of_no_rows(spark):
    assert sort_means.digest(table(spark, [(1, None), (2, [0.5] * 63)])).count() == 0
    assert ours(sort_means.digest(table(spark, [(1, [0.5] * 64)]))) == plain([(1, [0.5] * 64)])


def test_scan_stops_strictly_beyond_twice_the_distance():
    """A tie at exactly twice the distance still goes to the smaller number; far centroids aren't looked at."""
    order = sort_means.Order([[0, 0], [8, 0], [100, 0], [200, 0]])
    x, before = np.array([[4, 0], [5, 0], [1, 0]]), np.array([1, 1, 0])
    cluster, distance, taken = order.assign(x, before)
    assert cluster.tolist() == [0, 1, 0] and distance.tolist() == [16, 9, 1] and taken == 3 + 1
    rng = np.random.default_rng(2)
    centres = rng.integers(-5000, 5000, (8, 16))
    x = centres[rng.integers(0, 8, 2000)] + rng.integers(-40, 41, (2000, 16))
    order = sort_means.Order(centres.tolist())
    cluster, distance, _ = order.assign(x, np.zeros(2000, np.int64))
    d = ((x[:, None] - centres) ** 2).sum(-1)
    assert (cluster == d.argmin(1)).all() and (distance == d.min(1)).all()
    again, _, taken = order.assign(x, cluster)
    assert (again == cluster).all() and taken < 1.1 * len(x)


def test_queries_do_not_depend_on_partitions(spark):
    fine, _ = odd_rows(np.random.default_rng(7), 90, 64)
    assert ours(sort_means.digest(table(spark, fine).repartition(1))) == ours(sort_means.digest(table(spark, fine).repartition(7)))
