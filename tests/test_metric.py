"""Neighbours in any number of dimensions against brute force."""

import numpy as np
import pytest

from murmuration.operators import metric

SCHEMA = "vec_id long, embedding array<double>"


def clustered(rng, n, d, groups=8, spread=0.05):
    centres = rng.uniform(-1, 1, (groups, d))
    return centres[rng.integers(0, groups, n)] + spread * rng.standard_normal((n, d))


def table(spark, v, ids=None):
    ids = range(len(v)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if x is None else [float(e) for e in x]) for i, x in zip(ids, v, strict=True)], SCHEMA).repartition(5)


def brute_knn(v, ids, k):
    out = {}
    for i, x in zip(ids, v, strict=True):
        near = sorted((float(np.sqrt(((x - y) ** 2).sum())), j) for j, y in zip(ids, v, strict=True) if j != i)
        out[i] = [(0.0, i), *near][:k]
    return out


@pytest.mark.parametrize("d", [1, 2, 3, 64])
def test_k_nearest_with_small_tiles(spark, monkeypatch, d):
    monkeypatch.setattr(metric, "CELL_ROWS", 20)
    monkeypatch.setattr(metric, "TILE_ROWS", 32)
    rng = np.random.default_rng(d)
    v = clustered(rng, 400, d)
    v[50:80] = v[0]  # one position often
    v[90:92] = v[91]
    ids = rng.permutation(1000)[:400]
    found, work = metric.knn(table(spark, v, ids), 5)
    got = {}
    for r in found.collect():
        got.setdefault(r.vec_id, {})[r.nn] = (r.distance, r.neighbour)
    want = brute_knn(v, ids, 5)
    assert set(got) == set(want)
    for i, near in want.items():
        assert [got[i][n][1] for n in range(5)] == [x[1] for x in near]
        assert np.allclose([got[i][n][0] for n in range(5)], [x[0] for x in near])
    assert work["positions"] == 400 - 30 - 1 and work["cells"] > 10
    if d == 3:  # cells that cannot hold a nearer point are not visited
        assert work["visits"] < 0.4 * work["positions"] * work["cells"]


def brute_dbscan(v, ids, eps, least):
    near = np.sqrt(((v[:, None] - v) ** 2).sum(axis=2)) <= eps
    core = near.sum(axis=1) >= least
    cluster = np.full(len(v), -1)
    for i in np.argsort(ids):
        if core[i] and cluster[i] < 0:
            todo, cluster[i] = [i], ids[i]
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core & (cluster < 0)):
                    cluster[j] = ids[i]
                    todo.append(j)
    for i in np.flatnonzero(~core):
        touched = cluster[near[i] & core]
        cluster[i] = touched.min() if len(touched) else -1
    return {int(i): (int(c), bool(x)) for i, c, x in zip(ids, cluster, core, strict=True)}


@pytest.mark.parametrize(("d", "eps"), [(2, 0.06), (3, 0.09), (64, 0.57)])
def test_dbscan_with_small_tiles(spark, monkeypatch, d, eps):
    monkeypatch.setattr(metric, "CELL_ROWS", 20)
    monkeypatch.setattr(metric, "TILE_ROWS", 32)
    rng = np.random.default_rng(10 + d)
    v = np.concatenate([clustered(rng, 300, d), rng.uniform(-1, 1, (60, d))])
    v[20:26] = v[0]
    ids = rng.permutation(1000)[: len(v)]
    want = brute_dbscan(v, ids, eps, 4)
    assert len({c for c, _ in want.values()}) > 2 and any(c >= 0 and not x for c, x in want.values()) and any(c < 0 for c, _ in want.values())
    got = {r.vec_id: (r.cluster, r.core) for r in metric.dbscan(table(spark, v, ids), eps, 4).collect()}
    assert got == want


def test_few_unusable_and_unequal_vectors(spark):
    rows = [[1.0, 2.0], [1.0, 2.0], None, [], [float("nan"), 1.0], [3.0], [0.0, 0.0], [-0.0, 0.0]]
    found, _ = metric.knn(table(spark, rows), 3)
    got = {}
    for r in found.collect():
        got.setdefault(r.vec_id, []).append((r.nn, r.neighbour, round(r.distance, 6)))
    assert set(got) == {0, 1, 5, 6, 7} and got[5] == [(0, 5, 0.0)]
    assert sorted(got[1]) == [(0, 1, 0.0), (1, 0, 0.0), (2, 6, 2.236068)] and sorted(got[7])[1] == (1, 6, 0.0)
    clusters = {r.vec_id: (r.cluster, r.core) for r in metric.dbscan(table(spark, rows), 0.1, 2).collect()}
    assert clusters == {0: (0, True), 1: (0, True), 5: (-1, False), 6: (6, True), 7: (6, True)}
    empty = table(spark, rows).where("vec_id < 0")
    assert metric.knn(empty, 3)[0].count() == 0 and metric.dbscan(empty, 0.1, 2).count() == 0


def test_visitors_travel_to_tiles_and_not_to_cells(spark, monkeypatch):
    monkeypatch.setattr(metric, "CELL_ROWS", 20)
    monkeypatch.setattr(metric, "TILE_ROWS", 128)
    v = np.random.default_rng(5).standard_normal((400, 64))  # distances alike, so every cell may hold a near point
    ids = np.arange(400)
    found, work = metric.knn(table(spark, v), 4)
    assert work["cells"] == 20 and work["visits"] <= 400 * 5  # 400 * 20 when each cell was a visit of its own
    got = {(r.vec_id, r.nn): r.neighbour for r in found.collect()}
    assert got == {(i, n): near[1] for i, x in brute_knn(v, ids, 4).items() for n, near in enumerate(x)}


def test_known_sets_are_not_visited_again(spark, monkeypatch):
    monkeypatch.setattr(metric, "CELL_ROWS", 20)
    monkeypatch.setattr(metric, "TILE_ROWS", 64)
    visits, plain = [], metric.visit

    def counted(*args, **options):
        met, n = plain(*args, **options)
        visits.append(n)
        return met, n

    monkeypatch.setattr(metric, "visit", counted)
    rng = np.random.default_rng(6)
    v = rng.standard_normal((400, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    got = {r.vec_id: (r.cluster, r.core) for r in metric.dbscan(table(spark, v), 1.4, 4).collect()}
    assert got == brute_dbscan(v, np.arange(400), 1.4, 4)
    count, beside, apart, border = visits  # 400 * 20 twice when all visited all
    assert count == border == apart == 0 and beside <= 400


def test_cells_share_tiles():
    block, tiles = metric.packed(np.array([[0.0], [9.0], [1.0], [8.0], [2.0]]), np.array([3, 4, 3, 30, 2]), 8)
    assert block.tolist() == [0, 2, 0, 1, 0] and tiles.tolist() == [1, 4, 1]
    label = np.arange(6)
    tied = metric._united(label, np.array([0, 5, 4, 1]), np.array([4, 4, 1, 0]))
    assert label.tolist() == [0, 0, 2, 3, 0, 0] and sum(len(a) for a, _ in tied) == 3
