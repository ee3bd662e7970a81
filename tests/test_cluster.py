import numpy as np
import pytest

from murmuration.operators import cluster


def plane(spark, xy):
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)]
    return spark.createDataFrame(rows, "id long, x double, y double").repartition(4)


def brute_dbscan(xy, eps, m):
    near = ((xy[:, None] - xy[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= m
    comp = np.full(len(xy), -1)
    for i in range(len(xy)):
        if core[i] and comp[i] < 0:
            stack = [i]
            comp[i] = i
            while stack:
                j = stack.pop()
                for n in np.flatnonzero(near[j] & core & (comp < 0)):
                    comp[n] = i
                    stack.append(n)
    label = comp.copy()
    for i in np.flatnonzero(~core):
        touched = comp[near[i] & core]
        label[i] = touched.min() if len(touched) else -1
    names = {c: k for k, c in enumerate(sorted(set(label) - {-1}))}
    return {i: names.get(c, -1) for i, c in enumerate(label)}


def clouds(seed, n):
    """Scattered points, a chain, a spot that holds a third of them, and many copies of one point."""
    rng = np.random.default_rng(seed)
    spread = rng.uniform(-2, 2, (n // 3, 2))
    spot = rng.normal(0.5, 0.08, (n // 3, 2))
    chain = np.c_[np.linspace(-2, 2, n // 6), np.full(n // 6, -1.7)]
    copies = np.tile([[1.5, 1.5]], (n // 6, 1))
    return np.concatenate([spread, spot, chain, copies])


@pytest.mark.parametrize("seed,n,eps,m", [(0, 600, 0.1, 4), (1, 600, 0.05, 4), (2, 300, 0.29, 4), (3, 300, 0.2, 8), (4, 240, 0.02, 2)])
def test_dbscan(spark, seed, n, eps, m):
    xy = clouds(seed, n)
    got = {r.id: r.label for r in cluster.dbscan(plane(spark, xy), "id", eps, m).collect()}
    assert got == brute_dbscan(xy, eps, m)


def test_spread_joins_give_the_same(spark, monkeypatch):
    """The path for inputs too large for one task, forced on a small one with a hot spot."""
    from murmuration.operators import skew

    monkeypatch.setattr(skew, "PLAIN_ROWS", 0)
    xy = clouds(5, 240)
    got = {r.id: r.label for r in cluster.dbscan(plane(spark, xy), "id", 0.1, 4).collect()}
    assert got == brute_dbscan(xy, 0.1, 4)
    want = np.sort(np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1)), axis=1)[:, :4]
    for r in cluster.knn_distances(plane(spark, xy), "id", 4).collect():
        assert r.distance == pytest.approx(want[r.id, r.nn], abs=1e-12)


def test_dbscan_all_noise(spark):
    xy = np.array([[0.0, 0], [10, 0], [20, 0]])
    got = {r.id: r.label for r in cluster.dbscan(plane(spark, xy), "id", 1.0, 2).collect()}
    assert got == {0: -1, 1: -1, 2: -1}


@pytest.mark.parametrize("seed,n,k", [(0, 600, 4), (1, 120, 7), (2, 18, 4)])
def test_knn(spark, seed, n, k):
    xy = clouds(seed, n)
    want = np.sort(np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1)), axis=1)[:, :k]
    got = cluster.knn_distances(plane(spark, xy), "id", k).collect()
    assert len(got) == len(xy) * k
    for r in got:
        assert r.distance == pytest.approx(want[r.id, r.nn], abs=1e-12)


def test_knn_same_place(spark):
    got = cluster.knn_distances(plane(spark, np.zeros((10, 2))), "id", 4).collect()
    assert len(got) == 40 and {r.distance for r in got} == {0.0}


def test_knn_fewer_points_than_neighbours(spark):
    got = cluster.knn_distances(plane(spark, np.array([[0.0, 0], [3, 4]])), "id", 4).collect()
    assert sorted((r.id, r.nn, r.distance) for r in got) == [(0, 0, 0.0), (0, 1, 5.0), (1, 0, 0.0), (1, 1, 5.0)]


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b").union(spark.range(3).selectExpr("1000 + id", "1001"))
    found = {r.node: r.component for r in cluster.connected_components(edges).collect()}
    assert {found[i] for i in range(301)} == {0} and {found[i] for i in (1000, 1001, 1002)} == {1000}


def test_components_of_a_star(spark):
    edges = spark.range(1, 2000).selectExpr("5000L AS a", "id AS b")
    found = {r.component for r in cluster.connected_components(edges).collect()}
    assert found == {1}


def test_a_far_point_does_not_crowd_the_others(spark):
    """One point far away leaves the others as many cells as before, and the distances right."""
    near = [(i, (i * 37 % 101) / 100, (i * 53 % 97) / 100) for i in range(300)]
    rows = spark.createDataFrame([*near, (300, 1e9, 1e9)], "id long, x double, y double")
    got = {(r.id, r.nn): r.distance for r in cluster.knn_distances(rows, "id", 3).collect()}
    for i, x, y in near[::29]:
        nearest = sorted(((x - a) ** 2 + (y - b) ** 2) ** 0.5 for _, a, b in near)[:3]
        assert [got[i, nn] for nn in range(3)] == pytest.approx(nearest)
