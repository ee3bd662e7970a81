import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts, entries, rounds):
    """``rows``: (id, vector, label) with sound vectors."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, [math.floor(1024 * x) for x in r[1]]))
    v = [[math.floor(1024 * x) for x in r[1]] for r in rows]
    width = len(v[0]) // parts
    cut = [[x[p * width : (p + 1) * width] for p in range(parts)] for x in v]
    started = [c for r, c in zip(rows, cut, strict=True) if r[0] is not None][:entries]
    books = [[list(c[p]) for c in started] for p in range(parts)]

    def nearest(part, book):
        away = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in book]
        return away.index(min(away)), min(away)

    for _ in range(rounds):
        for p in range(parts):
            given = [[] for _ in books[p]]
            for c in cut:
                given[nearest(c[p], books[p])[0]].append(c[p])
            books[p] = [[sum(col) // len(g) for col in zip(*g, strict=True)] if g else e for g, e in zip(given, books[p], strict=True)]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for _, d in f) for f in found]
    by_label = {}
    for r, e in zip(rows, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], "".join(f"{i:02x}" for i, _ in f), e, by_label[r[2]], sha) for r, f, e in zip(rows, found, errors, strict=True)]


def key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


@pytest.mark.parametrize("entries", [1, 5, 40])
def test_equal_to_brute_force(spark, entries):
    rng = np.random.default_rng(entries)
    centres = rng.normal(size=(6, 8))
    rows = [(int(i), (centres[i % 6] + 0.2 * rng.normal(size=8)).tolist(), [None, 0, 1, 2][i % 4]) for i in rng.permutation(400)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(200)]  # one vector very often
    rows += [(2000 + i, [0.0] * 8, None) for i in range(3)] + [(5, rows[3][1], 2), (None, rows[7][1], 0)]
    odd = [(3000, None, 1), (3001, [1.0, None] * 4, 1), (3002, [float("nan")] * 8, 0), (3003, [float("inf")] * 8, 0), (3004, [], 1), (3005, [1.0] * 7, 1), (3006, [1e300] * 8, 1)]
    df = spark.createDataFrame(rows + odd, SCHEMA).withColumn("code", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("v", F.lit(1))
    found = codes.vector_codes(df.repartition(5), parts=2, entries=entries, rounds=3)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(brute(rows, 2, entries, 3), key=key)


def test_trees_give_every_point_its_nearest_entry_once():
    rng = np.random.default_rng(3)
    for n, m, spread in ((1, 1, 5), (17, 3, 2), (1000, 64, 1), (1000, 64, 300), (700, 256, 1000)):
        points = rng.integers(-3, 4, (n, 4)) + spread * rng.integers(-3, 4, (n, 1))
        entries = rng.integers(-3, 4, (m, 4)) + spread * rng.integers(-3, 4, (m, 1))
        entries[m // 2] = entries[0]  # a tie
        tree = codes.Tree(points, 16)
        found = np.full(n, -1)
        for starts, ends, entry in codes.nearest(tree, entries):
            for a, b, e in zip(starts, ends, entry, strict=True):
                assert (found[a:b] == -1).all()
                found[a:b] = e
        assert found.tolist() == ((points[tree.order][:, None] - entries) ** 2).sum(axis=2).argmin(axis=1).tolist()


def test_large_components_are_exact():
    rng = np.random.default_rng(4)
    rows, entries = rng.integers(-(1 << 26), 1 << 26, (50, 16)), rng.integers(-(1 << 26), 1 << 26, (9, 16))
    assert (codes.distances(rows, entries) == ((rows[:, None] - entries) ** 2).sum(axis=2)).all()


def test_tables_without_usable_vectors(spark):
    assert codes.vector_codes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert codes.vector_codes(spark.createDataFrame([(1, None, 1), (2, [], 1)], SCHEMA)).count() == 0
    assert codes.vector_codes(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], SCHEMA)).count() == 0  # cannot be cut into four
    one = codes.vector_codes(spark.createDataFrame([(1, [1.0, 2.0, 3.0, -0.5], None)], SCHEMA)).collect()
    assert [tuple(r)[:4] for r in one] == [(1, "00000000", 0, 0)]
