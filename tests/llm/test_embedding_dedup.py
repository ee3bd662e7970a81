import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, least=0.9):
    """``rows``: (id, vector); by rows, since ids may repeat."""
    n = len(rows)
    sound = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) and i is not None for i, v in rows]
    links = [[] for _ in rows]
    for a in range(n):
        for b in range(n):
            if a != b and sound[a] and sound[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= least:
                    links[a].append(b)
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        component = min(rows[b][0] for b in seen) if rows[a][0] is not None else None
        out.append((rows[a][0], len(links[a]), component, component is None or component == rows[a][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("tile", [4096, 16])
def test_equal_to_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE_ROWS", tile)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 10))
    rows = [(int(i), (centres[i % 12] + 0.33 * rng.normal(size=10)).tolist()) for i in rng.permutation(260)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # one vector very often
    rows += [(2000 + i, (np.array(rows[1][1]) * (i + 1)).tolist()) for i in range(3)]  # multiples
    rows += [(3000, None), (3001, [0.0] * 10), (3002, [1.0, None] * 5), (3003, [float("nan")] * 10), (3004, [float("inf")] * 10), (3005, [])]
    rows += [(3006, [1.0, 2.0]), (3007, [2.0, 4.0]), (None, rows[0][1]), (3, rows[5][1]), (4000, [-0.0] + rows[9][1][1:]), (4001, [0.0] + rows[9][1][1:])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumn("node", F.lit(1)).withColumn("name", F.lit("clash")).withColumn("cell", F.lit(1))
    found = embedding_dedup.near_vectors(df)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)


def test_bounds_hold_and_close_calls_are_computed_again():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 64))
    near = base + rng.normal(size=(300, 64)) * 0.48  # cosines around 0.9
    a, b = (embedding_dedup.Tile([v.tobytes() for v in x]) for x in (base, near))
    got = embedding_dedup.linked(a, slice(0, 300), b, 0.9)
    cosine = (base @ near.T) / np.outer(np.linalg.norm(base, axis=1), np.linalg.norm(near, axis=1))
    assert (got == (cosine >= 0.9)).all() and 50 < got.sum() < 250
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    codes, scale, error = embedding_dedup.quantise(unit)
    assert (np.linalg.norm(unit - scale[:, None] * codes, axis=1) <= error).all()


def test_a_tile_gives_out_fewer_links_than_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (np.ones(8) + 0.01 * rng.normal(size=8)).tolist(), 0) for i in range(500)]
    found = embedding_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r["n_links"] == 499 and r["component_id"] == 0 for r in found)


def test_empty_table(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
