"""Near copies against a comparison of all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
from llm_helpers import documents, odd_texts, words

from murmuration.llm import minhash


def brute(texts, ids, k=5, percent=75):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    name = list(range(len(texts)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same = ids[i] == ids[j]
            if same or both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                name[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(texts)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return sorted((ids[i], len(sets[i]), least[root(i)], least[root(i)] == ids[i]) for i in range(len(texts)))


def test_equals_all_pairs(spark):
    texts = odd_texts()
    texts += [t.upper() for t in texts[10:12]]
    ids = [100 - i for i in range(len(texts))]
    found = sorted(tuple(r) for r in minhash.near_copies(documents(spark, texts, ids, ["n", "node", "component_id", "kept"])).collect())
    assert found == brute(texts, ids)


def test_crowded_regions_and_many_pieces(spark, monkeypatch):
    rng = random.Random(3)
    base, texts = words(rng, 60), []
    for _ in range(150):  # around the threshold, so that many pairs are just above or below it
        copy = list(base)
        for at in rng.sample(range(60), rng.randint(0, 6)):
            copy[at] = "".join(rng.choice("abcdef") for _ in range(5))
        texts.append(" ".join(copy))
    monkeypatch.setattr(minhash, "FEW", 40)
    monkeypatch.setattr(minhash, "PIECE_ROWS", 16)
    found = sorted(tuple(r) for r in minhash.near_copies(documents(spark, texts)).collect())
    assert found == brute(texts, list(range(len(texts))))


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(words(random.Random(1), 50))
    found = minhash.near_copies(documents(spark, [text, text, text, text, "other"], [None, 7, 7, 9, None])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in found) == [
        (-1, -1, True), (-1, -1, True), (7, 7, True), (7, 7, True), (9, 7, False),
    ]


def test_empty_table(spark):
    assert minhash.near_copies(documents(spark, [])).collect() == []


def test_partition_edges():
    edge = lambda tree, label, node: {"tree": tree, "label": np.array(label, ">u2").tobytes(), "node": node, "n": 10}
    edges = [edge(0, [1, 2, 3, 4, 5, 6], 1), edge(0, [1, 2, 3, 9, 9, 9], 2), edge(1, [1, 2, 3, 9, 9, 9], 3), edge(1, [2, 2, 3, 9, 9, 9], 4)]
    links, company = minhash.across_edges(edges, 75)
    assert links == [(1, 2)] and [c[2] for c in company] == [1, 2]


def test_tasks_stay_small_however_large_a_region(spark, monkeypatch):
    """Rows with equal keys in one order, no two of them linked: all are odd but one, no hash divides them."""
    monkeypatch.setattr(minhash, "FEW", 20)
    monkeypatch.setattr(minhash, "PIECE_ROWS", 20)
    label = np.array([1, 2, 3, 4, 5, 6], ">u2").tobytes()
    company = spark.createDataFrame([(0, label, i, 50) for i in range(300)], "tree int, label binary, node long, n long")
    found = minhash.regions(company, spark.createDataFrame([], "node long, component long"))
    rows = found[0] if isinstance(found, tuple) else found
    groups = {}
    for r in minhash.in_pieces(rows).collect():
        groups.setdefault((r.region, r["block"] if "block" in r else 0, r.piece), []).append((r.odd, r.node))
    assert max(map(len, groups.values())) <= 100
    met = {frozenset((a, b)) for g in groups.values() for odd, a in g if odd for other, b in g if not other and a != b}
    assert len(met) == 300 * 299 // 2


def test_crowded_regions_compare_pairs_of_the_base_depth(spark, monkeypatch):
    """A pair that no order's neighbours link and that shares no order's whole key is found in a crowded region."""
    for seed in range(5000):
        rng = random.Random(seed)
        base = words(rng, 40)
        texts = [" ".join(base), " ".join([*base[:20], "other", *base[21:]])]
        data = [t.encode() for t in texts]
        bounds = np.array([0, len(data[0]), len(data[0]) + len(data[1])])
        data = np.frombuffer(b"".join(data), np.uint8)
        sig = minhash.signatures(*minhash.shingle_sets(data, bounds, 5)).reshape(2, minhash.TREES, minhash.DEPTH)
        shared = minhash.common_prefix(sig[0], sig[1])
        if shared[: minhash.CHAIN_TREES].max() < minhash.BASE_DEPTH <= shared.max() < minhash.DEPTH and (sig[0] == sig[1]).mean() >= minhash.ESTIMATE:
            break
    else:
        raise AssertionError("no such pair")
    monkeypatch.setattr(minhash, "FEW", 0.5)  # one odd row is a crowd
    found = minhash.near_copies(documents(spark, texts)).collect()
    assert {r.component_id for r in found} == {0}


def test_every_pair_comes_up_once_over_all_orders_and_depths():
    """Rows of one region each time, none linked: a pair is a candidate exactly if it shares the base depth somewhere."""
    rng = np.random.default_rng(4)
    sig = rng.integers(0, 3, (12, minhash.TREES, minhash.DEPTH)).astype(np.uint16)
    sig[rng.random(sig.shape) < 0.6] = 0
    seen = {}
    for depth in range(minhash.DEPTH, minhash.BASE_DEPTH - 1, -1):
        for tree in range(minhash.TREES):
            prefixes = {}
            for row in range(len(sig)):
                prefixes.setdefault(sig[row, tree, :depth].tobytes(), []).append(row)
            for prefix, rows in prefixes.items():
                piece = pa.table({
                    "odd": [True] * len(rows) + [False] * len(rows), "n": [50] * (2 * len(rows)), "comp": rows + rows,
                    "region": [{"tree": tree, "prefix": prefix}] * (2 * len(rows)), "sig": [sig[r].tobytes() for r in rows + rows],
                })
                for row, others in minhash.candidates(piece, 75, depth):
                    for other in others:
                        pair = tuple(sorted((rows[row], rows[other - len(rows)])))
                        seen.setdefault(pair, set()).add((depth, tree))
    expected = set()
    for a in range(len(sig)):
        for b in range(a + 1, len(sig)):
            same = sig[a] == sig[b]
            if same.mean() >= minhash.ESTIMATE and same[:, : minhash.BASE_DEPTH].all(axis=1).any():
                expected.add((a, b))
    assert expected and set(seen) == expected
    assert all(len(places) == 1 for places in seen.values())


def test_components_tied_by_later_links(spark):
    named = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "node long, component long")
    links = spark.createDataFrame([(6, 2), (7, 9)], "a long, b long")
    found = {r.node: r.component for r in minhash.merged_components(named, links).collect()}
    assert found == {1: 1, 2: 1, 5: 1, 6: 1, 7: 7, 8: 7, 9: 7}
