import random
import re
from collections import Counter, defaultdict

import numpy as np
from llm_helpers import documents, odd_texts
from pyspark.sql import functions as F

from murmuration.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=3, top=200):
    counts, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
        sources[lang].add(source)
    out = []
    for lang, names in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = sum((counts[lang, s] for s in names), Counter())

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p = {s: shares(counts[lang, s]) for s in names}
        q = shares(whole)
        for s in names:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in names if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def table(spark, rows):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string")
    return docs.withColumn("term", F.lit("clash")).withColumn("count", F.lit(3)).withColumn("block", F.lit("x"))


def test_equal_to_brute_force_with_small_blocks_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 7)
    monkeypatch.setattr(divergence, "TILE_GROUPS", 2)
    rng = random.Random(1)
    words = ["".join(rng.choice("abcÉüß日") for _ in range(rng.randint(1, 2))) + rng.choice(["", "A", "b"]) for _ in range(60)]
    rows = []
    for _ in range(150):
        text = rng.choice([" ", "1", "-", "\x00", "[", "{"]).join(rng.choices(words, k=rng.randint(0, 40)))
        rows.append((rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", "ä", None, ""]), text))
    rows += [("en", "hot", "same text here")] * 80 + [("fr", "x", "once only"), ("fr", "y", None), ("it", "z", "")]
    found = sorted(tuple(r) for r in divergence.source_divergence(table(spark, rows)).collect())
    assert found == brute(rows)
    assert ("fr", "x", "pair", "y", 0, 1) in found


def test_odd_texts_and_a_low_rank_limit(spark):
    rows = [("en", f"s{i % 3}", t) for i, t in enumerate(odd_texts() * 3)]
    docs = table(spark, rows)
    found = sorted(tuple(r) for r in divergence.source_divergence(docs, top=5).collect())
    assert found == brute(rows, top=5)


def test_empty_table(spark):
    assert divergence.source_divergence(documents(spark, [])).count() == 0


def test_shares_are_exact_for_large_counts():
    count, total = np.array([0, 10**12, 8 * 10**15 - 1]), 8 * 10**15 + 11
    assert divergence.share(count, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in count]


def test_gallop_places_like_binary_search():
    rng = np.random.default_rng(0)
    for n, m in ((0, 5), (5, 0), (3, 10_000), (900, 1000), (1000, 3), (5000, 5000)):
        wanted, ids = np.unique(rng.integers(0, 20_000, n)), np.unique(rng.integers(0, 20_000, m))
        assert divergence.gallop(wanted, ids).tolist() == np.searchsorted(ids, wanted).tolist()
