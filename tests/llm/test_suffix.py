"""Repeated strings against a table of all strings."""

import random
import time
from collections import Counter
from hashlib import sha256

import pytest
from llm_helpers import documents, odd_texts, words
from pyspark.sql import functions as F

from murmuration import session
from murmuration.llm import suffix
from murmuration.session import scratch_made


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[s : s + length] for b in data for s in range(len(b) - length + 1))
    out = []
    for b in data:
        covered = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                covered[s : s + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        out.append((len(b), sum(covered), len([r for r in bytes(covered).split(b"\0") if r]), sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [50, 100, 400])
def test_equals_all_strings(spark, length):
    texts = odd_texts(1)
    found = suffix.dedup_digest(documents(spark, texts, extra=["key", "sha", "spans"]), length=length).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in found] == brute(texts, length)


def test_null_ids_and_empty_table(spark):
    found = suffix.dedup_digest(documents(spark, ["a" * 401, "b", None], [None, None, 3]))
    assert sorted((r.n_bytes, r.n_removed) for r in found.collect()) == [(0, 0), (1, 0), (401, 401)]
    assert suffix.dedup_digest(documents(spark, [])).collect() == []


def test_characters_stay_whole(spark):
    texts = ["é" + "ab" * 100 + "é" + str(i) for i in range(3)] + [None, "short"]
    docs = documents(spark, texts)
    found = suffix.without_repeats(docs, length=60)
    assert found.columns == docs.columns
    assert [r.text for r in found.orderBy("doc_id").collect()] == ["0", "1", "2", None, "short"]


def test_sampling_is_alike_for_equal_strings():
    import numpy as np

    rng = np.random.default_rng(0)
    common = rng.integers(97, 100, 700).astype(np.uint8)
    a = np.concatenate([rng.integers(97, 100, 333).astype(np.uint8), common])
    b = np.concatenate([common, rng.integers(97, 100, 99).astype(np.uint8)])
    buckets = []
    for data in (a, b):
        _, bucket, _, low, high, _ = suffix.blocks_of(data, np.array([0, len(data)]), 400)
        buckets.append({s: n for n, x, y in zip(bucket.tolist(), low, high, strict=True) for s in range(x, y + 1)})
        assert sorted(buckets[-1]) == list(range(len(data) - 399))
    assert all(buckets[0][333 + s] == buckets[1][s] for s in range(301))


def test_removed_strings_are_gone(spark):
    docs = documents(spark, odd_texts(2))
    left = suffix.without_repeats(docs, length=50).where(F.octet_length("text") > 0)
    assert left.join(docs.withColumnRenamed("text", "old"), "doc_id").where(F.octet_length("text") > F.octet_length("old")).count() == 0


def test_tables_on_the_way_go(spark):
    rng = random.Random(77)
    passage = " ".join(words(rng, 120))
    docs = documents(spark, [" ".join(words(rng, 20)) + passage + " ".join(words(rng, n)) for n in (5, 9, 40)])
    before = scratch_made(spark)
    kept = suffix.without_repeats(docs)
    left = [p.rsplit("/", 1)[-1].rsplit("-", 1)[0] for p in session._MADE[spark.sparkContext.applicationId][before:]]
    assert sorted(left) == ["spans", "touched", "touched-rows"]  # nothing of the search for repeats stays on disk
    assert all(passage not in r.text for r in kept.collect())


def test_tables_and_shuffles_on_the_way_go_early(spark, monkeypatch):
    rng = random.Random(5)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(700))
    texts = [f"{i} {''.join(rng.choice('stuvwxyz ') for _ in range(300))}{shared[i:]} end {i}" for i in range(40)]
    docs = session.cut_lineage(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "docs")
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles() -> int:
        return sum("shuffle_" in f for f in files.getAllFiles().mkString("|").split("|"))

    session.release_shuffles(spark)
    time.sleep(1)
    labels, before, real, held = [], shuffles(), session.cut_lineage, {}

    def seen(df, label):
        labels.append(label)
        at = real(df, label)
        kinds = {p.rsplit("/", 1)[-1].rsplit("-", 1)[0] for p in session._MADE[spark.sparkContext.applicationId]}
        held.setdefault(label, kinds)
        return at

    monkeypatch.setattr(suffix, "cut_lineage", seen)
    left = suffix.without_repeats(docs).select("text").collect()
    assert sum(len(r.text) for r in left) < sum(map(len, texts)) - 40 * 600
    assert "texts" not in labels and "blocks" not in held["marked"] and "shared-buckets" not in held["opened"]
    session.release_shuffles(spark)
    for _ in range(50):  # Spark deletes them beside the jobs
        if shuffles() <= before:
            break
        time.sleep(0.2)
    assert shuffles() <= before
