"""The pipeline's stages against plain versions of what each decides, on a small corpus."""

import random

import corpus_pipeline
import pytest
from llm_helpers import documents, words
from pyspark.sql import functions as F

from murmuration.llm import langid, minhash, packing, quality, suffix
from murmuration.llm.queries import TOKENIZER
from murmuration.session import cut_lineage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage returns, written in between as ``run`` does."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    rng = random.Random(9)
    passage = " ".join(words(rng, 100))
    extra = [(10_001, None), (10_002, "12 34 %%"), (10_003, " ".join(words(rng, 30)) + " " + passage), (10_004, " ".join(words(rng, 30)) + " " + passage)]
    docs = docs.unionByName(documents(spark, [t for _, t in extra], [i for i, _ in extra]).withColumn("lang", F.lit(None).cast("string")))
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        out.append(cut_lineage(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def test_columns_and_order(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_dedup", "suffix_dedup", "packing"]
    assert all(k.columns == kept[0].columns and k.schema["n_chars"].dataType == kept[0].schema["n_chars"].dataType for k in kept[1:5])


def test_languages(spark, kept):
    scored = langid.predict(kept[0], langid.learn(kept[0])).collect()
    want = sorted(r.doc_id for r in scored if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_LANGUAGE_SCORE)
    assert sorted(r.doc_id for r in kept[1].collect()) == want
    assert 10_001 not in want and 10_002 not in want and len(want) >= 195


def test_quality(spark, kept):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality.score(kept[1], quality.learn(kept[1], labels)).collect()
    assert sorted(r.doc_id for r in kept[2].collect()) == sorted(r.doc_id for r in scored if r.score >= corpus_pipeline.LEAST_QUALITY)
    good = {r.doc_id for r in labels.where("quality = 1").collect()} & {r.doc_id for r in kept[1].collect()}
    assert len(good - {r.doc_id for r in kept[2].collect()}) <= 0.03 * len(good)


def test_near_copies(spark, kept):
    near = minhash.near_copies(kept[2]).where("kept").collect()
    assert sorted(r.doc_id for r in kept[3].collect()) == sorted(r.doc_id for r in near)


def test_repeats(kept):
    before = {r.doc_id: r.text.encode() for r in kept[3].collect()}
    after = {r.doc_id: r for r in kept[4].collect()}
    assert set(before) == set(after)
    seen = {}
    for data in before.values():
        for s in range(len(data) - 399):
            key = data[s : s + 400]
            seen[key] = seen.get(key, 0) + 1
    cut = 0
    for i, data in before.items():
        covered = bytearray(len(data))
        for s in range(len(data) - 399):
            if seen[data[s : s + 400]] > 1:
                covered[s : s + 400] = b"\1" * 400
        spans, at = [], 0
        while (low := covered.find(1, at)) >= 0:
            at = covered.find(0, low) if covered.find(0, low) >= 0 else len(data)
            spans.append({"low": low, "high": at})
        cut += bool(spans)
        assert after[i].text == suffix.cut(data.decode(), spans, whole_characters=True).decode()
        assert after[i].n_chars == len(after[i].text)
    assert cut >= 2


def test_packing(kept):
    coder = packing.ChunkIds(TOKENIZER)
    pieces = kept[5].collect()
    tokens = {r.doc_id: len(coder.texts([r.text])[0]) // 4 + 1 for r in kept[4].collect()}
    assert {r.doc_id for r in pieces} == set(tokens)
    assert all(sum(p.length for p in pieces if p.doc_id == i) == n for i, n in list(tokens.items())[:40])
    assert len({r.sequence_id for r in pieces}) <= sum(tokens.values()) / 4096 + 2


def test_stages_with_nothing(spark):
    empty = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []


def test_repeated_ids_go_only_with_their_own_copies(spark):
    rng = random.Random(4)
    one, two, three = (" ".join(words(rng, 60)) for _ in range(3))
    docs = documents(spark, [one, two, two, three, three + " tail", one], [7, 7, 7, 7, 9, None])
    found = corpus_pipeline.keep_one_of_near_copies(spark, docs, SF).collect()
    texts = sorted((r.doc_id or 0, r.text) for r in found)
    first = min(one, two, three)
    assert (0, one) in texts and (7, first) in texts and {t for i, t in texts if i == 7} >= {one, two}
    assert len(texts) == 4 and len([t for _, t in texts if t.startswith(three)]) == 1


def test_clashing_names_and_repeated_ids(spark):
    """Columns named like those used inside, and rows that repeat an id, go through near-dedup and the cutting of repeats."""
    rng = random.Random(2)
    same, other = " ".join(words(rng, 60)), " ".join(words(rng, 60))
    docs = documents(spark, [same, same, other, None, ""], [1, 1, 1, 4, None], extra=["row", "id", "key", "copied", "spans", "_key", "n", "before", "rep"])
    kept = cut_lineage(corpus_pipeline.keep_one_of_near_copies(spark, docs, SF), "test-clash")
    assert kept.columns == docs.columns
    assert sorted(r.text or "" for r in kept.collect()) == sorted([same, other, "", ""]) and kept.where("`_key` = 'clash' AND id = 'clash'").count() == 4
    cut = corpus_pipeline.cut_repeats(spark, kept, SF)
    assert cut.columns == docs.columns and cut.count() == 4
    assert corpus_pipeline.cut_repeats(spark, corpus_pipeline.keep_one_of_near_copies(spark, docs.where("doc_id > 99"), SF), SF).count() == 0
