"""The saved search index against the search that weighs the whole corpus."""

import random

import pytest

from murmuration.operators import search_index
from murmuration.operators.search import document_search
from murmuration.operators.search_index import SearchIndex, build_index
from murmuration.session import scratch_path


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    terms = [f"w{i}" for i in range(60)]
    rows = [(i, ["all"] + [terms[min(int(rng.expovariate(0.1)), 59)] for _ in range(2 ** rng.randint(0, 6))]) for i in range(400)]
    rows += [(400 + i, ["all", "w3", "twin"]) for i in range(30)]  # ties
    rows += [(900, []), (901, None)]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>").selectExpr("doc_id", "concat('text ', doc_id) AS text", "tokens")
    path = scratch_path(spark, "index")
    build_index(docs, path, block_docs=8, buckets=16)
    return docs, SearchIndex(spark, path)


@pytest.mark.parametrize("terms", [["w3", "twin"], ["all"], ["w1", "w1", "w40"], ["w50", "unheard"]])
def test_same_as_the_search_without_an_index(corpus, terms):
    docs, index = corpus
    found = [(r.doc_id, round(r.similarity, 9)) for r in index.search(terms, 12).collect()]
    wanted = sorted(((r.doc_id, round(r.similarity, 9)) for r in document_search(docs, terms, 12).collect()), key=lambda r: (-r[1], r[0]))
    assert found == wanted


def test_unknown_terms_find_nothing(corpus):
    _, index = corpus
    assert index.search(["unheard"], 3).collect() == [] and index.search([], 3).collect() == []


def test_only_blocks_that_may_hold_a_hit_are_opened(corpus):
    _, index = corpus
    _, bounds, opened = index.open_blocks(["w3", "twin"], 3)
    assert 0 < opened.count() < bounds.count()


def test_a_search_reads_the_folders_of_its_terms(corpus):
    _, index = corpus
    plan = index.of_terms(index.postings, ["w3"]).select("most")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "term,w3" in plan and "doc_id" not in plan


def test_empty_corpus(spark):
    path = scratch_path(spark, "index")
    build_index(spark.createDataFrame([], "doc_id long, tokens array<string>"), path)
    assert SearchIndex(spark, path).search(["garlic"], 3).collect() == []


def test_postings_are_shuffled_once(spark, monkeypatch):
    """Rows that share an id or have none; and the plan that writes the postings."""
    rows = [(1, ["a", "b"]), (1, ["a", "c", "c"]), (2, ["a"]), (None, ["a", "b"]), (3, ["b", "d", "e", "f", "g"])]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    plans, plain = [], search_index.tfidf_smooth
    monkeypatch.setattr(search_index, "tfidf_smooth", lambda docs, **given: plans.append(docs) or plain(docs, **given))
    path = scratch_path(spark, "index")
    build_index(docs, path, buckets=4)
    weights = {(w.doc_id, w.term, round(w.tfidf, 9)) for w in plain(docs.where("doc_id IS NOT NULL"), stats=SearchIndex(spark, path).terms, n_docs=SearchIndex(spark, path).n_docs).collect()}
    found = spark.read.parquet(f"{path}/postings").selectExpr("term", "block", "most", "explode(docs) AS d").collect()
    assert {(r.d.doc_id, r.term, round(r.d.tfidf, 9)) for r in found} == weights and all(r.d.tfidf <= r.most for r in found)
    assert len([r for r in found if r.d.doc_id == 1]) == 8 and len([r for r in found if r.d.doc_id == 3]) == 5  # ids that repeat: all their blocks
    assert [c for c in plans[0].columns] == ["doc_id", "tokens"] and plans[0].schema["doc_id"].dataType.names == ["doc_id", "blocks"]
