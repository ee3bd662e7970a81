"""Vocabularies without a limit, against DuckDB and small brute force."""

import duckdb
import pytest
from pyspark.sql import functions as F

from murmuration.operators import vocab
from murmuration.session import cut_lineage, scratch_path


def docs_of(spark, lists):
    return spark.createDataFrame(list(enumerate(lists)), "doc_id long, tokens array<string>")


def test_five_million_terms_get_dense_alphabetical_ids(spark):
    n = 5_000_000
    terms = spark.range(n).select(F.concat(F.md5(F.col("id").cast("string")), F.lit("é")).alias("term"), F.lit(1).cast("long").alias("df"))
    numbered = vocab.dense_ids(cut_lineage(terms, "terms"))
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "rows_per" not in plan and plan.count("Window ") <= 1  # over the sizes of the ranges alone
    path = scratch_path(spark, "numbered")
    numbered.write.parquet(path)
    found = duckdb.sql(f"SELECT count(*), count(*) FILTER (term_id <> r) FROM (SELECT term_id, row_number() OVER (ORDER BY term) - 1 AS r FROM '{path}/*.parquet')")
    assert found.fetchall() == [(n, 0)]


@pytest.mark.parametrize("most", [200_000, 3])
def test_most_frequent_with_ties(spark, monkeypatch, most):
    monkeypatch.setattr(vocab, "MAX_VOCABULARY", most)
    lists = [["b", "a", "c"], ["a", "d", "b"], ["e", "f", "a"], [], None, ["ü", "z", "é"]]
    for n in (4, 5, 6, 9, 20):
        got = vocab.build_vocab(docs_of(spark, lists), max_features=n).orderBy("term_id").collect()
        want = sorted(sorted(["a", "b", "c", "d", "e", "f", "ü", "z", "é"], key=lambda t: (-sum(t in (x or []) for x in lists), t.encode()))[:n], key=str.encode)
        assert [r.term for r in got] == want and [r.term_id for r in got] == list(range(len(want)))


def test_joined_counts_equal_counts_inside_rows(spark):
    lists = [["a", "b", "a"], [], None, ["x", "b"], ["unknown"], ["a"] * 50]
    docs = docs_of(spark, lists)
    terms = vocab.with_term_ids(vocab.term_stats(docs).where("term <> 'unknown'"))
    _, words = vocab.pin(terms)
    assert sorted(vocab.bow(docs, terms).collect()) == sorted(vocab.doc2bow(docs, words).collect())
    wide = {r.doc_id: (r.ids, r.cnts) for r in vocab.bow_vectors(docs, terms).collect()}
    assert wide == {r.doc_id: (r.ids, r.cnts) for r in vocab.doc_vectors(docs, words).collect()}


@pytest.mark.parametrize("most", [1 << 20, 2])
def test_weights_inside_rows_equal_joined_ones(spark, monkeypatch, most):
    lists = [["a", "b", "a"], ["b", "c"], [], None, ["d"], ["a", "b", "c", "d"]]
    docs = docs_of(spark, lists)
    want = {name: sorted((r[0], r[1], round(r[2], 12)) for r in fn(docs).collect()) for name, fn in (("s", vocab.tfidf_smooth), ("l", vocab.tfidf_log2))}
    monkeypatch.setattr(vocab, "MAX_WEIGHTS", most)
    for name, fn in (("s", vocab.tfidf_smooth), ("l", vocab.tfidf_log2)):
        assert sorted((r[0], r[1], round(r[2], 12)) for r in fn(docs).collect()) == want[name]
    assert [w for d, t, w in want["s"] if d == 4] == [1.0]
    assert vocab.tfidf_smooth(docs.where("doc_id < 0")).count() == 0


def test_term_totals_are_counted_without_batches_of_texts(spark):
    lists = [["b", "a", "b"], ["a", None, "é", None], [], None, ["é"] * 5, ["b", "a", "b"]]
    stats = vocab.term_stats(docs_of(spark, lists))
    assert sorted(map(tuple, stats.collect())) == [("a", 3, 3), ("b", 4, 2), ("é", 6, 2)]
    assert "Python" not in stats._jdf.queryExecution().executedPlan().toString()
