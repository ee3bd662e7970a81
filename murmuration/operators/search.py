"""Keyword search over TF-IDF rows by cosine similarity."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.operators.vocab import l2_normalize, pinned_stats, tfidf_smooth


def query_weights(terms: list[str], stats: DataFrame, n_docs: DataFrame) -> DataFrame:
    """The query as a unit TF-IDF vector in the corpus vocabulary; a few rows."""
    counts = Counter(terms)
    known = stats.where(F.col("term").isin(list(counts)))
    table = stats.sparkSession.createDataFrame(list(counts.items()), "term string, n long")
    idf = F.log((1 + n_docs.scalar()) / (1 + F.col("df"))) + 1
    weights = known.join(F.broadcast(table), "term").select(
        F.lit(0).alias("q"), "term", (F.col("n") * idf).alias("query_weight")
    )
    return l2_normalize(weights, "query_weight", "q").select("term", "query_weight")


def document_search(docs: DataFrame, terms: list[str], top_n: int = 3, weights: DataFrame | None = None) -> DataFrame:
    """``(doc_id, text, similarity)`` of the ``top_n`` closest documents, ties by doc_id. Pass a saved
    TF-IDF table as ``weights`` to search many times."""
    stats = pinned_stats(docs)
    n_docs = docs.agg(F.count(F.lit(1)).alias("n"))
    if weights is None:  # only documents that share a word with the query need weighing
        sharing = docs.where(F.arrays_overlap("tokens", F.array(*[F.lit(t) for t in dict.fromkeys(terms)])))
        weights = tfidf_smooth(sharing, stats=stats, n_docs=n_docs)
    query = query_weights(terms, stats, n_docs)
    scores = (
        weights.where(F.col("term").isin(list(dict.fromkeys(terms))))
        .join(F.broadcast(query), "term")
        .groupBy("doc_id")
        .agg(F.sum(F.col("tfidf") * F.col("query_weight")).alias("similarity"))
    )
    best = scores.orderBy(F.desc(F.round("similarity", 9)), "doc_id").limit(top_n)
    return docs.select("doc_id", "text").join(F.broadcast(best), "doc_id")
