"""Screening texts and topics with a term list ``(grp, term, harmless_meaning)``.

A lexicon is a hand-made list; joins broadcast it after its size is checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.functions.text import bigrams

MAX_LEXICON = 100_000


def _bounded(lexicon: DataFrame) -> DataFrame:
    """Broadcast a lexicon of checked size; leave a larger one to a shuffled join."""
    small = lexicon.limit(MAX_LEXICON + 1).count() <= MAX_LEXICON
    return F.broadcast(lexicon) if small else lexicon


def usable(lexicon: DataFrame) -> DataFrame:
    return lexicon.where(~F.col("harmless_meaning")).select("grp", "term")


def in_use(lexicon: DataFrame, docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Lexicon rows whose first word occurs somewhere in the documents."""
    first = lexicon.withColumn("first", F.element_at(F.split("term", " "), 1))
    words = docs.select(F.explode(F.array_distinct(tokens)).alias("first"))
    seen = words.join(_bounded(first.select("first").distinct()), "first", "left_semi").distinct()
    return first.join(seen, "first", "left_semi").drop("first")


def build(lexicon: DataFrame) -> DataFrame:
    """One row per group: its usable terms, sorted and joined by ``|``."""
    return (
        usable(lexicon)
        .groupBy("grp")
        .agg(
            F.count(F.lit(1)).alias("n_terms"),
            F.array_join(F.sort_array(F.collect_list("term")), "|").alias("terms"),
        )
    )


def min_group(lexicon: DataFrame, at_least: int = 5) -> DataFrame:
    """Drop groups with fewer terms."""
    big = lexicon.groupBy("grp").count().where(F.col("count") >= at_least)
    return lexicon.join(big, "grp", "left_semi")


def trigrams(tokens):
    """Three neighbouring tokens joined by spaces."""
    after = F.slice(bigrams(tokens), 2, F.greatest(F.size(tokens), F.lit(1)))
    return F.array_compact(F.zip_with(tokens, after, lambda a, b: F.concat(a, F.lit(" "), b)))


def _hits(docs: DataFrame, lexicon: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Distinct one- to three-word phrases of each document that the lexicon holds."""
    column = F.col(tokens)
    phrases = F.array_distinct(F.concat(column, bigrams(column), trigrams(column)))
    return docs.select("doc_id", F.explode(phrases).alias("term")).join(_bounded(lexicon), "term")


def in_docs(docs: DataFrame, lexicon: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``(doc_id, grp)`` for every group with a term in the document."""
    return _hits(docs, lexicon, tokens).select("doc_id", "grp").distinct()


def term_document_counts(docs: DataFrame, lexicon: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``(grp, term, n_docs)``, with zero for terms that never occur."""
    found = _hits(docs, lexicon, tokens).groupBy("grp", "term").agg(F.count(F.lit(1)).alias("n_docs"))
    return lexicon.join(found, ["grp", "term"], "left").na.fill(0, ["n_docs"])


def in_topics(topic_words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Which lexicon terms occur in a topic's words, with their weight there."""
    return topic_words.join(_bounded(lexicon), "term").select("topic", "grp", "term", "weight")
