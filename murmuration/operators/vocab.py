"""Vocabularies, document-term counts and TF-IDF tables in long form."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from murmuration.operators.skew import skew_join
from murmuration.session import cut_lineage

# A vocabulary at or below this size may be broadcast; every bounded builder here enforces it.
MAX_VOCABULARY = 200_000
MAX_TERMS = 1 << 29  # more than any text has; a larger number asked for is taken for a mistake
MAX_WEIGHTS = 1 << 20  # terms whose weights travel to every task, some 30 bytes each
ROWS_PER_PIECE = 500_000  # terms numbered by one task


def each_token(docs: DataFrame, *keep: str, tokens: str = "tokens", name: str = "term") -> DataFrame:
    """One row per token. An inner explode would make the optimiser test the token list for emptiness
    below it, and so tokenise every text three times; an outer one does not."""
    return docs.select(*keep, F.explode_outer(tokens).alias(name)).where(F.col(name).isNotNull())


WEIGHED = ArrayType(StructType([StructField("term", StringType()), StructField("tfidf", DoubleType())]))
COUNTED = ArrayType(StructType([StructField("term", StringType()), StructField("cnt", LongType())]))


@F.arrow_udf(COUNTED)
def counted(tokens: pa.Array) -> pa.Array:
    """Each list's distinct tokens with their numbers, a whole batch at a time; nothing leaves its row."""
    words = tokens.flatten().dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False) if len(words) else np.zeros(0)
    known = ~np.isnan(codes) if codes.dtype.kind == "f" else np.ones(len(codes), bool)
    rows = pc.list_parent_indices(tokens).to_numpy()[known].astype(np.int64)
    cells, count = np.unique(rows << 32 | codes[known].astype(np.int64), return_counts=True)
    offsets = np.searchsorted(cells >> 32, np.arange(len(tokens) + 1)).astype(np.int32)
    terms = words.dictionary.take(pa.array(cells & 0xFFFFFFFF)).cast(pa.string())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([terms, pa.array(count.astype(np.int64))], names=["term", "cnt"]))


def term_stats(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``(term, cf, df)``: occurrences and documents per term, in one pass.

    Each row's tokens are sorted, and one that differs from the token before it counts its document, so nothing but
    per-task term totals is shuffled and no batch of rows is gathered; no (document, term) pair moves.
    """
    rows = docs.select(F.sort_array(tokens).alias("own"))  # nulls first
    pairs = F.arrays_zip(F.col("own").alias("term"), F.concat(F.array(F.lit(None).cast("string")), "own").alias("before"))
    each = rows.select(F.explode_outer(pairs).alias("c")).select("c.term", "c.before").where(F.col("term").isNotNull())
    opens = F.when(F.col("term").eqNullSafe(F.col("before")), 0).otherwise(1)
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("cf"), F.sum(opens).alias("df"))


def term_counts(docs: DataFrame, id_col: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """``(doc_id, term, cnt)``; documents without tokens have no row. A document is one row, so nothing moves."""
    cells = docs.select(id_col, F.explode_outer(counted(F.col(tokens))).alias("c")).where(F.col("c").isNotNull())
    return cells.select(id_col, "c.term", "c.cnt")


def normalize_terms(counts: DataFrame, forms: DataFrame, stats: DataFrame) -> DataFrame:
    """Counts with every term replaced by its form from a ``(term, form)`` table; terms the table lacks
    stay. ``stats`` holds each term's document frequency, since frequent terms are hot keys."""
    known = stats.select("term", "df").join(forms, "term", "left")
    known = known.select("term", "df", F.coalesce("form", "term").alias("form"))
    joined = skew_join(counts, known, "term", "df", "doc_id")
    return joined.groupBy("doc_id", F.col("form").alias("term")).agg(F.sum("cnt").alias("cnt"))


def dense_ids(terms: DataFrame, key: str = "term", out: str = "term_id", rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """Number the rows of a written table from 0 in the order of a unique string.

    The strings are cut into ranges of about ``rows_per_piece`` rows, each range is sorted and numbered by one task, and
    the exact sizes of the ranges before it (at most 4096 numbers) are added.
    """
    pieces = max(1, min(4096, -(-terms.count() // rows_per_piece)))
    ranged = terms.repartitionByRange(pieces, key).sortWithinPartitions(key).withColumn("_place", F.monotonically_increasing_id())
    ranged = cut_lineage(ranged, "ranged-terms").withColumn("_piece", F.shiftright("_place", 33))
    sizes = ranged.groupBy("_piece").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_piece", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(offsets), "_piece").withColumn(out, F.col("_before") + inside).drop("_place", "_piece", "_before")


def with_term_ids(vocabulary: DataFrame) -> DataFrame:
    """Dense alphabetical ids for a vocabulary of any size; a small one is numbered by one task."""
    known = cut_lineage(vocabulary, "vocabulary")
    if known.count() > MAX_VOCABULARY:
        return dense_ids(known)
    return known.withColumn("term_id", F.row_number().over(Window.orderBy("term")).cast("long") - 1)


def most_frequent(stats: DataFrame, by: str, n: int) -> DataFrame:
    """The ``n`` terms of the largest number in a column, ties by term.

    Many terms are cut where the count of terms by number says so, which is a short table; only those that tie there are
    ranked among themselves.
    """
    if n > MAX_TERMS:
        raise ValueError(f"at most {MAX_TERMS} terms can be asked for; leave the number out to keep all")
    if n <= MAX_VOCABULARY:
        return stats.orderBy(F.desc(by), "term").limit(n)
    stats = cut_lineage(stats, "term-stats")
    through = F.sum("terms").over(Window.orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, 0))
    steps = stats.groupBy(by).agg(F.count(F.lit(1)).alias("terms")).withColumn("through", through)
    cut = steps.where(F.col("through") >= n).orderBy("through").limit(1).collect()
    if not cut:
        return stats
    level, wanted = cut[0][by], n - (cut[0]["through"] - cut[0]["terms"])
    ties = dense_ids(stats.where(F.col(by) == level), out="_tie").where(F.col("_tie") < wanted).drop("_tie")
    return stats.where(F.col(by) > level).unionByName(ties.select(*stats.columns))


def build_vocab(
    docs: DataFrame,
    min_df: int = 1,
    max_df: float = 1.0,
    max_features: int | None = None,
    tokens: str = "tokens",
) -> DataFrame:
    """``(term_id, term, df, cf)``: drop terms in more than a share ``max_df`` or fewer than ``min_df``
    documents, keep the ``max_features`` most frequent if that is given (ties by term), number them alphabetically."""
    n_docs = docs.agg(F.count(F.lit(1)).alias("n"))
    kept = (
        term_stats(docs, tokens)
        .where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n_docs.scalar()))
    )
    kept = kept if max_features is None else most_frequent(kept, "cf", max_features)
    return with_term_ids(kept).select("term_id", "term", "df", "cf")


def filter_extremes(
    docs: DataFrame, no_below: int = 5, no_above: float = 0.5, keep_n: int | None = None, tokens: str = "tokens"
) -> DataFrame:
    """The other dictionary rule: same limits, but the survivors are ranked by document frequency."""
    n_docs = docs.agg(F.count(F.lit(1)).alias("n"))
    kept = (
        term_stats(docs, tokens)
        .where((F.col("df") >= no_below) & (F.col("df") <= F.lit(no_above) * n_docs.scalar()))
    )
    kept = kept if keep_n is None else most_frequent(kept, "df", keep_n)
    return with_term_ids(kept).select("term_id", "term", "df", "cf")


def extend_vocab(vocabulary: DataFrame, extra: list[str]) -> DataFrame:
    """Append terms that are not there yet, keeping the existing ids and numbering on from them."""
    spark = vocabulary.sparkSession
    size = vocabulary.agg(F.coalesce(F.max("term_id") + 1, F.lit(0)).cast("long").alias("size"))
    added = spark.createDataFrame([(i, t) for i, t in enumerate(dict.fromkeys(extra))], "position long, term string")
    new = added.join(vocabulary.select("term"), "term", "left_anti")
    ids = F.row_number().over(Window.orderBy("position")).cast("long") - 1
    new = new.withColumn("term_id", ids + size.scalar())
    return vocabulary.select("term_id", "term").unionByName(new.select("term_id", "term"))


def pin(vocabulary: DataFrame) -> tuple[DataFrame, list[str]]:
    """Compute a bounded vocabulary once: the table as a local relation, and its words in id order."""
    spark = vocabulary.sparkSession
    rows = sorted(vocabulary.limit(MAX_VOCABULARY + 1).collect(), key=lambda r: r["term_id"])
    if len(rows) > MAX_VOCABULARY or [r["term_id"] for r in rows] != list(range(len(rows))):
        raise ValueError(f"expected dense ids and at most {MAX_VOCABULARY} terms")
    return spark.createDataFrame(rows, vocabulary.schema), [r["term"] for r in rows]


def feature_vectors(docs: DataFrame, words: list[str], tokens: str = "tokens") -> DataFrame:
    """Documents with a sparse ``features`` vector of counts, position = term id. Counting happens
    inside each row, so nothing is shuffled; the bounded word list travels to the executors."""
    model = CountVectorizerModel.from_vocabulary(words, inputCol=tokens, outputCol="features")
    return model.transform(docs.withColumn(tokens, F.coalesce(tokens, F.array().cast("array<string>"))))


def doc_vectors(docs: DataFrame, words: list[str], tokens: str = "tokens", keep: list[str] = ()) -> DataFrame:
    """``(doc_id, ..., ids, cnts)``: one sparse row per document with ascending ids, empty arrays for
    documents without any known word."""
    vector = F.unwrap_udt("features")
    return feature_vectors(docs, words, tokens).select(
        "doc_id", *keep, vector["indices"].alias("ids"), vector["values"].alias("cnts")
    )


def bow(docs: DataFrame, vocabulary: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``(doc_id, term_id, cnt)`` against a vocabulary of any size: its table ``(term_id, term, df)`` is joined by term, never
    collected. Frequent terms are hot keys, so ``df`` tells how far to spread them."""
    known = cut_lineage(vocabulary.select("term", "term_id", "df"), "terms")
    joined = skew_join(term_counts(docs, tokens=tokens), known, "term", "df", "doc_id")
    return joined.select("doc_id", "term_id", "cnt")


def bow_vectors(docs: DataFrame, vocabulary: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``(doc_id, ids, cnts)`` as ``doc_vectors`` gives them, for a vocabulary of any size."""
    cells = F.array_sort(F.collect_list(F.struct("term_id", "cnt")))  # a document's terms, which its text bounds
    rows = bow(docs, vocabulary, tokens).groupBy("doc_id").agg(cells.alias("c"))
    met = docs.select("doc_id").join(rows, "doc_id", "left").withColumn("c", F.coalesce("c", F.array().cast("array<struct<term_id:bigint,cnt:bigint>>")))
    return met.select("doc_id", F.col("c.term_id").cast("array<int>").alias("ids"), F.col("c.cnt").cast("array<double>").alias("cnts"))


def l1_scale(vectors: DataFrame) -> DataFrame:
    """Each document's counts scaled to sum to one, so that very long documents do not outweigh the rest."""
    total = F.aggregate("cnts", F.lit(0.0), lambda s, v: s + v)
    # zipped with a constant array: inside a lambda the total would be added up again for every entry
    totals = F.array_repeat(total, F.size("cnts"))
    return vectors.withColumn("cnts", F.zip_with("cnts", totals, lambda v, t: v / t))


def doc2bow(docs: DataFrame, words: list[str], tokens: str = "tokens") -> DataFrame:
    """``(doc_id, term_id, cnt)`` for known words; unknown ones are dropped."""
    pairs = F.arrays_zip("ids", "cnts")
    return doc_vectors(docs, words, tokens).select("doc_id", F.explode(pairs).alias("p")).select(
        "doc_id", F.col("p.ids").cast("long").alias("term_id"), F.col("p.cnts").cast("long").alias("cnt")
    )


def doc_term_matrix(docs: DataFrame, words: list[str], tokens: str = "tokens") -> DataFrame:
    """Long counts for a given vocabulary; a document without known words keeps one row of nulls."""
    pairs = F.arrays_zip("ids", "cnts")
    return doc_vectors(docs, words, tokens).select("doc_id", F.explode_outer(pairs).alias("p")).select(
        "doc_id", F.col("p.ids").cast("long").alias("term_id"), F.col("p.cnts").cast("long").alias("cnt")
    )


def tfidf_vectors(docs: DataFrame, vocabulary: DataFrame, words: list[str], n_docs: int, tokens: str = "tokens") -> DataFrame:
    """Documents with a unit ``tfidf`` vector over a pinned vocabulary, computed row by row in the JVM."""
    df_of = {r["term_id"]: r["df"] for r in vocabulary.select("term_id", "df").collect()}
    idf = Vectors.dense([math.log((1 + n_docs) / (1 + df_of[i])) + 1 for i in range(len(words))])
    weighted = ElementwiseProduct(scalingVec=idf, inputCol="features", outputCol="weighted").transform(
        feature_vectors(docs, words, tokens)
    )
    return Normalizer(p=2.0, inputCol="weighted", outputCol="tfidf").transform(weighted).drop("features", "weighted")


def l2_normalize(weights: DataFrame, value: str, by: str = "doc_id") -> DataFrame:
    """Each document's row scaled to length one. A document's terms are a bounded group."""
    norm = F.sqrt(F.sum(F.col(value) * F.col(value)).over(Window.partitionBy(by)))
    return weights.withColumn(value, F.when(norm > 0, F.col(value) / norm).otherwise(F.col(value)))


def pinned_stats(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Term totals written once. They are needed for the list of hot terms as well as for the join, and
    the corpus should not be tokenised again for each."""
    return cut_lineage(term_stats(docs, tokens), "term-stats")


def _unit_weights(cells: DataFrame, stats: DataFrame, idf, least: float = 0.0) -> DataFrame:
    """``(doc_id, term, tfidf)`` of ``(doc_id, cells)``: counts times ``idf(df)``, each document's row of length one.

    Weights of up to ``MAX_WEIGHTS`` terms travel to the documents, which are weighed and scaled inside their rows, and nothing
    is shuffled. More terms are joined; frequent ones are hot keys.
    """
    if stats.limit(MAX_WEIGHTS + 1).count() > MAX_WEIGHTS:
        counts = cells.select("doc_id", F.explode_outer("cells").alias("c")).where(F.col("c").isNotNull()).select("doc_id", "c.term", "c.cnt")
        joined = skew_join(counts, stats.select("term", "df"), "term", "df", "doc_id")
        joined = joined.withColumn("tfidf", F.col("cnt") * idf(F, F.col("df")))
        return l2_normalize(joined, "tfidf").where(F.abs("tfidf") > least).select("doc_id", "term", "tfidf")
    table = stats.select("term", "df").toArrow().combine_chunks()
    weights = idf(np, table["df"].to_numpy().astype(np.float64))
    shared = stats.sparkSession.sparkContext.broadcast((table["term"].combine_chunks().cast(pa.large_string()), weights))

    @F.arrow_udf(WEIGHED)
    def weigh(column: pa.Array) -> pa.Array:
        terms, weight = shared.value
        held = column.flatten()
        words = held.field(0).cast(pa.large_string()).dictionary_encode()
        place = pc.index_in(words.dictionary, value_set=terms)
        known = pc.fill_null(place, -1).to_numpy()[words.indices.to_numpy()]
        value = held.field(1).to_numpy() * weight[known]
        rows = pc.list_parent_indices(column).to_numpy()
        norm = np.sqrt(np.bincount(rows, value * value, minlength=len(column)))[rows]
        value = np.where(norm > 0, value / np.where(norm > 0, norm, 1), value)
        good = (known >= 0) & (np.abs(value) > least)
        offsets = np.searchsorted(rows[good], np.arange(len(column) + 1)).astype(np.int32)
        parts = pa.StructArray.from_arrays([held.field(0).filter(pa.array(good)).cast(pa.string()), pa.array(value[good])], names=["term", "tfidf"])
        return pa.ListArray.from_arrays(pa.array(offsets), parts)

    weighed = cells.select("doc_id", F.explode_outer(weigh("cells")).alias("c")).where(F.col("c").isNotNull())
    return weighed.select("doc_id", "c.term", "c.tfidf")


def _counted_once(docs: DataFrame, tokens: str, stats: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Each document's counted tokens, and the terms' totals unless given. Where both are wanted texts are tokenised once."""
    cells = docs.select("doc_id", counted(F.col(tokens)).alias("cells"))
    if stats is not None:
        return cells, stats
    cells = cut_lineage(cells, "token-counts")
    each = cells.select(F.explode_outer("cells").alias("c")).where(F.col("c").isNotNull())
    totals = each.groupBy(F.col("c.term").alias("term")).agg(F.sum("c.cnt").alias("cf"), F.count(F.lit(1)).alias("df"))
    return cells, cut_lineage(totals, "term-stats")


def tfidf_smooth(
    docs: DataFrame, tokens: str = "tokens", stats: DataFrame | None = None, n_docs: DataFrame | None = None
) -> DataFrame:
    """``(doc_id, term, tfidf)`` with idf = ln((1+N)/(1+df)) + 1 and unit rows. Pass the ``stats`` and
    document count of the whole corpus to weigh a part of it."""
    cells, stats = _counted_once(docs, tokens, stats)
    n = (docs if n_docs is None else n_docs).agg(F.count(F.lit(1)) if n_docs is None else F.max("n")).first()[0]
    return _unit_weights(cells, stats, lambda m, df: m.log((1 + n) / (1 + df)) + 1, -1.0)


def tfidf_log2(docs: DataFrame, tokens: str = "tokens", stats: DataFrame | None = None) -> DataFrame:
    """``(doc_id, term, tfidf)`` with idf = log2(N/df), unit rows, entries near zero dropped."""
    cells, stats = _counted_once(docs, tokens, stats)
    n = docs.count()
    return _unit_weights(cells, stats, lambda m, df: m.log2(n / df), 1e-12)


def tfidf_from_bow(bow: DataFrame, vocabulary: DataFrame, n_docs: DataFrame) -> DataFrame:
    """Two-step form: counts over a bounded vocabulary first, then smooth idf and unit rows."""
    idf = F.log((1 + n_docs.scalar()) / (1 + F.col("df"))) + 1
    weights = bow.join(F.broadcast(vocabulary.select("term_id", "df")), "term_id").withColumn(
        "tfidf", F.col("cnt") * idf
    )
    return l2_normalize(weights, "tfidf").select("doc_id", "term_id", "tfidf")


def matrix_shape(weights: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows, columns and stored values of a long matrix, from per-term totals."""
    per_term = weights.groupBy("term").count()
    n_docs = docs.agg(F.count(F.lit(1)).alias("n"))
    return per_term.agg(
        F.count(F.lit(1)).alias("n_cols"), F.sum("count").alias("nnz")
    ).select(n_docs.scalar().alias("n_rows"), "n_cols", "nnz")
