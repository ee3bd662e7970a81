"""The whole way in a few calls: raw files to clean weeks, texts to topics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.functions.text import ngrams_1_2, preprocess, strip_accents
from murmuration.operators import coherence, inference, lda, sampling, tensor_lda, timechunks, topics, vocab
from murmuration.session import cut_lineage
from murmuration.sources import posts, sinks

Tokenizer = Callable[[Column], Column]


def clean_archive(spark: SparkSession, raw, out: str, whole_files: bool = False) -> DataFrame:
    """Read raw post files, write clean posts by day and the rejects beside them; returns the clean table."""
    parsed = cut_lineage(posts.scan_concat_json(spark, raw, whole_files=whole_files), "parsed")  # parsed once, read twice
    good, bad = posts.split_rejects(parsed)
    sinks.write_clean(posts.clean_posts(good), out)
    bad.write.mode("overwrite").parquet(f"{out}/rejects")
    return spark.read.parquet(f"{out}/data").drop("day")


def weekly_archive(clean: DataFrame, out: str, ts: str = "created_at", days: int = 7) -> DataFrame:
    """Split clean posts into weeks anchored at their first post; returns the manifest."""
    sinks.write_chunks(timechunks.anchored_weeks(clean, ts, "doc_id", days), out, ts)
    return clean.sparkSession.read.parquet(f"{out}/manifest")


def load_posts(
    spark: SparkSession, raw, fraction: float = 1.0, tokenizer: Tokenizer | None = preprocess, seed: int = 0, rejects: str | None = None
) -> DataFrame:
    """English original posts of raw files, an exact share of every file, tokenised when a tokeniser is given.
    What cannot be read is written to the folder ``rejects``; without one it is an error."""
    parsed = cut_lineage(posts.scan_concat_json(spark, raw), "parsed")
    good, bad = posts.split_rejects(parsed)
    if rejects is not None:
        bad.write.mode("overwrite").parquet(rejects)
    elif not bad.isEmpty():
        raise ValueError("some of the input cannot be read; name a folder for rejects")
    clean = posts.clean_posts(good)
    if fraction < 1.0:
        clean = sampling.sample_per_group(clean, "doc_id", "source", fraction, seed)
    return clean.withColumn("tokens", tokenizer(F.col("text"))) if tokenizer else clean


@dataclass
class TopicRun:
    """A fitted model with its vocabulary, normalised topic table and vectors."""

    model: tensor_lda.TopicModel
    vocabulary: DataFrame
    words: list[str]
    vectors: DataFrame
    table: DataFrame

    def top_words(self, n: int = 20) -> DataFrame:
        return topics.top_words(self.table, n, "p").select("topic", "rank", "term", "p")

    def weights(self) -> DataFrame:
        plain = self.model.topic_table(self.table.sparkSession, add_mean=False)
        return topics.topic_weights(plain, self.model.params.alpha0)

    def doc_topics(self, n_iter: int = 150, seed: int = 0) -> DataFrame:
        beta = inference.beta_matrix(self.table, len(self.words))
        return inference.infer_doc_topics(self.vectors, beta, n_iter=n_iter, seed=seed)


def learn_topics(
    docs: DataFrame,
    params: tensor_lda.TopicParams,
    vocabulary: DataFrame | None = None,
    min_df: int = 100,
    max_df: float = 0.5,
    max_features: int | None = None,
    axis: str = "topic",
    smoothing: float = 1e-6,
    negatives: str = "clip",
    scale_documents: bool = False,
) -> TopicRun:
    """Topics of ``(doc_id, tokens)``. Without a vocabulary one is built; ``scale_documents`` lets each
    document count alike whatever its length."""
    spark = docs.sparkSession
    if vocabulary is None:
        vocabulary = vocab.build_vocab(docs, min_df, max_df, max_features)
    vocabulary, words = vocab.pin(vocabulary)
    counts = vocab.doc_vectors(docs, words)
    vectors = (vocab.l1_scale(counts) if scale_documents else counts).persist()
    try:
        model = tensor_lda.fit(vectors, len(words), params)
    finally:
        vectors.unpersist()
    table = topics.normalize_topics(model.topic_table(spark, vocabulary), axis, smoothing, negatives)
    return TopicRun(model, vocabulary, words, counts, table)


def text_tokens(text: Column, accents: bool = True, normalize: bool = True, pairs: bool = True) -> Column:
    """Tokens of raw text: accents off, the default tokeniser with its suffix rules, then pairs of neighbours after the single words."""
    words = preprocess(strip_accents(text) if accents else text, normalize=normalize)
    return ngrams_1_2(words) if pairs else words


def topics_of_texts(
    docs: DataFrame, params: tensor_lda.TopicParams, text: str = "text", accents: bool = True, normalize: bool = True, pairs: bool = True, **options
) -> TopicRun:
    """Topics of ``(doc_id, text)`` in one call; ``options`` as in ``learn_topics``.

    Texts are tokenised once: the tokens are written, since vocabulary, moments and tensors each read them.
    """
    known = F.coalesce(F.col(text), F.lit(""))
    words = docs.select("doc_id", text_tokens(known, accents, normalize, False).alias("words"))
    tokens = words.select("doc_id", ngrams_1_2(F.col("words")).alias("tokens")) if pairs else words.withColumnRenamed("words", "tokens")
    return learn_topics(cut_lineage(tokens, "tokens"), params, **options)


def lda_coherence(
    docs: DataFrame,
    k: int,
    alpha: float = 0.01,
    eta: float = 0.91,
    measure: str = "umass",
    passes: int = 10,
    min_df: int = 5,
    max_df: float = 0.5,
    max_features: int | None = None,
    top: int = 20,
) -> DataFrame:
    """``(coherence)`` of a classical model with ``k`` topics; measures: umass, uci, npmi, cv."""
    vocabulary, words = vocab.pin(vocab.build_vocab(docs, min_df, max_df, max_features))
    features = vocab.feature_vectors(docs, words).select("doc_id", "features").persist()
    try:
        model = lda.lda_online(features, k, alpha, eta, passes)
    finally:
        features.unpersist()
    described = lda.describe_topics(model, vocabulary, top).select("topic", "rank", "term")
    score = {"umass": coherence.umass, "uci": coherence.uci, "npmi": coherence.npmi, "cv": coherence.cv}[measure]
    return coherence.mean_coherence(score(docs, described))
