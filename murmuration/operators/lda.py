"""Classical topic models with Spark's own online variational LDA."""

from __future__ import annotations

from pyspark.ml.clustering import LDA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lda_online(
    features: DataFrame,
    k: int,
    alpha: float = 0.01,
    eta: float = 0.91,
    passes: int = 5,
    subsampling: float = 0.2,
    seed: int = 100,
    minibatch: int | None = None,
    offset: float = 1024.0,
    decay: float = 0.51,
):
    """A fitted model; ``passes`` over the corpus become passes / subsampling minibatches. ``minibatch`` gives their size in
    documents instead. ``offset`` and ``decay`` say how fast later minibatches lose weight. Inside a minibatch each
    document is worked on until its topics settle."""
    if minibatch is not None:
        subsampling = min(1.0, max(minibatch, 1) / max(1, features.count()))
    return LDA(
        learningOffset=offset,
        learningDecay=decay,
        k=k,
        maxIter=max(1, round(passes / subsampling)),
        optimizer="online",
        docConcentration=[alpha],
        topicConcentration=eta,
        subsamplingRate=subsampling,
        optimizeDocConcentration=False,
        seed=seed,
    ).fit(features)


def doc_topics(model, features: DataFrame) -> DataFrame:
    """``(doc_id, topic, p)``."""
    shares = model.transform(features).select("doc_id", vector_to_array("topicDistribution").alias("p"))
    return shares.select("doc_id", F.posexplode("p").alias("topic", "p"))


def describe_topics(model, vocabulary: DataFrame, n: int = 10) -> DataFrame:
    """``(topic, rank, term, weight)``; topics x n rows."""
    described = model.describeTopics(n).select(
        "topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "w")
    )
    words = described.select(
        "topic",
        (F.col("rank") + 1).alias("rank"),
        F.col("w.termIndices").cast("long").alias("term_id"),
        F.col("w.termWeights").alias("weight"),
    )
    return vocabulary.select("term_id", "term").join(F.broadcast(words), "term_id").select("topic", "rank", "term", "weight")


def model_fit(model, features: DataFrame) -> DataFrame:
    """``(log_likelihood, log_perplexity)`` of the corpus under the model."""
    row = [(float(model.logLikelihood(features)), float(model.logPerplexity(features)))]
    return features.sparkSession.createDataFrame(row, "log_likelihood double, log_perplexity double")
