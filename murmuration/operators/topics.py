"""Topic tables ``(topic, term_id, weight)``: normalisation, top words, comparison between runs.

A topic table has (topics x vocabulary) rows and the vocabulary is bounded, so windows over one topic
or one term hold at most that many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmuration.operators.sampling import top_per_group


def topic_weights(topics: DataFrame, beta0: float = 0.003) -> DataFrame:
    """``(topic, norm, alpha)``: the L3 norm of each topic, and its inverse square scaled to sum to beta0."""
    norms = topics.groupBy("topic").agg(F.pow(F.sum(F.pow(F.abs("weight"), 3)), 1 / 3).alias("norm"))
    strength = F.pow("norm", -2)
    return norms.select(
        "topic", "norm", (strength / F.sum(strength).over(Window.partitionBy()) * beta0).alias("alpha")
    )


def normalize_topics(
    topics: DataFrame, axis: str = "topic", smoothing: float = 1e-6, negatives: str = "clip"
) -> DataFrame:
    """Non-negative, smoothed shares ``p``. ``axis='topic'`` makes each topic a distribution over words,
    ``axis='word'`` each word one over topics. Negative weights become 0 ('clip') or everything is
    raised by the table's smallest value ('shift')."""
    group, other = ("topic", "term_id") if axis == "topic" else ("term_id", "topic")
    smallest = topics.agg(F.abs(F.min("weight"))).scalar()
    size = topics.agg(F.countDistinct(other)).scalar()
    raised = F.greatest("weight", F.lit(0.0)) if negatives == "clip" else F.col("weight") + smallest
    smooth = topics.withColumn("p", raised * (1 - smoothing) + F.lit(smoothing) / size)
    return smooth.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(group)))


def smooth_beta(topics: DataFrame, smoothing: float = 0.01) -> DataFrame:
    """Mix each topic's distribution ``p`` with the uniform one."""
    rows = topics.agg(F.countDistinct("term_id")).scalar()
    return topics.withColumn("p", F.col("p") * (1 - smoothing) + F.lit(smoothing) / rows)


def unit_sums(topics: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """``(topic, total, ok)``: does each topic's distribution sum to one?"""
    totals = topics.groupBy("topic").agg(F.sum("p").alias("total"))
    return totals.withColumn("ok", F.abs(F.col("total") - 1) <= tolerance)


def simplex_project(topics: DataFrame, value: str = "weight") -> DataFrame:
    """Euclidean projection of each topic onto the simplex: adds ``p`` and the threshold ``theta``."""
    ordered = Window.partitionBy("topic").orderBy(F.desc(value), "term_id")
    ranked = topics.withColumn("_r", F.row_number().over(ordered)).withColumn(
        "_t", (F.sum(value).over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - 1) / F.col("_r")
    )
    above = F.when(F.col(value) - F.col("_t") > 0, F.struct("_r", "_t"))
    theta = F.max(above).over(Window.partitionBy("topic"))["_t"]
    return (
        ranked.withColumn("theta", theta)
        .withColumn("p", F.greatest(F.col(value) - F.col("theta"), F.lit(0.0)))
        .drop("_r", "_t")
    )


def nonneg_adjust(topics: DataFrame) -> DataFrame:
    """Project each topic and its mirror image, both raised to start at zero; keep the one with the
    smaller threshold, the mirror image on a tie."""
    whole = Window.partitionBy("topic")
    shifted = topics.withColumn("_u", F.col("weight") - F.min("weight").over(whole)).withColumn(
        "_d", F.max("weight").over(whole) - F.col("weight")
    )
    up = simplex_project(shifted, "_u").withColumnRenamed("theta", "_tu").withColumnRenamed("p", "_pu")
    both = simplex_project(up, "_d")
    keep_up = F.col("_tu") < F.col("theta")
    return both.select(
        "topic", "term_id", F.when(keep_up, F.col("_pu")).otherwise(F.col("p")).alias("p"), (~keep_up).alias("mirrored")
    )


def top_words(topics: DataFrame, n: int = 20, value: str = "weight") -> DataFrame:
    """``(topic, rank, term, ...)`` by falling weight, ties by term."""
    return top_per_group(topics, "topic", [F.desc(value), F.col("term")], n)


def term_across_topics(topics: DataFrame, term: str) -> DataFrame:
    return topics.where(F.col("term") == term).select("topic", "term", "weight").orderBy("topic")


def doc_top_topic(doc_topics: DataFrame, docs: DataFrame) -> DataFrame:
    """``(doc_id, topic, p, text)``: each document with its strongest topic (ties: the larger topic), null if it has none."""
    best = doc_topics.groupBy("doc_id").agg(F.max(F.struct("p", "topic")).alias("b"))
    return docs.join(best, "doc_id", "left").select("doc_id", F.col("b.topic").alias("topic"), F.col("b.p").alias("p"), "text")


def run_similarity(runs: DataFrame, n: int = 10, tolerance: int = 5) -> DataFrame:
    """``(run1, run2, similarity)`` for all ordered pairs: how many topics of run2 have a topic in run1
    whose top ``n`` words differ in at most ``tolerance``. Works on the top words alone (runs x topics x n)."""
    top = top_per_group(runs, ["run", "topic"], [F.desc("weight"), F.col("term")], n).select("run", "topic", "term")
    a = top.select(F.col("run").alias("run1"), F.col("topic").alias("i"), "term")
    b = top.select(F.col("run").alias("run2"), F.col("topic").alias("j"), "term")
    sizes = top.groupBy(F.col("run").alias("run1"), F.col("topic").alias("i")).agg(F.count(F.lit(1)).alias("size"))
    shared = a.join(b, "term").groupBy("run1", "i", "run2", "j").agg(F.count(F.lit(1)).alias("overlap"))
    # all pairs of topics, with a common word or not; the few topics travel as one value
    others = sizes.agg(F.collect_list(F.struct(F.col("run1").alias("run2"), F.col("i").alias("j")))).scalar()
    every = sizes.select("run1", "i", "size", F.explode(others).alias("o")).select("run1", "i", "size", "o.run2", "o.j")
    matched = (
        every.join(shared, ["run1", "i", "run2", "j"], "left")
        .where(F.col("size") - F.coalesce("overlap", F.lit(0)) <= tolerance)
        .groupBy("run1", "run2")
        .agg(F.countDistinct("j").alias("similarity"))
    )
    names = runs.select("run").distinct()
    listed = names.agg(F.collect_set("run")).scalar()
    pairs = names.select(F.col("run").alias("run1"), F.explode(listed).alias("run2"))
    return pairs.join(matched, ["run1", "run2"], "left").na.fill(0, ["similarity"])


def runs_converged(runs: DataFrame, n: int = 10, tolerance: int = 5) -> DataFrame:
    """One row: do all ordered pairs of runs, each with itself included, share half their topics?"""
    half = runs.agg(F.countDistinct("topic") / 2).scalar()
    return run_similarity(runs, n, tolerance).agg(F.bool_and(F.col("similarity") >= half).alias("converged"))


def whitened_allclose(runs: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """``(run1, run2, max_diff, close)`` over ``(run, doc_id, y)`` rows. Each document's runs are compared side by
    side in one pass; only run pairs leave it. Runs that do not hold the same documents are not close."""
    per_doc = runs.groupBy("doc_id").agg(F.collect_list(F.struct("run", "y")).alias("runs"))
    left = per_doc.select("runs", F.explode("runs").alias("a"))
    both = left.select("a", F.explode("runs").alias("b"))
    gap = F.array_max(F.zip_with("a.y", "b.y", lambda p, q: F.abs(p - q)))
    pairs = both.groupBy(F.col("a.run").alias("run1"), F.col("b.run").alias("run2")).agg(
        F.max(gap).alias("max_diff"), F.count(F.lit(1)).alias("n")
    )
    # a run meets itself once for each of its documents
    own = {side: pairs.where("run1 = run2").select(F.col("run1").alias(side), F.col("n").alias(f"n_{side}")) for side in ("run1", "run2")}
    names = runs.agg(F.collect_set("run")).scalar()
    every = runs.select(F.col("run").alias("run1")).distinct().select("run1", F.explode(names).alias("run2"))
    counted = every.join(pairs, ["run1", "run2"], "left").join(own["run1"], "run1").join(own["run2"], "run2")
    same = (F.col("n") == F.col("n_run1")) & (F.col("n") == F.col("n_run2"))
    return counted.select("run1", "run2", "max_diff", F.coalesce(same & (F.col("max_diff") <= tolerance), F.lit(False)).alias("close"))


def sentiment_blocks(bow: DataFrame, vocabulary: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(doc_id, term_id, v)`` over three blocks of the vocabulary (positive, neutral, negative): counts
    times the token's score, a third each for tokens the lexicon lacks."""
    size = vocabulary.agg(F.count(F.lit(1))).scalar()
    scored = vocabulary.join(lexicon, vocabulary["term"] == lexicon["token"], "left").select(
        "term_id", *[F.coalesce(c, F.lit(1 / 3)).alias(c) for c in ("positive", "neutral", "negative")]
    )
    blocks = F.array(
        *[F.struct(F.lit(b).alias("block"), F.col(c).alias("s")) for b, c in enumerate(("positive", "neutral", "negative"))]
    )
    return (
        bow.join(F.broadcast(scored), "term_id")  # a bounded vocabulary
        .select("doc_id", "term_id", "cnt", F.explode(blocks).alias("b"))
        .select("doc_id", (F.col("term_id") + F.col("b.block") * size).alias("term_id"), (F.col("cnt") * F.col("b.s")).alias("v"))
    )


def fold_sentiment(topics: DataFrame, n_topics: int, size: int) -> DataFrame:
    """Topics over the three blocks as three times as many topics over the vocabulary."""
    block = F.floor(F.col("term_id") / size)
    return topics.select(
        (block * n_topics + F.col("topic")).alias("topic"), (F.col("term_id") % size).alias("term_id"), "weight"
    )
