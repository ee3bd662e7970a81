"""Topic shares of documents by variational inference, and the perplexity bound."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.functions.numeric import dirichlet_expectation, gammaln, log_sum_exp

CELLS_AT_ONCE = 1 << 15  # words of documents worked on together; each opens a few numbers for every topic


def beta_matrix(topics: DataFrame, n_terms: int, value: str = "p") -> np.ndarray:
    """The V x topics table of a normalised topic table; model-sized, grouped to one row per term."""
    rows = topics.groupBy("term_id").agg(F.array_sort(F.collect_list(F.struct("topic", F.col(value).alias("p")))).alias("r"))
    collected = rows.collect()
    beta = np.zeros((n_terms, len(collected[0]["r"])))
    for row in collected:
        beta[row["term_id"]] = [cell["p"] for cell in row["r"]]
    return beta


def infer_block(ids, counts, sizes, beta, start, prior: float, n_iter: int):
    """Gamma rows for many sparse documents at once; a document stops when its mean change is <= 1e-2."""
    gamma = start.copy()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    share = beta[ids]
    live = np.ones(len(sizes), dtype=bool)
    for _ in range(n_iter):
        if not live.any():
            break
        chosen = np.flatnonzero(live)
        cells = live[owner]
        local = np.searchsorted(chosen, owner[cells])
        weight = np.exp(dirichlet_expectation(gamma[chosen]))
        rows, cnt = share[cells], counts[cells]
        norm = (rows * weight[local]).sum(axis=1) + 1e-100
        pulled = np.zeros_like(weight)
        if len(local):
            starts = np.flatnonzero(np.r_[True, local[1:] != local[:-1]])
            pulled[local[starts]] = np.add.reduceat(rows * (cnt / norm)[:, None], starts, axis=0)
        fresh = weight * pulled + prior
        change = np.abs(fresh - gamma[chosen]).mean(axis=1)
        gamma[chosen] = fresh
        live[chosen[change <= 1e-2]] = False
    return gamma


def normalize_gamma(gamma):
    """exp of the Dirichlet expectation, NaN as 0, rows scaled to sum to one."""
    weight = np.exp(dirichlet_expectation(np.nan_to_num(gamma)))
    return weight / weight.sum(axis=1, keepdims=True)


def pieces(sizes: np.ndarray, rows: int, cells: int = CELLS_AT_ONCE):
    """Slices of a batch of documents with at most ``rows`` of them and ``cells`` words, or one document with more."""
    through, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        before = through[begin - 1] if begin else 0
        end = min(begin + rows, max(begin + 1, int(np.searchsorted(through, before + cells, side="right"))))
        yield slice(begin, end)
        begin = end


def infer_doc_topics(
    vectors: DataFrame,
    beta: np.ndarray,
    prior: float | None = None,
    n_iter: int = 150,
    gamma_shape: float = 1.0,
    seed: int = 0,
    block: int = 2048,
) -> DataFrame:
    """``(doc_id, gamma, p)``. Each document's start is drawn from its own id, so results do not depend
    on how the table is split."""
    k = beta.shape[1]
    prior = 1.0 / k if prior is None else prior
    shared = vectors.sparkSession.sparkContext.broadcast(beta)  # V x k, a bounded vocabulary

    def apply(frames):
        for pdf in frames:
            for piece in pieces(pdf["ids"].map(len).to_numpy(dtype=np.int64), block):
                part = pdf.iloc[piece]
                sizes = part["ids"].map(len).to_numpy()
                some = sizes.sum() > 0
                ids = np.concatenate(part["ids"].to_numpy()) if some else np.zeros(0, dtype=int)
                counts = np.concatenate(part["cnts"].to_numpy()) if some else np.zeros(0)
                start = np.stack(
                    [np.random.default_rng([seed, int(d) % (1 << 64)]).gamma(gamma_shape, 1 / gamma_shape, k) for d in part["doc_id"]]
                )
                gamma = infer_block(ids, counts, sizes, shared.value, start, prior, n_iter)
                yield pd.DataFrame({"doc_id": part["doc_id"], "gamma": list(gamma), "p": list(normalize_gamma(gamma))})

    columns = vectors.select("doc_id", "ids", "cnts")
    return columns.mapInPandas(apply, "doc_id long, gamma array<double>, p array<double>")


def doc_topic_rows(inferred: DataFrame) -> DataFrame:
    """``(doc_id, topic, p)`` in long form."""
    return inferred.select("doc_id", F.posexplode("p").alias("topic", "p"))


def perplexity(vectors: DataFrame, inferred: DataFrame, beta: np.ndarray, alpha: np.ndarray) -> DataFrame:
    """``(perplexity, n_words)``: minus the summed document bounds per word."""
    log_beta = np.log(beta)
    alpha = np.asarray(alpha, dtype=float)
    shared = vectors.sparkSession.sparkContext.broadcast(log_beta)

    def apply(frames):
        for pdf in frames:
            for piece in pieces(pdf["ids"].map(len).to_numpy(dtype=np.int64), 2048):
                part = pdf.iloc[piece]
                sizes = part["ids"].map(len).to_numpy()
                owner = np.repeat(np.arange(len(part)), sizes)
                some = len(owner) > 0
                ids = np.concatenate(part["ids"].to_numpy()) if some else np.zeros(0, dtype=int)
                counts = np.concatenate(part["cnts"].to_numpy()) if some else np.zeros(0)
                gamma = np.stack(part["gamma"].to_numpy())
                expected = dirichlet_expectation(gamma)
                of_words = counts * log_sum_exp(shared.value[ids] + expected[owner]) if some else counts
                bound = np.bincount(owner, of_words, minlength=len(part))
                bound += ((alpha - gamma) * expected + gammaln(gamma) - gammaln(alpha)).sum(axis=1)
                bound += gammaln(alpha.sum()) - gammaln(gamma.sum(axis=1))
                yield pd.DataFrame({"bound": bound, "words": np.bincount(owner, counts, minlength=len(part))})

    rows = vectors.join(inferred.select("doc_id", "gamma"), "doc_id").select("ids", "cnts", "gamma")
    parts = rows.mapInPandas(apply, "bound double, words double")
    return parts.agg((-F.sum("bound") / F.sum("words")).alias("perplexity"), F.sum("words").alias("n_words"))
