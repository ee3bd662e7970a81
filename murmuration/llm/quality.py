"""Quality classifier: learned vectors of hashed words and character n-grams, averaged, with a softmax above."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.llm.common import text_slices, tidy
from murmuration.llm.features import Features, Rows, labelled_sample, remainder

FEATURES = Features(grams=(3, 4), bits=17, repeats=True)


@dataclass
class QualityModel:
    """``vectors``: one for each feature; ``outputs``: what a mean vector gives for labels 0 and 1."""

    vectors: np.ndarray
    outputs: np.ndarray
    offsets: np.ndarray

    def table(self) -> np.ndarray:
        """What each feature adds to label 1 over label 0: the softmax of two needs no more than that."""
        gain = self.vectors @ (self.outputs[:, 1] - self.outputs[:, 0])
        return np.append(gain, 0).astype(np.float32)


def fit(sample: pa.Table, dim: int = 8, steps: int = 800, batch: int = 32, rate: float = 30.0, seed: int = 0) -> QualityModel:
    """Stochastic gradient descent on the cross entropy of ``(label, text)`` rows with labels 0 and 1.

    ``steps`` batches whatever the number of rows. Both labels weigh alike. Rates fall in a straight line. Without any row, every text scores one half.
    """
    rng = np.random.default_rng(seed)
    vectors = np.asfortranarray(rng.uniform(-1, 1, (FEATURES.none, dim)) / dim)
    outputs, offsets = rng.uniform(-1, 1, (dim, 2)) / dim, np.zeros(2)
    label = np.array([int(x) for x in sample["label"].to_pylist()], np.int64)
    parts = [FEATURES.rows(data, bounds) for _, _, data, bounds in text_slices(pa.array(sample["text"].to_pylist(), pa.large_string()))]
    if not parts:
        return QualityModel(np.zeros_like(vectors), outputs, offsets)
    ends = np.cumsum([0, *(len(p.columns) for p in parts)])
    rows = Rows(
        np.concatenate([p.columns for p in parts]), np.concatenate([p.values for p in parts]),
        np.concatenate([[0], *(p.bounds[1:] + e for p, e in zip(parts, ends, strict=False))]),
    )
    weight = len(label) / 2 / np.maximum(np.bincount(label, minlength=2), 1)
    step = 0
    while step < steps:
        order = rng.permutation(len(label))
        for first in range(0, min(len(label), (steps - step) * batch), batch):
            chosen = order[first : first + batch]
            part = rows.take(chosen)
            of = np.repeat(np.arange(len(chosen)), np.diff(part.bounds))
            mean = np.stack([np.bincount(of, part.values * vectors[part.columns, d], minlength=len(chosen)) for d in range(dim)], axis=1)
            raw = mean @ outputs + offsets
            chance = np.exp(raw - raw.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            error = chance
            error[np.arange(len(chosen)), label[chosen]] -= 1
            error *= weight[label[chosen]][:, None] / len(chosen)
            now = rate * (1 - step / steps)
            step += 1
            back = error @ outputs.T
            for d in range(dim):
                vectors[:, d] -= now * np.bincount(part.columns, part.values * back[of, d], minlength=FEATURES.none)
            outputs -= 0.05 * now * mean.T @ error
            offsets -= 0.05 * now * error.sum(axis=0)
    return QualityModel(vectors, outputs, offsets)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", each: int = 1500, largest: int = 1 << 15) -> QualityModel:
    """A model from at most ``each`` documents of each label, none of those with ``crc32(id) mod 5 = 0``.

    Labels other than 0 and 1 are not used. ``each`` and ``largest`` (bytes of a text) bound what is fitted on.
    """
    known = labels.where((remainder(id_col, 5) != 0) & F.col(label).isin(0, 1)).groupBy(id_col).agg(F.min(label).alias("_label"))
    model = fit(labelled_sample(docs.where(remainder(id_col, 5) != 0), id_col, "_label", text, each, largest, labels=2, known=known))
    tidy()  # the driver goes on to other work
    return model


def score(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of label 1, from the whole text alone; null and empty texts have that of no feature.

    A given column ``out`` is replaced; rows are independent, and an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.table(), float(model.offsets[1] - model.offsets[0])))  # half a megabyte

    @F.arrow_udf("double")
    def chance(column: pa.Array) -> pa.Array:
        table, offset = shared.value
        found = [FEATURES.means(table, data, bounds) for _, _, data, bounds in text_slices(column)]
        raw = np.concatenate(found) + offset if found else np.empty(0)
        tidy()
        return pa.array(1 / (1 + np.exp(-np.clip(raw, -500, 500))), pa.float64())

    return docs.select(*[c for c in docs.columns if c != out], chance(text).alias(out))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``(id, held_out, score, predicted)`` of every document; ``held_out`` is null for a null id."""
    scored = score(docs.select(id_col, text), learn(docs, labels, id_col, text), text)
    return scored.select(
        id_col, (remainder(id_col, 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
