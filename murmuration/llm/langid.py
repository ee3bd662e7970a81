"""Language ID: the family first, then linear support vector machines between the languages of it."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.llm.common import text_slices, tidy
from murmuration.llm.features import IS_LETTER, Features, Rows, labelled_sample, remainder

UNDETERMINED = "und"
# --- fixed values: families of languages by their codes; a language that is not listed is a family by itself
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "indic": "hi ur bn pa gu mr ne si",
    "turkic": "tr az kk ky uz tk",
    "uralic": "fi et hu",
    "semitic": "ar he am mt",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
FEATURES = Features(grams=(2, 3), bits=16, letters_only=True)


def hinge_fit(rows: Rows, sign: np.ndarray, size: int, epochs: int = 12, batch: int = 64, reg: float = 1e-4, seed: int = 0) -> np.ndarray:
    """Weights and, last, the offset of a linear support vector machine; averaged stochastic subgradient descent."""
    rng = np.random.default_rng(seed)
    weights, mean, step = np.zeros(size + 1), np.zeros(size + 1), 0
    balance = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())) * len(sign)
    for epoch in range(epochs):
        order = rng.permutation(len(sign))
        for first in range(0, len(order), batch):
            chosen = order[first : first + batch]
            part, want = rows.take(chosen), sign[chosen]
            of = np.repeat(np.arange(len(chosen)), np.diff(part.bounds))
            margin = np.bincount(of, part.values * weights[part.columns], minlength=len(chosen)) + weights[-1]
            push = np.where(want * margin < 1, want * balance[chosen], 0.0) / len(chosen)
            step += 1
            rate = 1 / (reg * (step + 1 / (reg * 0.5)))
            weights[:-1] *= 1 - rate * reg
            weights[:-1] += rate * np.bincount(part.columns, part.values * push[of], minlength=size)
            weights[-1] += 0.1 * rate * push.sum()
        if epoch >= epochs // 2:
            mean += weights / (epochs - epochs // 2)
    return mean


def slope(rows: Rows, sign: np.ndarray, weights: np.ndarray) -> float:
    """How steeply a margin becomes a probability: the slope of a one-parameter logistic fit."""
    of = np.repeat(np.arange(len(rows)), np.diff(rows.bounds))
    margin = (np.bincount(of, rows.values * weights[rows.columns], minlength=len(rows)) + weights[-1]) * sign
    tried = np.geomspace(0.5, 64, 22)
    loss = [np.logaddexp(0, -np.clip(a * margin, -500, 500)).mean() + 1e-4 * a for a in tried]
    return float(tried[int(np.argmin(loss))])


@dataclass
class LanguageModel:
    """Machines in the columns of ``table``: one for each family, then one for each pair within a family."""

    languages: list[str]
    families: list[str]
    family_of: np.ndarray
    pairs: list[tuple[int, int]]
    table: np.ndarray
    offsets: np.ndarray
    slopes: np.ndarray

    def predict(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language (-1: undetermined) and score of each text."""
        n, n_families = len(bounds) - 1, len(self.families)
        if not self.languages:
            return np.full(n, -1), np.zeros(n)
        margin = FEATURES.means(self.table, data, bounds) + self.offsets
        chance = 1 / (1 + np.exp(-np.clip(margin * self.slopes, -500, 500)))
        of_family = chance[:, :n_families]
        family = of_family.argmax(axis=1)
        # each language's least chance against the others of its family, and the votes it wins there
        least, votes = np.ones((n, len(self.languages))), np.zeros((n, len(self.languages)))
        for at, (a, b) in enumerate(self.pairs, n_families):
            for language, won in ((a, chance[:, at]), (b, 1 - chance[:, at])):
                votes[:, language] += won > 0.5
                least[:, language] = np.minimum(least[:, language], won)
        ranked = np.where(self.family_of[None, :] == family[:, None], votes + 0.5 * least, -1.0)
        language = ranked.argmax(axis=1)
        everyone = np.arange(n)
        # with few features there is little to go by, so the margin of a short text counts less
        score = (of_family[everyone, family] if n_families > 1 else 1.0) * least[everyone, language]
        lettered = has_letter(data, bounds)
        return np.where(lettered, language, -1), np.where(lettered, score, 0.0)


def has_letter(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    counts = np.concatenate([[0], np.cumsum(IS_LETTER[data])])
    found = counts[bounds[1:]] > counts[bounds[:-1]]
    for row in np.flatnonzero(~found):
        found[row] = any(c.isalpha() for c in data[bounds[row] : bounds[row + 1]].tobytes().decode("utf-8", "replace"))
    return found


def fit(sample: pa.Table) -> LanguageModel:
    """Learn from ``(label, text)`` rows; texts without letters are left out. Of none, nothing can be told."""
    labels = np.array(sample["label"].to_pylist(), object)
    column = pa.array(sample["text"].to_pylist(), pa.large_string())
    parts, lettered = [], []
    for _, _, data, bounds in text_slices(column):
        parts.append(FEATURES.rows(data, bounds))
        lettered.append(has_letter(data, bounds))
    if not parts or not np.concatenate(lettered).any():
        empty = np.zeros(0)
        return LanguageModel([], [], empty, [], np.zeros((FEATURES.none + 1, 0), np.float32), empty, empty)
    ends = np.cumsum([0, *(len(p.columns) for p in parts)])
    rows = Rows(
        np.concatenate([p.columns for p in parts]), np.concatenate([p.values for p in parts]),
        np.concatenate([[0], *(p.bounds[1:] + e for p, e in zip(parts, ends, strict=False))]),
    )
    del parts
    usable = np.flatnonzero(np.concatenate(lettered))
    if len(usable) < len(rows):
        rows, labels = rows.take(usable), labels[usable]
    of = np.repeat(np.arange(len(rows)), np.diff(rows.bounds))
    unit = 1 / np.sqrt(np.bincount(of, rows.values.astype(np.float64) ** 2, minlength=len(rows))).mean()
    rows.values = (rows.values * unit).astype(np.float32)
    languages = sorted(set(labels))
    family_names = [FAMILY_OF.get(x, x) for x in languages]
    families = sorted(set(family_names))
    family_of = np.array([families.index(x) for x in family_names])
    which = np.array([languages.index(x) for x in labels])
    pairs = [(a, b) for a, b in combinations(range(len(languages)), 2) if family_of[a] == family_of[b]]
    columns, slopes = [], []
    tasks = [(np.arange(len(which)), np.where(family_of[which] == f, 1.0, -1.0)) for f in range(len(families))]
    tasks += [(np.flatnonzero((which == a) | (which == b)), a) for a, b in pairs]
    for chosen, sign in tasks:
        if not isinstance(sign, np.ndarray):
            sign = np.where(which[chosen] == sign, 1.0, -1.0)
        part = rows.take(chosen) if len(chosen) < len(rows) else rows
        weights = hinge_fit(part, sign, FEATURES.none)
        columns.append(weights)
        slopes.append(slope(part, sign, weights))
    stacked = np.array(columns).T
    table = np.zeros((FEATURES.none + 1, len(columns)), np.float32)
    table[:-1] = stacked[:-1] * unit
    return LanguageModel(languages, families, family_of, pairs, table, stacked[-1], np.array(slopes))


def learn(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", each: int = 1000, largest: int = 1 << 15) -> LanguageModel:
    """A model from at most ``each`` documents of each language, none of those with ``crc32(id) mod 4 = 2``.

    Every language is learned; of over 64 each gives fewer documents, more than 1,024 are an error. ``each`` and ``largest``
    (bytes of a text) bound what is fitted on; everything is predicted on. A language of larger texts alone gives its smallest.
    """
    model = fit(labelled_sample(docs.where(remainder(id_col, 4) != 2), id_col, lang, text, each, largest))
    tidy()  # the driver goes on to other work
    return model


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add ``lang_pred string, score double`` from the text alone, all of it.

    ``und`` with score 0 for null and empty texts and those without a letter, and where no labelled text was given. The score is the family's
    probability times the least one against the other languages of the family. Given columns of these names
    are replaced; rows are independent, and an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 65,537 rows of one number a machine

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def told(column: pa.Array) -> pa.Array:
        known = shared.value
        words = np.array([*known.languages, UNDETERMINED], object)
        found = [known.predict(data, bounds) for _, _, data, bounds in text_slices(column)]
        language = np.concatenate([f[0] for f in found]) if found else np.empty(0, int)
        score = np.concatenate([f[1] for f in found]) if found else np.empty(0)
        tidy()
        return pa.StructArray.from_arrays([pa.array(words[language], pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    both = docs.select(*kept, told(text).alias("lang_pred"))  # texts go to Python, only the answers come back
    return both.select(*kept, F.col("lang_pred.lang_pred").alias("lang_pred"), F.col("lang_pred.score").alias("score"))


def language_id(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``(id, held_out, lang_pred, score)`` of every document; ``held_out`` is null for a null id."""
    model = learn(docs, id_col, text, lang)
    scored = predict(docs.select(id_col, text), model, text)
    return scored.select(id_col, (remainder(id_col, 4) == 2).alias("held_out"), "lang_pred", "score")
