"""Hashed words and character n-grams of whole texts, and bounded labelled samples to learn from."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.llm.common import mix, prefix_hash, span_hash
from murmuration.session import cut_lineage

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LETTERS = np.full(256, 0x20, np.uint8)  # ASCII letters in lower case, bytes of other letters as they are, spaces for all else
LETTERS[0x80:] = np.arange(0x80, 0x100)
for _code in range(0x61, 0x7B):
    LETTERS[_code] = LETTERS[_code - 0x20] = _code
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_GRAM_TABLES = (mix(np.arange(1, 1 + 8 * 256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32).reshape(8, 256)
SCRAMBLE = np.uint32(0x9E3779B1)


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between white space, and the bounds of each text's words among them."""
    space = SPACE[data]
    begins, ends = ~space, ~space
    first = bounds[:-1][np.diff(bounds) > 0]
    before = np.empty(len(data), bool)
    before[:1] = True
    before[1:] = space[:-1]
    before[first] = True
    starts = np.flatnonzero(begins & before)
    after = np.empty(len(data), bool)
    after[-1:] = True
    after[:-1] = space[1:]
    after[first[first > 0] - 1] = True
    stops = np.flatnonzero(ends & after) + 1
    return starts, stops, np.searchsorted(starts, bounds)


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the stretches between bounds, each added up by itself; zero for empty ones."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]))
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full], axis=0, dtype=np.float64)
    return out


@dataclass(frozen=True)
class Features:
    """What of a text is counted: byte n-grams of these sizes, words, words that repeat the one before.

    Every feature is a bucket below ``1 << bits``; ``1 << bits`` itself means none.
    """

    grams: tuple[int, ...]
    bits: int
    letters_only: bool = False
    repeats: bool = False

    @property
    def none(self) -> int:
        return 1 << self.bits

    def of(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Lists of ``(buckets, bounds of each text among them)``."""
        if self.letters_only:
            data = LETTERS[data]
        shift, found = np.uint32(32 - self.bits), []
        for q in self.grams:
            held = max(0, len(data) - q + 1)
            value = np.full(held, q, np.uint32)
            for i in range(q):
                value += _GRAM_TABLES[i][data[i : i + held]]
            bucket = np.full(len(data), self.none, np.int32)
            bucket[:held] = (value * SCRAMBLE) >> shift
            for back in range(1, q):  # those that would reach into the next text
                at = bounds[1:] - back
                bucket[at[at >= bounds[:-1]]] = self.none
            found.append((bucket, bounds))
        starts, stops, of_text = word_bounds(data, bounds)
        word = span_hash(prefix_hash(data), starts, stops) if len(starts) else np.empty(0, np.uint64)
        found.append(((word >> np.uint64(64 - self.bits)).astype(np.int32), of_text))
        if self.repeats:
            same = np.zeros(len(word), bool)
            same[1:] = word[1:] == word[:-1]
            same[of_text[:-1][np.diff(of_text) > 0]] = False
            marked = int(mix(np.array([self.bits], np.uint64))[0] >> np.uint64(64 - self.bits))
            found.append((np.where(same, marked, self.none).astype(np.int32), of_text))
        return found

    def totals(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Features counted in each text."""
        return sum(segment_sums((bucket != self.none).astype(np.float64), bounds) for bucket, bounds in found)

    def means(self, table: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The mean of ``table``'s rows over the features of each text; ``table[none]`` must be zero."""
        found = self.of(data, bounds)
        total = np.maximum(self.totals(found), 1)
        return sum(segment_sums(table[bucket], of_text) for bucket, of_text in found) / total.reshape(-1, *[1] * (table.ndim - 1))

    def rows(self, data: np.ndarray, bounds: np.ndarray) -> Rows:
        """Sparse rows of feature shares, for learning."""
        found, n = self.of(data, bounds), len(bounds) - 1
        keys = np.concatenate(
            [(np.repeat(np.arange(n), np.diff(of_text)) << 32 | bucket)[bucket != self.none] for bucket, of_text in found]
        )
        keys, count = np.unique(keys, return_counts=True)
        row, column = keys >> 32, (keys & 0xFFFFFFFF).astype(np.int32)
        starts = np.searchsorted(row, np.arange(n + 1))
        return Rows(column, (count / np.maximum(self.totals(found), 1)[row]).astype(np.float32), starts)


@dataclass
class Rows:
    columns: np.ndarray
    values: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def take(self, rows: np.ndarray) -> Rows:
        sizes = self.bounds[rows + 1] - self.bounds[rows]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(ends[-1]) + np.repeat(self.bounds[rows] - ends[:-1], sizes)
        return Rows(self.columns[at], self.values[at], ends)


def remainder(id_col: str, divisor: int) -> Column:
    """The CRC-32 of the id's decimal text modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor


def labelled_sample(
    docs: DataFrame, id_col: str, label: str, text: str, each: int, largest: int, labels: int = 1024, known: DataFrame | None = None
) -> pa.Table:
    """At most ``each`` rows of each label, as ``(label, text)`` on the driver; more than ``labels`` labels are an error.

    ``known`` holds ``(id, label)`` where the label is no column of the documents. Only for fitting: of over 64 labels
    fewer rows are taken each, 64 times ``each`` in all, and of texts those of up to ``largest`` bytes, so the sample has
    a fixed bound. A label without such texts gives its smallest text. Which rows are taken depends on a hash of their id
    and text alone. Ranks are found on ids, sizes and hashes; texts are read again for the rows taken and never shuffled.
    """
    named = docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull())
    order = F.xxhash64(id_col, text)
    size = F.octet_length(text).cast("long").alias("bytes")
    if known is None:
        light = named.select(F.col(id_col).alias("id"), size, order.alias("order"), F.col(label).alias("label"))
    else:
        light = named.select(F.col(id_col).alias("id"), size, order.alias("order")).join(known.select(F.col(id_col).alias("id"), F.col(label).alias("label")), "id")
    light = cut_lineage(light.where("label IS NOT NULL").withColumn("label", F.col("label").cast("string")), "labelled")
    fits = F.col("bytes") <= largest
    counts = light.groupBy("label").agg(F.count_if(fits).alias("count"), F.min("bytes").alias("least"))
    counts = counts.orderBy(F.desc("count"), "label").limit(labels + 1).collect()
    if len(counts) > labels:
        raise ValueError(f"more than {labels} labels")
    if not counts:
        return pa.table({"label": pa.array([], pa.string()), "text": pa.array([], pa.string())})
    each = min(each, max(1, 64 * each // len(counts)))
    spark, by_order = docs.sparkSession, Window.partitionBy("label").orderBy("order")
    cuts = []
    for row in counts:  # a share of the hashes first, with room to spare, so that few rows are ranked however many there are
        share = min(1.0, 1.5 * each / row["count"] + 50 / row["count"]) if row["count"] else 1.0
        cuts.append((row["label"], min(int(-(1 << 63) + share * ((1 << 64) - 1)), (1 << 63) - 1)))
    usable = light.where(fits).join(F.broadcast(spark.createDataFrame(cuts, "label string, cut long")), "label").where("order <= cut").drop("cut")
    ranked = usable.select(*light.columns).withColumn("n", F.row_number().over(by_order)).where(F.col("n") <= each)
    large = [(row["label"], row["least"]) for row in counts if not row["count"]]
    if large:
        smallest = light.join(F.broadcast(spark.createDataFrame(large, "label string, bytes long")), ["label", "bytes"]).select(*light.columns)
        ranked = ranked.unionByName(smallest.withColumn("n", F.row_number().over(by_order)).where("n = 1"))
    taken = cut_lineage(ranked.select(F.col("id").alias("of"), "order", "label", "n"), "taken")
    texts = docs.select(F.col(id_col).alias("of"), order.alias("order"), F.col(text).alias("text"))
    found = texts.join(F.broadcast(taken), ["of", "order"]).select("label", "n", "text")  # at most 64 * each rows without texts
    table = found.toArrow().sort_by([("label", "ascending"), ("n", "ascending")])
    place = list(zip(table["label"].to_pylist(), table["n"].to_pylist(), strict=True))  # rows that repeat id and text come up once for each
    first = [i for i, x in enumerate(place) if i == 0 or x != place[i - 1]]
    return table.take(pa.array(first, pa.int64())).select(["label", "text"])
