"""First, second and third moments of document vectors, and whitening.

Documents are sparse rows ``(doc_id, ids, cnts)`` over a bounded vocabulary. Every pass adds up one
model-sized partial result per task; only model-sized numbers (V x V, V x k, k x k x k) reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmuration.functions.numeric import cube_sum, symmetrize_pair, top_eigen, triples, unpack_symmetric
from murmuration.operators.skew import by_bounds, global_rank
from murmuration.session import cut_lineage

MAX_GRAM = 6000  # widest vocabulary whose second moment (V x V) is built
CHUNK = 512  # documents handled at a time inside a task


def _flat(pdf):
    """``(sizes, ids, cnts)`` of sparse rows laid end to end."""
    sizes = pdf["ids"].map(len).to_numpy()
    if not sizes.sum():
        return sizes, np.zeros(0, dtype=np.int64), np.zeros(0)
    return sizes, np.concatenate(pdf["ids"].to_numpy()).astype(np.int64), np.concatenate(pdf["cnts"].to_numpy())


def _chunks(frames):
    for pdf in frames:
        for start in range(0, len(pdf), CHUNK):
            yield pdf.iloc[start : start + CHUNK]


def _add_products(gram, sizes, ids, cnts) -> None:
    """Add every row's x x^T to the upper triangle of ``gram``. Short rows touch only their own cells;
    rows dense enough for it go through a matrix product."""
    width = len(gram)
    pairs = int((sizes * (sizes + 1) // 2).sum())
    if pairs * 50 > len(sizes) * width * width:
        block = np.zeros((len(sizes), width))
        block[np.repeat(np.arange(len(sizes)), sizes), ids] = cnts
        gram += block.T @ block
        return
    ends = np.repeat(np.cumsum(sizes), sizes)
    reach = ends - np.arange(len(ids))  # cells from each entry to the end of its row, itself included
    first = np.repeat(np.arange(len(ids)), reach)
    second = first + np.arange(pairs) - np.repeat(np.cumsum(reach) - reach, reach)
    np.add.at(gram.reshape(-1), ids[first] * width + ids[second], cnts[first] * cnts[second])


def _row_sums(table, sizes, ids, cnts):
    """Each sparse row times a table with one line per term."""
    result = np.zeros((len(sizes), table.shape[1]))
    filled = np.flatnonzero(sizes)
    if len(filled):
        starts = (np.cumsum(sizes) - sizes)[filled]
        result[filled] = np.add.reduceat(table[ids] * cnts[:, None], starts, axis=0)
    return result


def one_pass_per_core(df: DataFrame) -> DataFrame:
    """About as many tasks as cores, so that few model-sized partial results travel. The shuffle setting
    counts too, since executors may not have arrived yet when the plan is made."""
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.coalesce(tasks)


def add_up(partials: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Element-wise sum of array columns per key, JVM-side."""
    total = Summarizer.sum(array_to_vector(F.col(value)))
    return partials.groupBy(*keys).agg(vector_to_array(total).alias(value))


def gram_rows(vectors: DataFrame, width: int, period: str | None = None) -> DataFrame:
    """Sums over documents: row ``i`` >= 0 holds sum of x_i x_j for j >= i, row -1 the sum of x, row -2
    the document count. With ``period`` the sums are kept apart per value of that column."""
    if width > MAX_GRAM:
        raise ValueError(f"second moments need a vocabulary of at most {MAX_GRAM} terms")

    def emit(label, gram, first, count):
        for start in range(0, width, 256):
            index = range(start, min(width, start + 256))
            yield pd.DataFrame({"period": label, "i": list(index), "v": [gram[i, i:] for i in index]})
        yield pd.DataFrame({"period": label, "i": [-1, -2], "v": [first, np.array([float(count)])]})

    def partial(frames):
        state = None  # one period at a time: rows arrive sorted by it
        for part in _chunks(frames):
            labels = part["period"].to_numpy() if period else np.zeros(len(part), dtype=int)
            for label in pd.unique(labels):
                sizes, ids, cnts = _flat(part[labels == label])
                if state is not None and state[0] != label:
                    yield from emit(*state)
                    state = None
                if state is None:
                    state = [label, np.zeros((width, width)), np.zeros(width), 0]
                _add_products(state[1], sizes, ids, cnts)
                state[2] += np.bincount(ids, cnts, minlength=width)
                state[3] += len(sizes)
        if state is not None:
            yield from emit(*state)

    source = vectors.select("ids", "cnts", *([F.col(period).alias("period")] if period else []))
    label = source.schema["period"].dataType.simpleString() if period else "long"
    tasks = one_pass_per_core(source)
    tasks = tasks.sortWithinPartitions("period") if period else tasks
    partials = tasks.mapInPandas(partial, f"period {label}, i int, v array<double>")
    return add_up(partials, ["period", "i"])


@dataclass
class Moments:
    """Additive state: document count, sum of x, sum of x x^T."""

    n: float
    first: np.ndarray
    second: np.ndarray

    @staticmethod
    def from_rows(rows, width: int) -> dict:
        """Per period, the state held by collected ``gram_rows``; V + 2 rows each."""
        states = {}
        for row in rows:
            state = states.setdefault(row["period"], Moments(0.0, np.zeros(width), np.zeros((width, width))))
            values = np.asarray(row["v"])
            if row["i"] == -2:
                state.n = float(values[0])
            elif row["i"] == -1:
                state.first = values
            else:
                state.second[row["i"], row["i"] :] = values
                state.second[row["i"] :, row["i"]] = values
        return states

    @staticmethod
    def of(vectors: DataFrame, width: int) -> "Moments":
        states = Moments.from_rows(gram_rows(vectors, width).collect(), width)
        return states.get(0, Moments(0.0, np.zeros(width), np.zeros((width, width))))

    def merge(self, other: "Moments") -> "Moments":
        return Moments(self.n + other.n, self.first + other.first, self.second + other.second)

    @property
    def mean(self) -> np.ndarray:
        return self.first / self.n

    def covariance(self, alpha0: float) -> np.ndarray:
        return (alpha0 + 1) * (self.second / self.n - np.outer(self.mean, self.mean))

    def exact_second(self, alpha0: float) -> np.ndarray:
        pairs = self.second / self.n - np.diag(self.mean)
        return (alpha0 + 1) * pairs - alpha0 * np.outer(self.mean, self.mean)


def second_moment(vectors: DataFrame, width: int, alpha0: float, exact: bool = False) -> DataFrame:
    """``(i, j, v)`` for i <= j: the centred second moment, or with ``exact`` the single-topic form."""
    rows = cut_lineage(gram_rows(vectors, width).drop("period"), "gram")
    count = rows.where("i = -2").select(F.col("v")[0]).scalar()
    mean = rows.where("i = -1").select(F.posexplode("v").alias("term", "s")).select("term", (F.col("s") / count).alias("m"))
    mean_i = F.broadcast(mean.select(F.col("term").alias("i"), F.col("m").alias("mi")))  # V rows
    mean_j = F.broadcast(mean.select(F.col("term").alias("j"), F.col("m").alias("mj")))
    pairs = (
        rows.where("i >= 0")
        .select("i", F.posexplode("v").alias("step", "s"))
        .select("i", (F.col("i") + F.col("step")).alias("j"), (F.col("s") / count).alias("e"))
        .join(mean_i, "i")
        .join(mean_j, "j")
    )
    product = F.col("mi") * F.col("mj")
    if exact:
        diagonal = F.when(F.col("i") == F.col("j"), F.col("mi")).otherwise(0.0)
        value = (alpha0 + 1) * (F.col("e") - diagonal) - alpha0 * product
    else:
        value = (alpha0 + 1) * (F.col("e") - product)
    return pairs.select("i", "j", value.alias("v"))


@dataclass
class Whitening:
    """Projection ``y = (x - mean) W`` and its way back; V x k numbers."""

    mean: np.ndarray
    vectors: np.ndarray  # V x k
    values: np.ndarray  # k
    centred: bool = True
    spectrum: np.ndarray = field(default=None, repr=False)

    @property
    def forward(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)

    @property
    def backward(self) -> np.ndarray:
        return self.vectors * np.sqrt(self.values)

    @property
    def k(self) -> int:
        return len(self.values)


def _fit(matrix, mean, k: int, centred: bool) -> Whitening:
    values, vectors = top_eigen(matrix, len(mean))
    # what rounding leaves of a zero eigenvalue is no axis
    if k > len(values) or values[k - 1] <= values[0] * len(mean) * np.finfo(float).eps:
        raise ValueError(f"the second moment has fewer than {k} positive eigenvalues")
    return Whitening(mean, vectors[:, :k], values[:k], centred, values)


def whiten_fit(moments: Moments, k: int, alpha0: float) -> Whitening:
    """Principal axes of the centred second moment scaled by (alpha0 + 1)."""
    return _fit(moments.covariance(alpha0), moments.mean, k, True)


def whiten_unit(moments: Moments, k: int) -> Whitening:
    """The variant without the alpha0 scale, whose rows have unit covariance."""
    return whiten_fit(moments, k, 0.0)


def whiten_exact(moments: Moments, k: int, alpha0: float) -> tuple[Whitening, float]:
    """Rank-k factors of the exact second moment, and their condition number; rows are not centred."""
    fitted = _fit(moments.exact_second(alpha0), moments.mean, k, False)
    return fitted, float(fitted.values.max() / fitted.values.min())


def project(vectors: DataFrame, forward: np.ndarray, offset: np.ndarray, keep: list[str] = ()) -> DataFrame:
    """``(doc_id, ..., y)``: each sparse row times a V x k table, minus a fixed row. Documents without
    known terms get the offset alone."""
    shared = vectors.sparkSession.sparkContext.broadcast((np.ascontiguousarray(forward), np.asarray(offset)))
    columns = ["doc_id", *keep]

    def apply(frames):
        table, shift = shared.value
        for part in _chunks(frames):
            out = part[columns].copy()
            out["y"] = list(_row_sums(table, *_flat(part)) - shift)
            yield out

    types = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in columns)
    return vectors.select(*columns, "ids", "cnts").mapInPandas(apply, f"{types}, y array<double>")


def whiten_transform(vectors: DataFrame, whitening: Whitening, keep: list[str] = ()) -> DataFrame:
    forward = whitening.forward
    offset = whitening.mean @ forward if whitening.centred else np.zeros(whitening.k)
    return project(vectors, forward, offset, keep)


def explained_variance(spark, whitening: Whitening) -> DataFrame:
    """``(component, ratio, cumulative)`` over the whole spectrum; V rows."""
    values = np.clip(whitening.spectrum, 0, None)
    rows = [(i + 1, float(v)) for i, v in enumerate(values)]
    table = spark.createDataFrame(rows, "component long, v double")
    total = F.sum("v").over(Window.partitionBy())
    running = F.sum("v").over(Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0))
    return table.select("component", (F.col("v") / total).alias("ratio"), (running / total).alias("cumulative"))


def assign_batches(rows: DataFrame, n: int, batch_size: int) -> DataFrame:
    """``batch_id`` by position in id order, as many batches as the size asks for. The last may be short and is
    kept. The driver holds one id a batch."""
    if n == 0:
        raise ValueError("no documents, so no batch")
    if n <= batch_size:
        return rows.withColumn("batch_id", F.lit(0))
    # only ids are ranked; the first id of each batch then places the rows without moving them
    ranked = global_rank(rows.select("doc_id"), "doc_id", "_rank")
    firsts = [r["doc_id"] for r in ranked.where((F.col("_rank") > 1) & ((F.col("_rank") - 1) % batch_size == 0)).collect()]
    return by_bounds(rows, "doc_id", firsts, "batch_id")


def third_moment(whitened: DataFrame, k: int, keys: str = "batch_id") -> DataFrame:
    """``(key, n, t)`` with the unique entries of sum y x y x y per key. A task's rows come sorted by key, so it
    holds one sum at a time and gives out one row per key it meets."""
    index = triples(k)

    def partial(frames):
        current, total, count = None, 0.0, 0
        for pdf in frames:
            labels = pdf["key"].to_numpy()
            rows = np.stack(pdf["y"].to_numpy()) if len(pdf) else np.zeros((0, k))
            for label in pd.unique(labels):
                if count and label != current:
                    yield pd.DataFrame({"key": [current], "v": [np.append(total, count)]})
                    total, count = 0.0, 0
                chosen = rows[labels == label]
                total = total + sum(cube_sum(chosen[s : s + 4096])[index] for s in range(0, len(chosen), 4096))
                current, count = label, count + len(chosen)
        if count:
            yield pd.DataFrame({"key": [current], "v": [np.append(total, count)]})

    label = whitened.schema[keys].dataType.simpleString()
    source = whitened.select(F.col(keys).alias("key"), "y").sortWithinPartitions("key")
    partials = source.mapInPandas(partial, f"key {label}, v array<double>")
    totals = add_up(partials, ["key"])
    size = len(index[0])
    return totals.select(
        F.col("key").alias(keys), F.col("v")[size].cast("long").alias("n"), F.slice("v", 1, size).alias("t")
    )


def collect_tensors(table: DataFrame, k: int, key: str = "batch_id"):
    """``(keys, counts, mean tensors)`` of the few per-batch rows."""
    rows = sorted(table.collect(), key=lambda r: r[key])
    tensors = [unpack_symmetric(np.asarray(r["t"]), k) / r["n"] for r in rows]
    return [r[key] for r in rows], np.array([r["n"] for r in rows], dtype=float), np.array(tensors)


def exact_third_moment(vectors: DataFrame, whitening: Whitening, moments: Moments, alpha0: float) -> np.ndarray:
    """The exact third moment, contracted with the whitening table in all three positions.

    The corrections for repeated words live in word space: sum over words of x_i w_i x w_i x (y)
    per document and of x_i w_i x w_i x w_i overall. Only k x k x k sums leave a task.
    """
    k = whitening.k
    shared = vectors.sparkSession.sparkContext.broadcast(whitening.forward)
    index = triples(k)

    def partial(frames):
        table = shared.value
        squares = np.einsum("vi,vj->vij", table, table).reshape(len(table), k * k)
        total = np.zeros((k, k, k))
        for part in _chunks(frames):
            sizes, ids, cnts = _flat(part)
            rows = _row_sums(table, sizes, ids, cnts)
            spread = np.zeros((len(part), k * k))
            ends = np.cumsum(sizes)
            for start in range(0, len(part), 32):  # a few rows at a time: an entry opens k^2 numbers
                piece = slice(ends[start] - sizes[start], ends[min(start + 32, len(part)) - 1])
                spread[start : start + 32] = _row_sums(squares, sizes[start : start + 32], ids[piece], cnts[piece])
            total += cube_sum(rows) - symmetrize_pair(spread.reshape(-1, k, k), rows)
        yield pd.DataFrame({"key": [0], "v": [total[index]]})

    sums = vectors.select("ids", "cnts").mapInPandas(partial, "key int, v array<double>")
    raw = unpack_symmetric(np.asarray(add_up(sums, ["key"]).first()["v"]), k) / moments.n
    table, mean = whitening.forward, moments.mean
    raw += 2 * np.einsum("v,vi,vj,vm->ijm", mean, table, table, table, optimize=True)
    centre = mean @ table
    spread = np.einsum("v,vi,vj->ij", mean, table, table, optimize=True)
    result = (alpha0 + 1) * (alpha0 + 2) / 2 * raw
    result -= alpha0 * (alpha0 + 1) / 2 * symmetrize_pair(spread[None], centre[None])
    return result + alpha0**2 * np.einsum("i,j,m->ijm", centre, centre, centre)
