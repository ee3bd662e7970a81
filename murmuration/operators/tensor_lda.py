"""Topics by the method of moments: a symmetric decomposition of the whitened third moment.

Spark adds up one k x k x k tensor per minibatch in a single pass over the documents. A minibatch
gradient depends on its documents only through that tensor, so the descent itself needs no more data.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.functions.numeric import triples, unpack_symmetric
from murmuration.operators import moments as M
from murmuration.operators.spectral import leading_axes
from murmuration.session import cut_lineage, scratch_path

TENSOR_BYTES = 1 << 29  # larger sets of batch tensors stay out of the driver; each step then sums over its batch's rows


@dataclass(frozen=True)
class TopicParams:
    """``init``: 'tiny' draws N(0,1)/1e4, 'scaled' N(0, s^2) with s = (scale/sqrt(k))^(1/3).
    ``schedule``: 'decay' is rate*10/(10+epoch), 'cosine' is rate*(cos(1000*pi*epoch/batch)+1.0001)."""

    n_topics: int
    alpha0: float = 0.003
    n_iter: int = 1000
    batch_size: int = 15000
    learning_rate: float = 0.01
    theta: float = 1.0
    init: str = "tiny"
    scale: float = 0.001
    schedule: str = "decay"
    seed: int = 0


def initial_factors(params: TopicParams) -> np.ndarray:
    k = params.n_topics
    draw = np.random.default_rng(params.seed).standard_normal((k, k))
    return draw / 1e4 if params.init == "tiny" else draw * (params.scale / math.sqrt(k)) ** (1 / 3)


def step_size(params: TopicParams, epoch: int) -> float:
    if params.schedule == "decay":
        return params.learning_rate * 10 / (10 + epoch)
    return params.learning_rate * (math.cos(1000 * math.pi * epoch / params.batch_size) + 1.0001)


def contract(tensor: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """Column c of the result is the tensor applied to (phi_c, phi_c)."""
    k, rank = phi.shape
    half = (tensor.reshape(k * k, k) @ phi).reshape(k, k, rank)
    return np.einsum("ijc,jc->ic", half, phi)


def cumulant_gradient(phi: np.ndarray, mean_tensor: np.ndarray, alpha0: float = 1.0, theta: float = 1.0) -> np.ndarray:
    """Average gradient of a batch whose mean of y x y x y is ``mean_tensor``; columns are topics."""
    pull = 3 * (1 + theta) * phi @ ((phi.T @ phi) ** 2)
    return pull - 3 * (1 + alpha0) * (2 + alpha0) / 2 * contract(mean_tensor, phi)


def batch_loss(phi: np.ndarray, mean_tensor: np.ndarray, alpha0: float = 1.0, theta: float = 1.0) -> float:
    """What a step on a batch lowers: the function whose gradient is ``cumulant_gradient``."""
    pull = (1 + theta) / 2 * ((phi.T @ phi) ** 3).sum()
    return float(pull - (1 + alpha0) * (2 + alpha0) / 2 * (phi * contract(mean_tensor, phi)).sum())


def steady_step(phi: np.ndarray, tensor: np.ndarray, rate: float, params: TopicParams) -> np.ndarray:
    """The step on a batch, halved until it does not raise the batch's loss; a step that lowers it is taken as it is.

    ``cumulant_gradient`` and ``batch_loss`` of one place, which share what they are made of: a descent takes millions of steps.
    """
    pull, push = 1 + params.theta, (1 + params.alpha0) * (2 + params.alpha0) / 2
    gram, pushed = phi.T @ phi, contract(tensor, phi)
    squares = gram * gram
    gradient = 3 * pull * phi @ squares - 3 * push * pushed
    before = pull / 2 * (squares * gram).sum() - push * (phi * pushed).sum()
    allowed = before + 1e-9 * abs(before)  # rounding near the bottom is no rise
    for _ in range(200):
        fresh = phi - rate * gradient
        gram = fresh.T @ fresh
        if pull / 2 * (gram * gram * gram).sum() - push * (fresh * contract(tensor, fresh)).sum() <= allowed:  # never of what is not finite
            return fresh
        rate /= 2
    return phi if np.isfinite(before) else fresh


def descend(phi: np.ndarray, tensors: np.ndarray, params: TopicParams, first_epoch: int = 1, steady: bool = False) -> np.ndarray:
    """Epochs of minibatch steps on the driver, over tensors of at most ``TENSOR_BYTES``. With ``steady`` a step too long
    for its batch is shortened, for batches unlike those that the learning rate was chosen for."""
    phi = phi.copy()
    for epoch in range(first_epoch, params.n_iter):
        rate = step_size(params, epoch)
        with np.errstate(over="ignore", invalid="ignore"):
            for tensor in tensors:
                if steady:
                    phi = steady_step(phi, tensor, rate, params)
                else:
                    phi -= rate * cumulant_gradient(phi, tensor, params.alpha0, params.theta)
        if not np.isfinite(phi).all():
            raise FloatingPointError("the descent left the finite range; use a smaller learning rate")
    return phi


def descend_finite(phi: np.ndarray, tensors: np.ndarray, params: TopicParams) -> np.ndarray:
    """``descend``, and if it leaves the finite range the same epochs from the same start with steps too long for their batch shortened."""
    try:
        return descend(phi, tensors, params)
    except FloatingPointError:
        return descend(phi, tensors, params, steady=True)


@dataclass
class WrittenBatches:
    """Whitened rows in the shared folder, one part per minibatch, with each batch's number of rows."""

    path: str
    counts: list[int]

    @staticmethod
    def of(vectors: DataFrame, whitening: M.Whitening, n: int, batch_size: int) -> WrittenBatches:
        if n == 0:
            raise ValueError("no documents, so no batch")
        spark = vectors.sparkSession
        path = scratch_path(spark, "batches")
        batched = M.assign_batches(vectors, n, batch_size)
        M.whiten_transform(batched, whitening, ["batch_id"]).write.partitionBy("batch_id").parquet(path)
        counted = spark.read.parquet(path).groupBy("batch_id").count().orderBy("batch_id").collect()
        return WrittenBatches(path, [r["count"] for r in counted])

    def rows(self, spark, batch: int) -> DataFrame:
        return spark.read.schema("y array<double>").parquet(f"{self.path}/batch_id={batch}")


def descend_on_data(phi: np.ndarray, spark, batches: WrittenBatches, params: TopicParams) -> np.ndarray:
    """The steps of ``descend`` without tensors: one small sum over the rows of its batch for each."""
    phi = phi.copy()
    for epoch in range(1, params.n_iter):
        rate = step_size(params, epoch)
        for batch, n in enumerate(batches.counts):
            shared = spark.sparkContext.broadcast(phi)

            def partial(frames, shared=shared):
                total = 0.0
                for pdf in frames:
                    rows = np.stack(pdf["y"].to_numpy())
                    total = total + rows.T @ (rows @ shared.value) ** 2
                if not np.isscalar(total):
                    yield pd.DataFrame({"i": range(len(total)), "v": list(total)})

            sums = M.add_up(batches.rows(spark, batch).mapInPandas(partial, "i int, v array<double>"), ["i"])
            push = np.array([r["v"] for r in sorted(sums.collect(), key=lambda r: r["i"])]) / n
            with np.errstate(over="ignore", invalid="ignore"):
                pull = 3 * (1 + params.theta) * phi @ ((phi.T @ phi) ** 2)
                phi = phi - rate * (pull - 3 * (1 + params.alpha0) * (2 + params.alpha0) / 2 * push)
            shared.unpersist()
            if not np.isfinite(phi).all():
                raise FloatingPointError("the descent left the finite range; use a smaller learning rate")
    return phi


def rebuild(phi: np.ndarray, weights=None) -> np.ndarray:
    """Sum over columns of phi_c x phi_c x phi_c."""
    weights = np.ones(phi.shape[1]) if weights is None else weights
    return np.einsum("c,ic,jc,mc->ijm", weights, phi, phi, phi, optimize=True)


def tensor_losses(phi: np.ndarray, cumulant: np.ndarray, theta: float) -> dict[str, float]:
    """Reconstruction and orthogonality losses, their sum, and the form relative to the tensor's norm."""
    built = rebuild(phi)
    rec = float(((built - cumulant) ** 2).sum())
    ortho = float((1 + theta) / 2 * (built**2).sum())
    return {"total": ortho + rec, "ortho": ortho, "rec": rec, "rec_relative": rec / float(np.sqrt((cumulant**2).sum()))}


def reconstruction_error(built: np.ndarray, tensor: np.ndarray) -> float:
    return float(np.linalg.norm(built - tensor) / np.linalg.norm(tensor))


def power_iteration(tensor: np.ndarray, rank: int, n_repeat: int = 15, n_iter: int = 10, seed: int = 0):
    """``(weights, factors)`` of a symmetric tensor: repeated power steps, best start kept, then deflation."""
    rng = np.random.default_rng(seed)
    rest, weights, columns = tensor.copy(), [], []
    for _ in range(rank):
        best = None
        for _ in range(n_repeat):
            vector = rng.uniform(-1, 1, len(rest))
            for _ in range(n_iter):
                vector = contract(rest, vector[:, None])[:, 0]
                vector /= np.linalg.norm(vector) or 1.0
            score = float(np.einsum("ijm,i,j,m->", rest, vector, vector, vector))
            if best is None or score > best[0]:
                best = (score, vector)
        vector = best[1]
        for _ in range(n_iter):
            vector = contract(rest, vector[:, None])[:, 0]
            vector /= np.linalg.norm(vector) or 1.0
        weight = float(np.einsum("ijm,i,j,m->", rest, vector, vector, vector))
        rest = rest - weight * np.einsum("i,j,m->ijm", vector, vector, vector)
        weights.append(weight)
        columns.append(vector)
    return np.array(weights), np.array(columns).T


@dataclass
class TopicModel:
    """A fitted model: whitening, factors (k x topics, columns are topics) and its settings."""

    params: TopicParams
    whitening: M.Whitening
    factors: np.ndarray
    tensors: np.ndarray = None
    counts: np.ndarray = None
    batches: WrittenBatches = None

    def unwhitened(self) -> np.ndarray:
        """Topic directions in word space, V x topics."""
        return self.whitening.backward @ self.factors

    def topic_table(self, spark, vocabulary: DataFrame | None = None, add_mean: bool = True) -> DataFrame:
        """``(topic, term_id, weight)`` (and ``term``): unwhitened columns plus the mean taken out before."""
        table = self.unwhitened()
        if add_mean and self.whitening.centred:
            table = table + self.whitening.mean[:, None]
        return topic_frame(spark, table, vocabulary)

    def cumulant(self) -> np.ndarray:
        """The scaled third moment over all documents."""
        if self.tensors is None:
            raise ValueError("this model keeps no tensors; use cumulant_of_data")
        a = self.params.alpha0
        return (a + 1) * (a + 2) / 2 * np.average(self.tensors, axis=0, weights=self.counts)

    def partial_fit(self, tensors: np.ndarray, counts: np.ndarray, n_iter: int | None = None) -> "TopicModel":
        """Continue from the present factors with the tensors of further batches.

        Their documents may be unlike those the model was whitened by, so a step too long for them is shortened."""
        params = self.params if n_iter is None else replace(self.params, n_iter=n_iter)
        if self.tensors is None:
            raise ValueError("this model keeps no tensors; use partial_fit_on_data")
        phi = descend(self.factors, tensors, params, steady=True)
        return TopicModel(
            self.params,
            self.whitening,
            phi,
            np.concatenate([self.tensors, tensors]),
            np.concatenate([self.counts, counts]),
        )


    def partial_fit_on_data(self, vectors: DataFrame, n: int, n_iter: int | None = None) -> TopicModel:
        """Continue from the present factors with further documents, whatever the rank."""
        params = self.params if n_iter is None else replace(self.params, n_iter=n_iter)
        batches = WrittenBatches.of(vectors, self.whitening, n, params.batch_size)
        phi = descend_on_data(self.factors, vectors.sparkSession, batches, params)
        return TopicModel(self.params, self.whitening, phi, self.tensors, self.counts, batches)


def topic_frame(spark, table: np.ndarray, vocabulary: DataFrame | None = None) -> DataFrame:
    """A V x topics table in long form; model-sized, one row per term before the split by topic."""
    size, topics = table.shape
    cells = pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * topics, pa.int32()), pa.array(np.ascontiguousarray(table, float).ravel()))
    rows = pa.table({"term_id": pa.array(np.arange(size), pa.int64()), "w": cells})
    frame = spark.createDataFrame(rows, "term_id long, w array<double>").select(
        F.posexplode("w").alias("topic", "weight"), "term_id"
    )
    if vocabulary is not None:
        frame = frame.join(F.broadcast(vocabulary.select("term_id", "term")), "term_id")
    return frame.select("topic", "term_id", "weight", *(["term"] if vocabulary is not None else []))


def fits_driver(k: int, n: int, batch_size: int) -> bool:
    return k**3 * 8 * -(-n // batch_size) <= TENSOR_BYTES


def batch_tensors(vectors: DataFrame, whitening: M.Whitening, n: int, batch_size: int):
    """The single data pass: whiten, then one mean tensor per minibatch. A batch's documents meet first, so that
    a task makes whole tensors, one after the other."""
    if n == 0:
        raise ValueError("no documents, so no batch")
    if not fits_driver(whitening.k, n, batch_size):
        raise ValueError("too many tensors for the driver; use WrittenBatches and descend_on_data")
    batched = M.assign_batches(vectors, n, batch_size)
    batched = batched.repartition("batch_id") if n > batch_size else batched
    whitened = M.whiten_transform(batched, whitening, ["batch_id"])
    _, counts, tensors = M.collect_tensors(M.third_moment(whitened, whitening.k), whitening.k)
    return tensors, counts


def fit(vectors: DataFrame, width: int, params: TopicParams, finite: bool = False) -> TopicModel:
    """Two passes over the documents: second moment, then per-batch third moments. Where these would not fit the
    driver the same steps are taken on whitened rows that are written once. Above ``moments.MAX_GRAM`` terms the second
    moment is never built; its axes come from some more passes. With ``finite`` a descent over tensors that a few batches
    unlike the rest drive out of the finite range is taken again in shorter steps; else it is an error."""
    if width > M.MAX_GRAM:
        state = leading_axes(vectors, width, params.n_topics, params.alpha0)
        whitening = state.whitening()
    else:
        state = M.Moments.of(vectors, width)
        whitening = M.whiten_fit(state, params.n_topics, params.alpha0)
    if not fits_driver(params.n_topics, int(state.n), params.batch_size):
        batches = WrittenBatches.of(vectors, whitening, int(state.n), params.batch_size)
        phi = descend_on_data(initial_factors(params), vectors.sparkSession, batches, params)
        return TopicModel(params, whitening, phi, batches=batches)
    tensors, counts = batch_tensors(vectors, whitening, int(state.n), params.batch_size)
    phi = (descend_finite if finite else descend)(initial_factors(params), tensors, params)
    return TopicModel(params, whitening, phi, tensors, counts)


def fit_exact(vectors: DataFrame, width: int, n_topics: int, alpha0: float, seed: int = 0):
    """Exact moments and power iteration: ``(weights, V x topics table, tensor, whitening, factors)``."""
    if width > M.MAX_GRAM:
        state = leading_axes(vectors, width, n_topics, alpha0, exact=True)
        whitening = state.whitening(centred=False)
    else:
        state = M.Moments.of(vectors, width)
        whitening, _ = M.whiten_exact(state, n_topics, alpha0)
    tensor = M.exact_third_moment(vectors, whitening, state, alpha0)
    weights, factors = power_iteration(tensor, n_topics, seed=seed)
    return weights, whitening.backward @ factors, tensor, whitening, factors


def pack_symmetric(tensor: np.ndarray) -> np.ndarray:
    return tensor[triples(len(tensor))]


def save_model(model: TopicModel, spark, path: str) -> None:
    """Settings as JSON text, numbers as Parquet."""
    spark.createDataFrame([(json.dumps(asdict(model.params)),)], "params string").coalesce(1).write.mode(
        "overwrite"
    ).text(f"{path}/params")
    w = model.whitening
    rows = [(i, float(w.mean[i]), w.vectors[i].tolist()) for i in range(len(w.mean))]
    spark.createDataFrame(rows, "term_id int, mean double, vector array<double>").write.mode("overwrite").parquet(
        f"{path}/whitening"
    )
    factors = [(i, float(w.values[i]), bool(w.centred), model.factors[i].tolist()) for i in range(w.k)]
    spark.createDataFrame(factors, "i int, value double, centred boolean, factor array<double>").write.mode(
        "overwrite"
    ).parquet(f"{path}/factors")
    kept = [] if model.tensors is None else zip(model.counts, model.tensors, strict=True)
    tensors = [(b, float(n), pack_symmetric(t).tolist()) for b, (n, t) in enumerate(kept)]
    spark.createDataFrame(tensors, "batch int, n double, t array<double>").write.mode("overwrite").parquet(f"{path}/tensors")


def load_model(spark, path: str) -> TopicModel:
    params = TopicParams(**json.loads(spark.read.text(f"{path}/params").first()[0]))
    terms = sorted(spark.read.parquet(f"{path}/whitening").collect())
    factors = sorted(spark.read.parquet(f"{path}/factors").collect(), key=lambda r: r["i"])
    whitening = M.Whitening(
        np.array([r["mean"] for r in terms]),
        np.array([r["vector"] for r in terms]),
        np.array([r["value"] for r in factors]),
        factors[0]["centred"],
    )
    kept = sorted(spark.read.parquet(f"{path}/tensors").collect(), key=lambda r: r["batch"])
    tensors = np.array([unpack_symmetric(np.asarray(r["t"]), whitening.k) for r in kept]) if kept else None
    counts = np.array([r["n"] for r in kept]) if kept else None
    return TopicModel(params, whitening, np.array([r["factor"] for r in factors]), tensors, counts)


def fit_periods(vectors: DataFrame, period: str, width: int, params: TopicParams, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(period, topic, term_id, term, weight)``: a model per period from two passes over all of them, and
    ``(period, reason)`` of those that cannot be fitted, as a second table.

    Periods are calendar pieces, so few. Their V x V states are written out and solved one after the
    other. A period is one batch.
    """
    spark = vectors.sparkSession
    sums = cut_lineage(M.gram_rows(vectors, width, period), "period-moments")
    fitted, rejects = {}, []
    for (name,) in sums.where("i = -2").select("period").orderBy("period").collect():
        rows = sums.where(F.col("period") == F.lit(name)).collect()
        try:
            fitted[name] = M.whiten_fit(M.Moments.from_rows(rows, width)[name], params.n_topics, params.alpha0)
        except ValueError as reason:
            rejects.append((name, str(reason)))
    shared = spark.sparkContext.broadcast({p: (w.forward, w.mean @ w.forward) for p, w in fitted.items()})

    def whiten(frames):
        for pdf in frames:
            for name, part in pdf.groupby("period"):
                if name in shared.value:
                    forward, offset = shared.value[name]
                    for chunk in M._chunks([part]):
                        yield pd.DataFrame({"period": name, "y": list(M._row_sums(forward, *M._flat(chunk)) - offset)})

    source = vectors.select(F.col(period).alias("period"), "ids", "cnts")
    label = source.schema["period"].dataType.simpleString()
    whitened = source.mapInPandas(whiten, f"period {label}, y array<double>")
    names, counts, tensors = M.collect_tensors(M.third_moment(whitened, params.n_topics, "period"), params.n_topics, "period")
    label = vectors.schema[period].dataType.simpleString()
    result = topic_frame(spark, np.zeros((0, params.n_topics)), vocabulary).withColumn("period", F.lit(None).cast(label))
    for name, count, tensor in zip(names, counts, tensors):
        try:
            phi = descend(initial_factors(params), tensor[None], params)
        except FloatingPointError as reason:
            rejects.append((name, str(reason)))
            continue
        model = TopicModel(params, fitted[name], phi, tensor[None], np.array([count]))
        part = model.topic_table(spark, vocabulary).withColumn("period", F.lit(name))
        result = result.unionByName(part)
    return result, spark.createDataFrame(rejects, f"period {label}, reason string")
