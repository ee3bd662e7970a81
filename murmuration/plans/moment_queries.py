"""Queries over moments, whitening and topics by the method of moments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration import workflow
from murmuration.functions import text as T
from murmuration.operators import inference, moments, spectral, tensor_lda, topics, tuning, vocab
from murmuration.plans import sql
from murmuration.plans.registry import query, table
from murmuration.plans.text_queries import preprocessed
from murmuration.plans.vocab_queries import BASE
from murmuration.session import cut_lineage, scratch_path
from murmuration.sources import sinks
from murmuration.streaming import jobs

ALPHA0 = 0.003
SMALL = dict(min_df=5, max_df=0.5, max_features=1000)
FIT = dict(min_df=5, max_df=0.5, max_features=1000)
PARAMS = tensor_lda.TopicParams(
    n_topics=20, alpha0=ALPHA0, n_iter=1000, batch_size=15000, learning_rate=0.002, init="scaled", seed=0
)


def prepared(spark, sf_dir: str, limits: dict, scale: bool = False):
    """``(vectors, vocabulary, words)``; with ``scale`` each document's counts sum to one, so that very
    long documents do not outweigh the rest."""
    docs = preprocessed(spark, sf_dir)
    terms, words = vocab.pin(vocab.build_vocab(docs, **limits))
    vectors = vocab.doc_vectors(docs, words)
    if scale:
        vectors = vocab.l1_scale(vectors)
    return vectors.persist(), terms, words


# --- moments of the corpus

SMALL_BOW = f"{BASE}, {sql.vocab(**SMALL)}, x AS (SELECT doc_id, term_id, cnt::DOUBLE AS c FROM counts JOIN vocab USING (term))"
PAIRS = (
    f"{SMALL_BOW}, m AS (SELECT term_id, sum(c) / {sql.N_DOCS} AS m FROM x GROUP BY term_id), "
    "e AS (SELECT a.term_id AS i, b.term_id AS j, sum(a.c * b.c) / " + sql.N_DOCS + " AS e FROM x a JOIN x b USING (doc_id) "
    "WHERE a.term_id <= b.term_id GROUP BY ALL), "
    "p AS (SELECT a.term_id AS i, b.term_id AS j, a.m AS mi, b.m AS mj, coalesce(e, 0) AS e FROM m a JOIN m b "
    "ON a.term_id <= b.term_id LEFT JOIN e ON e.i = a.term_id AND e.j = b.term_id)"
)


@query("first_moment", f"{SMALL_BOW} SELECT term_id, round(sum(c) / {sql.N_DOCS}, 8) AS m FROM x GROUP BY term_id")
def first_moment(spark, sf_dir):
    docs = preprocessed(spark, sf_dir)
    words = vocab.pin(vocab.build_vocab(docs, **SMALL))[1]
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    bow = vocab.doc2bow(docs, words)
    return bow.groupBy("term_id").agg(F.round(F.sum("cnt") / n_docs, 8).alias("m"))


def _pairs(frame: DataFrame) -> DataFrame:
    return frame.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("v", 9).alias("v"))


@query("covariance", f"{PAIRS} SELECT i, j, round(({ALPHA0} + 1) * (e - mi * mj), 9) AS v FROM p")
def covariance(spark, sf_dir):
    vectors, _, words = prepared(spark, sf_dir, SMALL)
    return _pairs(moments.second_moment(vectors, len(words), ALPHA0))


@query(
    "second_moment_exact",
    f"{PAIRS} SELECT i, j, round(({ALPHA0} + 1) * (e - CASE WHEN i = j THEN mi ELSE 0 END) - {ALPHA0} * mi * mj, 9) AS v FROM p",
)
def second_moment_exact(spark, sf_dir):
    vectors, _, words = prepared(spark, sf_dir, SMALL)
    return _pairs(moments.second_moment(vectors, len(words), ALPHA0, exact=True))


# --- whitening: what must hold of the whitened rows


def identity_sql(k: int, value: str = "1.0") -> str:
    return (
        f"SELECT i::BIGINT AS i, j::BIGINT AS j, round(CASE WHEN i = j THEN {value} ELSE 0 END, 6)::DOUBLE AS v "
        f"FROM range({k}) a(i), range({k}) b(j)"
    )


def second_moment_of(rows: DataFrame) -> DataFrame:
    """``(i, j, v)``: mean of y_i y_j over ``(doc_id, y)`` rows, k^2 rows."""
    left = rows.select("y", F.posexplode("y").alias("i", "a"))
    both = left.select("i", "a", F.posexplode("y").alias("j", "b"))
    mean = both.groupBy("i", "j").agg(F.avg(F.col("a") * F.col("b")).alias("v"))
    return mean.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), (F.round("v", 6) + 0.0).alias("v"))


@query("whiten_fit", identity_sql(20, f"1 / (1 + {ALPHA0})"))
def whiten_fit(spark, sf_dir):
    """The whitened corpus has the second moment I / (1 + alpha0)."""
    vectors, _, words = prepared(spark, sf_dir, FIT)
    fitted = moments.whiten_fit(moments.Moments.of(vectors, len(words)), 20, ALPHA0)
    return second_moment_of(moments.whiten_transform(vectors, fitted))


@query("whiten_unit", identity_sql(20))
def whiten_unit(spark, sf_dir):
    vectors, _, words = prepared(spark, sf_dir, FIT)
    fitted = moments.whiten_unit(moments.Moments.of(vectors, len(words)), 20)
    return second_moment_of(moments.whiten_transform(vectors, fitted))


@query("whiten_transform")
def whiten_transform(spark, sf_dir):
    """Whitened rows, written and read back."""
    vectors, _, words = prepared(spark, sf_dir, FIT)
    fitted = moments.whiten_fit(moments.Moments.of(vectors, len(words)), 20, ALPHA0)
    path = scratch_path(spark, "whitened")
    sinks.write_whitened(moments.whiten_transform(vectors, fitted), path)
    return spark.read.parquet(path)


EMBEDDED = (
    "y AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings), "
    "w AS (SELECT label, d, avg(v) AS w FROM y GROUP BY ALL), mean AS (SELECT d, avg(v) AS m FROM y GROUP BY d)"
)


def embedded(spark, sf_dir) -> DataFrame:
    """Dense vectors in the sparse row form."""
    vectors = table(spark, sf_dir, "embeddings")
    values = F.transform("embedding", lambda v: v.cast("double"))
    ids = F.sequence(F.lit(0), F.size("embedding") - 1)
    return vectors.select(F.col("vec_id").alias("doc_id"), "label", ids.alias("ids"), values.alias("cnts"))


def label_means(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``(dimensions x labels, overall mean)``; model-sized."""
    cells = rows.select("label", F.posexplode("cnts").alias("d", "v")).groupBy("label", "d").agg(
        F.avg("v").alias("w"), F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")
    ).collect()
    labels, size = sorted({c["label"] for c in cells}), max(c["d"] for c in cells) + 1
    result, sums, counts = np.zeros((size, len(labels))), np.zeros(size), np.zeros(size)
    for c in cells:
        result[c["d"], labels.index(c["label"])] = c["w"]
        sums[c["d"]] += c["s"]
        counts[c["d"]] += c["n"]
    return result, sums / counts


@query(
    "project_rows",
    f"WITH {EMBEDDED} SELECT vec_id AS doc_id, w.label::BIGINT AS component, round(sum((v - m) * w), 6) AS y "
    "FROM y JOIN w USING (d) JOIN mean USING (d) GROUP BY vec_id, w.label",
)
def project_rows(spark, sf_dir):
    """Centred rows times a given table, here the label means of the embeddings."""
    rows = embedded(spark, sf_dir)
    weights, mean = label_means(rows)
    projected = moments.project(rows, weights, mean @ weights)
    return projected.select("doc_id", F.posexplode("y").alias("component", "y")).select(
        "doc_id", F.col("component").cast("long").alias("component"), (F.round("y", 6) + 0.0).alias("y")
    )


@query("whiten_partial_fit", "SELECT true AS same_count, true AS same_mean, true AS same_moment")
def whiten_partial_fit(spark, sf_dir):
    """Moments added up period by period equal those of the whole corpus."""
    docs = preprocessed(spark, sf_dir, "source")
    words = vocab.pin(vocab.build_vocab(docs, **SMALL))[1]
    vectors = vocab.doc_vectors(docs, words, keep=["source"]).persist()
    whole = moments.Moments.of(vectors, len(words))
    parts = moments.Moments.from_rows(moments.gram_rows(vectors, len(words), "source").collect(), len(words))
    merged = None
    for state in parts.values():
        merged = state if merged is None else merged.merge(state)
    row = (
        bool(whole.n == merged.n),
        bool(np.allclose(whole.mean, merged.mean, rtol=1e-12)),
        bool(np.allclose(whole.second, merged.second, rtol=1e-12)),
    )
    return spark.createDataFrame([row], "same_count boolean, same_mean boolean, same_moment boolean")


@query("unwhiten")
def unwhiten(spark, sf_dir):
    """The whitening axes themselves, back in word space."""
    vectors, terms, words = prepared(spark, sf_dir, FIT)
    fitted = moments.whiten_fit(moments.Moments.of(vectors, len(words)), 5, ALPHA0)
    return tensor_lda.topic_frame(spark, fitted.backward, terms)


@query("whiten_exact", identity_sql(20))
def whiten_exact(spark, sf_dir):
    """The exact second moment, contracted with its whitening table on both sides, is the identity."""
    vectors, _, words = prepared(spark, sf_dir, FIT)
    state = moments.Moments.of(vectors, len(words))
    fitted, _ = moments.whiten_exact(state, 20, ALPHA0)
    product = fitted.forward.T @ state.exact_second(ALPHA0) @ fitted.forward
    rows = [(i, j, round(float(product[i, j]), 6) + 0.0) for i in range(20) for j in range(20)]
    return spark.createDataFrame(rows, "i long, j long, v double")


@query("explained_variance_curve")
def explained_variance_curve(spark, sf_dir):
    vectors, _, words = prepared(spark, sf_dir, SMALL)
    return moments.explained_variance(spark, moments.whiten_fit(moments.Moments.of(vectors, len(words)), 5, ALPHA0))


@query(
    "spectrum_totals",
    f"{PAIRS}, c AS (SELECT i, j, ({ALPHA0} + 1) * (e - mi * mj) AS v FROM p) "
    "SELECT round(sum(v) FILTER (i = j), 4) AS trace, round(sum(CASE WHEN i = j THEN v * v ELSE 2 * v * v END), 2) AS squares FROM c",
)
def spectrum_totals(spark, sf_dir):
    """The eigenvalues add up to the covariance's trace, their squares to its squared norm."""
    vectors, _, words = prepared(spark, sf_dir, SMALL)
    spectrum = moments.whiten_fit(moments.Moments.of(vectors, len(words)), 5, ALPHA0).spectrum
    rows = [(round(float(spectrum.sum()), 4), round(float((spectrum**2).sum()), 2))]
    return spark.createDataFrame(rows, "trace double, squares double")


@query("pca_project")
def pca_project(spark, sf_dir):
    """Two principal components of the centred counts, unscaled."""
    vectors, _, words = prepared(spark, sf_dir, FIT)
    fitted = moments.whiten_unit(moments.Moments.of(vectors, len(words)), 2)
    rows = moments.project(vectors, fitted.vectors, fitted.mean @ fitted.vectors)
    return rows.select("doc_id", F.col("y")[0].alias("pc1"), F.col("y")[1].alias("pc2"))


# --- second moments over the whole vocabulary, by products alone

WIDE = dict(min_df=2, max_df=1.0, max_features=vocab.MAX_VOCABULARY)
WIDE_AXES = 20


def all_terms(spark, sf_dir: str, min_df: int) -> tuple[DataFrame, int]:
    """``(vectors, terms)`` over every term of so many documents, each document's counts summing to one. Terms are joined, so none
    is left out for their number. ``doc_id`` numbers the rows, whose own ids may repeat; tokens are written, as they are read twice."""
    tokens = preprocessed(spark, sf_dir).select("tokens").withColumn("doc_id", F.monotonically_increasing_id())
    docs = cut_lineage(tokens, "tokens")
    terms = cut_lineage(vocab.build_vocab(docs, min_df), "terms")
    return vocab.l1_scale(vocab.bow_vectors(docs, terms)).persist(), terms.count()


@query("whiten_matrix_free", identity_sql(WIDE_AXES, f"1 / (1 + {ALPHA0})"))
def whiten_matrix_free(spark, sf_dir):
    """As ``whiten_fit``, over all terms of two documents at least."""
    vectors, width = all_terms(spark, sf_dir, 2)
    fitted = spectral.leading_axes(vectors, width, WIDE_AXES, ALPHA0).whitening()
    return second_moment_of(moments.whiten_transform(vectors, fitted))


@query(
    "leading_axes",
    f"{BASE}, {sql.vocab(**WIDE)}, x AS (SELECT doc_id, term_id, cnt::DOUBLE AS c FROM counts JOIN vocab USING (term)), "
    "scaled AS (SELECT doc_id, term_id, c / sum(c) OVER (PARTITION BY doc_id) AS c FROM x), "
    f"m AS (SELECT sum(c) / {sql.N_DOCS} AS m, sum(c * c) / {sql.N_DOCS} AS e FROM scaled GROUP BY term_id) "
    f"SELECT component::BIGINT AS component, round(({ALPHA0} + 1) * (SELECT sum(e) - sum(m * m) FROM m), 8) AS trace, true AS settled "
    f"FROM range(1, {WIDE_AXES + 1}) c(component)",
)
def leading_axes(spark, sf_dir):
    """The trace, and for each axis whether the second moment's product with it, worked out by joins, is its multiple."""
    vectors, _, words = prepared(spark, sf_dir, WIDE, scale=True)
    found = spectral.leading_axes(vectors, len(words), WIDE_AXES, ALPHA0)
    axes = tensor_lda.topic_frame(spark, found.vectors).select(F.col("topic").cast("long").alias("component"), F.col("term_id").cast("long").alias("term_id"), F.col("weight").alias("v"))
    values = F.element_at(F.lit([float(v) for v in found.values]), F.col("component").cast("int") + 1)
    off = F.sqrt(F.sum(F.pow(F.col("cv") - values * F.col("v"), F.lit(2.0))))
    met = spectral.moment_times(vectors, axes, ALPHA0).groupBy("component").agg(off.alias("off"))
    return met.select(
        (F.col("component") + 1).alias("component"), F.lit(round(found.trace, 8)).alias("trace"), (F.col("off") <= 1e-6 * float(found.values[0])).alias("settled")
    )


# --- third moments and the decomposition, on given rows: all embedding values, the label being the batch

WIDTH, LABELS = 64, 10
CUBE = (
    "y AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings), "
    "phi AS (SELECT d AS i, label AS c, avg(v) AS v FROM y GROUP BY ALL)"
)
# one third moment for each i <= j <= m, and how many cells of the symmetric tensor it fills
WHOLE = (
    "whole AS (SELECT a.d AS i, b.d AS j, c.d AS m, avg(a.v * b.v * c.v) AS v, "
    "CASE WHEN a.d = b.d AND b.d = c.d THEN 1 WHEN a.d = b.d OR b.d = c.d THEN 3 ELSE 6 END AS cells "
    "FROM y a JOIN y b ON a.vec_id = b.vec_id AND a.d <= b.d JOIN y c ON a.vec_id = c.vec_id AND b.d <= c.d GROUP BY ALL)"
)


def small_rows(spark, sf_dir) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(F.col("vec_id").alias("doc_id"), "label", F.transform("embedding", lambda v: v.cast("double")).alias("y"))


def small_factors(rows: DataFrame) -> np.ndarray:
    """Columns: the mean of each label."""
    means = rows.select("label", F.posexplode("y").alias("i", "v")).groupBy("i", "label").agg(F.avg("v").alias("v"))
    phi = np.zeros((WIDTH, LABELS))
    for r in means.collect():
        phi[r["i"], r["label"]] = r["v"]
    return phi


def whole_tensor(rows: DataFrame) -> np.ndarray:
    _, _, tensors = moments.collect_tensors(moments.third_moment(rows.withColumn("batch_id", F.lit(0)), WIDTH), WIDTH)
    return tensors[0]


@query(
    "third_moment_whitened",
    f"WITH {CUBE} SELECT a.label AS label, a.d::BIGINT AS i, b.d::BIGINT AS j, c.d::BIGINT AS m, "
    f"round(({ALPHA0} + 1) * ({ALPHA0} + 2) / 2 * avg(a.v * b.v * c.v), 9) AS v "
    "FROM y a JOIN y b ON a.vec_id = b.vec_id AND a.d <= b.d JOIN y c ON a.vec_id = c.vec_id AND b.d <= c.d GROUP BY ALL",
)
def third_moment_whitened(spark, sf_dir):
    """Scaled third moments per batch, the label being the batch."""
    names = [(at, *map(int, e)) for at, e in enumerate(zip(*moments.triples(WIDTH), strict=True))]
    named = spark.createDataFrame(names, "at int, i long, j long, m long")
    sums = moments.third_moment(small_rows(spark, sf_dir), WIDTH, "label")
    cells = sums.select("label", "n", F.posexplode("t").alias("at", "t")).join(F.broadcast(named), "at")  # a row a cell of the tensor
    value = (ALPHA0 + 1) * (ALPHA0 + 2) / 2 * F.col("t") / F.col("n")
    return cells.select("label", "i", "j", "m", F.round(value, 9).alias("v"))


def matrix_frame(spark, matrix: np.ndarray, places: int) -> DataFrame:
    rows = [(i, c, round(float(matrix[i, c]), places) + 0.0) for i in range(len(matrix)) for c in range(matrix.shape[1])]
    return spark.createDataFrame(rows, "i long, c long, v double")


@query(
    "cumulant_gradient",
    f"WITH {CUBE}, g AS (SELECT a.c AS c, b.c AS e, pow(sum(a.v * b.v), 2) AS g FROM phi a JOIN phi b USING (i) GROUP BY ALL), "
    "pull AS (SELECT phi.i, g.e AS c, 6 * sum(phi.v * g.g) AS v FROM phi JOIN g USING (c) GROUP BY ALL), "
    "s AS (SELECT vec_id, c, pow(sum(y.v * phi.v), 2) AS s FROM y JOIN phi ON phi.i = y.d GROUP BY ALL), "
    f"push AS (SELECT d AS i, c, 3 * (1 + {ALPHA0}) * (2 + {ALPHA0}) / 2 * avg(y.v * s.s) AS v FROM y JOIN s USING (vec_id) GROUP BY ALL) "
    "SELECT i::BIGINT AS i, c::BIGINT AS c, round(pull.v - push.v, 10) AS v FROM pull JOIN push USING (i, c)",
)
def cumulant_gradient(spark, sf_dir):
    """The gradient from the third moment equals the one summed over the rows themselves."""
    rows = small_rows(spark, sf_dir)
    gradient = tensor_lda.cumulant_gradient(small_factors(rows), whole_tensor(rows), ALPHA0, 1.0)
    return matrix_frame(spark, gradient, 10)


BUILT = (
    "built AS (SELECT a.i, b.i AS j, c.i AS m, sum(a.v * b.v * c.v) AS v FROM phi a JOIN phi b ON a.c = b.c AND a.i <= b.i "
    "JOIN phi c ON a.c = c.c AND b.i <= c.i GROUP BY ALL)"
)


@query(
    "tensor_losses",
    f"WITH {CUBE}, {WHOLE}, {BUILT}, q AS (SELECT sum(cells * pow(b.v - w.v, 2)) AS rec, (1 + 5) / 2.0 * sum(cells * b.v * b.v) AS ortho, "
    "sqrt(sum(cells * w.v * w.v)) AS size FROM built b JOIN whole w USING (i, j, m)) "
    "SELECT round(ortho + rec, 10) AS total, round(ortho, 10) AS ortho, round(rec, 10) AS rec, round(rec / size, 10) AS rec_relative FROM q",
)
def tensor_losses(spark, sf_dir):
    rows = small_rows(spark, sf_dir)
    losses = tensor_lda.tensor_losses(small_factors(rows), whole_tensor(rows), theta=5)
    values = [tuple(round(losses[c], 10) for c in ("total", "ortho", "rec", "rec_relative"))]
    return spark.createDataFrame(values, "total double, ortho double, rec double, rec_relative double")


@query(
    "reconstruction_error",
    f"WITH {CUBE}, {WHOLE}, {BUILT} SELECT round(sqrt(sum(cells * pow(b.v - w.v, 2)) / sum(cells * w.v * w.v)), 7) AS error FROM built b JOIN whole w USING (i, j, m)",
)
def reconstruction_error(spark, sf_dir):
    rows = small_rows(spark, sf_dir)
    error = tensor_lda.reconstruction_error(tensor_lda.rebuild(small_factors(rows)), whole_tensor(rows))
    return spark.createDataFrame([(round(error, 7),)], "error double")


# --- fitted models


def fitted_model(spark, sf_dir: str, params=PARAMS, limits=FIT, finite: bool = False):
    vectors, terms, words = prepared(spark, sf_dir, limits, scale=True)
    return tensor_lda.fit(vectors, len(words), params, finite), vectors, terms


@query("tlda_fit")
def tlda_fit(spark, sf_dir):
    """``(topic, term_id, term, weight)`` of the fitted topics."""
    model, _, terms = fitted_model(spark, sf_dir)
    return model.topic_table(spark, terms)


@query("tlda_top_words")
def tlda_top_words(spark, sf_dir):
    """Flagship: documents to the top words of every learned topic."""
    model, _, terms = fitted_model(spark, sf_dir)
    shares = topics.normalize_topics(model.topic_table(spark, terms))
    return topics.top_words(shares, 20, "p").select("topic", "rank", "term", "p")


@query("tlda_text_to_topics")
def tlda_text_to_topics(spark, sf_dir):
    """The whole way in one call: accents and suffixes off, single words and pairs, 1,000 of them, 20 topics."""
    params = tensor_lda.TopicParams(n_topics=20, alpha0=ALPHA0, n_iter=1000, batch_size=15000, learning_rate=0.002, init="scaled", seed=0)
    run = workflow.topics_of_texts(table(spark, sf_dir, "documents"), params, min_df=5, max_df=0.5, max_features=1000, scale_documents=True)
    return run.top_words(20)


@query("tlda_fit_options")
def tlda_fit_options(spark, sf_dir):
    """The other settings: cosine schedule, theta 5, wider start; with the losses over all documents."""
    params = tensor_lda.TopicParams(
        5, ALPHA0, 600, 200, 0.0005, theta=5.0, init="scaled", scale=0.877, schedule="cosine", seed=1
    )
    model, _, _ = fitted_model(spark, sf_dir, params, finite=True)
    losses = tensor_lda.tensor_losses(model.factors, model.cumulant(), params.theta)
    rows = [(len(model.counts), float(model.counts.sum()), *(losses[c] for c in ("total", "ortho", "rec", "rec_relative")))]
    return spark.createDataFrame(
        rows, "batches long, documents double, total double, ortho double, rec double, rec_relative double"
    )


@query(
    "stream_weekly_closed",
    "SELECT week_start, event_type AS term, count(*) AS cnt FROM (SELECT event_type, "
    "time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS week_start FROM events) "
    "WHERE week_start + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY ALL",
)
def stream_weekly_closed(spark, sf_dir):
    """The append form: only weeks the watermark has passed are written."""
    stream = jobs.stream_table(spark, sf_dir, "events").select(
        jobs.utc_instant("ts").alias("ts"), F.array("event_type").alias("tokens")
    )
    path = scratch_path(spark, "weekly-closed")
    jobs.run_to_table(jobs.weekly_term_counts(stream, "ts", "tokens"), path)
    weeks = spark.read.schema("week_start timestamp, term string, cnt long").parquet(f"{path}/data")
    return weeks.withColumn("week_start", jobs.utc_wall_time("week_start"))


@query("tlda_partial_fit")
def tlda_partial_fit(spark, sf_dir):
    """A model fitted on the documents, updated with the conversations as a further batch."""
    model, _, terms = fitted_model(spark, sf_dir)
    words = [r["term"] for r in terms.orderBy("term_id").collect()]
    turns = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"),
        T.preprocess(F.col("text"), normalize=False).alias("tokens"),
    )
    vectors = vocab.l1_scale(vocab.doc_vectors(turns, words)).persist()
    tensors, counts = tensor_lda.batch_tensors(vectors, model.whitening, vectors.count(), 15000)
    updated = model.partial_fit(tensors, counts, n_iter=200)
    return updated.topic_table(spark, terms)


@query("exact_fit")
def exact_fit(spark, sf_dir):
    """Exact moments and power iteration: weights and the relative error of the rebuilt tensor."""
    vectors, _, words = prepared(spark, sf_dir, FIT)
    weights, _, tensor, _, factors = tensor_lda.fit_exact(vectors, len(words), 5, ALPHA0)
    error = tensor_lda.reconstruction_error(tensor_lda.rebuild(factors, weights), tensor)
    return spark.createDataFrame([(i, float(w), error) for i, w in enumerate(weights)], "topic long, weight double, error double")


FEW = dict(min_df=5, max_df=0.5, max_features=60)
FEW_BOW = f"{BASE}, {sql.vocab(**FEW)}, x AS (SELECT doc_id, term_id, cnt::DOUBLE AS c FROM counts JOIN vocab USING (term))"


@query(
    "third_moment_words",
    f"{FEW_BOW}, m AS (SELECT term_id, sum(c) / {sql.N_DOCS} AS m FROM x GROUP BY term_id), "
    f"p AS (SELECT a.term_id AS i, b.term_id AS j, sum(a.c * b.c) / {sql.N_DOCS} AS p FROM x a JOIN x b USING (doc_id) GROUP BY ALL), "
    f"t AS (SELECT a.term_id AS i, b.term_id AS j, c.term_id AS m, sum(a.c * b.c * c.c) / {sql.N_DOCS} AS t FROM x a "
    "JOIN x b USING (doc_id) JOIN x c USING (doc_id) GROUP BY ALL), "
    "g AS (SELECT a.term_id AS i, b.term_id AS j, c.term_id AS m, a.m AS mi, b.m AS mj, c.m AS mm FROM m a, m b, m c "
    "WHERE a.term_id <= b.term_id AND b.term_id <= c.term_id) "
    f"SELECT g.i, g.j, g.m, round(({ALPHA0} + 1) * ({ALPHA0} + 2) / 2 * (coalesce(t, 0) "
    "- CASE WHEN g.i = g.j THEN coalesce(jm.p, 0) ELSE 0 END - CASE WHEN g.i = g.m THEN coalesce(ij.p, 0) ELSE 0 END "
    "- CASE WHEN g.j = g.m THEN coalesce(ij.p, 0) ELSE 0 END + CASE WHEN g.i = g.j AND g.j = g.m THEN 2 * mi ELSE 0 END) "
    f"- {ALPHA0} * ({ALPHA0} + 1) / 2 * (CASE WHEN g.i = g.j THEN mi * mm ELSE 0 END + CASE WHEN g.i = g.m THEN mi * mj ELSE 0 END "
    f"+ CASE WHEN g.j = g.m THEN mi * mj ELSE 0 END) + {ALPHA0} * {ALPHA0} * mi * mj * mm, 5) AS v FROM g "
    "LEFT JOIN t ON t.i = g.i AND t.j = g.j AND t.m = g.m LEFT JOIN p ij ON ij.i = g.i AND ij.j = g.j "
    "LEFT JOIN p jm ON jm.i = g.j AND jm.j = g.m",
)
def third_moment_words(spark, sf_dir):
    """The exact third moment in word space, where the whitening table is the identity."""
    vectors, _, words = prepared(spark, sf_dir, FEW)
    state = moments.Moments.of(vectors, len(words))
    plain = moments.Whitening(state.mean, np.eye(len(words)), np.ones(len(words)), False)
    tensor = moments.exact_third_moment(vectors, plain, state, ALPHA0)
    rows = [(int(i), int(j), int(m), round(float(tensor[i, j, m]), 5) + 0.0) for i, j, m in zip(*moments.triples(len(words)))]
    return spark.createDataFrame(rows, "i long, j long, m long, v double")


@query("third_moment_exact")
def third_moment_exact(spark, sf_dir):
    vectors, _, words = prepared(spark, sf_dir, SMALL)
    state = moments.Moments.of(vectors, len(words))
    fitted, _ = moments.whiten_exact(state, 4, ALPHA0)
    tensor = moments.exact_third_moment(vectors, fitted, state, ALPHA0)
    rows = [(int(i), int(j), int(m), float(tensor[i, j, m])) for i, j, m in zip(*moments.triples(4))]
    return spark.createDataFrame(rows, "i long, j long, m long, v double")


def _inferred(spark, sf_dir):
    model, _, terms = fitted_model(spark, sf_dir)
    shares = topics.normalize_topics(model.topic_table(spark, terms))
    beta = inference.beta_matrix(shares, terms.count())
    docs = preprocessed(spark, sf_dir)
    words = [r["term"] for r in terms.orderBy("term_id").collect()]
    vectors = vocab.doc_vectors(docs, words)
    return vectors, beta, inference.infer_doc_topics(vectors, beta)


@query("infer_doc_topics")
def infer_doc_topics(spark, sf_dir):
    return _inferred(spark, sf_dir)[2]


FIT_TOKENS = f"{BASE}, {sql.vocab(**FIT)}, kept AS (SELECT doc_id, sum(cnt) AS n FROM counts JOIN vocab USING (term) GROUP BY doc_id)"


@query("infer_gamma_sums", f"{FIT_TOKENS} SELECT doc_id, round(coalesce(n, 0)::DOUBLE + 1, 6) AS total FROM documents LEFT JOIN kept USING (doc_id)")
def infer_gamma_sums(spark, sf_dir):
    """What any step of the inference leaves: a document's topics share its known words and one more."""
    sums = F.aggregate("gamma", F.lit(0.0), lambda a, b: a + b)
    return _inferred(spark, sf_dir)[2].select("doc_id", F.round(sums, 6).alias("total"))


@query(
    "write_doc_topics",
    f"{FIT_TOKENS} SELECT doc_id, round(coalesce(n, 0)::DOUBLE + 1, 6) AS total, {PARAMS.n_topics} AS topics FROM documents LEFT JOIN kept USING (doc_id)",
)
def write_doc_topics(spark, sf_dir):
    """Documents' topics through a CSV with a header, lists as text."""
    path = scratch_path(spark, "doc-topics")
    sinks.write_csv(_inferred(spark, sf_dir)[2].select("doc_id", "gamma"), path)
    saved = spark.read.csv(path, header=True, schema="doc_id long, gamma string")
    parts = F.transform(F.split("gamma", r"\|"), lambda v: v.cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)
    return saved.select("doc_id", F.round(total, 6).alias("total"), F.size(parts).alias("topics"))


@query(
    "write_whitened",
    "SELECT vec_id AS doc_id, d, round(v, 6) AS v FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS d, "
    "unnest(embedding)::DOUBLE AS v FROM embeddings)",
)
def write_whitened(spark, sf_dir):
    """Rows of coordinates written and read back."""
    path = scratch_path(spark, "whitened")
    sinks.write_whitened(small_rows(spark, sf_dir).select("doc_id", "y"), path)
    saved = spark.read.parquet(path).select("doc_id", F.posexplode("y").alias("d", "v"))
    return saved.select("doc_id", F.col("d").cast("long").alias("d"), F.round("v", 6).alias("v"))


@query(
    "doc_topic_normalize",
    "SELECT doc_id, 20::BIGINT AS n_topics, 1.0::DOUBLE AS total, true AS positive FROM documents",
)
def doc_topic_normalize(spark, sf_dir):
    """Every document has one positive share per topic, summing to one."""
    shares = inference.doc_topic_rows(_inferred(spark, sf_dir)[2])
    return shares.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_topics"), F.round(F.sum("p"), 9).alias("total"), F.bool_and(F.col("p") > 0).alias("positive")
    )


@query("perplexity")
def perplexity(spark, sf_dir):
    vectors, beta, inferred = _inferred(spark, sf_dir)
    return inference.perplexity(vectors, inferred, beta, np.full(beta.shape[1], 1 / beta.shape[1]))


@query("save_load_model", "SELECT true AS same")
def save_load_model(spark, sf_dir):
    """A saved model read back gives the same topics."""
    model, _, _ = fitted_model(spark, sf_dir)
    path = scratch_path(spark, "model")
    tensor_lda.save_model(model, spark, path)
    back = tensor_lda.load_model(spark, path)
    same = back.params == model.params and np.allclose(back.unwhitened(), model.unwhitened(), rtol=1e-12, atol=1e-15)
    return spark.createDataFrame([(bool(same),)], "same boolean")


@query("param_sweep")
def param_sweep(spark, sf_dir):
    """Two starts per setting: do their topics agree? The tensors are summed once for the whole grid."""
    vectors, terms, words = prepared(spark, sf_dir, FIT, scale=True)
    return tuning.param_sweep(vectors, terms, len(words), PARAMS, rates=(0.002, 0.001), iterations=(300, 1000))


@query("per_period_topics")
def per_period_topics(spark, sf_dir):
    """Topics of every day: one job adds up the second moments of all days, one their third moments."""
    docs = preprocessed(spark, sf_dir)
    days = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.to_date("ts").cast("string").alias("period"))
    docs = docs.join(days, "doc_id")
    terms, words = vocab.pin(vocab.build_vocab(docs, min_df=5, max_df=0.5, max_features=200))
    vectors = vocab.doc_vectors(docs, words, keep=["period"]).persist()
    params = tensor_lda.TopicParams(3, ALPHA0, 500, 15000, 0.0005, init="scaled")
    found, rejects = tensor_lda.fit_periods(vectors, "period", len(words), params, terms)
    return found.withColumn("reason", F.lit(None).cast("string")).unionByName(rejects, allowMissingColumns=True)


# --- streams


@query(
    "stream_weekly_term_counts",
    "SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS week_start, event_type AS term, count(*) AS cnt "
    "FROM events GROUP BY ALL",
)
def stream_weekly_term_counts(spark, sf_dir):
    """Event types as one-word texts, counted per week by a stream."""
    stream = jobs.stream_table(spark, sf_dir, "events").select(
        jobs.utc_instant("ts").alias("ts"), F.array("event_type").alias("tokens")
    )
    path = scratch_path(spark, "weekly")
    jobs.run_updates(jobs.weekly_term_counts(stream, "ts", "tokens"), path)
    weeks = jobs.read_updates(spark, path, ["week_start", "term"], "cnt")
    return weeks.withColumn("week_start", jobs.utc_wall_time("week_start"))


@query("stream_moments", f"{SMALL_BOW} SELECT term_id, round(sum(c) / {sql.N_DOCS}, 8) AS m FROM x GROUP BY term_id")
def stream_moments(spark, sf_dir):
    """Means from the moment sums a stream of documents leaves behind."""
    words = vocab.pin(vocab.build_vocab(preprocessed(spark, sf_dir), **SMALL))[1]
    stream = jobs.stream_table(spark, sf_dir, "documents", spark.sparkContext.defaultParallelism).select(
        "doc_id", T.preprocess(F.col("text"), normalize=False).alias("tokens")
    )
    path = scratch_path(spark, "moments")
    jobs.run_moments(stream, words, path)
    mean = jobs.read_moments(spark, path, len(words)).mean
    return spark.createDataFrame([(i, round(float(m), 8)) for i, m in enumerate(mean)], "term_id long, m double")
