import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.functions import numeric
from murmuration.operators import inference, moments, tensor_lda, topics

V, K, N = 30, 3, 1500
ALPHA0 = 0.1


def planted(seed=0, n=N, v=V, k=K, length=60):
    rng = np.random.default_rng(seed)
    phi = rng.dirichlet(np.full(v, 0.08), k)
    theta = rng.dirichlet(np.full(k, ALPHA0 / k), n)
    return np.array([rng.multinomial(length, t @ phi) for t in theta]).astype(float), phi


def frame(spark, counts, parts=4):
    rows = []
    for d, row in enumerate(counts):
        ids = np.flatnonzero(row)
        rows.append((d, ids.tolist(), row[ids].tolist()))
    return spark.createDataFrame(rows, "doc_id long, ids array<int>, cnts array<double>").repartition(parts, "doc_id")


@pytest.fixture(scope="module")
def corpus(spark):
    counts, phi = planted()
    counts[7] = 0  # a document without known words
    return counts, phi, frame(spark, counts).persist()


def test_special_functions():
    x = np.array([0.003, 0.1, 0.5, 1.0, 2.5, 7.0, 30.0, 1e4])
    assert np.allclose(numeric.gammaln(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)
    assert np.allclose(numeric.digamma(x + 1) - numeric.digamma(x), 1 / x, rtol=1e-10)
    assert numeric.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-12)
    rows = np.array([[1.0, 2, 3], [-700, 700, 0]])
    assert np.allclose(numeric.log_sum_exp(rows), [3.4076059644, 700])


def test_symmetric_packing():
    rng = np.random.default_rng(1)
    cube = numeric.cube_sum(rng.normal(size=(5, 4)))
    assert np.allclose(numeric.unpack_symmetric(cube[numeric.triples(4)], 4), cube)


@pytest.mark.parametrize("parts", [1, 7])
def test_moments(spark, corpus, parts):
    counts, _, _ = corpus
    state = moments.Moments.of(frame(spark, counts, parts), V)
    assert state.n == N
    assert np.allclose(state.mean, counts.mean(0))
    assert np.allclose(state.covariance(ALPHA0), (ALPHA0 + 1) * np.cov(counts.T, bias=True))
    pairs = np.einsum("ni,nj->ij", counts, counts) / N - np.diag(counts.mean(0))
    want = (ALPHA0 + 1) * pairs - ALPHA0 * np.outer(counts.mean(0), counts.mean(0))
    assert np.allclose(state.exact_second(ALPHA0), want)


def test_short_and_long_rows_add_up_alike():
    rng = np.random.default_rng(4)
    for width, share in ((200, 0.02), (40, 0.7)):
        rows = rng.poisson(2.0, (90, width)) * (rng.random((90, width)) < share)
        rows[5] = 0
        ids, cnts = np.nonzero(rows)[1], rows[np.nonzero(rows)].astype(float)
        gram = np.zeros((width, width))
        moments._add_products(gram, (rows > 0).sum(1), ids, cnts)
        assert np.allclose(np.triu(gram), np.triu(rows.T @ rows))


def test_batches_add_up(spark, corpus):
    counts, _, vectors = corpus
    whole = moments.Moments.of(vectors, V)
    a = moments.Moments.of(vectors.where("doc_id < 400"), V)
    b = moments.Moments.of(vectors.where("doc_id >= 400"), V)
    assert np.allclose(a.merge(b).second, whole.second) and a.merge(b).n == whole.n


def test_whitening(spark, corpus):
    counts, _, vectors = corpus
    state = moments.Moments.of(vectors, V)
    fitted = moments.whiten_fit(state, K, ALPHA0)
    assert np.allclose(fitted.forward.T @ state.covariance(ALPHA0) @ fitted.forward, np.eye(K), atol=1e-9)
    rows = moments.whiten_transform(vectors, fitted).collect()
    y = np.zeros((N, K))
    for r in rows:
        y[r.doc_id] = r.y
    assert len(rows) == N
    assert np.allclose(y, (counts - counts.mean(0)) @ fitted.forward)
    assert np.allclose(y.T @ y / N, np.eye(K) / (1 + ALPHA0))
    assert np.allclose(fitted.forward.T @ fitted.backward, np.eye(K))


def test_too_many_topics_is_an_error(spark, corpus):
    with pytest.raises(ValueError):
        moments.whiten_fit(moments.Moments.of(corpus[2], V), V + 1, ALPHA0)


def raw_gradient(phi, y, alpha, theta):
    gradient = 3 * (1 + theta) * phi @ ((phi.T @ phi) ** 2)
    return gradient - 3 * (1 + alpha) * (2 + alpha) / (2 * len(y)) * y.T @ ((y @ phi) ** 2)


def test_tensor_descent_equals_descent_on_rows(spark, corpus):
    """Minibatches of 400 in id order, the short last one included."""
    counts, _, vectors = corpus
    state = moments.Moments.of(vectors, V)
    fitted = moments.whiten_fit(state, K, ALPHA0)
    params = tensor_lda.TopicParams(K, ALPHA0, 40, 400, 0.001, init="scaled", seed=3)
    tensors, sizes = tensor_lda.batch_tensors(vectors, fitted, N, 400)
    assert sizes.tolist() == [400, 400, 400, 300]
    got = tensor_lda.descend(tensor_lda.initial_factors(params), tensors, params)
    y = (counts - counts.mean(0)) @ fitted.forward
    phi = tensor_lda.initial_factors(params)
    for epoch in range(1, 40):
        for start in range(0, N, 400):
            rate = 0.001 * 10 / (10 + epoch)
            phi = phi - rate * raw_gradient(phi, y[start : start + 400], ALPHA0, 1.0)
    assert np.allclose(got, phi, rtol=1e-9, atol=1e-12)


def test_descent_on_data_equals_one_tensor(spark, corpus):
    counts, _, vectors = corpus
    fitted = moments.whiten_fit(moments.Moments.of(vectors, V), K, ALPHA0)
    params = tensor_lda.TopicParams(K, ALPHA0, 5, N, 0.001, init="scaled")
    tensors, _ = tensor_lda.batch_tensors(vectors, fitted, N, N)
    start = tensor_lda.initial_factors(params)
    got = tensor_lda.descend_on_data(start, spark, tensor_lda.WrittenBatches.of(vectors, fitted, N, N), params)
    assert np.allclose(got, tensor_lda.descend(start, tensors, params), rtol=1e-9)


def test_minibatches_without_tensors(spark, corpus, monkeypatch):
    """The same steps whether the tensors fit the driver or not."""
    vectors = corpus[2]
    params = tensor_lda.TopicParams(K, ALPHA0, 3, 400, 0.001, init="scaled")
    plain = tensor_lda.fit(vectors, V, params)
    monkeypatch.setattr(tensor_lda, "TENSOR_BYTES", 0)
    other = tensor_lda.fit(vectors, V, params)
    assert other.tensors is None and len(other.batches.counts) == len(plain.counts)
    assert np.allclose(other.factors, plain.factors, rtol=1e-9)
    with pytest.raises(ValueError):
        other.cumulant()
    with pytest.raises(FloatingPointError):
        tensor_lda.descend_on_data(other.factors, spark, other.batches, tensor_lda.TopicParams(K, ALPHA0, 20, 400, 1e6))


def test_reloaded_model_goes_on(spark, corpus, tmp_path):
    vectors = corpus[2]
    model = tensor_lda.fit(vectors, V, tensor_lda.TopicParams(K, ALPHA0, 3, 400, 0.001, init="scaled"))
    tensor_lda.save_model(model, spark, str(tmp_path / "m"))
    back = tensor_lda.load_model(spark, str(tmp_path / "m"))
    more = (model.tensors[:2], model.counts[:2])
    assert np.allclose(back.cumulant(), model.cumulant())
    assert np.allclose(back.partial_fit(*more).factors, model.partial_fit(*more).factors)
    assert len(back.partial_fit(*more).tensors) == len(model.tensors) + 2


def test_batches_of_long_ids(spark, corpus):
    shifted = corpus[2].withColumn("doc_id", F.col("doc_id") + F.lit(1_250_000_000_000_000_000))
    sizes = moments.assign_batches(shifted, N, 100).groupBy("batch_id").count().collect()
    assert sorted(r["count"] for r in sizes) == sorted([100] * (N // 100) + [N % 100] * (N % 100 > 0))


def test_as_many_batches_as_asked(spark, corpus):
    some = corpus[2].orderBy("doc_id").limit(600)
    rows = moments.assign_batches(some, 600, 1)
    assert rows.select("batch_id").distinct().count() == 600
    with pytest.raises(ValueError):
        moments.assign_batches(corpus[2], 0, 10)


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(0)
    y, phi, a, theta = rng.normal(size=(50, 3)), rng.normal(size=(3, 3)), 0.3, 1.0
    mean = numeric.cube_sum(y) / len(y)

    def loss(p):
        gram = p.T @ p
        scale = (1 + a) * (2 + a) / 2
        return (1 + theta) / 2 * (gram**3).sum() - scale * np.einsum("ijm,ic,jc,mc->", mean, p, p, p)

    want = np.zeros_like(phi)
    for i in range(3):
        for c in range(3):
            step = np.zeros_like(phi)
            step[i, c] = 1e-6
            want[i, c] = (loss(phi + step) - loss(phi - step)) / 2e-6
    got = tensor_lda.cumulant_gradient(phi, mean, a, theta)
    assert np.allclose(got, want, rtol=1e-4, atol=1e-4)


def test_exact_third_moment(spark):
    """Against the word-space tensor built entry by entry, then contracted."""
    counts, _ = planted(2, 200, 8, 3, 12)
    state = moments.Moments.of(frame(spark, counts), 8)
    fitted, _ = moments.whiten_exact(state, 3, ALPHA0)
    n, v, a = 200, 8, ALPHA0
    mean, pair = counts.mean(0), counts.T @ counts / n
    m3 = np.einsum("ni,nj,nl->ijl", counts, counts, counts) / n
    for i in range(v):
        for j in range(v):
            m3[i, i, j] -= pair[i, j]
            m3[i, j, i] -= pair[i, j]
            m3[j, i, i] -= pair[i, j]
        m3[i, i, i] += 2 * mean[i]
    m3 *= (a + 1) * (a + 2) / 2
    for i in range(v):
        for j in range(v):
            for t in ((i, i, j), (i, j, i), (j, i, i)):
                m3[t] -= a * (a + 1) / 2 * mean[i] * mean[j]
    m3 += a * a * np.einsum("i,j,l->ijl", mean, mean, mean)
    want = np.einsum("ijl,ia,jb,lc->abc", m3, fitted.forward, fitted.forward, fitted.forward)
    got = tensor_lda.M.exact_third_moment(frame(spark, counts), fitted, state, ALPHA0)
    assert np.allclose(got, want, rtol=1e-8, atol=1e-8)


def test_power_iteration_recovers_an_orthogonal_tensor():
    basis, _ = np.linalg.qr(np.random.default_rng(5).normal(size=(4, 4)))
    weights = np.array([4.0, 3.0, 2.0, 1.0])
    tensor = tensor_lda.rebuild(basis, weights)
    found, factors = tensor_lda.power_iteration(tensor, 4, n_iter=40)
    assert np.allclose(np.sort(found), np.sort(weights), atol=1e-6)
    assert tensor_lda.reconstruction_error(tensor_lda.rebuild(factors, found), tensor) < 1e-6


def best_cosines(found, truth):
    found = found / np.linalg.norm(found, axis=0)
    truth = truth.T / np.linalg.norm(truth.T, axis=0)
    return np.abs(truth.T @ found).max(axis=1)


def test_planted_topics_are_found(spark, corpus):
    _, phi, vectors = corpus
    _, table, _, _, _ = tensor_lda.fit_exact(vectors, V, K, ALPHA0)
    assert best_cosines(table, phi).mean() > 0.9
    params = tensor_lda.TopicParams(K, ALPHA0, 2000, 15000, 0.01, init="scaled")
    model = tensor_lda.fit(vectors, V, params)
    rows = model.topic_table(spark).collect()
    learned = np.zeros((V, K))
    for r in rows:
        learned[r.term_id, r.topic] = r.weight
    assert best_cosines(learned, phi).mean() > 0.6
    assert tensor_lda.tensor_losses(model.factors, model.cumulant(), 1.0)["rec"] >= 0


def test_divergence_is_reported(spark, corpus):
    with pytest.raises(FloatingPointError):
        tensor_lda.fit(corpus[2], V, tensor_lda.TopicParams(K, ALPHA0, 500, 15000, 5.0, init="scaled"))


def one_by_one(ids, counts, beta, start, prior, n_iter):
    gamma = start.copy()
    for _ in range(n_iter):
        last = gamma
        weight = np.exp(numeric.digamma(last) - numeric.digamma(last.sum()))
        gamma = weight * (beta[ids].T @ (counts / (beta[ids] @ weight + 1e-100))) + prior
        if np.abs(gamma - last).mean() <= 1e-2:
            break
    return gamma


def test_inference_by_document(spark, corpus):
    counts, phi, vectors = corpus
    beta = phi.T / phi.T.sum(axis=1, keepdims=True)
    rows = inference.infer_doc_topics(vectors, beta, seed=5, block=64).collect()
    assert len(rows) == N
    for r in rows[:200]:
        start = np.random.default_rng([5, r.doc_id]).gamma(1.0, 1.0, K)
        ids = np.flatnonzero(counts[r.doc_id])
        want = one_by_one(ids, counts[r.doc_id][ids], beta, start, 1 / K, 150)
        assert np.allclose(r.gamma, want, rtol=1e-8)
        assert sum(r.p) == pytest.approx(1.0)
    other = {r.doc_id: r.gamma for r in inference.infer_doc_topics(vectors.repartition(1), beta, seed=5).collect()}
    assert all(np.allclose(r.gamma, other[r.doc_id], rtol=1e-9) for r in rows)


def test_perplexity_by_hand(spark, corpus):
    counts, phi, vectors = corpus
    beta = phi.T * (1 - 1e-6) + 1e-6
    beta /= beta.sum(axis=0)
    inferred = inference.infer_doc_topics(vectors, beta).persist()
    alpha = np.full(K, 1 / K)
    got = inference.perplexity(vectors, inferred, beta, alpha).first()
    total = 0.0
    for r in inferred.collect():
        gamma = np.array(r.gamma)
        e = numeric.digamma(gamma) - numeric.digamma(gamma.sum())
        for w in np.flatnonzero(counts[r.doc_id]):
            total += counts[r.doc_id, w] * math.log(sum(math.exp(e[c]) * beta[w, c] for c in range(K)))
        total += ((alpha - gamma) * e).sum()
        total += sum(math.lgamma(g) - math.lgamma(x) for g, x in zip(gamma, alpha))
        total += math.lgamma(alpha.sum()) - math.lgamma(gamma.sum())
    assert got.n_words == counts.sum()
    assert got.perplexity == pytest.approx(-total / counts.sum(), rel=1e-9)


def test_fold_sentiment(spark):
    rows = spark.createDataFrame([(0, 1, 0.5), (1, 4, 0.25), (0, 6, 0.125)], "topic long, term_id long, weight double")
    folded = {(r.topic, r.term_id, r.weight) for r in topics.fold_sentiment(rows, 2, 3).collect()}
    assert folded == {(0, 1, 0.5), (3, 1, 0.25), (4, 0, 0.125)}


def simplex_by_search(v):
    low, high = v.min() - 1, v.max()
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if np.maximum(v - mid, 0).sum() > 1 else (low, mid)
    return np.maximum(v - low, 0)


def test_simplex_projection(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=(3, 12))
    rows = [(t, i, float(values[t, i])) for t in range(3) for i in range(12)]
    frame_ = spark.createDataFrame(rows, "topic long, term_id long, weight double")
    for r in topics.simplex_project(frame_).collect():
        assert r.p == pytest.approx(simplex_by_search(values[r.topic])[r.term_id], abs=1e-9)
    sums = topics.nonneg_adjust(frame_).groupBy("topic").agg(F.sum("p").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in sums)


def test_stability_of_runs(spark):
    words = [f"w{i:02d}" for i in range(40)]
    rows = [(run, t, w, float(100 - i)) for run, shift in (("a", 0), ("b", 0)) for t in range(2) for i, w in enumerate(words[t * 20 + shift :][:15])]
    rows += [("c", t, f"z{t}{i}", float(100 - i)) for t in range(2) for i in range(15)]
    frame_ = spark.createDataFrame(rows, "run string, topic long, term string, weight double")
    got = {(r.run1, r.run2): r.similarity for r in topics.run_similarity(frame_).collect()}
    assert got[("a", "b")] == 2 and got[("a", "c")] == 0 and got[("c", "c")] == 2 and len(got) == 9
    assert topics.runs_converged(frame_).first().converged is False
    assert topics.runs_converged(frame_.where("run != 'c'")).first().converged is True


def test_whitened_tolerance(spark):
    rows = [(run, d, [1.0 + shift, 2.0]) for run, shift in (("a", 0.0), ("b", 5e-5), ("c", 2e-4)) for d in range(3)]
    frame_ = spark.createDataFrame(rows, "run string, doc_id long, y array<double>")
    close = {(r.run1, r.run2): r.close for r in topics.whitened_allclose(frame_).collect()}
    assert close[("a", "b")] and not close[("a", "c")] and close[("c", "c")]
    less = frame_.where("run != 'b' OR doc_id > 0").unionByName(frame_.where("run = 'a'").withColumns({"run": F.lit("d"), "doc_id": F.col("doc_id") + 9}))
    close = {(r.run1, r.run2): r.close for r in topics.whitened_allclose(less).collect()}
    assert not close[("a", "b")] and close[("b", "b")] and not close[("a", "d")] and len(close) == 16


def test_topics_without_a_common_word_may_match(spark):
    rows = [(run, 0, f"{run}{i}", float(9 - i)) for run in "ab" for i in range(4)]
    frame_ = spark.createDataFrame(rows, "run string, topic long, term string, weight double")
    assert {r.similarity for r in topics.run_similarity(frame_, tolerance=5).collect()} == {1}


def test_joint_sentiment(spark):
    bow = spark.createDataFrame([(1, 0, 3), (1, 1, 3)], "doc_id long, term_id long, cnt long")
    words = spark.createDataFrame([(0, "good"), (1, "plain")], "term_id long, term string")
    lexicon = spark.createDataFrame([("good", 0.8, 0.1, 0.1)], "token string, positive double, negative double, neutral double")
    got = {r.term_id: r.v for r in topics.sentiment_blocks(bow, words, lexicon).collect()}
    assert got == pytest.approx({0: 2.4, 1: 1.0, 2: 0.3, 3: 1.0, 4: 0.3, 5: 1.0})


def test_further_batches_unlike_the_first_are_learned_without_leaving_the_finite_range():
    rng = np.random.default_rng(4)
    params = tensor_lda.TopicParams(K, 0.003, 200, 100, 0.002, init="scaled")
    usual = tensor_lda.rebuild(rng.normal(size=(K, K)))[None]
    factors = tensor_lda.descend(tensor_lda.initial_factors(params), usual, params)
    model = tensor_lda.TopicModel(params, None, factors, usual, np.array([100.0]))
    assert np.array_equal(model.partial_fit(usual, np.array([9.0])).factors, tensor_lda.descend(factors, usual, params))
    larger = 1e4 * tensor_lda.rebuild(rng.normal(size=(K, K)))[None]
    with pytest.raises(FloatingPointError):
        tensor_lda.descend(factors, larger, params)
    found = model.partial_fit(larger, np.array([9.0])).factors
    before, after = (tensor_lda.batch_loss(x, larger[0], params.alpha0) for x in (factors, found))
    assert np.isfinite(found).all() and after < before
    steps = 1e-6 * rng.normal(size=(K, K))  # the gradient is that of the loss
    slope = (tensor_lda.batch_loss(factors + steps, usual[0]) - tensor_lda.batch_loss(factors - steps, usual[0])) / 2
    assert slope == pytest.approx(float((tensor_lda.cumulant_gradient(factors, usual[0]) * steps).sum()), rel=1e-4)


def test_documents_are_worked_on_a_bounded_number_of_words_at_a_time(spark, monkeypatch):
    sizes = np.array([3, 0, 4, 9, 0, 0, 2, 2, 1])
    cut = [(p.start, p.stop) for p in inference.pieces(sizes, 3, 5)]
    assert cut == [(0, 2), (2, 3), (3, 4), (4, 7), (7, 9)]
    assert list(inference.pieces(np.zeros(0, np.int64), 3)) == []
    counts, phi = planted(seed=6, n=40)
    sparse = [np.flatnonzero(row) for row in counts]
    ids, sizes = np.concatenate(sparse), np.array([len(x) for x in sparse])
    cnts, start = np.concatenate([row[x] for row, x in zip(counts, sparse, strict=True)]), np.ones((40, K))
    whole = inference.infer_block(ids, cnts, sizes, phi.T, start, 0.1, 50)
    ends = np.cumsum(sizes)
    parts = []
    for p in inference.pieces(sizes, 2048, 100):
        words = slice(ends[p.start] - sizes[p.start], ends[p.stop - 1])
        parts.append(inference.infer_block(ids[words], cnts[words], sizes[p], phi.T, start[p], 0.1, 50))
    assert len(parts) > 3 and np.array_equal(np.vstack(parts), whole)


def test_a_descent_that_a_few_batches_drive_out_of_the_finite_range_is_taken_in_shorter_steps(spark, corpus):
    rng = np.random.default_rng(7)
    params = tensor_lda.TopicParams(K, 0.003, 60, 100, 0.002, init="scaled")
    tensors = np.array([tensor_lda.rebuild(rng.normal(size=(K, K))) for _ in range(20)])
    start = tensor_lda.initial_factors(params)
    assert np.array_equal(tensor_lda.descend_finite(start, tensors, params), tensor_lda.descend(start, tensors, params))
    tensors[7] *= 1e4  # documents much alike, all in one batch
    with pytest.raises(FloatingPointError):
        tensor_lda.descend(start, tensors, params)
    found = tensor_lda.descend_finite(start, tensors, params)
    assert np.isfinite(found).all()
    for tensor in tensors[:8]:  # a shortened step is halves of the plain one, and the first that does not raise the loss
        for rate in (1e-4, 1.0):
            step = found - tensor_lda.steady_step(found, tensor, rate, params)
            gradient = tensor_lda.cumulant_gradient(found, tensor, params.alpha0)
            halves = np.log2(rate * np.linalg.norm(gradient) / np.linalg.norm(step))
            assert halves == pytest.approx(round(halves), abs=1e-6) and np.allclose(step, rate / 2 ** round(halves) * gradient)
            low = tensor_lda.batch_loss(found, tensor, params.alpha0)
            assert tensor_lda.batch_loss(found - step, tensor, params.alpha0) <= low + 1e-8 * abs(low)
            assert round(halves) == 0 or tensor_lda.batch_loss(found - 2 * step, tensor, params.alpha0) > low
    wild = tensor_lda.TopicParams(K, ALPHA0, 500, 15000, 5.0, init="scaled")  # what test_divergence_is_reported reports
    assert np.isfinite(tensor_lda.fit(corpus[2], V, wild, finite=True).factors).all()
