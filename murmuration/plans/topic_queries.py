"""Queries over topic tables, runs, coherence and joint sentiment counts.

The topic tables here are computed from the whole corpus: one topic per language, a word's weight being
its share in that language minus its share overall. The runs weigh words by occurrences, by documents
and by the square root of occurrences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmuration.operators import coherence, lexicon, topics, vocab
from murmuration.operators.cluster import cluster_distinct_terms as distinct_terms
from murmuration.operators.skew import skew_join
from murmuration.plans import sql
from murmuration.plans.registry import query, table
from murmuration.plans.text_queries import preprocessed
from murmuration.plans.vocab_queries import BASE, LEXICON_SQL, TFIDF, toy_lexicon
from murmuration.session import cut_lineage, scratch_path
from murmuration.sources import sinks

TOPIC_VOCAB = dict(min_df=5, max_df=0.9, max_features=400)
RUNS = ("occurrences", "documents", "roots")


def lang_runs(spark, sf_dir: str) -> DataFrame:
    """``(run, topic, term_id, term, weight)`` for every word of a 400-word vocabulary."""
    docs = preprocessed(spark, sf_dir, "lang")
    words, listed = vocab.pin(vocab.build_vocab(docs, **TOPIC_VOCAB))
    counted = (
        vocab.doc_vectors(docs, listed, keep=["lang"])
        .select("lang", F.explode(F.arrays_zip("ids", "cnts")).alias("p"))
        .groupBy("lang", F.col("p.ids").cast("long").alias("term_id"))
        .agg(F.sum("p.cnts").alias("occurrences"), F.count(F.lit(1)).cast("double").alias("documents"))
        .withColumn("roots", F.sqrt("occurrences"))
    )
    langs = docs.select(F.col("lang").alias("topic")).distinct()
    every = words.withColumn("topic", F.explode(langs.agg(F.collect_set("topic")).scalar()))
    stacked = counted.select("lang", "term_id", F.expr("stack(3, " + ", ".join(f"'{r}', {r}" for r in RUNS) + ") AS (run, v)"))
    filled = (
        every.withColumn("run", F.explode(F.array(*map(F.lit, RUNS))))
        .join(stacked.withColumnRenamed("lang", "topic"), ["run", "topic", "term_id"], "left")
        .na.fill(0.0, ["v"])
    )
    in_topic = F.sum("v").over(Window.partitionBy("run", "topic"))
    in_word = F.sum("v").over(Window.partitionBy("run", "term_id"))
    overall = F.sum("v").over(Window.partitionBy("run"))  # 400 words by a few languages
    return filled.select("run", "topic", "term_id", "term", (F.col("v") / in_topic - in_word / overall).alias("weight"))


def lang_topics(spark, sf_dir: str) -> DataFrame:
    return lang_runs(spark, sf_dir).where("run = 'occurrences'").drop("run")


TOPICS = (
    f"{BASE}, {sql.vocab(**TOPIC_VOCAB)}, "
    "lang_counts AS (SELECT lang, term, count(*)::DOUBLE AS o, count(DISTINCT doc_id)::DOUBLE AS d FROM words GROUP BY ALL), "
    "cells AS (SELECT run, l.lang AS topic, term_id, v.term, coalesce(CASE run WHEN 'occurrences' THEN o "
    "WHEN 'documents' THEN d ELSE sqrt(o) END, 0) AS v FROM vocab v CROSS JOIN (SELECT DISTINCT lang FROM documents) l "
    "CROSS JOIN (VALUES ('occurrences'), ('documents'), ('roots')) r(run) "
    "LEFT JOIN lang_counts c ON c.lang = l.lang AND c.term = v.term), "
    "runs AS (SELECT run, topic, term_id, term, v / sum(v) OVER (PARTITION BY run, topic) "
    "- sum(v) OVER (PARTITION BY run, term_id) / sum(v) OVER (PARTITION BY run) AS weight FROM cells), "
    "topics AS (SELECT topic, term_id, term, weight FROM runs WHERE run = 'occurrences')"
)
TOPICS_BODY = TOPICS.removeprefix("WITH ")
N_TERMS = "(SELECT count(DISTINCT term_id) FROM topics)"
N_TOPICS = "(SELECT count(DISTINCT topic) FROM topics)"


@query(
    "topic_weights",
    f"{TOPICS}, n AS (SELECT topic, pow(sum(pow(abs(weight), 3)), 1.0 / 3) AS norm FROM topics GROUP BY topic) "
    "SELECT topic, round(norm, 6) AS norm, round(pow(norm, -2) / sum(pow(norm, -2)) OVER () * 0.003, 8) AS alpha FROM n",
)
def topic_weights(spark, sf_dir):
    weights = topics.topic_weights(lang_topics(spark, sf_dir))
    return weights.select("topic", F.round("norm", 6).alias("norm"), F.round("alpha", 8).alias("alpha"))


def _normalized_sql(group: str, size: str, raised: str, smoothing: str = "1e-6") -> str:
    return (
        f"{TOPICS}, s AS (SELECT topic, term_id, {raised} * (1 - {smoothing}) + {smoothing} / {size} AS p FROM topics) "
        f"SELECT topic, term_id, round(p / sum(p) OVER (PARTITION BY {group}), 9) AS p FROM s"
    )


def _normalized(spark, sf_dir, **options):
    shares = topics.normalize_topics(lang_topics(spark, sf_dir), **options)
    return shares.select("topic", "term_id", F.round("p", 9).alias("p"))


@query("topic_word_normalize", _normalized_sql("topic", N_TERMS, "greatest(weight, 0)"))
def topic_word_normalize(spark, sf_dir):
    return _normalized(spark, sf_dir)


@query("topic_word_normalize_by_word", _normalized_sql("term_id", N_TOPICS, "greatest(weight, 0)"))
def topic_word_normalize_by_word(spark, sf_dir):
    return _normalized(spark, sf_dir, axis="word")


@query("topic_shift_nonneg", _normalized_sql("topic", N_TERMS, "(weight + (SELECT abs(min(weight)) FROM topics))"))
def topic_shift_nonneg(spark, sf_dir):
    return _normalized(spark, sf_dir, negatives="shift")


@query(
    "smooth_beta",
    f"{TOPICS}, s AS (SELECT topic, term_id, greatest(weight, 0) * (1 - 1e-6) + 1e-6 / {N_TERMS} AS p FROM topics), "
    "b AS (SELECT topic, term_id, p / sum(p) OVER (PARTITION BY topic) AS p FROM s) "
    f"SELECT topic, term_id, round(p * 0.99 + 0.01 / {N_TERMS}, 9) AS p FROM b",
)
def smooth_beta(spark, sf_dir):
    smooth = topics.smooth_beta(topics.normalize_topics(lang_topics(spark, sf_dir)), 0.01)
    return smooth.select("topic", "term_id", F.round("p", 9).alias("p"))


@query(
    "smooth_beta_sums",
    "SELECT DISTINCT lang AS topic, 1.0::DOUBLE AS total, true AS ok FROM documents",
)
def smooth_beta_sums(spark, sf_dir):
    """The check that smoothing leaves every topic summing to one."""
    smooth = topics.smooth_beta(topics.normalize_topics(lang_topics(spark, sf_dir)), 0.01)
    return topics.unit_sums(smooth).withColumn("total", F.round("total", 9))


def _simplex_sql(value: str, source: str, name: str) -> str:
    return (
        f"{name}r AS (SELECT *, row_number() OVER w AS r, sum({value}) OVER w AS c FROM {source} "
        f"WINDOW w AS (PARTITION BY topic ORDER BY {value} DESC, term_id ROWS UNBOUNDED PRECEDING)), "
        f"{name}t AS (SELECT topic, arg_max((c - 1) / r, r) AS theta FROM {name}r WHERE {value} - (c - 1) / r > 0 GROUP BY topic), "
        f"{name} AS (SELECT topic, term_id, theta, greatest({value} - theta, 0) AS p FROM {source} JOIN {name}t USING (topic))"
    )


@query(
    "simplex_project",
    f"{TOPICS}, {_simplex_sql('weight', 'topics', 's')} "
    "SELECT topic, term_id, round(theta, 8) AS theta, round(p, 8) AS p FROM s",
)
def simplex_project(spark, sf_dir):
    projected = topics.simplex_project(lang_topics(spark, sf_dir))
    return projected.select("topic", "term_id", F.round("theta", 8).alias("theta"), F.round("p", 8).alias("p"))


@query(
    "nonneg_adjust",
    f"{TOPICS}, shifted AS (SELECT topic, term_id, weight - min(weight) OVER (PARTITION BY topic) AS u, "
    "max(weight) OVER (PARTITION BY topic) - weight AS d FROM topics), "
    f"{_simplex_sql('u', 'shifted', 'up')}, {_simplex_sql('d', 'shifted', 'dn')} "
    "SELECT topic, term_id, round(CASE WHEN up.theta < dn.theta THEN up.p ELSE dn.p END, 8) AS p, "
    "NOT up.theta < dn.theta AS mirrored FROM up JOIN dn USING (topic, term_id)",
)
def nonneg_adjust(spark, sf_dir):
    return topics.nonneg_adjust(lang_topics(spark, sf_dir)).withColumn("p", F.round("p", 8))


TOP = "row_number() OVER (PARTITION BY {by} ORDER BY weight DESC, term)"


@query(
    "top_words",
    f"{TOPICS} SELECT topic, {TOP.format(by='topic')} AS rank, term, round(weight, 8) AS weight FROM topics "
    f"QUALIFY {TOP.format(by='topic')} <= 20",
)
def top_words(spark, sf_dir):
    best = topics.top_words(lang_topics(spark, sf_dir), 20)
    return best.select("topic", "rank", "term", F.round("weight", 8).alias("weight"))


@query(
    "topic_growth_terms",
    f"{TOPICS} SELECT topic, term, round(weight, 8) AS weight FROM topics QUALIFY {TOP.format(by='topic')} <= 200",
)
def topic_growth_terms(spark, sf_dir):
    """The word-to-weight map a word cloud is drawn from."""
    best = topics.top_words(lang_topics(spark, sf_dir), 200)
    return best.select("topic", "term", F.round("weight", 8).alias("weight"))


@query("term_across_topics", f"{TOPICS} SELECT topic, term, round(weight, 8) AS weight FROM topics WHERE term = 'ention'")
def term_across_topics(spark, sf_dir):
    bars = topics.term_across_topics(lang_topics(spark, sf_dir), "ention")
    return bars.withColumn("weight", F.round("weight", 8))


@query(
    "doc_top_topic",
    f"{TOPICS}, score AS (SELECT doc_id, topic, round(sum(cnt * greatest(weight, 0)), 7) AS p FROM counts "
    "JOIN topics USING (term) GROUP BY ALL), best AS (SELECT * FROM score QUALIFY row_number() OVER "
    "(PARTITION BY doc_id ORDER BY p DESC, topic DESC) = 1) "
    "SELECT doc_id, topic, p, text FROM documents LEFT JOIN best USING (doc_id)",
)
def doc_top_topic(spark, sf_dir):
    """Documents scored by the words of every topic; each with its strongest topic and its text."""
    docs = preprocessed(spark, sf_dir, "text")
    table_ = lang_topics(spark, sf_dir)
    words = [r["term"] for r in table_.select("term_id", "term").distinct().orderBy("term_id").collect()]
    weights = table_.select("topic", "term_id", F.greatest("weight", F.lit(0.0)).alias("weight"))
    scores = (
        vocab.doc2bow(docs, words)
        .join(F.broadcast(weights), "term_id")  # 400 words by a few topics
        .groupBy("doc_id", "topic")
        .agg(F.round(F.sum(F.col("cnt") * F.col("weight")), 7).alias("p"))
    )
    return topics.doc_top_topic(scores, docs.select("doc_id", "text"))


SIMILAR = (
    f"{TOPICS}, top AS (SELECT run, topic, term FROM runs QUALIFY {TOP.format(by='run, topic')} <= 10), "
    "ids AS (SELECT DISTINCT run, topic FROM top), "
    "matched AS (SELECT a.run AS run1, b.run AS run2, b.topic AS j, bool_or((SELECT count(*) FROM top t WHERE t.run = a.run "
    "AND t.topic = a.topic AND t.term NOT IN (SELECT u.term FROM top u WHERE u.run = b.run AND u.topic = b.topic)) <= 5) AS hit "
    "FROM ids a CROSS JOIN ids b GROUP BY ALL), "
    "alike AS (SELECT run1, run2, count(*) FILTER (hit) AS similarity FROM matched GROUP BY run1, run2)"
)


@query("run_similarity", f"{SIMILAR} SELECT run1, run2, similarity FROM alike")
def run_similarity(spark, sf_dir):
    return topics.run_similarity(lang_runs(spark, sf_dir))


@query("runs_converged", f"{SIMILAR} SELECT bool_and(similarity >= {N_TOPICS} / 2.0) AS converged FROM alike")
def runs_converged(spark, sf_dir):
    return topics.runs_converged(lang_runs(spark, sf_dir))


@query(
    "whitened_allclose",
    "WITH y AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings), "
    "runs AS (SELECT 'full' AS run, * FROM y UNION ALL SELECT 'four', vec_id, round(v, 4), d FROM y "
    "UNION ALL SELECT 'two', vec_id, round(v, 2), d FROM y) "
    "SELECT a.run AS run1, b.run AS run2, round(max(abs(a.v - b.v)), 7) AS max_diff, max(abs(a.v - b.v)) <= 1e-4 AS close "
    "FROM runs a JOIN runs b USING (vec_id, d) GROUP BY ALL",
)
def whitened_allclose(spark, sf_dir):
    """Vectors at three precisions, as three runs."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda v: v.cast("double")).alias("y")
    )
    runs = rows.withColumn("run", F.lit("full"))
    for name, places in (("four", 4), ("two", 2)):
        coarse = F.expr(f"transform(y, v -> round(v, {places}))")
        runs = runs.unionByName(rows.select("doc_id", coarse.alias("y"), F.lit(name).alias("run")))
    close = topics.whitened_allclose(runs)
    return close.withColumn("max_diff", F.round("max_diff", 7))


@query("write_distribution", f"{TOPICS} SELECT run, topic, term, round(weight, 8) AS prob FROM runs")
def write_distribution(spark, sf_dir):
    """The full tables of all runs, written by run and read back."""
    path = scratch_path(spark, "distributions")
    sinks.write_distribution(lang_runs(spark, sf_dir).select("run", "topic", "term", F.col("weight").alias("prob")), path)
    saved = spark.read.parquet(path)
    return saved.select("run", "topic", "term", F.round("prob", 8).alias("prob"))


@query(
    "write_top_words",
    f"{TOPICS} SELECT topic, {TOP.format(by='topic')}::INTEGER AS rank, term FROM topics QUALIFY {TOP.format(by='topic')} <= 20",
)
def write_top_words(spark, sf_dir):
    """Top words through a CSV with a header."""
    path = scratch_path(spark, "top-words")
    sinks.write_csv(topics.top_words(lang_topics(spark, sf_dir), 20).select("topic", "rank", "term"), path)
    return spark.read.csv(path, header=True, schema="topic string, rank int, term string")


# A small made-up sentiment lexicon in the corpus's own words.
SENTIMENT = [("thention", 0.7, 0.1, 0.2), ("onthe", 0.1, 0.8, 0.1), ("erenin", 0.25, 0.25, 0.5), ("inere", 0.6, 0.2, 0.2)]
SENTIMENT_SQL = "senti(token, positive, negative, neutral) AS (VALUES " + ", ".join(
    f"('{t}', {p}::DOUBLE, {n}::DOUBLE, {u}::DOUBLE)" for t, p, n, u in SENTIMENT
) + ")"


@query(
    "joint_sentiment_dtm",
    f"{BASE}, {sql.vocab(5, 0.5, 1000)}, {SENTIMENT_SQL}, b AS (SELECT doc_id, term_id, cnt, positive, neutral, negative "
    "FROM counts JOIN vocab USING (term) LEFT JOIN senti ON token = term) "
    + " UNION ALL ".join(
        f"SELECT doc_id, term_id + {i} * (SELECT count(*) FROM vocab) AS term_id, round(cnt * coalesce({c}, 1.0 / 3), 6) AS v FROM b"
        for i, c in enumerate(("positive", "neutral", "negative"))
    ),
)
def joint_sentiment_dtm(spark, sf_dir):
    docs = preprocessed(spark, sf_dir)
    terms, words = vocab.pin(vocab.build_vocab(docs, 5, 0.5, 1000))
    scores = spark.createDataFrame(SENTIMENT, "token string, positive double, negative double, neutral double")
    blocks = topics.sentiment_blocks(vocab.doc2bow(docs, words), terms, scores)
    return blocks.withColumn("v", F.round("v", 6))


@query(
    "lexicon_in_topics",
    f"WITH {LEXICON_SQL}, {TOPICS[5:]} SELECT topic, grp, term, round(weight, 8) AS weight FROM topics JOIN lex USING (term)",
)
def lexicon_in_topics(spark, sf_dir):
    found = lexicon.in_topics(lang_topics(spark, sf_dir), toy_lexicon(spark).select("grp", "term"))
    return found.withColumn("weight", F.round("weight", 8))


# --- clusters described by terms


@query(
    "cluster_distinct_terms",
    f"{BASE}, {TFIDF}, sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source), "
    "centres AS (SELECT source AS cluster, term, round(sum(tfidf) / max(n), 9) AS weight FROM tfidf JOIN documents USING (doc_id) "
    "JOIN sizes USING (source) GROUP BY source, term), "
    "lead AS (SELECT cluster, term, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term) AS r FROM centres "
    "QUALIFY r <= 100), alone AS (SELECT * FROM lead QUALIFY count(*) OVER (PARTITION BY term) = 1) "
    "SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY r) AS rank, term FROM alone "
    "QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY r) <= 5",
)
def cluster_distinct_terms(spark, sf_dir):
    """Sources as clusters, their centres being mean TF-IDF rows."""
    docs = preprocessed(spark, sf_dir, "source")
    sizes = docs.groupBy(F.col("source").alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    sums = (
        vocab.tfidf_smooth(docs)
        .join(docs.select("doc_id", F.col("source").alias("cluster")), "doc_id")
        .groupBy("cluster", "term")
        .agg(F.sum("tfidf").alias("total"))
    )
    sums = cut_lineage(sums, "cluster-terms")  # read for the sizes and for the join
    by_cluster = sums.groupBy("cluster").count()
    sized = sizes.join(by_cluster, "cluster")
    centres = skew_join(sums, sized, "cluster", "count", "term").select(
        "cluster", "term", F.round(F.col("total") / F.col("size"), 9).alias("weight")
    )
    return distinct_terms(centres)


# --- coherence of the language topics over the whole corpus

CO_TOP = (
    f"{TOPICS}, top AS (SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) - 1 AS b FROM topics "
    "QUALIFY row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) <= 20)"
)


def coherence_input(spark, sf_dir):
    top = topics.top_words(lang_topics(spark, sf_dir), 20).select("topic", "rank", "term")
    pinned = spark.createDataFrame(top.collect(), top.schema)  # topics x 20 rows
    return preprocessed(spark, sf_dir), pinned


def _windows_sql(size: int) -> str:
    return (
        f"{CO_TOP}, starts AS (SELECT doc_id, tokens, unnest(range(0, greatest(len(tokens) - {size}, 0) + 1)) AS s FROM tok "
        f"WHERE len(tokens) > 0), wins AS (SELECT doc_id, s, list_distinct(tokens[s + 1 : s + {size}]) AS ws FROM starts), "
        "n AS (SELECT count(*) AS n FROM wins), held AS (SELECT doc_id, s, topic, b FROM "
        "(SELECT doc_id, s, unnest(ws) AS term FROM wins) JOIN top USING (term)), "
        "one AS (SELECT topic, b, count(*) AS c FROM held GROUP BY ALL), "
        "two AS (SELECT x.topic, x.b AS a, y.b AS b, count(*) AS c FROM held x JOIN held y USING (doc_id, s, topic) GROUP BY ALL), "
        "pairs AS (SELECT p.topic, p.b AS a, q.b AS b, o.c::DOUBLE / n AS pa, r.c::DOUBLE / n AS pb, coalesce(t.c, 0) / n + 1e-12 AS pab "
        "FROM top p JOIN top q USING (topic) JOIN one o ON o.topic = p.topic AND o.b = p.b "
        "JOIN one r ON r.topic = p.topic AND r.b = q.b LEFT JOIN two t ON t.topic = p.topic AND t.a = p.b AND t.b = q.b, n)"
    )


def rounded(per_topic):
    return per_topic.select("topic", F.round("coherence", 6).alias("coherence"))


@query(
    "coherence_umass",
    f"{CO_TOP}, held AS (SELECT DISTINCT doc_id, topic, b FROM words JOIN top USING (term)), "
    "one AS (SELECT topic, b, count(*) AS c FROM held GROUP BY ALL), "
    "two AS (SELECT x.topic, x.b AS a, y.b AS b, count(*) AS c FROM held x JOIN held y USING (doc_id, topic) GROUP BY ALL) "
    f"SELECT p.topic, round(avg(ln((coalesce(t.c, 0) / {sql.N_DOCS}::DOUBLE + 1e-12) / (o.c / {sql.N_DOCS}::DOUBLE))), 6) AS coherence "
    "FROM top p JOIN top q ON p.topic = q.topic AND p.b > q.b JOIN one o ON o.topic = q.topic AND o.b = q.b "
    "LEFT JOIN two t ON t.topic = p.topic AND t.a = p.b AND t.b = q.b GROUP BY p.topic",
)
def coherence_umass(spark, sf_dir):
    return rounded(coherence.umass(*coherence_input(spark, sf_dir)))


@query(
    "coherence_uci",
    f"{_windows_sql(10)} SELECT topic, round(avg(ln(pab / (pa * pb))), 6) AS coherence FROM pairs WHERE a <> b GROUP BY topic",
)
def coherence_uci(spark, sf_dir):
    return rounded(coherence.uci(*coherence_input(spark, sf_dir)))


@query(
    "coherence_npmi",
    f"{_windows_sql(10)} SELECT topic, round(avg(ln(pab / (pa * pb)) / -ln(pab)), 6) AS coherence FROM pairs "
    "WHERE a <> b GROUP BY topic",
)
def coherence_npmi(spark, sf_dir):
    return rounded(coherence.npmi(*coherence_input(spark, sf_dir)))


@query(
    "coherence_cv",
    f"{_windows_sql(110)}, v AS (SELECT topic, a, b, ln(pab / (pa * pb)) / -ln(pab) AS v FROM pairs), "
    "t AS (SELECT topic, b, sum(v) AS t FROM v GROUP BY ALL), c AS (SELECT topic, a, sum(v * t) / "
    "(sqrt(sum(v * v)) * sqrt(sum(t * t))) AS c FROM v JOIN t USING (topic, b) GROUP BY ALL) "
    "SELECT topic, round(avg(c), 6) AS coherence FROM c GROUP BY topic",
)
def coherence_cv(spark, sf_dir):
    return rounded(coherence.cv(*coherence_input(spark, sf_dir)))
