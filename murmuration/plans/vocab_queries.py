"""Queries over vocabularies, counts, TF-IDF, corpus measurements and lexicons."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmuration.functions import text as T
from murmuration.operators import lexicon, measure, vocab
from murmuration.operators.search import document_search as search
from murmuration.operators.search_index import SearchIndex, build_index
from murmuration.plans import sql
from murmuration.plans.plane import PLANE, plane
from murmuration.plans.registry import documents, query, table
from murmuration.plans.text_queries import preprocessed
from murmuration.session import scratch_path
from murmuration.sources import sinks

MIN_DF, MAX_DF, MAX_FEATURES = 5, 0.5, 1000
BASE = sql.BASE
VOCAB = sql.vocab(MIN_DF, MAX_DF, MAX_FEATURES)

# A neutral made-up lexicon in the corpus's own words; one group has only four terms.
LEXICON = [
    ("north", "tion", False), ("north", "erin", False), ("north", "and the", False),
    ("north", "ndth", True), ("north", "ention", False), ("north", "thing", False),
    ("south", "étre", False), ("south", "ment", False), ("south", "de la", False),
    ("south", "queque", False), ("south", "et la le", False), ("south", "enier", False),
    ("east", "und", False), ("east", "einach", False), ("east", "nicht", False), ("east", "icht", False),
]
LEXICON_SQL = (
    "lex(grp, term, harmless) AS (VALUES "
    + ", ".join(f"('{g}', '{t}', {str(h).lower()})" for g, t, h in LEXICON)
    + ")"
)


def bigram_vocab_docs(spark, sf_dir):
    docs = documents(spark, sf_dir, "text")
    tokens = T.preprocess(T.strip_accents(F.col("text")), normalize=False)
    return docs.select("doc_id", tokens.alias("words")).select("doc_id", T.ngrams_1_2(F.col("words")).alias("tokens"))


def corpus_vocab(docs):
    return vocab.build_vocab(docs, MIN_DF, MAX_DF, MAX_FEATURES)


def corpus_words(docs) -> list[str]:
    return vocab.pin(corpus_vocab(docs))[1]


@query(
    "build_vocab",
    f"WITH tok0 AS (SELECT doc_id, {sql.kept_tokens('strip_accents(text)')} AS w FROM documents), "
    "tok AS (SELECT doc_id, list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS tokens FROM tok0), "
    f"words AS (SELECT doc_id, unnest(tokens) AS term FROM tok), {sql.COUNTS}, {sql.STATS}, "
    f"{sql.vocab(5, 0.5, 2000)} SELECT term_id, term, df, cf FROM vocab",
)
def build_vocab(spark, sf_dir):
    return vocab.build_vocab(bigram_vocab_docs(spark, sf_dir), min_df=5, max_df=0.5, max_features=2000)


ALL_TERMS = "all_terms AS (SELECT row_number() OVER (ORDER BY term) - 1 AS term_id, term, df, cf FROM stats)"
ALL_BASE = (
    f"WITH tok0 AS (SELECT doc_id, {sql.kept_tokens('strip_accents(text)')} AS w FROM documents), "
    "tok AS (SELECT doc_id, list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS tokens FROM tok0), "
    f"words AS (SELECT doc_id, unnest(tokens) AS term FROM tok), {sql.COUNTS}, {sql.STATS}, {ALL_TERMS}"
)


@query("vocab_all_terms", f"{ALL_BASE} SELECT term_id, term, df, cf FROM all_terms")
def vocab_all_terms(spark, sf_dir):
    """Every word and pair of the corpus, numbered range by range."""
    stats = vocab.pinned_stats(bigram_vocab_docs(spark, sf_dir))
    return vocab.dense_ids(stats, rows_per_piece=50_000).select("term_id", "term", "df", "cf")


@query("bow_all_terms", f"{ALL_BASE} SELECT doc_id, term_id, cnt FROM counts JOIN all_terms USING (term)")
def bow_all_terms(spark, sf_dir):
    """Counts against that vocabulary, joined by term."""
    docs = bigram_vocab_docs(spark, sf_dir)
    return vocab.bow(docs, vocab.dense_ids(vocab.pinned_stats(docs), rows_per_piece=50_000))


@query("filter_extremes", f"{BASE}, {sql.vocab(15, 0.5, 1500, order='df')} SELECT term_id, term, df, cf FROM vocab")
def filter_extremes(spark, sf_dir):
    return vocab.filter_extremes(preprocessed(spark, sf_dir), no_below=15, no_above=0.5, keep_n=1500)


EXTRA = ["thention", "newcoinedterm", "andthe", "newcoinedterm"]
EXTENDED = (
    f"{VOCAB}, extra AS (SELECT term, min(p) AS p FROM (VALUES "
    + ", ".join(f"('{t}', {i})" for i, t in enumerate(EXTRA))
    + ") x(term, p) WHERE term NOT IN (SELECT term FROM vocab) GROUP BY term), "
    "vocab2 AS (SELECT term_id, term FROM vocab UNION ALL SELECT (SELECT count(*) FROM vocab) "
    "+ row_number() OVER (ORDER BY p) - 1, term FROM extra)"
)


@query("load_vocab", f"{BASE}, {EXTENDED} SELECT term_id, term FROM vocab2")
def load_vocab(spark, sf_dir):
    """A saved vocabulary read back, with extra terms appended."""
    path = scratch_path(spark, "vocab")
    sinks.write_vocab(corpus_vocab(preprocessed(spark, sf_dir)), path)
    return vocab.extend_vocab(spark.read.parquet(path), EXTRA)


@query(
    "doc2bow", f"{BASE}, {VOCAB} SELECT doc_id, term_id, cnt FROM counts JOIN vocab USING (term)"
)
def doc2bow(spark, sf_dir):
    docs = preprocessed(spark, sf_dir)
    return vocab.doc2bow(docs, corpus_words(docs))


MATRIX = (
    "bow AS (SELECT doc_id, term_id, cnt FROM counts JOIN {vocab} USING (term)) "
    "SELECT doc_id, term_id, cnt FROM documents LEFT JOIN bow USING (doc_id)"
)


@query("dtm_fixed_vocab", f"{BASE}, {VOCAB}, " + MATRIX.format(vocab="vocab"))
def dtm_fixed_vocab(spark, sf_dir):
    docs = preprocessed(spark, sf_dir)
    return vocab.doc_term_matrix(docs, corpus_words(docs))


@query("vocab_plus_terms", f"{BASE}, {EXTENDED}, " + MATRIX.format(vocab="vocab2"))
def vocab_plus_terms(spark, sf_dir):
    docs = preprocessed(spark, sf_dir)
    extended = vocab.extend_vocab(corpus_vocab(docs), EXTRA)
    return vocab.doc_term_matrix(docs, vocab.pin(extended)[1])


SMOOTH = f"ln((1.0 + {sql.N_DOCS}) / (1.0 + df)) + 1"
TFIDF = (
    f"w AS (SELECT doc_id, term, cnt * ({SMOOTH}) AS v FROM counts JOIN stats USING (term)), "
    "tfidf AS (SELECT doc_id, term, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS tfidf FROM w)"
)


@query("tfidf_smooth", f"{BASE}, {TFIDF} SELECT doc_id, term, round(tfidf, 6) AS tfidf FROM tfidf")
def tfidf_smooth(spark, sf_dir):
    weights = vocab.tfidf_smooth(preprocessed(spark, sf_dir))
    return weights.withColumn("tfidf", F.round("tfidf", 6))


@query(
    "tfidf_gensim",
    f"{BASE}, w AS (SELECT doc_id, term, cnt * log2(CAST({sql.N_DOCS} AS DOUBLE) / df) AS v "
    "FROM counts JOIN stats USING (term)), n AS (SELECT doc_id, term, "
    "v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS v FROM w) "
    "SELECT doc_id, term, round(v, 6) AS tfidf FROM n WHERE abs(v) > 1e-12",
)
def tfidf_gensim(spark, sf_dir):
    weights = vocab.tfidf_log2(preprocessed(spark, sf_dir))
    return weights.withColumn("tfidf", F.round("tfidf", 6))


@query(
    "tfidf_two_step",
    f"{BASE}, {VOCAB}, w AS (SELECT doc_id, term_id, cnt * ({SMOOTH}) AS v FROM counts JOIN vocab USING (term)) "
    "SELECT doc_id, term_id, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM w",
)
def tfidf_two_step(spark, sf_dir):
    docs = preprocessed(spark, sf_dir)
    terms, words = vocab.pin(corpus_vocab(docs))
    bow = vocab.doc2bow(docs, words)
    n_docs = docs.agg(F.count(F.lit(1)).alias("n"))
    return vocab.tfidf_from_bow(bow, terms, n_docs).withColumn("tfidf", F.round("tfidf", 6))


@query(
    "l2_normalize",
    f"{BASE} SELECT doc_id, term, round(cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY doc_id)), 6) AS weight FROM counts",
)
def l2_normalize(spark, sf_dir):
    counts = vocab.term_counts(preprocessed(spark, sf_dir)).withColumn("weight", F.col("cnt").cast("double"))
    return vocab.l2_normalize(counts, "weight").select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(
    "matrix_shape",
    f"{BASE} SELECT {sql.N_DOCS} AS n_rows, count(DISTINCT term) AS n_cols, count(*) AS nnz FROM counts",
)
def matrix_shape(spark, sf_dir):
    docs = preprocessed(spark, sf_dir)
    return vocab.matrix_shape(vocab.term_counts(docs), docs)


# --- corpus measurements


@query("term_totals", f"{BASE} SELECT term, cf, df FROM stats ORDER BY cf DESC, term")
def term_totals(spark, sf_dir):
    return vocab.term_stats(preprocessed(spark, sf_dir)).orderBy(F.desc("cf"), "term")


GROWTH = [1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0]


@query(
    "vocab_growth",
    f"{BASE}, ranked AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents), "
    "firsts AS (SELECT term, min(r) AS r FROM counts JOIN ranked USING (doc_id) GROUP BY term), "
    "sizes AS (SELECT CAST(floor((SELECT count(*) FROM documents) * f) AS BIGINT) AS n_docs FROM (VALUES "
    + ", ".join(f"({f})" for f in GROWTH)
    + ") x(f)) SELECT n_docs, (SELECT count(*) FROM firsts WHERE r <= n_docs) AS n_terms FROM sizes",
)
def vocab_growth(spark, sf_dir):
    return measure.vocab_growth(preprocessed(spark, sf_dir), GROWTH)


EDGES = measure.OCCURRENCE_BINS


@query(
    "occurrence_hist",
    f"{BASE} SELECT CAST(b AS INTEGER) AS bin, CAST(lo AS DOUBLE) AS low, CAST(hi AS DOUBLE) AS high, "
    "(SELECT count(*) FROM stats WHERE cf >= lo AND (cf < hi OR (b = 4 AND cf = hi))) AS n_terms FROM (VALUES "
    + ", ".join(f"({i}, {EDGES[i]}, {EDGES[i + 1]})" for i in range(len(EDGES) - 1))
    + ") x(b, lo, hi) UNION ALL SELECT "
    + f"{len(EDGES) - 1}, {EDGES[-1]}, NULL, (SELECT count(*) FROM stats WHERE cf > {EDGES[-1]})",
)
def occurrence_hist(spark, sf_dir):
    return measure.occurrence_hist(vocab.term_stats(preprocessed(spark, sf_dir)))


@query(
    "occurrence_thresholds",
    f"{BASE} SELECT count(*) FILTER (cf = 1) AS n_once, count(*) FILTER (cf > 10) AS n_above, "
    "count(*) FILTER (cf <= 10) AS n_up_to FROM stats",
)
def occurrence_thresholds(spark, sf_dir):
    return measure.occurrence_thresholds(vocab.term_stats(preprocessed(spark, sf_dir)))


@query(
    "occurrence_ratio_curve",
    f"{BASE} SELECT i, round(count(*) FILTER (cf < i) / nullif(count(*) FILTER (cf >= i), 0), 6) AS ratio "
    "FROM range(100) r(i), stats GROUP BY i",
)
def occurrence_ratio_curve(spark, sf_dir):
    curve = measure.occurrence_ratio_curve(vocab.term_stats(preprocessed(spark, sf_dir)))
    return curve.withColumn("ratio", F.round("ratio", 6))


@query("duplicate_count", "SELECT count(*) - count(DISTINCT text) AS n_duplicates FROM documents")
def duplicate_count(spark, sf_dir):
    return measure.duplicate_count(table(spark, sf_dir, "documents"), F.col("text"))


@query(
    "duplicate_vectors",
    f"{BASE}, v AS (SELECT doc_id, string_agg(term || ':' || cnt, '|' ORDER BY term) AS k FROM documents "
    "LEFT JOIN counts USING (doc_id) GROUP BY doc_id) "
    "SELECT count(*) - count(DISTINCT coalesce(k, '')) AS n_duplicates FROM v",
)
def duplicate_vectors(spark, sf_dir):
    """Documents with the same bag of words: the sorted token list is the same key."""
    docs = preprocessed(spark, sf_dir)
    return measure.duplicate_count(docs, F.array_join(F.sort_array("tokens"), "|"))


@query(
    "hist2d",
    f"WITH {PLANE}, "
    "b AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM p) "
    "SELECT CAST(least(floor((x - x0) / (x1 - x0) * 100), 99) AS BIGINT) AS x_bin, "
    "CAST(least(floor((y - y0) / (y1 - y0) * 100), 99) AS BIGINT) AS y_bin, count(*) AS n FROM p, b GROUP BY ALL",
)
def hist2d(spark, sf_dir):
    return measure.hist2d(plane(spark, sf_dir), "x", "y", 100)


# --- search

SEARCH = "ndention thereon erinsh"


@query(
    "document_search",
    f"{BASE}, {TFIDF}, q0 AS (SELECT unnest(regexp_extract_all('{SEARCH}', '[a-z]+')) AS term), "
    "q1 AS (SELECT term, count(*) AS cnt FROM q0 GROUP BY term), "
    f"q2 AS (SELECT term, cnt * ({SMOOTH}) AS v FROM q1 JOIN stats USING (term)), "
    "q AS (SELECT term, v / sqrt(sum(v * v) OVER ()) AS qv FROM q2) "
    "SELECT doc_id, text, round(sum(tfidf * qv), 6) AS similarity FROM tfidf JOIN q USING (term) "
    "JOIN documents USING (doc_id) GROUP BY doc_id, text ORDER BY round(sum(tfidf * qv), 9) DESC, doc_id LIMIT 10",
)
def document_search(spark, sf_dir):
    docs = preprocessed(spark, sf_dir, "text")
    hits = search(docs, SEARCH.split(), top_n=10)
    return hits.withColumn("similarity", F.round("similarity", 6))


SECOND_SEARCH = "thereon queque nicht nicht"


@query(
    "indexed_search",
    f"{BASE}, {TFIDF}, q0 AS (SELECT 0 AS search, unnest(regexp_extract_all('{SEARCH}', '[a-z]+')) AS term "
    f"UNION ALL SELECT 1, unnest(regexp_extract_all('{SECOND_SEARCH}', '[a-z]+'))), "
    "q1 AS (SELECT search, term, count(*) AS cnt FROM q0 GROUP BY ALL), "
    f"q2 AS (SELECT search, term, cnt * ({SMOOTH}) AS v FROM q1 JOIN stats USING (term)), "
    "q AS (SELECT search, term, v / sqrt(sum(v * v) OVER (PARTITION BY search)) AS qv FROM q2), "
    "s AS (SELECT search, doc_id, sum(tfidf * qv) AS x FROM tfidf JOIN q USING (term) GROUP BY ALL) "
    "SELECT search, doc_id, round(x, 6) AS similarity FROM s "
    "QUALIFY row_number() OVER (PARTITION BY search ORDER BY round(x, 9) DESC, doc_id) <= 10",
)
def indexed_search(spark, sf_dir):
    """Two searches of one saved index."""
    path = scratch_path(spark, "search-index")
    build_index(preprocessed(spark, sf_dir), path)
    index = SearchIndex(spark, path)
    hits = [index.search(words.split(), top_n=10).withColumn("search", F.lit(i)) for i, words in enumerate((SEARCH, SECOND_SEARCH))]
    return hits[0].unionByName(hits[1]).select("search", "doc_id", F.round("similarity", 6).alias("similarity"))


# --- lexicons


def toy_lexicon(spark):
    return spark.createDataFrame(LEXICON, "grp string, term string, harmless_meaning boolean")


@query("write_lexicon", f"WITH {LEXICON_SQL}, used AS (SELECT DISTINCT unnest({sql.raw_tokens()}) AS term FROM documents) "
       "SELECT grp, lex.term, harmless FROM lex SEMI JOIN used ON used.term = split_part(lex.term, ' ', 1)")  # fmt: skip
def write_lexicon(spark, sf_dir):
    """The lexicon's terms whose first word the corpus uses, as JSON lines and back."""
    docs = documents(spark, sf_dir, "text").select(T.tokenize(F.col("text")).alias("tokens"))
    used = vocab.each_token(docs).select(F.col("term").alias("first")).distinct()
    found = toy_lexicon(spark).withColumn("first", F.split("term", " ")[0]).join(used, "first", "left_semi").drop("first")
    path = scratch_path(spark, "lexicon")
    sinks.write_lexicon(found, path)
    saved = spark.read.json(path, schema="grp string, term string, harmless_meaning boolean")
    return saved.select("grp", "term", F.col("harmless_meaning").alias("harmless"))


IN_CORPUS = (
    f"{LEXICON_SQL}, raw AS (SELECT doc_id, {sql.raw_tokens()} AS t FROM documents), grams AS ("
    "SELECT doc_id, unnest(list_concat(t, [t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))], "
    "[t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] FOR i IN range(1, len(t) - 1)])) AS term FROM raw), "
    "hits AS (SELECT DISTINCT doc_id, grp FROM grams JOIN lex USING (term) WHERE NOT harmless)"
)


@query(
    "lexicon_build",
    f"WITH {LEXICON_SQL}, used AS (SELECT DISTINCT unnest({sql.raw_tokens()}) AS term FROM documents) "
    "SELECT grp, count(*) AS n_terms, string_agg(term, '|' ORDER BY term) AS terms FROM lex "
    "SEMI JOIN used ON used.term = split_part(lex.term, ' ', 1) WHERE NOT harmless GROUP BY grp",
)
def lexicon_build(spark, sf_dir):
    """Terms without a harmless meaning by group, of those whose first word the corpus uses."""
    docs = documents(spark, sf_dir, "text").select("doc_id", T.tokenize(F.col("text")).alias("tokens"))
    return lexicon.build(lexicon.in_use(toy_lexicon(spark), docs))


@query(
    "lexicon_min_group",
    f"WITH {IN_CORPUS} SELECT grp, term, n_docs FROM (SELECT grp, term, count(DISTINCT doc_id) AS n_docs "
    "FROM lex LEFT JOIN grams USING (term) WHERE NOT harmless AND grp IN "
    "(SELECT grp FROM lex WHERE NOT harmless GROUP BY grp HAVING count(*) >= 5) GROUP BY grp, term)",
)
def lexicon_min_group(spark, sf_dir):
    """Groups with at least five usable terms, with the documents each term occurs in."""
    docs = documents(spark, sf_dir, "text").select("doc_id", T.tokenize(F.col("text")).alias("tokens"))
    terms = lexicon.min_group(lexicon.usable(toy_lexicon(spark)), 5)
    return lexicon.term_document_counts(docs, terms)


@query(
    "lexicon_in_docs",
    f"WITH {IN_CORPUS} SELECT doc_id, grp, quality, toxic FROM hits LEFT JOIN labels USING (doc_id)",
)
def lexicon_in_docs(spark, sf_dir):
    docs = documents(spark, sf_dir, "text").select("doc_id", T.tokenize(F.col("text")).alias("tokens"))
    hits = lexicon.in_docs(docs, lexicon.usable(toy_lexicon(spark)))
    return hits.join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "grp", "quality", "toxic")


@query(
    "lexicon_report",
    f"WITH {IN_CORPUS} SELECT grp, count(*) AS n_docs, count(toxic) AS n_labelled, "
    "CAST(coalesce(sum(toxic), 0) AS BIGINT) AS n_toxic FROM hits LEFT JOIN labels USING (doc_id) GROUP BY grp",
)
def lexicon_report(spark, sf_dir):
    """Documents hit per group, against the toxicity labels."""
    return (
        lexicon_in_docs(spark, sf_dir)
        .groupBy("grp")
        .agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.count("toxic").alias("n_labelled"),
            F.coalesce(F.sum("toxic"), F.lit(0)).alias("n_toxic"),
        )
    )
