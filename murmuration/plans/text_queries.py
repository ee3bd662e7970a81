"""Queries over the text functions, filters, samples and row order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.functions import text as T
from murmuration.operators import sampling
from murmuration.operators.vocab import normalize_terms, pinned_stats, term_counts
from murmuration.plans import sql
from murmuration.plans.registry import documents, query, table


def preprocessed(spark, sf_dir: str, *columns: str) -> DataFrame:
    """``(doc_id, ..., tokens)`` with the default tokeniser without suffix rules."""
    docs = documents(spark, sf_dir, "text", *columns)
    return docs.select("doc_id", *columns, T.preprocess(F.col("text"), normalize=False).alias("tokens"))


# --- predicates


@query("english_only", "SELECT doc_id, source, text FROM documents WHERE lang = 'en'")
def english_only(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "source", "text")


@query("phrase_filter", "SELECT doc_id, text FROM documents WHERE contains(lower(text), 'and the')")
def phrase_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.lower("text").contains("and the")).select("doc_id", "text")


SCREENS = {
    "ending": "(Th|th|TH)[a-z]*ing",
    "pair": "(Onhe|onhe|ONHE) ?[a-z]+ed",
    "starred": "ere* (in|on)",
    "accent": "(É|é)[a-z]+tre",
}


@query(
    "regex_screen",
    " UNION ALL ".join(
        f"SELECT '{name}' AS screen, doc_id FROM documents WHERE regexp_matches(text, '{pattern}')"
        for name, pattern in SCREENS.items()
    ),
)
def regex_screen(spark, sf_dir):
    """All screens in one pass over the text."""
    hits = F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in SCREENS.items()])
    docs = documents(spark, sf_dir, "text")
    return docs.select(F.explode(F.array_compact(hits)).alias("screen"), "doc_id")


@query(
    "schema_coverage",
    "SELECT count(*) AS n_rows, count(d.text) AS n_text, count(l.quality) AS n_quality, "
    "count(l.toxic) AS n_toxic, count(l.doc_id) FILTER (d.lang = 'en') AS n_english_labelled "
    "FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def schema_coverage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("text").isNotNull()).alias("n_text"),
        F.count_if(F.col("quality").isNotNull()).alias("n_quality"),
        F.count_if(F.col("toxic").isNotNull()).alias("n_toxic"),
        F.count_if(F.col("quality").isNotNull() & (F.col("lang") == "en")).alias("n_english_labelled"),
    )


# --- text functions


def text_query(name: str, expression, sql_expression: str, columns: str = "documents"):
    @query(name, f"SELECT doc_id, {sql_expression} AS result FROM documents")
    def run(spark, sf_dir):
        return documents(spark, sf_dir, "text").select("doc_id", expression(F.col("text")).alias("result"))

    return run


text_query(
    "strip_handles",
    T.strip_handles,
    "regexp_replace(regexp_replace(text, '@[A-Za-z0-9_]+', '', 'g'), '#[A-Za-z0-9_]+', '', 'g')",
)
text_query("alpha_only", T.alpha_only, "lower(regexp_replace(text, '[^a-zA-Z]', ' ', 'g'))")
text_query("strip_digits", T.strip_digits, "regexp_replace(text, '[0-9]+', '', 'g')")
text_query("strip_accents", T.strip_accents, "strip_accents(text)")
text_query(
    "strip_accents_ascii", T.strip_accents_ascii, r"regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')"
)


@query(
    "url_mask",
    "SELECT page_id, regexp_replace(html, 'http\\S+', 'http', 'g') AS html, "
    "regexp_replace(url, 'http\\S+', 'http', 'g') AS url FROM pages",
)
def url_mask(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        "page_id", T.mask_urls(F.col("html")).alias("html"), T.mask_urls(F.col("url")).alias("url")
    )


text_query("tokenize", lambda c: T.join_tokens(T.tokenize(c)), f"array_to_string({sql.raw_tokens()}, ' ')")
text_query(
    "stop_filter",
    lambda c: T.join_tokens(T.drop_stop_words(T.tokenize(c))),
    f"array_to_string(list_filter({sql.raw_tokens()}, lambda t: t NOT IN ({sql.STOPS})), ' ')",
)
text_query(
    "min_len",
    lambda c: T.join_tokens(T.min_length(T.tokenize(c))),
    f"array_to_string(list_filter({sql.raw_tokens()}, lambda t: length(t) > 3), ' ')",
)
text_query(
    "join_tokens",
    lambda c: T.join_tokens(T.preprocess(c, normalize=False)),
    f"array_to_string({sql.kept_tokens()}, ' ')",
)
text_query(
    "analyzer_stem_only",
    lambda c: T.join_tokens(T.normalize_tokens(T.tokenize_words(T.strip_accents_ascii(c)))),
    "array_to_string(list_transform(regexp_extract_all(lower(regexp_replace(strip_accents(text), "
    r"'[^\x00-\x7F]', '', 'g')), '[\p{L}\p{N}_]{2,}'), lambda t: regexp_replace("
    + sql.suffix_sql("t")
    + r", 'http\S+', 'http', 'g')), ' ')",
)


@query(
    "token_normalize",
    f"SELECT doc_id, array_to_string({sql.normalized_tokens()}, ' ') AS result FROM documents",
)
def token_normalize(spark, sf_dir):
    docs = documents(spark, sf_dir, "text")
    return docs.select("doc_id", T.join_tokens(T.preprocess(F.col("text"))).alias("result"))


@query(
    "token_normalize_table",
    f"WITH {sql.TOK}, {sql.WORDS}, forms AS (SELECT DISTINCT term, left(term, 5) AS norm FROM words) "
    "SELECT doc_id, norm, count(*) AS cnt FROM words JOIN forms USING (term) GROUP BY ALL",
)
def token_normalize_table(spark, sf_dir):
    """Normalisation through a (token, norm) table, here five-letter stems of the corpus's own words."""
    docs = preprocessed(spark, sf_dir)
    stats = pinned_stats(docs)
    forms = stats.select("term", F.substring("term", 1, 5).alias("form")).where(F.length("term") > 5)
    return normalize_terms(term_counts(docs), forms, stats).withColumnRenamed("term", "norm")


@query(
    "ngrams_1_2",
    f"WITH {sql.TOK} SELECT doc_id, array_to_string(list_concat(tokens, "
    "[tokens[i] || ' ' || tokens[i + 1] FOR i IN range(1, len(tokens))]), '|') AS result FROM tok",
)
def ngrams_1_2(spark, sf_dir):
    docs = preprocessed(spark, sf_dir)
    return docs.select("doc_id", F.array_join(T.ngrams_1_2(F.col("tokens")), "|").alias("result"))


# --- samples and order


def h(seed, column="doc_id"):
    return f"md5('{seed}:' || CAST({column} AS VARCHAR))"


@query(
    "sample_per_file",
    f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {h(7)}) "
    "<= floor(0.3 * count(*) OVER (PARTITION BY source))",
)
def sample_per_file(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.sample_per_group(docs, "doc_id", "source", 0.3, seed=7)


@query(
    "sample_global",
    f"SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (ORDER BY {h(1)}) <= floor(0.1 * count(*) OVER ())",
)
def sample_global(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.sample_fraction(docs, "doc_id", 0.1, seed=1)


@query(
    "cap_sample",
    f"SELECT event_id, user_id FROM events QUALIFY row_number() OVER (ORDER BY {h(2, 'event_id')}) <= 1000000",
)
def cap_sample(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    return sampling.sample_cap(events, "event_id", 1_000_000, seed=2)


@query(
    "cap_sample_over",
    f"SELECT event_id, user_id FROM events QUALIFY row_number() OVER (ORDER BY {h(2, 'event_id')}) <= 700",
)
def cap_sample_over(spark, sf_dir):
    """The same sampler when the table is larger than the cap."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    return sampling.sample_cap(events, "event_id", 700, seed=2)


@query(
    "shuffle_restore",
    f"SELECT doc_id, lang, {h(3)} AS position FROM documents ORDER BY doc_id",
)
def shuffle_restore(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.shuffled(docs, "doc_id", seed=3).orderBy("doc_id")


@query(
    "prefix_fraction",
    "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (ORDER BY doc_id) <= floor(0.75 * count(*) OVER ())",
)
def prefix_fraction(spark, sf_dir):
    return sampling.prefix_fraction(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 0.75)


@query(
    "random_row_of_cluster",
    f"SELECT vec_id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY {h(5, 'vec_id')}) = 1",
)
def random_row_of_cluster(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return sampling.one_per_group(vectors, "vec_id", "label", seed=5)
