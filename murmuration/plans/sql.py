"""Pieces shared by the SQL texts: the tokeniser and the standard tables."""

from __future__ import annotations

from murmuration.functions.text import STOP_WORDS, SUFFIX_RULES

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
RAW_TOKENS = (
    r"list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{Nl}}\p{{No}}_]+'), "
    r"lambda t: length(t) BETWEEN 2 AND 15 AND NOT starts_with(t, '_'))"
)


def raw_tokens(text: str = "text") -> str:
    return RAW_TOKENS.format(text=text)


def kept_tokens(text: str = "text") -> str:
    """Stop words out, then tokens of three characters or fewer out."""
    return f"list_filter({raw_tokens(text)}, lambda t: t NOT IN ({STOPS}) AND length(t) > 3)"


def suffix_sql(expr: str) -> str:
    for pattern, replacement in SUFFIX_RULES:
        expr = f"regexp_replace({expr}, '{pattern}', '{replacement.replace('$1', chr(92) + '1')}')"
    return expr


def normalized_tokens(text: str = "text") -> str:
    rules = suffix_sql("t")
    return f"list_transform({kept_tokens(text)}, lambda t: regexp_replace({rules}, 'http\\S+', 'http', 'g'))"


# tok(doc_id, lang, source, tokens): the default tokeniser without normalisation
TOK = f"tok AS (SELECT doc_id, lang, source, {kept_tokens()} AS tokens FROM documents)"
WORDS = "words AS (SELECT doc_id, lang, source, unnest(tokens) AS term FROM tok)"
COUNTS = "counts AS (SELECT doc_id, term, count(*) AS cnt FROM words GROUP BY ALL)"
STATS = "stats AS (SELECT term, CAST(sum(cnt) AS BIGINT) AS cf, count(*) AS df FROM counts GROUP BY term)"
BASE = f"WITH {TOK}, {WORDS}, {COUNTS}, {STATS}"
N_DOCS = "(SELECT count(*) FROM documents)"


def vocab(min_df: int, max_df: float, max_features: int, stats: str = "stats", order: str = "cf") -> str:
    return (
        f"vocab AS (SELECT row_number() OVER (ORDER BY term) - 1 AS term_id, term, df, cf FROM "
        f"(SELECT * FROM {stats} WHERE df >= {min_df} AND df <= {max_df} * {N_DOCS} "
        f"ORDER BY {order} DESC, term LIMIT {max_features}))"
    )
