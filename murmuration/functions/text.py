"""Text functions, all ``Column -> Column``, so they stay inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a token, and its length bounds.
TOKEN_PATTERN = r"[\p{L}\p{Nl}\p{No}_]+"
TOKEN_MIN, TOKEN_MAX = 2, 15

# The default English stop words. Every caller may pass another list.
STOP_WORDS = (
    "a about above after again against all also am an and any are as at be because been before "
    "being below between both but by can cannot could did do does doing down during each few for "
    "from further had has have having he her here hers herself him himself his how i if in into is "
    "it its itself just me more most my myself no nor not now of off on once only or other our ours "
    "ourselves out over own same she should so some such than that the their theirs them themselves "
    "then there these they this those through to too under until up very was we were what when "
    "where which while who whom why will with would you your yours yourself yourselves"
).split()


def accent_table() -> tuple[str, str]:
    """(from, to) strings for ``translate``: letters up to U+024F, U+1E00..U+1EFF whose compatibility
    decomposition is one ASCII letter plus marks, followed by the combining marks, which vanish."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFKD", chr(code))
        base = [c for c in parts if not unicodedata.combining(c)]
        if len(base) == 1 and len(parts) > 1 and base[0].isascii():
            source.append(chr(code))
            target.append(base[0])
    marks = [chr(code) for code in range(0x300, 0x370)]
    return "".join(source + marks), "".join(target)


_ACCENTS = accent_table()


def strip_accents(text: Column) -> Column:
    return F.translate(text, *_ACCENTS)


def strip_accents_ascii(text: Column) -> Column:
    """Accents removed, then every character that is still outside ASCII dropped."""
    return F.regexp_replace(strip_accents(text), r"[^\x00-\x7F]", "")


def strip_handles(text: Column) -> Column:
    no_handles = F.regexp_replace(text, "@[A-Za-z0-9_]+", "")
    return F.regexp_replace(no_handles, "#[A-Za-z0-9_]+", "")


def alpha_only(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^a-zA-Z]", " "))


def mask_urls(text: Column) -> Column:
    return F.regexp_replace(text, r"http\S+", "http")


def strip_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]+", "")


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters, 2 to 15 long, none starting with an underscore."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.filter(
        runs, lambda t: F.length(t).between(TOKEN_MIN, TOKEN_MAX) & ~F.startswith(t, F.lit("_"))
    )


def tokenize_words(text: Column) -> Column:
    """The plain vectoriser's analyser: runs of two or more word characters, digits included."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def drop_stop_words(tokens: Column, stop_words=STOP_WORDS) -> Column:
    """Keeps repeats of the remaining tokens, which ``array_except`` would not."""
    words = [str(w) for w in stop_words]
    return F.filter(tokens, lambda t: ~t.isin(words)) if words else tokens


def min_length(tokens: Column, longer_than: int = 3) -> Column:
    return F.filter(tokens, lambda t: F.length(t) > longer_than)


# Fixed values: (pattern, replacement) suffix rules, applied in order, standing in for a lemmatiser
# and stemmer. Group references use Spark's form.
SUFFIX_RULES = (
    ("sses$", "ss"),
    ("ies$", "i"),
    ("([^s])s$", "$1"),
    ("^(.{3,})(ingly|edly|ing|ed|ly)$", "$1"),
    ("^(.{3,})(ation|ment|ness)$", "$1"),
)


def apply_suffix_rules(token: Column, rules=SUFFIX_RULES) -> Column:
    for pattern, replacement in rules:
        token = F.regexp_replace(token, pattern, replacement)
    return token


def normalize_tokens(tokens: Column, rules=SUFFIX_RULES) -> Column:
    """Each token through the suffix rules, then the URL mask."""
    return F.transform(tokens, lambda t: mask_urls(apply_suffix_rules(t, rules)))


def join_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def bigrams(tokens: Column) -> Column:
    pairs = F.zip_with(
        tokens,
        F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.array_compact(pairs)


def ngrams_1_2(tokens: Column) -> Column:
    """Single tokens, then neighbouring pairs joined by a space."""
    return F.concat(tokens, bigrams(tokens))


def preprocess(text: Column, stop_words=STOP_WORDS, longer_than: int = 3, normalize: bool = True) -> Column:
    """The pipeline's default tokeniser: tokens, stop words out, short ones out, normalised."""
    words = [str(w) for w in stop_words]
    shortest = max(TOKEN_MIN, longer_than + 1)

    def wanted(t: Column) -> Column:  # the three filters above as one pass over the tokens
        fits = F.length(t).between(shortest, TOKEN_MAX) & ~F.startswith(t, F.lit("_"))
        return fits & ~t.isin(words) if words else fits

    tokens = F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0)), wanted)
    return normalize_tokens(tokens) if normalize else tokens
