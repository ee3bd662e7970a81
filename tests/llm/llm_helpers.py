"""Small tables with every odd case, shared by the tests of this folder."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghiklmnoprstuvwéñ") for _ in range(rng.randint(1, 9))) for _ in range(n)]


def odd_texts(seed: int = 0) -> list[str | None]:
    """Nulls, empty and blank texts, ties, repeats, copies with edits, shared passages and a very long text."""
    rng = random.Random(seed)
    base = words(rng, 300)
    passage = words(rng, 120)
    texts: list[str | None] = [None, "", " \n\t ", "one", "one", "two words", "Four words are here", "123 456 !!", "aaaa" * 400, "ab" * 900]
    texts += [" ".join(base)] * 3
    for edits in (1, 2, 4, 8, 16, 32, 64):
        copy = list(base)
        for _ in range(edits):
            copy[rng.randrange(len(copy))] = "edited"
        texts.append(" ".join(copy))
    texts += [" ".join(words(rng, 40) + passage + words(rng, 40)) for _ in range(4)]
    texts += [" ".join(words(rng, rng.randint(1, 200))) for _ in range(30)]
    texts.append(" ".join(words(rng, 6000)))
    texts.append(texts[-1] + " tail")
    texts += ["x" * 399, "y" * 400, "y" * 400 + "z", "日本語 テキスト です " * 60, "İstanbul Straße ΑΣ."]
    return texts


def documents(spark, texts, ids=None, extra=None):
    """A documents table; ids count from 0 unless given. ``extra``: names of columns that clash with results."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", f"s{n % 3}", None if t is None else len(t)) for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    df = spark.createDataFrame(rows, DOCUMENTS)
    for name in extra or []:
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("clash"))
    return df


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]
