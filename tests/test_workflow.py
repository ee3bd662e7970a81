import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration import workflow
from murmuration.functions import text as T
from murmuration.operators import lexicon, search, tensor_lda, vocab

THEMES = {
    "sea": "harbour sailor anchor tide vessel captain compass island".split(),
    "food": "kitchen pepper onion butter flour oven recipe garlic".split(),
}


def raw_post(i, day):
    theme = list(THEMES)[i % 2]
    rng = np.random.default_rng(i)
    words = " ".join(rng.choice(THEMES[theme], 9))
    return json.dumps({"created_at": f"Thu Apr {day:02d} 06:45:{i % 60:02d} +0000 2020", "id": i, "lang": "en", "text": words})


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for day in range(1, 21):
        lines = [raw_post(day * 100 + i, day) for i in range(30)]
        (folder / f"p-2020-04-{day:02d}.json").write_text("".join(lines).replace('{"created_at": ', '{"created_at":'))
    return str(folder)


def test_archive_and_weeks(spark, raw, tmp_path):
    clean = workflow.clean_archive(spark, raw, str(tmp_path / "clean"))
    assert clean.count() == 600
    manifest = workflow.weekly_archive(clean, str(tmp_path / "weeks")).orderBy("chunk_id").collect()
    assert sum(m.n for m in manifest) == 600 and len(manifest) == 3


def test_sample_of_each_file(spark, raw):
    sample = workflow.load_posts(spark, raw, 0.25, seed=3)
    assert {r["count"] for r in sample.groupBy("source").count().collect()} == {7}
    assert sample.where(F.size("tokens") > 9).isEmpty()


def test_two_themes_come_apart(spark, raw):
    docs = workflow.load_posts(spark, raw, tokenizer=lambda c: T.preprocess(c, normalize=False))
    params = tensor_lda.TopicParams(1, 0.1, 400, 15000, 0.01, init="scaled")
    run = workflow.learn_topics(docs, params, min_df=2, max_df=0.9)
    assert run.table.agg(F.sum("p")).first()[0] == pytest.approx(1.0)
    assert run.weights().first().alpha == pytest.approx(0.1)
    assert run.top_words(5).count() == 5
    assert run.doc_topics().count() == 600
    score = workflow.lda_coherence(docs, 2, passes=2, min_df=2, max_df=0.9, top=5).first().coherence
    assert -30 < score < 1


def test_search_finds_the_theme(spark, raw):
    docs = workflow.load_posts(spark, raw, tokenizer=lambda c: T.preprocess(c, normalize=False))
    hits = search.document_search(docs, ["garlic", "butter"], top_n=5).collect()
    assert len(hits) == 5 and all(r.doc_id % 2 == 1 for r in hits)
    saved = vocab.tfidf_smooth(docs)
    again = search.document_search(docs, ["garlic", "butter"], top_n=5, weights=saved).collect()
    assert {r.doc_id for r in again} == {r.doc_id for r in hits}
    assert search.document_search(docs, ["unheard"], top_n=5).isEmpty()


def test_normalisation_and_accents(spark):
    rows = spark.createDataFrame([("Caught the sailors' passing glasses http://x.y",), ("Ünïcödé façade ﬁt Ærø",)], "text string")
    got = [r[0] for r in rows.select(T.strip_accents(F.col("text"))).collect()]
    assert got[1] == "Unicode facade ﬁt Ærø"
    tokens = rows.select(T.normalize_tokens(T.tokenize(F.col("text"))).alias("t")).collect()[0].t
    assert tokens[:5] == ["caught", "the", "sailor", "pass", "glass"] and "http" in tokens


def test_token_bounds(spark):
    rows = spark.createDataFrame([("_private a ab under_score x2y sixteenletterword fifteenletterwd ²² 12",)], "text string")
    assert rows.select(T.tokenize(F.col("text"))).first()[0] == ["ab", "under_score", "fifteenletterwd", "²²"]


def test_vocabulary_edges(spark):
    docs = spark.createDataFrame(
        [(1, ["b", "a", "a"]), (2, ["a", "c"]), (3, ["c", "d"]), (4, [])], "doc_id long, tokens array<string>"
    )
    words = vocab.build_vocab(docs, min_df=1, max_df=0.5, max_features=3).collect()
    assert [(w.term_id, w.term, w.df, w.cf) for w in words] == [(0, "a", 2, 3), (1, "b", 1, 1), (2, "c", 2, 2)]
    pinned, listed = vocab.pin(vocab.build_vocab(docs, min_df=2, max_df=0.5))
    vectors = {r.doc_id: (r.ids, r.cnts) for r in vocab.doc_vectors(docs, listed).collect()}
    assert vectors == {1: ([0], [2.0]), 2: ([0, 1], [1.0, 1.0]), 3: ([1], [1.0]), 4: ([], [])}
    assert vocab.build_vocab(docs).count() == vocab.filter_extremes(docs, 1, 1.0).count() == 4
    with pytest.raises(ValueError):
        vocab.build_vocab(docs, max_features=10**9)


def test_lexicon_groups(spark):
    words = [("keep", f"w{i}") for i in range(5)] + [("drop", f"v{i}") for i in range(4)]
    frame = spark.createDataFrame(words, "grp string, term string")
    assert {r.grp for r in lexicon.min_group(frame, 5).collect()} == {"keep"}
    docs = spark.createDataFrame([(1, ["w1", "x", "w2", "w3"])], "doc_id long, tokens array<string>")
    phrases = spark.createDataFrame([("g", "x w2"), ("h", "w1 x w2"), ("i", "w1 w2")], "grp string, term string")
    assert {r.grp for r in lexicon.in_docs(docs, phrases).collect()} == {"g", "h"}
