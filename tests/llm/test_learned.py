"""Language and quality on held-out documents, and what never changes a score."""

import random

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import documents, odd_texts
from pyspark.sql import functions as F

from murmuration.llm import langid, quality
from murmuration.llm.features import labelled_sample
from murmuration.plans.registry import table

SF = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    docs = table(spark, SF, "documents")
    found = langid.language_id(docs).where("held_out").join(docs, "doc_id").collect()
    assert len(found) > 200
    assert sum(r.lang_pred == r.lang for r in found) >= 0.98 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_cases(spark):
    letters = {"en": "the of and tion ing ", "de": "der die und sch ung ", "fr": "le de les eau ment ", "es": "el de los ción ado ", "xx": "qqq zzz kkk vvv "}
    rng = random.Random(2)
    rows = [(k, "".join(rng.choice(v.split()) + rng.choice(["", " "]) for _ in range(60))) for k, v in letters.items() for _ in range(40)]
    model = langid.fit(pa.table({"label": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    assert model.families == ["germanic", "romance", "xx"] and model.pairs == [(0, 1), (2, 3)]
    texts = [None, "", "12 %% !!", "the and of thing", "漢字", "der und die sch", "qqq zzz"]
    docs = documents(spark, texts, extra=["lang_pred", "score"])
    found = [(r.lang_pred, r.score > 0) for r in langid.predict(docs, model).orderBy("doc_id").collect()]
    assert [f[0] for f in found[:4]] == ["und", "und", "und", "en"] and found[4][0] != "und" and [f[0] for f in found[5:]] == ["de", "xx"]
    assert [f[1] for f in found[:3]] == [False] * 3
    assert langid.predict(documents(spark, []), model).collect() == []


def test_without_labels_all_is_undetermined(spark):
    found = langid.language_id(documents(spark, ["a", None], [1, None]).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in found} == {("und", 0.0)} and {r.held_out for r in found} <= {False, True, None}
    assert langid.language_id(documents(spark, [])).collect() == []


def test_one_language_only():
    model = langid.fit(pa.table({"label": ["en"] * 3, "text": ["the and", "of the", "and so"]}))
    data = np.frombuffer(b"whatever", np.uint8)
    language, score = model.predict(data, np.array([0, len(data)]))
    assert model.languages[language[0]] == "en" and 0 < score[0] <= 1


def test_quality_of_held_out_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    found = quality.quality(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert len(found) > 50
    assert sum(r.predicted == r.quality for r in found) >= 0.95 * len(found)


def test_quality_cases(spark):
    rng = random.Random(4)
    rows = [("1", " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(30))) for _ in range(30)]
    rows += [("0", " ".join(rng.choice(["%%%", "###", "$$$"]) for _ in range(30))) for _ in range(10)]
    model = quality.fit(pa.table({"label": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    texts = ["alpha gamma", "%%% ### $$$", None, "", *odd_texts()]
    scores = [r.score for r in quality.score(documents(spark, texts, extra=["score"]), model).orderBy("doc_id").collect()]
    assert scores[0] > 0.8 and scores[1] < 0.2 and scores[2] == scores[3]
    again = [r.score for r in quality.score(documents(spark, texts).repartition(5), model).orderBy("doc_id").collect()]
    assert scores == again
    assert quality.score(documents(spark, []), model).collect() == []


def test_without_labels_every_score_is_half(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = quality.quality(documents(spark, ["a", None], [None, 1]), empty).collect()
    assert [r.score for r in found] == [0.5, 0.5] and {r.predicted for r in found} == {1}


def test_every_label_is_sampled(spark):
    rows = [(i, f"l{i % 70}", f"text {i}") for i in range(210)] + [(300, "large", "x" * 50), (301, "large", "y" * 40)]
    table = spark.createDataFrame(rows, "id long, lang string, text string")
    found = labelled_sample(table, "id", "lang", "text", 10, 30).to_pylist()
    assert {r["label"] for r in found} == {r[1] for r in rows}
    assert [r["text"] for r in found if r["label"] == "large"] == ["y" * 40]
    assert len(found) == 211
