"""What the plans must look like."""

import re

import pytest
from pyspark.sql import functions as F

from murmuration.operators import sampling, timechunks, vocab
from murmuration.plans import all_queries
from murmuration.plans.registry import table
from murmuration.plans.text_queries import preprocessed

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_language_filter_reaches_the_scan(spark):
    text = plan(all_queries.QUERIES["english_only"](spark, SF_DIR))
    assert "EqualTo(lang,en)" in text


def test_unused_columns_are_not_read(spark):
    text = plan(sampling.top_per_group(table(spark, SF_DIR, "embeddings").select("vec_id", "label"), "label", [F.col("vec_id")], 3))
    assert "embedding" not in re.search("ReadSchema: (.*)", text).group(1)
    assert "WindowGroupLimit" in text


def test_time_probe_reaches_the_scan(spark):
    events = table(spark, SF_DIR, "events")
    rows = events.where(F.col("ts") >= timechunks._time(events, "ts", "1704067200000000L"))
    assert "GreaterThanOrEqual(ts,2024-01-01T00:00)" in plan(rows)


@pytest.mark.parametrize("build", [vocab.term_counts, vocab.term_stats])
def test_text_is_tokenised_once(spark, build):
    docs = preprocessed(spark, SF_DIR)
    text = build(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract_all") == 1


def test_counting_known_words_moves_nothing(spark):
    docs = table(spark, SF_DIR, "documents").select("doc_id", F.split("text", " ").alias("tokens"))
    assert "Exchange" not in plan(vocab.doc_vectors(docs, ["the", "and"]))


def test_day_files_are_pruned(spark, tmp_path):
    from murmuration.sources import posts

    rows = spark.range(40).select("id", F.expr("date_add(DATE '2024-01-01', int(id % 20))").alias("day"))
    rows.write.partitionBy("day").parquet(str(tmp_path / "t"))
    chosen = posts.select_files_by_day(spark.read.parquet(str(tmp_path / "t")), ["2024-01-03"])
    assert chosen.count() == 2
    assert len(chosen.select("_metadata.file_path").distinct().collect()) <= 2


def test_lda_over_weights_makes_as_many_passes_as_over_counts(spark, tmp_path, monkeypatch):
    from pyspark.ml.clustering import LDA

    words = ["garden", "flower", "engine", "wheels"]
    rows = [(i, " ".join(words[(i + j) % 4] for j in range(1 + i % 2)), "en", "s", 0) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    made, real = [], LDA.fit
    monkeypatch.setattr(LDA, "fit", lambda self, df: made.append((self.getMaxIter(), self.getSubsamplingRate(), self.getK())) or real(self, df))
    for name in ("lda_online", "lda_tfidf"):
        assert all_queries.QUERIES[name](spark, str(tmp_path)).count() == 40 * 14
    assert made == [(25, 0.2, 14)] * 2
