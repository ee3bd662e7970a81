import pytest
from pyspark.sql import functions as F

from murmuration.plans import all_queries
from murmuration.streaming import jobs


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    words = ["harbour", "sailor", "anchor", "vessel"]
    rows = [(i, f"{words[i % 4]} {words[i % 4]} {words[i // 4 % 4] if i % 3 else ''}", "en", "a", 10) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3, "doc_id").write.parquet(f"{path}/documents.parquet")
    return path


def test_a_folder_of_files_is_streamed_whole(spark, folder):
    for limit in (None, 1):
        stream = jobs.stream_table(spark, folder, "documents", limit)
        seen = []
        query = stream.writeStream.foreachBatch(lambda batch, _: seen.append(batch.count())).trigger(availableNow=True).start()
        query.awaitTermination()
        assert sum(seen) == 60 and len(seen) == (1 if limit is None else 3)


def test_streamed_moments_of_a_folder_are_the_means(spark, folder):
    means = [sorted(map(tuple, all_queries.QUERIES[q](spark, folder).collect())) for q in ("first_moment", "stream_moments")]
    assert means[0] == means[1] and len(means[0]) > 1


def test_one_file_is_streamed_as_before(spark, folder, tmp_path):
    parts = spark.read.parquet(f"{folder}/documents.parquet").coalesce(1)
    parts.write.parquet(str(tmp_path / "one"))
    next((tmp_path / "one").glob("part-*")).rename(tmp_path / "documents.parquet")
    stream = jobs.stream_table(spark, str(tmp_path), "documents").select(F.col("doc_id"))
    seen = []
    stream.writeStream.foreachBatch(lambda batch, _: seen.append(batch.count())).trigger(availableNow=True).start().awaitTermination()
    assert seen == [60]
