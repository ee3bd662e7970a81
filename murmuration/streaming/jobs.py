"""Structured Streaming jobs: weekly term counts, and moments that grow batch by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.operators import moments as M
from murmuration.operators.vocab import doc_vectors, each_token


def utc_instant(column: str) -> Column:
    """A zone-free time read as UTC; event time must be an instant, and weeks must not depend on the
    session's zone."""
    micros = f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})"
    return F.expr(f"timestamp_micros({micros})")


def utc_wall_time(column: str) -> Column:
    """The way back from an instant to a zone-free time."""
    return F.expr(f"timestampadd(MICROSECOND, unix_micros({column}), TIMESTAMP_NTZ '1970-01-01 00:00:00')")


def weekly_term_counts(posts: DataFrame, ts: str, tokens: str, late: str = "1 day") -> DataFrame:
    """``(week_start, term, cnt)`` of a stream, final once the watermark has passed the week."""
    words = each_token(posts.withWatermark(ts, late), ts, tokens=tokens)
    counts = words.groupBy(F.window(ts, "7 days"), "term").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.select(F.col("window.start").alias("week_start"), "term", "cnt")


def run_to_table(frame: DataFrame, path: str, mode: str = "append") -> None:
    """Drain the stream's present input into a Parquet table, restartable from its checkpoint."""
    query = (
        frame.writeStream.format("parquet")
        .option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/checkpoint")
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_updates(frame: DataFrame, path: str) -> None:
    """Drain the stream and keep, per micro-batch, the rows that changed, open weeks included."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")

    query = (
        frame.writeStream.foreachBatch(keep)
        .option("checkpointLocation", f"{path}/checkpoint")
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_updates(spark: SparkSession, path: str, keys: list[str], value: str) -> DataFrame:
    """The latest value of every key."""
    rows = spark.read.parquet(f"{path}/data")
    return rows.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def run_moments(posts: DataFrame, words: list[str], path: str, tokens: str = "tokens") -> None:
    """Write each micro-batch's moment sums to its own folder. A repeated batch overwrites its folder,
    so every document counts once."""

    def add(batch: DataFrame, batch_id: int) -> None:
        sums = M.gram_rows(doc_vectors(batch, words, tokens), len(words))
        sums.write.mode("overwrite").parquet(f"{path}/sums/batch={batch_id}")

    query = (
        posts.writeStream.foreachBatch(add)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_moments(spark: SparkSession, path: str, width: int) -> M.Moments:
    """The merged state of all batches so far."""
    rows = M.add_up(spark.read.parquet(f"{path}/sums").select("period", "i", "v"), ["period", "i"])
    return M.Moments.from_rows(rows.collect(), width)[0]


def stream_table(spark: SparkSession, folder: str, name: str, files_at_once: int | None = None) -> DataFrame:
    """A driver table, one file or a folder of files, as a stream; ``files_at_once`` limits the files of a micro-batch.

    Without a limit all present files come in one micro-batch, so no row is late because its file came after another.
    """
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    reader = reader if files_at_once is None else reader.option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(f"{folder}/{name}.parque[t]")  # a pattern, since a plain path would have to be a folder
