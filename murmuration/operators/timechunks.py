"""Time operators: sorting, data-anchored weeks, calendar weeks and named weeks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.session import cut_lineage

DAY_MICROS = 86_400_000_000
EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def _micros(df: DataFrame, ts: str) -> Column:
    """A time column as microseconds, so that boundaries pass the driver without any time zone."""
    if df.schema[ts].dataType.simpleString() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, `{ts}`)")
    return F.unix_micros(ts)


def _time(df: DataFrame, ts: str, micros: str) -> Column:
    """The way back, for a number or a column of numbers."""
    if df.schema[ts].dataType.simpleString() == "timestamp_ntz":
        return F.expr(f"timestampadd(MICROSECOND, {micros}, {EPOCH})")
    return F.expr(f"timestamp_micros({micros})")


def sort_by_time(df: DataFrame, ts: str, id_col: str) -> DataFrame:
    return df.orderBy(ts, id_col)


MOST_ROWS = 4096  # rows looked at in one span


def _span_heads(times: DataFrame, start: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(time, id, sure)`` of the first rows of every span of ``span`` microseconds from ``start`` on, in order of time and id.

    The n-th span gives up to 4n + 16 rows: a chunk that opened n spans before has drifted by two rows a chunk, if rows come
    as densely everywhere. ``sure`` tells whether the row after it, in the whole table, is the next one given.
    """
    number = F.call_function("div", F.col("t") - F.lit(start), F.lit(span))
    rank = F.row_number().over(Window.partitionBy("span").orderBy("t", "id"))
    heads = times.where(F.col("t") >= F.lit(start)).select("t", "id", number.alias("span")).withColumn("r", rank)
    heads = heads.where(F.col("r") <= MOST_ROWS + 1)  # a constant, so tasks keep no more before the shuffle
    limit = F.least(4 * F.col("span") + 16, F.lit(MOST_ROWS))
    found = heads.where(F.col("r") <= limit + 1).select("t", "id", (F.col("r") > limit).alias("beyond")).toArrow().sort_by([("t", "ascending"), ("id", "ascending")])
    t, row, beyond = (found[c].to_numpy() for c in ("t", "id", "beyond"))
    given = ~beyond
    sure = np.append(given[1:], True)[given]  # a span with more rows than were asked for shows one more
    return t[given], row[given], sure


def chunk_starts(df: DataFrame, ts: str, id_col: str, days: int = 7) -> list[tuple]:
    """First row ``(microseconds, id)`` of every chunk. A chunk opens at its first row and closes with the first
    row at or after that time plus ``days``, which it still holds; the next row opens the next chunk.

    One job gathers the first rows of all spans of ``days`` after a chunk's start, a table of the calendar's size; the driver
    walks on as far as these rows tell what follows, usually to the end. Where rows come so unevenly that they do not,
    the next job starts from the chunk reached. Rows without a time are in no chunk."""
    times = df.where(F.col(ts).isNotNull()).select(_micros(df, ts).alias("t"), F.col(id_col).cast("long").alias("id"))
    times = cut_lineage(times.repartitionByRange("t").sortWithinPartitions("t"), "times")
    span = days * DAY_MICROS
    first = times.agg(F.min(F.struct("t", "id")).alias("f")).first()["f"]
    if first is None:
        return []
    current = (first["t"], first["id"])
    starts = [current]
    while True:
        origin = current[0]
        t, row, sure = _span_heads(times, origin, span)
        while True:
            until = current[0] + span
            closing = int(np.searchsorted(t, until))
            # rows not given stand behind an unsure one, in its span
            if not sure[closing - 1] and until < origin + ((int(t[closing - 1]) - origin) // span + 1) * span:
                break
            if closing == len(t):
                return starts
            if not sure[closing]:
                break
            if closing + 1 == len(t):
                return starts
            current = (int(t[closing + 1]), int(row[closing + 1]))
            starts.append(current)


def anchored_weeks(df: DataFrame, ts: str, id_col: str, days: int = 7) -> DataFrame:
    """Add ``chunk_id`` (0, 1, ...) to every row: the last chunk that opened at or before it; null without a time."""
    starts = chunk_starts(df, ts, id_col, days)
    times, ids = (np.array([s[i] for s in starts], np.int64) for i in (0, 1))

    @F.arrow_udf("long")
    def chunk(time: pa.Array, row: pa.Array) -> pa.Array:
        """Chunks open more than ``days`` apart, so the id only decides against one start of the same time."""
        t = pc.fill_null(time, 0).to_numpy()
        found = np.searchsorted(times, t, "right") - 1
        at = np.maximum(found, 0)
        found = found - ((times[at] == t) & (pc.fill_null(row, 0).to_numpy() < ids[at]))
        return pa.array(found.astype(np.int64), mask=time.is_null().to_numpy(zero_copy_only=False))

    if not starts:
        return df.withColumn("chunk_id", F.lit(None).cast("long"))
    return df.withColumn("chunk_id", chunk(_micros(df, ts), F.col(id_col).cast("long")))


def chunk_manifest(chunked: DataFrame, ts: str) -> DataFrame:
    """``(chunk_id, first_ts, last_ts, n)``, what the chunk's file name would say."""
    return chunked.groupBy("chunk_id").agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n")
    )


def calendar_weeks(df: DataFrame, ts: str) -> DataFrame:
    """``(week_start, n)`` on fixed seven-day windows."""
    return df.groupBy(F.window(ts, "7 days").start.alias("week_start")).agg(F.count(F.lit(1)).alias("n"))


def named_weeks(df: DataFrame, ts: str, mid: int = 50, length: int = 7) -> DataFrame:
    """``(bucket, day)``: the first ``length`` distinct days, ``length`` days from position ``mid``, and
    the last ``length``. Ranks run over distinct days, a calendar-sized table."""
    days = df.select(F.to_date(ts).alias("day")).distinct()
    up, down = Window.orderBy("day"), Window.orderBy(F.desc("day"))
    ranked = days.select("day", F.row_number().over(up).alias("r"), F.row_number().over(down).alias("b"))
    buckets = F.array(
        F.when(F.col("r") <= length, F.lit("start")),
        F.when((F.col("r") > mid) & (F.col("r") <= mid + length), F.lit("mid")),
        F.when(F.col("b") <= length, F.lit("end")),
    )
    return ranked.select(F.explode(F.array_compact(buckets)).alias("bucket"), "day")


def rows_in_buckets(df: DataFrame, ts: str, buckets: DataFrame) -> DataFrame:
    """Rows whose day belongs to a bucket; the day table is calendar-sized."""
    return df.withColumn("day", F.to_date(ts)).join(F.broadcast(buckets), "day").select(*df.columns, "bucket")
