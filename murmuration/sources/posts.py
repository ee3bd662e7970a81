"""Readers for raw posts: concatenated JSON, CSV and (date, text) pair tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.sources import json_blocks

# The raw post's fields, in declared form.
POST_SCHEMA = (
    "created_at string, id bigint, lang string, text string, full_text string, "
    "extended_tweet struct<full_text: string>, retweeted_status struct<id: bigint>"
)
CORRUPT, REASON = "_corrupt_record", "_reason"
SEPARATOR = '}{"created_at"'  # inside a string the quotes would be escaped, so it only stands between two objects
BOUNDARY = re.compile(r"\}\s*(?=\{)")


def root_objects(text: str) -> Iterator[tuple[str, str | None]]:
    """``(object, None)`` for every JSON object that stands in a stretch of text, touching or with white space
    between, and ``(text, reason)`` for all else, so nothing is lost. The last object may lack its closing
    brace, which a record separator has taken. After an error the next object at a boundary is looked for."""
    decode, n = json.JSONDecoder(strict=False).raw_decode, len(text)
    closed, at = text + "}", 0
    while True:
        while at < n and (text[at].isspace() or text[at] == "\ufeff"):
            at += 1
        if at >= n:
            return
        try:
            value, end = decode(closed, at)
            if isinstance(value, dict):
                yield closed[at:end], None
            else:
                yield text[at:end], "text outside an object"
        except (ValueError, RecursionError):
            found = BOUNDARY.search(text, at + 1)
            end = found.end() if found else n
            yield text[at:end], "not a JSON object" if text[at] == "{" else "text outside an object"
        at = end


def _objects(spark: SparkSession, path, separator: str, whole_files: bool) -> DataFrame:
    """``(file, json, reason)``: the top-level objects of files, and whatever else stands in them."""
    if not whole_files:
        return json_blocks.objects(spark, path, separator, root_objects)

    def run(batches):
        for batch in batches:
            files, parts, reasons = [], [], []
            for file, text in zip(batch.column(0), batch.column(1), strict=True):
                for part, reason in root_objects(text.as_py()):
                    files.append(file.as_py())
                    parts.append(part)
                    reasons.append(reason)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (files, parts, reasons)], names=["file", "json", "reason"])

    records = spark.read.text(path, wholetext=True)
    return records.select(F.col("_metadata.file_path").alias("file"), "value").mapInArrow(run, "file string, json string, reason string")


def scan_concat_json(
    spark: SparkSession, path, schema: str = POST_SCHEMA, separator: str = SEPARATOR, whole_files: bool = False
) -> DataFrame:
    """Parsed posts plus ``file`` and, for what does not parse, its text in ``_corrupt_record`` and ``_reason``.

    Objects may touch or have white space between them, in any mix and with any order of keys; every object gives
    one row. The separator decides only where large files can be split, here between touching objects with the usual
    first key; a file without it is read by one task. It must end with a quoted key (``'}\\n{"id"'`` for lines).
    """
    objects = _objects(spark, path, separator, whole_files)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = objects.withColumn("post", F.from_json("json", f"{schema}, {CORRUPT} string", options))
    fields = [f for f in parsed.schema["post"].dataType.names if f != CORRUPT]
    fault = F.when(F.col("reason").isNotNull(), F.col("json")).otherwise(F.col(f"post.{CORRUPT}"))
    reason = F.coalesce("reason", F.when(F.col(f"post.{CORRUPT}").isNotNull(), F.lit("does not fit the schema")))
    sound = F.when(F.col("reason").isNull(), F.col("post"))
    return parsed.select("file", *[sound[f].alias(f) for f in fields], fault.alias(CORRUPT), reason.alias(REASON))


def split_rejects(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and ``(file, reason, content)`` for the others; one bad object spoils no neighbour."""
    good = posts.where(F.col(CORRUPT).isNull()).drop(CORRUPT, REASON)
    bad = posts.where(F.col(CORRUPT).isNotNull())
    return good, bad.select("file", F.col(REASON).alias("reason"), F.col(CORRUPT).alias("content"))


def drop_retweets(posts: DataFrame) -> DataFrame:
    """An explicit JSON null counts as absent."""
    return posts.where(F.col("retweeted_status").isNull())


def english_only(posts: DataFrame) -> DataFrame:
    return posts.where(F.col("lang") == "en")


def best_text() -> Column:
    return F.coalesce("full_text", "extended_tweet.full_text", "text")


def parse_created_at(column: str = "created_at") -> Column:
    """``Thu Apr 23 06:45:20 +0000 2020`` as a zone-free timestamp; other forms give NULL."""
    # The one accepted layout.
    layout = r"^[A-Z][a-z]{2} ([A-Z][a-z]{2} \d{2} \d{2}:\d{2}:\d{2}) \+0000 (\d{4})$"
    body = F.concat(F.regexp_extract(column, layout, 1), F.lit(" "), F.regexp_extract(column, layout, 2))
    return F.when(F.col(column).rlike(layout), F.to_timestamp_ntz(body, F.lit("MMM dd HH:mm:ss yyyy")))


def clean_posts(posts: DataFrame) -> DataFrame:
    """``(doc_id, created_at, text, source)``: English originals with their best text."""
    return english_only(drop_retweets(posts)).select(
        F.col("id").alias("doc_id"),
        parse_created_at().alias("created_at"),
        best_text().alias("text"),
        F.col("file").alias("source"),
    )


def missing_nested(posts: DataFrame) -> DataFrame:
    """Posts that carry the extended struct without its text."""
    return posts.where(F.col("extended_tweet").isNotNull() & F.col("extended_tweet.full_text").isNull())


def read_csv(spark: SparkSession, path, schema: str) -> DataFrame:
    """Header CSV with quoted line breaks; doubled quotes are the escape."""
    return spark.read.csv(
        path,
        schema=schema,
        header=True,
        multiLine=True,
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def scan_csv_dir(spark: SparkSession, path, schema: str, lang: str = "en") -> DataFrame:
    """Every CSV below a folder, one language."""
    return read_csv(spark, path, schema).where(F.col("lang") == lang)


def scan_pairs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The union of several ``(created_at, text)`` tables; a table with other columns is an error."""
    frames = [spark.read.parquet(p) for p in paths]
    return reduce(lambda a, b: a.unionByName(b), frames)


def select_files_by_day(frame: DataFrame, days: list[str]) -> DataFrame:
    """Rows of the files whose path names one of the days; other files are not opened."""
    day = F.regexp_extract("_metadata.file_path", r"(\d{4}-\d{2}-\d{2})", 1)
    return frame.where(day.isin([str(d) for d in days]))
