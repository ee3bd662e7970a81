"""Queries over the file readers, writers and time operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.operators import timechunks
from murmuration.operators.vocab import build_vocab, doc_vectors, pin
from murmuration.plans.registry import query, table
from murmuration.plans.text_queries import preprocessed
from murmuration.plans.vocab_queries import BASE, VOCAB
from murmuration import workflow
from murmuration.session import scratch_path
from murmuration.sources import posts, sinks

# --- raw posts made from the documents: the last digit of the source decides where the text sits


def posts_from_documents(spark, sf_dir: str) -> DataFrame:
    """Documents as raw posts, timed by the event with the same id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    times = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "ts")
    kind = F.substring("source", -1, 1)
    stamp = F.date_format("ts", "EEE MMM dd HH:mm:ss '+0000' yyyy")
    extended = F.when(kind == "1", F.struct(F.col("text").alias("full_text"))).when(
        kind == "2", F.struct(F.lit(None).cast("string").alias("full_text"))
    )
    return docs.join(times, "doc_id").select(
        stamp.alias("created_at"),
        F.col("doc_id").alias("id"),
        "lang",
        F.when(kind.isin("1", "3"), F.left("text", F.lit(20))).otherwise(F.col("text")).alias("text"),
        F.when(kind == "3", F.col("text")).alias("full_text"),
        extended.alias("extended_tweet"),
        F.when(kind == "0", F.struct(F.lit(1).cast("long").alias("id"))).alias("retweeted_status"),
        "source",
    )


def raw_files(spark, sf_dir: str, spoil: bool = False, one_file_each: bool = False) -> str:
    """The posts written as objects back to back, one folder per source. The source's last digit varies the layout:
    4 a line each, 5 spaces between, 6 another first key; with ``spoil``, 7 cannot be read and 8 is cut off."""
    rows = posts_from_documents(spark, sf_dir)
    rows = rows.repartition("source") if one_file_each else rows
    fields = [c for c in rows.columns if c != "source"]
    kind = F.substring("source", -1, 1)
    line = F.when(kind == "6", F.to_json(F.struct("id", "lang", *[c for c in fields if c not in ("id", "lang")]))).otherwise(
        F.to_json(F.struct(*fields))
    )
    if spoil:  # an unquoted language makes the object unreadable
        unquoted = F.replace(line, F.lit('"lang":"'), F.lit('"lang":'))
        cut_off = F.substring(line, F.lit(1), F.length(line) - 3)
        line = F.when(kind == "7", unquoted).when(kind == "8", cut_off).otherwise(line)
    line = F.concat(F.when(kind == "4", F.lit("\n")).when(kind == "5", F.lit("  ")).otherwise(F.lit("")), line)
    path = scratch_path(spark, "raw-posts")
    # the closing brace is the line separator, so the objects touch
    body = rows.select("source", F.expr("1").alias("_"), line.alias("value")).drop("_")
    body = body.withColumn("value", F.expr("substr(value, 1, length(value) - 1)"))
    body.write.partitionBy("source").option("lineSep", "}").text(path)
    return path


RAW = (
    "raw AS (SELECT d.*, right(source, 1) AS kind, date_trunc('second', e.ts) AS ts "
    "FROM documents d JOIN events e ON e.event_id = d.doc_id)"
)


@query("scan_concat_json", f"WITH {RAW} SELECT doc_id AS id, lang, kind = '0' AS retweet, text FROM raw")
def scan_concat_json(spark, sf_dir):
    """Documents written as touching JSON objects and read back."""
    good = posts.scan_concat_json(spark, raw_files(spark, sf_dir))
    return good.select(
        "id", "lang", F.col("retweeted_status").isNotNull().alias("retweet"), posts.best_text().alias("text")
    )


@query(
    "quarantine_bad_files",
    f"WITH {RAW} SELECT doc_id, CASE WHEN kind IN ('7', '8') THEN 'rejected' ELSE 'good' END AS status FROM raw",
)
def quarantine_bad_files(spark, sf_dir):
    good, bad = posts.split_rejects(posts.scan_concat_json(spark, raw_files(spark, sf_dir, spoil=True)))
    lost = bad.select(F.regexp_extract("content", r'"id":(\d+)', 1).cast("long").alias("doc_id"))
    return (
        good.select(F.col("id").alias("doc_id"), F.lit("good").alias("status"))
        .unionByName(lost.withColumn("status", F.lit("rejected")))
    )


@query("drop_retweets", f"WITH {RAW} SELECT doc_id AS id FROM raw WHERE kind <> '0'")
def drop_retweets(spark, sf_dir):
    return posts.drop_retweets(posts_from_documents(spark, sf_dir)).select("id")


@query("best_text", f"WITH {RAW} SELECT doc_id AS id, text FROM raw")
def best_text(spark, sf_dir):
    return posts_from_documents(spark, sf_dir).select("id", posts.best_text().alias("text"))


@query("missing_nested", f"WITH {RAW} SELECT doc_id AS id FROM raw WHERE kind = '2'")
def missing_nested(spark, sf_dir):
    return posts.missing_nested(posts_from_documents(spark, sf_dir)).select("id")


@query("text_field_coverage", f"WITH {RAW} SELECT count(*) AS n, count(text) AS n_text, count(*) FILTER (kind = '3') "
       "AS n_full_text, count(*) FILTER (kind IN ('1', '2')) AS n_extended, "
       "count(*) FILTER (kind = '1') AS n_extended_text FROM raw")  # fmt: skip
def text_field_coverage(spark, sf_dir):
    def has(c):
        return F.count_if(F.col(c).isNotNull())

    return posts_from_documents(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n"),
        has("text").alias("n_text"),
        has("full_text").alias("n_full_text"),
        has("extended_tweet").alias("n_extended"),
        has("extended_tweet.full_text").alias("n_extended_text"),
    )


@query(
    "parse_created_at",
    f"WITH {RAW} SELECT doc_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM raw",
)
def parse_created_at(spark, sf_dir):
    rows = posts_from_documents(spark, sf_dir)
    return rows.select("id", posts.parse_created_at().cast("string").alias("created_at"))


@query(
    "scan_csv_tweets",
    "SELECT lang, sum(length(text))::BIGINT AS chars, count(*) AS n FROM documents GROUP BY lang",
)
def scan_csv_tweets(spark, sf_dir):
    """Texts with commas, quotes and line breaks through a CSV with a ``tweet`` column."""
    path = scratch_path(spark, "tweet-csv")
    docs = table(spark, sf_dir, "documents").select("lang", F.col("text").alias("tweet"))
    sinks.write_csv(docs, path)
    back = posts.read_csv(spark, path, "lang string, tweet string")
    return back.groupBy("lang").agg(F.sum(F.length("tweet")).alias("chars"), F.count(F.lit(1)).alias("n"))


@query("scan_csv_dir_lang", "SELECT doc_id, lang, text FROM documents WHERE lang = 'en'")
def scan_csv_dir_lang(spark, sf_dir):
    path = scratch_path(spark, "csv-dir")
    sinks.write_csv(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), path)
    return posts.scan_csv_dir(spark, path, "doc_id long, lang string, text string")


def timed_documents(spark, sf_dir: str) -> DataFrame:
    """``(doc_id, created_at, text)``: documents timed by the event with the same id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    times = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("created_at"))
    return docs.join(times, "doc_id")


TIMED = "timed AS (SELECT doc_id, ts AS created_at, text FROM documents JOIN events ON event_id = doc_id)"


@query(
    "scan_pairs",
    f"WITH {TIMED} SELECT created_at, text FROM timed UNION ALL SELECT ts, event_type FROM events",
)
def scan_pairs(spark, sf_dir):
    """Two pair tables written apart and read as one."""
    paths = [scratch_path(spark, "pairs"), scratch_path(spark, "pairs")]
    timed_documents(spark, sf_dir).select("created_at", "text").write.parquet(paths[0])
    events = table(spark, sf_dir, "events")
    events.select(F.col("ts").alias("created_at"), F.col("event_type").alias("text")).write.parquet(paths[1])
    return posts.scan_pairs(spark, paths)


DAYS = ["2024-01-03", "2024-01-04", "2024-01-29"]


@query(
    "select_files_by_day",
    "SELECT event_id, user_id FROM events WHERE strftime(ts, '%Y-%m-%d') IN ("
    + ", ".join(f"'{d}'" for d in DAYS)
    + ")",
)
def select_files_by_day(spark, sf_dir):
    path = scratch_path(spark, "by-day")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("day"))
    events.write.partitionBy("day").parquet(path)
    return posts.select_files_by_day(spark.read.parquet(path), DAYS).select("event_id", "user_id")


@query(
    "write_clean",
    "SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM events JOIN documents ON event_id = doc_id",
)
def write_clean(spark, sf_dir):
    path = scratch_path(spark, "clean")
    sinks.write_clean(timed_documents(spark, sf_dir), path)
    return spark.read.parquet(f"{path}/manifest")


@query(
    "clean_archive",
    f"WITH {RAW} SELECT doc_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, text FROM raw WHERE lang = 'en' AND kind <> '0'",
)
def clean_archive(spark, sf_dir):
    """Raw files to the clean table: English originals with their best text and time."""
    clean = workflow.clean_archive(spark, raw_files(spark, sf_dir), scratch_path(spark, "archive"))
    return clean.select("doc_id", F.col("created_at").cast("string").alias("created_at"), "text")


@query(
    "load_posts_sample",
    f"WITH {RAW}, kept AS (SELECT source, count(*) AS n FROM raw WHERE lang = 'en' AND kind <> '0' GROUP BY source) "
    "SELECT CAST(floor(n * 0.5) AS BIGINT) AS size, count(*) AS files FROM kept WHERE floor(n * 0.5) > 0 GROUP BY 1",
)
def load_posts_sample(spark, sf_dir):
    """Half of every raw file's usable posts: how many files gave a sample of each size. One file holds one source."""
    path = raw_files(spark, sf_dir, one_file_each=True)
    sample = workflow.load_posts(spark, path, 0.5, rejects=scratch_path(spark, "rejects"))
    return sample.groupBy("source").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("files"))


# --- time

CHUNKS = (
    "RECURSIVE o AS MATERIALIZED (SELECT event_id, user_id, ts, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events), "
    "starts AS (SELECT CAST(0 AS BIGINT) AS chunk_id, CAST(1 AS BIGINT) AS rn UNION ALL "
    "SELECT chunk_id + 1, nx FROM (SELECT s.chunk_id, min(o.rn) + 1 AS nx FROM starts s JOIN o b ON b.rn = s.rn "
    "JOIN o ON o.rn > s.rn AND o.ts >= b.ts + INTERVAL {days} DAY GROUP BY s.chunk_id) q "
    "WHERE nx <= (SELECT count(*) FROM o)), "
    "chunked AS (SELECT event_id, ts, (SELECT max(chunk_id) FROM starts WHERE starts.rn <= o.rn) AS chunk_id FROM o)"
)


@query("sort_by_time", "SELECT event_id, ts FROM events ORDER BY ts, event_id")
def sort_by_time(spark, sf_dir):
    return timechunks.sort_by_time(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id")


@query("anchored_weeks", f"WITH {CHUNKS.format(days=7)} SELECT event_id, chunk_id FROM chunked")
def anchored_weeks(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return timechunks.anchored_weeks(events, "ts", "event_id").select("event_id", "chunk_id")


@query(
    "write_chunks",
    f"WITH {CHUNKS.format(days=3)} SELECT chunk_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n "
    "FROM chunked GROUP BY chunk_id",
)
def write_chunks(spark, sf_dir):
    """Three-day chunks written by chunk, and the manifest read back."""
    path = scratch_path(spark, "chunks")
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    sinks.write_chunks(timechunks.anchored_weeks(events, "ts", "event_id", 3), path, "ts")
    return spark.read.parquet(f"{path}/manifest")


@query(
    "calendar_weeks",
    "SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS week_start, count(*) AS n FROM events GROUP BY 1",
)
def calendar_weeks(spark, sf_dir):
    return timechunks.calendar_weeks(table(spark, sf_dir, "events"), "ts")


@query(
    "bucket_weeks",
    "WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), r AS (SELECT day, row_number() OVER "
    "(ORDER BY day) AS r, row_number() OVER (ORDER BY day DESC) AS b FROM d), buckets AS ("
    "SELECT 'start' AS bucket, day FROM r WHERE r <= 7 UNION ALL SELECT 'mid', day FROM r WHERE r BETWEEN 13 AND 19 "
    "UNION ALL SELECT 'end', day FROM r WHERE b <= 7) "
    "SELECT event_id, bucket FROM events JOIN buckets ON CAST(ts AS DATE) = day",
)
def bucket_weeks(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    buckets = timechunks.named_weeks(events, "ts", mid=12)
    return timechunks.rows_in_buckets(events, "ts", buckets).select("event_id", "bucket")


@query(
    "stage_metrics_counts",
    f"{BASE}, {VOCAB}, every AS (SELECT count(*)::DOUBLE AS n FROM documents) "
    "SELECT 'tokenise' AS stage, 'rows' AS metric, n AS value FROM every UNION ALL SELECT 'vectors', 'rows', n FROM every "
    "UNION ALL SELECT 'tokenise', 'tokens', sum(cnt)::DOUBLE FROM counts UNION ALL SELECT 'vocabulary', 'terms', count(*)::DOUBLE "
    "FROM vocab UNION ALL SELECT 'vectors', 'nnz', count(*)::DOUBLE FROM counts JOIN vocab USING (term)",
)
def stage_metrics_counts(spark, sf_dir):
    """The counts of the run metrics, without the times."""
    return stage_metrics(spark, sf_dir).where("metric <> 'seconds'").select("stage", "metric", "value")


@query("stage_metrics")
def stage_metrics(spark, sf_dir):
    """Rows and seconds of the vectorising stages, observed while they run."""
    metrics = sinks.RunMetrics(spark, "vectorise")
    with metrics.stage("tokenise"):
        docs = metrics.observe(preprocessed(spark, sf_dir), "tokenise")
        n = docs.select(F.size("tokens").alias("n")).agg(F.sum("n")).first()[0]
        metrics.add("tokenise", "tokens", n)
    with metrics.stage("vocabulary"):
        words = pin(build_vocab(preprocessed(spark, sf_dir), 5, 0.5, 1000))[1]
        metrics.add("vocabulary", "terms", len(words))
    with metrics.stage("vectors"):
        vectors = metrics.observe(doc_vectors(preprocessed(spark, sf_dir), words), "vectors")
        metrics.add("vectors", "nnz", vectors.agg(F.sum(F.size("ids"))).first()[0])
    path = scratch_path(spark, "metrics")
    metrics.append(path)
    return spark.read.parquet(path)
