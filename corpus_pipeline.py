"""From raw documents to packed sequences: language, quality, near copies, repeated passages, packing.

Stages keep all columns of documents, whatever their names; ``text`` and ``n_chars`` follow what is cut. Null, empty and
letterless texts go with the first stage, as do texts whose language is told badly. Rows may repeat, with or without
their ids; an empty table gives no sequence. Rows that a stage keeps stand in the order Spark gives them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmuration.llm import langid, minhash, packing, quality, suffix
from murmuration.llm.common import small_batches
from murmuration.llm.queries import TOKENIZER
from murmuration.plans.registry import table
from murmuration.session import cut_lineage, drop_scratch, scratch_made

LEAST_LANGUAGE_SCORE = 0.2
LEAST_QUALITY = 0.3
COPIES_BROADCAST = 1 << 20  # ids, 8 bytes each


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told from their text; those without a letter and those told badly go."""
    small_batches(spark)
    scored = langid.predict(docs, langid.learn(docs))
    good = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return scored.where(good).select(*docs.columns)


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores like those labelled good."""
    small_batches(spark)
    scored = quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col("score") >= LEAST_QUALITY).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id.

    Rows that repeat an id are judged by their texts: of equal ones one is looked at, of others the first keeps the id
    and the rest stand behind all ids, each for itself. Rows without an id are no one's copies and stay.
    """
    small_batches(spark)
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), "text")
    known = named.where("id IS NOT NULL")
    repeated = cut_lineage(known.groupBy("id").count().where("count > 1").select("id"), "repeated-ids")
    order = Window.partitionBy("id").orderBy("text")
    several = known.join(repeated, "id").withColumn("n", F.row_number().over(order)).withColumn("before", F.lag("text").over(order))
    several = several.where("n = 1 OR NOT (text <=> before)")
    behind = F.xxhash64("id", "text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    several = several.select("row", F.when(F.col("n") == 1, F.col("id")).otherwise(behind).alias("id"), "text")
    rows = known.join(repeated, "id", "left_anti").select("row", "id", "text").unionByName(cut_lineage(several, "repeated-rows"))
    mark = scratch_made(spark)
    copies = cut_lineage(minhash.near_copies(rows.select("id", "text"), "id").where("NOT kept").select("id"), "copies")
    drop_scratch(spark, mark, "copies")
    copies = F.broadcast(copies) if copies.count() <= COPIES_BROADCAST else copies
    return rows.join(copies, "id", "left_anti").select("row.*").unionByName(docs.where("doc_id IS NULL"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without the strings of 400 bytes that also stand elsewhere."""
    small_batches(spark)
    return suffix.without_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: sequences of at most 4096 tokens."""
    small_batches(spark)
    return packing.pack(docs.select("doc_id", "text"), TOKENIZER)


STAGES = [
    ("language_id", keep_known_languages),
    ("quality", keep_good_quality),
    ("near_dedup", keep_one_of_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack_sequences),
]
ORACLE_SQL = None  # trained models and packing are not expressible


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
