"""The list of registered queries and, beside each, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread an input that arrives in fewer pieces than there are cores, by its row key.

    A large table has far more splits than cores and passes through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(cores, key)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    wanted = ["doc_id", *[c for c in columns if c != "doc_id"]]
    return spread(table(spark, sf_dir, "documents").select(*wanted), "doc_id")
