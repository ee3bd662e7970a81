"""Reproducible sampling and row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.operators.skew import exact_sample, global_rank, hash_order


def sample_per_group(df: DataFrame, id_col: str, by: str, fraction: float, seed: int = 0) -> DataFrame:
    """Exactly ``floor(n * fraction)`` rows of every group."""
    return exact_sample(df, id_col, seed, fraction=fraction, by=by)


def sample_fraction(df: DataFrame, id_col: str, fraction: float, seed: int = 0) -> DataFrame:
    return exact_sample(df, id_col, seed, fraction=fraction)


def sample_cap(df: DataFrame, id_col: str, cap: int, seed: int = 0) -> DataFrame:
    """All rows when there are at most ``cap``, otherwise exactly ``cap`` of them."""
    return exact_sample(df, id_col, seed, size=cap)


def shuffled(df: DataFrame, id_col: str, seed: int = 0, position: str = "position") -> DataFrame:
    """A seeded order column: sort by it to shuffle, sort by the id to restore."""
    return df.withColumn(position, hash_order(id_col, seed))


def prefix_fraction(df: DataFrame, id_col: str, fraction: float) -> DataFrame:
    """The first ``floor(n * fraction)`` rows in id order."""
    ranked = global_rank(df, id_col, "_rank")
    wanted = df.agg(F.floor(F.count(F.lit(1)) * F.lit(fraction)).alias("n"))
    return ranked.where(F.col("_rank") <= wanted.scalar()).drop("_rank")


def one_per_group(df: DataFrame, id_col: str, by: str, seed: int = 0) -> DataFrame:
    """One seeded pick of every group, through a map-side minimum."""
    row = F.struct(*[F.col(c) for c in df.columns])
    picked = df.groupBy(by).agg(F.min_by(row, hash_order(id_col, seed)).alias("_row"))
    return picked.select("_row.*")


def top_per_group(df: DataFrame, by: str | list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of every group. Spark limits each group inside every task before the
    shuffle, so a hot group sends ``n`` rows per task and not all its rows."""
    by = [by] if isinstance(by, str) else by
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window).cast("long")).where(F.col(rank) <= n)
