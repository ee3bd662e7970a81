"""Joins, ranks and samples that hold when one key owns a large share of all rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from murmuration.session import cut_lineage

PLAIN_ROWS = 1_000_000  # up to here a single task copes, so nothing needs spreading
HOT_SHARE = 1000  # a key is hot when it owns more than 1/HOT_SHARE of the rows


def skew_join(
    big: DataFrame,
    small: DataFrame,
    key: str,
    weight: str,
    spread: str | list[str],
    how: str = "inner",
    sizes: DataFrame | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Join a large table to a table with few rows per key. ``weight`` is the number of rows of the large
    table a key holds; it is a column of ``small`` or, when given, of ``sizes`` (one row per key).

    Keys holding more than 1/1000 of all rows can number fewer than 1000, so their list is broadcast
    whatever the data size. Each hot key is cut into pieces of at most 1/1000 of the rows by the hash
    of ``spread``; the small side repeats its row once per piece. No reducer gets more than that share.

    A caller that knows the large table's ``rows`` gets a plain join while one task could hold them all.
    """
    if rows is not None and rows <= PLAIN_ROWS:
        return big.join(small, key, how)
    if rows is not None:  # known to be large: keep what is read several times below
        small = cut_lineage(small, "join-rows")
        sizes = sizes if sizes is None else cut_lineage(sizes.select(key, weight), "join-sizes")
    spread = [spread] if isinstance(spread, str) else spread
    sizes = small if sizes is None else sizes
    total = sizes.agg(F.sum(weight).alias("_total"))
    hot = sizes.where(F.col(weight) * HOT_SHARE > total.scalar()).select(
        key, F.ceil(F.col(weight) * HOT_SHARE / total.scalar()).cast("int").alias("_pieces")
    )
    left = (
        big.join(F.broadcast(hot), key, "left")
        .withColumn(
            "_salt",
            F.when(F.col("_pieces").isNull(), F.lit(0)).otherwise(
                F.pmod(F.xxhash64(*spread), F.col("_pieces")).cast("int")
            ),
        )
        .drop("_pieces")
    )
    right = (
        small.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)))
        .drop("_pieces")
    )
    return left.join(right, [key, "_salt"], how).drop("_salt")


def hash_order(id_col: str | Column, seed: int | str) -> Column:
    """A seeded pseudo-random order that any engine can reproduce."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), column.cast("string")))


def hash_threshold(
    df: DataFrame, order: Column, by: str | None = None, fraction: float | None = None, size: int | None = None
) -> DataFrame:
    """Per group (or overall) the largest hash of the exact sample: ``(by, _rows, _cut)``.

    Two small passes over the hash: a histogram of its first 16 bits finds the bucket in which the
    sample ends, and only that bucket's rows are ranked. No group meets in one task.
    """
    group = [by] if by else []
    hashed = df.select(*group, order.alias("_h")).withColumn("_b", F.substring("_h", 1, 4))
    histogram = hashed.groupBy(*group, "_b").count()
    ordered = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group)
    wanted = F.lit(size) if size is not None else F.floor(F.lit(fraction) * F.col("_rows"))
    ends = (
        histogram.withColumn("_through", F.sum("count").over(ordered))
        .withColumn("_rows", F.sum("count").over(whole))
        .withColumn("_need", F.least(wanted.cast("long"), F.col("_rows")))
        .where((F.col("_through") >= F.col("_need")) & (F.col("_through") - F.col("count") < F.col("_need")))
        .select(*group, "_b", "_rows", (F.col("_need") - F.col("_through") + F.col("count")).alias("_left"))
    )
    last = hashed.join(ends, [*group, "_b"])
    rank = F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_h"))
    kept = last.withColumn("_r", rank).where(F.col("_r") <= F.col("_left"))
    return kept.groupBy(*group).agg(F.max("_rows").alias("_rows"), F.max("_h").alias("_cut"))


def exact_sample(
    df: DataFrame,
    id_col: str,
    seed: int | str,
    fraction: float | None = None,
    size: int | None = None,
    by: str | None = None,
) -> DataFrame:
    """Exactly ``floor(n * fraction)`` or ``size`` rows, overall or of every group, without replacement."""
    order = hash_order(id_col, seed)
    if by is None:
        cuts = cut_lineage(hash_threshold(df, order, None, fraction, size), "sample-cuts")
        return df.where(order <= cuts.select("_cut").scalar())
    # null is a group like any other, so it is named by a value that joins
    named = df.withColumn("_group", F.when(F.col(by).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(by).cast("string"))))
    cuts = cut_lineage(hash_threshold(named, order, "_group", fraction, size), "sample-cuts")
    return skew_join(named, cuts, "_group", "_rows", id_col).where(order <= F.col("_cut")).select(*df.columns)


def by_bounds(df: DataFrame, key: str, bounds: list, piece: str) -> DataFrame:
    """Number the pieces that literal bounds cut a numeric column into: how many bounds a value reaches, found by
    binary search. Whole numbers are compared as such, whatever their size; null is in the first piece."""
    whole = isinstance(df.schema[key].dataType, IntegralType)
    cuts = sorted({min(max(math.ceil(b), -(1 << 63)), (1 << 63) - 1) if whole else float(b) for b in bounds})
    if not cuts:
        return df.withColumn(piece, F.lit(0))
    edges, kind = np.array(cuts, np.int64 if whole else np.float64), pa.int64() if whole else pa.float64()

    @F.arrow_udf("int")
    def place(values: pa.Array) -> pa.Array:
        found = np.searchsorted(edges, pc.fill_null(values.cast(kind), 0).to_numpy(), "right")
        return pa.array(np.where(values.is_null().to_numpy(zero_copy_only=False), 0, found).astype(np.int32))

    return df.withColumn(piece, place(key))


def global_rank(df: DataFrame, key: str, rank: str = "rank", rows_per_task: int = 2_000_000) -> DataFrame:
    """``row_number() over (order by key)`` for a unique numeric key, ranked piece by piece.

    Quantile bounds cut the key range into pieces of about ``rows_per_task`` rows. The bounds are
    literals, so a recomputed task sees the same pieces; the piece counts (at most 4096 rows) give
    each piece its offset.
    """
    order = Window.orderBy(key)
    n = df.count()
    if n <= rows_per_task:
        return df.withColumn(rank, F.row_number().over(order).cast("long"))
    pieces = min(4096, -(-n // rows_per_task))
    keyed = df.withColumn("_key", F.col(key).cast("double"))
    cuts = keyed.approxQuantile("_key", [i / pieces for i in range(1, pieces)], 0.25 / pieces)
    placed = by_bounds(keyed, key, cuts, "_piece")
    offsets = (
        placed.groupBy("_piece")
        .count()
        .select(
            "_piece",
            F.coalesce(
                F.sum("count").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("_offset"),
        )
    )
    local = F.row_number().over(Window.partitionBy("_piece").orderBy(key))
    return (
        placed.join(F.broadcast(offsets), "_piece")
        .withColumn(rank, (F.col("_offset") + local).cast("long"))
        .drop("_key", "_piece", "_offset")
    )
