"""Corpus measurements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.operators.skew import global_rank

# Bin edges of the occurrence histogram; the last of them is closed, above it lies an open bin.
OCCURRENCE_BINS = (0, 1.5, 10, 100, 1000, 10000)


def vocab_growth(docs: DataFrame, fractions: list[float], id_col: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """``(n_docs, n_terms)``: distinct terms in the first documents, for every prefix share at once.

    A term counts from the first prefix that holds it, so one minimum per term and one count per
    prefix replace a run per size.
    """
    fractions = sorted(set(fractions))
    n = docs.count()
    sizes = [int(n * f) for f in fractions]
    ranked = global_rank(docs.select(id_col), id_col, "_rank")
    wanted = sorted(set(sizes))
    cuts = {r["_rank"]: r[id_col] for r in ranked.where(F.col("_rank").isin(wanted)).collect()}
    step = F.lit(None).cast("int")
    for position in range(len(wanted) - 1, -1, -1):
        step = F.when(F.col(id_col) <= F.lit(cuts.get(wanted[position])), position).otherwise(step)
    terms = docs.withColumn("_step", step).where(F.col("_step").isNotNull())
    first = (
        terms.select("_step", F.explode(F.array_distinct(tokens)).alias("term"))
        .groupBy("term")
        .agg(F.min("_step").alias("_step"))
    )
    new = first.groupBy("_step").agg(F.count(F.lit(1)).alias("_new"))
    steps = docs.sparkSession.createDataFrame(
        [(i, size) for i, size in enumerate(wanted)], "_step int, n_docs long"
    )
    running = F.sum(F.coalesce("_new", F.lit(0))).over(
        Window.orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    )
    return steps.join(new, "_step", "left").select("n_docs", running.alias("n_terms"))


def occurrence_hist(stats: DataFrame, bins=OCCURRENCE_BINS, value: str = "cf") -> DataFrame:
    """Histogram of term occurrences: ``(bin, low, high, n_terms)``, empty bins included. Terms above the last
    edge are in one more bin, without ``high``."""
    column = F.col(value)
    rows = [(i, float(bins[i]), float(bins[i + 1])) for i in range(len(bins) - 1)]
    choice = reduce(
        lambda other, r: F.when(
            (column >= r[1]) & ((column < r[2]) | ((column == r[2]) & F.lit(r[0] == len(rows) - 1))), r[0]
        ).otherwise(other),
        rows,
        F.when(column > rows[-1][2], len(rows)),
    )
    rows.append((len(rows), float(bins[-1]), None))
    counted = stats.groupBy(choice.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n_terms"))
    frame = stats.sparkSession.createDataFrame(rows, "bin int, low double, high double")
    return frame.join(counted, "bin", "left").select(
        "bin", "low", "high", F.coalesce("n_terms", F.lit(0)).alias("n_terms")
    )


def occurrence_thresholds(stats: DataFrame, value: str = "cf", limit: int = 10) -> DataFrame:
    return stats.agg(
        F.count_if(F.col(value) == 1).alias("n_once"),
        F.count_if(F.col(value) > limit).alias("n_above"),
        F.count_if(F.col(value) <= limit).alias("n_up_to"),
    )


def occurrence_ratio_curve(stats: DataFrame, upto: int = 100, value: str = "cf") -> DataFrame:
    """For each i below ``upto``: terms occurring fewer than i times per term occurring at least i times."""
    level = F.least(F.col(value), F.lit(upto)).alias("i")
    per_level = stats.groupBy(level).agg(F.count(F.lit(1)).alias("n"))
    levels = stats.sparkSession.range(upto + 1).withColumnRenamed("id", "i")
    everything = Window.orderBy("i")  # upto + 1 rows
    below = F.sum("n").over(everything.rowsBetween(Window.unboundedPreceding, -1))
    from_here = F.sum("n").over(everything.rowsBetween(0, Window.unboundedFollowing))
    filled = levels.join(per_level, "i", "left").na.fill(0, ["n"])
    curve = filled.select("i", F.try_divide(F.coalesce(below, F.lit(0)), from_here).alias("ratio"))
    return curve.where(F.col("i") < upto)


def duplicate_count(df: DataFrame, key: Column) -> DataFrame:
    """Rows whose key already occurred in an earlier row: all copies but one, whichever comes first."""
    groups = df.groupBy(F.sha2(key.cast("binary"), 256).alias("_key")).count()
    return groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicates"))


def hist2d(points: DataFrame, x: str, y: str, bins: int = 100) -> DataFrame:
    """``(x_bin, y_bin, n)``: counts on a grid between the smallest and largest values."""
    bounds = points.agg(
        F.struct(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).alias("b")
    )
    boxed = points.withColumn("_b", bounds.scalar())

    def place(column: str, low: str, high: str) -> Column:
        span = F.col(f"_b.{high}") - F.col(f"_b.{low}")
        position = F.floor((F.col(column) - F.col(f"_b.{low}")) / span * bins)
        return F.when(span > 0, F.least(position, F.lit(bins - 1))).otherwise(0).cast("long")

    return boxed.groupBy(place(x, "x0", "x1").alias("x_bin"), place(y, "y0", "y1").alias("y_bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
