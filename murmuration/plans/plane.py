"""Vectors as points of a plane, for the planar operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmuration.plans.registry import table

# two fixed projections that use every value; sums of whole numbers, so that any order gives the same
PLANE = (
    "q AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 65536) AS BIGINT)) AS v FROM embeddings), "
    "p AS (SELECT vec_id, list_sum(list_transform(v, lambda e, i: CASE WHEN i % 2 = 1 THEN e ELSE -e END)) / 65536.0::DOUBLE AS x, "
    "list_sum(list_transform(v, lambda e, i: CASE WHEN (i - 1) % 4 < 2 THEN e ELSE -e END)) / 65536.0::DOUBLE AS y FROM q)"
)


def plane(spark, sf_dir):
    """Every vector's two fixed projections."""
    whole = F.transform("embedding", lambda e: F.floor(e.cast("double") * 65536))

    def along(positive):
        signed = F.transform(whole, lambda e, i: F.when(positive(i), e).otherwise(-e))
        return F.aggregate(signed, F.lit(0).cast("long"), lambda a, b: a + b) / F.lit(65536.0)

    return table(spark, sf_dir, "embeddings").select(
        "vec_id", along(lambda i: i % 2 == 0).alias("x"), along(lambda i: i % 4 < 2).alias("y")
    )
