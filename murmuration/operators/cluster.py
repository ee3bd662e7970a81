"""k-means on sparse rows, and exact planar neighbour queries: k nearest distances and DBSCAN.

The planar operators place points on grids. Equal points are merged first, and each grid is chosen so
that the pairs looked at stay proportional to the number of points however dense a spot is.
"""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.operators.sampling import top_per_group
from murmuration.operators.skew import global_rank, skew_join
from murmuration.session import cut_lineage

# --- k-means


def kmeans(features: DataFrame, k: int = 10, max_iter: int = 1000, seed: int = 0, column: str = "features"):
    """A fitted model; rows stay sparse and none are left out."""
    return KMeans(k=k, maxIter=max_iter, seed=seed, featuresCol=column, predictionCol="cluster").fit(features)


def centre_distances(points: DataFrame, centres: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``(id, cluster, distance)`` to every centre ``(cluster, centre)``; the few centres travel as one value."""
    listed = centres.agg(F.collect_list(F.struct("cluster", "centre"))).scalar()
    pairs = points.select(id_col, vector, F.explode(listed).alias("c"))
    square = F.aggregate(
        F.zip_with(vector, "c.centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v
    )
    return pairs.select(id_col, F.col("c.cluster").alias("cluster"), F.sqrt(square).alias("distance"))


def cluster_distinct_terms(centres: DataFrame, top: int = 100, n: int = 5) -> DataFrame:
    """``(cluster, rank, term)``: the first ``n`` of each centre's ``top`` terms that no other centre has
    among its own ``top``."""
    leading = top_per_group(centres, "cluster", [F.desc("weight"), F.col("term")], top, "_rank")
    alone = leading.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("term"))).where("_n = 1")
    return top_per_group(alone, "cluster", [F.col("_rank")], n).select("cluster", "rank", "term")


# --- planar points


FINEST = 60  # halvings of a grid; cell numbers then still fit 64 bits


def merge_equal(points: DataFrame, id_col: str) -> DataFrame:
    """``(p, x, y, w)``: distinct positions, named by their smallest id, with their number of points."""
    return points.groupBy("x", "y").agg(F.min(id_col).alias("p"), F.count(F.lit(1)).alias("w"))


def to_members(points: DataFrame, per_position: DataFrame, rows: int) -> DataFrame:
    """Results per distinct position back to every point there."""
    place = F.struct("x", "y")
    places = per_position.withColumn("_place", place).drop("x", "y")
    return skew_join(points.withColumn("_place", place), places, "_place", "w", "id", rows=rows).drop("_place")


def neighbour_cells(cx: Column, cy: Column, reach: int) -> Column:
    steps = range(-reach, reach + 1)
    return F.array(*[F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in steps for j in steps])


def knn_distances(points: DataFrame, id_col: str, k: int = 4) -> DataFrame:
    """``(id, nn, distance)`` for nn = 0..k-1, the point itself being the first. Exact.

    Square grids are halved level by level. A point uses the finest level at which its own cell holds k
    points: its k nearest then lie within the cell's diagonal, so inside the 5 x 5 cells around. At any
    level a cell holds fewer than 4k points that use this level, so a dense cell meets at most 100k others. Where a
    few far points stretch the grid, it is halved further until its finest cells hold few positions.
    """
    named = points.withColumnRenamed(id_col, "id")
    unique = cut_lineage(merge_equal(named, "id"), "positions")
    box = unique.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1)), F.sum("w")).first()
    if not box[4]:
        return points.select(F.col(id_col), F.lit(0).alias("nn"), F.lit(0.0).alias("distance")).limit(0)
    span = max(box[1] - box[0], box[3] - box[2]) or 1.0

    def cell(column: str, low: float) -> Column:
        return F.floor((F.col(column) - low) / span * F.pow(F.lit(2.0), "level")).cast("long")

    levels = math.ceil(math.log(box[4] + 1, 4)) + 8
    while levels < FINEST:
        finest = unique.withColumn("level", F.lit(levels)).groupBy(cell("x", box[0]), cell("y", box[2])).count()
        if finest.agg(F.max("count")).first()[0] < 4 * k:
            break
        levels += 8
    levels = min(levels, FINEST)

    placed = unique.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).select(
        "p", "x", "y", "w", F.struct("level", cell("x", box[0]).alias("cx"), cell("y", box[2]).alias("cy")).alias("cell")
    )
    n_placed = box[4] * (levels + 1)
    sizes = placed.groupBy("cell").agg(F.sum("w").alias("held"), F.count(F.lit(1)).alias("rows"))
    full = sizes.where((F.col("held") >= k) | (F.col("cell.level") == 0))
    own = (
        skew_join(placed.select("p", "x", "y", "cell"), full, "cell", "rows", "p", rows=n_placed)
        .groupBy("p", "x", "y")
        .agg(F.max("cell").alias("cell"))
    )
    around = neighbour_cells(F.col("cell.cx"), F.col("cell.cy"), 2)
    probes = own.select(F.col("p").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy"), "cell.level", F.explode(around).alias("c"))
    probes = probes.select("q", "qx", "qy", F.struct("level", F.col("c.cx").alias("cx"), F.col("c.cy").alias("cy")).alias("cell"))
    met = skew_join(placed, probes, "cell", "rows", "p", sizes=sizes, rows=n_placed)
    square = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))
    nearest = top_per_group(
        met.select("q", "qx", "qy", "p", "w", F.sqrt(square).alias("d")), ["q", "qx", "qy"], [F.col("d"), F.col("p")], k, "r"
    )
    listed = nearest.groupBy("q", "qx", "qy").agg(F.array_sort(F.collect_list(F.struct("r", "d", "w"))).alias("l"))
    repeated = F.flatten(F.transform("l", lambda e: F.array_repeat(e["d"], F.least(e["w"], F.lit(k)).cast("int"))))
    per_position = listed.select(F.col("qx").alias("x"), F.col("qy").alias("y"), F.slice(repeated, 1, k).alias("ds"))
    counted = per_position.join(unique.select("x", "y", "w"), ["x", "y"])
    return to_members(named, counted, box[5]).select(F.col("id").alias(id_col), F.posexplode("ds").alias("nn", "distance"))


def knn_curve(distances: DataFrame, id_col: str, nn: int = 1) -> DataFrame:
    """``(position, distance)``: the nn-th neighbour distances in rising order, ranked piece by piece.

    Equal distances are merged before ranking, so a value many points share stays one row.
    """
    values = distances.where(F.col("nn") == nn).groupBy("distance").count()
    ranked = cut_lineage(global_rank(values, "distance", "r"), "curve")
    pieces = ranked.withColumn("_piece", F.floor(F.col("r") / 100_000))
    inside = F.sum("count").over(Window.partitionBy("_piece").orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    totals = pieces.groupBy("_piece").agg(F.sum("count").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("_piece", before.alias("_before"))
    last = pieces.withColumn("_inside", inside).join(offsets, "_piece").withColumn("last", F.col("_inside") + F.col("_before"))
    return last.select(
        F.explode(F.sequence(F.col("last") - F.col("count") + 1, F.col("last"))).alias("position"), "distance"
    )


# --- connected components


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` with the smallest node of each component as its name.

    Alternating star contraction: every round links each node's larger (then smaller) neighbours to the
    smallest node around, which needs logarithmically many rounds even for long chains. Links at a
    node with very many neighbours are spread over tasks. Each round is written out.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = cut_lineage(links, "links")
    nodes = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()
    seen, size = None, links.count()
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        stars = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("degree"))
        large = skew_join(both, stars, "u", "degree", "v", rows=2 * size).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
        small = skew_join(large, least, "u", "degree", "v", rows=2 * size).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut_lineage(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            named = links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
            return nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        seen, size = state, state[0]
    raise RuntimeError("components did not settle")


# --- DBSCAN


def _gap(low_a: str, high_a: str, low_b: str, high_b: str, far: bool) -> Column:
    """Smallest or largest distance of two intervals."""
    a0, a1, b0, b1 = (F.col(c) for c in (low_a, high_a, low_b, high_b))
    if far:
        return F.greatest(F.abs(a1 - b0), F.abs(b1 - a0))
    return F.greatest(b0 - a1, a0 - b1, F.lit(0.0))


def _box_distance(far: bool) -> Column:
    x = _gap("ax0", "ax1", "bx0", "bx1", far)
    y = _gap("ay0", "ay1", "by0", "by1", far)
    return x * x + y * y


def touching_cells(dense: DataFrame, sizes: DataFrame, eps: float, side: float, rows: int) -> DataFrame:
    """``(a, b)`` pairs of full cells with two points within ``eps``, found without pairing points.

    Cells are compared by the boxes of their points. Boxes wholly within eps settle a pair, boxes
    wholly beyond it are dropped, and only undecided boxes are halved and compared again; a box of one
    position always decides. ``dense``: ``(node, cell, x, y)`` distinct positions of full cells.
    """
    limit = eps * eps

    def boxes(points: DataFrame, depth: int) -> DataFrame:
        part = side / 2**depth
        return points.withColumn(
            "sub", F.struct(F.floor(F.col("x") / part).alias("sx"), F.floor(F.col("y") / part).alias("sy"))
        ).groupBy("node", "cell", "sub").agg(
            F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
        )

    def side_of(name: str, frame: DataFrame, extra: list[str] = ()) -> DataFrame:
        renamed = [F.col(c).alias(f"{name}{c}") for c in ("x0", "x1", "y0", "y1")]
        return frame.select(F.col("node").alias(name), F.col("sub").alias(f"{name}sub"), *renamed, *extra)

    first = boxes(dense, 0)
    around = first.select("*", F.explode(neighbour_cells(F.col("cell.cx"), F.col("cell.cy"), 2)).alias("near"))
    pairs = side_of("a", around, ["near"]).join(side_of("b", first, [F.col("cell").alias("near")]), "near").where("a < b")
    found = None
    for depth in range(1, 1075):
        judged = pairs.select(
            "a", "b", "asub", "bsub", _box_distance(False).alias("near2"), _box_distance(True).alias("far2")
        ).where(F.col("near2") <= limit)
        judged = cut_lineage(judged, "boxes")
        joined = judged.where(F.col("far2") <= limit).select("a", "b").distinct()
        found = joined if found is None else found.union(joined).distinct()
        open_pairs = judged.where(F.col("far2") > limit).join(found, ["a", "b"], "left_anti").select("a", "b", "asub", "bsub")
        open_pairs = cut_lineage(open_pairs, "open")
        if open_pairs.isEmpty():
            return found
        wanted = open_pairs.select(F.col("a").alias("node")).union(open_pairs.select("b")).distinct()
        inside = skew_join(dense, wanted, "node", "rows", ["x", "y"], sizes=sizes, rows=rows)
        children = boxes(inside, depth).withColumn(
            "parent", F.struct(F.floor(F.col("sub.sx") / 2).alias("sx"), F.floor(F.col("sub.sy") / 2).alias("sy"))
        )
        halves = open_pairs.withColumnsRenamed({"asub": "ap", "bsub": "bp"})
        pairs = halves.join(side_of("a", children, [F.col("parent").alias("ap")]), ["a", "ap"]).join(
            side_of("b", children, [F.col("parent").alias("bp")]), ["b", "bp"]
        )
    raise RuntimeError("boxes did not separate")


def dbscan(points: DataFrame, id_col: str, eps: float = 0.29, min_samples: int = 4) -> DataFrame:
    """``(id, label)``: cluster numbers by each cluster's smallest core id, -1 for noise. Exact, planar.

    Cells have the diagonal eps, so a cell with ``min_samples`` points is all core and one node. Only
    points of thinner cells look around; a cell meets at most 25 * (min_samples - 1) of them. A border
    point joins the lowest-numbered cluster it touches.
    """
    named = points.withColumnRenamed(id_col, "id")
    side = eps / math.sqrt(2) * (1 - 1e-9)  # rounding must not let a cell outgrow eps
    cell = F.struct(F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"))
    unique = cut_lineage(merge_equal(named, "id").withColumn("cell", cell), "positions")
    cells = cut_lineage(
        unique.groupBy("cell").agg(
            F.sum("w").alias("held"), F.count(F.lit(1)).alias("rows"), F.min("p").alias("first")
        ).withColumn("full", F.col("held") >= min_samples),
        "cells",
    )
    n_unique, n_points = unique.agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0))).first()
    placed = cut_lineage(
        skew_join(unique, cells.drop("held"), "cell", "rows", "p", rows=n_unique).withColumn(
            "node", F.when(F.col("full"), F.col("first")).otherwise(F.col("p"))
        ),
        "placed",
    )
    thin = placed.where(~F.col("full")).select(
        F.col("p").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy"),
        F.explode(neighbour_cells(F.col("cell.cx"), F.col("cell.cy"), 2)).alias("cell"),
    )
    square = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))
    cell_rows = cells.select("cell", "rows")
    near = skew_join(placed.drop("rows"), thin, "cell", "rows", "p", sizes=cell_rows, rows=n_unique).where(square <= eps * eps)
    touched = cut_lineage(near.groupBy("q", "node", "full").agg(F.sum("w").alias("w")), "touched")
    core = touched.groupBy("q").agg(F.sum("w").alias("w")).where(F.col("w") >= min_samples).select("q")
    solid = touched.where("full").unionByName(
        touched.where("not full").join(core.select(F.col("q").alias("node")), "node", "left_semi")
    )
    full_cells = cells.where("full")
    node_sizes = full_cells.select(F.col("first").alias("node"), "rows")
    dense = placed.where("full").select("node", "cell", "x", "y")
    links = (
        solid.join(core, "q", "left_semi").select(F.col("q").alias("a"), F.col("node").alias("b"))
        .unionByName(touching_cells(dense, node_sizes, eps, side, n_unique))
    )
    cores = node_sizes.select("node").union(core.select(F.col("q").alias("node")))
    named_cores = cores.join(connected_components(links), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
    border = (
        solid.join(core, "q", "left_anti").join(named_cores, "node").groupBy("q").agg(F.min("component").alias("component"))
    )
    by_node = named_cores.unionByName(border.select(F.col("q").alias("node"), "component"))
    numbers = cut_lineage(by_node.select("component").distinct(), "clusters")
    numbered = global_rank(numbers, "component", "label").withColumn("label", F.col("label") - 1)
    labelled = by_node.join(numbered, "component").select("node", "label")
    rows_of = cells.select(F.when(F.col("full"), F.col("first")).alias("node"), "rows").where("node is not null")
    sizes = labelled.join(rows_of, "node", "left").na.fill(1, ["rows"])
    members = placed.select("p", "x", "y", "w", "node")
    per_position = skew_join(members, sizes, "node", "rows", "p", how="left", rows=n_unique)
    labels = per_position.select("x", "y", "w", F.coalesce("label", F.lit(-1)).alias("label"))
    result = to_members(named, labels, n_points)
    return result.select(F.col("id").alias(id_col), "label")
