"""Exact neighbours in any number of dimensions: k nearest points and DBSCAN over a partition by pivots.

Every position belongs to the cell of its nearest pivot, and a cell knows its radius. A point visits another cell only if a
point there can be near enough: not if its distance to that pivot, less the cell's radius, or its distance to the
plane between the two pivots, is beyond its reach. Neighbouring cells share a tile, to which a visitor travels once; large
cells are dealt to several. Tiles and the visitors that meet there are bounded, so no task grows with a cell.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmuration.operators.cluster import connected_components
from murmuration.operators.skew import skew_join
from murmuration.session import cut_lineage

PIVOTS = 2048  # cells at most
CELL_ROWS = 256  # positions a cell holds while there are fewer pivots than that
TILE_ROWS = 32768  # positions of either side of a task at most
TILE_VALUES = 1 << 21  # components of either side of a task, 16 MB as doubles
TILE_LEAST, TILES = 2048, 6  # fewer positions make smaller tiles, about six, but none below this many rows
MOST_TASKS = 4096
SLAB_PAIRS = 1 << 22  # pairs of positions judged at a time, 32 MB
SLACK = 1e-9  # relative, above the rounding of distances that only decide where to look


def positions(points: DataFrame, id_col: str, vector: str, k: int) -> tuple[DataFrame, DataFrame]:
    """``(id, v)`` of all usable points, and distinct positions ``(node, dims, w, ids, v)``: their number of points and the
    ``k`` smallest ids there. Vectors that are null, empty or hold null or non-finite components, and points without an
    id, are left out."""
    x = F.col(vector).cast("array<double>")
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & (F.size(x) > 0) & F.col(id_col).isNotNull()
    rows = points.where(sound).select(F.col(id_col).alias("id"), F.transform(x, lambda e: e + F.lit(0.0)).alias("v"))  # no negative zeros
    rows = cut_lineage(rows, "points")
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))  # tasks keep k rows of a position before they meet
    first = rows.withColumn("r", rank).where(F.col("r") <= k).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    held = rows.groupBy("v").agg(F.count(F.lit(1)).alias("w")).join(first, "v")
    named = held.select(F.monotonically_increasing_id().alias("node"), F.size("v").alias("dims"), "w", "ids", "v")
    return rows, cut_lineage(named, "positions")  # written, so the numbers stay


def matrix(column) -> np.ndarray:
    """A list column of equal lengths as rows of an array."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def rough_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by a product; off by rounding, never by more than ``SLACK`` of the squared lengths."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0)


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(axis=1))


def pair_distances(a: np.ndarray, b: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Exact distances of the pairs ``a[row], b[col]``, a bounded number at a time."""
    step = max(1, TILE_VALUES // a.shape[1])
    parts = [exact_distances(a[row[i : i + step]], b[col[i : i + step]]) for i in range(0, len(row), step)]
    return np.concatenate(parts) if parts else np.empty(0)


def lifted(v: np.ndarray, host: bool) -> np.ndarray:
    """Vectors with two components more, so that guests times hosts are squared distances as ``rough_squares`` has them."""
    square, one = (v * v).sum(axis=1)[:, None], np.ones((len(v), 1))
    return np.hstack([-2 * v, one, square] if host else [v, square, one])


@dataclass
class Cells:
    """Pivots, the radius and the block of each cell, and how many tiles a block is dealt to; bounded by ``PIVOTS`` whatever
    the table. Only a block of one cell has more than one tile."""

    pivots: np.ndarray
    radius: np.ndarray
    block: np.ndarray
    tiles: np.ndarray
    size: float  # the largest length of a vector, for the slack
    rows: int  # positions of a tile at most

    def slack(self) -> float:
        return float(np.sqrt(SLACK) * self.size) if self.size else 0.0

    def own(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = np.concatenate([rough_squares(v[i : i + 1024], self.pivots).argmin(axis=1) for i in range(0, len(v), 1024)])
        return cell, exact_distances(v, self.pivots[cell])

    def near(self, v: np.ndarray, cell: np.ndarray, reach: np.ndarray, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``(row, place)``: every cell, by its place in ``among`` or of all, in which a point may lie within a row's reach."""
        among = np.arange(len(self.pivots)) if among is None else among
        pivots, radius, rows, places = self.pivots[among], self.radius[among], [], []
        for first in range(0, len(v), 1024):
            part = slice(first, first + 1024)
            square = rough_squares(v[part], pivots)
            own = exact_distances(v[part], self.pivots[cell[part]]) ** 2
            of, which = np.unique(cell[part], return_inverse=True)
            between = np.sqrt(rough_squares(self.pivots[of], pivots))
            between[of[:, None] == among] = 0
            between = between[which]
            plane = np.divide(square - own[:, None], 2 * between, out=np.zeros_like(square), where=between > 0)
            good = (np.maximum(np.sqrt(square) - radius, plane) <= (reach[part] + 2 * self.slack())[:, None]) & (radius >= 0)
            row, place = np.nonzero(good)
            rows.append(row + first)
            places.append(place)
        return np.concatenate(rows), np.concatenate(places)

    def blocks(self, batch: pa.RecordBatch, only=None) -> tuple[np.ndarray, np.ndarray]:
        """``(row, block)``: where the rows of a batch of visitors go, each to a block once; ``only`` may leave some out."""
        row, found = self.near(matrix(batch.column("v")), batch.column("cell").to_numpy(), batch.column("reach").to_numpy())
        both = np.unique(row * len(self.tiles) + self.block[found])
        row, block = both // len(self.tiles), both % len(self.tiles)
        if only is None:
            return row, block
        kept = only(self, batch, row, block)
        return row[kept], block[kept]

    def slabs(self, guests: pa.Table, hosts: pa.Table):
        """``(guest rows, host rows, rough squared distances)`` of all pairs of which one may be within its guest's reach."""
        v, cell, reach = matrix(guests["v"]), guests["cell"].to_numpy(), guests["reach"].to_numpy()
        others, of = matrix(hosts["v"]), hosts["cell"].to_numpy()
        order = np.argsort(of, kind="stable")
        there, begins = np.unique(of[order], return_index=True)
        ends = np.append(begins[1:], len(of))
        left, right = lifted(v, False), lifted(others[order], True)
        by = np.argsort(cell, kind="stable")
        step = max(1, SLAB_PAIRS // len(of))
        for first in range(0, len(by), step):
            some = by[first : first + step]
            reached = np.unique(self.near(v[some], cell[some], reach[some], there)[1])
            if len(reached) == len(there):
                yield some, order, left[some] @ right.T
            elif len(reached):
                at = np.concatenate([np.arange(begins[c], ends[c]) for c in reached])
                yield some, order[at], left[some] @ right[at].T


def packed(pivots: np.ndarray, counts: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """``(block of each cell, tiles of each block)``: cells one after the other, the nearest of those left next, share a
    block while they hold ``rows`` positions at most. A larger cell is a block of several tiles."""
    apart, left = rough_squares(pivots, pivots), np.ones(len(pivots), bool)
    block, tiles, held, at = np.zeros(len(pivots), int), [], rows, 0
    for _ in range(len(pivots)):
        left[at] = False
        if not tiles or held + counts[at] > rows:
            tiles.append(max(1, -(-int(counts[at]) // rows)))
            held = 0
        block[at] = len(tiles) - 1
        held += counts[at]
        at = int(np.where(left, apart[at], np.inf).argmin())
    return block, np.array(tiles)


def celled(nodes: DataFrame, payload: list[str]) -> tuple[DataFrame, Cells, int]:
    """Positions with their cell, block and tile ``(node, v, ..., cell, block, tile)``, the cells, and the number of positions."""
    spark, n = nodes.sparkSession, nodes.count()
    wanted = min(PIVOTS, max(1, -(-n // CELL_ROWS)))
    picked = nodes.orderBy(F.xxhash64("v"), "v").limit(wanted).select("v").collect()
    size = nodes.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)))).first()[0]
    pivots = np.array([r["v"] for r in picked], float).reshape(len(picked), -1)
    rows = max(1, min(TILE_ROWS, TILE_VALUES // max(1, pivots.shape[1]), max(TILE_LEAST, -(-n // TILES))))
    cells = Cells(pivots, np.full(len(picked), -1.0), np.zeros(len(picked), int), np.ones(1, int), size or 0.0, rows)
    shared = spark.sparkContext.broadcast(cells)
    columns = ["node", "v", *payload]

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                cell, away = shared.value.own(matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)], names=[*columns, "cell", "away"])

    schema = nodes.select(*columns).withColumns({"cell": F.lit(0), "away": F.lit(0.0)}).schema
    placed = cut_lineage(nodes.select(*columns).mapInArrow(place, schema), "cells")
    counts = np.zeros(len(picked), int)
    for row in placed.groupBy("cell").agg(F.max("away").alias("r"), F.count(F.lit(1)).alias("n")).collect():  # at most PIVOTS rows
        cells.radius[row["cell"]], counts[row["cell"]] = row["r"], row["n"]
    cells.block, cells.tiles = packed(pivots, counts, rows)
    placed = placed.withColumn("block", F.element_at(F.lit(cells.block.tolist()), F.col("cell") + 1).cast("int"))
    tiles = F.element_at(F.lit(cells.tiles.tolist()), F.col("block") + 1)
    return placed.withColumn("tile", F.pmod(F.xxhash64("node"), tiles).cast("int")).drop("away"), cells, n


def visit(home: DataFrame, visitors: DataFrame, cells: Cells, meet, schema: str, carried: list[str], only=None) -> tuple[DataFrame, int]:
    """Let ``visitors`` ``(node, v, cell, reach, ...)`` meet the tiles of ``home`` they can reach, and count the visits.

    ``meet(visitor table, home table)`` gives an Arrow table of ``schema``; both hold ``node``, ``v``, ``cell`` and their own
    columns. ``only(cells, batch, row, block)`` says which visits are wanted where not all are.
    """
    shared = home.sparkSession.sparkContext.broadcast(cells)
    columns = ["node", "v", "cell", "reach", *carried]
    source = visitors.select(*columns)

    def homes(batches):
        for batch in batches:
            if batch.num_rows:
                block, count = np.unique(shared.value.blocks(batch, only)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array(count.astype(np.int64))], names=["home", "n"])

    counted = source.mapInArrow(homes, "home int, n long").groupBy("home").agg(F.sum("n").alias("n")).collect()  # at most PIVOTS rows
    chunks = np.zeros(len(cells.tiles), int)
    for row in counted:
        chunks[row["home"]] = -(-row["n"] // cells.rows)

    def travel(batches):
        known = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            row, found = known.blocks(batch, only)
            node = batch.column("node").to_numpy()[row]
            chunk = (node * 0x9E3779B1 >> 7) % chunks[found]
            times = known.tiles[found]
            at = np.repeat(np.arange(len(row)), times)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            keys = [pa.array(x.astype(np.int32)) for x in (found[at], piece, chunk[at])]
            for first in range(0, len(at), 4096):
                part = slice(first, first + 4096)
                rows = batch.take(pa.array(row[at[part]]))
                yield pa.RecordBatch.from_arrays([*(k[part] for k in keys), *rows.columns], names=["home", "piece", "chunk", *columns])

    keyed = source.withColumns({"home": F.lit(0), "piece": F.lit(0), "chunk": F.lit(0)}).select("home", "piece", "chunk", *columns)
    moved = source.mapInArrow(travel, keyed.schema)
    many = F.element_at(F.lit(chunks.tolist()), F.col("block") + 1)
    visited = home.where(many > 0)  # tiles that no one visits stay where they are
    own = visited.select(F.col("block").alias("home"), F.col("tile").alias("piece"), F.explode(F.sequence(F.lit(0), (many - 1).cast("int"))).alias("chunk"), *[c for c in home.columns if c not in ("block", "tile")])

    empty = pa.schema([(f.name, pa.int64() if f.dataType.typeName() == "long" else pa.float64()) for f in home.sparkSession.createDataFrame([], schema).schema])

    def run(guests: pa.Table, hosts: pa.Table) -> pa.Table:
        if not guests.num_rows or not hosts.num_rows:
            return empty.empty_table()
        return meet(guests, hosts)

    keys = ["home", "piece", "chunk"]
    tasks = max(1, min(MOST_TASKS, 2 * int((chunks * cells.tiles).sum())))  # few bytes, much work: not to be put together by size
    guests, hosts = (x.repartition(tasks, *keys).groupBy(*keys) for x in (moved, own))
    return cut_lineage(guests.cogroup(hosts).applyInArrow(run, schema), "met"), sum(r["n"] for r in counted)


def in_tiles(home: DataFrame, cells: Cells, run, schema: str) -> DataFrame:
    """What ``run(table)`` gives for each tile."""
    keys = ["block", "tile"]
    return home.repartition(min(MOST_TASKS, 2 * int(cells.tiles.sum())), *keys).groupBy(*keys).applyInArrow(run, schema)


# --- k nearest


def _kth(square: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """For each row the least square within which others of weight ``k`` lie; infinite where they are too few."""
    n = min(k, square.shape[1])
    at = np.argpartition(square, n - 1, axis=1)[:, :n]
    near = np.take_along_axis(square, at, axis=1)
    order = np.argsort(near, axis=1)
    enough = np.cumsum(w[np.take_along_axis(at, order, axis=1)], axis=1) >= k
    last = np.take_along_axis(near, np.take_along_axis(order, enough.argmax(axis=1)[:, None], axis=1), axis=1)[:, 0]
    return np.where(enough.any(axis=1), last, np.inf)


def _nearest(square: np.ndarray, v: np.ndarray, others: np.ndarray, at: np.ndarray, lists: list[np.ndarray], reach: np.ndarray, k: int, slack: float):
    """``(row, distance, id)``: for each row the first ``k`` by distance, then id, of the ids of ``others[at]`` within its reach."""
    near = square <= ((reach + slack) ** 2)[:, None]
    many = np.flatnonzero(near.sum(axis=1) > 4 * k)
    if len(many):  # enough that the rest cannot be among the first
        limit = np.sqrt(np.maximum(np.partition(square[many], k, axis=1)[:, k], 0)) + 2 * slack
        near[many] &= square[many] <= (limit**2)[:, None]
    row, col = np.nonzero(near)
    col = at[col]
    distance = pair_distances(v, others, row, col)
    sizes = np.array([len(lists[x]) for x in col], int)
    each = np.repeat(np.arange(len(row)), sizes)
    ids = np.concatenate([lists[x] for x in col]) if len(col) else np.empty(0, np.int64)
    order = np.lexsort((ids, distance[each], row[each]))
    row, distance, ids = row[each][order], distance[each][order], ids[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], distance[first], ids[first]


def _bound(shared: Broadcast, k: int, slack: float):
    """A function that bounds the k-th distance of a tile's positions by what the tile itself holds."""

    def bound(table: pa.Table) -> pa.Table:
        v, w, cell = matrix(table["v"]), table["w"].to_numpy(), table["cell"].to_numpy()
        reach = np.full(len(v), np.inf)
        for of in np.unique(cell):  # by part of the cell first, so that few other cells of the tile need to be looked at
            there = np.flatnonzero(cell == of)
            known = there[:TILE_LEAST]
            for part in np.array_split(there, -(-len(there) * len(known) // SLAB_PAIRS)):
                reach[part] = np.sqrt(_kth(rough_squares(v[part], v[known]), w[known], k)) + slack
        for some, at, square in shared.value.slabs(table.append_column("reach", pa.array(reach)), table):
            reach[some] = np.minimum(reach[some], np.sqrt(np.maximum(_kth(square, w[at], k), 0)) + slack)
        return pa.table({"node": table["node"], "reach": pa.array(reach)})

    return bound


def _meet(shared: Broadcast, k: int, slack: float):
    """A function that finds the guests' nearest in a tile."""

    def meet(guests: pa.Table, hosts: pa.Table) -> pa.Table:
        lists = [np.array(x, np.int64) for x in hosts["ids"].to_pylist()]
        v, others, reach, node = matrix(guests["v"]), matrix(hosts["v"]), guests["reach"].to_numpy(), guests["node"].to_numpy()
        out = []
        for some, at, square in shared.value.slabs(guests, hosts):
            row, distance, ids = _nearest(square, v[some], others, at, lists, reach[some], k, slack)
            out.append((node[some[row]], distance, ids))
        node, distance, ids = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, int), np.empty(0), np.empty(0, int))
        return pa.table({"node": pa.array(node), "distance": pa.array(distance), "neighbour": pa.array(ids)})

    return meet


def knn(points: DataFrame, k: int = 4, id_col: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, dict]:
    """``(id, nn, neighbour, distance)`` for nn = 0..k-1, the point itself being the first, then others by distance and id; and
    how much work it was. Exact, Euclidean, in as many dimensions as the vectors have.

    A tile of the point's own cell gives a first bound on its k-th distance; with that reach it visits the tiles that may hold
    nearer points. Only points of as many components are compared; ids must be whole numbers and unique.
    """
    rows, nodes = positions(points, id_col, vector, k)
    results, work = None, {"positions": 0, "visits": 0, "cells": 0}
    for size in nodes.groupBy("dims").count().collect():  # a row for each number of components
        part = nodes.where(F.col("dims") == size["dims"])
        home, cells, n = celled(part, ["w", "ids"])
        shared, slack = rows.sparkSession.sparkContext.broadcast(cells), 2 * cells.slack()
        reach = in_tiles(home, cells, _bound(shared, k, slack), "node long, reach double")
        visitors = cut_lineage(home.join(reach, "node"), "reach")
        met, visits = visit(home, visitors, cells, _meet(shared, k, slack), "node long, distance double, neighbour long", [])
        results = met if results is None else results.unionByName(met)
        work = {"positions": work["positions"] + n, "visits": work["visits"] + visits, "cells": work["cells"] + len(cells.pivots)}
    if results is None:
        empty = rows.select("id", F.lit(0).alias("nn"), F.col("id").alias("neighbour"), F.lit(0.0).alias("distance"))
        return empty.withColumnRenamed("id", id_col), work
    best = results.groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))), 1, k).alias("near"))
    near = nodes.select("node", "v", "w").join(best, "node").select("v", "w", "near")
    joined = skew_join(rows, cut_lineage(near, "near"), "v", "w", "id", rows=rows.count())
    others = F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("id")), 1, k - 1)
    listed = F.concat(F.array(F.struct(F.lit(0.0).alias("distance"), F.col("id").cast("long").alias("neighbour"))), others)
    out = joined.select("id", F.posexplode(listed).alias("nn", "x"))
    return out.select(F.col("id").alias(id_col), "nn", F.col("x.neighbour").alias("neighbour"), F.col("x.distance").alias("distance")), work


# --- DBSCAN


def dbscan(points: DataFrame, eps: float, min_pts: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, cluster, core)``: clusters named by the smallest id of their core points, -1 for noise, in any number of dimensions.

    A point is a core if at least ``min_pts`` points, itself included, are within ``eps``. Cores within ``eps`` of each other
    are of one cluster; another point within ``eps`` of a core joins the lowest-numbered cluster it touches. Every point
    visits the cells its eps-ball reaches; tasks give out counts, links that join sets, and one cluster a point, never all pairs.
    """
    rows, nodes = positions(points, id_col, vector, 1)
    found = None
    for size in nodes.groupBy("dims").count().collect():
        part = _clusters(nodes.where(F.col("dims") == size["dims"]), eps, min_pts)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(F.col("id").alias(id_col), F.lit(-1).cast("long").alias("cluster"), F.lit(False).alias("core"))
    named = cut_lineage(nodes.select("node", "v", "w").join(found, "node").select("v", "w", "cluster", "core"), "clusters")
    joined = skew_join(rows, named, "v", "w", "id", rows=rows.count())
    return joined.select(F.col("id").alias(id_col), "cluster", "core")


def _within(square: np.ndarray, v: np.ndarray, others: np.ndarray, at: np.ndarray, eps: float, size: float) -> np.ndarray:
    """Which pairs with ``others[at]`` are within eps, of their rough squared distances; those that these leave open are computed again."""
    limit, open_ = eps * abs(eps), 4 * SLACK * size * size
    near = square <= limit + open_
    row, col = np.nonzero(near & (square > limit - open_))
    near[row, col] = pair_distances(v, others, row, at[col]) <= eps
    return near


def _united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Let linked names ``a[i], b[i]`` have one label, the least, and give the labels that were tied to others for it."""
    tied = []
    while True:
        differ = label[a] != label[b]
        if not differ.any():
            return tied
        a, b = a[differ], b[differ]
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        parent = np.arange(len(label))
        np.minimum.at(parent, high, low)
        roots = np.unique(high)
        tied.append((roots, parent[roots]))
        while (parent != parent[parent]).any():
            parent = parent[parent]
        label[:] = parent[label]


def _across(cells: Cells, batch: pa.RecordBatch, row: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Of each two blocks one visits the other, and one dealt to several tiles itself."""
    own = cells.block[batch.column("cell").to_numpy()][row]
    return (block > own) | ((block == own) & (cells.tiles[own] > 1))


def _clusters(nodes: DataFrame, eps: float, min_pts: int) -> DataFrame:
    """Most cores are known from their own tile alone, and only the others are counted everywhere. Cores are then tied to
    sets: within tiles, with the next block, and at last with all blocks that hold a core of another set."""
    home, cells, _ = celled(nodes.withColumn("least", F.element_at("ids", 1).cast("long")), ["w", "least"])
    home = home.withColumn("reach", F.lit(float(eps)))
    shared, size = nodes.sparkSession.sparkContext.broadcast(cells), cells.size

    def pairs(guests: pa.Table, hosts: pa.Table):
        v, others = matrix(guests["v"]), matrix(hosts["v"])
        for some, at, square in shared.value.slabs(guests, hosts):
            yield some, at, _within(square, v[some], others, at, eps, size)

    def count(guests: pa.Table, hosts: pa.Table) -> pa.Table:
        w, n = hosts["w"].to_numpy(), np.zeros(guests.num_rows, np.int64)
        for some, at, near in pairs(guests, hosts):
            row, col = np.nonzero(near)
            n[some] = n[some] + np.bincount(row, w[at[col]], minlength=len(some)).astype(np.int64)
        return pa.table({"node": guests["node"], "n": pa.array(n)})

    inside = in_tiles(home, cells, lambda table: count(table, table), "node long, n long")
    sure = cut_lineage(inside.where(F.col("n") >= min_pts).select("node"), "sure-cores")
    counts, _ = visit(home.drop("reach"), cut_lineage(home.join(sure, "node", "left_anti"), "open"), cells, count, "node long, n long", [])
    others = counts.groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= min_pts).select("node")
    cores = cut_lineage(sure.unionByName(others), "cores")
    core_home = cut_lineage(home.join(cores, "node", "left_semi").withColumn("component", F.col("node")), "core-cells")

    def link(guests: pa.Table, hosts: pa.Table) -> pa.Table:
        names, place = np.unique(np.concatenate([guests["component"].to_numpy(), hosts["component"].to_numpy()]), return_inverse=True)
        a, b, label, tied = place[: guests.num_rows], place[guests.num_rows :], np.arange(len(names)), []
        for some, at, near in pairs(guests, hosts):
            row, col = np.nonzero(near)
            tied += _united(label, a[some[row]], b[at[col]])
            if not label.any():  # all are of one set
                break
        ends = [np.concatenate(x) for x in zip(*tied, strict=True)] if tied else [np.empty(0, int)] * 2
        return pa.table({"a": pa.array(names[ends[0]]), "b": pa.array(names[ends[1]])})

    def merged(held: DataFrame, links: DataFrame) -> DataFrame:
        links = cut_lineage(links, "set-links")
        if links.isEmpty():
            return held
        groups = cut_lineage(connected_components(links), "groups").toDF("component", "of")
        joined = held.join(groups, "component", "left").withColumn("component", F.coalesce("of", "component"))
        return cut_lineage(joined.select(*held.columns), "sets")

    def beside(cells: Cells, batch: pa.RecordBatch, row: np.ndarray, block: np.ndarray) -> np.ndarray:
        own = cells.block[batch.column("cell").to_numpy()][row]
        return _across(cells, batch, row, block) & (block - own <= 1)

    sets = core_home.select("node", "component")
    tie = "a long, b long"

    def with_sets() -> DataFrame:
        return cut_lineage(core_home.drop("component").join(sets, "node"), "core-sets")

    sets = merged(sets, in_tiles(core_home, cells, lambda table: link(table, table), tie))
    held = with_sets()
    sets = merged(sets, visit(held.drop("reach"), held, cells, link, tie, ["component"], beside)[0])
    held = with_sets()
    sole = np.full(len(cells.tiles), -1)  # the set of a block that holds no other
    for row in held.groupBy("block").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a = b").collect():
        sole[row["block"]] = row["a"]

    def apart(cells: Cells, batch: pa.RecordBatch, row: np.ndarray, block: np.ndarray) -> np.ndarray:
        return _across(cells, batch, row, block) & (batch.column("component").to_numpy()[row] != sole[block])

    sets = merged(sets, visit(held.drop("reach"), held, cells, link, tie, ["component"], apart)[0])
    tied = core_home.drop("component").join(sets, "node")
    least = tied.groupBy("component").agg(F.min("least").alias("cluster"))
    core_named = cut_lineage(tied.join(least, "component").select("node", "v", "cell", "block", "tile", "cluster"), "core-clusters")

    def touch(guests: pa.Table, hosts: pa.Table) -> pa.Table:
        none = np.iinfo(np.int64).max
        cluster, found, of = hosts["cluster"].to_numpy(), np.zeros(guests.num_rows, bool), np.full(guests.num_rows, none)
        for some, at, near in pairs(guests, hosts):
            of[some] = np.minimum(of[some], np.where(near, cluster[at], none).min(axis=1))
            found[some] |= near.any(axis=1)
        return pa.table({"node": pa.array(guests["node"].to_numpy()[found]), "cluster": pa.array(of[found])})

    touched, _ = visit(core_named, home.join(cores, "node", "left_anti"), cells, touch, "node long, cluster long", [])
    border = touched.groupBy("node").agg(F.min("cluster").alias("cluster"))
    known = core_named.select("node", "cluster", F.lit(True).alias("core")).unionByName(border.withColumn("core", F.lit(False)))
    return nodes.select("node").join(known, "node", "left").select("node", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("core", F.lit(False)).alias("core"))
