"""Near copies among vectors: products of quantised tiles, and whole precision where their error leaves it open."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.operators.cluster import connected_components
from murmuration.operators.skew import skew_join
from murmuration.session import cut_lineage

TILE_ROWS = 1 << 12  # vectors of either side of a product
STRIP_ROWS = 1 << 9  # rows of a tile multiplied at once
PIVOTS = 256  # cells at most; a cell of more vectors than a tile is dealt to several
OPEN_PAIRS = 1 << 16  # pairs recomputed at once
FAR = 1 << 30  # chunks of visitors are numbered from here, tiles from 0
ROUNDING = 1e-5  # above the rounding of the bounds, which are single-precision numbers near 1


def sound_rows(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``(id, name, dims, v)``: vectors as the bytes of doubles, and a 128-bit name of them.

    ``v`` is null for vectors that link with nothing: null, empty, zero, holding null or non-finite components, so long that
    their square is not finite, or without an id.
    """
    x = F.col(vector).cast("array<double>")
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(sound, x).alias("x"))

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # no negative zeros
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
            names, held = [], []
            with np.errstate(over="ignore"):
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    square = float(flat[a:b] @ flat[a:b])
                    data = flat[a:b].tobytes() if 0 < square < np.inf else None
                    held.append(data)
                    names.append(None if data is None else hashlib.blake2b(data, digest_size=16).digest())
            dims = pa.array(np.diff(ends).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), dims, pa.array(held, pa.binary())], names=["id", "name", "dims", "v"])

    return rows.mapInArrow(run, "id long, name binary, dims int, v binary")


def unit_rows(data: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(codes, scale, error)``: ``scale * codes`` is off each unit vector by no more than ``error`` in length.

    The error is measured, not estimated: it is the length of what the codes leave.
    """
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    left = unit - scale[:, None] * codes
    return codes, scale, np.sqrt((left * left).sum(axis=1)) * (1 + 1e-9) + 1e-12


class Tile:
    """Vectors ready for products: codes as whole single-precision numbers, their scales and error bounds."""

    def __init__(self, data: list[bytes]):
        self.v = np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)
        with np.errstate(over="ignore"):
            self.norm = np.sqrt((self.v * self.v).sum(axis=1))
        codes, self.scale, self.error = quantise(unit_rows(data))
        # products of codes stay whole in the type: 127^2 times the components is below 2^24, or 2^53
        self.codes = codes.astype(np.float32 if self.v.shape[1] <= 1040 else np.float64)


def linked(a: Tile, rows: slice, b: Tile, least: float) -> np.ndarray:
    """Which of some rows of ``a`` and all of ``b`` have a cosine of ``least`` or more.

    With x = sq + e, the product of the unit vectors is off that of their codes by at most |e_x| + (1 + |e_x|)|e_y|. Pairs that
    this puts above or below are settled; all others are computed in double precision.
    """
    rough = (a.codes[rows] @ b.codes.T) * (a.scale[rows, None] * b.scale).astype(a.codes.dtype)
    error = a.error[rows]
    most = error + (1 + error) * b.error.max() + ROUNDING
    at_row, at_col = np.nonzero(rough >= (least - most).astype(rough.dtype)[:, None])
    out = np.zeros(rough.shape, bool)
    if not len(at_row):
        return out
    bound = error[at_row] + (1 + error[at_row]) * b.error[at_col] + ROUNDING
    value = rough[at_row, at_col].astype(np.float64)
    sure = value - bound >= least
    out[at_row[sure], at_col[sure]] = True
    unsettled = ~sure & (value + bound >= least)
    at_row, at_col = at_row[unsettled], at_col[unsettled]
    own, norm = a.v[rows], a.norm[rows]
    if 8 * len(at_row) > out.size:
        cosine = (own @ b.v.T) / (norm[:, None] * b.norm)
        out[at_row, at_col] = cosine[at_row, at_col] >= least
        return out
    for first in range(0, len(at_row), OPEN_PAIRS):
        i, j = at_row[first : first + OPEN_PAIRS], at_col[first : first + OPEN_PAIRS]
        out[i, j] = np.einsum("ij,ij->i", own[i], b.v[j]) / (norm[i] * b.norm[j]) >= least
    return out


class Forest:
    """Sets of numbers that links join."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        root = self.parent[x]
        while True:
            above = self.parent[root]
            if (above == root).all():
                self.parent[x] = root
                return root
            root = above

    def join(self, x: int, others: np.ndarray) -> np.ndarray:
        """Those of the others whose link to ``x`` joined two sets."""
        roots, first = np.unique(self.roots(others), return_index=True)
        own = int(self.roots(np.array([x]))[0])
        new = roots != own
        self.parent[roots[new]] = own
        return others[first[new]]


def tile_links(home: pa.Table, visitors: pa.Table, least: float) -> tuple[np.ndarray, list, np.ndarray]:
    """``(nodes, links, how many rows each links with)`` of a product of tiles; without visitors, of a tile with itself.

    Of all links found only those that join two sets of nodes are given out, fewer than there are nodes.
    """
    a = Tile(home["v"].to_pylist())
    same = visitors.num_rows == 0
    b = a if same else Tile(visitors["v"].to_pylist())
    n, copies = home.num_rows, home["copies"].to_numpy()
    other_copies = copies if same else visitors["copies"].to_numpy()
    nodes = home["node"].to_numpy() if same else np.concatenate([home["node"].to_numpy(), visitors["node"].to_numpy()])
    shift = 0 if same else n
    forest, found, links = Forest(len(nodes)), np.zeros(len(nodes), np.int64), []
    for first in range(0, n, STRIP_ROWS):
        rows = slice(first, min(n, first + STRIP_ROWS))
        near = linked(a, rows, b, least)
        if same:
            near &= np.arange(len(b.v)) > np.arange(rows.start, rows.stop)[:, None]
        if not near.any():
            continue
        found[rows] += near @ other_copies
        found[shift:] += copies[rows] @ near
        for i in np.flatnonzero(near.any(axis=1)):
            joined = forest.join(first + i, np.flatnonzero(near[i]) + shift)
            links += [(nodes[first + i], x) for x in nodes[joined]]
    return nodes, links, found


def pivots_of(classes: DataFrame, n: int) -> np.ndarray:
    """Unit vectors that name the cells: at most ``PIVOTS``, one for each tile's worth of rows, picked by their names."""
    wanted = min(PIVOTS, max(1, round(n / TILE_ROWS)))
    return unit_rows([r["v"] for r in classes.orderBy("name").limit(wanted).select("v").collect()])


def celled(classes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Each class with its nearest pivot (``cell``) and the distances to all pivots, between unit vectors."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = unit_rows(batch.column("v").to_pylist())
            away = np.sqrt(np.maximum(2 - 2 * (unit @ shared.value.T), 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1) * len(pivots), pa.int32()), pa.array(away.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(away.argmin(axis=1).astype(np.int32)), lists], names=[*batch.schema.names, "cell", "away"])

    return classes.select("node", "copies", "v").mapInArrow(run, "node long, copies long, v binary, cell int, away array<double>")


def links_of(classes: DataFrame, n: int, least: float) -> DataFrame:
    """``(a, b, count)``: links between classes that join them to groups, and with ``b`` null, how many rows ``a`` links with.

    Every cell's vectors are its home rows, dealt to tiles. A vector visits the cells of lower numbers in which one of
    its links can lie: not further from the pivot than the cell's radius plus the distance of a linked pair.
    """
    reach = float(np.sqrt(2 - 2 * least)) + ROUNDING
    pivots = pivots_of(classes, n)
    placed = cut_lineage(celled(classes, pivots), "cells")
    own = F.element_at("away", F.col("cell") + 1)
    cells = placed.groupBy("cell").agg(F.max(own).alias("radius"), F.count(F.lit(1)).alias("rows")).collect()  # at most PIVOTS rows
    within, in_tiles, in_chunks = np.full(len(pivots), -1.0), np.zeros(len(pivots), int), np.zeros(len(pivots), int)
    for cell in cells:
        within[cell["cell"]], in_tiles[cell["cell"]] = cell["radius"] + reach, -(-cell["rows"] // TILE_ROWS)

    def of_cell(values: np.ndarray, cell: str | Column) -> Column:
        return F.element_at(F.lit(values.tolist()), (F.col(cell) if isinstance(cell, str) else cell) + 1)

    below = F.when(F.col("cell") > 0, F.sequence(F.lit(0), F.col("cell") - 1)).otherwise(F.array().cast("array<int>"))
    visited = F.explode(F.filter(below, lambda h: F.element_at("away", h + 1) <= of_cell(within, h)))
    for row in placed.select(visited.alias("home")).groupBy("home").count().collect():  # at most PIVOTS rows
        in_chunks[row["home"]] = -(-row["count"] // TILE_ROWS)
    what = ["node", "copies", "v"]
    home = placed.select(*what, F.col("cell").alias("home"), F.pmod(F.xxhash64("node"), of_cell(in_tiles, "cell")).cast("int").alias("tile"))
    # rows of a cell's other tiles, and of cells of higher numbers, come in chunks of a tile's size
    earlier = F.when(F.col("tile") > 0, F.sequence(F.lit(0), F.col("tile") - 1)).otherwise(F.array().cast("array<int>"))
    guests = home.select(*what, "home", F.explode(earlier).alias("piece"), F.col("tile").alias("chunk"))
    travel = placed.select(*what, visited.alias("home"))
    chunk = F.lit(FAR) + F.pmod(F.xxhash64("node", F.lit(1)), of_cell(in_chunks, "home")).cast("int")
    travel = travel.select(*what, "home", F.explode(F.sequence(F.lit(0), (of_cell(in_tiles, "home") - 1).cast("int"))).alias("piece"), chunk.alias("chunk"))
    visitors = guests.unionByName(travel)
    # a home tile meets itself (-1), the later tiles of its cell and every chunk of visitors
    tiles, chunks = of_cell(in_tiles, "home").cast("int"), of_cell(in_chunks, "home").cast("int")
    others = F.filter(F.sequence(F.lit(-1), tiles - 1), lambda t: (t < 0) | (t > F.col("tile")))
    far = F.when(chunks > 0, F.sequence(F.lit(FAR), F.lit(FAR - 1) + chunks)).otherwise(F.array().cast("array<int>"))
    met = home.select(*what, "home", F.col("tile").alias("piece"), F.explode(F.concat(others, far)).alias("chunk"))
    names = ["a", "b", "count"]

    def product(rows: pa.Table, others: pa.Table) -> pa.Table:
        if not rows.num_rows or (not others.num_rows and rows["chunk"][0].as_py() >= 0):
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        nodes, links, found = tile_links(rows.sort_by("node"), others.sort_by("node"), least)
        some = np.flatnonzero(found)
        ends = np.array(links, np.int64).reshape(-1, 2)
        return pa.table(
            [
                pa.array(np.concatenate([ends[:, 0], nodes[some]])),
                pa.concat_arrays([pa.array(ends[:, 1]), pa.nulls(len(some), pa.int64())]),
                pa.array(np.concatenate([np.zeros(len(ends), np.int64), found[some]])),
            ],
            names=names,
        )

    keys = ["home", "piece", "chunk"]
    found = met.groupBy(*keys).cogroup(visitors.groupBy(*keys)).applyInArrow(product, "a long, b long, count long")
    return cut_lineage(found, "tile-links")


def near_vectors(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, n_links, component_id, kept)`` of every vector, linked where the cosine is ``least`` (above 0) or more.

    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id that links reach, its own
    included, and ``kept`` marks the rows that bear it. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing, nor do rows without an id, which have no component and are kept. Vectors of
    different numbers of components are not linked. Rows that repeat an id are rows each for themselves. Other columns
    are not read; an empty table gives an empty table.

    Equal vectors are one class first, whatever their number, and count as often as they stand there. Classes are dealt to
    cells around pivots; a tile of at most about 4,096 of a cell meets those tiles in which a link can lie, the rest is proven away.
    Products of a tile are taken on int8 codes, whose measured errors bound what they can be off; pairs that may be on
    either side are computed again in double precision. Tasks give out counts and the links that join groups, never all pairs.
    """
    rows = cut_lineage(sound_rows(vectors, id_col, vector), "vectors")
    grouped = rows.where("v IS NOT NULL").groupBy("name", "dims").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.min("v").alias("v"))
    classes = cut_lineage(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")  # written, so numbers stay
    sizes = classes.groupBy("dims").count().collect()  # a row for each number of components
    found = None
    for size in sizes:
        part = links_of(classes.where(F.col("dims") == size["dims"]), size["count"], least)
        found = part if found is None else found.unionByName(part)
    if found is None:
        named = classes.select("name", "copies", F.col("least_id").alias("component_id"), F.lit(0).cast("long").alias("more"))
    else:
        more = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("count").alias("more"))
        groups = cut_lineage(connected_components(found.where("b IS NOT NULL").select("a", "b")), "components")
        tied = classes.select("node", "name", "copies", "least_id").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        ids = tied.groupBy("component").agg(F.min("least_id").alias("component_id"))
        named = tied.join(ids, "component").join(more, "node", "left").select("name", "copies", "component_id", F.coalesce("more", F.lit(0)).alias("more"))
    named = cut_lineage(named, "named")
    known = skew_join(rows.where("v IS NOT NULL").select("id", "name"), named, "name", "copies", "id", rows=rows.count())
    linked_rows = known.select("id", (F.col("copies") - 1 + F.col("more")).alias("n_links"), "component_id")
    alone = rows.where("v IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = linked_rows.unionByName(alone)
    return every.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
