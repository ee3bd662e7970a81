"""Vector codes: codebooks of vector parts by Lloyd's rounds, with trees over the parts and over the entries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmuration.operators.skew import skew_join
from murmuration.session import cut_lineage

BLOCK_ROWS = 1 << 12  # vectors whose parts share their trees
LEAF_ROWS = 16
LARGEST = 1 << 26  # components are whole numbers below this, so that squares of differences add up exactly
EXACT = 1 << 22  # below this, products of whole numbers are exact in doubles too (parts of up to 512 components)


class Tree:
    """A balanced tree over whole-numbered points: every node's rows stand together, halves at the widest component.

    ``levels[l]`` holds the first rows of the nodes at depth ``l`` and the end; a node's children are the nodes ``2i``
    and ``2i + 1`` one level down. ``order`` gives the points' rows in the order of the leaves.
    """

    def __init__(self, points: np.ndarray, leaf: int, order: np.ndarray | None = None):
        n, depth = len(points), 0
        while -(-n >> depth) > leaf:
            depth += 1
        self.levels = [np.array([(i * n) >> level for i in range((1 << level) + 1)]) for level in range(depth + 1)]
        if order is None:
            order = np.arange(n)
            for level in range(depth):
                bounds, below = self.levels[level], self.levels[level + 1]
                for node in range(1 << level):
                    rows = order[bounds[node] : bounds[node + 1]]
                    if len(rows) < 2:
                        continue
                    part = points[rows]
                    widest = (part.max(axis=0) - part.min(axis=0)).argmax()
                    middle = below[2 * node + 1] - bounds[node]
                    order[bounds[node] : bounds[node + 1]] = rows[np.argpartition(part[:, widest], middle)]
        self.order = order
        self.points = points[order]
        self.low = [np.minimum.reduceat(self.points, level[:-1], axis=0) for level in self.levels]
        self.high = [np.maximum.reduceat(self.points, level[:-1], axis=0) for level in self.levels]


def _least(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """The least value of each group of a rising column of group numbers, all of which occur."""
    return np.minimum.reduceat(values, np.searchsorted(group, np.arange(groups)))


def _box_bounds(a: Tree, la: int, x: np.ndarray, b: Tree, lb: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distance between the boxes of node pairs ``(x, y)``."""
    gap = np.maximum(np.maximum(b.low[lb][y] - a.high[la][x], a.low[la][x] - b.high[lb][y]), 0)
    far = np.maximum(b.high[lb][y] - a.low[la][x], a.high[la][x] - b.low[lb][y])
    return (gap * gap).sum(axis=1), (far * far).sum(axis=1)


def _beaten(low: np.ndarray, high: np.ndarray, entry: np.ndarray, rival: np.ndarray) -> np.ndarray:
    """Whether all points of a box are strictly nearer to ``rival`` than to ``entry``.

    ``|p - rival|^2 - |p - entry|^2`` is linear in p, so its largest value stands in the corner picked per component.
    """
    slope = 2 * (entry - rival)
    most = np.where(slope > 0, high, low)
    return (slope * most).sum(axis=1) + (rival * rival).sum(axis=1) - (entry * entry).sum(axis=1) < 0


def nearest(points: Tree, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """All points' nearest entries, ties to the lower index, as ``(starts, ends, entry)`` of stretches of the tree's order.

    Both trees are gone down together. A pair of nodes goes when its least distance is above the largest distance
    of the same points to another node of entries; below the entries' leaves, when a rival is nearer to the whole box.
    A node left with one entry is given to it whole. What is open in the points' leaves is settled point by point.
    """
    book = Tree(entries, 1)
    x, y = np.zeros(1, np.int64), np.zeros(1, np.int64)
    lp, le = 0, 0
    deepest, entries_deep = len(points.levels) - 1, len(book.levels) - 1
    while True:
        if le < entries_deep:
            le += 1
            x, y = np.repeat(x, 2), np.concatenate([2 * y[:, None], 2 * y[:, None] + 1], axis=1).ravel()
            filled = book.levels[le][y + 1] > book.levels[le][y]
            x, y = x[filled], y[filled]
        names, place = np.unique(x, return_inverse=True)
        least, most = _box_bounds(points, lp, x, book, le, y)
        keep = least <= _least(most, place, len(names))[place]
        x, y, place, least = x[keep], y[keep], place[keep], least[keep]
        if le == entries_deep:
            index = book.order[book.levels[le][y]]
            middle = points.low[lp][x] + points.high[lp][x] - 2 * entries[index]
            near = (middle * middle).sum(axis=1)
            first = np.lexsort((index, near, place))
            rival = index[first][np.searchsorted(place[first], np.arange(len(names)))][place]
            keep = ~_beaten(points.low[lp][x], points.high[lp][x], entries[index], entries[rival])
            x, y, place, index = x[keep], y[keep], place[keep], index[keep]
            alone = np.bincount(place, minlength=len(names))[place] == 1
            if alone.any():
                bounds = points.levels[lp]
                yield bounds[x[alone]], bounds[x[alone] + 1], index[alone]
                x, y, index = x[~alone], y[~alone], index[~alone]
            if not len(x):
                return
            if lp == deepest:
                break
        if lp < deepest:
            lp += 1
            pairs = np.concatenate([2 * x[:, None], 2 * x[:, None] + 1], axis=1)
            x, y = pairs.T.ravel(), np.concatenate([y, y])
            order = np.argsort(x, kind="stable")
            x, y = x[order], y[order]
    bounds = points.levels[deepest]
    for leaf in np.unique(x):
        rows = points.points[bounds[leaf] : bounds[leaf + 1]]
        wanted = np.sort(index[x == leaf])
        found = wanted[distances(rows, entries[wanted]).argmin(axis=1)]
        starts = np.arange(bounds[leaf], bounds[leaf + 1])
        yield starts, starts + 1, found


def distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances in whole numbers."""
    if max(np.abs(rows).max(initial=0), np.abs(entries).max(initial=0)) < EXACT:
        product = (rows.astype(np.float64) @ entries.T.astype(np.float64)).astype(np.int64)
        return (rows * rows).sum(axis=1)[:, None] - 2 * product + (entries * entries).sum(axis=1)
    return np.stack([((rows - e) ** 2).sum(axis=1) for e in entries], axis=1)


def blocks_of(rows: DataFrame, parts: int, dims: int) -> DataFrame:
    """``(ids, labels, points, orders)``: vectors dealt to blocks as they come, with each part's tree order.

    Trees are built once, here; later rounds read the orders and sum up the nodes again.
    """
    label = rows.schema["label"].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label)), T.StructField("points", T.BinaryType()), T.StructField("orders", T.BinaryType())])
    width = dims // parts

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        v = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table["v"].chunks]).astype(np.int64).reshape(-1, dims)
        orders = [Tree(v[:, p * width : (p + 1) * width], LEAF_ROWS).order.astype(np.int32) for p in range(parts)]
        bounds = pa.array([0, len(v)], pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, table[c].combine_chunks()) for c in ("id", "label")]
        arrays = [*lists, pa.array([v.astype(np.int32).tobytes()], pa.binary()), pa.array([np.concatenate(orders).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["ids", "labels", "points", "orders"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                taken = batch.slice(0, BLOCK_ROWS - n)
                batch = batch.slice(taken.num_rows)
                held.append(taken)
                n += taken.num_rows
                if n == BLOCK_ROWS:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return rows.select("id", "label", "v").mapInArrow(run, schema)


def part_trees(points: bytes, orders: bytes, n: int, parts: int, width: int) -> Iterator[tuple[int, Tree]]:
    v = np.frombuffer(points, np.int32).reshape(n, parts, width)
    order = np.frombuffer(orders, np.int32).reshape(parts, n)
    for p in range(parts):
        yield p, Tree(v[:, p].astype(np.int64), LEAF_ROWS, order[p])


def stretch_sums(tree: Tree, found: Iterator, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(count, sums)`` of the points given to each of ``size`` entries, from running sums over the tree's order."""
    running = np.concatenate([np.zeros((1, tree.points.shape[1]), np.int64), np.cumsum(tree.points, axis=0)])
    count, sums = np.zeros(size, np.int64), np.zeros((size, tree.points.shape[1]), np.int64)
    for starts, ends, entry in found:
        np.add.at(count, entry, ends - starts)
        np.add.at(sums, entry, running[ends] - running[starts])
    return count, sums


def lloyd_round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round: every entry the floor of its parts' mean; unused ones stay.

    A task adds up its blocks and gives one row an entry and component; only these sums are shuffled.
    """
    parts, size, width = books.shape
    shared = blocks.sparkSession.sparkContext.broadcast(books)  # parts x entries x width numbers, whatever the table's size

    def run(batches):
        count, sums = np.zeros((parts, size), np.int64), np.zeros((parts, size, width), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                n = len(batch.column(0)[row])
                for p, tree in part_trees(batch.column(1)[row].as_py(), batch.column(2)[row].as_py(), n, parts, width):
                    c, s = stretch_sums(tree, nearest(tree, shared.value[p]), size)
                    count[p] += c
                    sums[p] += s
        p, entry = np.nonzero(count)
        if len(p):
            at = np.repeat(np.arange(len(p)), width)
            component = np.tile(np.arange(width), len(p))
            arrays = [p[at], entry[at], component, count[p, entry][at], sums[p, entry].ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in arrays], names=["part", "entry", "component", "count", "total"])

    found = blocks.select("ids", "points", "orders").mapInArrow(run, "part long, entry long, component long, count long, total long")
    out = books.copy()
    summed = found.groupBy("part", "entry", "component").agg(F.sum("count").alias("count"), F.sum("total").alias("total"))
    for row in summed.collect():  # as many rows as the codebooks have numbers
        out[row["part"], row["entry"], row["component"]] = row["total"] // row["count"]
    shared.unpersist()
    return out


def encoded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """``(id, label, code, error)`` of every vector of the blocks."""
    parts, size, width = books.shape
    shared = blocks.sparkSession.sparkContext.broadcast(books)
    label = blocks.schema["labels"].dataType.elementType
    digits = max(2, len(f"{size - 1:x}"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", label), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches):
        names = np.array([f"{i:0{digits}x}" for i in range(size)], object)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels = batch.column(0).slice(row, 1).flatten(), batch.column(1).slice(row, 1).flatten()
                codes, error = np.full(len(ids), "", object), np.zeros(len(ids), np.int64)
                for p, tree in part_trees(batch.column(2)[row].as_py(), batch.column(3)[row].as_py(), len(ids), parts, width):
                    chosen = np.empty(len(ids), np.int64)
                    for starts, ends, entry in nearest(tree, shared.value[p]):
                        for a, b, e in zip(starts.tolist(), ends.tolist(), entry.tolist(), strict=True):
                            chosen[a:b] = e
                    away = tree.points - shared.value[p][chosen]
                    codes[tree.order] += names[chosen]
                    error[tree.order] += (away * away).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array(error)], names=schema.names)

    return blocks.mapInArrow(run, schema)


def learn(rows: DataFrame, blocks: DataFrame, parts: int, entries: int, rounds: int, dims: int) -> np.ndarray:
    """Codebooks as ``(part, entry, component)``, started from the vectors of the smallest ids."""
    first = rows.where("id IS NOT NULL").orderBy("id", "v").limit(entries).select("v").collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        books = lloyd_round(blocks, books)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
    id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """``(id, code, error, label_error, codebooks_sha256)`` of every vector with sound components.

    Each component x becomes ``floor(scale * x)``, vectors are cut into ``parts`` equal parts, and each part position gets a
    codebook of ``entries`` entries: at first those of the smallest ids, then ``rounds`` times the floors of the means
    of the parts nearest to them (squared distance, ties to the lower index; unused entries stay). ``code`` writes the
    nearest final entries' indexes in two hex digits each, ``error`` adds up their squared distances, ``label_error`` the
    errors of all vectors with the same label, null being one. All arithmetic is in whole numbers.

    Vectors that are null, empty or hold null or non-finite components are left out; so are those whose number of
    components is not that of the smallest id, or with a component of 2^26 or more after scaling. If that number is
    not divisible by ``parts``, no vector can be cut and the result is empty. Fewer vectors than ``entries`` give as many
    entries. Rows without an id are encoded but start no entry; of rows that repeat an id the smaller vector comes
    first. An empty table gives an empty table. Other columns are not read.

    A round reads blocks of about 4,096 vectors, written once with their trees' orders, and shuffles only sums.
    """
    x = F.col(vector).cast("array<double>")
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < LARGEST / scale)) & (F.size(x) > 0)
    named = F.col(label) if label in vectors.columns else F.lit(None).cast("int")
    v = F.transform(x, lambda e: F.floor(e * scale).cast("long"))
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), named.alias("label"), v.alias("v"))
    first = rows.where("id IS NOT NULL").orderBy("id", "v").limit(1).collect()
    dims = len(first[0]["v"]) if first else 0
    usable = rows.where(F.size("v") == (dims if dims % parts == 0 else -1))
    blocks = cut_lineage(blocks_of(usable, parts, max(dims, parts)), "vector-blocks")
    books = learn(usable, blocks, parts, entries, rounds, dims) if dims and dims % parts == 0 else np.zeros((parts, 0, 1), np.int64)
    key = F.when(F.col("label").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    coded = cut_lineage(encoded(blocks, books).withColumn("key", key), "codes")
    sums = coded.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows"))
    met = skew_join(coded, sums, "key", "rows", "id", rows=coded.count())
    return met.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
