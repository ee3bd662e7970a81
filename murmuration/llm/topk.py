"""Exact top-k by inner product: a ball tree per shard, searched in the order of its nodes' upper bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmuration.session import cut_lineage

SHARD_ROWS = 1 << 14  # vectors of one tree; more shards, not larger ones, for more data
QUERY_ROWS = 1 << 10  # queries searched together
LEAF_ROWS = 256
NONE = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """``(id, dims, v)``: floor(scale * x) of every component, as doubles that hold whole numbers.

    Vectors that are null, empty or hold a null or non-finite component, and rows without an id, are left out.
    """
    x = F.col(vector).cast("array<double>")
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(sound & (F.size(x) > 0) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.size(x).alias("dims"), F.transform(x, lambda e: F.floor(e * scale).cast("double")).alias("v")
    )


class BallTree:
    """Balls that halve the vectors again and again; a node's rows stand together."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.argsort(ids, kind="stable")  # an order of rows that does not depend on how they arrived
        self.centres, self.radii, self.first, self.last, self.children = [], [], [], [], []
        self._build(v, 0, len(ids), leaf)
        self.ids, self.v = ids[self.order], v[self.order]
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)

    def _build(self, v: np.ndarray, first: int, last: int, leaf: int) -> None:
        todo = [(first, last, -1)]
        while todo:
            first, last, parent = todo.pop()
            rows = self.order[first:last]
            points = v[rows]
            centre = points.mean(axis=0)
            away = ((points - centre) ** 2).sum(axis=1)
            node = len(self.first)
            self.centres.append(centre)
            self.radii.append(float(np.sqrt(away.max())))
            self.first.append(first)
            self.last.append(last)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if last - first > leaf and self.radii[-1] > 0:
                pole = points[away.argmax()]
                other = points[((points - pole) ** 2).sum(axis=1).argmax()]
                along = points @ (other - pole)
                middle = (last - first) // 2
                self.order[first:last] = rows[np.argpartition(along, middle)]
                todo += [(first, first + middle, node), (first + middle, last, node)]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, known: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(query, ids, scores)``: what may be among a query's k best. ``known``: a score that k others reach.

        All queries go down the tree together: a node's bound, inner product with its centre plus norm times
        radius, is taken for those queries still interested, the child with the higher bound first, and a query
        leaves a node whose bound is below its k-th score so far.
        """
        norms = np.sqrt((queries**2).sum(axis=1))
        slack = 1e-6 * (1 + norms)  # bounds are rounded, scores are whole numbers
        best = np.full((len(queries), k), NONE, np.int64)
        best_ids = np.full((len(queries), k), NONE, np.int64)
        floor = known.copy()
        at_centre = queries @ self.centres.T
        bound = at_centre + norms[:, None] * (self.radii + 1e-6 * (1 + np.sqrt((self.centres**2).sum(axis=1)))) + slack[:, None]
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, who = todo.pop()
            who = who[bound[who, node] >= floor[who]]
            if not len(who):
                continue
            if self.children[node]:
                a, b = self.children[node]
                nearer = bound[who, a] >= bound[who, b]
                todo += [(a, who[~nearer]), (b, who), (a, who[nearer])]
                continue
            rows = slice(self.first[node], self.last[node])
            score = np.rint(queries[who] @ self.v[rows].T).astype(np.int64)
            score[self.ids[rows] == query_ids[who, None]] = NONE
            ids = np.broadcast_to(self.ids[rows], score.shape)
            all_scores = np.concatenate([best[who], score], axis=1)
            all_ids = np.concatenate([best_ids[who], ids], axis=1)
            order = np.lexsort((all_ids, -np.maximum(all_scores, NONE + 1)), axis=1)[:, :k]
            best[who] = np.take_along_axis(all_scores, order, axis=1)
            best_ids[who] = np.take_along_axis(all_ids, order, axis=1)
            floor[who] = np.maximum(floor[who], best[who, k - 1])
        for q in range(len(queries)):
            good = (best[q] > NONE) & (best[q] >= floor[q])
            if good.any():
                yield q, best_ids[q][good], best[q][good]


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k rows of highest integer inner product, exactly.

    ``queries`` has the columns of ``vectors``; a row is no answer to the query with its id. Ties go to the
    smaller id; a query with fewer than k candidates gets all of them, one without any has no row. Vectors
    that are null, empty or hold null or non-finite components take no part, and only vectors of as many
    components are compared. Rows that repeat an id are candidates each for themselves; a repeated query id
    is searched once, with its first vector in order. Components times ``scale`` must stay below 2^20 in size
    for the products to be exact in doubles (vectors of up to 2^13 components).

    Vectors are dealt by a hash of id and components into shards of about 16,384 rows; every shard meets every
    block of queries, as an exact search must. A first search of one shard finds k scores for every query; the
    k-th of these is shared with the searches of all other shards, where it cuts off nodes from the start.
    """
    rows = cut_lineage(quantised(vectors, id_col, vector, scale), "vectors")
    asked = quantised(queries, id_col, vector, scale).groupBy("id").agg(F.min(F.struct("dims", "v")).alias("q"))
    asked = cut_lineage(asked.select("id", "q.dims", "q.v"), "queries")
    n_shards = max(1, round(rows.count() / SHARD_ROWS))
    n_blocks = max(1, round(asked.count() / QUERY_ROWS))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(n_shards)).cast("int"))
    blocks = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(n_blocks)).cast("int"))
    found_schema = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "vec_id", "score")])
    found_arrow = pa.schema([(c, pa.int64()) for c in ("query_id", "vec_id", "score")])

    def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
        flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False)
        return flat.reshape(-1, dims)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        """One shard against one block of queries."""
        out: list[list[np.ndarray]] = [[], [], []]
        for dims in np.unique(left["dims"].to_numpy()) if left.num_rows and right.num_rows else []:
            own = left.filter(pc.equal(left["dims"], int(dims)))
            block = right.filter(pc.equal(right["dims"], int(dims)))
            if not block.num_rows:
                continue
            query_ids = block["id"].to_numpy()
            known = block["known"].to_numpy() if "known" in block.column_names else np.full(len(query_ids), NONE)
            tree = BallTree(own["id"].to_numpy(), matrix(own["v"], int(dims)))
            for q, ids, scores in tree.search(query_ids, matrix(block["v"], int(dims)), k, known):
                out[0].append(np.full(len(ids), query_ids[q]))
                out[1].append(ids)
                out[2].append(scores)
        joined = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]
        return pa.table(joined, schema=found_arrow)

    def meet(shards: DataFrame, blocks: DataFrame, pieces) -> DataFrame:
        """Search every shard with every block; a shard is repeated for each block, a block for each shard."""
        numbers = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
        left = shards.select("*", numbers.alias("block"))
        right = blocks.select("*", F.explode(pieces).alias("shard"))
        return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(search, found_schema)

    probe = meet(dealt.where("shard = 0"), blocks, F.array(F.lit(0)))
    first = cut_lineage(probe, "first-shard")
    if n_shards == 1:
        found = first
    else:
        kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
        shared = kth.where(F.col("n") >= k).select(F.col("query_id").alias("id"), "kth")
        told = blocks.join(shared, "id", "left").select("*", F.coalesce("kth", F.lit(NONE)).alias("known")).drop("kth")
        others = meet(dealt.where("shard > 0"), told, F.sequence(F.lit(1), F.lit(n_shards - 1)))
        found = first.unionByName(others)
    # at most k rows come from a shard, only of those that reach the shared score; tasks keep k before the shuffle
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
