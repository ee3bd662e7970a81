"""Histogram sort: probes are counted exactly and refined until the splitters fit, then rows move once."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmuration.session import cut_lineage

MAX_PIECES = 1 << 14  # pieces grow beyond this many; it bounds the splitters that the driver holds
PROBES = 1 << 13  # a round's probes, at least 8 for each open splitter
KEY = 1 << 128


@dataclass
class Splitter:
    """Bounds of a splitter being searched: keys, and the size and rows below each of them."""

    target: float
    low: int = 0
    high: int = KEY
    below_low: tuple[int, int] = (0, 0)
    below_high: tuple[int, int] = (0, 0)
    key: int | None = None
    below: tuple[int, int] = (0, 0)

    def settle(self, tolerance: float) -> None:
        """Take a bound once it is near enough, or once a single key lies between the bounds."""
        over, under = self.below_high[0] - self.target, self.target - self.below_low[0]
        if self.high - self.low <= 1 or min(over, under) <= tolerance:
            nearer = over < under
            self.key = self.high if nearer else self.low
            self.below = self.below_high if nearer else self.below_low


def key_bytes(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """Two signed columns as one array of 16 bytes that sorts like them."""
    out = np.empty((len(major), 2), ">u8")
    for at, column in enumerate((major, minor)):
        out[:, at] = column.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return out.view("S16").ravel()


def probe_bytes(keys: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(k.to_bytes(16, "big") for k in keys), "S16")


def key_number(value: bytes) -> int:
    return int.from_bytes(value.ljust(16, b"\0"), "big")


COUNTS = "bucket int, size long, rows long, first string, last string"


def count_between(rows: DataFrame, keys: list[int]) -> list:
    """Exact size and rows between neighbouring probes over all partitions, with the extreme keys met there."""
    probes = probe_bytes(keys)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            key = key_bytes(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            order = np.argsort(key, kind="stable")
            key = key[order]
            total = np.concatenate([[0], np.cumsum(batch.column(2).to_numpy()[order])])
            ends = np.concatenate([[0], np.searchsorted(key, probes), [len(key)]])
            full = np.flatnonzero(ends[1:] > ends[:-1])
            first, last = ends[full], ends[full + 1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full.astype(np.int32)), pa.array(total[last] - total[first]), pa.array(last - first),
                    pa.array([k.ljust(16, b"\0").hex() for k in key[first].tolist()], pa.string()),
                    pa.array([k.ljust(16, b"\0").hex() for k in key[last - 1].tolist()], pa.string()),
                ],
                names=["bucket", "size", "rows", "first", "last"],
            )

    part = rows.select("_major", "_minor", "_size").mapInArrow(run, COUNTS)
    merged = part.groupBy("bucket").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"))
    return merged.orderBy("bucket").collect()  # a row a probe at most


def find_splitters(rows: DataFrame, pieces: int, tolerance: float) -> list[Splitter]:
    """``pieces - 1`` keys that cut ``(_major, _minor, _size)`` into pieces of equal size.

    ``tolerance`` is the allowed error of a cut as a share of a piece. A key's rows are never parted, so where
    one key is larger than that, the cut is at the nearer side of it.
    """
    total, n = rows.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count(F.lit(1))).first()
    found = [Splitter(total * k / pieces, below_high=(total, n)) for k in range(1, pieces)]
    for _ in range(256):
        for s in found:
            if s.key is None:
                s.settle(tolerance * total / pieces)
        todo = [s for s in found if s.key is None]
        if not todo:
            break
        each = max(8, PROBES // len(todo))
        keys: set[int] = set()
        for low, high in {(s.low, s.high) for s in todo}:
            keys |= {low + (high - low) * i // each for i in range(each)} | {high}
        probes = sorted(k for k in keys if 0 < k < KEY)
        counts = {r["bucket"]: r for r in count_between(rows, probes)}
        below, size, held = [(0, 0)], 0, 0
        for bucket in range(len(probes) + 1):
            if bucket in counts:
                size, held = size + counts[bucket]["size"], held + counts[bucket]["rows"]
            below.append((size, held))
        sizes = [b[0] for b in below]
        for s in todo:
            bucket = min(bisect_right(sizes, s.target) - 1, len(probes))
            while bucket not in counts and bucket:
                bucket -= 1
            if bucket not in counts:
                bucket = min(counts)
            s.low, s.high = int(counts[bucket]["first"], 16), int(counts[bucket]["last"], 16) + 1
            s.below_low, s.below_high = below[bucket], below[bucket + 1]
    for before, after in zip(found, found[1:], strict=False):
        if after.key < before.key:  # two cuts at one large key
            after.key, after.below = before.key, before.below
    return found


def with_piece(rows: DataFrame, splitters: list[Splitter]) -> DataFrame:
    """Add ``_piece int``: how many splitters a row's key reaches."""
    keys, names = probe_bytes([s.key for s in splitters]), [*rows.columns, "_piece"]
    at = [rows.columns.index(c) for c in ("_major", "_minor")]
    schema = T.StructType([*rows.schema.fields, T.StructField("_piece", T.IntegerType())])

    def run(batches):
        for batch in batches:
            key = key_bytes(batch.column(at[0]).to_numpy(), batch.column(at[1]).to_numpy())
            piece = np.searchsorted(keys, key, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(piece)], names=names)

    return rows.mapInArrow(run, schema) if splitters else rows.withColumn("_piece", F.lit(0))


def text_key(id_col: str, text: str) -> tuple[Column, Column, Column]:
    """Equal texts stand together, in the order of their ids; a row counts its bytes and 8 more."""
    whole = F.coalesce(F.col(text), F.lit(""))
    size = F.octet_length(whole).cast("long") + 8
    return F.xxhash64(whole), F.coalesce(F.col(id_col).cast("long"), F.lit(np.iinfo(np.int64).min)), size


def balanced_shards(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text: str = "text", tolerance: float = 0.001, piece_rows: int = 1 << 18
) -> DataFrame:
    """Add ``size long, text_crc32 long, law string, shard int, slot long, grown_shard int``; law ``bytes``.

    Shards are stretches of the order (hash of the text, id) with nearly equal bytes: each cut errs by at most
    ``tolerance`` of a shard, or by less than the rows of one key. Equal texts are neighbours, and a text that
    holds a third of all bytes is cut between its ids. Null texts count as empty; rows without an id sort first;
    rows that repeat id and text stay together. ``slot`` numbers a shard's rows from 0 in that order.
    ``grown_shard`` is null under this law. An empty table gives an empty table. Given columns of these names are
    replaced. Columns named ``_major``, ``_minor``, ``_size``, ``_piece``, ``_base`` are used inside.

    Only keys and sizes are counted; the rows then move once. Shards are made of pieces of about ``piece_rows``
    rows, whose first slots follow from the counted rows.
    """
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    inner = ["_major", "_minor", "_size", "_piece", "_base"]
    kept = [c for c in docs.columns if c not in added and c not in inner]
    major, minor, size = text_key(id_col, text)
    keyed = docs.select(*kept, major.alias("_major"), minor.alias("_minor"), size.alias("_size"))
    light = cut_lineage(keyed.select("_major", "_minor", "_size"), "keys")
    each = max(1, min(MAX_PIECES // shards, -(-light.count() // (shards * piece_rows))))
    splitters = find_splitters(light, shards * each, tolerance / each)
    rows_below = [0, *(s.below[1] for s in splitters)]
    bases = [rows_below[p] - rows_below[p - p % each] for p in range(shards * each)]
    spark = docs.sparkSession
    offsets = spark.createDataFrame(list(enumerate(bases)), "_piece int, _base long")
    order = Window.partitionBy("_piece").orderBy("_major", "_minor")
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    placed = with_piece(keyed.withColumn("text_crc32", crc), splitters).withColumn("_row", F.row_number().over(order))
    return placed.join(F.broadcast(offsets), "_piece").select(  # at most MAX_PIECES rows
        *kept,
        F.col("_size").alias("size"),
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.floor(F.col("_piece") / each).cast("int").alias("shard"),
        (F.col("_base") + F.col("_row") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, **options) -> None:
    """Write whole rows, one folder a shard, each file in the order of its slots."""
    placed = balanced_shards(docs, shards, **options)
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
