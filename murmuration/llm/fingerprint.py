"""Document fingerprints: byte triplets counted in buckets, quartiles of the counts as two-bit codes."""

from __future__ import annotations

import math
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.llm.common import mix, text_slices
from murmuration.llm.sharding import MAX_PIECES, find_splitters, with_piece
from murmuration.session import cut_lineage

BUCKETS = 256
# one byte and two of the four after it make a triplet: these distances
DISTANCES = ((1, 2), (1, 3), (2, 4))
_VALUES = (mix(np.arange(1, 1 + 256 * 3 * len(DISTANCES), dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
TABLES = _VALUES.reshape(len(DISTANCES), 3, 256)
SCRAMBLE = np.uint32(0x9E3779B1)
# what unlike codes add to the difference; documents with nothing in common differ by 1.625 a bucket on average
CODE_DIFFERENCE = np.array([0, 1, 2, 6], np.int64)
BOUND = 1.625 * BUCKETS


def bucket_counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How often each bucket is met in each text, as rows of ``BUCKETS`` counts."""
    n = len(bounds) - 1
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(bounds))
    counts = np.zeros((n, BUCKETS), np.int64)
    for table, (near, far) in zip(TABLES, DISTANCES, strict=True):
        held = len(data) - far
        if held <= 0:
            continue
        value = table[0][data[:held]] + table[1][data[near : near + held]] + table[2][data[far : far + held]]
        bucket = (value * SCRAMBLE) >> np.uint32(24)
        same = row[:held] == row[far:]
        counts += np.bincount((row[:held] * BUCKETS + bucket)[same], minlength=n * BUCKETS).reshape(n, BUCKETS)
    return counts


def encode(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(header, codes)``: per text three header values (length class, quartile ratios) and a code per bucket."""
    counts = bucket_counts(data, bounds)
    ordered = np.sort(counts, axis=1)
    q1, q2, q3 = (ordered[:, BUCKETS * i // 4 - 1] for i in (1, 2, 3))
    codes = sum((counts > q[:, None]).astype(np.uint8) for q in (q1, q2, q3))
    length = np.minimum(255, np.rint(np.log1p(np.diff(bounds)) * 12)).astype(np.uint8)
    ratios = [(np.where(q3 > 0, 15 * q / np.maximum(q3, 1), 0)).astype(np.uint8) for q in (q1, q2)]
    return np.stack([length, *ratios], axis=1), codes


def to_text(header: np.ndarray, codes: np.ndarray) -> list[str]:
    """Hex digits: length class, the ratios, then four codes a byte."""
    four = codes.reshape(len(codes), BUCKETS // 4, 4)
    packed = four[:, :, 0] << 6 | four[:, :, 1] << 4 | four[:, :, 2] << 2 | four[:, :, 3]
    head = np.stack([header[:, 0], header[:, 1] << 4 | header[:, 2]], axis=1)
    return [row.tobytes().hex() for row in np.concatenate([head, packed], axis=1).astype(np.uint8)]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """1 for equal digests, down to 0: one minus the difference as a share of its bound.

    Codes add 1, 2 or 6 a bucket by their distance, length classes their distance beyond a factor of 1.5,
    ratios their distance; the sum counts up to ``BOUND``.
    """
    (ha, ca), (hb, cb) = a, b
    body = CODE_DIFFERENCE[np.abs(ca.astype(np.int8) - cb.astype(np.int8))].sum(axis=1)
    head = np.abs(ha.astype(np.int64) - hb.astype(np.int64))
    head[:, 0] = np.maximum(0, head[:, 0] - 5)
    return 1 - np.minimum(1.0, (body + head.sum(axis=1)) / BOUND)


def encode_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return encode(np.frombuffer(b"".join(texts), np.uint8), bounds)


def from_text(digests: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The parts of written digests, for ``likeness``."""
    raw = np.frombuffer(bytes.fromhex("".join(digests)), np.uint8).reshape(len(digests), 2 + BUCKETS // 4)
    header = np.stack([raw[:, 0], raw[:, 1] >> 4, raw[:, 1] & 15], axis=1)
    codes = np.stack([raw[:, 2:] >> s & 3 for s in (6, 4, 2, 0)], axis=2).reshape(len(raw), BUCKETS)
    return header, codes


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the digest of the whole text; null counts as empty. Texts of fewer than three bytes share a digest
    with others of their length; equal texts always have equal digests. A given column ``out`` is replaced."""
    source = docs.select(*[c for c in docs.columns if c != out])
    at, names = source.columns.index(text), [*source.columns, out]
    schema = source.withColumn(out, F.lit("")).schema

    def run(batches):
        for batch in batches:
            digests = [d for _, _, data, bounds in text_slices(batch.column(at)) for d in to_text(*encode(data, bounds))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=names)

    return source.mapInArrow(run, schema)


# --- every document beside the next one

SLICE_CHARS = 1 << 20
RESULT = {
    "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(),
}


def edited(text: str, following: str) -> str:
    """The last third of the code points gives way to as many from the start of the next text, or all it has."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text", piece_bytes: int = 2 << 20) -> DataFrame:
    """``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` for every row.

    The next document is that of the next smaller id, after the last the first; rows without an id come last and
    equal ids go by a hash of their texts. A single document is its own next. Null texts count as empty. Other
    columns are not read; an empty table gives an empty table.

    The ids' order is cut into pieces of about ``piece_bytes`` by exact counts, texts move once to their piece
    and are read there in order. The first document of a piece goes to the piece before it as well.
    """
    low = np.iinfo(np.int64).min
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), whole.alias("text"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(low)).alias("_major"), F.xxhash64(whole).alias("_minor"),
        (F.octet_length(whole).cast("long") + 8).alias("_size"),
    )
    light = cut_lineage(rows.select("_major", "_minor", "_size"), "keys")
    total = light.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    pieces = max(1, min(MAX_PIECES, math.ceil(total / piece_bytes)))
    splitters = find_splitters(light, pieces, 0.2)
    tops = with_piece(light, splitters).groupBy("_piece").agg(F.max(F.struct("_major", "_minor")).alias("top"))
    tops = sorted((r["_piece"], r["top"]["_major"], r["top"]["_minor"]) for r in tops.collect())  # a row a piece
    # the largest key of a piece follows the smallest of the next higher one; the very largest follows the very smallest
    lends = [(major, minor, tops[(i + 1) % len(tops)][0]) for i, (_, major, minor) in enumerate(tops)]
    heads = docs.sparkSession.createDataFrame(lends, "_major long, _minor long, _lend int")
    told = with_piece(rows.drop("_size"), splitters).join(F.broadcast(heads), ["_major", "_minor"], "left")
    own = F.struct(F.col("_piece").alias("piece"), F.lit(0).alias("lent"))
    lent = F.struct(F.col("_lend").alias("piece"), F.lit(1).alias("lent"))
    dealt = told.select(
        F.explode(F.when(F.col("_lend").isNull(), F.array(own)).otherwise(F.array(own, lent))).alias("to"), "id", "text", "_major", "_minor"
    ).select("to.piece", "to.lent", "_major", "_minor", "id", "text")
    in_order = dealt.repartition(pieces, "piece").sortWithinPartitions("piece", "lent", F.desc("_major"), F.desc("_minor"))

    def compared(held: list[tuple]) -> pa.RecordBatch:
        """``held``: rows in order, the last of which is only a next one."""
        texts = [t.encode("utf-8") for _, _, _, t in held]
        own = encode_texts(texts)
        out = [i for i, row in enumerate(held[:-1]) if not row[1]]
        changed = [edited(held[i][3], held[i + 1][3]).encode("utf-8") for i in out]
        new = encode_texts(changed)
        these, following = tuple(x[out] for x in own), tuple(x[[i + 1 for i in out]] for x in own)
        arrays = [
            pa.array([held[i][2] for i in out], pa.int64()), pa.array([len(held[i][3]) for i in out], pa.int64()),
            pa.array([sha256(t).hexdigest() for t in changed], pa.string()), pa.array(to_text(*these), pa.string()),
            pa.array(to_text(*new), pa.string()), pa.array(likeness(these, new)), pa.array(likeness(these, following)),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=[id_col, *RESULT])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            columns = [batch.column(i) for i in (0, 1, 4, 5)]
            for row in zip(*(c.to_pylist() for c in columns), strict=True):
                held.append(row)
                size += len(row[3])
                if size > SLICE_CHARS:
                    yield compared(held)
                    held, size = held[-1:], len(row[3])
        if len(held) > 1:
            yield compared(held)

    schema = f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order.mapInArrow(run, schema)
