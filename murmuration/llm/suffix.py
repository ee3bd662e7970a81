"""Repeated byte strings: q-gram buckets of sampled suffixes, refined on the buckets of later offsets."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.llm.common import gram_hash, mix, prefix_hash, span_hash, text_bytes, text_slices, tidy
from murmuration.session import cut_lineage, drop_scratch, release_shuffles, scratch_made

FIRST_GRAM = 32  # bytes of the first buckets' strings
TEXTS_BROADCAST = 1 << 20  # keys of texts, 8 bytes each
PART = 32  # neighbouring starts that are judged together
STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    least, held = key, 1
    while 2 * held <= width:
        least = np.minimum(least[:-held], least[held:])
        held *= 2
    rest = width - held
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def blocks_of(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``(row, bucket, whole, low, high, place)``: the starts of all strings of ``length`` bytes, by the suffix they sample.

    A string samples, of all its positions, the one whose q-gram has the least hash (the first such). Equal
    strings sample alike, so strings can only be equal if their suffixes are in one q-gram bucket. ``low`` to
    ``high`` are neighbouring starts that sample one suffix; ``bucket`` names its q-gram, ``whole`` all the bytes
    of the block and where the suffix at ``place`` is in it.
    """
    none = (np.empty(0, np.int64),) * 6
    if len(data) < length:
        return none
    prefix = prefix_hash(data)
    gram = gram_hash(prefix, FIRST_GRAM)
    bits = np.uint64(max(21, int(len(data)).bit_length()))
    each = np.arange(len(gram), dtype=np.uint64)
    sampled = sliding_least(gram >> bits << bits | each, length - FIRST_GRAM + 1) & np.uint64((1 << int(bits)) - 1)
    sampled = sampled.astype(np.int64)
    change = np.zeros(len(sampled) + 1, np.int32)
    full = np.diff(bounds) >= length
    np.add.at(change, bounds[:-1][full], 1)
    np.add.at(change, bounds[1:][full] - length + 1, -1)
    valid = np.cumsum(change[:-1]) > 0
    same = np.zeros(len(sampled) + 1, bool)  # as the start before
    same[1:-1] = (sampled[1:] == sampled[:-1]) & valid[1:] & valid[:-1]
    low = np.flatnonzero(valid & ~same[:-1])
    high = np.flatnonzero(valid & ~same[1:])
    if not len(low):
        return none
    at = sampled[low]
    whole = mix(span_hash(prefix, low, high + length) + (at - low).astype(np.uint64) * STEP)
    row = np.searchsorted(bounds, low, "right") - 1
    return row, gram[at].view(np.int64), whole.view(np.int64), low - bounds[row], high - bounds[row], at - bounds[row]


def rows_with_blocks(batch: pa.RecordBatch):
    """``(key, bytes, blocks)`` of each row of ``(key, text, blocks)``, the blocks as arrays by their names.

    Rows are taken from the batch's own memory one by one, so no second copy of all its texts and blocks exists.
    """
    data, bounds = text_bytes(batch.column(1))
    for row, key in enumerate(batch.column(0).to_numpy()):
        blocks = batch.column(2).slice(row, 1).flatten()
        held = {f.name: blocks.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(blocks.type)}
        yield key, data[bounds[row] : bounds[row + 1]], held


BLOCKS = ["bucket", "whole", "key", "low", "high", "place"]


def sampled_blocks(texts: DataFrame, length: int) -> DataFrame:
    """``(bucket, whole, key, low, high, place)`` of ``(key, text)``."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for first, _, data, bounds in text_slices(batch.column(1)):
                row, bucket, whole, *places = blocks_of(data, bounds, length)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket, whole, keys[first + row], *places)], names=BLOCKS)
        tidy()

    return texts.mapInArrow(run, ", ".join(f"{c} long" for c in BLOCKS))


def part_blocks(open_blocks: DataFrame, length: int) -> DataFrame:
    """``(bucket, whole, key, low, high, place, known)`` of ``(key, text, blocks)``: blocks parted by the distance
    of their starts from the suffix, ``PART`` neighbours each, with a bucket for each part.

    Equal strings have the suffix at equal distances, so they are in like parts; what all strings of a part hold
    in common, nearly all of their bytes, names its bucket.
    """

    def run(batches):
        for batch in batches:
            for key, data, blocks in rows_with_blocks(batch):
                prefix = prefix_hash(data)
                low, high, place, known = (blocks[c] for c in ("low", "high", "place", "known"))
                first, last = (place - high) // PART, (place - low) // PART
                of = np.repeat(np.arange(len(low)), last - first + 1)
                part = np.arange(len(of)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[of]
                at = place[of]
                begin = np.maximum(low[of], at - (part + 1) * PART + 1)
                end = np.minimum(high[of], at - part * PART)
                step = part.astype(np.uint64) * STEP
                bucket = mix(span_hash(prefix, at - part * PART, at - (part + 1) * PART + 1 + length) + step)
                whole = mix(span_hash(prefix, begin, end + length) + (at - begin).astype(np.uint64) * STEP)
                columns = [bucket.view(np.int64), whole.view(np.int64), np.full(len(of), key), begin, end, at]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(known[of])], names=[*BLOCKS, "known"])
        tidy()

    return open_blocks.mapInArrow(run, ", ".join(f"{c} long" for c in BLOCKS) + ", known boolean")


def refined(data: np.ndarray, length: int) -> np.ndarray:
    """Names of the buckets of all strings of ``length`` bytes, by their start.

    The buckets of short strings are refined by the bucket found at the offset where they end, which doubles
    their length; each round reuses the names of the one before. The last round overlaps itself to hit ``length``.
    Names follow from content, so tasks agree on them.
    """
    held = min(FIRST_GRAM, length)
    name = gram_hash(prefix_hash(data), held)
    while held < length and len(name):
        ahead = min(held, length - held)
        name = mix(name[: max(0, len(name) - ahead)] * STEP + name[ahead:])
        held += ahead
    return name


def refined_starts(open_blocks: DataFrame, length: int) -> DataFrame:
    """``(name, key, low, known)`` of ``(key, text, blocks)``: a row for each start of each block."""

    def run(batches):
        for batch in batches:
            for key, data, blocks in rows_with_blocks(batch):
                name = refined(data, length)
                low = blocks["low"]
                sizes = blocks["high"] - low + 1
                known = np.repeat(blocks["known"], sizes)
                start = np.arange(sizes.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
                arrays = [pa.array(name[start].view(np.int64)), pa.array(np.full(len(start), key)), pa.array(start), pa.array(known)]
                yield pa.RecordBatch.from_arrays(arrays, names=["name", "key", "low", "known"])
        tidy()

    return open_blocks.mapInArrow(run, "name long, key long, low long, known boolean")


def repeated(rows: DataFrame, name: str, place: str) -> DataFrame:
    """Names that stand at two places at least. Equal texts have one key, so their places are one."""
    spot = F.xxhash64("key", place)
    ends = rows.groupBy(name).agg(F.min(spot).alias("a"), F.max(spot).alias("b"))
    return ends.where("a <> b").select(name)


def settled(blocks: DataFrame, mark: int) -> tuple[DataFrame, DataFrame]:
    """Of blocks with a flag ``known``: those whose bucket is met at two places, the flag now also set where the
    whole block is; and one block of each kind of the buckets that hold several kinds.

    Tables made since ``mark``, the blocks among them, are deleted as soon as what reads them is written.
    """
    spark = blocks.sparkSession
    # the joined tables are written first, so that a join may split a bucket that very many texts share
    met = cut_lineage(repeated(blocks, "bucket", "low"), "met")
    shared = cut_lineage(blocks.join(met, "bucket", "left_semi"), "shared-buckets")
    drop_scratch(spark, mark, "shared-buckets")
    spot = F.xxhash64("key", "low")
    kinds = cut_lineage(shared.groupBy("bucket", "whole").agg(F.min(spot).alias("first"), F.max(spot).alias("last")), "kinds")
    several = cut_lineage(kinds.groupBy("bucket").count().where("count > 1").select("bucket"), "several")
    marked = shared.join(kinds, ["bucket", "whole"]).select(
        *BLOCKS, (F.col("known") | (F.col("first") != F.col("last"))).alias("known"), "known", (spot == F.col("first")).alias("one")
    )
    marked = cut_lineage(marked.toDF(*BLOCKS, "known", "before", "one"), "marked")
    drop_scratch(spark, mark, "marked", "several")
    opened = cut_lineage(marked.where("one").join(several, "bucket", "left_semi").select(*BLOCKS, "known"), "opened")
    drop_scratch(spark, mark, "marked", "opened")
    return marked, opened


def repeated_spans(docs: DataFrame, text: str = "text", length: int = 400) -> tuple[DataFrame, DataFrame]:
    """``(key, spans)`` of distinct texts, and the texts themselves ``(key, text)`` of those that were looked at.

    ``key`` is ``xxhash64`` of the text. ``spans`` are the rising, disjoint byte ranges ``(low, high)`` covered by
    strings of ``length`` bytes that also start elsewhere, in this or another distinct text, on 64-bit names.
    Texts that several documents have in full are left to the caller.

    Blocks of starts are settled twice: by the q-gram they sample, then, where a bucket holds several kinds of
    block, in parts by nearly all of their bytes. Only parts that still differ are refined start by start.
    """
    long_texts = docs.where(F.octet_length(text) >= length).select(F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    spark = docs.sparkSession
    mark = scratch_made(spark)
    blocks = cut_lineage(sampled_blocks(long_texts, length), "blocks").withColumn("known", F.lit(False))
    marked, opened = settled(blocks, mark)

    def texts_of(some: DataFrame) -> DataFrame:
        """Each distinct text that a table names, once. Not written: what is joined to it needs no further shuffle of texts."""
        keys = some.select("key").distinct()
        keys = F.broadcast(cut_lineage(keys, "keys")) if keys.count() <= TEXTS_BROADCAST else keys
        return long_texts.join(keys, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))

    def with_text(some: DataFrame) -> DataFrame:
        per_text = some.groupBy("key").agg(F.collect_set(F.struct("low", "high", "place", "known")).alias("blocks"))
        return texts_of(some).join(per_text, "key").select("key", "text", "blocks")  # a text's blocks number less than its bytes

    mark = scratch_made(spark)
    parts = cut_lineage(part_blocks(with_text(opened), length), "parts")
    release_shuffles(spark)
    parts_marked, parts_opened = settled(parts, mark)
    starts = cut_lineage(refined_starts(with_text(parts_opened), length), "starts")
    release_shuffles(spark)
    again = cut_lineage(repeated(starts, "name", "low"), "again")
    found = starts.where("not known").join(again, "name", "left_semi")
    ranges = found.select("key", "low", (F.col("low") + length).alias("high"))
    for some in (marked, parts_marked):
        ranges = ranges.unionByName(some.where("known AND NOT before").select("key", "low", (F.col("high") + length).alias("high")))
    gathered = ranges.groupBy("key").agg(F.collect_set(F.struct("low", "high")).alias("r"))  # at most a range a byte of the text
    return merged(gathered), texts_of(marked)


def merged(gathered: DataFrame) -> DataFrame:
    """Join ranges that touch or overlap."""

    def run(batches):
        for batch in batches:
            out = []
            for held in batch.column(1).to_pylist():
                r = np.array([(x["low"], x["high"]) for x in held], np.int64)
                r = r[np.argsort(r[:, 0], kind="stable")]
                reach = np.maximum.accumulate(r[:, 1])
                begins = np.append(True, r[1:, 0] > reach[:-1])
                out.append([{"low": a, "high": b} for a, b in zip(r[begins, 0].tolist(), reach[np.append(begins[1:], True)].tolist(), strict=True)])
            kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["key", "spans"])

    return gathered.mapInArrow(run, "key long, spans array<struct<low:long,high:long>>")


def cut(text: str, spans: list[dict], whole_characters: bool = False) -> bytes:
    """The text's UTF-8 bytes outside the spans; on request characters that are cut in parts stay whole."""
    data, kept, at = text.encode("utf-8"), [], 0
    for span in spans:
        low, high = span["low"], span["high"]
        if whole_characters:
            while low < high and data[low] & 0xC0 == 0x80:
                low += 1
            while high < len(data) and high > low and data[high] & 0xC0 == 0x80:
                high -= 1
        kept.append(data[at:low])
        at = max(at, high)
    return b"".join([*kept, data[at:]])


def dedup_digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 400) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` of every document.

    Every byte is removed that is covered by a string of ``length`` bytes which also starts anywhere else in the
    input, in the same text (overlapping or not) or another row; so of copies none is spared. Null counts as empty.
    Ids may be null or repeat: rows are judged one by one. Other columns are not read; an empty table gives an
    empty one.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id_col), F.xxhash64(whole).alias("key"), F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("sha")
    )
    rows = cut_lineage(rows, "texts-named")
    copies = rows.where(F.col("n_bytes") >= length).groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("copied"))
    spans, texts = repeated_spans(docs, text, length)

    def digest(batches):
        for batch in batches:
            key, removed, n_spans, sha = [], [], [], []
            for k, t, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key.append(k)
                removed.append(sum(x["high"] - x["low"] for x in held))
                n_spans.append(len(held))
                sha.append(sha256(cut(t, held)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())],
                names=["key", "n_removed", "n_spans", "kept_sha"],
            )

    part = texts.join(spans, "key").select("key", "text", "spans").mapInArrow(digest, "key long, n_removed long, n_spans long, kept_sha string")
    joined = rows.join(copies, "key", "left").join(part, "key", "left")
    return joined.select(
        id_col, "n_bytes",
        F.when(F.col("copied"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copied"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copied"), F.lit(sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, text: str = "text", length: int = 400) -> DataFrame:
    """The rows with repeated strings taken out of the text; null texts stay null, other columns stay as they are.

    As ``dedup_digest`` judges them, except that a character of which only some bytes are covered stays whole.
    Only texts of which something goes are sent to Python, and only they come back.
    """
    mark = scratch_made(docs.sparkSession)
    spans, _ = repeated_spans(docs, text, length)
    spans = cut_lineage(spans, "spans")
    drop_scratch(docs.sparkSession, mark, "spans")
    named = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(text).alias("key"), F.octet_length(text).alias("size"))
    copies = named.where(F.col("size") >= length).groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("copied"))
    touched = cut_lineage(spans.join(copies, "key", "full"), "touched")
    keys, n = touched.select("key"), touched.count()
    if n <= TEXTS_BROADCAST:  # only rows of which something goes are shuffled
        keys = F.broadcast(keys)
        rest = named.join(keys, "key", "left_anti")
        hit = cut_lineage(named.join(keys, "key", "left_semi"), "touched-rows").join(touched, "key")
        joined = hit.select("row", "copied", "spans").unionByName(rest.select("row"), allowMissingColumns=True)
    else:
        joined = named.join(touched, "key", "left")

    @F.arrow_udf("string")
    def left_of(texts: pa.Array, copied: pa.Array, held: pa.Array) -> pa.Array:
        out = []
        for row in range(len(texts)):
            whole = texts[row].as_py()
            out.append(whole if whole is None else "" if copied[row].as_py() else cut(whole, held[row].as_py(), whole_characters=True).decode("utf-8"))
        return pa.array(out, pa.string())

    changed = F.coalesce("copied", F.lit(False)) | F.col("spans").isNotNull()
    whole = F.col("row").getField(text)
    new = F.when(changed, left_of(F.when(changed, whole), F.coalesce("copied", F.lit(False)), "spans")).otherwise(whole)
    return joined.select(*(new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns))
