"""How far the sources of a language differ in their terms: sorted sparse counts, merged pair by pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.llm.common import text_slices
from murmuration.session import cut_lineage

SCALE_STEPS = 3  # one billion is a thousand to this power
BLOCK_TERMS = 1 << 16  # terms whose counts meet in one task
TILE_GROUPS = 8  # sources of either side of a task
STRIDE = 64  # every so many elements one is placed by itself; the others gallop from there
SLICE = 8 << 20
IN_TERM = np.zeros(256, bool)
IN_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def terms_of(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts in order, and the row each stands in."""
    inside = IN_TERM[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    filled = bounds[:-1][np.diff(bounds) > 0]  # a text's first byte starts a term whatever stands before
    begins[filled] = inside[filled]
    last = bounds[1:][np.diff(bounds) > 0] - 1
    ends[last] = inside[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    letters = np.ascontiguousarray(LOWER[data[inside]])
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters))
    return terms, np.searchsorted(bounds, starts, "right") - 1


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, count, docs)`` of ``(lang, source, text)`` without nulls, added up in slices and then for all."""

    def run(batches):
        for batch in batches:
            groups = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], names=["lang", "source"])
            names: dict[tuple, int] = {}
            of_row = np.array([names.setdefault((g["lang"], g["source"]), len(names)) for g in groups.to_pylist()], np.int64)
            langs, sources = (pa.array([n[i] for n in names], pa.string()) for i in (0, 1))
            for first, last, data, bounds in text_slices(batch.column(2), SLICE):
                terms, row = terms_of(data, bounds)
                if not len(terms):
                    continue
                coded = terms.dictionary_encode()
                width = len(coded.dictionary)
                in_row, count = np.unique(row * width + coded.indices.to_numpy(), return_counts=True)
                key = of_row[first:last][in_row // width] * width + in_row % width
                found, place = np.unique(key, return_inverse=True)
                arrays = [
                    langs.take(pa.array(found // width)), sources.take(pa.array(found // width)),
                    coded.dictionary.take(pa.array(found % width)).cast(pa.string()),
                    pa.array(np.bincount(place, count).astype(np.int64)), pa.array(np.bincount(place)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "count", "docs"])

    parts = docs.mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, total: int) -> np.ndarray:
    """``1 + floor(10^9 * (count + 1) / total)`` by long division, exact for totals below 9 * 10^15."""
    rest, out = count + 1, np.zeros_like(count)
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def share_column(count: Column, total: Column) -> Column:
    """``share`` of long columns."""
    rest, out = count + 1, F.lit(0).cast("long")
    for _ in range(SCALE_STEPS):
        scaled = rest * 1000
        rest = scaled % total
        out = out * 1000 + _div(scaled, total)
    return out + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def gallop(wanted: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where rising ``wanted`` numbers would be put into rising ``ids``.

    One in ``STRIDE`` is placed by binary search. The others start from there and double their steps until they
    have passed their number, then halve them; all numbers step together.
    """
    anchors = np.searchsorted(ids, wanted[::STRIDE])
    low = np.repeat(anchors, STRIDE)[: len(wanted)]  # all ids before it are smaller
    reach, moving = 1, np.arange(len(wanted))
    high = low.copy()
    while len(moving):  # find a step that is not smaller any more
        probe = low[moving] + reach - 1
        inside = probe < len(ids)
        smaller = np.zeros(len(moving), bool)
        smaller[inside] = ids[probe[inside]] < wanted[moving[inside]]
        high[moving] = np.minimum(probe, len(ids))
        low[moving[smaller]] = probe[smaller] + 1
        high[moving[smaller]] = len(ids)
        moving = moving[smaller]
        reach *= 2
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        smaller = ids[middle] < wanted[open_]
        low[open_[smaller]] = middle[smaller] + 1
        high[open_[~smaller]] = middle[~smaller]


class Counts:
    """One source's counts of the terms of a block: rising ids, their shares, and the share of a term it lacks."""

    def __init__(self, source: str, total: int, ids: bytes, counts: bytes):
        self.source = source
        self.ids = np.frombuffer(ids, np.int64)
        total = max(1, total)  # zero only where no term is kept, and then nothing is priced
        self.shares = share(np.frombuffer(counts, np.int64), total)
        self.absent = share(np.zeros(1, np.int64), total)


def merge(a: Counts, b: Counts, terms: int) -> tuple[int, int]:
    """Both ways: the sum of prices over ``terms`` terms of a block, ``a`` against ``b`` and ``b`` against ``a``."""
    small, large = (a, b) if len(a.ids) <= len(b.ids) else (b, a)
    at = gallop(small.ids, large.ids)
    common = np.zeros(len(small.ids), bool)
    inside = at < len(large.ids)
    common[inside] = large.ids[at[inside]] == small.ids[inside]
    only = np.ones(len(large.ids), bool)
    only[at[common]] = False
    neither = terms - len(small.ids) - int(only.sum())
    there, here = 0, 0  # small against large, large against small
    for p, q, times in (
        (small.shares[common], large.shares[at[common]], 1),
        (small.shares[~common], large.absent, 1),
        (small.absent, large.shares[only], 1),
        (small.absent, large.absent, neither),
    ):
        there += times * int(price(p, q).sum())
        here += times * int(price(q, p).sum())
    return (there, here) if small is a else (here, there)


def merged_pairs(blocks: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` of every ordered pair of sources of a language, from the blocks of their counts.

    ``blocks``: ``(lang, block, terms, tile, tiles, source, total, ids, counts)``. A task holds two tiles of sources in one
    block of terms; each unordered pair is merged once and priced both ways.
    """
    columns = ["lang", "block", "terms", "source", "total", "ids", "counts"]
    left = blocks.select(*columns, F.col("tile").alias("one"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("two"))
    right = blocks.select(*columns, F.col("tile").alias("two"), F.explode(F.sequence(F.lit(0), "tile")).alias("one"))
    keys = ["lang", "block", "one", "two"]

    def held(table: pa.Table) -> list[Counts]:
        held = ["source", "total", "ids", "counts"]
        return sorted((Counts(*row) for row in zip(*(table[c].to_pylist() for c in held), strict=True)), key=lambda c: c.source)

    def meet(ones: pa.Table, twos: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if ones.num_rows and twos.num_rows:
            lang, terms = ones["lang"][0].as_py(), ones["terms"][0].as_py()
            same = ones["one"][0].as_py() == ones["two"][0].as_py()
            first = held(ones)
            second = first if same else held(twos)
            for i, a in enumerate(first):
                for b in second[i + 1 :] if same else second:
                    there, here = merge(a, b, terms)
                    out += [(lang, a.source, b.source, there), (lang, b.source, a.source, here)]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.table([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=["lang", "source", "item", "value"])

    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "lang string, source string, item string, value long")
    return met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def packed_blocks(joined: DataFrame, groups: DataFrame, sizes: DataFrame, in_block: DataFrame) -> DataFrame:
    """The rows that ``merged_pairs`` takes: every source of a language in every block of its terms, also without any."""
    tiles = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE_GROUPS).cast("int").alias("tiles"))
    every = groups.join(sizes, "lang").join(tiles, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
    every = every.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("total", F.col("n") + F.col("kept"))
    every = every.join(in_block, ["lang", "block"], "left").withColumn("terms", F.coalesce("terms", F.lit(0).cast("long")))
    found = joined.groupBy("lang", "source", "block").agg(F.array_sort(F.collect_list(F.struct("id", "count"))).alias("found"))
    rows = every.join(found, ["lang", "source", "block"], "left").select(
        "lang", "block", "terms", "tile", "tiles", "source", "total", F.col("found.id").alias("id"), F.col("found.count").alias("count")
    )

    def pack(batches):
        for batch in batches:
            packed = []
            for column in (batch.column(7), batch.column(8)):
                flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())])
                packed.append(pa.array([flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], *packed], names=[*batch.schema.names[:7], "ids", "counts"])

    schema = "lang string, block int, terms long, tile int, tiles int, source string, total long, ids binary, counts binary"
    return rows.mapInArrow(pack, schema)


def source_divergence(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 3, top: int = 200
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far each source's shares of terms lie from others'.

    A term is a run of ASCII letters and characters beyond ASCII, A-Z in lower case; a language keeps the terms of at
    least ``least_docs`` of its documents. A term's share in a group that counts it c times is
    ``p = 1 + floor(10^9 * (c + 1) / (N + V))``, with N the group's count over the V kept terms, and the price of p against q is
    ``floor((p - q)^2 / q)``. Part ``pair``: the sum of a source's prices against each other source of its language
    over all kept terms (0 if there are none). Part ``term``: the source's terms whose share is above the language's, with
    their prices, the first ``top``. Ranks count from 1 by falling value, then by the item's bytes.

    Nulls count as empty strings, so null and empty sources are one group. Sources without a term are groups like others;
    repeated rows count each time. Other columns are not read. An empty table gives an empty table. Sums are whole
    numbers throughout, exact for groups of up to 9 * 10^15 terms.

    Counts are added up inside tasks before they are shuffled, so no group, source or term meets in one task. Terms are
    dealt to blocks of about 65,536, and a task merges the sorted counts of a few sources in one block.
    """
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    counts = cut_lineage(term_counts(texts), "term-counts")
    totals = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("all")).where(F.col("docs") >= least_docs)
    totals = cut_lineage(totals.select("lang", "term", "all"), "kept-terms")
    names = texts.select("lang", "source").distinct()
    kept = totals.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("all").alias("all_n"))
    sizes = names.select("lang").distinct().join(kept, "lang", "left").fillna(0, ["kept", "all_n"])
    sizes = cut_lineage(sizes.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") / BLOCK_TERMS)).cast("int")), "languages")
    blocked = totals.join(sizes.select("lang", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    order = Window.partitionBy("lang", "block").orderBy("term")
    ids = cut_lineage(blocked.select("lang", "block", "term", "all", F.row_number().over(order).cast("long").alias("id")), "term-ids")
    joined = cut_lineage(counts.drop("docs").join(ids, ["lang", "term"]), "kept-counts")
    sums = joined.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = cut_lineage(names.join(sums, ["lang", "source"], "left").fillna(0, ["n"]), "groups")
    in_block = ids.groupBy("lang", "block").agg(F.count(F.lit(1)).alias("terms"))
    pairs = merged_pairs(cut_lineage(packed_blocks(joined, groups, sizes, in_block), "blocks"))

    priced = joined.join(groups, ["lang", "source"]).join(sizes, "lang").select(
        "lang", "source", F.col("term").alias("item"),
        share_column(F.col("count"), F.col("n") + F.col("kept")).alias("p"), share_column(F.col("all"), F.col("all_n") + F.col("kept")).alias("q"),
    )
    above = priced.where("p > q").select("lang", "source", "item", _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value"))
    by_value = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pairs.withColumn("rank", by_value).withColumn("part", F.lit("pair"))
    first = above.withColumn("rank", by_value).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return ranked.unionByName(first).select("lang", "source", "part", "item", "value", "rank")
