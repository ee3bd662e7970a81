"""Top-level JSON objects of files of any layout and size, found in blocks that many tasks scan at once.

A file is read in records that end at a closing brace, wherever it stands; they can begin at any byte range. Blocks
of such records are written once. Whether a block begins inside a string is told by the block itself, where only one
answer leaves no letters outside strings, else by the quotes of all blocks before it. A closing and an opening brace outside
strings, with nothing but white space between, part two objects: inside an object a comma would stand there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmuration.session import cut_lineage

BLOCK_BYTES = 1 << 20
SURE = 8  # bytes that cannot stand outside a string: as many, and none the other way, decide where a block begins
QUOTE, BACKSLASH, OPEN, CLOSE = 0x22, 0x5C, 0x7B, 0x7D
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True
FOREIGN = np.ones(256, bool)  # what no JSON value holds outside its strings
FOREIGN[list(b' \t\n\r{}[]:,".+-0123456789eEtrufalsn')] = False
SUMMARY = "odd int, reset int, foreign_out long, foreign_in long, parts_out int, parts_in int"


class Scan:
    """Where a block's quotes and possible bounds stand, whatever it begins in."""

    def __init__(self, data: np.ndarray, separator: bytes):
        self.data = data
        quotes = np.flatnonzero(data == QUOTE)
        escaped, back, asked = np.zeros(len(quotes), bool), quotes - 1, np.arange(len(quotes))
        while len(asked):  # an odd number of backslashes before a quote takes its meaning
            asked = asked[(back[asked] >= 0) & (data[np.maximum(back[asked], 0)] == BACKSLASH)]
            escaped[asked] ^= True
            back[asked] -= 1
        self.quotes = quotes[~escaped]
        opens = np.flatnonzero(data == OPEN)
        before, asked = opens - 1, np.arange(len(opens))
        while len(asked):
            asked = asked[(before[asked] >= 0) & SPACE[data[np.maximum(before[asked], 0)]]]
            before[asked] -= 1
        after_close = (before < 0) | (data[np.maximum(before, 0)] == CLOSE)  # a block begins after a closing brace, or a file
        self.bounds = opens[after_close]
        # the separator cannot stand inside a string, whatever the quotes before it say
        text, at, found = data.tobytes(), 0, []
        inner = separator.index(b"{")
        while (at := text.find(separator, at)) >= 0:
            found.append(at + inner)
            at += len(separator)
        self.resets = np.array(found, np.int64)

    def inside(self, at: np.ndarray, begins_inside: int) -> np.ndarray:
        """Whether positions are inside a string."""
        count = np.searchsorted(self.quotes, at)
        last = np.searchsorted(self.resets, at, "right") - 1
        base = np.full(len(at), -begins_inside)
        known = last >= 0
        base[known] = np.searchsorted(self.quotes, self.resets[last[known]])
        return (count - base) % 2 == 1

    def parts(self, begins_inside: int) -> np.ndarray:
        """Where objects begin that another one, or the file's begin, is before."""
        return self.bounds[~self.inside(self.bounds, begins_inside)]

    def summary(self) -> list[int]:
        """``(odd, reset, foreign_out, foreign_in, parts_out, parts_in)``: whether the quotes turn the state around; the state at the
        end if a separator told it (else -1); and what follows from beginning outside or inside a string."""
        end = np.array([len(self.data)])
        odd = len(self.quotes) % 2
        reset = int(self.inside(end, 0)[0]) if len(self.resets) else -1
        foreign = np.flatnonzero(FOREIGN[self.data])
        outside = [int((~self.inside(foreign, s)).sum()) for s in (0, 1)]
        return [odd, reset, *outside, len(self.parts(0)), len(self.parts(1))]

    def whole(self, parts: np.ndarray, begins_inside: int) -> np.ndarray:
        """Which stretches from one part to the next are one balanced pair of braces, so that nothing needs a second look."""
        braces = np.flatnonzero((self.data == OPEN) | (self.data == CLOSE))
        braces = braces[~self.inside(braces, begins_inside)]
        depth = np.cumsum(np.where(self.data[braces] == OPEN, 1, -1))
        first = np.searchsorted(braces, parts[:-1])
        last = np.searchsorted(braces, parts[1:]) - 1
        before = np.where(first > 0, depth[np.maximum(first - 1, 0)], 0)
        good = depth[last] == before
        inner = depth.copy()
        inner[last] = np.iinfo(np.int64).max
        lowest = np.minimum.reduceat(inner, first) if len(first) else np.zeros(0, np.int64)
        return good & (lowest > before)


def blocks_of(spark: SparkSession, path, separator: str) -> DataFrame:
    """``(file, start, seq, content, ...)``: blocks in the order of their file, and what they say of themselves."""
    records = spark.read.option("lineSep", "}").text(path)
    mark = separator.encode()

    def run(batches):
        now, held, size, seq = None, [], 0, 0

        def block():
            content = b"".join(held)
            found = Scan(np.frombuffer(content, np.uint8), mark).summary()
            arrays = [pa.array([now[0]], pa.string()), pa.array([now[1]], pa.int64()), pa.array([seq], pa.int32()), pa.array([content], pa.binary())]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            arrays += [pa.array([x], k) for x, k in zip(found, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=["file", "start", "seq", "content", "odd", "reset", "foreign_out", "foreign_in", "parts_out", "parts_in"])

        for batch in batches:
            if not batch.num_rows:
                continue
            starts = batch.column(1).to_numpy()
            files = batch.column(0).dictionary_encode()
            codes = files.indices.to_numpy()
            column = batch.column(2).cast(pa.large_binary())
            _, offsets, data = column.buffers()
            ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
            data = memoryview(data)
            change = np.flatnonzero((np.diff(starts) != 0) | (np.diff(codes) != 0)) + 1
            for a, b in zip([0, *change], [*change, len(starts)], strict=True):
                key = (files.dictionary[int(codes[a])].as_py(), int(starts[a]))
                if key != now:
                    if held:
                        yield block()
                    now, held, size, seq = key, [], 0, 0
                while a < b:
                    upto = int(np.searchsorted(ends, ends[a] + BLOCK_BYTES - size, "right")) - 1
                    upto = min(b, max(upto, a + 1))
                    held.append(bytes(data[ends[a] : ends[upto]]))
                    size += len(held[-1])
                    a = upto
                    if size >= BLOCK_BYTES or a < b:
                        yield block()
                        held, size, seq = [], 0, seq + 1
        if held:
            yield block()

    source = records.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.concat(F.col("value"), F.lit("}")).alias("value")
    )
    return cut_lineage(source.mapInArrow(run, f"file string, start long, seq int, content binary, {SUMMARY}"), "json-blocks")


def states(blocks: DataFrame) -> DataFrame:
    """``(file, start, seq, inside, chain, last_chain)`` of each block: what it begins in, and the number of parts begun before it.

    Only summaries are sorted: a row for each megabyte of a file.
    """
    order = Window.partitionBy("file").orderBy("start", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    told = F.when((F.col("foreign_out") == 0) & (F.col("foreign_in") >= SURE), 0).when((F.col("foreign_in") == 0) & (F.col("foreign_out") >= SURE), 1)
    rows = blocks.drop("content").withColumn("told", told)
    # the state at a block's end, if it is known without the blocks before, less the quotes up to there
    ended = F.when(F.col("reset") >= 0, F.col("reset")).when(F.col("told").isNotNull(), (F.col("told") + F.col("odd")) % 2)
    rows = rows.withColumn("through", F.sum("odd").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("offset", F.pmod(ended + F.col("through"), F.lit(2)))
    known = F.coalesce(F.last("offset", ignorenulls=True).over(before), F.lit(0))
    inside = F.coalesce("told", F.pmod(known + F.col("through") - F.col("odd"), F.lit(2))).cast("int")
    rows = rows.withColumn("inside", inside)
    rows = rows.withColumn("n", F.when(F.col("inside") == 0, F.col("parts_out")).otherwise(F.col("parts_in")))
    has = (F.col("n") > 0).cast("long")
    chain = F.coalesce(F.sum(has).over(before), F.lit(0).cast("long"))
    last = F.sum(has).over(Window.partitionBy("file"))
    return rows.select("file", "start", "seq", "inside", chain.alias("chain"), last.alias("last_chain"))


def objects(spark: SparkSession, path, separator: str, part_of) -> DataFrame:
    """``(file, json, reason)``: all top-level objects of files and whatever else stands in them, with the reason.

    ``part_of(text)`` gives ``(text, reason)`` of what a stretch that is not simply one object holds. Objects that blocks cut
    are put together again: of each block at most its first and last stretch travel.
    """
    blocks = blocks_of(spark, path, separator)
    placed = cut_lineage(states(blocks), "json-states")
    mark = separator.encode()
    names = ["file", "json", "reason", "chain", "start", "seq", "piece", "final"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()]

    def looked_at(text: bytes) -> list[tuple[str, str | None]]:
        return list(part_of(text.decode("utf-8", "replace")))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                file, start, seq, content, inside, chain, last = (c[row].as_py() for c in batch.columns)
                data = np.frombuffer(content, np.uint8)
                scan = Scan(data, mark)
                parts = scan.parts(inside)
                whole, odd = [], []
                if len(parts) > 1:
                    good = scan.whole(parts, inside)
                    for a, b, simple in zip(parts[:-1].tolist(), parts[1:].tolist(), good.tolist(), strict=True):
                        if simple:
                            whole.append(content[a:b])
                        else:
                            odd += looked_at(content[a:b])
                head = content[: parts[0]] if len(parts) else content
                pieces = [(chain, head, chain == last)] if head else []
                if len(parts):
                    pieces.append((chain + 1, content[parts[-1] :], chain + 1 == last))
                n = len(whole) + len(odd)
                arrays = [
                    [file] * (n + len(pieces)),
                    pa.array(whole + [o[0].encode() for o in odd] + [None] * len(pieces), pa.binary()).view(pa.string()),
                    [None] * len(whole) + [o[1] for o in odd] + [None] * len(pieces),
                    [None] * n + [p[0] for p in pieces],
                    [None] * n + [start] * len(pieces),
                    [None] * n + [seq] * len(pieces),
                    [None] * n + [p[1] for p in pieces],
                    [None] * n + [p[2] for p in pieces],
                ]
                yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, k) for a, k in zip(arrays, kinds, strict=True)], names=names)

    whole = blocks.select("file", "start", "seq", "content").join(placed, ["file", "start", "seq"]).select("file", "start", "seq", "content", "inside", "chain", "last_chain")
    schema = "file string, json string, reason string, chain long, start long, seq int, piece binary, final boolean"
    found = cut_lineage(whole.mapInArrow(run, schema), "json-objects")
    pieces = found.where("chain IS NOT NULL").groupBy("file", "chain").agg(
        F.array_sort(F.collect_list(F.struct("start", "seq", "piece"))).alias("pieces"), F.bool_or("final").alias("final")
    )

    def put_together(batches):
        for batch in batches:
            files, texts, reasons = [], [], []
            for row in range(batch.num_rows):
                held = batch.column(1).slice(row, 1).flatten()
                text = b"".join(held.field(2).to_pylist())
                text = text[:-1] if batch.column(2)[row].as_py() else text  # the reader cannot tell whether a file's last brace was there
                for part, reason in looked_at(text):
                    files.append(batch.column(0)[row].as_py())
                    texts.append(part)
                    reasons.append(reason)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (files, texts, reasons)], names=["file", "json", "reason"])

    joined = pieces.select("file", "pieces", "final").mapInArrow(put_together, "file string, json string, reason string")
    return found.where("chain IS NULL").select("file", "json", "reason").unionByName(joined)
