"""Packing token sequences: greedy fill, then one document out for two that fit better."""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmuration.llm.bpe import WordBpe
from murmuration.session import cut_lineage

END_ID = 1
CACHE_CHUNKS = 800_000  # a task's memory for chunks already encoded; it starts anew when full
CACHE_WORDS = 600_000
MARKS = ".,;:!?%&*#$|()[]\"-"  # no letters, digits, apostrophes or white space
GROUP_PIECES = 1 << 16  # pieces packed together; more groups, not larger ones, for more data


class ChunkIds:
    """Ids of texts through the tokenizers library; each stretch without white space is encoded once.

    The library drops white space and no word of it crosses any, so a text's ids are those of its
    stretches one after another. It also parts letters from marks and takes no notice of case, so letters
    with marks behind them are looked up apart, in lower case. What is new is encoded together, divided by
    a special token.
    """

    def __init__(self, file: str, limit: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.divider = max(self.tokenizer.get_added_tokens_decoder())
        self.divider_text = self.tokenizer.id_to_token(self.divider)
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    @staticmethod
    def parts(chunk: str) -> tuple[str, ...]:
        letters = chunk.rstrip(MARKS)
        if letters and letters.isalpha() and max(letters) < "\u0130":  # up to there lower case is letter by letter
            return (letters.lower(), chunk[len(letters) :]) if len(letters) < len(chunk) else (letters.lower(),)
        return (chunk,)

    def learn_words(self, words: set[str]) -> None:
        plain = [w for w in words if "<|" not in w and "|>" not in w]
        for first in range(0, len(plain), 20_000):
            part = plain[first : first + 20_000]
            ids = self._encode(self.divider_text.join(part))
            ends = np.append(np.flatnonzero(ids == self.divider), len(ids))
            starts = np.append(0, ends[:-1] + 1)
            data = ids.tobytes()
            self.words.update((w, data[4 * a : 4 * b]) for w, a, b in zip(part, starts.tolist(), ends.tolist(), strict=True))
        for word in words.difference(plain):
            self.words[word] = self._encode(word).tobytes()

    def learn(self, chunks: set[str]) -> None:
        if len(self.known) > self.limit:
            self.known.clear()
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        known, words = self.known, self.words
        new = {c: self.parts(c) for c in chunks if c not in known}
        self.learn_words({w for parts in new.values() for w in parts if w not in words})
        for chunk, parts in new.items():
            known[chunk] = words[parts[0]] if len(parts) == 1 else words[parts[0]] + words[parts[1]]

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of every text."""
        out, first = [], 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and size < 4 << 20:
                size += len(texts[last] or "")
                last += 1
            cut = [[c for c in WordBpe.chunks(t or "") if c] for t in texts[first:last]]
            self.learn({c for chunks in cut for c in chunks})
            out += [b"".join(map(self.known.__getitem__, chunks)) for chunks in cut]
            first = last
        return out


@lru_cache(maxsize=1)
def _coder(file: str) -> ChunkIds:
    return ChunkIds(file)


PIECE = {"piece": "int", "start": "long", "length": "long", "ids_crc32": "long"}


def token_pieces(docs: DataFrame, file: str, limit: int = 4096, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut the ids of every text, closed by id 1, into pieces of at most ``limit`` tokens.

    Returns the other columns of ``docs``, ``piece, start, length, ids_crc32``, with ``with_ids`` the
    ``ids`` too, and ``_part, _index``: a number for every row. Null, empty and blank texts are one piece of id 1.
    Columns with these names are replaced.
    """
    kinds = PIECE | ({"ids": "array<int>"} if with_ids else {})
    inner = {"_part": "int", "_index": "long"}
    carried = [c for c in docs.columns if c not in kinds and c not in inner and c != text]
    source = docs.select(*carried, text)
    schema = T.StructType(
        [*(f for f in source.schema.fields if f.name != text)]
        + [T.StructField(k, T._parse_datatype_string(v)) for k, v in (kinds | inner).items()]
    )

    def run(batches):
        coder, part, index = _coder(file), TaskContext.get().partitionId(), 0
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            rows, piece, start, length, crc, ids_out = [], [], [], [], [], []
            for row, ids in enumerate(coder.texts(texts)):
                ids += end
                for number, at in enumerate(range(0, len(ids), 4 * limit)):
                    data = ids[at : at + 4 * limit]
                    rows.append(row)
                    piece.append(number)
                    start.append(at // 4)
                    length.append(len(data) // 4)
                    crc.append(zlib.crc32(data))
                    if with_ids:
                        ids_out.append(np.frombuffer(data, "<u4").astype(np.int32))
            taken = pa.array(rows, pa.int64())
            arrays = [batch.column(i).take(taken) for i, c in enumerate([*carried, text]) if c != text]
            arrays += [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            if with_ids:
                arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
            arrays += [pa.array(np.full(len(rows), part, np.int32)), pa.array(np.arange(index, index + len(rows)))]
            index += len(rows)
            yield pa.RecordBatch.from_arrays(arrays, names=[*carried, *kinds, *inner])

    return source.mapInArrow(run, schema)


class Shelf:
    """Unpacked documents by length, with the largest length up to a bound found through one bit per length."""

    def __init__(self, lengths: np.ndarray):
        self.bits = 0
        self.rows: dict[int, list[int]] = {}
        for row in np.argsort(lengths, kind="stable")[::-1].tolist():  # the first rows of a length leave first
            self.put(int(lengths[row]), row)

    def put(self, length: int, row: int) -> None:
        held = self.rows.setdefault(length, [])
        held.append(row)
        self.bits |= 1 << length

    def take(self, length: int) -> int:
        held = self.rows[length]
        row = held.pop()
        if not held:
            self.bits &= ~(1 << length)
        return row

    def largest(self, bound: int) -> int:
        """The largest length up to ``bound``; 0 if there is none."""
        return (self.bits & ((2 << bound) - 1)).bit_length() - 1 if bound > 0 and self.bits & ((2 << bound) - 1) else 0

    def pair(self, bound: int) -> tuple[int, int]:
        """Two lengths, at different rows, with the largest sum up to ``bound``; zeros if there are none."""
        best, a = (0, 0), self.largest(bound - 1)
        while a and 2 * a > sum(best):
            top = min(a if len(self.rows[a]) > 1 else a - 1, bound - a)
            b = self.largest(top)
            if b and a + b > sum(best):
                best = (a, b)
                if a + b == bound:
                    break
            a = self.largest(a - 1)
        return best


def fill(lengths: np.ndarray, limit: int, two_for_one: bool) -> list[list[int]]:
    """Bins of rows. A bin takes the largest document that fits, again and again; with ``two_for_one``, while that
    fills it better, its smallest document then goes back for the two that fill its place best."""
    shelf, bins = Shelf(lengths), []
    while shelf.bits:
        held: list[tuple[int, int]] = []
        gap = limit
        while size := shelf.largest(gap):
            held.append((size, shelf.take(size)))
            gap -= size
        while two_for_one and gap and len(held) > 1:
            size, row = min(held)
            a, b = shelf.pair(gap + size)
            if a + b <= size:
                break
            held.remove((size, row))
            held += [(x, shelf.take(x)) for x in (a, b)]
            shelf.put(size, row)
            gap += size - a - b
        bins.append([row for _, row in held])
    return bins


def best_two_fit(lengths: np.ndarray, limit: int) -> list[list[int]]:
    """Every row in one bin, by ``fill`` with two documents for one; where documents are so large that the small
    ones it spends are missed later, and the greedy bins alone are fewer, these."""
    bins = fill(lengths, limit, True)
    if len(bins) * limit - int(lengths.sum()) >= limit:  # else no packing has fewer
        greedy = fill(lengths, limit, False)
        bins = greedy if len(greedy) < len(bins) else bins
    return bins


def pack(docs: DataFrame, file: str, limit: int = 4096, text: str = "text", with_ids: bool = False) -> DataFrame:
    """``token_pieces`` placed in sequences of at most ``limit`` tokens: adds ``sequence_id, offset`` (long).

    The pieces are numbered where they were made and written to the shared folder; a hash of that number
    deals them into groups of about 65,536, so no key, source or length can fill one group. Every group is
    packed by ``best_two_fit``; a group ends in at most a few bins that are not full. Equal documents are
    packed each for itself; an empty table gives an empty table. Given columns ``sequence_id``, ``offset`` are replaced.
    """
    docs = docs.drop("sequence_id", "offset", "_group")
    pieces = cut_lineage(token_pieces(docs, file, limit, text, with_ids), "pieces")
    groups = max(1, round(pieces.count() / GROUP_PIECES))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("_part", "_index"), F.lit(groups)))
    kept = [f for f in pieces.schema.fields if f.name not in ("_part", "_index")]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = [f.name for f in kept]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_part", "ascending"), ("_index", "ascending")])
        lengths = table["length"].to_numpy()
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        base = int(table["_group"][0].as_py()) << 32
        for number, rows in enumerate(best_two_fit(lengths, limit)):
            sequence[rows] = base + number
            offset[rows] = np.cumsum(lengths[rows]) - lengths[rows]
        out = table.select(names)
        return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return dealt.groupBy("_group").applyInArrow(run, schema)
