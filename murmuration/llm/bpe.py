"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NEVER = np.iinfo(np.int64).max
CACHE_WORDS = 600_000  # a task's memory for words already encoded; it starts anew when full
CELLS = 1 << 17  # tree cells handled at once
SPACES = regex.compile(r"\p{White_Space}+")
SEPARATORS = regex.compile("[\x1c-\x1f]")  # str.split() takes these as white space, the tokenizer doesn't


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if visible, else the next one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


@lru_cache(maxsize=2)
def other_classes(file: str) -> dict[int, str]:
    """Code points that the tokenizers library takes for another kind (letter, digit, other) than ``regex`` does, each with a
    character of the library's kind: the two know different versions of Unicode. All assigned planes are tried."""
    from tokenizers import Regex, pre_tokenizers

    with open(file, encoding="utf-8") as source:
        pattern = json.load(source)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    split, own = pre_tokenizers.Split(Regex(pattern), "removed", invert=True), regex.compile(pattern)
    stand_ins = {1: "ª", 2: "²", 3: "†"}  # a letter, a digit, neither
    out = {}
    for first in (*range(0x80, 0x40000, 1 << 14), 0xE0000):
        codes = [c for c in range(first, first + (1 << 14)) if not 0xD800 <= c < 0xE000]
        text = " ".join(f"a{chr(c)}!" for c in codes)  # letters join the a, others the mark, digits neither

        def kinds(bounds: list[tuple[int, int]], n: int = len(codes)) -> list[int]:
            starts = {a for a, _ in bounds}
            ends = {b for _, b in bounds}
            return [1 if 4 * i + 2 in ends and 4 * i + 1 not in starts else 2 if 4 * i + 2 in ends else 3 if 4 * i + 1 in starts else 0 for i in range(n)]

        theirs = kinds([b for _, b in split.pre_tokenize_str(text)])
        ours = kinds([m.span() for m in own.finditer(text)])
        out |= {c: stand_ins[t] for c, t, o in zip(codes, theirs, ours, strict=True) if t != o and t}
    return out


@lru_cache(maxsize=2)
def other_cases(file: str) -> dict[int, str]:
    """Code points that the library turns into another lower case than ``str.lower`` does, for the same reason."""
    from tokenizers import Tokenizer

    normalizer, out = Tokenizer.from_file(file).normalizer, {}
    for first in (*range(0x80, 0x40000, 1 << 14), 0xE0000):
        chars = [chr(c) for c in range(first, first + (1 << 14)) if not 0xD800 <= c < 0xE000]
        chars = [c for c in chars if not c.isspace()]  # white space is dropped before
        text = "|".join(chars)
        theirs, ours = normalizer.normalize_str(text).split("|"), WordBpe.normal(text).split("|")
        out |= {ord(c): t for c, t, o in zip(chars, theirs, ours, strict=True) if t != o}
    return out


class WordBpe:
    """A tokenizer file with word ends, read for encoding: lower case, white space dropped.

    The file must hold a BPE model with an end-of-word suffix, the steps NFC, white space to spaces and
    lower case, and one splitting pattern before the byte symbols; anything else is refused.
    """

    def __init__(self, file: str, others: dict[int, str] | None = None, cases: dict[int, str] | None = None):
        self.others = other_classes(file) if others is None else others
        self.cases = other_cases(file) if cases is None else cases
        self.other_chars, self.case_chars = (frozenset(map(chr, x)) for x in (self.others, self.cases))
        with open(file, encoding="utf-8") as source:
            spec = json.load(source)
        model = spec["model"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("not a word BPE tokenizer")
        self.suffix = model["end_of_word_suffix"]
        vocab = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        symbols = byte_symbols()
        self.inside = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + self.suffix] for s in symbols], np.int64)
        pairs = [(x if isinstance(x, list) else x.split(" ")) for x in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        joined = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(left << 32 | right, kind="stable")
        self.pair_keys, self.pair_ranks = (left << 32 | right)[order], order.astype(np.int64)
        self.joined = joined
        self.words: dict[str, list[int]] = {}

    # --- encoding of words

    def _rank_keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
        """What a leaf holds: rank and place in one number, so that the least is the leftmost of lowest rank."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, wanted), len(self.pair_keys) - 1)
        known = (self.pair_keys[at] == wanted) & (left >= 0) & (right >= 0)
        return np.where(known, self.pair_ranks[at] * size + place, NEVER)

    def _merge(self, ids: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
        """Encode many words at once. ``ids``: one row of symbols a word, -1 beyond its length; the width is a power of two.

        Each word has a segment tree whose leaf ``i`` is the pair that starts at symbol ``i``. The roots
        give every word its next merge; a merge changes three leaves and the paths above them.
        """
        n, size = ids.shape
        place = np.arange(size)
        after = np.where(place + 1 < lengths[:, None], place + 1, size)
        before = np.broadcast_to(np.where(place > 0, place - 1, size), (n, size)).copy()
        ids = np.concatenate([ids, np.full((n, 1), -1, np.int64)], axis=1)  # column ``size``: no such symbol
        after = np.concatenate([after, np.full((n, 1), size)], axis=1)
        before = np.concatenate([before, np.full((n, 1), size)], axis=1)
        tree = np.full((n, 2 * size), NEVER, np.int64)
        tree[:, size : 2 * size - 1] = self._rank_keys(ids[:, : size - 1], ids[:, 1:size], place[:-1], size)
        half = size // 2
        while half:
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
            half //= 2

        def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = leaf + size
            tree[rows, node] = value
            for _ in range(size.bit_length() - 1):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.arange(n)
        while True:
            root = tree[rows, 1]
            rows = rows[root < NEVER]
            if not len(rows):
                break
            root = root[root < NEVER]
            at = root % size
            gone = after[rows, at]
            following = after[rows, gone]
            ids[rows, at] = self.joined[root // size]
            ids[rows, gone] = -1
            after[rows, at] = following
            before[rows, following] = at
            after[rows, size] = before[rows, size] = size
            put(rows, gone, np.full(len(rows), NEVER))
            put(rows, at, self._rank_keys(ids[rows, at], ids[rows, following], at, size))
            earlier = before[rows, at]
            has = earlier < size
            some, left = rows[has], earlier[has]
            put(some, left, self._rank_keys(ids[some, left], ids[some, at[has]], left, size))
        left = ids[:, :size] >= 0
        flat, ends = ids[:, :size][left].tolist(), np.cumsum(left.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct pre-split words."""
        raw = [w.encode("utf-8") for w in words]
        lengths = np.array([len(b) for b in raw], np.int64)
        widths = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        out: dict[str, list[int]] = {}
        for width in np.unique(widths):
            chosen = np.flatnonzero(widths == width)
            step = max(1, CELLS // int(width))
            for first in range(0, len(chosen), step):
                part = chosen[first : first + step]
                held = lengths[part]
                inside = np.arange(width) < held[:, None]
                data = np.frombuffer(b"".join(raw[i] for i in part), np.uint8)
                ids = np.full((len(part), int(width)), -1, np.int64)
                ids[inside] = self.inside[data]
                ends = np.cumsum(held) - 1
                ids[np.arange(len(part)), held - 1] = self.last[data[ends]]
                out.update(zip((words[i] for i in part), self._merge(ids, held), strict=True))
        return out

    # --- texts

    @staticmethod
    def normal(piece: str) -> str:
        """NFC and lower case letter by letter (a capital sigma has no final form here)."""
        return unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The stretches between white space; no word crosses one."""
        return SPACES.split(text) if SEPARATORS.search(text) else text.split()

    def split(self, chunk: str) -> list[str]:
        """Words of a stretch without white space; special tokens stand by themselves."""
        if chunk.isalpha() and chunk.isascii():
            return [chunk.lower()]
        parts = self.cut.split(chunk) if self.cut and "<|" in chunk else [chunk]
        words: list[str] = []
        for part in parts:
            words += [part] if part in self.special else self.words_of(self.normal(part if part.isascii() or self.case_chars.isdisjoint(part) else part.translate(self.cases)))
        return words

    def words_of(self, part: str) -> list[str]:
        """What the splitting pattern finds, characters taken for the kinds that the library takes them for."""
        if part.isascii() or self.other_chars.isdisjoint(part):
            return self.pattern.findall(part)
        return [part[slice(*m.span())] for m in self.pattern.finditer(part.translate(self.others))]

    def encode_chunks(self, chunks: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Ids of each of the chunks. Words met before are looked up in a table of bounded size."""
        split = {c: self.split(c) for c in chunks}
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        new = {w for words in split.values() for w in words if w not in self.words and w not in self.special}
        self.words.update(self.encode_words(list(new)))
        known, special = self.words, self.special
        for chunk, words in split.items():
            if len(words) == 1 and words[0] in known:
                yield chunk, known[words[0]]
            else:
                yield chunk, [i for w in words for i in ([special[w]] if w in special else known[w])]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; none for null, empty or blank texts."""
        chunks = [c for c in self.chunks(text or "") if c]
        known = dict(self.encode_chunks(dict.fromkeys(chunks)))
        return [i for c in chunks for i in known[c]]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens joined by spaces, word ends and special tokens as they are."""
        return " ".join(self.tokens[i] for i in ids)


@lru_cache(maxsize=2)
def load(file: str, others: tuple[tuple[int, str], ...] | None = None, cases: tuple[tuple[int, str], ...] | None = None) -> WordBpe:
    return WordBpe(file, None if others is None else dict(others), None if cases is None else dict(cases))


class TextCoder:
    """Encodes and decodes text by text; what a chunk gives is kept in a table of bounded size."""

    def __init__(self, bpe: WordBpe, limit: int = CACHE_WORDS):
        self.bpe, self.limit = bpe, limit
        self.known: dict[str, tuple[str, str]] = {}
        self.names = [str(i) for i in range(max(bpe.tokens) + 1)]

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.known) > self.limit:
            self.known.clear()
        names, tokens, known = self.names, self.bpe.tokens, self.known
        new = {c for chunks in texts for c in chunks if c not in known}
        for chunk, ids in self.bpe.encode_chunks(new):
            known[chunk] = (" ".join([names[i] for i in ids]), " ".join([tokens[i] for i in ids]))

    def both(self, chunks: list[str]) -> tuple[str, str]:
        """The ids, then the decoded text, of a text cut into chunks."""
        found = [x for x in map(self.known.__getitem__, chunks) if x[0]]
        return " ".join([x[0] for x in found]), " ".join([x[1] for x in found])


GROUP_CHARS = 4 << 20


def _groups(texts: list[str | None]) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        part.append(text or "")
        size += len(part[-1])
        if size > GROUP_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_decode(docs: DataFrame, file: str, text: str = "text", texts: bool = False) -> DataFrame:
    """Add ``n_tokens long, ids_sha256 string, decoded_sha256 string`` to every row.

    ``ids_sha256`` is over the decimal ids joined by one space, ``decoded_sha256`` over the UTF-8 of the
    decoded text. With ``texts`` the ids and the decoded text are added too (``ids array<int>, decoded string``).
    Null, empty and blank texts have no tokens and an empty decoding. Other columns go through as they
    are, except that columns with the added names are replaced. Rows are independent and may repeat.
    """
    added = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    if texts:
        added |= {"ids": "array<int>", "decoded": "string"}
    source = docs.select(*[c for c in docs.columns if c not in added])
    schema = T.StructType([*source.schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in added.items())])

    names = [*source.columns, *added]
    others, cases = tuple(other_classes(file).items()), tuple(other_cases(file).items())  # found once, of all code points

    def run(batches):
        coder = TextCoder(load(file, others, cases))
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text)).to_pylist()
            counts, ids_sha, decoded_sha, ids_out, decoded_out = [], [], [], [], []
            for group in _groups(column):
                cut = [[c for c in coder.bpe.chunks(t) if c] for t in group]
                coder.learn(cut)
                for chunks in cut:
                    ids, decoded = coder.both(chunks)
                    counts.append(ids.count(" ") + 1 if ids else 0)
                    ids_sha.append(sha256(ids.encode("ascii")).hexdigest())
                    decoded_sha.append(sha256(decoded.encode("utf-8")).hexdigest())
                    if texts:
                        ids_out.append([int(i) for i in ids.split()])
                        decoded_out.append(decoded)
            arrays = [*batch.columns, pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            if texts:
                arrays += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(decoded_out, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(run, schema)


def digest(docs: DataFrame, file: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every document."""
    return encode_decode(docs.select("doc_id", F.col("text")), file).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"
    )
