"""BPE and packing against the tokenizers library."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from llm_helpers import documents, odd_texts

from murmuration.llm import bpe, packing
from murmuration.llm.queries import TOKENIZER

ALPHABET = "ab .,'<|endoftext|>éÉ́ÑΣσς1İı२\t\n\x1d\x85　漢字's'T'Re😀!%"


def strange(n, seed=5):
    rng = random.Random(seed)
    fixed = ["a\x1cb c", "<|endoftext|>x<|startoftext|>", "ΑΣ ΑΣΑ.", "éa ́x", "it's I'LL don'T", "½²Ⅷ", "a" * 3000, "x" * 64, "x" * 65, "K. Å.", "İ"]
    return fixed + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(50))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return packing.ChunkIds(TOKENIZER).tokenizer


def test_encode_and_decode(library):
    coder = bpe.load(TOKENIZER)
    for text in strange(1500) + [t for t in odd_texts() if t]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == ids
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert coder.encode(None) == []


def test_every_code_point_as_in_the_library(library):
    coder = bpe.load(TOKENIZER)
    for first in (*range(0, 0x40000, 512), *range(0xE0000, 0xE0200, 512)):
        chars = [chr(c) for c in range(first, first + 512) if not 0xD800 <= c < 0xE000]
        for text in ("".join(f"a{c}b{c}! {c}1 " for c in chars), " ".join(chars)):
            assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(first)


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    coder = bpe.TextCoder(bpe.WordBpe(TOKENIZER), limit=3)
    for text in strange(60, 6):
        chunks = [c for c in coder.bpe.chunks(text) if c]
        coder.learn([chunks])
        assert coder.both(chunks)[0] == " ".join(map(str, library.encode(text, add_special_tokens=False).ids))
    ids = packing.ChunkIds(TOKENIZER, limit=3)
    for text in strange(60, 7):
        assert ids.texts([text])[0] == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_digest(spark, library):
    texts = odd_texts() + strange(50)
    docs = documents(spark, texts, [None, *range(len(texts) - 1)], ["n_tokens", "ids_sha256", "ids"])
    found = {r.text: r for r in bpe.encode_decode(docs, TOKENIZER, texts=True).collect()}
    for text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        r = found[text]
        assert (r.n_tokens, r.ids) == (len(ids), ids)
        assert r.ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digest(documents(spark, []), TOKENIZER).collect() == []


def test_pack(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 30)
    texts = odd_texts()
    docs = documents(spark, texts, extra=["piece", "length", "ids", "sequence_id"])
    packed = packing.pack(docs, TOKENIZER, limit=64, with_ids=True).orderBy("doc_id", "piece").collect()
    for doc, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        mine = [r for r in packed if r.doc_id == doc]
        assert [(r.piece, r.start, r.length) for r in mine] == [(i, 64 * i, len(ids[64 * i : 64 * i + 64])) for i in range(-(-len(ids) // 64))]
        assert [x for r in mine for x in r.ids] == ids
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in mine)
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert [p[0] for p in places] == [sum(x[1] for x in places[:i]) for i in range(len(places))]
        assert sum(p[1] for p in places) <= 64
    assert len(sequences) <= sum(r.length for r in packed) / 64 + len(packed) / 30 + 1  # at most a part of one a group
    assert packing.pack(documents(spark, []), TOKENIZER).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_two_for_one(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 101, rng.integers(1, 400))
    bins = packing.best_two_fit(lengths, 100)
    assert sorted(r for b in bins for r in b) == list(range(len(lengths)))
    assert all(lengths[b].sum() <= 100 for b in bins)
    assert len(bins) <= len(packing.fill(lengths, 100, False)) <= 1.04 * max(lengths.sum() / 100, (lengths > 50).sum()) + 1
    assert packing.best_two_fit(np.array([], np.int64), 100) == []


def test_smallest_gives_way_to_a_better_pair():
    assert sorted(map(sorted, packing.best_two_fit(np.array([60, 35, 20, 20]), 100))) == [[0, 2, 3], [1]]


def test_pairs_on_the_shelf():
    rng = np.random.default_rng(1)
    for _ in range(200):
        lengths = rng.integers(1, 30, rng.integers(2, 9))
        bound = int(rng.integers(1, 60))
        shelf = packing.Shelf(lengths)
        best = max((a + b for i, a in enumerate(lengths) for b in lengths[:i] if a + b <= bound), default=0)
        assert sum(shelf.pair(bound)) == best
