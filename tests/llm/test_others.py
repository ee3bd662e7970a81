"""Shards, fingerprints, search and page text against plain versions."""

import random
import time
import zlib
from hashlib import sha256

import pytest
from llm_helpers import documents, odd_texts
from pyspark.sql import functions as F

from murmuration.llm import fingerprint, html, sharding, topk


# --- shards


@pytest.mark.parametrize("piece_rows", [1 << 18, 3])
def test_shards(spark, piece_rows):
    texts = odd_texts() * 4
    ids = [None, *range(1, len(texts))]
    docs = documents(spark, texts, ids, ["size", "shard", "slot", "_piece"])
    found = sharding.balanced_shards(docs, 7, piece_rows=piece_rows).collect()
    assert len(found) == len(texts)
    text_of = dict(zip(ids, texts, strict=True))
    sizes, slots, order = {}, {}, []
    for r in found:
        data = (text_of[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        order.append((r.shard, r.slot, text_of[r.doc_id] or ""))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r.size for r in found)
    assert all(abs(sizes.get(k, 0) - sum(sizes.values()) / 7) <= largest for k in range(7))
    in_order = [t for _, _, t in sorted(order)]
    assert sum(a != b for a, b in zip(in_order, in_order[1:], strict=False)) == len(set(in_order)) - 1  # equal texts are neighbours


def test_one_text_is_cut_between_its_ids(spark):
    found = sharding.balanced_shards(documents(spark, ["same"] * 240), 24).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in found) == [10] * 24


def test_rows_of_one_key_stay_together(spark):
    found = sharding.balanced_shards(documents(spark, ["same"] * 9, [5] * 9), 3).collect()
    assert len({r.shard for r in found}) == 1 and sorted(r.slot for r in found) == list(range(9))
    assert sharding.balanced_shards(documents(spark, []), 3).collect() == []


def test_written_shards(spark, tmp_path):
    docs = documents(spark, odd_texts())
    sharding.write_shards(docs, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 3


# --- fingerprints


def test_next_documents(spark):
    texts = odd_texts()
    ids = random.Random(1).sample(range(10**6), len(texts))
    found = {r.doc_id: r for r in fingerprint.compare_with_next(documents(spark, texts, ids), piece_bytes=2000).collect()}
    plain = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(documents(spark, texts, ids, ["fingerprint"])).collect()}
    order = sorted(zip(ids, texts, strict=True), reverse=True)
    for at, (i, text) in enumerate(order):
        text, (after, following) = text or "", order[(at + 1) % len(order)]
        third = len(text) // 3
        new = text[: len(text) - third] + (following or "")[:third]
        r = found[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(text), sha256(new.encode()).hexdigest(), plain[i])
        own, other, changed = (fingerprint.from_text([x]) for x in (plain[i], plain[after], r.edited_fingerprint))
        assert r.near_next == fingerprint.likeness(own, other)[0] and r.near_edited == fingerprint.likeness(own, changed)[0]
        assert r.edited_fingerprint == fingerprint.to_text(*fingerprint.encode_texts([new.encode()]))[0]
    assert len({plain[i] for i, t in zip(ids, texts, strict=True) if t == texts[10]}) == 1


def test_triplets_do_not_cross_texts():
    texts = [b"abc", b"", b"defgh" * 9, b"xy"]
    together = fingerprint.to_text(*fingerprint.encode_texts(texts))
    assert together == [fingerprint.to_text(*fingerprint.encode_texts([t]))[0] for t in texts]


def test_one_document_and_none(spark):
    alone = fingerprint.compare_with_next(documents(spark, ["abcdef" * 9], [None])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    assert fingerprint.compare_with_next(documents(spark, [])).collect() == []


def test_likeness_is_bounded_and_even():
    rng = random.Random(1)
    codes = fingerprint.encode_texts([bytes(rng.choices(range(97, 123), k=2000)) for _ in range(2)] + [b"", b"a" * 10**5])
    pairs = [(tuple(x[[i]] for x in codes), tuple(x[[j]] for x in codes)) for i in range(4) for j in range(4)]
    assert all(0 <= fingerprint.likeness(a, b)[0] <= 1 and fingerprint.likeness(a, b)[0] == fingerprint.likeness(b, a)[0] for a, b in pairs)


# --- search


def plain_search(vectors, k):
    import math

    sound = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in sound:
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in sound if j != i and len(w) == len(v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize(("shard_rows", "query_rows"), [(1 << 14, 1 << 10), (40, 2)])
def test_search(spark, monkeypatch, shard_rows, query_rows):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(topk, "QUERY_ROWS", query_rows)
    rng = random.Random(3)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(700)]
    vectors += [(700 + i, vectors[3][1]) for i in range(15)]  # ties
    vectors += [(800, None), (801, []), (802, [1.0, None, 1.0, 1.0, 1.0]), (803, [float("nan")] * 5), (804, [float("inf")] * 5), (None, [1.0] * 5)]
    vectors += [(900, [1.0, 2.0]), (901, [3.0, -1.0]), (1000, [1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("dims", F.lit(1))
    rounded = [(r.vec_id, None if r.embedding is None else list(r.embedding)) for r in df.collect()]
    found = topk.top_k(df, df.where("vec_id % 100 = 0")).collect()
    assert sorted(tuple(r) for r in found) == plain_search(rounded, 10)


def test_search_in_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty, empty).collect() == []


def test_equal_vectors_make_one_leaf():
    import numpy as np

    tree = topk.BallTree(np.arange(1000), np.ones((1000, 3)))
    assert len(tree.first) == 1


# --- pages

PAGES = {
    "<nav>a b</nav><article><h1>T</h1><p>One, two&amp;three &lt;b&gt;.<p>Four<br>five</article><footer>f</footer>": "T\n\nOne, two&three <b>.\n\nFour five",
    "<body class='has-sidebar'><div id=menu><a href=x>m</a></div><div><h2>H</h2><p>Text, long enough, here.</p><div class='comments'><p>no, no, no</p></div></div>": "H\n\nText, long enough, here.",
    "plain   text": "plain text",
    "<script>var t='</p><p>x';</script><style>p{}</style><!-- c --><p>kept": "kept",
    "<article><p>cut &am": "cut &am",
    "<article><p>a</p><aside>s</aside><div class=ad>ad</div><form>f</form><p>b</p>": "a\n\nb",
    "<div><p>x</p></div": "x",
    "": "",
    "<nav>only</nav>": "",
    "<ul><li>one, and more<li>two</ul>": "one, and more\n\ntwo",
    "<article><p>un<b>bo</b>ld <a href=/q>link</a></p></article>": "unbold link",
    "<div hidden>h</div><main><p>m</p></main>": "m",
    "<article>" + "<div>" * 3000 + "deep": "deep",
}


def test_pages(spark):
    for page, text in PAGES.items():
        assert html.main_text(page) == text
    rows = [(i, "u", p) for i, p in enumerate([None, *PAGES, *PAGES])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    found = html.extract_text(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert [(r.text, r.n_chars) for r in found.orderBy("page_id").collect()] == [("", 0), *((t, len(t)) for _ in range(2) for t in PAGES.values())]
    assert html.extract_text(pages.where("page_id < 0")).collect() == []


def test_wrappers_of_the_article_stay_whatever_their_name():
    text = "A sentence, with commas, that is long enough to count. " * 4
    article = f"<article><p>{text}</p></article>"
    for name in ("content has-sidebar", "no-sidebar", "with-banner", "social-science"):
        assert html.main_text(f'<body><div class="{name}">{article}</div></body>') == text.strip(), name
    assert html.main_text(f"<body><form>{article}</form></body>") == text.strip()
    assert html.main_text(f'<body><form><div class="social-science"><p>{text}</p><p>{text}</p></div></form></body>').count(text.strip()) == 2
    comments = f'<div class="comments"><p>{text}</p><p>{text}</p><p>{text}</p><p>{text}</p><p>{text}</p></div>'
    cards = f'<div class="related"><article><p>{text}</p></article></div>'
    for aside in (comments, cards):
        assert html.main_text(f"<body><article><p>Short, but the article.</p></article>{aside}</body>") == "Short, but the article."


def test_short_sections_beside_the_best_stay():
    long = "<p>" + "A sentence, with commas, that is long enough to count. " * 8 + "</p>"
    short = "One, two, " + "words without a mark " * 14
    links = '<div><a href="/a">another page</a> <a href="/b">and one more</a></div>'
    page = f"<body><section>{long * 6}</section><section><p>{short}</p></section><ul><li>an item</li></ul><blockquote>quoted</blockquote>{links}</body>"
    text = html.main_text(page)
    assert short.strip() in text and text.endswith("an item\n\nquoted")


def test_deep_pages_take_linear_time():
    lines = [f"line {i}, with some text" for i in range(100_000)]
    begin = time.perf_counter()
    found = html.main_text("<body>" + "".join(f"<div>{x}" for x in lines)).split("\n\n")
    assert found == lines[-len(found) :] and len(found) > 1000
    for piece in ("<b>x", "<p>a</section>", "<li>y, z", "<div class=comment>t", "</p><i>", "<h2>t<div>u"):
        html.main_text("<body>" + piece * 50_000)
    assert time.perf_counter() - begin < 30


def test_short_lines_around_an_article_without_a_name():
    article = "<div>" + "".join(f"<p>Paragraph {i}, with commas, and words enough to count as text.</p>" for i in range(5)) + "</div>"
    notices = ["We use cookies to give you the best experience.", "Copyright 2024 Someone", "Readers say it is nice", "3 people read this"]
    page = f"<body><div>{notices[0]}</div>{article}<div><p>The end.</p></div>" + "".join(f"<div>{n}</div>" for n in notices[1:])
    text = html.main_text(page)
    assert "Paragraph 4" in text and text.endswith("The end.")
    assert not any(n in text for n in notices)
    inside = html.main_text(f"<main>{article}<ol class='reader-responses'><li>great read, thanks</li></ol></main>")
    assert "great read" not in inside and "Paragraph 4" in inside
