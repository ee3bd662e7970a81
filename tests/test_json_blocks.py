"""One large file of touching objects, of any layout, read in many blocks: every object is a row or a reject."""

import json
import random

import numpy as np
import pytest

from murmuration.sources import json_blocks, posts

SCHEMA = "n bigint, t string, o struct<a: array<string>, b: string>"


@pytest.fixture
def small_splits(spark, monkeypatch):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    monkeypatch.setattr(json_blocks, "BLOCK_BYTES", 1500)
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def nasty(rng):
    pieces = ['}{', '}{"', '"', "\\", '\\"', "}", "{", "{}", "\n", ",", ":", "[1]", "12", "true", "é日", '"}{"n":1}{"', " ", "word", "}\n{"]
    return "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))


def made(rng, n):
    out = []
    for i in range(n):
        value = {"n": i, "t": nasty(rng), "o": {"a": [nasty(rng) for _ in range(rng.randint(0, 3))], "b": nasty(rng)}}
        keys = list(value)
        rng.shuffle(keys)
        out.append({k: value[k] for k in keys})
    out[n // 2]["t"] = "}" * 4000 + '"' * 50 + "x" * 3000  # an object over several splits
    return out


LAYOUTS = {"touching": lambda rng: "", "lines": lambda rng: "\n", "blanks": lambda rng: " \n\t "[: rng.randint(0, 4)], "windows": lambda rng: "\r\n"}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_every_layout(spark, tmp_path, small_splits, layout):
    rng = random.Random(layout)
    values = made(rng, 700)
    texts = [json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, None, None, 1])) for v in values]
    (tmp_path / "one.json").write_text("".join(t + LAYOUTS[layout](rng) for t in texts), encoding="utf-8")
    read = posts.scan_concat_json(spark, str(tmp_path), schema=SCHEMA)
    good, bad = posts.split_rejects(read)
    assert bad.collect() == []
    rows = {r.n: r for r in good.collect()}
    assert len(rows) == len(values) == good.count()
    for v in values:
        assert rows[v["n"]].t == v["t"] and rows[v["n"]].o.a == v["o"]["a"] and rows[v["n"]].o.b == v["o"]["b"]
    blocks = json_blocks.blocks_of(spark, str(tmp_path), posts.SEPARATOR)
    sizes = [len(r.content) for r in blocks.select("content").collect()]
    assert blocks.select("start").distinct().count() > 5 and len(sizes) > 50 and max(sizes) < 5000


@pytest.mark.parametrize("cut", ["brace", "string", "quote"])
def test_broken_objects_are_rejects_and_their_neighbours_rows(spark, tmp_path, small_splits, cut):
    rng = random.Random(7)
    texts = [json.dumps({"n": i, "t": "some words here, and there", "o": {"b": str(rng.random())}}) for i in range(600)]
    broken = set(range(50, 600, 100))
    for i in broken:
        texts[i] = {"brace": texts[i][:-2], "string": texts[i][:25], "quote": texts[i].replace(': "some', ": some")}[cut]
    (tmp_path / "one.json").write_text("\n".join(texts))
    good, bad = posts.split_rejects(posts.scan_concat_json(spark, str(tmp_path), schema=SCHEMA, separator='}\n{"n"'))
    found = {r.n for r in good.collect()}
    assert found <= set(range(600)) - broken
    near = {i + d for i in broken for d in (-1, 0, 1)}
    assert set(range(600)) - near <= found  # reading is sure again at the next separator
    content = "".join(r.content for r in bad.collect())
    for i in set(range(600)) - found:
        assert f'"n": {i}' in content


def test_state_at_any_place_of_a_text():
    rng = random.Random(3)
    text = "".join(json.dumps(v) for v in made(rng, 40)).encode()
    inside, state, escaped = [], False, False
    for c in text:
        inside.append(state)
        if state and escaped:
            escaped = False
        elif state and c == 0x5C:
            escaped = True
        elif c == 0x22:
            state = not state
    closes = [i + 1 for i, c in enumerate(text[:-1]) if c == 0x7D]
    for at in rng.sample(closes, 60):
        scan = json_blocks.Scan(np.frombuffer(text[at:], np.uint8), b'}{"created_at"')
        assert scan.inside(np.arange(len(text) - at), int(inside[at])).tolist() == [bool(x) for x in inside[at:]]


def test_empty_and_blank_files(spark, tmp_path):
    (tmp_path / "a.json").write_text("")
    (tmp_path / "b.json").write_text(" \n ")
    (tmp_path / "c.json").write_text('﻿{"n": 1}\n')
    (tmp_path / "d.json").write_text("no object")
    good, bad = posts.split_rejects(posts.scan_concat_json(spark, str(tmp_path), schema=SCHEMA))
    assert [r.n for r in good.collect()] == [1] and [r.content for r in bad.collect()] == ["no object"]
