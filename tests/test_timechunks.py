import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from murmuration.operators import timechunks

START = datetime(2020, 4, 23, 6, 0, 0)


def greedy(rows, days):
    """The rule read literally: a chunk takes rows while its last taken row lies inside the span."""
    queue, chunks = sorted(rows, key=lambda r: (r[1], r[0])), []
    while queue:
        chunk = [queue.pop(0)]
        while queue and chunk[-1][1] < chunk[0][1] + timedelta(days=days):
            chunk.append(queue.pop(0))
        chunks.append(chunk)
    return {r[0]: i for i, chunk in enumerate(chunks) for r in chunk}


def at(*hours):
    return [(i, START + timedelta(hours=h)) for i, h in enumerate(hours)]


CASES = {
    "boundary row closes the chunk": at(0, 1, 168, 169, 400),
    "equal times on the boundary": at(0, 168, 168, 168, 169),
    "long gap": at(0, 1, 1000, 1001, 5000),
    "single tail": at(0, 100, 200, 201 + 168),
    "one row": at(5),
    "microseconds": [(0, START), (1, START + timedelta(days=7, microseconds=-1)), (2, START + timedelta(days=7, microseconds=1)), (3, START + timedelta(days=7, microseconds=2))],
    "many": [(i, START + timedelta(minutes=(i * i * 37) % 90_000)) for i in range(400)],
}


@pytest.mark.parametrize("name", CASES)
def test_anchored_weeks(spark, name):
    rows = CASES[name]
    frame = spark.createDataFrame(rows, "doc_id long, ts timestamp_ntz").repartition(3)
    got = {r.doc_id: r.chunk_id for r in timechunks.anchored_weeks(frame, "ts", "doc_id").collect()}
    assert got == greedy(rows, 7)


@pytest.mark.parametrize("most", [4096, 3])
@pytest.mark.parametrize("seed", range(3))
def test_uneven_rows_over_years(spark, monkeypatch, seed, most):
    """Gaps, bursts of equal times and drift; few jobs however many chunks there are."""
    monkeypatch.setattr(timechunks, "MOST_ROWS", most)
    rng = random.Random(seed)
    hours, rows = 0.0, []
    while hours < 24 * 365 * (10 if seed == 0 else 2):
        hours += rng.choice([0, 1, 5, 30, 30]) if seed else 6
        hours += 24 * 40 if seed and rng.random() < 0.002 else 0
        rows += [(len(rows), START + timedelta(hours=hours)) for _ in range(1 if rng.random() > 0.02 else 30 if seed else 1)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, ts timestamp_ntz")
    looked = []
    heads = timechunks._span_heads
    monkeypatch.setattr(timechunks, "_span_heads", lambda *a: looked.append(1) or heads(*a))
    starts = timechunks.chunk_starts(frame, "ts", "doc_id")
    chunks = greedy(rows, 7)
    place = dict(rows)
    first = {}
    for i, c in sorted(chunks.items(), key=lambda x: (place[x[0]], x[0])):
        first.setdefault(c, i)
    assert [i for _, i in starts] == [first[c] for c in range(len(first))]
    assert len(starts) > 60
    if most == 4096:
        assert len(looked) == 1 if seed == 0 else len(looked) <= 10


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_other_time_zones(spark, kind):
    rows = CASES["many"] + [(1000 + i, t + timedelta(days=200)) for i, t in CASES["many"]]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        frame = spark.createDataFrame(rows, "doc_id long, ts timestamp_ntz")
        if kind == "timestamp":  # the same moments as UTC instants
            frame = frame.withColumn("ts", F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', ts))"))
        got = {r.doc_id: r.chunk_id for r in timechunks.anchored_weeks(frame, "ts", "doc_id").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == greedy(rows, 7)


def test_empty_input(spark):
    frame = spark.createDataFrame([], "doc_id long, ts timestamp_ntz")
    assert timechunks.anchored_weeks(frame, "ts", "doc_id").isEmpty()


def test_named_weeks(spark):
    rows = [(i, START + timedelta(days=i)) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, ts timestamp_ntz")
    found = {}
    for r in timechunks.named_weeks(frame, "ts").collect():
        found.setdefault(r.bucket, []).append(r.day)
    assert {k: len(v) for k, v in found.items()} == {"start": 7, "mid": 7, "end": 7}
    assert min(found["mid"]) == (START + timedelta(days=50)).date()


def test_rows_without_a_time_stay(spark):
    rows = [(0, START), (1, None), (2, START + timedelta(days=9)), (3, START + timedelta(days=9))]
    frame = spark.createDataFrame(rows, "doc_id long, ts timestamp_ntz")
    got = {r.doc_id: r.chunk_id for r in timechunks.anchored_weeks(frame, "ts", "doc_id").collect()}
    assert got == {0: 0, 1: None, 2: 0, 3: 1}
    none = timechunks.anchored_weeks(frame.where("doc_id = 1"), "ts", "doc_id").collect()
    assert [r.chunk_id for r in none] == [None]
