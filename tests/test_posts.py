import json

import pytest
from pyspark.sql import functions as F

from murmuration.sources import posts, sinks

STAMP = "Thu Apr 23 06:45:20 +0000 2020"


def post(i, **fields):
    return json.dumps({"created_at": STAMP, "id": i, "lang": "en", **fields}, separators=(",", ":"))


ROWS = [
    post(1, text="only text"),
    post(2, text="short", full_text="top full"),
    post(3, text="short", extended_tweet={"full_text": "nested full"}),
    post(4, text="kept", extended_tweet={}),
    post(5, text="again", retweeted_status={"id": 9}),
    post(6, text="explicit null", retweeted_status=None),
    post(7, text="bonjour", lang="fr"),
    post(8, text='braces }{ and }{"created_at" inside }{'),
    post(9, text=""),
    post(10, text="http://a.b/c @me #tag é 42"),
]
ALL_IDS = set(range(1, 11))


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "x-y-A-2020-04-23-1.json").write_text("".join(ROWS[:6]))
    (tmp_path / "x-y-A-2020-04-24-1.json").write_text("".join(ROWS[6:]))
    return tmp_path


@pytest.mark.parametrize("whole_files", [False, True])
def test_scan(spark, folder, whole_files):
    read = posts.scan_concat_json(spark, str(folder), whole_files=whole_files)
    good, bad = posts.split_rejects(read)
    assert {r.id for r in good.collect()} == ALL_IDS and bad.isEmpty()
    texts = {r.id: r.t for r in good.select("id", posts.best_text().alias("t")).collect()}
    assert texts[2] == "top full" and texts[3] == "nested full" and texts[4] == "kept"
    assert texts[8] == 'braces }{ and }{"created_at" inside }{' and texts[9] == ""


def test_scan_splits_files(spark, tmp_path):
    """The same records whatever the split size, so one large file is read by many tasks."""
    rows = [post(i, text=f"text {i} " + "x" * (i % 50)) for i in range(3000)]
    (tmp_path / "one.json").write_text("".join(rows))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        read = posts.scan_concat_json(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 5
        assert sorted(r.id for r in read.collect()) == list(range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_white_space_between_objects(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n ".join(ROWS))
    read = posts.scan_concat_json(spark, str(tmp_path), whole_files=True)
    assert {r.id for r in read.collect()} == ALL_IDS


@pytest.mark.parametrize("whole_files", [False, True])
def test_truncated_file_is_quarantined(spark, folder, whole_files):
    (folder / "x-y-A-2020-04-25-1.json").write_text(post(11, text="fine") + post(12, text="cut here")[:-6])
    good, bad = posts.split_rejects(posts.scan_concat_json(spark, str(folder), whole_files=whole_files))
    assert {r.id for r in good.collect()} == ALL_IDS | {11}
    (reject,) = bad.collect()
    assert reject.file.endswith("x-y-A-2020-04-25-1.json") and '"id":12' in reject.content


MIXED = [
    ROWS[0] + ROWS[1] + "\n" + ROWS[2] + " \n " + ROWS[3],
    ROWS[4] + json.dumps({"id": 6, "lang": "en", "text": "another first key"}) + ROWS[6],
    "\n".join(ROWS[7:]) + "\n",
]


@pytest.mark.parametrize("whole_files", [False, True])
def test_any_layout_and_key_order(spark, tmp_path, whole_files):
    for i, text in enumerate(MIXED):
        (tmp_path / f"{i}.json").write_text(text)
    good, bad = posts.split_rejects(posts.scan_concat_json(spark, str(tmp_path), whole_files=whole_files))
    assert sorted(r.id for r in good.collect()) == sorted(ALL_IDS) and bad.isEmpty()


@pytest.mark.parametrize("whole_files", [False, True])
def test_every_object_is_a_row_or_a_reject(spark, tmp_path, whole_files):
    broken = ROWS[2].replace('"lang":"en"', '"lang":en')
    texts = [
        ROWS[0] + broken + ROWS[1],
        ROWS[0] + "\n" + broken + "\n" + ROWS[1] + " trailing words",
        ROWS[3] + ROWS[5] + ROWS[4][:-12],
        ROWS[6] + "[1, 2]",
        json.dumps({"id": "no number", "created_at": 5}) + ROWS[7],
    ]
    expected = [(2, 1), (2, 2), (2, 1), (1, 1), (1, 1)]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.json").write_text(text)
    good, bad = posts.split_rejects(posts.scan_concat_json(spark, str(tmp_path), whole_files=whole_files))
    name = F.regexp_extract("file", r"(\d)\.json", 1).cast("int").alias("i")
    counts = [{r.i: r["count"] for r in rows.groupBy(name).count().collect()} for rows in (good, bad)]
    assert [(counts[0].get(i, 0), counts[1].get(i, 0)) for i in range(len(texts))] == expected
    assert any("trailing words" in r.content for r in bad.collect())


def test_lines_are_split_by_their_separator(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(ROWS))
    good, bad = posts.split_rejects(posts.scan_concat_json(spark, str(tmp_path), separator='}\n{"created_at"'))
    assert {r.id for r in good.collect()} == ALL_IDS and bad.isEmpty()


def test_clean_posts(spark, folder):
    rows = posts.clean_posts(posts.scan_concat_json(spark, str(folder))).collect()
    assert {r.doc_id for r in rows} == ALL_IDS - {5, 7}
    assert {str(r.created_at) for r in rows} == {"2020-04-23 06:45:20"}


def test_missing_nested(spark, folder):
    found = posts.missing_nested(posts.scan_concat_json(spark, str(folder)))
    assert {r.id for r in found.collect()} == {4}


def test_select_files_by_day(spark, folder):
    read = posts.scan_concat_json(spark, [str(p) for p in sorted(folder.iterdir())])
    day = read.where(F.col("file").contains("2020-04-24"))
    lines = posts.select_files_by_day(spark.read.text(str(folder)), ["2020-04-24"])
    assert lines.count() == 1 and day.count() == 4


def test_bad_dates_are_null(spark):
    rows = spark.createDataFrame([(STAMP,), ("Thu Apr 23 06:45:20 +0200 2020",), ("yesterday",)], "created_at string")
    got = [r[0] for r in rows.select(posts.parse_created_at()).collect()]
    assert str(got[0]) == "2020-04-23 06:45:20" and got[1:] == [None, None]


def test_csv_round_trip(spark, tmp_path):
    texts = ['say "hi", you', "two\nlines", " padded ", "a,b", 'ends with \\', '""']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, tweet string")
    sinks.write_csv(rows, str(tmp_path / "c"))
    back = posts.read_csv(spark, str(tmp_path / "c"), "i int, tweet string")
    assert {r.i: r.tweet for r in back.collect()} == dict(enumerate(texts))


def test_pair_tables_must_agree(spark, tmp_path):
    spark.range(1).selectExpr("'a' AS text", "id AS created_at").write.parquet(str(tmp_path / "a"))
    spark.range(1).selectExpr("'a' AS words", "id AS created_at").write.parquet(str(tmp_path / "b"))
    with pytest.raises(Exception, match="text"):
        posts.scan_pairs(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).count()


def test_sinks(spark, tmp_path):
    from murmuration.operators.vocab import extend_vocab

    words = spark.createDataFrame([(0, "a"), (1, "b")], "term_id long, term string")
    sinks.write_vocab(words, str(tmp_path / "v"))
    longer = extend_vocab(spark.read.parquet(str(tmp_path / "v")), ["b", "c"])
    assert {(r.term_id, r.term) for r in longer.collect()} == {(0, "a"), (1, "b"), (2, "c")}
    topics = spark.createDataFrame([("r1", 0, "a", 0.5), ("r2", 0, "a", 0.25)], "run string, topic int, term string, prob double")
    sinks.write_distribution(topics, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).where("run = 'r2'").first().prob == 0.25
    shares = spark.createDataFrame([(1, [0.25, 0.75])], "doc_id long, p array<double>")
    sinks.write_csv(shares, str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), header=True).first().p == "0.25|0.75"
    sinks.write_whitened(shares, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).count() == 1
    sinks.write_lexicon(words, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 2


def test_run_metrics(spark, tmp_path):
    for _ in range(2):
        metrics = sinks.RunMetrics(spark, "run")
        with metrics.stage("scan"):
            metrics.observe(spark.range(7), "scan").count()
        metrics.append(str(tmp_path / "m"))
    rows = spark.read.parquet(str(tmp_path / "m")).where("metric = 'rows'").collect()
    assert [r.value for r in rows] == [7.0, 7.0]
