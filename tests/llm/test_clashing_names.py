"""Helpers that return whole rows leave every column as it was, whatever its name."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bagminhash, decontaminate, exact, linejoin, shard

NAMES = ("_text_key", "_key", "_id", "_gone", "_ord", "ord", "text_key", "row", "gone", "_row_key", "_tie", "_size", "_part", "a.b", "doc id")


@pytest.fixture(scope="module")
def wide(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words), "one two three\none two three\nfour five", None, "", "alpha beta gamma delta " * 5]
    rows = [(i, t, "en", "s", len(t or ""), *[f"{n}-{i}" for n in NAMES]) for i, t in enumerate(texts)]
    rows.append((None, " ".join(words[:30] + words[31:]), None, None, None, *[f"{n}-x" for n in NAMES]))
    fields = ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {fields}")


def values(df):
    return {(r["doc_id"], *[r[n] for n in NAMES]) for r in df.collect()}


def test_lines_go_and_other_columns_stay(wide):
    got = linejoin.without_repeated_lines(wide)
    assert got.columns == wide.columns and got.count() == wide.count() and values(got) == values(wide)
    by_id = {r["doc_id"]: (r["text"], r["n_chars"]) for r in got.collect()}
    assert by_id[2] == ("one two three\nfour five", 23) and by_id[3] == (None, 0) and by_id[1] == ("", 0) and by_id[0][1] == len(by_id[0][0])


def test_one_row_of_a_class_stays_whole(wide):
    got = bagminhash.keep_one(wide)
    assert got.columns == wide.columns and values(got) <= values(wide)
    assert {r["doc_id"] for r in got.collect()} >= {0, 2, 5} and 1 not in {r["doc_id"] for r in got.collect()}


def test_clean_rows_stay_whole(spark, wide):
    benchmark = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)))], "item_id long, text string")
    got = decontaminate.clean(wide, benchmark)
    assert got.columns == wide.columns and values(got) <= values(wide) and {2, 3, 5} <= {r["doc_id"] for r in got.collect()}


def test_sorted_rows_stay_whole(wide):
    taken = wide.withColumn("shard", F.lit("old")).withColumn("slot", F.lit("old"))
    got = shard.histogram_sort(taken, F.xxhash64("text"), F.col("doc_id"), F.length("text"), shards=3)
    assert got.columns == taken.columns and values(got) == values(wide)
    assert {r["shard"] for r in got.collect()} <= {0, 1, 2} and dict(got.dtypes)["slot"] == "bigint"


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_screened_byte_check_finds_the_same_groups(wide, monkeypatch, most):
    monkeypatch.setattr(exact, "SCREEN_BYTES", most)
    old, new = wide.filter("doc_id % 2 = 0"), wide.filter("doc_id % 2 = 1 OR doc_id IS NULL")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact.deduplicate(old, new).collect()}
    assert got == {0: (0, 2, True), 1: (0, 2, False), 2: (2, 1, True), 3: (3, 2, True), 4: (3, 2, False), 5: (5, 1, True), None: (None, 1, True)}


def test_stages_leave_only_the_scratch_of_the_last_one(spark, wide, monkeypatch):
    left = corpus_pipeline._LEFT.setdefault(spark.sparkContext.applicationId, [])
    stage = dict(corpus_pipeline.STAGES)["line dedup"]
    first = stage(spark, wide, "")
    assert len(left) == 1 and first.count() == wide.count()
    folder = left[0]
    second = stage(spark, wide.limit(3), "")
    assert left != [folder] and len(left) == 1 and second.count() == 3
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
