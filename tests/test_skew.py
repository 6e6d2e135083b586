"""Hot keys, counted sides, ranks and folds against plain Python; nothing is lost when a key is split."""

import random

import pytest
from pyspark.sql import functions as F

from codexmill import session as X
from codexmill.operators import service as S
from codexmill.operators import skew as K


def test_hot_join(spark):
    rng = random.Random(1)
    many = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(50)}", i) for i in range(3000)] + [(None, 1)]
    few = [("hot", "a"), ("hot", "b"), ("k1", "c"), (None, "d"), ("gone", "e")]
    got = K.hot_join(spark.createDataFrame(few, "k string, x string"), spark.createDataFrame(many, "k string, i long"), ["k"], ["i"], hot=100)
    assert sorted((r.k, r.x, r.i) for r in got.collect()) == sorted((a, x, i) for a, x in few for b, i in many if a == b and a is not None)
    assert got.columns == ["k", "x", "i"]


@pytest.mark.parametrize("limit", [0, 1000])
def test_sized_join(spark, limit):
    big = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("c", 4)], "k string, v long")
    small = spark.createDataFrame([("a", 10), ("c", 30)], "k string, w long")
    rows = lambda how, s=small: sorted(tuple(r) for r in K.sized_join(big, s, ["k"], how, limit).fillna("-").fillna(0).collect())
    assert rows("left_semi", small.select("k")) == [("a", 1), ("c", 4)]
    assert rows("left_anti", small.select("k")) == [("-", 3), ("b", 2)]
    assert rows("left") == [("-", 3, 0), ("a", 1, 10), ("b", 2, 0), ("c", 4, 30)]


def test_ranked(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(40)) for i in range(2000)]
    got = K.ranked(spark.createDataFrame(rows, "id long, v long").repartition(7), F.desc("v"), "id").collect()
    assert [(r.id, r["rank"]) for r in got] == [(i, k) for k, (i, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])), 1)]
    assert K.ranked(spark.createDataFrame([], "id long"), "id").count() == 0


def test_sorted_fold(spark):
    rows = [(k, i, (i * 7 + k) % 5) for k in range(3) for i in range(400)] + [(9, 0, 1)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = K.sorted_fold(df, ["k"], ["i"], lambda: 0, lambda s, r: (s + r.v, [(int(r.i), int(s + r.v))] if r.v == 4 else []), lambda s: [(-1, int(s))], "k long, i long, s long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for k in (0, 1, 2, 9):
        s = 0
        for _, i, v in sorted(r for r in rows if r[0] == k):
            s += v
            want += [(k, i, s)] if v == 4 else []
        want.append((k, -1, s))
    assert sorted(map(tuple, got)) == sorted(want)


def test_materialised_data_can_be_released(spark):
    X.release(spark)
    df = X.materialise(spark.range(5), "x")
    path = df.inputFiles()[0]
    assert df.count() == 5 and X.release(spark) == 1
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_service_edges(spark):
    one = lambda expr, v: spark.createDataFrame([(v,)], "s string").select(expr(F.col("s")).alias("r")).first().r
    assert one(S.clean_path, "/a/./b//../c/") == "/a/c" and one(S.clean_path, "/../x") == "/x"
    assert one(S.cover_lines, "一二三四五六七八九十一二三四五六七八九十一二") == ["一二三四五", "六七八九十", "一二三四五", "六七八九…"]
    assert one(S.cover_lines, "  ") == [] and one(S.cover_lines, "the long and winding road") == ["the long and", "winding road"]
    assert one(S.username_error, "a") == "length" and one(S.username_error, "a b") == "characters" and one(S.username_error, "a.b-c_1") is None
    assert one(S.password_error, "short") == "short" and one(S.password_error, "长" * 25) == "long" and one(S.password_error, "long enough") is None
    assert one(S.percent_escape, "a b/ü~") == "a%20b%2F%C3%BC~" and "export.jsonl" in one(S.attachment, "书.jsonl")
    assert one(lambda c: S.marked(c, "a."), "xA.ya.") == ["x", "A.", "y", "a.", ""]
    assert one(S.upload_name, " /x/.. a?.TXT ") == "a_.txt" and one(S.upload_name, "...") == "book."
    up = spark.createDataFrame([(1, i, "a.txt") for i in range(4)] + [(1, 9, "b.txt")], "folder_id long, upload_id long, name string")
    there = spark.createDataFrame([(1, "a.txt"), (1, "a (2).txt"), (2, "b.txt")], "folder_id long, name string")
    assert {r.upload_id: r.target for r in S.unique_names(up, there).collect()} == {0: "a (1).txt", 1: "a (3).txt", 2: "a (4).txt", 3: "a (5).txt", 9: "b.txt"}
    seen = []
    df, done = S.with_progress(spark.range(7), seen.append)
    df.collect()
    done()
    assert seen == [7]
