from __future__ import annotations

import re
from types import SimpleNamespace

import pytest

from salesops.operators import joins
from salesops.operators.joins import lookup_join
from salesops.plans import lineage
from tests.conftest import plan, rows


@pytest.fixture(scope="module")
def sides(spark):
    big = spark.sql(
        """SELECT id, CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 11 > 0 THEN CAST(id % 7 AS STRING) END AS k
        FROM range(300)"""
    )
    lookup = spark.createDataFrame([("hot", 1), ("2", 2), ("5", 3), ("9", 4)], "k string, v int")
    return big, lookup


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast_join(sides, how):
    big, lookup = sides
    small_side = lookup_join(big, lookup, "k", how)
    salted = lookup_join(big, lookup, "k", how, max_broadcast_rows=3, salt=5)
    assert sorted(rows(salted), key=repr) == sorted(rows(small_side), key=repr)
    assert salted.columns == small_side.columns


def test_hot_keys_are_counted(sides):
    big, _ = sides
    assert [r["k"] for r in joins.hot_keys(big, "k", share=4).collect()] == ["hot"]
    assert joins.hot_keys(big, "k", share=3).count() == 0
    assert joins.hot_keys(big.filter("false"), "k").count() == 0


def test_copies_of_one_row_are_spread(spark):
    copies = spark.range(0, 4000, 1, 16).selectExpr("'hot' AS k", "1 AS v")
    lookup = spark.createDataFrame([("hot", "x"), ("cold", "y")], "k string, w string")
    joined = lookup_join(copies, lookup, "k", "inner", max_broadcast_rows=0, salt=8)
    assert joined.count() == 4000
    salts = copies.select(
        (joins.F.pmod(joins.F.xxhash64("k", "v", joins.F.spark_partition_id()), joins.F.lit(8))).alias("s")
    )
    assert salts.distinct().count() > 3


def test_large_lookup_is_not_hinted(sides):
    big, lookup = sides
    assert "_salt" in plan(lookup_join(big, lookup, "k", "inner", max_broadcast_rows=3))
    assert "_salt" not in plan(lookup_join(big, lookup, "k"))


def test_hot_key_is_spread(spark, sides):
    big, lookup = sides
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup_join(big, lookup, "k", "inner", max_broadcast_rows=0, salt=8)
        shuffles = re.findall(r"hashpartitioning\((.*?), \d+\)", plan(joined))
        expected = sorted(rows(lookup_join(big, lookup, "k")), key=repr)
        assert sorted(rows(joined), key=repr) == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(shuffles) == 2
    assert all(s.startswith("k#") and "_salt#" in s for s in shuffles)


def test_unknown_join_type(sides):
    with pytest.raises(ValueError):
        lookup_join(*sides, "k", "full")


def test_cut_drops_lineage(spark):
    df = lineage.cut(spark.range(10).selectExpr("id * 2 AS x"))
    assert "Range" not in plan(df)
    assert df.agg({"x": "sum"}).first()[0] == 90


class FakeContext:
    def __init__(self, master: str):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def fake_session(master: str, named: str | None):
    conf = {"spark.checkpoint.dir": named, "spark.sql.warehouse.dir": "/shared/warehouse"}
    return SimpleNamespace(conf=conf, sparkContext=FakeContext(master))


def test_shared_folder_comes_from_the_session():
    assert lineage.shared_dir(fake_session("spark://m:7077", "/shared/x")) == "/shared/x"
    for master in ("spark://m:7077", "local[2]"):
        assert lineage.shared_dir(fake_session(master, None)) == "/shared/warehouse/_scratch"


def test_released_folders_are_gone(spark):
    path = lineage.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    kept, lineage._made[:] = lineage._made[:-1], [path]
    lineage.release(spark)
    lineage._made[:] = kept
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_scratch_paths_differ(spark):
    a, b = lineage.scratch_path(spark, "m"), lineage.scratch_path(spark, "m")
    assert a != b and a.startswith(lineage.shared_dir(spark).rstrip("/"))
