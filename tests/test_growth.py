"""What grows with the tables stays off the driver, off single tasks, and is done once."""

import os

import pytest
from pyspark.sql import functions as F

from stowline.functions import paths as P
from stowline.operators import matching as M
from stowline.operators import records as RC
from stowline.operators import refs as RF
from stowline.operators import resolve as R
from stowline.operators import skew
from stowline.plans import bindings as B
from stowline.plans import queries_records as QR


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_a_side_that_does_not_fit_is_not_broadcast_by_a_guess(spark, monkeypatch, how):
    monkeypatch.setattr(skew, "fits_broadcast", lambda df, *a: False)
    big, small = spark.range(50).withColumnRenamed("id", "k"), spark.range(20).select(F.col("id").alias("k"), F.lit(1).alias("w"))
    joined = skew.checked_join(big, small, ["k"], how)
    assert "SortMergeJoin" in plan(joined) and "BroadcastHashJoin" not in plan(joined)
    assert joined.count() == {"inner": 20, "left": 50, "left_semi": 20, "left_anti": 30}[how]


def test_the_other_side_is_broadcast_if_it_is_the_smaller_one(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 20)
    few, many = spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("v")), spark.range(400).select((F.col("id") % 20).alias("k"), F.col("id").alias("w"))
    joined = skew.checked_join(few, many, ["k"])
    assert "BroadcastHashJoin [k" in plan(joined) and "BuildLeft" in plan(joined)
    assert joined.columns == ["k", "v", "w"] and joined.count() == 200


def test_items_of_long_lists_take_their_texts_from_the_leaf(spark):
    item = F.array(F.struct(F.lit("files").alias("key"), F.lit(2).cast("long").alias("idx")))
    leaf = spark.createDataFrame([(1, "x.fa"), (2, "y.fa"), (3, "z.fa")], "rec_id long, value string").select(
        "rec_id", item.alias("path"), F.lit("string").alias("kind"), "value")
    matches = spark.createDataFrame([("x.fa", 4, "gs://a/x.fa"), ("x.fa", 7, "gs://b/x.fa"), ("y.fa", 5, "gs://a/y.fa")], "name string, ord long, uri string")
    filled = QR.shown_filled(R.fill_references(QR.labelled(leaf), matches, F.lit(True)))
    assert sorted(tuple(r) for r in filled.collect()) == [
        (1, "files", "2.4", "string", "gs://a/x.fa", True), (1, "files", "2.7", "string", "gs://b/x.fa", True),
        (2, "files", "2", "string", "gs://a/y.fa", True), (3, "files", "2", "string", "z.fa", False)]


def test_a_pattern_is_walked_once(spark, monkeypatch):
    seen, walk = [], R.walk_folders
    monkeypatch.setattr(R, "walk_folders", lambda tree, asked, *a: seen.append(asked.count()) or walk(tree, asked, *a))
    listing = spark.createDataFrame([("/d/r1/s_1.bam",), ("/d/r2/s_2.bam",), ("/d/r2/t.bam",)], "path string")
    asked = spark.range(30).select(F.col("id").alias("req_id"), F.lit("s").alias("name"), F.array(F.lit("/d/r*")).alias("inputs"))
    found = R.expand_names(listing, asked.unionByName(asked.filter("req_id = 3")))
    assert found.count() == 62 and found.filter("req_id = 3").count() == 4
    assert seen == [1]


def test_relative_resources_meet_one_row_per_file(spark, monkeypatch):
    joins, real = [], skew.checked_join
    monkeypatch.setattr(skew, "checked_join", lambda big, small, on, *a, **b: joins.append((big.columns, small)) or real(big, small, on, *a, **b))
    listed = spark.createDataFrame([(i, f"s3://b/hg/v/{i % 3}.gz") for i in range(60)], "ord long, uri string")
    asked = spark.createDataFrame([(i, "s3://b/hg/seq", "a", "b", f"../v/{i % 4}.gz") for i in range(40)],
                                  "res_id long, base_dir string, k1 string, k2 string, value string")
    found = RF.resolve_relative(asked, listed)
    assert found.count() == 30
    # Resources stay on the side that is not broadcast.
    assert [("res_id" in big, small.count()) for big, small in joins] == [(True, 3)]


def test_bindings_of_a_small_file_use_all_cores(spark, tmp_path):
    spark.range(40).select(
        F.col("id").alias("p_partkey"), F.lit("red bolt").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("PROMO").alias("p_type"),
        F.lit(3).alias("p_size")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    t = B.Tables(spark, str(tmp_path))
    for made in (B.parts(t), B.objects(t), B.keyed_listing(t), B.requests(t), B.catalog(t)):
        assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and made.count() == 40


def test_only_list_items_ask_for_their_list(spark, monkeypatch):
    joins, real = [], skew.checked_join
    monkeypatch.setattr(skew, "checked_join", lambda big, small, on, *a, **b: joins.append((big, list(on))) or real(big, small, on, *a, **b))
    sheet = spark.createDataFrame([(1, '{"a":"x.fa","files":["x.fa","y.fa"]}')], "rec_id long, json string")
    there = spark.createDataFrame([("/d/x.fa",)], "path string")
    out = RC.absolute_paths(RC.flatten(sheet), there, ["/d"], [])
    assert sorted(r["value"] for r in out.collect()) == ["/d/x.fa", "/d/x.fa", "null"]
    [asked] = [big for big, on in joins if "_key" in on]
    assert asked.filter("_key is not null").count() == 2


def test_even_paths_are_not_walked(spark):
    paths = ["/a/b", "a", "/x/../y", "x/../y/./z", "/x/..//y", "//x/../y", "x/..//y", "a/../b/../c", "x/../..", "..x/../y", "/../x/../../y", "x/y/../../z", "x\n/../y", "./../a", "a/..", "///a/../b"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", P.normalize("p").alias("n"))
    assert {r["p"]: r["n"] for r in df.collect()} == {p: os.path.normpath(p) for p in paths}
    assert P._UNEVEN in df._jdf.queryExecution().toString()


def test_counts_are_not_broadcast_by_a_guess(spark, monkeypatch):
    names = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "name string")
    matches = spark.createDataFrame([("a", 1), ("a", 2)], "name string, ord long")
    monkeypatch.setattr(skew, "fits_broadcast", lambda df, *a: False)
    counts = R.match_counts(names, matches)
    assert "BroadcastHashJoin" not in plan(counts)
    assert {r["name"]: r["n_matches"] for r in counts.collect()} == {"a": 2, "b": 0, None: 0}


def test_ends_of_globs_are_cut_off_before_they_meet_texts(spark):
    texts = spark.createDataFrame([("/d/abcd_x.fa",), ("/d/abcd_y.fa",)], "uri string")
    met = M.glob_candidates(texts, "uri", spark.createDataFrame([("abcd*x.fa",)], "name string"))
    assert met.columns == ["uri", "name"] and [r["uri"] for r in met.collect()] == ["/d/abcd_x.fa"]
    conditions = [x for x in met._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Contains(" in x]
    assert conditions and not any("split(" in x for x in conditions)


def test_literal_ends_are_tested_before_the_rest_of_a_glob(spark):
    texts = spark.createDataFrame([("/d/abcd_x.fa",), ("/d/abcd_y.fa",), ("/d/abcd_z_x.fa",)], "uri string")
    asked = spark.createDataFrame([("abcd*x.fa",), ("abcd_[x-z].f*a",)], "name string")
    met = M.name_join(texts, "uri", asked).filter(F.col("name").isNotNull()).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    assert {r["name"]: r["n"] for r in met.collect()} == {"abcd*x.fa": 2, "abcd_[x-z].f*a": 2}
    [condition] = [x for x in met._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Contains(" in x]
    ends = max(condition.index("Contains("), condition.index("EndsWith("))
    assert ends < condition.index("RLIKE(") and ends < condition.index("aggregate(")
    # Parts and expressions of a glob are made once per glob.
    assert "split(" not in condition and "regexp_replace(" not in condition


def test_filled_lists_do_without_paths(spark, monkeypatch):
    monkeypatch.setattr(skew, "fits_broadcast", lambda df, *a: False)
    leaf = RC.flatten(spark.createDataFrame([(1, '{"files":["x.fa","y.fa"]}'), (2, '{"a":{"b":"x.fa"}}')], "rec_id long, json string"))
    matches = spark.createDataFrame([("x.fa", 4, "gs://a/x.fa"), ("x.fa", 7, "gs://b/x.fa")], "name string, ord long, uri string")
    filled = QR.shown_filled(R.fill_references(QR.labelled(leaf), matches, F.lit(True)))
    assert sorted(tuple(r) for r in filled.collect()) == [
        (1, "files", "0.0.4", "string", "gs://a/x.fa", True), (1, "files", "0.0.7", "string", "gs://b/x.fa", True),
        (1, "files", "0.1", "string", "y.fa", False),
        (2, "a.b", "0.0.4", "string", "gs://a/x.fa", True), (2, "a.b", "0.0.7", "string", "gs://b/x.fa", True)]
    # No step is added to a path, and no path is shuffled to the lists.
    above = filled._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[0]
    assert "path#" not in above and "element_at(" not in above
