"""Glob index, platform strategies and hot keys against plain loops."""

import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from stowline.operators import matching as M
from stowline.operators import resolve as R
from stowline.operators import skew
from stowline.operators.platforms import PLATFORMS


def matches(text, name):
    return text == name or text.endswith("/" + name) or ("*" in name and fnmatch.fnmatchcase(text, "*/" + name))


def test_name_join_agrees_with_fnmatch(spark):
    rng = random.Random(9)
    piece = lambda: "".join(rng.choice("ab_.1") for _ in range(rng.randint(0, 5)))
    texts = {"/".join(piece() for _ in range(rng.randint(1, 4))) for _ in range(250)} | {"a", "", "x/[a]*", "b/a?b", "é/漢*"}
    names = {"*", "**", "*a", "a*", "*/", "[a]*", "[!a]*b", "?*", "a[*", "*.*", "é/漢**", "*]", "[a", "a?b", "b*b*b"}
    for _ in range(150):
        parts = [rng.choice(["*", "?", "[ab]", "[!b]", "/", piece(), piece(), piece()]) for _ in range(rng.randint(1, 5))]
        names.add("".join(parts))
    names.discard("")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(sorted(texts))], "ord int, uri string")
    asked = spark.createDataFrame([(n,) for n in sorted(names)], "name string")
    got = sorted((r["uri"], r["name"]) for r in M.name_join(rows, "uri", asked).collect())
    assert got == sorted((t, n) for t in texts for n in names if matches(t, n))


def test_globs_meet_few_candidates(spark):
    # One naming style: all patterns share their ending, and all files theirs.
    files = spark.range(2000).selectExpr("id", "explode(array('R1', 'R2')) r").selectExpr(
        "row_number() over (order by id, r) ord", "concat('gs://b/run', id % 7, '/S', id % 200, '_L00', id % 4, '_', r, '.fastq.gz') uri")
    names = spark.range(200).selectExpr("concat('S', id, '_*_R1.fastq.gz') name")
    candidates = M.glob_candidates(files, "uri", names)
    found = M.name_join(files, "uri", names).count()
    assert found == 2000 and candidates.count() < 3 * found
    filed, _ = M.rarest_grams(files, "uri", names)
    met = files.select(F.explode(M._offered(F.col("uri"), [M.GRAM])).alias("_gram")).join(filed, "_gram").count()
    assert met < 10 * found


def test_globs_that_nothing_can_match_are_left_out(spark):
    rows = spark.createDataFrame([(0, "a/bcd.txt")], "ord int, uri string")
    filed, _ = M.rarest_grams(rows, "uri", spark.createDataFrame([("*.bam",), ("b*.txt",)], "name string"))
    assert [r["name"] for r in filed.collect()] == ["b*.txt"]
    assert M.name_join(rows, "uri", spark.createDataFrame([], "name string")).count() == 0


def test_platforms_find_and_strip(spark):
    names = spark.createDataFrame([("x/a.bam",), ("a.bam",), ("none",)], "name string")
    found = lambda df: sorted((r["name"], r["uri"]) for r in df.collect())
    gs = spark.createDataFrame([(0, "gs://b/x/a.bam"), (1, "gs://b/y/a.bam")], "ord long, uri string")
    assert found(PLATFORMS["gs"].find(gs, names, ())) == [("a.bam", "gs://b/x/a.bam"), ("a.bam", "gs://b/y/a.bam"), ("x/a.bam", "gs://b/x/a.bam")]
    keep = spark.createDataFrame([(0, "c1", "q/x/a.bam"), (1, "c2", "x/a.bam")], "ord long, container string, path string")
    assert found(PLATFORMS["keep"].find(keep, names, ())) == [("a.bam", "keep:c1/q/x/a.bam"), ("x/a.bam", "keep:c2/x/a.bam")]
    sbg = spark.createDataFrame([(0, "f1", "x/a.bam"), (1, "f2", "x/a.bam")], "ord long, file_id string, path string")
    assert found(PLATFORMS["sbg"].find(sbg, names, ())) == [("x/a.bam", "sbg:f1/x/a.bam")]
    dx = spark.createDataFrame([(0, "p0", "f1", "/in/x/a.bam"), (1, "p0", "f2", "/in/y/a.bam")], "ord long, project string, file_id string, path string")
    assert found(PLATFORMS["dx"].find(dx, names, ((0, "p0", "/in"),))) == [
        ("a.bam", "dx:f1/p0:/in/x/a.bam"), ("a.bam", "dx:f2/p0:/in/y/a.bam"), ("x/a.bam", "dx:f1/p0:/in/x/a.bam")]
    local = spark.createDataFrame([("/d/x/a.bam",)], "path string")
    folder = spark.createDataFrame([("x",), ("x/../x/a.bam",)], "name string")
    assert found(PLATFORMS["local"].find(local, folder, ("/none", "/d"))) == [("x", "/d/x"), ("x/../x/a.bam", "/d/x/a.bam")]
    strip = spark.createDataFrame([("dx:f1/p0:/a", "sbg:f1/x/a", "/plain")], "d string, s string, l string").select(
        PLATFORMS["dx"].strip("d").alias("d"), PLATFORMS["sbg"].strip("s").alias("s"), PLATFORMS["dx"].strip("l").alias("l")).first()
    assert tuple(strip) == ("p0:/a", "x/a", "/plain")
    assert [tuple(r) for r in PLATFORMS["dx"].keyed(dx).limit(1).collect()] == [(0, "dx:f1/p0:/in/x/a.bam", "p0:/in/x/a.bam")]


def test_match_sets_keep_lists_once(spark):
    path = "array<struct<key: string, idx: long>>"
    leaves = spark.createDataFrame([(i, [("f", None)], "string", "pop.bam" if i < 50 else "one.bam" if i < 60 else "x") for i in range(70)],
                                   f"rec_id long, path {path}, kind string, value string")
    found = spark.createDataFrame([("pop.bam", k, f"gs://b/{k}/pop.bam") for k in range(30)] + [("one.bam", 5, "gs://b/one.bam")], "name string, ord long, uri string")
    candidate = R.is_candidate("value", F.lit("gs"))
    sets, members = R.match_sets(found)
    filled = R.fill_sets(leaves, sets, candidate)
    assert filled.count() == 70 and members.count() == 30
    opened = R.open_sets(filled, members).collect()
    assert len(opened) == 50 * 30 + 20 and sum(r["filled"] for r in opened) == 50 * 30 + 10
    assert sorted(r["path"][1]["idx"] for r in opened if r["rec_id"] == 3) == list(range(30))
    assert [(r["value"], len(r["path"])) for r in opened if r["rec_id"] in (55, 65)] == [("gs://b/one.bam", 1), ("x", 1)] or \
        {(r["value"], len(r["path"])) for r in opened if r["rec_id"] in (55, 65)} == {("gs://b/one.bam", 1), ("x", 1)}


def rows_by_task(df):
    counts = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    return sorted((r["count"] for r in counts), reverse=True)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_equal_rows_of_a_hot_key_are_spread(spark, how):
    # 90 % of the rows are the same row.
    big = spark.range(2000).select(F.when(F.col("id") < 1800, 0).otherwise(F.col("id")).alias("k"), F.lit("same").alias("v"))
    small = spark.createDataFrame([(0, "a"), (1900, "b"), (5, "c")], "k long, w string")
    got = skew.skew_join(big, small, ["k"], how, hot_rows=100)
    assert sorted(map(str, got.collect())) == sorted(map(str, big.join(small, "k", how).collect()))
    if how == "inner":
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            sizes = rows_by_task(skew.skew_join(big, small, ["k"], how, hot_rows=100))
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert sizes[0] < 1200


@pytest.fixture
def split_joins(monkeypatch):
    """No side fits a broadcast, and a key of 50 rows is hot."""
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    whole = skew.fits_broadcast
    monkeypatch.setattr(skew, "fits_broadcast", lambda df, rows=None, size=None: whole(df, rows, size) if rows else False)


def test_hot_names_give_the_same_as_broadcasts(spark, split_joins):
    catalog = spark.range(300).selectExpr("id ord", "concat('gs://b/x', id % 3, '/', case when id < 270 then 'hot.bam' else concat('f', id) end) uri")
    asked = spark.range(200).selectExpr("id req_id", "0 pos", "case when id < 180 then 'hot.bam' else concat('f', id + 80) end name")
    got = R.resolve(catalog, asked)
    assert got.count() == 180 * 270 + len([i for i in range(180, 200) if 270 <= i + 80 < 300])
    prefixed = R.find_with_prefix(catalog, asked, "gs://b")
    assert prefixed.filter("name = 'hot.bam'").count() == 270
    listing = spark.createDataFrame([("/d/hot.bam",)], "path string")
    many = spark.range(200).selectExpr("id req_id", "'hot.bam' name", "array('/n', '/d') inputs")
    assert R.expand_names(listing, many).count() == 200
    assert R.unresolved(many, many.limit(0)).count() == 200
