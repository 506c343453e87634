"""Lookup rules on small hand-made catalogs, and the equality joins against brute force."""

import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from stowline.operators import matching as M
from stowline.operators import resolve as R
from stowline.operators import skew


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


@pytest.fixture(params=["broadcast", "salted"])
def join_mode(request, monkeypatch):
    """Every join rule must hold on the broadcast side and on the salted shuffle side."""
    if request.param == "salted":
        monkeypatch.setattr(skew, "HOT_ROWS", 2)
        real = skew.fits_broadcast
        # Only the table of hot keys itself may be broadcast.
        monkeypatch.setattr(skew, "fits_broadcast", lambda df, *a: "_salts" in df.columns and real(df, *a))
        monkeypatch.setattr(M, "_fits", lambda facts: False)
    return request.param


CATALOG = ["gs://b/hg19/x.fa", "gs://b/hg19-noalt/x.fa", "gs://b/hg19/x.fa", "gs://b/q/s1_R1.fq.gz", "gs://b/q/s1_R2.fq.gz",
           "gs://b/q/a?b.fa", "gs://b/genomes/mm10/seq/mm10.fa", "top.fa", "gs://b/deep/top.fa"]


def catalog(spark):
    return spark.createDataFrame(list(enumerate(CATALOG)), "ord long, uri string")


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def brute(name):
    hit = lambda u: u == name or u.endswith("/" + name) or ("*" in name and fnmatch.fnmatchcase(u, "*/" + name))
    return [(name, i, u) for i, u in enumerate(CATALOG) if hit(u)]


def test_find_all(spark, join_mode):
    asked = ["x.fa", "hg19/x.fa", "s1*", "s1_R?.fq.gz", "a?b.fa", "none", "*", "top.fa", "*_R[12]*", "gs://b/hg19/x.fa", "q/*.fa"]
    got = rows(R.find_all(catalog(spark), names(spark, *asked, "x.fa")), "name", "ord", "uri")
    assert got == sorted(sum((brute(n) for n in asked), []))


def test_find_all_random(spark, join_mode):
    rnd = random.Random(7)
    part = lambda: rnd.choice(["a", "b", "ab", "a.b", "x*", "", "[a]"])
    texts = ["/".join(part() for _ in range(rnd.randint(1, 5))) for _ in range(120)]
    asked = sorted({"/".join(rnd.choice(["a", "b", "*", "a*", "*b", "?b*", "[!a]*", "ab", "x*"]) for _ in range(rnd.randint(1, 3)))
                    for _ in range(40)})
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, uri string")
    want = sorted((n, i) for n in asked for i, u in enumerate(texts)
                  if u == n or u.endswith("/" + n) or ("*" in n and fnmatch.fnmatchcase(u, "*/" + n)))
    assert rows(R.find_all(df, names(spark, *asked)), "name", "ord") == want


def test_prefix_join_is_theta_join(spark, join_mode):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab/") for _ in range(rnd.randint(0, 8))) for _ in range(150)]
    keys = sorted({"".join(rnd.choice("ab/") for _ in range(rnd.randint(1, 4))) for _ in range(25)})
    left = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    right = spark.createDataFrame([(k,) for k in keys], "k string")
    assert rows(M.prefix_join(left, "t", right, "k"), "i", "k") == sorted(
        (i, k) for i, t in enumerate(texts) for k in keys if t.startswith(k))


def test_no_names_at_all(spark):
    assert rows(R.find_all(catalog(spark), names(spark, "x").limit(0))) == []
    assert rows(M.prefix_join(catalog(spark), "uri", names(spark, "x").limit(0), "name")) == []


def test_prefix_mode_resets(spark, join_mode):
    # The last row under the prefix discards earlier matches; later ordinary matches are added.
    listed = ["gs://o/hg19", "gs://b/hg19/a", "gs://c/hg19", "gs://b/hg19/b", "gs://d/hg19", "gs://e/zz"]
    df = spark.createDataFrame(list(enumerate(listed)), "ord long, uri string")
    got = rows(R.find_with_prefix(df, names(spark, "hg19", "zz", "no"), "gs://b"), "name", "ord", "uri")
    assert got == [("hg19", 3, "gs://b/hg19"), ("hg19", 4, "gs://d/hg19"), ("zz", 5, "gs://e/zz")]


OBJECTS = [(0, "c1", "f0", "z/dir/a.bam"), (1, "c2", "f1", "a.bam"), (2, "c3", "f2", "dir/sub/b.bam"), (3, "c4", "f3", "y/dir/c.bam")]


def objects(spark):
    return spark.createDataFrame(OBJECTS, "ord long, container string, file_id string, path string")


def test_two_tiers(spark, join_mode):
    got = rows(R.find_first_tiers(objects(spark), names(spark, "a.bam", "b.bam", "dir", "x")), "name", "tier", "ord", "uri")
    assert got == [("a.bam", 1, 1, "keep:c2/a.bam"), ("b.bam", 2, 2, "keep:c3/dir/sub/b.bam")]
    got = rows(R.find_first_tiers(objects(spark), names(spark, "dir", "sub", "y"), folders=True), "name", "tier", "ord", "uri")
    assert got == [("dir", 1, 2, "keep:c3/dir"), ("sub", 2, 2, "keep:c3/dir/sub"), ("y", 1, 3, "keep:c4/y")]


def test_single_tier(spark, join_mode):
    asked = names(spark, "a.bam", "dir", "sbg:zz/dir/sub/b.bam")
    assert rows(R.find_first(objects(spark), asked), "name", "uri") == [
        ("a.bam", "sbg:f1/a.bam"), ("sbg:zz/dir/sub/b.bam", "sbg:f2/dir/sub/b.bam")]
    assert ("dir", "sbg:f2/dir") in rows(R.find_first(objects(spark), asked, folders=True), "name", "uri")


def test_folder_order(spark, join_mode):
    keyed = spark.createDataFrame([
        (0, "p1", "f0", "/in/s.bam"), (1, "p1", "f1", "/ref/s.bam"), (2, "p2", "f2", "/in/deep/t.bam"), (3, "p2", "f3", "/in/deep/u.bam"),
        (4, "p1", "f4", "/in2/t.bam")], "ord long, project string, file_id string, path string")
    folders = [(0, "p0", "/ref"), (1, "p1", "/in")]
    asked = spark.createDataFrame(
        [(1, "s.bam", folders), (2, "p1:s.bam", folders), (3, "t.bam", folders), (4, "*.bam", folders), (5, "p9:t.bam", folders),
         (6, "dx:id/s.bam", folders), (7, "none", folders)],
        "req_id long, name string, folders array<struct<rank:int,project:string,folder:string>>")
    got = rows(R.find_in_folders(keyed, asked), "req_id", "tier", "uri")
    assert got == sorted([
        (1, 1, "dx:f1/p1:/ref/s.bam"), (2, 1, "dx:f0/p1:/in/s.bam"), (3, 2, "dx:f2/p2:/in/deep/t.bam"),
        (4, 2, "dx:f0/p1:/in/s.bam"), (4, 2, "dx:f1/p1:/ref/s.bam"), (4, 2, "dx:f2/p2:/in/deep/t.bam"), (4, 2, "dx:f3/p2:/in/deep/u.bam"),
        (5, 2, "dx:f2/p2:/in/deep/t.bam"), (6, 1, "dx:f1/p1:/ref/s.bam")])


def test_local_lookup(spark, join_mode):
    listing = spark.createDataFrame([("/r/g/x.fa",), ("/i/g/x.fa",), ("/i/y.vcf.gz",), ("/i/y.txt",), ("/i/.yh.vcf",), ("/i/y2.bam",)], "path string")
    asked = spark.createDataFrame([(1, "g/../g/x.fa", ["/r", "/i"]), (2, "g", ["/q", "/i"]), (3, "no", ["/r"])],
                                  "req_id long, name string, bases array<string>")
    got = rows(R.first_existing(R.with_folders(listing), asked), "req_id", "pos", "path")
    assert got == [(1, 0, "/r/g/x.fa"), (2, 1, "/i/g")]
    wanted = spark.createDataFrame([(1, "y", ["/i", "/r"]), (2, "/i/y.txt", ["/i"]), (3, "q", ["/i"]), (4, "", ["/i"]), (5, "?2", ["/i"])],
                                   "req_id long, name string, inputs array<string>")
    found = R.expand_names(listing, wanted)
    assert rows(found, "req_id", "pos", "path") == [
        (1, 0, "/i/y.vcf.gz"), (1, 0, "/i/y2.bam"), (2, -1, "/i/y.txt"), (4, 0, "/i/y.vcf.gz"), (4, 0, "/i/y2.bam"), (5, 0, "/i/y2.bam")]
    missing = R.unresolved(wanted, found)
    assert rows(missing, "req_id") == [(3,)]
    with pytest.raises(Exception, match="no files"):
        R.require_none(missing, "no files").collect()
    assert R.require_none(missing.filter("false"), "no files").collect() == []


def test_exists_and_counts(spark, join_mode):
    asked = names(spark, "gs://b/hg19/x.fa", "x.fa", "none")
    assert rows(R.exists(catalog(spark), asked)) == [("gs://b/hg19/x.fa", True), ("none", False), ("x.fa", False)]
    counted = R.match_counts(asked, R.find_all(catalog(spark), asked))
    assert rows(counted) == [("gs://b/hg19/x.fa", 2), ("none", 0), ("x.fa", 3)]


def test_request_split(spark):
    df = spark.createDataFrame([(1, "a;b;;c")], "req_id long, names string")
    assert rows(R.split_requests(df)) == [(1, 0, "a"), (1, 1, "b"), (1, 2, ""), (1, 3, "c")]
    assert rows(R.split_requests(df, sep=None)) == [(1, 0, "a;b;;c")]
    arrays = df.select("req_id", F.split("names", ";").alias("names"))
    assert rows(R.split_requests(arrays)) == rows(R.split_requests(df))


def test_reference_prefix(spark):
    builds = spark.createDataFrame([("hg19",), ("mm10",), ("zz",)], "build string")
    found = R.find_with_prefix(catalog(spark), R.reference_prefix_names(builds), "gs://b").select("name", F.col("uri").alias("path"))
    assert rows(R.reference_prefix(builds, found), "build", "path") == [("hg19", "gs://b/hg19"), ("mm10", "gs://b/genomes/mm10")]
