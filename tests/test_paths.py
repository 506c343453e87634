"""Path expressions against the standard library's path functions."""

import fnmatch
import os.path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stowline.functions import paths as P

PIECES = st.lists(st.sampled_from(["a", "b.c", "..", ".", "", ".hid", "x.tar.gz", "/", "a.", "..b", "hg19"]), max_size=6)
PATHS = st.lists(PIECES.map("/".join), min_size=40, max_size=60)


def column(spark, values, expr):
    rows = spark.createDataFrame(list(enumerate(values)), "i long, p string").select("i", expr.alias("r")).collect()
    return [r["r"] for r in sorted(rows)]


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(PATHS)
def test_like_standard_library(spark, paths):
    paths = paths + ["/", "//", "///a", "//a", "a", "", "/a/../..", "a/../..", "../x", ".bashrc", "a/.b.c", "..a.b"]
    assert column(spark, paths, P.basename("p")) == [os.path.basename(p) for p in paths]
    assert column(spark, paths, P.dirname("p")) == [os.path.dirname(p) for p in paths]
    assert column(spark, paths, P.extension("p")) == [os.path.splitext(p)[1] for p in paths]
    assert column(spark, paths, P.without_extension("p")) == [os.path.splitext(p)[0] for p in paths]
    assert column(spark, paths, P.normalize("p")) == [os.path.normpath(p) for p in paths]
    assert column(spark, paths, P.join_path(F.lit("d/e"), "p")) == [os.path.join("d/e", p) for p in paths]
    assert column(spark, paths, P.join_path("p", F.lit("n"))) == [os.path.join(p, "n") for p in paths]


def test_normalize_remote(spark):
    names = ["s3://b/x/../y", "gs://b//z/./q", "a/../b", "/a//b"]
    assert column(spark, names, P.normalize_remote("p")) == ["s3://b/y", "gs://b/z/q", "b", "/a/b"]


PATTERNS = ["*.fa", "x*y", "a?c*", "[ab]*", "[!ab]*", "*[a-c].bam", "*[", "*[!]x", "[]]*", "[!]]*", "*.+(x)", "*a&&b", "*", "**", "q^$*{1}|"]
TEXTS = ["k/z.fa", "k/xqy", "k/abc1", "a/b", "c/q", "k/qa.bam", "k/x[", "k/x[!]x", "k/]a", "k/aaa", "k/z.+(x)", "k/za&&b", "k/q^$z{1}|",
         "k/line\nbreak.fa", "nofolder", "k/azfa"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_glob_regex_is_fnmatch(spark, pattern):
    regex = F.concat(F.lit(r"(?s)^.*/"), P.glob_regex(F.lit(pattern)), F.lit(r"\z"))
    got = column(spark, TEXTS, F.rlike("p", regex))
    assert got == [fnmatch.fnmatchcase(t, "*/" + pattern) for t in TEXTS], pattern


def test_clean_and_split(spark):
    rows = [("gs", "gs://b/k/f", "http"), ("gs", "gs://b/k/f", None), ("s3", "s3://b@eu/k/f", None), ("s3", "s3://b/k/f", "https"),
            ("sbg", "sbg:id1/p/q", None), ("dx", "dx:f1/proj:/a/b", None), ("keep", "keep:h/a", None)]
    df = spark.createDataFrame(rows, "platform string, uri string, t string")
    got = [r[0] for r in df.select(P.clean_uri("uri", "platform", "t")).collect()]
    assert got == ["https://storage.googleapis.com/b/k/f", "gs://b/k/f", "s3://b/k/f", "https://s3.amazonaws.com/b/k/f", "id1",
                   "proj:/a/b", "keep:h/a"]


def test_is_remote(spark):
    df = spark.createDataFrame([("s3", "s3:x"), ("s3", "s3:/x"), ("gs", "gs:x"), ("local", "gs:x")], "platform string, n string")
    assert [r[0] for r in df.select(P.is_remote("n", "platform")).collect()] == [False, True, True, False]


def test_data_root_and_upload_target(spark):
    df = spark.createDataFrame([("/m/hg19/g/hg19/seq/x.fa", "hg19"), ("/m/x.fa", "hg19"), ("hg19/x.fa", "hg19")], "f string, b string")
    assert [r[0] for r in df.select(P.data_root("f", "b")).collect()] == ["/m/hg19/g", None, None]
    df = spark.createDataFrame([("s3://b@eu/p/s.yaml",), ("s3://b/s.yaml",)], "u string")
    got = [tuple(r[0]) for r in df.select(P.upload_target("u")).collect()]
    assert got == [("b", "p/final", "eu"), ("b", "final", None)]
