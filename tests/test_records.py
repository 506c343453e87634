"""Flatten, rebuild, prune, remap and path expansion of nested records; transfer plans."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stowline.operators import records as RC
from stowline.operators import skew
from stowline.operators import transfer as TR
from stowline.plans import lifecycle as LC

SCALARS = st.one_of(st.none(), st.booleans(), st.integers(-1000, 1000), st.sampled_from(["", "a/b.fa", 'q"\\', "x\ny", "{[", "é"]))
TREES = st.recursive(SCALARS, lambda t: st.one_of(
    st.lists(t, max_size=3), st.dictionaries(st.sampled_from(["a", "b", 'k"', "algorithm"]), t, max_size=3)), max_leaves=12)


def table(spark, trees):
    return spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "rec_id long, json string")


def loaded(df):
    return {r["rec_id"]: json.loads(r["json"]) for r in df.collect()}


def pruned(x):
    """The pruning rule on one tree: nulls go, emptied mappings go, lists stay."""
    if isinstance(x, list):
        return [y for y in map(pruned, x) if y is not None]
    if isinstance(x, dict):
        kept = {k: y for k, y in ((k, pruned(v)) for k, v in x.items()) if y is not None}
        return kept or None
    return x


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(TREES, min_size=20, max_size=30))
def test_round_trip_and_pruning(spark, trees):
    leaves = RC.flatten(table(spark, trees))
    assert loaded(RC.rebuild(leaves)) == dict(enumerate(trees))
    want = {i: pruned(t) for i, t in enumerate(trees)}
    assert loaded(RC.rebuild(RC.prune_nulls(leaves))) == {i: t for i, t in want.items() if t is not None}


def test_given_depth_never_loses_leaves(spark):
    df = table(spark, [{"a": [1, {"b": 2}]}])
    assert RC.flatten(df, depth=3).count() == 2
    with pytest.raises(Exception, match="deeper"):
        RC.flatten(df, depth=2).collect()


def remapped(spark, values, remap, **options):
    df = spark.createDataFrame(list(enumerate(values)), "i long, v string")
    keys = spark.createDataFrame(remap, "src string, dst string")
    return [tuple(r) for r in RC.remap_longest(df, "v", keys, **options).orderBy("i").select("remapped", "matched").collect()]


@pytest.mark.parametrize("steps", [32, 0])
def test_longest_prefix(spark, monkeypatch, steps):
    monkeypatch.setattr(RC, "MAX_STEPS", steps)
    remap = [("/a", "/A"), ("/a/b", "/AB"), ("/hg19", "/H")]
    values = ["/a/b/c", "/a/c", "/a/x/a/y", "/hg19-noalt/x", "none", None]
    assert remapped(spark, values, remap) == [
        ("/AB/c", True), ("/A/c", True), ("/A/x/A/y", True), ("/H-noalt/x", True), ("none", False), (None, False)]
    assert remapped(spark, values, remap, prefix_only=True)[2] == ("/A/x/a/y", True)
    assert remapped(spark, values, remap, boundary=True)[3] == ("/hg19-noalt/x", False)


def test_remap_there_and_back(spark):
    mounts = spark.createDataFrame([(0, "/ext/a:/in/1"), (1, "/ext/b:/in/2"), (2, "/ext/c:/in/2")], "ord long, mount string")
    there = {r["src"]: r["dst"] for r in RC.parse_mounts(mounts).collect()}
    back = {r["src"]: r["dst"] for r in RC.parse_mounts(mounts, inward=False).collect()}
    assert there == {"/ext/a": "/in/1", "/ext/b": "/in/2", "/ext/c": "/in/2"} and back == {"/in/1": "/ext/a", "/in/2": "/ext/c"}
    pairs = RC.parse_mounts(mounts).withColumn("ord", F.when(F.col("src") == "/ext/c", 9).otherwise(1))
    assert {r["src"]: r["dst"] for r in RC.invert(pairs).collect()} == back
    df = spark.createDataFrame([("/ext/a/x.fa",)], "v string")
    out = RC.remap_longest(df, "v", RC.parse_mounts(mounts)).select(F.col("remapped").alias("v"))
    assert RC.remap_longest(out, "v", RC.parse_mounts(mounts, inward=False)).first()["remapped"] == "/ext/a/x.fa"


def test_remap_skips_nopath_keys(spark):
    tree = {"algorithm": {"tool": "/a/x", "bed": "/a/y"}, "tool": "/a/z"}
    out = RC.remap_leaves(RC.flatten(table(spark, [tree])), spark.createDataFrame([("/a", "/B")], "src string, dst string"), ["tool"])
    assert loaded(RC.rebuild(out.drop("matched"))) == {0: {"algorithm": {"tool": "/a/x", "bed": "/B/y"}, "tool": "/B/z"}}


def test_ignored_keys(spark):
    leaves = RC.flatten(table(spark, [{"a": 1, "algorithm": {"phasing": 2, "x": {"phasing": 3}}, "sub": {"a": 4}}]))
    values = lambda df: sorted(r["value"] for r in df.collect())
    assert values(RC.without_keys(leaves, ["a"])) == ["2", "3"]
    assert values(RC.without_keys(leaves, ["phasing"], under="algorithm")) == ["1", "3", "4"]


LISTING = [("/w/x.bam",), ("/r/x.bam",), ("/r/y.bam",), ("/w/b.bed",)]


def test_absolute_paths(spark):
    tree = {"f": "x.bam", "list": ["y.bam", "gone", "x.bam"], "cold": ["gone", "y.bam"], "lane": "x.bam", "deep": {"f": "x.bam"},
            "algorithm": {"bed": "b.bed", "phasing": "x.bam"}, "n": 1}
    listing = spark.createDataFrame(LISTING, "path string")
    leaves = RC.absolute_paths(RC.flatten(table(spark, [tree])), listing, ["/w", "/r"], list(RC.IGNORED_SAMPLE_KEYS))
    leaves = RC.absolute_paths(leaves, listing, ["/w", "/r"], list(RC.IGNORED_ALGORITHM_KEYS), under="algorithm")
    assert loaded(RC.rebuild(leaves))[0] == {
        "f": "/w/x.bam", "list": ["/r/y.bam", None, "/w/x.bam"], "cold": ["gone", "y.bam"], "lane": "x.bam", "deep": {"f": "x.bam"},
        "algorithm": {"bed": "/w/b.bed", "phasing": "x.bam"}, "n": 1}


def test_harvest_folders(spark):
    tree = {"a": "/w/x.bam", "rel": "x.bam", "list": ["/r/x.bam", "/not/there"], "cold": ["/not/1", "/w/b.bed"], "phasing": "/r/y.bam",
            "d": {"e": "/w/b.bed"}, "objs": [{"p": "/r/y.bam"}]}
    got = RC.harvest_folders(RC.flatten(table(spark, [tree])), spark.createDataFrame(LISTING, "path string"), ["phasing"])
    assert sorted(r["folder"] for r in got.collect()) == ["/not", "/r", "/w"]


def test_required(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a"],), (["b"],), ([],)], "ctx array<string>")
    keep = lambda f: sorted(r["ctx"] for r in TR.required(df, f).collect())
    assert keep([["a", "b"]]) == [["a", "b"]] and keep([["a"], ["b"]]) == [["a"], ["a", "b"], ["b"]]
    assert len(keep([])) == 4 and len(keep(None)) == 4
    keys = spark.createDataFrame([(["a", "b"],), (["b"],), (["b"],)], "keys array<string>")
    assert keep(keys) == [["a", "b"], ["b"]]


@pytest.mark.parametrize("group_rows", [None, 2])
def test_destinations(spark, group_rows):
    dirs = ["/work/a", "/work", "/bio/g", "/z", "/b", "/y", "/x", "/workother", "/work/a/work"]
    df = spark.createDataFrame([(1, d, "/work", "/bio", "run", "data") for d in dirs],
                               "rec_id long, dir string, work_dir string, data_dir string, run_bucket string, data_bucket string")
    got = {r["dir"]: (r["bucket"], r["folder"]) for r in TR.destinations(df, group_rows).collect()}
    assert got == {"/work/a": ("run", "a"), "/work": ("run", ""), "/bio/g": ("data", "g"), "/workother": ("run", "other"),
                   "/work/a/work": ("run", "a"), "/b": ("run", "externalmap/0"), "/x": ("run", "externalmap/1"),
                   "/y": ("run", "externalmap/2"), "/z": ("run", "externalmap/3")}


@pytest.mark.parametrize("group_rows", [None, 1])
def test_external_ids(spark, group_rows):
    files = [("/e/a/1", 0, "files"), ("/e/a/sub/2", 1, "files"), ("/w/x", 2, "files"), ("/e/3", 3, "files"), ("/e/a/4", 4, "files"),
             ("/alg/5", 5, "algorithm"), ("/q/r/6", 6, "files"), ("/q/7", 7, "files")]
    df = spark.createDataFrame([(1, [top], [n], v, "/w") for v, n, top in files],
                               "rec_id long, ctx array<string>, pos array<long>, value string, work_dir string")
    got = {r["dir"]: r["ext_id"] for r in TR.external_ids(df, group_rows).collect()}
    assert got == {"/e/a": 1, "/e": 2, "/q/r": 3, "/q": 4}


def test_shipping_plan(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 1000)
    tree = {"files": ["/work/a/x.bam"], "ref": {"fa": "/bio/hg19/s.fa"}, "out": "/work/a/missing", "other": "/ext/q.vcf", "name": "s1", "nil": None}
    listing = spark.createDataFrame([("/work/a/x.bam",), ("/work/a/x.bam.bai",), ("/bio/hg19/s.fa",), ("/ext/q.vcf",)], "path string")
    places = spark.createDataFrame([(0, "/work", "/bio", "run", "data")],
                                   "rec_id long, work_dir string, data_dir string, run_bucket string, data_bucket string")
    target = spark.createDataFrame([("data", "hg19/s.fa")], "bucket string, key string")
    sent, leaves = LC.shipping_plan(RC.flatten(table(spark, [tree])), places, listing, target)
    assert sorted(tuple(r) for r in sent.select("member", "bucket", "key").collect()) == [
        ("/ext/q.vcf", "run", "externalmap/0/q.vcf"), ("/work/a/x.bam", "run", "a/x.bam"), ("/work/a/x.bam.bai", "run", "a/x.bam.bai")]
    assert loaded(RC.rebuild(leaves))[0] == {
        "files": ["s3://run/a/x.bam"], "ref": {"fa": "s3://data/hg19/s.fa"}, "other": "s3://run/externalmap/0/q.vcf", "name": "s1"}


def test_prepare_sheets(spark):
    listing = spark.createDataFrame(LISTING, "path string")
    mounts = spark.createDataFrame([(0, "/w:/in")], "ord long, mount string")
    rows, folders = LC.prepare_sheets(table(spark, [{"f": "x.bam", "algorithm": {"bed": "b.bed"}}]), listing, ["/w", "/r"], mounts)
    assert loaded(RC.rebuild(rows))[0] == {"f": "/in/x.bam", "algorithm": {"bed": "/in/b.bed"}}
    assert [r["folder"] for r in folders.collect()] == ["/w"]


def test_fill_records(spark):
    catalog = spark.createDataFrame([(0, "gs://b/x.bam"), (1, "gs://c/x.bam"), (2, "gs://b/y.bam")], "ord long, uri string")
    tree = {"files": ["x.bam", "y.bam", "z.bam"], "one": "y.bam", "far": "gs://q/y.bam", "plain": "y", "num": 1.5}
    leaves = RC.flatten(table(spark, [tree]))
    out = LC.fill_records(leaves, catalog, spark.createDataFrame([("z.bam",)], "path string"), "gs")
    assert loaded(RC.rebuild(out.drop("filled")))[0] == {
        "files": [["gs://b/x.bam", "gs://c/x.bam"], "gs://b/y.bam", "z.bam"], "one": "gs://b/y.bam", "far": "gs://q/y.bam", "plain": "y",
        "num": 1.5}


def test_localize(spark):
    df = spark.createDataFrame([(["reference"], "s3://b/x"), (["files"], "s3://b/x"), (["files"], "/l"), ([], "s3://b/q")],
                               "ctx array<string>, value string")
    assert [r["value"] for r in TR.localize(df, "b", "/d/b").collect()] == ["/d/b/genomes/x", "/d/b/x", "/l", "/d/b/q"]


def test_flatten_goes_on_where_records_are_deep(spark, monkeypatch):
    deep = lambda n: '{"a":[' * (n // 2) + '"x"' + "]}" * (n // 2)
    df = spark.createDataFrame([(1, deep(200)), (2, '{"b":1,"e":{}}'), (3, deep(14)), (4, '[[[[[[[[]]]]]]]]'), (5, '"[[[[[[[[["')], "rec_id long, json string")
    got = {(r["rec_id"], len(r["path"]), r["kind"], r["value"]) for r in RC.flatten(df).collect()}
    assert got == {(1, 200, "string", "x"), (2, 1, "number", "1"), (2, 1, "object", "{}"), (3, 14, "string", "x"), (4, 7, "array", "[]"), (5, 0, "string", "[[[[[[[[[")}
    assert {r["rec_id"]: r["json"] for r in RC.rebuild(RC.flatten(df, levels=2)).collect()} == {r["rec_id"]: r["json"] for r in df.collect()}
    shallow = RC.flatten(df.filter("rec_id = 2"))
    assert shallow._jdf.queryExecution().executedPlan().toString().count("Generate") <= RC.LEVELS
