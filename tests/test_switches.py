"""Paths that are chosen by size give the same rows, also with null keys, repeated keys and map columns."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stowline.operators import metrics as MT
from stowline.operators import records as RC
from stowline.operators import refs as RF
from stowline.operators import resolve as R
from stowline.operators import skew
from stowline.sources import files as SF
from stowline.sources import inventory as I
from stowline.streaming import live as LV

T0 = dt.datetime(2024, 1, 1)
KEYED = [("a", 3), ("a", 1), (None, 2), (None, 5), ("a", 2), (None, 2), ("b", None)]


def rows(df):
    return Counter(map(str, df.collect()))


@pytest.fixture()
def keyed(spark):
    return spark.createDataFrame(KEYED, "k string, v long")


def test_numbering(keyed):
    small = skew.number_in_group(keyed, ["k"], ["v"])
    large = skew.number_in_group(keyed, ["k"], ["v"], group_rows=1)
    assert small.count() == len(KEYED) and rows(small) == rows(large.select(*small.columns))


def test_quantiles(keyed):
    points = {"low": 0.1, "mid": 0.5, "high": 0.95}
    small, large = (skew.exact_quantiles(keyed, ["k"], "v", points, n) for n in (100, 1))
    assert small.where("k IS NULL").count() == 1 and rows(small) == rows(large.select(*small.columns))


def test_usage(spark):
    data = [(h, T0 + dt.timedelta(minutes=m), "cpu", v) for h, m, v in
            (("h", 1, 1.0), ("h", 2, 4.0), (None, 3, 2.0), (None, 4, 4.0), ("h", 70, None), (None, 90, 3.0))]
    metrics = spark.createDataFrame(data, "host string, ts timestamp_ntz, metric string, value double")
    small, large = (MT.usage_by_interval(metrics, group_rows=n) for n in (100, 1))
    assert rows(small) == rows(large) and small.where("host IS NULL AND p95 IS NOT NULL").count() == 2


def test_remap(spark, monkeypatch):
    remap = spark.createDataFrame([("/a", "/x", 0), ("/a", "/y", 1), ("/a/b", "/z", 2), (None, "/n", 3)], "src string, dst string, ord int")
    values = spark.createDataFrame([(i, v) for i, v in enumerate(["/a/c", "/a/b/d", None, "/q", None, "/a/c"])], "i int, v string")
    small = RC.remap_longest(values, "v", remap)
    found = rows(small)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    large = RC.remap_longest(values, "v", remap)
    assert found == rows(large.select(*small.columns)) and small.where("remapped = '/y/c'").count() == 2


@pytest.mark.parametrize("how, n", [("inner", 42), ("left", 47), ("left_semi", 42), ("left_anti", 5)])
def test_join(spark, how, n):
    data = [("a", {"x": i}) for i in range(40)] + [("b", None), ("b", {}), ("c", {"y": 1}), ("c", {"y": 1}), (None, {"z": 1}), (None, None), ("d", None)]
    big = spark.createDataFrame(data, "k string, m map<string,int>")
    small = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, w int")
    salted = skew.skew_join(big, small, ["k"], how, hot_rows=5)
    plain = big.join(small, ["k"], how)
    assert salted.count() == n and rows(salted.select(*plain.columns)) == rows(plain)


def test_too_many_hot_keys_raise_the_bar(spark, monkeypatch):
    big = spark.range(60).select((F.col("id") % 6).alias("k"), "id")
    small = spark.range(6).select(F.col("id").alias("k"), F.lit(1).alias("w"))
    monkeypatch.setattr(skew, "HOT_KEYS", 3)
    assert skew.skew_join(big, small, ["k"], hot_rows=2).count() == 60


def test_yaml_without_a_reader_is_an_error(spark, tmp_path, monkeypatch):
    (tmp_path / "a.json").write_text('{"details": []}')
    monkeypatch.setattr(SF, "yaml", None)
    assert SF.read_documents(spark, str(tmp_path)).count() == 1
    (tmp_path / "b.yaml").write_text("details: []")
    with pytest.raises(Exception, match="no YAML reader"):
        SF.read_documents(spark, str(tmp_path)).collect()


def test_ingest_keeps_history_under_a_new_checkpoint(spark, tmp_path):
    schema = "host string, name string, size long, mtime timestamp"
    landing, target = str(tmp_path / "in"), str(tmp_path / "out")
    kind = spark.createDataFrame([], schema).schema
    day = dt.timedelta(days=1)
    for k, names in enumerate((["a"], ["a", "b"], ["b", "c"])):
        spark.createDataFrame([("h", x, 1, T0 + day * k) for x in names] + [("h", "a", 1, T0)], schema).coalesce(1).write.mode("append").parquet(landing)
        LV.ingest_changed(LV.open_stream(spark, landing, kind, max_files=1), target, str(tmp_path / f"check{k // 2}")).awaitTermination()
    got = Counter((r.name, r.mtime) for r in spark.read.parquet(target).collect())
    assert got == Counter({("a", T0): 1, ("a", T0 + day): 1, ("b", T0 + day): 1, ("b", T0 + 2 * day): 1, ("c", T0 + 2 * day): 1})


def test_repeated_paths_keep_their_first_place(spark):
    listing = spark.createDataFrame([(0, "p0", "f0", "/x/a"), (1, "p1", "f1", "/x/b"), (2, "p2", "f2", "/x/a")],
                                    "ord long, project string, file_id string, path string")
    keyed = I.keyed_last_wins(listing)
    assert [(r.path, r.project, r.file_id) for r in keyed.orderBy("ord").collect()] == [("/x/a", "p2", "f2"), ("/x/b", "p1", "f1")]
    assert [r.project for r in R.folder_catalog(keyed).collect()] == ["p1"]


def test_null_aligner_is_no_aligner(spark):
    catalog = spark.createDataFrame([(0, "gs://r/hg/seq/hg.fa"), (1, "gs://r/hg/seq/hg.fa.fai")], "ord long, uri string")
    for aligner in (None, ""):
        builds = spark.createDataFrame([("hg", aligner, "gs://r/hg")], "build string, aligner string, prefix string")
        assert RF.reference_bundle(builds, catalog).count() == 2


def test_folder_that_is_its_own_parent(spark):
    nodes = spark.createDataFrame([(1, 1, "root", "folder"), (2, 1, "d", "folder"), (3, 2, "f", "file")], "id long, parent long, name string, type string")
    assert [r.id for r in I.expand_folders(nodes, 1).collect()] == [3]


def test_run_window_days(spark):
    files = spark.createDataFrame([("a", T0 - dt.timedelta(days=3)), ("b", T0), ("c", T0 + dt.timedelta(days=2))], "name string, mtime timestamp_ntz")
    files = files.withColumn("first_ts", F.col("mtime") - F.expr("INTERVAL 1 DAY")).withColumn("day", F.to_date("mtime"))
    lines = spark.createDataFrame([("[2024-01-01T00:00:00] h: x",), ("[2024-01-01T05:00:00] h: x",)], "value string")
    frame = MT.run_frame(lines)
    plain = rows(MT.in_run_frame(files, frame))
    assert plain == rows(MT.in_run_frame(files, frame, day="day")) == rows(MT.in_run_frame(files, frame, day="day", span_days=1))
