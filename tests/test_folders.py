"""Wildcards in folders, start folders, stored catalogs and files, and null-safe ingest."""

import glob
import os
import random

from pyspark.sql import functions as F

from stowline.operators import metrics as MT
from stowline.operators import resolve as R
from stowline.sources import files as SF
from stowline.sources import inventory as I
from stowline.streaming import live as LV


def test_expand_names_agrees_with_glob(spark, tmp_path):
    rng, root = random.Random(6), str(tmp_path / "root")
    pick = lambda: rng.choice(["s1", "s2", "t1", ".h", "s[1]", "lane", "x.y"])
    paths = {"/".join([root, *(pick() for _ in range(rng.randint(1, 4))), rng.choice(["a", "b", ".c"]) + rng.choice([".bam", "_1.fq.gz", ".txt"])]) for _ in range(500)}
    for path in paths:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        open(path, "w").close()
    names = ["s*/a", "*/*/b", "?1/*", "s[12]/lane/a", "*", "s1/a", "s1/../s2/b", "./s*/../t1/a", "[!s]*/*", ".*/*", "*/.c", "s[[]1]/*", "none*/a", "s1/*/*/a"]
    asked = spark.createDataFrame([(i, n, [root, root + "/s*"]) for i, n in enumerate(names)], "req_id long, name string, inputs array<string>")
    listing = spark.createDataFrame([(p,) for p in sorted(paths)], "path string")
    got = sorted((r["req_id"], r["pos"], r["path"]) for r in R.expand_names(listing, asked).collect())
    wanted = []
    for i, name in enumerate(names):
        for pos, folder in enumerate([root, root + "/s*"]):
            head, _, base = f"{folder}/{name}".rpartition("/")
            pattern = os.path.normpath(head) + "/" + base + "*"
            wanted += [(i, pos, p) for p in glob.glob(pattern) if p.endswith((".bam", ".fq.gz"))]
    assert got == sorted(wanted) and len(got) > 50


def test_start_folders(spark):
    nodes = spark.createDataFrame([(1, 0, "a", "folder"), (2, 0, "a", "folder"), (3, 1, "b", "folder"), (4, 2, "c", "folder")],
                                  "id long, parent long, name string, type string")
    asked = spark.createDataFrame([(0, "a/b"), (0, "/a//b/"), (0, "a/c"), (0, ""), (1, "b"), (9, "b")], "root long, path string")
    got = {(r["root"], r["path"]): r["id"] for r in I.find_folders(nodes, asked).collect()}
    # Only the first of the two folders called a is walked.
    assert got == {(0, "a/b"): 3, (0, "/a//b/"): 3, (0, ""): 0, (1, "b"): 3}
    assert [r["id"] for r in I.find_folder(nodes, 0, "a/b").collect()] == [3] and I.find_folder(nodes, 0, "a/c").count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_catalog_prunes_by_prefix(spark, tmp_path):
    catalog = spark.range(5000).selectExpr("id ord", "concat('gs://b', id % 50, '/f', id) uri")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    I.write_catalog(catalog, str(tmp_path / "c"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    scan = I.under_prefix(spark.read.parquet(str(tmp_path / "c")), "gs://b7/")
    assert "StringStartsWith(uri,gs://b7/)" in plan(scan) and scan.count() == 100
    assert scan.select(F.input_file_name()).distinct().count() <= 2


def test_stored_files_prune_by_day(spark, tmp_path):
    files = spark.range(3000).selectExpr("concat('h', id % 5) host", "concat('f', id) name", "id size",
                                         "timestamp_ntz'2024-01-01' + make_interval(0,0,0,0, id div 4) mtime", "timestamp_ntz'2024-01-01' + make_interval(0,0,0,0, id div 4 - 5) first_ts")
    SF.write_raw_files(files, str(tmp_path / "f"))
    frame = spark.createDataFrame([("2024-01-10 03:00:00", "2024-01-11 04:00:00")], "a string, b string").select(
        F.col("a").cast("timestamp_ntz").alias("run_start"), F.col("b").cast("timestamp_ntz").alias("run_end"))
    pruned = MT.in_run_frame(spark.read.parquet(str(tmp_path / "f")), frame, day="day", span_days=1)
    assert "day" in plan(pruned).split("PartitionFilters: [")[1].split("]")[0]
    key = lambda df: sorted(r["name"] for r in df.collect())
    assert key(pruned) == key(MT.in_run_frame(files, frame)) != []


def test_ingest_takes_nulls_once(spark, tmp_path):
    rows = [("h", "a", 1, "2024-01-01 00:00:00"), (None, "b", 2, "2024-01-01 00:00:00"), ("h", "c", 3, None)]
    frame = spark.createDataFrame(rows, "host string, name string, size long, mtime string").withColumn("mtime", F.col("mtime").cast("timestamp_ntz"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    for k in range(3):
        stream = LV.open_stream(spark, str(tmp_path / "in"), frame.schema)
        LV.ingest_changed(stream, str(tmp_path / "out"), str(tmp_path / f"checkpoint{k}")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, (r["name"] for r in got.collect()))) == ["a", "b", "c"]
    # A batch without any time is compared as well.
    frame.filter("mtime IS NULL").write.parquet(str(tmp_path / "late"))
    stream = LV.open_stream(spark, str(tmp_path / "late"), frame.schema)
    LV.ingest_changed(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint9")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
