"""Exact dedup, mixing and sharding against brute force, with nulls, ties, repeated rows and clashing columns."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stowline.llm import common, exact_dedup, mixing, shards

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 5000
ROWS = [
    (5, "a  b", "en", "s1", 4), (3, "a b", "en", "s1", 3), (4, "a\tb", None, None, 3), (3, "a b", "en", "s1", 3), (None, "a b", "en", "s2", 3),
    (6, None, "en", "s2", 0), (7, "", None, "s2", 0), (8, " ", "en", None, 1), (9, "b a", "en", "s1", 3), (10, LONG, "en", "s3", 1), (11, LONG + "\n", "en", "s3", 1),
    (12, "a b", "en", "s3", 3), (None, None, None, None, None), (13, "x" * 300 + "1", "en", "s1", 1), (14, "x" * 300 + "2", "en", "s1", 1)]


@pytest.fixture()
def docs(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).withColumn("_row", F.lit("mine")).withColumn("size", F.lit(1)).repartition(3).write.parquet(str(tmp_path / "d"))
    return spark.read.parquet(str(tmp_path / "d"))


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("small", [True, False])
def test_exact_dedup(spark, docs, monkeypatch, small):
    if not small:
        monkeypatch.setattr(exact_dedup, "few", lambda *a: False)
        monkeypatch.setattr(common, "few", lambda *a: False)
    report = exact_dedup.dedup_report(docs).collect()
    assert len(report) == len(ROWS)
    groups = defaultdict(list)
    for row in ROWS:
        groups[norm(row[1])].append(row[0])
    got = defaultdict(list)
    for r in report:
        got[r.text_sha256].append(r)
    assert len(got) == len(groups)
    for own in got.values():
        ids = next(g for g in groups.values() if Counter(g) == Counter(r.doc_id for r in own))
        least = min((i for i in ids if i is not None), default=None)
        assert {r.keep_id for r in own} == {least} and {r.group_size for r in own} == {len(ids)}
        assert [r.doc_id for r in own if r.kept] == [least]
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_exact_dedup_of_nothing(spark, docs):
    assert exact_dedup.dedup_report(docs.limit(0)).count() == 0
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1, 10**6])
def test_lookup_join_keeps_hot_keys(spark, monkeypatch, hot):
    big = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 3), (3, 1)) for i in range(n)], "k long, i long")
    small = spark.createDataFrame([(1, 50, "a"), (2, 3, "b")], "k long, n long, v string")
    for how, n in (("left", 54), ("inner", 53)):
        rows = common.lookup_join(big, small, ["k"], "n", how, rows=0, hot=hot).collect()
        assert len(rows) == n and all(r.v == {1: "a", 2: "b"}.get(r.k) for r in rows)


def water(sizes, weights, cap):
    """Share by clamping one source after another."""
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        free = {s: weights[s] for s in sizes if s not in fixed}
        shares = {s: rest * w / sum(free.values()) for s, w in free.items()}
        over = {s for s in free if shares[s] > cap * sizes[s] + 1e-9}
        if not over:
            return {**fixed, **shares}
        fixed |= {s: cap * sizes[s] for s in over}


def test_mix(spark, docs):
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == len(ROWS)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in ROWS:
        sizes[r[3]] += count(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = water(sizes, {s: i % 3 + 1 for i, s in enumerate(order)}, 3.0)
    wanted = Counter((r[0], count(r[1]), sizes[r[3]], round(goal[r[3]], 6)) for r in ROWS)
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in rows) == wanted
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    again = mixing.mix_report(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.agg(F.sum(mixing.words())).first()[0] == sum(r["taken"] for r in rows)
    assert mixing.mix_report(docs.limit(0)).count() == 0


def test_mix_comes_near_its_targets(spark, tmp_path):
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37 + 1).cast("int")).alias("text"),
                                    F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    many.write.parquet(str(tmp_path / "m"))
    rows = mixing.mix_plan(spark.read.parquet(str(tmp_path / "m"))).groupBy("source").agg(
        F.first("target").alias("t"), F.sum(F.col("size") * F.col("times")).alias("n")).collect()
    assert len(rows) == 8 and all(abs(r.n / r.t - 1) < 0.02 for r in rows)


def test_mix_of_one_id_is_drawn_row_by_row(spark, tmp_path):
    rows = [(1, "a b c", "s1")] * 4000 + [(i, "a b c", "s2") for i in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "m"))
    sums = mixing.mix_plan(spark.read.parquet(str(tmp_path / "m"))).groupBy("source").agg(
        F.first("target").alias("t"), F.sum(F.col("size") * F.col("times")).alias("n")).collect()
    assert all(abs(r.n / r.t - 1) < 0.1 for r in sums)


@pytest.mark.parametrize("bucket", [4, 50_000])
def test_shards(spark, tmp_path, bucket):
    rows = [(i % 90, f"t{i}", i) for i in range(100)] + [(1, "same", 0)] * 60 + [(None, None, None)] * 30
    spark.createDataFrame(rows, "doc_id long, text string, shard long").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d")).drop("shard")
    got = shards.shuffled(docs, "doc_id", 24, bucket_rows=bucket).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(r[:2] for r in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    sizes = [len(v) for v in by.values()]
    assert len(by) == 24 and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    again = shards.shuffled(docs, "doc_id", 24, bucket_rows=bucket).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))
    other = shards.shuffled(docs, "doc_id", 24, seed=3, bucket_rows=bucket).collect()
    assert Counter(map(str, got)) != Counter(map(str, other))
    assert shards.shuffled(docs.limit(0), "doc_id").count() == 0


def test_mix_plan_keeps_columns_with_its_own_names(spark, docs):
    clash = docs.withColumns({"target": F.lit("t"), "source_size": F.lit("s"), "_cut": F.lit("c"), "_kept": F.lit("k"), "_stratum": F.lit(7)})
    rows = mixing.mix_plan(clash).collect()
    assert len(rows) == len(ROWS) and all((r["_cut"], r["_kept"], r["_stratum"]) == ("c", "k", 7) for r in rows)
    assert Counter(r["times"] for r in rows) == Counter(r["times"] for r in mixing.mix_plan(docs).collect())
    assert set(mixing.mix(clash).columns) == set(clash.columns)


def test_shard_report_is_what_was_written(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i} " * (i % 7), "s", i) for i in range(400)] + [(i, "copy", None, 0) for i in range(400, 600)] + [(None, None, None, None)] * 5
    spark.createDataFrame(rows, "doc_id long, text string, shard string, slot long").repartition(3).write.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(shards, "BUCKET_ROWS", 40)
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = shards.shard_report(docs, 7).collect()
    wanted = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == wanted
    places = defaultdict(list)
    for r in got:
        places[r["shard"]].append(r["slot"])
    assert sorted(places) == list(range(7)) and all(sorted(v) == list(range(len(v))) for v in places.values())
    assert {len(v) for v in places.values()} <= {605 // 7, 605 // 7 + 1}
    # Shuffled: neighbours in the input are seldom neighbours in a shard, and every shard has ids of the whole range.
    at = {(r["shard"], r["slot"]): r["doc_id"] for r in got}
    near = sum(at.get((s, k + 1)) is not None and d is not None and abs(at[s, k + 1] - d) == 1 for (s, k), d in at.items())
    assert near < 20 and all(min(d for (s, _), d in at.items() if s == k and d is not None) < 150 for k in range(7))
    shards.write_shards(docs, str(tmp_path / "out"), shards=7, bucket_rows=40)
    files = spark.read.parquet(str(tmp_path / "out")).select("shard", "slot", F.input_file_name().alias("f")).collect()
    by_file = defaultdict(list)
    for r in files:
        by_file[r["f"]].append(r["slot"])
    assert all(v == sorted(v) for v in by_file.values()) and len(by_file) > 7


def test_write_shards(spark, docs, tmp_path):
    shards.write_shards(docs, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(ROWS) and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2}
    report = shards.shard_report(docs).collect()
    assert sum(r["size"] for r in report) == sum(len((r[1] or "").encode()) + 8 for r in ROWS)


@pytest.mark.parametrize("parts", [1, 7, 200])
def test_task_numbers_deal_one_bucket_a_task(spark, parts):
    numbers = common.task_numbers(spark, parts)
    dealt = numbers.repartition(parts, "number").select(F.spark_partition_id().alias("p"), "part")
    assert dealt.count() == parts and dealt.where("p <> part").count() == 0
