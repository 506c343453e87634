"""Run metrics, streaming jobs and fleet queries."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from stowline.operators import fleet as FL
from stowline.operators import metrics as MT
from stowline.streaming import live as LV

T0 = dt.datetime(2024, 1, 1)


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def series(spark, n=600, hosts=3, seed=1, kind="timestamp_ntz"):
    rnd = random.Random(seed)
    # Host h0 holds most rows, and most of them within one hour.
    data = []
    for i in range(n):
        host = "h0" if rnd.random() < 0.7 else f"h{rnd.randrange(hosts)}"
        second = rnd.randrange(3600) if rnd.random() < 0.6 else rnd.randrange(86400)
        data.append((i, host, T0 + dt.timedelta(seconds=second), rnd.choice(["cpu", "mem"]), float(rnd.randrange(1000)) / 8))
    return data, spark.createDataFrame(data, f"event_id long, host string, ts {kind}, metric string, value double")


@pytest.mark.parametrize("split_rows", [None, 10])
@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_attribution_is_asof(spark, split_rows, kind):
    data, metrics = series(spark, kind=kind)
    rnd = random.Random(5)
    marks = [("h0", f"s{i}", T0 + dt.timedelta(seconds=rnd.randrange(0, 90000, 60))) for i in range(40)] + [("h1", "only", data[5][2])]
    steps = spark.createDataFrame(marks, f"host string, step string, start {kind}")
    got = {r["event_id"]: r["step"] for r in MT.attribute_steps(metrics, steps, split_rows=split_rows).collect()}
    want = {}
    for i, host, ts, _, _ in data:
        past = [(start, step) for h, step, start in marks if h == host and start <= ts]
        want[i] = max(past)[1] if past else None
    assert got == want and None in want.values()


def test_usage_paths_agree(spark):
    _, metrics = series(spark)
    plain, split = MT.usage_by_interval(metrics), MT.usage_by_interval(metrics, group_rows=20)
    assert rows(plain) == rows(split.select(*plain.columns))
    assert plain.agg(F.sum("n")).first()[0] == 600


def test_usage_by_step_and_hardware(spark):
    _, metrics = series(spark)
    steps = spark.createDataFrame([("h0", "s", T0)], "host string, step string, start timestamp_ntz")
    usage = MT.usage_by_step(MT.attribute_steps(metrics, steps))
    assert usage.agg(F.sum("n")).first()[0] == 600 and {r["step"] for r in usage.collect()} == {"s", None}
    hardware = spark.createDataFrame([("h0", 8)], "host string, cores int")
    assert MT.with_hardware(metrics, hardware).filter("cores = 8").count() == metrics.filter("host = 'h0'").count()
    assert rows(MT.step_ends(steps), "end") == [(None,)]


def test_log_and_file_selection(spark):
    lines = spark.createDataFrame([("[2024-01-01T10:00:00Z] h1: go",), ("[2024-01-01T12:30:00.5Z] h2: end",), ("junk",)], "value string")
    assert rows(MT.log_hosts(lines)) == [("h1",), ("h2",)]
    assert rows(MT.run_frame(lines)) == [(dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 1, 12, 30, 0, 500000))]
    day = dt.timedelta(hours=1)
    files = spark.createDataFrame(
        [("early", T0, T0 + day), ("in", T0 + 11 * day, T0 + 20 * day), ("late", T0 + 13 * day, T0 + 20 * day)],
        "name string, first_ts timestamp_ntz, mtime timestamp_ntz")
    assert rows(MT.in_run_frame(files, MT.run_frame(lines)), "name") == [("in",)]
    schema = "host string, name string, size long, mtime timestamp_ntz"
    remote = spark.createDataFrame([("h", "same", 1, T0), ("h", "grown", 2, T0), ("h", "new", 1, T0), ("h", "touched", 1, T0)], schema)
    local = spark.createDataFrame([("h", "same", 1, T0), ("h", "grown", 1, T0), ("h", "touched", 1, T0 + day)], schema)
    assert rows(MT.changed_files(remote, local), "name") == [("grown",), ("new",), ("touched",)]


@pytest.fixture
def landing(spark, tmp_path):
    return str(tmp_path / f"landing-{uuid.uuid4().hex}")


def test_stream_equals_batch(spark, landing, tmp_path):
    _, metrics = series(spark, kind="timestamp")
    metrics.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 100).parquet(landing)
    stream = LV.open_stream(spark, landing, metrics.schema)
    LV.write_usage(LV.live_usage(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    batch = MT.interval_stats(metrics)
    final = metrics.agg(F.max("ts") - F.expr("interval 10 minutes")).first()[0]
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got.select(*batch.columns)) == rows(batch.filter(F.col("end") <= F.lit(final)))


def test_ingest_versions(spark, landing, tmp_path):
    schema = "host string, name string, size long, mtime timestamp"
    target, ck = str(tmp_path / "t"), str(tmp_path / "c")
    first = [("h", "a", 1, T0), ("h", "b", 1, T0), ("h", "a", 1, T0)]
    spark.createDataFrame(first, schema).write.mode("append").parquet(landing)
    stream = LV.open_stream(spark, landing, spark.createDataFrame([], schema).schema)
    LV.ingest_changed(stream, target, ck).awaitTermination()
    spark.createDataFrame([("h", "a", 1, T0), ("h", "a", 2, T0), ("h", "c", 1, T0)], schema).write.mode("append").parquet(landing)
    LV.ingest_changed(stream, target, ck).awaitTermination()
    assert rows(spark.read.parquet(target), "name", "size") == [("a", 1), ("a", 2), ("b", 1), ("c", 1)]


def test_new_versions_stream(spark, landing, tmp_path):
    schema = "host string, name string, size long, mtime timestamp"
    spark.createDataFrame([("h", "a", 1, T0), ("h", "a", 1, T0), ("h", "a", 2, T0)], schema).write.parquet(landing)
    stream = LV.new_versions(LV.open_stream(spark, landing, spark.createDataFrame([], schema).schema))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "o")), "name", "size") == [("a", 1), ("a", 2)]


INSTANCES = [
    (0, "mgt0", "st", "n1", "running", "t", "", "10.0.0.1", "z"), (1, "ost1", "st", "n1", "running", "t", "54.0.0.2", "10.0.0.2", "z"),
    (2, "ost1", "st", "n1", "running", "t", "54.0.0.3", "10.0.0.3", "z"), (3, "ost1", "st", "n1", "terminated", "t", "", "10.0.0.4", "z"),
    (4, "NATDevice", "st", "n2", "running", "t", "54.0.0.5", "10.0.0.5", "z"), (5, None, None, "n2", "running", "t", None, "10.0.0.6", "z")]


def instances(spark):
    return spark.createDataFrame(INSTANCES, "ord long, name string, stack string, network_id string, state string, instance_type string, "
                                            "public_ip string, private_ip string, zone string")


def interfaces(spark):
    return spark.createDataFrame([(0, 0, "10.1.0.1", None), (0, 1, "10.1.0.2", "mgt"), (4, 0, "10.0.0.1", None)],
                                 "ord long, iface int, address string, role string")


def test_fleet_lookups(spark):
    networks = spark.createDataFrame([("n1", "main"), ("n2", "side")], "network_id string, network_name string")
    assert rows(FL.network_instances(instances(spark), networks, "side"), "name", "address") == [("(none)", "10.0.0.6"), ("NATDevice", "54.0.0.5")]
    asked = spark.createDataFrame([("10.0.0.1",), ("10.1.0.2",), ("9.9.9.9",), ("10.0.0.6",)], "address string")
    assert rows(FL.address_stack(asked, instances(spark), interfaces(spark))) == [("10.0.0.1", 0, "st"), ("10.0.0.6", 5, None), ("10.1.0.2", 0, "st")]
    assert rows(FL.management_address(instances(spark), interfaces(spark))) == [("st", "10.1.0.2")]
    members = FL.stack_members(instances(spark))
    assert rows(members.filter("stack = 'st'"), "name", "address") == [("NATDevice", "54.0.0.5"), ("mgt0", "10.0.0.1"), ("ost1", "10.0.0.3")]
    assert rows(FL.role_members(members), "role", "name") == [("mgs", "mgt0"), ("oss", "ost1")]


def test_rollups(spark):
    lines = spark.createDataFrame([(1, 0, "frontend001 a"), (1, 1, "frontend002 b"), (1, 2, "compute001 c"), (1, 3, "[all]")],
                                  "cluster_id long, ord long, line string")
    assert rows(FL.inventory_roles(lines), "role", "host") == [("client", "compute001"), ("server", "frontend002")]
    hosts = spark.createDataFrame([(1, "a", 1, 2), (1, "b", 0, 0), (2, "c", 0, 0)], "run_id long, host string, unreachable int, failures long")
    assert rows(FL.host_status(hosts)) == [(1, 1, 1, 2, True), (2, 0, 0, 0, False)]
    assert rows(FL.failing_hosts(hosts), "kind", "text") == [("failures", "a (2 failures)"), ("unreachable", "a")]
    expected = spark.createDataFrame([("s", "user", "u"), ("s", "group", "g"), ("s", "network", "n")], "scope string, kind string, name string")
    objects = spark.createDataFrame([("s", "user", "u"), ("s", "group", "other")], "scope string, kind string, name string")
    assert rows(FL.audit_expected(expected, objects), "kind", "state") == [("group", "missing"), ("network", "none exist"), ("user", "ok")]


def test_specs(spark):
    specs = spark.createDataFrame(
        [("s", "a", "memory", ["2G"]), ("s", "b", "memory", ["3g"]), ("s", "c", "jvm_opts", ["-Xms1m", "-Xmx750m"]), ("s", "d", "memory", ["3000M"]),
         ("s", "e", "cores", ["4"]), ("s", "f", "jvm_opts", ["-Xms1m", "-Xmx1G", "-XX"]), ("s", "g", "dir", ["x"])],
        "site string, program string, key string, values array<string>")
    assert rows(FL.common_memory(specs)) == [("s", 2000.0)]
    got = {r["program"]: r["values"] for r in FL.rescale_specs(specs, 8, 1500).collect()}
    # 3000 is exactly 1.5 × the median and stays.
    assert got == {"a": ["1500M"], "b": ["3g"], "c": ["-Xms1m", "-Xmx1500m"], "d": ["3000M"], "e": ["8"],
                   "f": ["-Xms1m", "-Xmx1G", "-Xmx1500M"], "g": ["x"]}
    with pytest.raises(Exception, match="unknown memory unit"):
        FL.common_memory(spark.createDataFrame([("s", "a", "memory", ["2T"])], specs.schema)).collect()


def test_capacity_and_images(spark):
    clusters = spark.createDataFrame([(1, 0, "x", "c4.8xlarge"), (2, 9, "c3.4xlarge", "x"), (3, 10, "c3.4xlarge", "x"), (4, 1, "new", "x")],
                                     "cluster_id long, compute_nodes int, compute_flavor string, frontend_flavor string")
    assert rows(FL.cluster_capacity(clusters), "cluster_id", "cores", "core_mb", "known") == [
        (1, 34, 1600, True), (2, 15, 1750, True), (3, 16, 1750, True), (4, None, None, False)]
    images = spark.createDataFrame(
        [("r", "hvm:ebs-ssd", "14.04 LTS", "<a>ami-1</a>"), ("r", "hvm:ebs-ssd", "16.04 LTS", "<a>ami-2</a>"), ("r", "hvm:ebs-ssd", "16.04 LTS", "<a>ami-3</a>"),
         ("r", "pv", "18.04 LTS", "<a>ami-4</a>"), ("r", "hvm:ebs-ssd", "17.10", "<a>ami-5</a>")], "region string, instance_type string, version string, image string")
    assert rows(FL.latest_image(images)) == [("r", "16.04 LTS", "ami-3")]
    outputs = spark.createDataFrame([("s", 0, "CREATE_COMPLETE", "k", "1"), ("s", 1, "CREATE_COMPLETE", "k", "2"), ("t", 0, "ROLLBACK", "k", "3")],
                                    "stack string, ord long, status string, key string, value string")
    assert rows(FL.stack_outputs(outputs)) == [("s", "k", "2")]
    folders = spark.createDataFrame([("hg19", "seq"), ("hg19", "vep"), ("hg19", "bwa"), ("hg19", "tmp")], "build string, name string")
    targets = spark.createDataFrame([("seq",), ("bwa",)], "target string")
    assert rows(FL.target_folders(folders, targets), "target", "path") == [("bwa", "hg19/bwa"), ("seq", "hg19/seq"), ("seq", "hg19/vep")]


def test_steps_of_one_busy_host_and_of_one_instant(spark):
    steps = spark.range(400).selectExpr("'h' host", "cast(id as string) step", "timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,0, id div 2) start")
    plain, sliced = (sorted(map(tuple, MT.step_ends(steps, n).collect())) for n in (None, 30))
    assert plain == sliced and sum(r[-1] is None for r in sliced) == 1
    # Most rows and many steps share one instant.
    rows = spark.range(3000).selectExpr("id event_id", "case when id % 50 = 0 then null else 'h' end host",
                                        "timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,0, if(id < 2500, 100, id - 2500)) ts", "'m' metric", "1D value")
    crowd = steps.unionByName(spark.range(500).selectExpr("'h' host", "concat('c', id) step", "timestamp_ntz'2024-01-01 00:01:40' start"))
    whole, split = (sorted(map(str, MT.attribute_steps(rows, crowd, split_rows=n).collect())) for n in (None, 40))
    assert whole == split and len(whole) == 3000
