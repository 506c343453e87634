"""Run-metric, streaming and fleet queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stowline.functions import paths as P
from stowline.operators import fleet as FL
from stowline.operators import metrics as MT
from stowline.plans import bindings as B
from stowline.plans import oracle_views as V
from stowline.plans.registry import query
from stowline.session import checkpoint_ready
from stowline.sources import files as SF
from stowline.sources import inventory as IV
from stowline.streaming import live as LV

METRICS = """
metrics AS (SELECT event_id, 'h' || user_id AS host, ts, event_type AS metric, value FROM events),
steps AS (SELECT 'h' || user_id AS host, 's' || (event_id % 12) AS step, ts AS start, event_id AS step_id FROM events WHERE event_type = 'signup')
"""
ATTRIBUTED = METRICS + """,
attributed AS (SELECT m.*, s.step, s.start AS step_start FROM metrics m ASOF LEFT JOIN steps s ON m.host = s.host AND m.ts >= s.start)
"""


def _host():
    return F.concat(F.lit("h"), F.col("user_id").cast("string"))


def _rounded(name):
    """Four digits; the nudge settles exact halves the same way in every engine."""
    return F.round(F.col(name) + 1e-9, 4)


def metrics(t):
    return t.events.select("event_id", _host().alias("host"), "ts", F.col("event_type").alias("metric"), "value")


def steps(t):
    name = F.concat(F.lit("s"), (F.col("event_id") % 12).cast("string"))
    return t.events.filter("event_type = 'signup'").select(_host().alias("host"), name.alias("step"), F.col("ts").alias("start"))


def log_lines(t):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    line = F.concat(F.lit("["), stamp, F.lit("Z] "), _host(), F.lit(": "), F.col("event_type"))
    return t.events.select(F.when(F.col("event_type") == "error", F.lit("Traceback: no stamp")).otherwise(line).alias("value"))


@query("d5_usage_interval", f"""
WITH {METRICS}
SELECT host, metric, date_trunc('hour', ts)::TIMESTAMP AS start, (date_trunc('hour', ts) + INTERVAL 1 HOUR)::TIMESTAMP AS "end", count(value) AS n,
    min(value) AS lowest, round(avg(value) + 1e-9, 4) AS mean, max(value) AS highest, round(quantile_cont(value, 0.95) + 1e-9, 4) AS p95 FROM metrics GROUP BY ALL
""")
def d5(t):
    return MT.usage_by_interval(metrics(t)).withColumns({"mean": _rounded("mean"), "p95": _rounded("p95")})


@query("d5_usage_day", f"""
WITH {METRICS}
SELECT host, metric, date_trunc('day', ts)::TIMESTAMP AS start, (date_trunc('day', ts) + INTERVAL 1 DAY)::TIMESTAMP AS "end", count(value) AS n,
    min(value) AS lowest, round(avg(value) + 1e-9, 4) AS mean, max(value) AS highest, round(quantile_cont(value, 0.95) + 1e-9, 4) AS p95 FROM metrics GROUP BY ALL
""")
def d5_day(t):
    return MT.usage_by_interval(metrics(t), "1 day").withColumns({"mean": _rounded("mean"), "p95": _rounded("p95")})


@query("d4_step_attribution", f"WITH {ATTRIBUTED} SELECT event_id, host, ts, metric, value, step, step_start FROM attributed")
def d4(t):
    return MT.attribute_steps(metrics(t), steps(t))


@query("d4_hardware", f"""
WITH {METRICS}, hw AS (SELECT 'h' || c_custkey AS host, c_nationkey + 1 AS cores, c_acctbal AS mem FROM customer)
SELECT event_id, host, cores, mem FROM metrics LEFT JOIN hw USING (host)
""")
def d4_hardware(t):
    hardware = t.customer.select(
        F.concat(F.lit("h"), F.col("c_custkey").cast("string")).alias("host"), (F.col("c_nationkey") + 1).alias("cores"),
        F.col("c_acctbal").alias("mem"))
    return MT.with_hardware(metrics(t), hardware).select("event_id", "host", "cores", "mem")


@query("d4_step_ends", f"""
WITH {METRICS} SELECT host, step, start, lead(start) OVER (PARTITION BY host ORDER BY start, step) AS "end" FROM steps
""")
def d4_ends(t):
    return MT.step_ends(steps(t))


@query("d6_usage_by_step", f"""
WITH {ATTRIBUTED}
SELECT step, metric, count(value) AS n, count(DISTINCT host) AS hosts, min(value) AS lowest, round(avg(value) + 1e-9, 4) AS mean, max(value) AS highest
FROM attributed GROUP BY ALL
""")
def d6(t):
    return MT.usage_by_step(MT.attribute_steps(metrics(t), steps(t))).withColumn("mean", _rounded("mean"))


FILES = """
remote AS (SELECT 'h' || user_id AS host, 'log-' || event_id || '.raw.gz' AS name, CAST(json_extract(props, '$.k') AS BIGINT) * 10 AS size, ts AS mtime,
    ts - INTERVAL 1 DAY AS first_ts, event_id FROM events)
"""


def _files(t):
    size = F.get_json_object("props", "$.k").cast("long") * 10
    name = F.concat(F.lit("log-"), F.col("event_id").cast("string"), F.lit(".raw.gz"))
    return t.events.select(
        _host().alias("host"), name.alias("name"), size.alias("size"), F.col("ts").alias("mtime"),
        (F.col("ts") - F.expr("INTERVAL 1 DAY")).alias("first_ts"), "event_id")


@query("d1_raw_files", f"WITH {FILES} SELECT host, name, size, date_trunc('second', mtime)::TIMESTAMP AS mtime FROM remote")
def d1(t):
    lines = _files(t).select("host", F.concat_ws(" ", F.col("size").cast("string"), F.unix_seconds(F.col("mtime").cast("timestamp")).cast("string"), "name").alias("value"))
    return SF.parse_stat_lines(lines).withColumn("mtime", F.col("mtime").cast("timestamp_ntz"))


@query("d2_window_prune", f"""
WITH {FILES}, frame AS (SELECT min(ts) AS a, max(ts) AS b FROM events WHERE event_type = 'view' AND ts BETWEEN '2024-01-05' AND '2024-01-06')
SELECT host, name, mtime FROM remote, frame WHERE mtime >= a AND first_ts <= b
""")
def d2(t):
    day = t.events.filter("event_type = 'view' and ts between timestamp_ntz'2024-01-05' and timestamp_ntz'2024-01-06'")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    lines = day.select(F.concat(F.lit("["), stamp, F.lit("] "), _host(), F.lit(": view")).alias("value"))
    return MT.in_run_frame(_files(t), MT.run_frame(lines)).select("host", "name", "mtime")


@query("d3_changed_files", f"""
WITH {FILES} SELECT host, name, size, mtime FROM remote WHERE NOT (event_id % 3 = 0 OR (event_id % 3 = 1 AND size % 20 = 0))
""")
def d3(t):
    remote, eid = _files(t), F.col("event_id")
    copied = remote.filter(eid % 3 != 2).withColumn(
        "size", F.when(eid % 3 == 0, F.col("size")).otherwise(F.floor(F.col("size") / 20) * 20))
    return MT.changed_files(remote, copied).select("host", "name", "size", "mtime")


@query("d7_log_hosts", f"WITH {METRICS} SELECT DISTINCT host FROM metrics WHERE metric <> 'error'")
def d7(t):
    return MT.log_hosts(log_lines(t))


@query("d8_run_frame", f"WITH {METRICS} SELECT min(ts) AS run_start, max(ts) AS run_end FROM metrics WHERE metric <> 'error'")
def d8(t):
    return MT.run_frame(log_lines(t))


def _scratch(spark) -> str:
    """A new folder under the shared checkpoint folder."""
    checkpoint_ready(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


@query("d9_series_sink", f"WITH {METRICS} SELECT event_id, host, ts, metric, value, CAST(ts AS DATE) AS day FROM metrics")
def d9(t):
    out = _scratch(t.spark) + "/series"
    SF.write_series(metrics(t), out)
    return t.spark.read.parquet(out)


@query("s2_live_usage", f"""
WITH {METRICS}, u AS (SELECT host, metric, date_trunc('hour', ts)::TIMESTAMP AS start, count(value) AS n, min(value) AS lowest,
    round(avg(value) + 1e-9, 4) AS mean, max(value) AS highest FROM metrics GROUP BY 1, 2, 3)
SELECT *, (start + INTERVAL 1 HOUR)::TIMESTAMP AS "end" FROM u
WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM metrics)
""")
def s2(t):
    out = _scratch(t.spark)
    stream = LV.open_stream(t.spark, t.folder, t.events.schema, "events.parquet")
    rows = stream.select(_host().alias("host"), "ts", F.col("event_type").alias("metric"), "value")
    LV.write_usage(LV.live_usage(rows), f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{out}/data").withColumn("mean", _rounded("mean"))


@query("s1_ingest", f"WITH {FILES} SELECT DISTINCT host, name, size, mtime FROM remote")
def s1(t):
    out = _scratch(t.spark)
    stream = LV.open_stream(t.spark, t.folder, t.events.schema, "events.parquet")
    name = F.concat(F.lit("log-"), F.col("event_id").cast("string"), F.lit(".raw.gz"))
    rows = stream.select(_host().alias("host"), name.alias("name"),
                         (F.get_json_object("props", "$.k").cast("long") * 10).alias("size"), F.col("ts").alias("mtime"))
    # Each version arrives twice.
    twice = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_copy")).drop("_copy")
    LV.ingest_changed(twice, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{out}/data").select("host", "name", "size", "mtime")


@query("s1_new_versions", f"WITH {FILES} SELECT DISTINCT host, name, size, mtime FROM remote")
def s1_versions(t):
    """Four files land, one a batch; each version is in two of them."""
    out = _scratch(t.spark)
    files = _files(t).select("host", "name", "size", F.col("mtime").cast("timestamp").alias("mtime"))
    twice = files.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    twice.repartitionByRange(4, "copy", "mtime").drop("copy").write.parquet(f"{out}/landed")
    stream = LV.open_stream(t.spark, f"{out}/landed", files.schema, max_files=1)
    query = LV.new_versions(stream, "40 days").writeStream.format("parquet").option("path", f"{out}/data").option(
        "checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return t.spark.read.parquet(f"{out}/data").withColumn("mtime", F.col("mtime").cast("timestamp_ntz"))


@query("d2_pruned", f"""
WITH {FILES}, frame AS (SELECT min(ts) AS a, max(ts) AS b FROM events WHERE event_type = 'view' AND ts BETWEEN '2024-01-05' AND '2024-01-06')
SELECT host, name, mtime FROM remote, frame WHERE mtime >= a AND first_ts <= b
""")
def d2_pruned(t):
    """The same window over stored files: days outside the run are not read."""
    out = _scratch(t.spark) + "/files"
    SF.write_raw_files(_files(t), out)
    frame = t.events.filter("event_type = 'view' and ts between timestamp_ntz'2024-01-05' and timestamp_ntz'2024-01-06'").agg(
        F.min("ts").alias("run_start"), F.max("ts").alias("run_end"))
    return MT.in_run_frame(t.spark.read.parquet(out), frame, day="day", span_days=1).select("host", "name", "mtime")


@query("a1_listing", f"""
WITH {V.PARTS} SELECT kind, CAST(sum(octet_length(encode(path)) + 1) AS BIGINT) AS bytes FROM parts GROUP BY kind
""")
def a1(t):
    """Files below a folder with their sizes, read from the file system alone: the paths, one a line, in one folder per kind."""
    out = _scratch(t.spark) + "/tree"
    B.parts(t).select("kind", "path").write.partitionBy("kind").text(out)
    files = IV.scan_files(t.spark, out)
    kind = F.regexp_extract("path", r"/kind=([^/]*)/[^/]*$", 1)
    return files.groupBy(kind.alias("kind")).agg(F.sum("size").alias("bytes"))


# -- fleet ---------------------------------------------------------------------------------------------

FLEET = """
instances AS (SELECT s_suppkey AS ord, CASE s_suppkey % 6 WHEN 0 THEN 'mgt' || (s_suppkey % 2) WHEN 1 THEN 'mdt0' WHEN 2 THEN 'ost' || (s_suppkey % 9)
        WHEN 3 THEN 'NATDevice' WHEN 4 THEN 'node' || s_suppkey END AS name, 'stack' || s_nationkey AS stack, 'vpc' || s_nationkey AS network_id,
    CASE WHEN s_acctbal < 0 THEN 'terminated' WHEN s_acctbal < 1000 THEN 'shutting-down' ELSE 'running' END AS state,
    CASE s_suppkey % 3 WHEN 0 THEN 'm4.large' ELSE 'c3.large' END AS instance_type, CASE s_suppkey % 4 WHEN 0 THEN '' ELSE '54.1.' || s_suppkey END AS public_ip,
    '10.0.' || (s_suppkey // 2) AS private_ip, 'z' || s_nationkey || 'a' AS zone FROM supplier),
interfaces AS (SELECT s_suppkey AS ord, i AS iface, '10.1.' || (s_suppkey + i) AS address, CASE WHEN i = 1 AND s_suppkey % 12 = 0 THEN 'mgt' END AS role
    FROM supplier, (SELECT unnest([0, 1]) AS i))
"""


def instances(t):
    key = F.col("s_suppkey")
    text = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    name = (
        F.when(key % 6 == 0, text("mgt", key % 2)).when(key % 6 == 1, F.lit("mdt0")).when(key % 6 == 2, text("ost", key % 9))
        .when(key % 6 == 3, F.lit("NATDevice")).when(key % 6 == 4, text("node", key)))
    state = F.when(F.col("s_acctbal") < 0, F.lit("terminated")).when(F.col("s_acctbal") < 1000, F.lit("shutting-down")).otherwise(F.lit("running"))
    nation = F.col("s_nationkey")
    return t.supplier.select(
        key.alias("ord"), name.alias("name"), text("stack", nation).alias("stack"), text("vpc", nation).alias("network_id"),
        state.alias("state"), F.when(key % 3 == 0, F.lit("m4.large")).otherwise(F.lit("c3.large")).alias("instance_type"),
        F.when(key % 4 == 0, F.lit("")).otherwise(text("54.1.", key)).alias("public_ip"),
        text("10.0.", F.floor(key / 2)).alias("private_ip"), F.concat(F.lit("z"), nation.cast("string"), F.lit("a")).alias("zone"))


def interfaces(t):
    key = F.col("s_suppkey")
    return t.supplier.select(key, F.explode(F.array(F.lit(0), F.lit(1))).alias("iface")).select(
        key.alias("ord"), "iface", F.concat(F.lit("10.1."), (key + F.col("iface")).cast("string")).alias("address"),
        F.when((F.col("iface") == 1) & (key % 12 == 0), F.lit("mgt")).alias("role"))


@query("e2_instances", f"""
WITH {FLEET}
SELECT ord, n_name AS network_name, coalesce(name, '(none)') AS name, instance_type, state, CASE WHEN public_ip = '' THEN private_ip ELSE public_ip END AS address, zone
FROM instances JOIN nation ON network_id = 'vpc' || n_nationkey WHERE n_name IN ('NATION_3', 'NATION_7')
""")
def e2(t):
    networks = t.nation.select(F.concat(F.lit("vpc"), F.col("n_nationkey").cast("string")).alias("network_id"), F.col("n_name").alias("network_name"))
    one = lambda name: FL.network_instances(instances(t), networks, name)
    return one("NATION_3").unionByName(one("NATION_7"))


@query("e3_addr_to_stack", f"""
WITH {FLEET},
asked AS (SELECT DISTINCT unnest(['10.0.' || s_suppkey, '10.1.' || (s_suppkey * 2)]) AS address FROM supplier),
owners AS (SELECT ord, -1 AS iface, private_ip AS address, stack FROM instances UNION ALL SELECT f.ord, f.iface, f.address, i.stack FROM interfaces f JOIN instances i USING (ord))
SELECT address, ord, stack FROM asked JOIN owners USING (address) QUALIFY row_number() OVER (PARTITION BY address ORDER BY ord, iface) = 1
""")
def e3(t):
    key = F.col("s_suppkey")
    asked = t.supplier.select(F.explode(F.array(
        F.concat(F.lit("10.0."), key.cast("string")), F.concat(F.lit("10.1."), (key * 2).cast("string")))).alias("address"))
    return FL.address_stack(asked, instances(t), interfaces(t))


@query("e3_management_addr", f"""
WITH {FLEET}, f AS (SELECT stack, ord, private_ip FROM instances WHERE starts_with(name, 'mgt') QUALIFY row_number() OVER (PARTITION BY stack ORDER BY ord) = 1)
SELECT stack, coalesce((SELECT min(address) FROM interfaces i WHERE i.ord = f.ord AND role = 'mgt'), private_ip) AS address FROM f
""")
def e3_management(t):
    return FL.management_address(instances(t), interfaces(t))


@query("e6_stack_members", f"""
WITH {FLEET} SELECT stack, name, CASE name WHEN 'NATDevice' THEN public_ip ELSE private_ip END AS address FROM instances
WHERE state = 'running' QUALIFY row_number() OVER (PARTITION BY stack, name ORDER BY ord DESC) = 1
""")
def e6(t):
    return FL.stack_members(instances(t))


@query("e7_role_rollup", f"""
WITH {FLEET}, m AS (SELECT stack, name, private_ip AS address FROM instances WHERE state = 'running' QUALIFY row_number() OVER (PARTITION BY stack, name ORDER BY ord DESC) = 1)
SELECT stack, CASE substr(name, 1, 3) WHEN 'mgt' THEN 'mgs' WHEN 'mdt' THEN 'mds' ELSE 'oss' END AS role, name, address FROM m WHERE substr(name, 1, 3) IN ('mgt', 'mdt', 'ost')
""")
def e7(t):
    return FL.role_members(FL.stack_members(instances(t)))


@query("e7_inventory_roles", """
WITH l AS (SELECT o_custkey % 50 AS cluster_id, o_orderkey AS ord, CASE o_orderstatus WHEN 'F' THEN 'frontend' WHEN 'O' THEN 'compute' ELSE 'other' END || CASE WHEN len('' || o_orderkey) < 3 THEN lpad('' || o_orderkey, 3, '0') ELSE '' || o_orderkey END AS host FROM orders)
SELECT cluster_id, 'client' AS role, ord, host FROM l WHERE starts_with(host, 'compute')
UNION ALL SELECT cluster_id, 'server', max(ord), arg_max(host, ord) FROM l WHERE starts_with(host, 'frontend') GROUP BY 1
""")
def e7_inventory(t):
    kind = F.when(F.col("o_orderstatus") == "F", F.lit("frontend")).when(F.col("o_orderstatus") == "O", F.lit("compute")).otherwise(F.lit("other"))
    number = F.col("o_orderkey").cast("string")
    padded = F.when(F.length(number) >= 3, number).otherwise(F.lpad(number, 3, "0"))
    line = F.concat(kind, padded, F.lit(" ansible_ssh_host=10.0.0.1"))
    return FL.inventory_roles(t.orders.select((F.col("o_custkey") % 50).alias("cluster_id"), F.col("o_orderkey").alias("ord"), line.alias("line")))


@query("e8_failures", """
SELECT 'stack' || (o_custkey % 40) AS stack, o_orderkey AS ord, 'res' || o_custkey || ': ' || o_orderpriority AS failure FROM orders WHERE o_orderstatus = 'F'
""")
def e8(t):
    status = F.when(F.col("o_orderstatus") == "F", F.lit("CREATE_FAILED")).otherwise(F.lit("CREATE_COMPLETE"))
    cust = F.col("o_custkey")
    return FL.failed_events(t.orders.select(
        F.concat(F.lit("stack"), (cust % 40).cast("string")).alias("stack"), F.col("o_orderkey").alias("ord"),
        F.concat(F.lit("res"), cust.cast("string")).alias("resource"), status.alias("status"), F.col("o_orderpriority").alias("reason")))


HOSTS = """
hosts AS (SELECT l_suppkey AS run_id, 'h' || l_orderkey || '-' || l_linenumber AS host, CASE WHEN l_returnflag = 'R' AND l_suppkey % 3 = 0 THEN 1 ELSE 0 END AS unreachable,
    CASE WHEN l_suppkey % 4 = 0 THEN CAST(l_linenumber AS BIGINT) % 3 ELSE 0 END AS failures FROM lineitem)
"""


def _hosts(t):
    run = F.col("l_suppkey")
    return t.lineitem.select(
        run.alias("run_id"), F.concat(F.lit("h"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("host"),
        F.when((F.col("l_returnflag") == "R") & (run % 3 == 0), 1).otherwise(0).alias("unreachable"),
        F.when(run % 4 == 0, F.col("l_linenumber").cast("long") % 3).otherwise(F.lit(0).cast("long")).alias("failures"))


@query("e8_host_status", f"""
WITH {HOSTS} SELECT run_id, count(*) FILTER (unreachable > 0) AS n_unreachable, count(*) FILTER (failures > 0) AS n_failing,
    CAST(sum(failures) AS BIGINT) AS n_failures, bool_or(unreachable > 0 OR failures > 0) AS failed FROM hosts GROUP BY 1
""")
def e8_status(t):
    return FL.host_status(_hosts(t))


@query("e8_failing_hosts", f"""
WITH {HOSTS} SELECT run_id, 'unreachable' AS kind, host AS text FROM hosts WHERE unreachable > 0
UNION ALL SELECT run_id, 'failures', host || ' (' || failures || ' failures)' FROM hosts WHERE failures > 0
""")
def e8_hosts(t):
    return FL.failing_hosts(_hosts(t))


CLUSTERS = """
clusters AS (SELECT c_custkey AS cluster_id, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 15 END AS compute_nodes,
    CASE c_mktsegment WHEN 'MACHINERY' THEN 'c4.8xlarge' WHEN 'FURNITURE' THEN 'm4.4xlarge' WHEN 'HOUSEHOLD' THEN 'r3.8xlarge' ELSE 'x9.huge' END AS compute_flavor,
    'm3.large' AS frontend_flavor FROM customer),
cap AS (SELECT * FROM (VALUES ('c4.8xlarge', 36, 1600), ('m4.4xlarge', 16, 4000), ('r3.8xlarge', 32, 7000), ('m3.large', 2, 3500)) v(machine, all_cores, core_mb)),
j AS (SELECT cluster_id, compute_nodes, CASE WHEN compute_nodes > 0 THEN compute_flavor ELSE frontend_flavor END AS machine FROM clusters)
"""


def _clusters(t):
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    flavor = (
        F.when(segment == "MACHINERY", F.lit("c4.8xlarge")).when(segment == "FURNITURE", F.lit("m4.4xlarge"))
        .when(segment == "HOUSEHOLD", F.lit("r3.8xlarge")).otherwise(F.lit("x9.huge")))
    return t.customer.select(key.alias("cluster_id"), F.when(key % 3 == 0, 0).otherwise(key % 15).alias("compute_nodes"),
                             flavor.alias("compute_flavor"), F.lit("m3.large").alias("frontend_flavor"))


@query("e4_capacity", f"""
WITH {CLUSTERS} SELECT cluster_id, j.machine, CAST(CASE WHEN all_cores > 30 THEN all_cores - 2 WHEN all_cores > 15 AND compute_nodes < 10 THEN all_cores - 1 ELSE all_cores END AS BIGINT) AS cores,
    CAST(core_mb AS BIGINT) AS core_mb, all_cores IS NOT NULL AS known FROM j LEFT JOIN cap USING (machine)
""")
def e4(t):
    return FL.cluster_capacity(_clusters(t))


@query("e9_usable_cores", """
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_quantity > 30 THEN l_quantity - 2 WHEN l_quantity > 15 AND l_linenumber < 10 THEN l_quantity - 1 ELSE l_quantity END AS BIGINT) AS cores FROM lineitem
""")
def e9(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", FL.usable_cores(F.col("l_quantity").cast("long"), "l_linenumber").alias("cores"))


SPECS = V.PARTS + """,
specs AS (SELECT k, brand AS site, 'prog' || k AS program, CASE k % 3 WHEN 0 THEN 'memory' WHEN 1 THEN 'jvm_opts' ELSE 'cores' END AS key,
    psize || CASE k % 4 WHEN 0 THEN 'G' WHEN 1 THEN 'g' WHEN 2 THEN 'M' ELSE 'm' END AS size, CASE k % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'm' WHEN 2 THEN 'M' ELSE 'm' END AS unit,
    psize * CASE WHEN k % 4 < 2 THEN 1000 ELSE 1 END AS mb FROM parts),
common AS (SELECT site, median(mb) AS common_mb FROM specs WHERE key <> 'cores' GROUP BY 1)
"""


def _specs(t):
    k = F.col("k")
    size = F.concat(F.col("psize").cast("string"), F.element_at(F.array(*map(F.lit, "GgMm")), (k % 4 + 1).cast("int")))
    key = F.when(k % 3 == 0, F.lit("memory")).when(k % 3 == 1, F.lit("jvm_opts")).otherwise(F.lit("cores"))
    jvm = F.array(F.lit("-Xms1m"), F.concat(F.lit("-Xmx"), size), F.lit("-XX:x"))
    return B.parts(t).select(
        F.col("brand").alias("site"), F.concat(F.lit("prog"), k.cast("string")).alias("program"), key.alias("key"),
        F.when(k % 3 == 1, jvm).otherwise(F.array(size)).alias("values"))


@query("e5_median_spec", f"WITH {SPECS} SELECT site, CAST(common_mb AS DOUBLE) AS common_mb FROM common")
def e5(t):
    return FL.common_memory(_specs(t))


@query("e13_rescale", f"""
WITH {SPECS} SELECT site, program, key, CASE key WHEN 'cores' THEN '7' WHEN 'memory' THEN CASE WHEN mb >= 1.5 * common_mb THEN size ELSE '2500' || unit END
    ELSE CASE WHEN mb >= 1.5 * common_mb THEN '-Xms1m -Xmx' || size || ' -XX:x' ELSE '-Xms1m -Xmx' || size || ' -Xmx2500' || unit END END AS spec
FROM specs JOIN common USING (site)
""")
def e13(t):
    return FL.rescale_specs(_specs(t), 7, 2500).select("site", "program", "key", F.array_join("values", " ").alias("spec"))


@query("e1_dir_whitelist", """
WITH d AS (SELECT 'hg' || p_partkey // 20 AS build, CASE p_size % 8 WHEN 0 THEN 'seq' WHEN 1 THEN 'coverage' WHEN 2 THEN 'bwa' WHEN 3 THEN 'vep' WHEN 4 THEN 'rtg' WHEN 5 THEN 'star' WHEN 6 THEN 'variation' ELSE 'tmp' END AS name FROM part)
SELECT build, 'seq' AS target, name, build || '/' || name AS path FROM d WHERE name IN ('seq', 'coverage', 'vep', 'variation')
UNION ALL SELECT build, name, name, build || '/' || name FROM d WHERE name IN ('bwa', 'rtg')
""")
def e1(t):
    names = F.array(*map(F.lit, ("seq", "coverage", "bwa", "vep", "rtg", "star", "variation", "tmp")))
    folders = t.part.select(F.concat(F.lit("hg"), F.floor(F.col("p_partkey") / 20).cast("string")).alias("build"),
                            F.element_at(names, F.col("p_size") % 8 + 1).alias("name"))
    targets = t.spark.createDataFrame([("seq",), ("bwa",), ("rtg",)], "target string")
    return FL.target_folders(folders, targets)


@query("e10_audit", """
WITH obj AS (SELECT 'n' || c_nationkey AS scope, CASE c_custkey % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'group' ELSE 'network' END AS kind, c_mktsegment AS name FROM customer WHERE c_nationkey % 4 <> 0 OR c_custkey % 3 = 0),
want AS (SELECT 'n' || n_nationkey AS scope, k AS kind, CASE WHEN n_nationkey % 2 = 0 THEN 'MACHINERY' ELSE 'NOTHERE' END AS expected FROM nation, (SELECT unnest(['user', 'group', 'network']) AS k))
SELECT scope, kind, expected, CASE WHEN NOT EXISTS (SELECT 1 FROM obj o WHERE o.scope = w.scope AND o.kind = w.kind) THEN 'none exist'
    WHEN EXISTS (SELECT 1 FROM obj o WHERE o.scope = w.scope AND o.kind = w.kind AND o.name = w.expected) THEN 'ok' ELSE 'missing' END AS state FROM want w
""")
def e10(t):
    key = F.col("c_custkey")
    kind = F.when(key % 3 == 0, F.lit("user")).when(key % 3 == 1, F.lit("group")).otherwise(F.lit("network"))
    objects = t.customer.filter("c_nationkey % 4 != 0 or c_custkey % 3 = 0").select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("scope"), kind.alias("kind"), F.col("c_mktsegment").alias("name"))
    expected = t.nation.select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("scope"),
        F.explode(F.array(F.lit("user"), F.lit("group"), F.lit("network"))).alias("kind"),
        F.when(F.col("n_nationkey") % 2 == 0, F.lit("MACHINERY")).otherwise(F.lit("NOTHERE")).alias("name"))
    return FL.audit_expected(expected, objects)


@query("e11_outputs_map", """
SELECT 'stack' || (o_custkey % 60) AS stack, o_orderpriority AS key, arg_max('v' || o_orderkey, o_orderkey) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2
""")
def e11(t):
    return FL.stack_outputs(_outputs(t))


def _outputs(t):
    status = F.when(F.col("o_orderstatus") == "F", F.lit("CREATE_COMPLETE")).otherwise(F.lit("ROLLBACK"))
    key = F.col("o_orderkey")
    return t.orders.select(
        F.concat(F.lit("stack"), (F.col("o_custkey") % 60).cast("string")).alias("stack"), key.alias("ord"), status.alias("status"),
        F.col("o_orderpriority").alias("key"), F.concat(F.lit("v"), key.cast("string")).alias("value"))


@query("e11_stack_parameter", """
SELECT 'stack' || (o_custkey % 60) AS stack, o_orderkey AS ord, 'v' || o_orderkey AS value FROM orders WHERE o_orderpriority = '2-HIGH'
""")
def e11_parameter(t):
    return FL.stack_parameter(_outputs(t), "2-HIGH")


@query("e12_latest_image", f"""
WITH {V.PARTS}, i AS (SELECT brand AS region, '1' || (psize % 9) || '.04' || CASE WHEN psize % 2 = 0 THEN ' LTS' ELSE '' END AS version, 'ami-' || k AS image_id
    FROM parts WHERE kind IN ('small', 'large', 'promo'))
SELECT region, version, image_id FROM i WHERE version LIKE '%LTS%' QUALIFY row_number() OVER (PARTITION BY region ORDER BY version DESC, image_id DESC) = 1
""")
def e12(t):
    lts = F.when(F.col("psize") % 2 == 0, F.lit(" LTS")).otherwise(F.lit(""))
    images = B.parts(t).select(
        P.zone_region(F.concat("brand", F.lit("ab"))).alias("region"),
        F.when(F.col("kind").isin("small", "large", "promo"), F.lit("hvm:ebs-ssd")).otherwise(F.lit("pv:ebs")).alias("instance_type"),
        F.concat(F.lit("1"), (F.col("psize") % 9).cast("string"), F.lit(".04"), lts).alias("version"),
        F.concat(F.lit('<a href="x">ami-'), F.col("k").cast("string"), F.lit("</a>")).alias("image"))
    return FL.latest_image(images)
