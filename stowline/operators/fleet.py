"""Fleet snapshots (instances, networks, stacks, images) and resource specifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowline.operators import skew

# Cores and megabytes per core of each machine type.
CAPACITY = {
    "m3.large": (2, 3500),
    "m3.xlarge": (4, 3500),
    "m3.2xlarge": (8, 3500),
    "c3.large": (2, 1750),
    "c3.xlarge": (4, 1750),
    "c3.2xlarge": (8, 1750),
    "c3.4xlarge": (16, 1750),
    "c3.8xlarge": (32, 1750),
    "c4.large": (2, 1750),
    "c4.xlarge": (4, 1750),
    "c4.2xlarge": (8, 1750),
    "c4.4xlarge": (16, 1750),
    "c4.8xlarge": (36, 1600),
    "r3.large": (2, 7000),
    "r3.xlarge": (4, 7000),
    "r3.2xlarge": (8, 7000),
    "r3.4xlarge": (16, 7000),
    "r3.8xlarge": (32, 7000),
    "t2.nano": (1, 500),
    "t2.micro": (1, 1000),
    "t2.small": (1, 2000),
    "t2.medium": (2, 2000),
    "t2.large": (2, 4000),
    "m4.large": (2, 4000),
    "m4.xlarge": (4, 4000),
    "m4.2xlarge": (8, 4000),
    "m4.4xlarge": (16, 4000),
    "m4.10xlarge": (40, 4000),
}

# Folders that make up the sequence target of a genome build.
SEQUENCE_FOLDERS = (
    "coverage", "editing", "prioritization", "rnaseq", "seq", "snpeff", "srnaseq", "validation", "variation", "vep",
)

# How storage server names start, and the role group they form.
STORAGE_ROLES = {
    "mgt": "mgs",
    "mdt": "mds",
    "ost": "oss",
}

# States of instances that count no more, the name of the address translator, and what a usable image is.
GONE_STATES = ("terminated", "shutting-down")
TRANSLATOR = "NATDevice"
IMAGE_TYPE = "hvm:ebs-ssd"
IMAGE_RELEASE = "LTS"


def target_folders(folders: DataFrame, targets: DataFrame) -> DataFrame:
    """Folders ``(build, name)`` that belong to a ``target``: ``seq`` stands for a fixed list."""
    members = F.when(F.col("target") == "seq", F.array(*[F.lit(n) for n in SEQUENCE_FOLDERS])).otherwise(F.array("target"))
    wanted = targets.select("target").distinct().select("target", F.explode(members).alias("name"))
    return skew.checked_join(folders, wanted, ["name"]).select(
        "build", "target", "name", F.concat("build", F.lit("/"), "name").alias("path"))


def reachable_address(public: Column | str, private: Column | str) -> Column:
    public, private = (F.col(c) if isinstance(c, str) else c for c in (public, private))
    return F.coalesce(F.nullif(public, F.lit("")), private)


def network_instances(instances: DataFrame, networks: DataFrame, network_name: Column | str) -> DataFrame:
    """Instances in the networks of a given name, with the address to reach them at."""
    wanted = networks.filter(F.col("network_name") == network_name).select("network_id", "network_name")
    return skew.checked_join(instances, wanted, ["network_id"]).select(
        "ord", "network_name", F.coalesce("name", F.lit("(none)")).alias("name"), "instance_type", "state",
        reachable_address("public_ip", "private_ip").alias("address"), "zone")


def address_stack(addresses: DataFrame, instances: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Stack of the instance that owns an address: ``(address, ord, stack)``.

    Instances are tried in order; an instance's own address comes before those of its interfaces
    ``(ord, iface, address)``.
    """
    own = instances.select("ord", F.lit(-1).alias("iface"), F.col("private_ip").alias("address"), "stack")
    extra = interfaces.select("ord", "iface", "address").join(instances.select("ord", "stack"), "ord")
    every = own.unionByName(extra.select("ord", "iface", "address", "stack"))
    hits = skew.checked_join(every, addresses.select("address").distinct(), ["address"])
    return hits.groupBy("address").agg(F.min_by(F.struct("ord", "stack"), F.struct("ord", "iface")).alias("_b")).select(
        "address", "_b.*")


def management_address(instances: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Management address of each stack: the first ``mgt…`` instance's interface of role ``mgt``, else its own."""
    first = (
        instances.filter(F.col("name").startswith("mgt")).groupBy("stack")
        .agg(F.min_by(F.struct("ord", "private_ip"), "ord").alias("_i")).select("stack", "_i.*")
    )
    tagged = interfaces.filter(F.col("role") == "mgt").groupBy("ord").agg(F.min_by("address", "iface").alias("_tagged"))
    return first.join(tagged, "ord", "left").select("stack", F.coalesce("_tagged", "private_ip").alias("address"))


def usable_cores(cores: Column | str, jobs: Column | str) -> Column:
    """Cores left for work after the room that large machines give up."""
    cores, jobs = (F.col(c) if isinstance(c, str) else c for c in (cores, jobs))
    return F.when(cores > 30, cores - 2).when((cores > 15) & (jobs < 10), cores - 1).otherwise(cores)


def capacity_table(spark) -> DataFrame:
    schema = T.StructType([T.StructField("machine", T.StringType()), T.StructField("all_cores", T.LongType()),
                           T.StructField("core_mb", T.LongType())])
    return spark.createDataFrame([(m, c, mb) for m, (c, mb) in CAPACITY.items()], schema)


def cluster_capacity(clusters: DataFrame) -> DataFrame:
    """Usable cores and memory per core of ``clusters (cluster_id, compute_nodes, compute_flavor,
    frontend_flavor)``. Unknown machine types get nulls and ``known = false``."""
    machine = F.when(F.col("compute_nodes") > 0, F.col("compute_flavor")).otherwise(F.col("frontend_flavor"))
    # The capacity table is the fixed one above, so its broadcast does not grow.
    joined = clusters.withColumn("machine", machine).join(F.broadcast(capacity_table(clusters.sparkSession)), "machine", "left")
    return joined.select("cluster_id", "machine", usable_cores("all_cores", "compute_nodes").alias("cores"), "core_mb",
                         F.col("all_cores").isNotNull().alias("known"))


# -- resource specifications ---------------------------------------------------------------------------

def _memory_text() -> Column:
    return F.when(F.col("key") == "memory", F.col("values")[0]).when(
        F.col("key") == "jvm_opts", F.replace(F.get("values", F.lit(1)), F.lit("-Xmx"), F.lit("")))


def memory_mb(text: Column) -> Column:
    """``3G`` → 3000, ``750m`` → 750; any other unit fails."""
    size, unit = F.substr(text, F.lit(1), F.length(text) - 1).cast("long"), F.lower(F.right(text, F.lit(1)))
    return F.when(unit == "g", size * 1000).when(unit == "m", size).when(
        text.isNotNull(), F.raise_error(F.concat(F.lit("unknown memory unit: "), text)).cast("long"))


def common_memory(specs: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Median memory in MB per site over ``specs (site, program, key, values array<string>)``."""
    sized = specs.filter(F.col("key").isin("memory", "jvm_opts")).withColumn("mb", memory_mb(_memory_text()))
    return skew.exact_quantiles(sized, ["site"], "mb", {"common_mb": 0.5}, group_rows)


def rescale_specs(specs: DataFrame, target_cores: int, target_mb: int) -> DataFrame:
    """Set cores and memory of every program to the targets.

    Memory at or above 1.5 × the site's common value stays. The unit letter follows the old one (a
    gigabyte letter becomes the megabyte letter of the same case); of JVM options the last one is replaced.
    """
    common = common_memory(specs)
    joined = skew.checked_join(specs, common, ["site"], "left")
    text = _memory_text()
    unit = F.right(text, F.lit(1))
    new = F.concat(F.lit(str(target_mb)), F.when(unit == "G", F.lit("M")).when(unit == "g", F.lit("m")).otherwise(unit))
    keep = memory_mb(text) >= F.col("common_mb") * 1.5
    values = F.col("values")
    jvm = F.concat(F.slice(values, F.lit(1), F.size(values) - 1), F.array(F.concat(F.lit("-Xmx"), new)))
    changed = (
        F.when(F.col("key") == "cores", F.array(F.lit(str(target_cores))))
        .when(~F.col("key").isin("memory", "jvm_opts") | keep, values)
        .when(F.col("key") == "memory", F.array(new)).otherwise(jvm)
    )
    return joined.select("site", "program", "key", changed.alias("values"))


# -- stacks --------------------------------------------------------------------------------------------

def stack_members(instances: DataFrame) -> DataFrame:
    """Address of every member of a stack; of equal names the last instance counts, gone ones never do."""
    address = F.when(F.col("name") == TRANSLATOR, F.col("public_ip")).otherwise(F.col("private_ip"))
    alive = instances.filter(~F.col("state").isin(*GONE_STATES))
    return alive.groupBy("stack", "name").agg(F.max_by(address, "ord").alias("address"))


def role_members(members: DataFrame) -> DataFrame:
    """Members of the storage roles: ``(stack, role, name, address)``."""
    role = F.lit(None).cast("string")
    for start, name in STORAGE_ROLES.items():
        role = F.when(F.col("name").startswith(start), F.lit(name)).otherwise(role)
    return members.select("stack", role.alias("role"), "name", "address").filter(F.col("role").isNotNull())


def inventory_roles(lines: DataFrame) -> DataFrame:
    """Host inventory ``(cluster_id, ord, line)`` → its server (the last ``frontend`` line) and all clients."""
    host = F.element_at(F.split(F.trim("line"), r"\s+"), 1)
    front = lines.filter(F.col("line").startswith("frontend")).groupBy("cluster_id").agg(
        F.max_by(F.struct("ord", host.alias("host")), "ord").alias("_b")).select("cluster_id", F.lit("server").alias("role"), "_b.*")
    clients = lines.filter(F.col("line").startswith("compute")).select(
        "cluster_id", F.lit("client").alias("role"), "ord", host.alias("host"))
    return front.unionByName(clients)


def failed_events(events: DataFrame) -> DataFrame:
    """Failed stack events ``(stack, ord, resource, status, reason)`` as ``resource: reason`` rows."""
    return events.filter(F.col("status").endswith("_FAILED")).select(
        "stack", "ord", F.concat("resource", F.lit(": "), "reason").alias("failure"))


def host_status(hosts: DataFrame) -> DataFrame:
    """Overall outcome per run of ``hosts (run_id, host, unreachable, failures)``."""
    down, bad = F.col("unreachable") > 0, F.col("failures") > 0
    return hosts.groupBy("run_id").agg(
        F.count_if(down).alias("n_unreachable"), F.count_if(bad).alias("n_failing"),
        F.coalesce(F.sum("failures"), F.lit(0)).alias("n_failures"), F.bool_or(down | bad).alias("failed"))


def failing_hosts(hosts: DataFrame) -> DataFrame:
    """The hosts behind :func:`host_status`, one row per problem."""
    bad = F.concat("host", F.lit(" ("), F.col("failures").cast("string"), F.lit(" failures)"))
    problems = F.filter(F.array(
        F.when(F.col("unreachable") > 0, F.struct(F.lit("unreachable").alias("kind"), F.col("host").alias("text"))),
        F.when(F.col("failures") > 0, F.struct(F.lit("failures").alias("kind"), bad.alias("text")))), lambda p: p.isNotNull())
    return hosts.select("run_id", F.explode(problems).alias("p")).select("run_id", "p.kind", "p.text")


def audit_expected(expected: DataFrame, objects: DataFrame) -> DataFrame:
    """State of each expected object ``(scope, kind, name)``: ``none exist``, ``ok`` or ``missing``."""
    asked = expected.select("scope", "kind", F.col("name").alias("expected"))
    counts = objects.groupBy("scope", "kind").agg(F.count(F.lit(1)).alias("n"))
    hits = objects.select("scope", "kind", F.col("name").alias("expected")).distinct().withColumn("_hit", F.lit(True))
    joined = skew.checked_join(asked, counts, ["scope", "kind"], "left")
    joined = skew.checked_join(joined, hits, ["scope", "kind", "expected"], "left")
    state = F.when(F.coalesce("n", F.lit(0)) == 0, F.lit("none exist")).when(F.col("_hit"), F.lit("ok")).otherwise(F.lit("missing"))
    return joined.select("scope", "kind", "expected", state.alias("state"))


def stack_outputs(outputs: DataFrame) -> DataFrame:
    """Outputs ``(stack, ord, status, key, value)`` of completed stacks; the last value of a key counts."""
    done = outputs.filter(F.col("status") == "CREATE_COMPLETE")
    return done.groupBy("stack", "key").agg(F.max_by("value", "ord").alias("value"))


def stack_parameter(parameters: DataFrame, key: str) -> DataFrame:
    return parameters.filter(F.col("key") == key).select("stack", "ord", "value")


def latest_image(images: DataFrame) -> DataFrame:
    """Newest long-term-support image per region: highest version, then highest id."""
    image = F.regexp_extract("image", r"^[^>]*>([^<>]*)", 1)
    usable = images.filter((F.col("instance_type") == IMAGE_TYPE) & F.col("version").contains(IMAGE_RELEASE))
    best = F.max(F.struct(F.col("version"), image.alias("image_id")))
    return usable.groupBy("region").agg(best.alias("_b")).select("region", "_b.*")
