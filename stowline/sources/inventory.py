"""Catalog tables: listings, folder trees, configured roots, unions and merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowline.functions import paths as P
from stowline.operators import skew
from stowline.session import cut_lineage


def parse_listing(lines: DataFrame, line: str = "value") -> DataFrame:
    """Recursive listing text → uris: blank lines and folder headings (``…/:``) are dropped."""
    text = F.col(line)
    return lines.filter((F.trim(text) != "") & ~text.endswith("/:")).withColumn("uri", F.trim(text)).drop(line)


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file under ``root`` with size and time; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select(
            F.regexp_replace("path", r"^file:/+", "/").alias("path"),
            F.col("length").alias("size"),
            F.col("modificationTime").alias("mtime"),
        )
    )


def spread(source: DataFrame) -> DataFrame:
    """Deal out a stored table that is read in fewer splits than there are cores.

    Opening records and fanning out names costs far more than reading them, so a single-file source would
    leave most cores idle. A large source already has more splits than cores and is returned unchanged.
    Only for plain scans: counting splits must not run a query.
    """
    cores = source.sparkSession.sparkContext.defaultParallelism
    return source.repartition(cores) if source.rdd.getNumPartitions() < cores else source


def ordered_listing(listing: DataFrame, order: str = "path") -> DataFrame:
    """Give a listing an explicit ``ord`` from a hash-free, repeatable order of its paths."""
    grouped = listing.withColumn("_all", F.lit(0))
    return skew.number_in_group(grouped, ["_all"], [order], "ord").drop("_all")


def expand_folders(nodes: DataFrame, root_id: Column | int | str) -> DataFrame:
    """``(id, parent, name, type)`` rows → full paths ``(id, path)`` of the files below ``root_id``.

    Only folders are walked, one join per level; the files, which are nearly all rows, are joined once
    at the end. Each level is checkpointed, so level k does not repeat the joins of the levels above. A folder that
    is its own ancestor is walked once.
    """
    root_id = root_id if isinstance(root_id, Column) else F.lit(root_id)
    folders = nodes.filter(F.col("type") == "folder").select("id", "parent", "name")
    level = nodes.sparkSession.range(1).select(root_id.alias("id"), F.lit("").alias("path"))
    level = level.select(F.col("id").cast(nodes.schema["id"].dataType), "path")
    found = level
    while True:
        step = skew.checked_join(
            folders.withColumnRenamed("id", "_id"), level.withColumnRenamed("id", "parent"), ["parent"]
        ).select(F.col("_id").alias("id"), P.join_path("path", "name").alias("path"))
        level = cut_lineage(step.join(found.select("id"), "id", "left_anti"))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    files = nodes.filter(F.col("type") != "folder").select(F.col("id").alias("_id"), "parent", "name")
    return skew.checked_join(files, found.withColumnRenamed("id", "parent"), ["parent"]).select(
        F.col("_id").alias("id"), P.join_path("path", "name").alias("path")
    )


def find_folder(nodes: DataFrame, root_id, path: str) -> DataFrame:
    """``(id)`` of the folder reached by walking ``path`` from ``root_id``; the first hit per level wins."""
    kind = nodes.schema["id"].dataType
    asked = nodes.sparkSession.range(1).select(F.lit(root_id).cast(kind).alias("root"), F.lit(path).alias("path"))
    return find_folders(nodes, asked).select("id")


def find_folders(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """The start folder of every row of ``asked (root, path)``: walked from ``root`` one component a level.

    The first hit of a level wins (the smallest id); rows that lead nowhere are left out. All rows take a level in one join, and
    each level is checkpointed.
    """
    steps = F.filter(F.split("path", "/"), lambda p: p != "")
    at = asked.select("root", "path", F.col("root").alias("_at"), steps.alias("_left"))
    first = nodes.groupBy("parent", "name").agg(F.min("id").alias("_id"))
    found = []
    while True:
        at = cut_lineage(at)
        found.append(at.filter(F.size("_left") == 0).select("root", "path", F.col("_at").alias("id")))
        going = at.filter(F.size("_left") > 0)
        if going.isEmpty():
            return reduce(DataFrame.unionByName, found)
        keyed = going.select("root", "path", F.col("_at").alias("parent"), F.element_at("_left", 1).alias("name"),
                             F.slice("_left", F.lit(2), F.size("_left")).alias("_left"))
        at = skew.checked_join(keyed, first, ["parent", "name"]).select("root", "path", F.col("_id").alias("_at"), "_left")


def catalog_roots(configs: DataFrame) -> DataFrame:
    """Configured listing roots in listing order: ``(cfg_id, rank, project, root)``.

    ``configs`` is ``(cfg_id, platform, ref, inputs array, folders array, project, ref_project, region)``.
    """
    pair = lambda project, root: F.struct(project.alias("project"), root.alias("root"))
    none = F.lit(None).cast("string")
    col = F.col
    as_roots = lambda arr: F.transform(arr, lambda r: pair(none, r))

    def s3_root(folder: Column) -> Column:
        bucket = F.substring_index(folder, "/", 1)
        rest = F.when(F.instr(folder, "/") > 0, F.substr(folder, F.instr(folder, "/") + 1)).otherwise(F.lit(""))
        with_region = F.concat(F.lit("s3://"), bucket, F.lit("@"), col("region"), F.lit("/"), rest)
        plain = col("region").isNull() | (col("region") == "") | bucket.startswith("s3:/")
        return F.when(plain, folder).otherwise(with_region)

    maybe_ref = F.when(col("ref").isNull(), F.array().cast("array<string>")).otherwise(F.array("ref"))
    gs = as_roots(F.concat(F.array("ref"), col("inputs")))
    s3 = F.transform(F.concat(col("folders"), col("inputs"), maybe_ref), lambda r: pair(none, s3_root(r)))
    keep = as_roots(F.array_sort(F.array_distinct(F.concat(maybe_ref, col("inputs")))))
    dx = F.concat(
        F.array(pair(F.coalesce(F.nullif(col("ref_project"), F.lit("")), col("project")), col("ref"))),
        F.transform(col("inputs"), lambda r: pair(col("project"), r)),
    )
    sbg_projects = F.filter(F.array("project", "ref"), lambda p: p.isNotNull() & (p != ""))
    sbg = F.flatten(F.transform(sbg_projects, lambda p: F.transform(col("inputs"), lambda r: pair(p, r))))
    roots = (
        F.when(col("platform") == "gs", gs).when(col("platform") == "s3", s3).when(col("platform") == "keep", keep)
        .when(col("platform") == "dx", dx).otherwise(sbg)
    )
    return configs.select("cfg_id", "platform", F.posexplode(roots).alias("rank", "_r")).select(
        "cfg_id", "platform", "rank", F.col("_r.project").alias("project"), F.col("_r.root").alias("root")
    )


def union_catalogs(listings: DataFrame, roots: DataFrame) -> DataFrame:
    """Listings of several roots as one catalog; repeats stay, order is (root rank, listing order).

    ``listings`` is ``(root, ord, uri)`` and ``roots`` is ``(root, rank)``; a root configured twice is
    listed twice.
    """
    return skew.checked_join(listings, roots.select("root", "rank"), ["root"]).select("rank", "ord", "uri")


def keyed_last_wins(listing: DataFrame, key: str = "path") -> DataFrame:
    """One row per key: the values listed last, at the place where the key was listed first."""
    rest = [c for c in listing.columns if c not in (key, "ord")]
    last = F.max_by(F.struct("ord", *rest), "ord").alias("_r")
    return listing.groupBy(key).agg(F.min("ord").alias("ord"), last).select(key, "ord", *[F.col(f"_r.{c}").alias(c) for c in rest])


def write_catalog(catalog: DataFrame, path: str, key: str = "uri", mode: str = "overwrite") -> None:
    """Store a catalog in the order of its names: a file holds a narrow range, which its statistics tell a prefix scan."""
    catalog.repartitionByRange(key).sortWithinPartitions(key).write.mode(mode).parquet(path)


def under_prefix(catalog: DataFrame, prefix: str, key: str = "uri") -> DataFrame:
    """Catalog rows whose key starts with ``prefix``; pushed down to the scan of a stored catalog."""
    return catalog.filter(F.col(key).startswith(prefix))


def under_prefixes(catalog: DataFrame, prefixes: DataFrame, key: str = "uri") -> DataFrame:
    """Table form of :func:`under_prefix`: ``(prefix, …catalog)``, one row per hit."""
    from stowline.operators.matching import prefix_join

    return prefix_join(catalog, key, prefixes.select("prefix").distinct(), "prefix")


def under_object_prefix(objects: DataFrame, prefixes: DataFrame, platform: str) -> DataFrame:
    """Prefix listing for id-based platforms: prefix and path are compared without their ids.

    ``objects`` is ``(ord, project, file_id, path)``. On ``dx`` the compared text is ``project:path``.
    """
    from stowline.operators.matching import prefix_join

    if platform == "dx":
        text = F.concat(F.col("project"), F.lit(":"), F.col("path"))
    else:
        text = F.col("path")
    wanted = prefixes.select("prefix", P.object_path("prefix", F.lit(platform)).alias("_want")).distinct()
    uri = F.concat(F.lit(platform + ":"), F.col("file_id"), F.lit("/"), F.col("_text"))
    return prefix_join(objects.withColumn("_text", text), "_text", wanted, "_want").select(
        "prefix", "ord", uri.alias("uri"))
