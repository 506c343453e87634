"""Plan transfers: where folders go, what must be shipped or copied, and how names change on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowline.functions import paths as P
from stowline.operators import skew

# Record keys whose files are reference data.
REFERENCE_KEYS = ("reference", "genome_resources", "sam_ref")


def required(leaves: DataFrame, filters: DataFrame | list[list[str]] | None, ctx: str = "ctx") -> DataFrame:
    """Leaves whose context starts with one of the ``filters``; no filters keep everything.

    ``filters`` is a list of key lists, or a table ``(keys array<string>)`` that is probed once per
    distinct length.
    """
    if filters is None:
        return leaves
    if isinstance(filters, list):
        if not filters:
            return leaves
        hit = F.lit(False)
        for keys in filters:
            hit = hit | (F.slice(ctx, F.lit(1), F.lit(len(keys))) == F.array(*[F.lit(k) for k in keys]))
        return leaves.filter(hit)
    lengths = sorted(r for r in filters.agg(F.collect_set(F.size("keys")).alias("n")).first()["n"])
    if not lengths:
        return leaves
    out, flags = leaves, []
    for n in lengths:
        keys = filters.filter(F.size("keys") == n).select(F.col("keys").alias("_keys")).distinct()
        keyed = out.withColumn("_keys", F.slice(ctx, F.lit(1), F.lit(n)))
        out = skew.checked_join(keyed, keys.withColumn(f"_f{n}", F.lit(True)), ["_keys"], "left").drop("_keys")
        flags.append(f"_f{n}")
    return out.filter(F.coalesce(*flags)).drop(*flags)


def destinations(folders: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Destination of every folder of a record.

    ``folders`` is distinct ``(rec_id, dir, work_dir, data_dir, run_bucket, data_bucket)``. Folders under
    the work or data folder keep their relative place; the others are numbered per record in sorted order.
    """
    under = lambda base: F.coalesce((F.col(base) != "") & F.col("dir").startswith(F.col(base)), F.lit(False))
    kind = F.when(under("work_dir"), F.lit("run")).when(under("data_dir"), F.lit("data")).otherwise(F.lit("external"))
    marked = folders.withColumn("_kind", kind)
    relative = F.replace("dir", F.when(F.col("_kind") == "run", F.col("work_dir")).otherwise(F.col("data_dir")), F.lit(""))
    known = marked.filter("_kind != 'external'").select(
        "rec_id", "dir", F.when(F.col("_kind") == "run", F.col("run_bucket")).otherwise(F.col("data_bucket")).alias("bucket"),
        F.regexp_replace(relative, "^/", "").alias("folder"))
    outside = skew.number_in_group(
        marked.filter("_kind = 'external'").select("rec_id", "dir", "run_bucket"), ["rec_id"], ["dir"], "_n", group_rows)
    return known.unionByName(outside.select(
        "rec_id", "dir", F.col("run_bucket").alias("bucket"),
        F.concat(F.lit("externalmap/"), F.col("_n").cast("string")).alias("folder")))


def external_ids(files: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Number the outside folders of each record in the order they are met.

    ``files`` is ``(rec_id, ctx, pos, value, work_dir)``. A folder counts only when none of its parent
    folders was met before it; ``algorithm`` settings are not looked at. Ids start at 1.
    """
    seen = (
        files.filter((F.size("ctx") > 0) & (F.get("ctx", F.lit(0)) != "algorithm"))
        .filter(~(F.col("value").startswith(F.concat("work_dir", F.lit("/"))) | (F.col("value") == F.col("work_dir"))))
        .select("rec_id", P.normalize(P.dirname("value")).alias("dir"), "pos")
        .groupBy("rec_id", "dir").agg(F.min("pos").alias("first"))
    )
    parts = F.split("dir", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda d: F.array_join(F.slice(parts, F.lit(1), d), "/"))
    parents = F.filter(above, lambda p: (p != "") & (p != F.col("dir")))
    covered = (
        seen.select("rec_id", "dir", "first", F.explode(parents).alias("_up"))
        .join(seen.select("rec_id", F.col("dir").alias("_up"), F.col("first").alias("_before")), ["rec_id", "_up"])
        .filter(F.col("_before") < F.col("first")).select("rec_id", "dir").distinct()
    )
    taken = seen.join(covered, ["rec_id", "dir"], "left_anti")
    numbered = skew.number_in_group(taken, ["rec_id"], ["first", "dir"], "_n", group_rows)
    return numbered.select("rec_id", "dir", (F.col("_n") + 1).alias("ext_id"))


def with_companions(files: DataFrame, path: str = "path") -> DataFrame:
    """Each file and the index files that may travel with it: adds ``suffix`` and ``member``."""
    suffixes = F.explode(F.array(*[F.lit(s) for s in P.COMPANION_SUFFIXES])).alias("suffix")
    return files.select("*", suffixes).withColumn("member", F.concat(path, F.col("suffix")))


def ship_missing(files: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Files to send: ``files (path, bucket, folder)`` and their indexes that exist in ``source (path)``
    and whose key is absent from ``target (bucket, key)``."""
    members = with_companions(files.select("path", "bucket", "folder").distinct())
    local = source.select(F.col("path").alias("member")).distinct()
    present = members.join(local, "member", "left_semi")
    keyed = present.select("member", "bucket", P.object_key("folder", "member").alias("key")).distinct()
    return keyed.join(target.select("bucket", "key"), ["bucket", "key"], "left_anti")


def shipped_uri(files: DataFrame) -> DataFrame:
    """The name every file has after shipping, sent or not."""
    return files.select("path", P.object_uri("bucket", "folder", "path").alias("uri")).distinct()


def copy_missing(files: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Copies to make: ``files (path, new_path)`` and their indexes that ``source`` has and ``target`` lacks."""
    members = with_companions(files.select("path", "new_path").distinct())
    local = source.select(F.col("path").alias("member")).distinct()
    pairs = members.join(local, "member", "left_semi").select(
        "member", F.concat("new_path", "suffix").alias("copy")).distinct()
    return pairs.join(target.select(F.col("path").alias("copy")), "copy", "left_anti")


def localize(leaves: DataFrame, bucket: str, local_dir: str, ctx: str = "ctx", value: str = "value") -> DataFrame:
    """Swap ``s3://bucket`` in values for a local folder; reference files go to its ``genomes`` folder."""
    remote = f"s3://{bucket}"
    is_reference = F.coalesce(F.get(ctx, F.lit(0)).isin(*REFERENCE_KEYS), F.lit(False))
    root = F.when(is_reference, F.lit(f"{local_dir}/genomes")).otherwise(F.lit(local_dir))
    new = F.when(F.col(value).startswith(remote), F.replace(F.col(value), F.lit(remote), root)).otherwise(F.col(value))
    return leaves.withColumn(value, new)


def existing_only(files: DataFrame, listing: DataFrame, path: str = "value") -> DataFrame:
    return files.join(listing.select(F.col("path").alias(path)).distinct(), path, "left_semi")

