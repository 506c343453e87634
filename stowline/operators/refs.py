"""Assemble reference bundles and companion files from a catalog.

Bundles are long tables, one row per member: ``role`` is ``base``, ``index`` or ``plain``. A folder can
hold any number of members, so they are never gathered into one list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowline.functions import paths as P
from stowline.operators import skew
from stowline.operators.matching import prefix_join
from stowline.operators.resolve import find_all
from stowline.session import cut_lineage

# How bundle kinds are named in a record, and the file names that mark a base file.
RENAMED_KINDS = {
    "seq": "fasta",
    "ucsc": "twobit",
}
BASE_NAMES = ("mainIndex",)
TARBALL_END = "-wf.tar.gz"

BUNDLE = ["build", "aligner", "kind"]


def keyed(catalog: DataFrame) -> DataFrame:
    """``(ord, uri, key)``: ``key`` is what folders and names are compared with, and the uri itself if a catalog has no ``key``.

    Platforms with ids in their names bring it (``Platform.keyed``).
    """
    return catalog.select("ord", "uri", F.col("key" if "key" in catalog.columns else "uri").alias("key"))


def _bundle_rows(builds: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wanted (build, aligner, kind) rows and every catalog row that may belong to one, with its role."""
    builds = builds.withColumn("aligner", F.coalesce("aligner", F.lit("")))
    kinds = F.array_distinct(F.filter(F.array(F.lit("seq"), F.lit("rtg"), F.col("aligner")), lambda k: k != ""))
    wanted = builds.select("build", "aligner", "prefix", F.explode(kinds).alias("kind"))
    rows = keyed(catalog)
    tarballs = (
        prefix_join(rows.filter(F.col("key").endswith(TARBALL_END)), "key", wanted, "prefix")
        .filter(P.basename("key").startswith(F.col("kind")))
        .select(*BUNDLE, "ord", "uri", F.lit("tarball").alias("part"))
    )
    is_base = F.col("key").endswith(F.concat(F.lit("/"), F.col("build"), F.lit(".fa")))
    for name in BASE_NAMES:
        is_base = is_base | F.col("key").endswith("/" + name)
    files = prefix_join(
        rows, "key", wanted.withColumn("folder", P.join_path("prefix", "kind")), "folder"
    ).select(*BUNDLE, "ord", "uri", F.when(is_base, F.lit("base")).otherwise(F.lit("file")).alias("part"))
    return wanted.select(*BUNDLE), tarballs.unionByName(files)


def _status(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    count = lambda part: F.count_if(F.col("part") == part)
    counts = rows.groupBy(*BUNDLE).agg(
        count("tarball").alias("n_tar"), count("base").alias("n_base"),
        F.count_if(F.col("part") != "tarball").alias("n_files"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    full = wanted.join(counts, BUNDLE, "left").select(*BUNDLE, zero("n_tar"), zero("n_base"), zero("n_files"))
    form = (
        F.when(F.col("n_tar") > 1, F.lit("too many tarballs"))
        .when((F.col("n_tar") == 1) & (F.col("kind") == F.col("aligner")), F.lit("tarball base"))
        .when(F.col("n_tar") == 1, F.lit("tarball"))
        .when(F.col("n_base") > 1, F.lit("too many bases"))
        .when(F.col("n_base") == 1, F.lit("base"))
        .when(F.col("n_files") == 1, F.lit("single"))
        .otherwise(F.lit("indexes"))
    )
    key = F.col("kind")
    for kind, name in RENAMED_KINDS.items():
        key = F.when(F.col("kind") == kind, F.lit(name)).otherwise(key)
    return full.select(*BUNDLE, key.alias("key"), "n_tar", "n_base", "n_files", form.alias("form"))


def reference_status(builds: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per (build, kind): which form its bundle has; two forms name a violation."""
    return _status(*_bundle_rows(builds, catalog))


def reference_bundle(builds: DataFrame, catalog: DataFrame) -> DataFrame:
    """Members of the bundles of ``builds (build, aligner, prefix)``.

    A kind is packed as one tarball, or is a folder with one base file and its indexes, or a single
    file, or only indexes. Kinds in violation have no members; see :func:`reference_status`.
    """
    wanted, rows = _bundle_rows(builds, catalog)
    status = _status(wanted, rows).select(*BUNDLE, "key", "form")
    form, part = F.col("form"), F.col("part")
    roles = (
        F.when((form == "tarball base") & (part == "tarball"), F.array(F.lit("base"), F.lit("index")))
        .when((form == "tarball") & (part == "tarball"), F.array(F.lit("plain")))
        .when((form == "base") & (part == "base"), F.array(F.lit("base")))
        .when((form == "base") & (part == "file"), F.array(F.lit("index")))
        .when((form == "single") & (part != "tarball"), F.array(F.lit("plain")))
        .when((form == "indexes") & (part != "tarball"), F.array(F.lit("index")))
    )
    return skew.checked_join(rows, status, BUNDLE).select(*BUNDLE, "key", F.explode(roles).alias("role"), "ord", "uri")


def _parent(base_dir: str = "base_dir") -> Column:
    return P.dirname(base_dir)


def viral_bundle(builds: DataFrame, catalog: DataFrame) -> DataFrame:
    """Members under ``<parent>/viral``: the first ``.fa`` is the base, files of other kinds are indexes.

    ``builds`` is ``(build, base_dir)``. A folder without any ``.fa`` gives rows of role ``no base``.
    """
    keys = builds.select("build", P.normalize_remote(P.join_path(_parent(), F.lit("viral"))).alias("folder"))
    rows = prefix_join(keyed(catalog), "key", keys, "folder")
    is_fasta = F.col("uri").endswith(".fa")
    first = rows.groupBy("build").agg(F.min(F.when(is_fasta, F.col("ord"))).alias("_base"))
    role = (
        F.when(F.col("_base").isNull(), F.lit("no base"))
        .when(F.col("ord") == F.col("_base"), F.lit("base"))
        .when(~is_fasta, F.lit("index"))
    )
    return (
        skew.checked_join(rows, first, ["build"]).select("build", role.alias("role"), "ord", "uri").filter(F.col("role").isNotNull())
    )


def database_bundle(builds: DataFrame, catalog: DataFrame, tool: str = "snpeff",
                    base_name: str = "snpEffectPredictor.bin") -> DataFrame:
    """Annotation database of each build ``(build, base_dir, db)``.

    Exactly one ``<parent>/<tool>--<db>-wf.tar.gz`` wins; otherwise the files below
    ``<parent>/<tool>/<db>/`` with one base file. Any other number of base files gives rows of role
    ``bad base``.
    """
    tar = P.join_path(_parent(), F.concat(F.lit(f"{tool}--"), F.col("db"), F.lit(TARBALL_END)))
    folder = F.concat(
        P.normalize_remote(P.join_path(P.join_path(_parent(), F.lit(tool)), F.col("db"))), F.lit("/"))
    keys = builds.select("build", "db", P.normalize_remote(tar).alias("tar"), folder.alias("folder"))
    rows = keyed(catalog)
    tars = skew.checked_join(rows, keys.select("build", "db", F.col("tar").alias("key")), ["key"])
    one_tar = tars.groupBy("build", "db").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"),
                                              F.min("uri").alias("uri")).filter("n = 1")
    inside = skew.checked_join(prefix_join(rows, "key", keys, "folder"), one_tar.select("build", "db"), ["build", "db"], "left_anti")
    is_base = F.col("uri").endswith("/" + base_name)
    bases = inside.groupBy("build", "db").agg(F.count_if(is_base).alias("_n"))
    role = (
        F.when(F.col("_n") != 1, F.lit("bad base")).when(is_base, F.lit("base")).otherwise(F.lit("index"))
    )
    members = skew.checked_join(inside, bases, ["build", "db"]).select("build", "db", role.alias("role"), "ord", "uri")
    return members.unionByName(one_tar.select("build", "db", F.lit("plain").alias("role"), "ord", "uri"))


def context_files(builds: DataFrame, catalog: DataFrame) -> DataFrame:
    """``.gz`` files under ``<parent>/coverage/problem_regions``; ``(name, ord)`` is their order."""
    folder = P.normalize_remote(P.join_path(_parent(), F.lit("coverage/problem_regions")))
    keys = builds.select("build", folder.alias("folder"))
    packed = keyed(catalog).filter(F.col("key").endswith(".gz"))
    return prefix_join(packed, "key", keys, "folder").select("build", P.basename("uri").alias("name"), "ord", "uri")


def companion(builds: DataFrame, catalog: DataFrame, path: Column) -> DataFrame:
    """First catalog row equal to a path derived from each build; null when there is none."""
    keys = builds.select("build", path.alias("key"))
    hits = skew.checked_join(keyed(catalog), keys, ["key"])
    first = hits.groupBy("build").agg(F.min_by(F.struct("ord", "uri"), "ord").alias("_b"))
    return builds.select("build").join(first.select("build", "_b.*"), "build", "left")


def versions_path() -> Column:
    return P.normalize_remote(P.join_path(_parent(), F.lit("versions.csv")))


def gene_bed_path(transcripts: Column | str) -> Column:
    return F.concat(P.without_full_extension(transcripts), F.lit(".bed"))


def resource_file(fasta: Column | str) -> Column:
    """Name of the resource definition that belongs to a fasta file."""
    return F.concat(P.without_extension(fasta), F.lit("-resources.yaml"))


def resolve_relative(resources: DataFrame, catalog: DataFrame, lookup: Callable[[DataFrame], DataFrame] | bool = False) -> DataFrame:
    """Resolve ``../`` values of two-level resources ``(res_id, base_dir, k1, k2, value)``.

    The normalised path must be the key of a catalog row under the parent of ``base_dir``, and becomes that row's uri. ``lookup`` is
    tried first: the lookup of a platform, names → ``(name, ord, uri)``, or True for the one by equality, ending and
    glob. Values that cannot be resolved are dropped, other values pass unchanged.
    """
    relative = F.col("value").startswith("../")
    rest = resources.filter(~relative | F.col("value").isNull())
    asked = cut_lineage(resources.filter(relative).withColumns(
        {"_path": P.normalize_remote(P.join_path("base_dir", "value")), "_root": _parent()}))
    cols = resources.columns
    # One row is left per key before any resource comes in.
    first = keyed(catalog).groupBy(F.col("key").alias("_path")).agg(F.min_by("uri", "ord").alias("_uri"))
    if not lookup:
        return rest.unionByName(_below_root(asked, first).select(*cols))
    names = cut_lineage(asked.select(F.col("_path").alias("name")).distinct())
    find = lookup if callable(lookup) else lambda names: find_all(catalog.select("ord", "uri"), names)
    found = cut_lineage(find(names).select(F.col("name").alias("_path"), F.col("uri").alias("_uri")))
    hit = skew.checked_join(asked, found, ["_path"]).withColumn("value", F.col("_uri")).select(*cols)
    left = skew.checked_join(asked, found.select("_path").distinct(), ["_path"], "left_anti")
    return rest.unionByName(hit).unionByName(_below_root(left, first).select(*cols))


def _below_root(asked: DataFrame, first: DataFrame) -> DataFrame:
    """``asked`` with the uri of the file at its path as value, if the path is below the root."""
    return skew.checked_join(asked, first, ["_path"]).filter(F.col("_path").startswith(F.col("_root"))).withColumn("value", F.col("_uri"))


# Text in an uploaded jar's name, and the program it stands for; the first rule wins.
JAR_RULES = {
    "genomeanalysistk": "gatk",
    "mutect": "mutect",
}


def jar_resources(sheets: DataFrame, catalog: DataFrame) -> DataFrame:
    """Program jars uploaded next to a sample sheet: ``(sheet_id, program, uri)``.

    ``sheets`` is ``(sheet_id, uri)``. The bucket's ``jars`` folder is read first, the sheet's own folder
    second; a later file replaces an earlier one.
    """
    scheme = F.regexp_extract("uri", r"^([^/]*//[^/]*)", 1)
    folders = sheets.select(
        "sheet_id",
        F.posexplode(F.array(P.join_path(scheme, F.lit("jars")), P.join_path(P.dirname("uri"), F.lit("jars")))).alias(
            "level", "folder"),
    )
    program = F.lit(None).cast("string")
    for text, name in reversed(JAR_RULES.items()):
        program = F.when(F.lower("uri").contains(text), F.lit(name)).otherwise(program)
    jars = catalog.select("ord", "uri", program.alias("program")).filter(F.col("program").isNotNull())
    # One jar per folder and program is left before any sheet comes in.
    best = prefix_join(jars, "uri", folders.select("folder").distinct(), "folder").groupBy("folder", "program").agg(
        F.max_by(F.struct("ord", "uri"), "ord").alias("_last"))
    hits = skew.checked_join(folders, best, ["folder"])
    return hits.groupBy("sheet_id", "program").agg(F.max_by("_last.uri", F.struct("level", "_last.ord")).alias("uri"))
