"""Resolve requested names against object catalogs.

Tables:

* catalog  ``(ord, uri, …)``: ``ord`` is the listing order that settles every tie;
* objects  ``(ord, container, path, …)``: a catalog whose names split into an id and a path;
* names    ``(req_id, pos, name)``: one row per requested name.

Matches come back as one row per match with ``ord``, not as a list per name: a popular name can match a
large part of a catalog, and no task should hold such a list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowline.functions import paths as P
from stowline.operators import skew
from stowline.operators.matching import name_join, prefix_join, suffix_join
from stowline.session import cut_lineage


def split_requests(requests: DataFrame, key: str = "names", sep: str | None = ";") -> DataFrame:
    """Requests ``(req_id, names)`` → ``(req_id, pos, name)``; names is an array or a joined string."""
    is_array = requests.schema[key].dataType.typeName() == "array"
    names = F.col(key) if is_array else (F.array(key) if sep is None else F.split(key, rf"\Q{sep}\E"))
    return requests.select("req_id", F.posexplode(names).alias("pos", "name"))


def find_all(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """Every catalog row that equals a name, ends with ``/name`` or matches it as a glob.

    Returns distinct names with all their rows; equal URIs listed twice stay twice.
    """
    return name_join(catalog, "uri", names.select("name").distinct()).select("name", *catalog.columns)


def resolve(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """``find_all`` per requested name: ``(req_id, pos, name, ord, uri, …)``; misses give no row."""
    return skew.checked_join(find_all(catalog, names), names, ["name"])


def match_counts(names: DataFrame, matches: DataFrame) -> DataFrame:
    """Number of matches per distinct name, 0 for a miss."""
    counts = matches.groupBy("name").agg(F.count(F.lit(1)).alias("n_matches"))
    return skew.checked_join(names.select("name").distinct(), cut_lineage(counts), ["name"], "left").select(
        "name", F.coalesce("n_matches", F.lit(0)).alias("n_matches"))


def find_with_prefix(catalog: DataFrame, names: DataFrame, prefix: Column | str) -> DataFrame:
    """``find_all`` with a folder prefix.

    A row under ``prefix/name`` discards what was found before it and stands for the folder itself;
    ordinary matches after the last such row are added to it.
    """
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    targets = names.select("name", P.join_path(prefix, F.col("name")).alias("target")).distinct()
    last = (
        prefix_join(catalog.select("ord", "uri"), "uri", targets, "target")
        .groupBy("name", "target")
        .agg(F.max("ord").alias("ord"))
    )
    later = (
        skew.checked_join(find_all(catalog.select("ord", "uri"), names), last.select("name", F.col("ord").alias("_last")), ["name"], "left")
        .filter(F.col("_last").isNull() | (F.col("ord") > F.col("_last")))
        .select("name", "ord", "uri")
    )
    return later.unionByName(last.select("name", "ord", F.col("target").alias("uri")))


def _first(hits: DataFrame, by: list[str], order: list[str], keep: list[str]) -> DataFrame:
    best = F.min_by(F.struct(*keep), F.struct(*order)).alias("_best")
    return hits.groupBy(*by).agg(best).select(*by, "_best.*")


def find_first_tiers(objects: DataFrame, names: DataFrame, scheme: str = "keep", folders: bool = False) -> DataFrame:
    """First hit per name: whole path first, then a path ending in ``/name``.

    With ``folders`` a name is a folder: a path starting with it gives the container plus the name, and
    the second tier compares parent folders.
    """
    wanted = names.select("name").distinct()
    base = objects.select("ord", "container", "path")

    def render(container: str, path: str) -> Column:
        return F.concat(F.lit(scheme + ":"), F.col(container), F.lit("/"), F.col(path))

    if not folders:
        hits = suffix_join(base, "path", wanted).select(
            "name", F.when(F.col("path") == F.col("name"), 1).otherwise(2).alias("tier"), "ord",
            render("container", "path").alias("uri"),
        )
    else:
        inside = prefix_join(base, "path", wanted, "name").select(
            "name", F.lit(1).alias("tier"), "ord", render("container", "name").alias("uri")
        )
        parents = base.groupBy("container", P.dirname("path").alias("dir")).agg(F.min("ord").alias("ord"))
        below = (
            suffix_join(parents, "dir", wanted)
            .filter(F.col("dir") != F.col("name"))
            .select("name", F.lit(2).alias("tier"), "ord", render("container", "dir").alias("uri"))
        )
        hits = inside.unionByName(below)
    return _first(hits, ["name"], ["tier", "ord"], ["tier", "ord", "uri"])


def find_first(objects: DataFrame, names: DataFrame, scheme: str = "sbg", folders: bool = False) -> DataFrame:
    """First object whose path equals the name, or starts with it when ``folders`` is set.

    ``objects`` carries ``file_id``; a name that already has the scheme is cut down to its path.
    """
    platform = F.lit(scheme)
    path = F.when(P.is_remote("name", platform), P.object_path("name", platform)).otherwise(F.col("name"))
    wanted = names.select("name", path.alias("_want")).distinct()
    base = objects.select("ord", "file_id", "path")
    if folders:
        hits = prefix_join(base, "path", wanted, "_want")
    else:
        hits = skew.checked_join(base.withColumn("_want", F.col("path")), wanted, ["_want"])
    uri = F.concat(F.lit(scheme + ":"), F.col("file_id"), F.lit("/"), F.col("_want"))
    return _first(hits.withColumn("uri", uri), ["name"], ["ord"], ["ord", "uri"])


def folder_catalog(keyed: DataFrame) -> DataFrame:
    """Collapse a keyed catalog ``(ord, project, file_id, path)`` to its folders, last listing wins."""
    return (
        keyed.groupBy(P.dirname("path").alias("path"))
        .agg(F.max("ord").alias("_last"), F.min("ord").alias("ord"), F.max_by("project", "ord").alias("project"))
        .select("ord", "project", F.lit("None").alias("file_id"), "path")
    )


def _above(path: str) -> Column:
    """All folders of a path: the text before each of its slashes."""
    parts = F.split(path, "/")
    joined = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda d: F.array_join(F.slice(parts, F.lit(1), d), "/"))
    return F.when(F.size(parts) > 1, joined).otherwise(F.array().cast("array<string>"))


def find_in_folders(keyed: DataFrame, requests: DataFrame, scheme: str = "dx") -> DataFrame:
    """Folder-ordered lookup.

    ``requests`` is ``(req_id, name, folders array<struct<rank, project, folder>>)`` and ``keyed`` is
    ``(ord, project, file_id, path)`` with one row per path. Tier 1 takes the first configured folder
    (of the asked project, if the name says ``project:name``) that holds ``folder/name``. Without one,
    tier 2 returns all rows below any folder that end with ``/name`` or match it as a glob. It looks at nothing
    else: rows are cut to those below a folder that is still asked for, and the folder is part of the join key.
    """
    platform = F.lit(scheme)
    bare = F.when(P.is_remote("name", platform), P.object_path("name", platform)).otherwise(F.col("name"))
    colon = F.instr(bare, ":")
    asked = requests.select(
        "req_id", "name", "folders",
        F.when(colon > 1, F.substring_index(bare, ":", 1)).alias("_project"),
        F.when(colon > 1, F.substr(bare, colon + 1)).otherwise(bare).alias("_want"),
    )
    base = keyed.select("ord", "project", "file_id", "path")
    exact = (
        asked.withColumn("_f", F.explode("folders"))
        .filter(F.col("_project").isNull() | (F.col("_project") == F.col("_f.project")))
        .select("req_id", "name", F.col("_f.rank").alias("rank"),
                P.join_path(F.col("_f.folder"), F.col("_want")).alias("path"))
    )
    tier1 = _first(
        skew.checked_join(base, exact, ["path"]).withColumn("tier", F.lit(1)),
        ["req_id", "name"], ["rank", "ord"], ["tier", "rank", "ord", "project", "file_id", "path"])
    # Only what tier 1 left over goes on, and only rows below one of its folders.
    tier1 = cut_lineage(tier1)
    left = cut_lineage(skew.checked_join(asked, tier1.select("req_id", "name"), ["req_id", "name"], "left_anti").select(
        "req_id", "name", "_want", F.explode("folders").alias("_f")).select("req_id", "name", "_want", F.col("_f.rank").alias("rank"), F.col("_f.folder").alias("_folder")))
    folders = left.select("_folder").distinct()
    under = skew.checked_join(base.withColumn("_folder", F.explode(_above("path"))), folders, ["_folder"], "left_semi")
    below = under.groupBy("ord", "project", "file_id", "path").agg(F.collect_set("_folder").alias("_folders"))
    loose = find_all(below.withColumn("uri", F.col("path")), left.select(F.col("_want").alias("name")))
    opened = loose.filter(F.col("path") != F.col("name")).withColumnRenamed("name", "_want").withColumn("_folder", F.explode("_folders"))
    tier2 = skew.checked_join(opened, left, ["_want", "_folder"]).select(
        "req_id", "name", F.lit(2).alias("tier"), "rank", "ord", "project", "file_id", "path")
    uri = F.concat(F.lit(scheme + ":"), F.col("file_id"), F.lit("/"), F.col("project"), F.lit(":"), F.col("path"))
    return tier1.unionByName(tier2).select("req_id", "name", "tier", "rank", "ord", uri.alias("uri"))


def with_folders(listing: DataFrame, path: str = "path") -> DataFrame:
    """All existing paths of a file listing: the files and every folder above them."""
    parts = F.split(path, "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda d: F.array_join(F.slice(parts, F.lit(1), d), "/")
    )
    folders = listing.filter(F.size(parts) > 1).select(F.explode(above).alias("path"))
    return listing.select(F.col(path).alias("path")).unionByName(folders).filter("path != ''").distinct()


def first_existing(listing: DataFrame, asked: DataFrame) -> DataFrame:
    """First base folder, in order, under which the name exists.

    ``asked`` is ``(…, name, bases array<string>)``; ``listing`` is ``(path)`` of existing paths.
    Returns the asked rows that were found with ``pos`` and ``path``.
    """
    keys = [c for c in asked.columns if c != "bases"]
    tried = asked.select(*keys, F.posexplode("bases").alias("pos", "_base")).select(
        *keys, "pos", P.normalize(P.join_path("_base", "name")).alias("path")
    )
    hits = skew.checked_join(listing.select("path"), tried, ["path"])
    return _first(hits, keys, ["pos"], ["pos", "path"])


_WILD = r"[*?\[]"


def _child(parent: Column, name: Column) -> Column:
    return F.when(parent.isin("", "/"), F.concat(parent, name)).otherwise(F.concat(parent, F.lit("/"), name))


def folder_tree(listing: DataFrame) -> DataFrame:
    """``(parent, name)`` of every folder above a file; the parent of a first component is ``/`` or nothing."""
    folder = F.col("_folder")
    parent = F.when(folder.rlike("^/[^/]*$"), F.lit("/")).otherwise(P.dirname(folder))
    return listing.select(F.explode(_above("path")).alias("_folder")).filter("_folder != ''").distinct().select(
        parent.alias("parent"), P.basename("_folder").alias("name"))


def walk_folders(tree: DataFrame, asked: DataFrame, folder: str = "_folder") -> DataFrame:
    """``asked`` with each folder pattern replaced by the folders that it names; one row per folder found.

    Components are matched one by one: the literal ones before the first wildcard at once, then one join per component with
    the children of the folders found so far, so that no pattern meets a folder it has not reached. Wildcards
    stay within a component, and a leading one does not reach hidden folders. ``tree`` is ``(parent, name)``.
    """
    keys = [c for c in asked.columns if c != folder]
    parts = F.filter(F.split(P.normalize(folder), "/"), lambda p: p != "")
    # How many components come before the first wildcard.
    literal = F.aggregate(parts, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda acc, p: F.struct(
        (acc["n"] + F.when(acc["go"] & ~p.rlike(_WILD), 1).otherwise(0)).alias("n"), (acc["go"] & ~p.rlike(_WILD)).alias("go")), lambda acc: acc["n"])
    root = F.when(F.col(folder).startswith("/"), F.lit("/")).otherwise(F.lit(""))
    at = asked.select(*keys, parts.alias("_parts"), literal.alias("_n"), root.alias("_root"))
    at = at.select(*keys, F.concat("_root", F.array_join(F.slice("_parts", F.lit(1), F.col("_n")), "/")).alias("_at"),
                   F.slice("_parts", F.col("_n") + 1, F.size("_parts")).alias("_left"))
    at, found = cut_lineage(at), []
    while True:
        found.append(at.filter(F.size("_left") == 0).select(*keys, F.col("_at").alias(folder)))
        open_ones = at.filter(F.size("_left") > 0)
        if open_ones.isEmpty():
            return reduce(DataFrame.unionByName, found)
        ready = open_ones.withColumns({"_part": F.element_at("_left", 1), "_left": F.slice("_left", F.lit(2), F.size("_left")), "parent": F.col("_at")})
        met = skew.checked_join(tree.withColumnRenamed("name", "_name"), ready, ["parent"])
        regex = F.concat(F.lit(r"(?s)^"), P.glob_regex("_part", "[^/]*", "[^/]"), F.lit(r"\z"))
        hidden = F.col("_name").startswith(".") & ~F.col("_part").startswith(".")
        hit = F.when(F.col("_part").rlike(_WILD), F.rlike("_name", regex) & ~hidden).otherwise(F.col("_part") == F.col("_name"))
        at = cut_lineage(met.filter(hit).select(*keys, _child(F.col("_at"), F.col("_name")).alias("_at"), "_left"))


def expand_names(listing: DataFrame, asked: DataFrame) -> DataFrame:
    """An existing name stands for itself; another one for the sample files ``folder/name*``.

    ``asked`` is ``(req_id, name, inputs array<string>)``; ``listing`` is ``(path)``. Names and folders may hold
    wildcards in any component; a leading wildcard does not reach hidden files. Folders are normalised.
    """
    wanted = asked.select("name").distinct()
    present = skew.checked_join(
        wanted, listing.select(F.col("path").alias("name")).distinct(), ["name"], "left_semi")
    asked_missing = skew.checked_join(asked, present, ["name"], "left_anti")
    full = P.join_path("_dir", "name")
    literal = F.regexp_extract(P.basename("_full"), r"^([^*?\[]*)", 1)
    wanted_at = asked_missing.select("req_id", "name", F.posexplode("inputs").alias("pos", "_dir")).select(
        "req_id", "name", "pos", full.alias("_full"))
    # A pattern is walked once, however many requests ask for it.
    tried = cut_lineage(
        wanted_at.select("_full").distinct()
        .select("_full", P.dirname("_full").alias("_folder"), literal.alias("_head"), P.basename("_full").alias("_base"))
    )
    wild = F.col("_folder").rlike(_WILD)
    plain = F.when(F.col("_folder") == "", F.lit("")).otherwise(P.normalize("_folder"))
    patterns = tried.filter(~wild).withColumn("_folder", plain)
    if not tried.filter(wild).isEmpty():
        patterns = patterns.unionByName(walk_folders(folder_tree(listing), tried.filter(wild)).select(*tried.columns))
    files = listing.filter(P.is_sample_file("path")).select(
        "path", P.dirname("path").alias("_folder"), P.basename("path").alias("_file"))
    lengths = sorted(
        patterns.agg(F.collect_set(F.length("_head")).alias("n")).first()["n"]
    )
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("_file"))
    fanned = files.withColumn("_head", F.explode(F.transform(cuts, lambda n: F.substr("_file", F.lit(1), n))))
    regex = F.concat(F.lit(r"(?s)^"), P.glob_regex(F.concat(F.col("_base"), F.lit("*")), "[^/]*", "[^/]"), F.lit(r"\z"))
    hidden = F.col("_file").startswith(".") & ~F.col("_base").startswith(".")
    # A name without wildcards is the head that both sides are joined by.
    fits = F.when(F.col("_base").rlike(_WILD), F.rlike("_file", regex)).otherwise(F.lit(True))
    named = cut_lineage(skew.checked_join(fanned, patterns, ["_folder", "_head"]).filter(fits & ~hidden).select("_full", "path"))
    found = skew.checked_join(wanted_at, named, ["_full"]).select("req_id", "name", "pos", "path")
    itself = skew.checked_join(asked, present, ["name"]).select(
        "req_id", "name", F.lit(-1).alias("pos"), F.col("name").alias("path"))
    return itself.unionByName(found)


def unresolved(asked: DataFrame, found: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Asked rows without any result: the rows a strict caller treats as errors."""
    keys = on or ["req_id", "name"]
    return skew.checked_join(asked, found.select(*keys).distinct(), keys, "left_anti")


def require_none(violations: DataFrame, message: str) -> DataFrame:
    """Make a plan fail on the first violating row (strict mode)."""
    detail = F.concat(F.lit(message + ": "), F.to_json(F.struct("*")))
    return violations.filter(F.raise_error(detail).cast("boolean"))


def exists(catalog: DataFrame, names: DataFrame, key: str = "uri") -> DataFrame:
    """Whether each distinct name is a catalog key, as a direct key lookup."""
    keys = catalog.select(F.col(key).alias("name"))
    wanted = names.select("name").distinct()
    there = skew.checked_join(keys, wanted, ["name"]).groupBy("name").agg(F.lit(True).alias("_there"))
    return wanted.join(there, "name", "left").select("name", F.col("_there").isNotNull().alias("found"))  # distinct on both sides


def reference_prefix(builds: DataFrame, folders: DataFrame) -> DataFrame:
    """Folder of each build: ``<build>`` first, then ``genomes/<build>``.

    ``folders`` is ``(name, path)``: the outcome of a folder lookup of those two names, by whichever
    platform rule. Builds with neither come back from :func:`unresolved`.
    """
    tries = builds.select(
        "build", F.posexplode(F.array("build", F.concat(F.lit("genomes/"), F.col("build")))).alias("rank", "name"))
    hits = skew.checked_join(folders.select("name", "path"), tries, ["name"])
    return _first(hits, ["build"], ["rank", "path"], ["rank", "path"])


def reference_prefix_names(builds: DataFrame) -> DataFrame:
    """The names :func:`reference_prefix` needs looked up."""
    names = F.array("build", F.concat(F.lit("genomes/"), F.col("build")))
    return builds.select(F.explode(names).alias("name")).distinct()


def match_sets(matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches ``(name, ord, uri)`` → one row per name, and the members of the names that have several.

    The first table is ``(name, uri, set_id)``: the only match, or the id of a set. The second is ``(set_id, ord, uri)``; a
    popular name's list is stored there once, however many records ask for it.
    """
    counts = matches.groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.min_by("uri", "ord").alias("_uri"))
    counts = cut_lineage(counts)
    many = F.col("_n") > 1
    sets = counts.select("name", F.when(~many, F.col("_uri")).alias("uri"), F.when(many, F.col("name")).alias("set_id"))
    members = skew.checked_join(matches, counts.filter(many).select("name"), ["name"], "left_semi")
    return sets, members.select(F.col("name").alias("set_id"), "ord", "uri")


def fill_sets(leaves: DataFrame, sets: DataFrame, candidate: Column) -> DataFrame:
    """``leaves`` with ``filled`` and ``set_id``: a value with one match is replaced, one with several gets its set.

    As many rows as ``leaves``. Leaves that are no candidates have no key: they stay where they are.
    """
    keyed = leaves.withColumn("name", F.when(candidate, F.col("value")))
    found = skew.checked_join(keyed, sets.withColumnRenamed("uri", "_uri"), ["name"], "left")
    return found.select("rec_id", "path", "kind", F.coalesce("_uri", "value").alias("value"),
                        (F.col("_uri").isNotNull() | F.col("set_id").isNotNull()).alias("filled"), "set_id", *_others(leaves))


def _others(leaves: DataFrame) -> list[str]:
    """Columns of the caller's own, which filling carries along."""
    return [c for c in leaves.columns if c not in ("rec_id", "path", "kind", "value", "filled", "set_id")]


def open_sets(filled: DataFrame, members: DataFrame) -> DataFrame:
    """Leaves with a set become lists: one leaf per member, one list step longer and in match order.

    A text column ``_item`` of the caller's own gets the number of the member, for those who can do without a path made per row.
    """
    number = F.col("_ord").cast("long")
    item = F.array(F.struct(F.lit(None).cast("string").alias("key"), number.alias("idx")))
    # Texts and steps are made once per member, not once per row of the result.
    inside = members.select("set_id", F.col("ord").alias("_ord"), F.col("uri").alias("_uri")).select(
        "set_id", "_uri", item.alias("_step"), number.cast("string").alias("_number"))
    # Without a set there is no key, and a left join keeps the leaf.
    opened = skew.checked_join(filled, inside, ["set_id"], "left")
    there = F.col("_uri").isNotNull()
    return opened.select(
        "rec_id", F.when(there, F.concat("path", "_step")).otherwise(F.col("path")).alias("path"), "kind", F.coalesce("_uri", "value").alias("value"),
        "filled", *[F.when(there, F.col("_number")).alias("_item") if c == "_item" else c for c in _others(filled)])


def fill_references(leaves: DataFrame, matches: DataFrame, candidate: Column) -> DataFrame:
    """Replace candidate leaf values by what they resolve to.

    ``leaves`` is a leaf table ``(rec_id, path, kind, value)``, ``matches`` is ``(name, ord, uri)``. A value
    with several matches becomes a list: its leaf turns into one leaf per match, one list step longer and
    in match order. Values without a match stay as they are.
    """
    sets, members = match_sets(matches)
    return open_sets(fill_sets(leaves, sets, candidate), members)


def is_candidate(value: Column | str, platform: Column, kind: Column | str = "kind") -> Column:
    """A string leaf that looks like a file name and is not remote already."""
    value = F.col(value) if isinstance(value, str) else value
    kind = F.col(kind) if isinstance(kind, str) else kind
    return (kind == "string") & (P.extension(value) != "") & ~P.is_remote(value, platform)


def candidate_names(leaves: DataFrame, platform: Column, listing: DataFrame | None = None) -> DataFrame:
    """Distinct candidate values ``(name)``, without those that exist locally in ``listing (path)``."""
    names = leaves.filter(is_candidate("value", platform)).select(F.col("value").alias("name")).distinct()
    if listing is None:
        return names
    return skew.checked_join(names, listing.select(F.col("path").alias("name")).distinct(), ["name"], "left_anti")


def drop_existing(leaves: DataFrame, listing: DataFrame) -> DataFrame:
    """Leaves whose value is not an existing local path."""
    local = listing.select(F.col("path").alias("value")).distinct()
    return skew.checked_join(leaves, local, ["value"], "left_anti")
