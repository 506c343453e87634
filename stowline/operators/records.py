"""Nested records as leaf tables, and the path rewriting done on them.

A leaf table has one row per scalar of a record (and per empty container):
``(rec_id, path array<struct<key, idx>>, kind, value)``. List steps have a null key. ``ctx`` (the keys on
the way down) and ``pos`` (the positions, which sort leaves in document order) derive from ``path``.
Object keys are in sorted order, as in Spark's VARIANT.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowline.functions import paths as P
from stowline.operators import skew
from stowline.operators.matching import prefix_join
from stowline.session import cut_lineage

PATH_TYPE = "array<struct<key:string,idx:bigint>>"
MAX_STEPS = 32

# Keys whose values are never file names, at sample level and under ``algorithm``.
IGNORED_SAMPLE_KEYS = ("description", "analysis", "resources", "genome_build", "lane")
IGNORED_ALGORITHM_KEYS = ("variantcaller", "realign", "recalibrate", "phasing", "svcaller")


#: Levels that are opened in one plan; what is deeper goes on from a checkpoint.
LEVELS = 6


def _is_container(v: str) -> Column:
    shape = F.schema_of_variant(v)
    return shape.startswith("OBJECT<") | shape.startswith("ARRAY<")


def flatten(records: DataFrame, json: str = "json", depth: int | None = None, levels: int | None = None) -> DataFrame:
    """Records ``(rec_id, json)`` → leaf table.

    Containers are opened level by level, ``levels`` of them in one scan without a shuffle; finished leaves ride along. Rows
    that are still containers then are the frontier, looked for among the records with more brackets than that. They
    alone are checkpointed and opened further, as often as there are any, so that neither the plan nor the work on shallow
    records grows with the deepest one. With ``depth`` given no frontier is looked for, and a deeper record fails
    instead of losing leaves.
    """
    levels = LEVELS if levels is None else levels
    rows = records.select("rec_id", F.parse_json(json).alias("v"), F.array().cast(PATH_TYPE).alias("path"))
    if depth is not None:
        return _leaves(_opened(rows, depth), strict=True)
    brackets = F.length(json) - F.length(F.replace(F.replace(F.col(json), F.lit("[")), F.lit("{")))
    deeper = _frontier(_opened(records.filter(brackets > levels).select("rec_id", F.parse_json(json).alias("v"), F.array().cast(PATH_TYPE).alias("path")), levels))
    done = [_leaves(_opened(rows, levels).filter(~_is_open()))]
    while not deeper.isEmpty():
        rows = _opened(deeper.select("rec_id", F.parse_json("v").alias("v"), "path"), levels)
        done.append(_leaves(rows.filter(~_is_open())))
        deeper = _frontier(rows)
    return reduce(DataFrame.unionByName, done)


def _is_open() -> Column:
    """Whether ``v`` is a container with something in it."""
    return _is_container("v") & ~F.to_json("v").isin("{}", "[]")


def _frontier(rows: DataFrame) -> DataFrame:
    return cut_lineage(rows.filter(_is_open()).select("rec_id", F.to_json("v").alias("v"), "path"))


def _opened(rows: DataFrame, levels: int) -> DataFrame:
    """``rows (rec_id, v, path)`` with ``levels`` levels of containers opened."""
    for _ in range(levels):
        opened = rows.withColumn("_c", F.when(_is_container("v"), F.col("v"))).lateralJoin(
            rows.sparkSession.tvf.variant_explode_outer(F.col("_c").outer()))
        step = F.struct(F.col("key").alias("key"), F.col("pos").cast("long").alias("idx"))
        rows = opened.select(
            "rec_id",
            F.when(F.col("pos").isNull(), F.col("v")).otherwise(F.col("value")).alias("v"),
            F.when(F.col("pos").isNull(), F.col("path")).otherwise(F.concat("path", F.array(step))).alias("path"),
        )
    return rows


def _leaves(rows: DataFrame, strict: bool = False) -> DataFrame:
    shape = F.schema_of_variant("v")
    kind = (
        F.when(shape == "STRING", F.lit("string")).when(shape == "VOID", F.lit("null"))
        .when(shape == "BOOLEAN", F.lit("boolean")).when(shape.startswith("OBJECT"), F.lit("object"))
        .when(shape.startswith("ARRAY"), F.lit("array")).otherwise(F.lit("number"))
    )
    if strict:
        kind = F.when(_is_open(), F.raise_error(F.lit("record nests deeper than the given depth")).cast("string")).otherwise(kind)
    value = F.when(shape == "STRING", F.col("v").cast("string")).otherwise(F.to_json("v"))
    return rows.select("rec_id", "path", kind.alias("kind"), value.alias("value"))


def ctx(path: Column | str = "path") -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.transform(F.filter(path, lambda s: s["key"].isNotNull()), lambda s: s["key"])


def pos(path: Column | str = "path") -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.transform(path, lambda s: s["idx"])


def _quoted(text: Column) -> Column:
    wrapped = F.to_json(F.struct(text.alias("v")))
    return F.substr(wrapped, F.lit(6), F.length(wrapped) - 6)


def rebuild(leaves: DataFrame) -> DataFrame:
    """Leaf table → ``(rec_id, json)``, the inverse of :func:`flatten`.

    One shuffle on ``rec_id``; the leaves of one record meet in one row because a record is one row.
    """
    text = F.when(F.col("kind") == "string", _quoted(F.col("value"))).otherwise(F.col("value"))
    rows = leaves.select(
        "rec_id", F.struct(
            pos().alias("pos"),
            F.transform("path", lambda s: F.struct(
                s["idx"].alias("idx"),
                F.when(s["key"].isNotNull(), F.concat(_quoted(s["key"]), F.lit(":"))).alias("label"))).alias("steps"),
            text.alias("text")).alias("leaf"))
    grouped = rows.groupBy("rec_id").agg(F.sort_array(F.collect_list("leaf")).alias("a"))

    def brackets(steps: Column, first: Column, opening: bool) -> Column:
        """Opening (with label) or closing marks of the containers at depth ``first`` and below."""
        part = F.slice(steps, first + 1, F.greatest(F.size(steps) - first, F.lit(0)))
        if opening:
            marks = F.transform(part, lambda s: F.concat(
                F.when(s["label"].isNull(), F.lit("[")).otherwise(F.lit("{")), F.coalesce(s["label"], F.lit(""))))
        else:
            marks = F.reverse(F.transform(part, lambda s: F.when(s["label"].isNull(), F.lit("]")).otherwise(F.lit("}"))))
        return F.array_join(marks, "")

    def piece(leaf: Column, i: Column) -> Column:
        before = F.col("a")[F.greatest(i - 1, F.lit(0))]
        shared = F.array_position(
            F.zip_with(leaf["pos"], before["pos"], lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int") - 1
        at = leaf["steps"][shared]
        later = F.concat(
            brackets(before["steps"], shared + 1, False), F.lit(","), F.coalesce(at["label"], F.lit("")),
            brackets(leaf["steps"], shared + 1, True))
        return F.concat(F.when(i == 0, brackets(leaf["steps"], F.lit(0), True)).otherwise(later), leaf["text"])

    body = F.array_join(F.transform("a", piece), "")
    end = brackets(F.element_at("a", -1)["steps"], F.lit(0), False)
    return grouped.select("rec_id", F.concat(body, end).alias("json"))


def without_keys(leaves: DataFrame, keys: list[str], under: str | None = None) -> DataFrame:
    """Leave out leaves below an ignored key; with ``under`` only where that key is directly below it."""
    keyed = ctx()
    if under is None:
        ignored = F.exists(keyed, lambda k: k.isin(keys))
    else:
        pairs = F.zip_with(keyed, F.slice(keyed, F.lit(2), F.greatest(F.size(keyed) - 1, F.lit(0))),
                           lambda k, nxt: (k == under) & F.coalesce(nxt.isin(keys), F.lit(False)))
        ignored = F.exists(pairs, lambda p: p)
    return leaves.filter(~ignored)


def prune_nulls(leaves: DataFrame) -> DataFrame:
    """Drop nulls and the objects they empty. Empty lists, empty strings and zeros stay.

    A list that loses all its items stays as an empty list, so such lists come back as leaves of their own.
    """
    gone = F.col("kind").isin("null", "object")
    kept = leaves.filter(~gone)
    inner = F.array_max(F.filter(
        F.transform("path", lambda s, i: F.when(s["key"].isNull(), i)), lambda i: i.isNotNull()))
    emptied = (
        leaves.filter(gone).withColumn("_at", inner).filter(F.col("_at").isNotNull())
        .select("rec_id", F.slice("path", F.lit(1), F.col("_at")).alias("path")).distinct()
    )
    # A list is not empty when a kept leaf, or another list that stays, lies below it.
    alive = kept.select("rec_id", "path").unionByName(emptied)
    parents = F.filter(
        F.transform("path", lambda s, i: F.when(s["key"].isNull(), F.slice(F.col("path"), F.lit(1), i))),
        lambda p: p.isNotNull())
    filled = alive.select("rec_id", F.explode(parents).alias("path")).distinct()
    empty = emptied.join(filled, ["rec_id", "path"], "left_anti")
    return kept.unionByName(empty.select("rec_id", "path", F.lit("array").alias("kind"), F.lit("[]").alias("value")))


# -- longest-prefix remap ------------------------------------------------------------------------------

def parse_mounts(mounts: DataFrame, inward: bool = True) -> DataFrame:
    """``from:to`` strings ``(ord, mount)`` → ``(src, dst)``; the last mapping of a source wins.

    With ``inward=False`` the direction is turned around, for results that come back.
    """
    left, right = F.substring_index("mount", ":", 1), F.substring_index("mount", ":", -1)
    src, dst = (left, right) if inward else (right, left)
    return mounts.groupBy(src.alias("src")).agg(F.max_by(dst, "ord").alias("dst"))


def invert(remap: DataFrame) -> DataFrame:
    """Swap ``(ord, src, dst)``; when two sources share a target the later one wins."""
    return remap.groupBy(F.col("dst").alias("src")).agg(F.max_by("src", "ord").alias("dst"))


def remap_longest(rows: DataFrame, value: str, remap: DataFrame, boundary: bool = False,
                  prefix_only: bool = False) -> DataFrame:
    """Rewrite ``value`` by the longest ``remap (src, dst)`` source that is its prefix.

    All occurrences of the source inside the value are replaced unless ``prefix_only``; ``boundary``
    asks for a ``/`` (or the end) after the prefix. Adds ``remapped`` and ``matched``; rows without a
    match keep their value. Of several mappings of a source the last by ``ord`` counts, or without ``ord`` the
    one with the greatest target. A small map is probed once per distinct source length, longest first, which
    needs no shuffle. A large map goes through a prefix join of the distinct values. The map is
    checkpointed first, so that it is derived once.
    """
    dst = F.max_by("dst", "ord") if "ord" in remap.columns else F.max("dst")
    table = cut_lineage(remap.filter(F.col("src").isNotNull()).groupBy("src").agg(dst.alias("dst")))
    facts = table.agg(F.count("src").alias("n"), F.coalesce(F.sum(F.length("src") + F.length("dst")), F.lit(0)).alias("b"),
                      F.collect_set(F.length("src")).alias("lengths")).first()
    lengths = sorted(facts["lengths"], reverse=True)
    small = facts["n"] <= skew.BROADCAST_ROWS and facts["b"] <= skew.BROADCAST_BYTES and len(lengths) <= MAX_STEPS
    text = F.col(value)

    def ends_well(length: Column) -> Column:
        nxt = F.substr(text, length + 1, F.lit(1))
        return (nxt == "") | (nxt == "/") | (F.substr(text, length, F.lit(1)) == "/")

    if small:
        out, found = rows, []
        for n in lengths:
            keys = table.filter(F.length("src") == n).select(
                F.col("src").alias(f"_k{n}"), F.struct("src", "dst").alias(f"_m{n}"))
            on = F.substr(text, F.lit(1), F.lit(n)) == F.col(f"_k{n}")
            if boundary:
                on = on & ends_well(F.lit(n))
            out = out.join(F.broadcast(keys), on, "left")
            found.append(F.col(f"_m{n}"))
        best = F.coalesce(*found) if found else F.lit(None).cast("struct<src:string,dst:string>")
        out = out.select(*rows.columns, best.alias("_best"))
    else:
        hits = prefix_join(rows.select(value).distinct(), value, table, "src")
        if boundary:
            hits = hits.filter(ends_well(F.length("src")))
        best = hits.groupBy(value).agg(F.max_by(F.struct("src", "dst"), F.length("src")).alias("_best"))
        # Rows without a value match nothing and skip the join; a value of very many rows is salted there.
        out = skew.checked_join(rows, best, [value], "left")
    src, dst = F.col("_best.src"), F.col("_best.dst")
    if prefix_only:
        new = F.concat(dst, F.substr(text, F.length(src) + 1))
    else:
        new = F.when(src == "", text).otherwise(F.replace(text, src, dst))
    return out.withColumn("remapped", F.coalesce(new, text)).withColumn("matched", src.isNotNull()).drop("_best")


def remap_leaves(leaves: DataFrame, remap: DataFrame, nopath_keys: list[str] | None = None, **options) -> DataFrame:
    """Remap the string leaves of records; values under ``algorithm`` / no-path keys pass unchanged."""
    keys = nopath_keys or []
    keyed = ctx()
    fixed = (
        F.exists(F.transform(keyed, lambda k, i: (i > 0) & (F.get(keyed, i - 1) == "algorithm") & k.isin(keys)),
                 lambda hit: hit)
        if keys else F.lit(False))
    marked = leaves.withColumn("_v", F.when((F.col("kind") == "string") & ~fixed, F.col("value")))
    out = remap_longest(marked, "_v", remap, **options)
    return out.select("rec_id", "path", "kind", F.coalesce("remapped", "value").alias("value"), "matched")


# -- local path work -----------------------------------------------------------------------------------

def absolute_paths(leaves: DataFrame, listing: DataFrame, bases: list[str], ignored: list[str],
                   under: str | None = None) -> DataFrame:
    """Expand file values of one mapping to absolute existing paths.

    The mapping is the record itself or, with ``under``, the object at that key. A string, or a list
    whose first item resolves, is replaced by the first base folder's path that exists; items of such a
    list that do not resolve become null. ``listing`` is ``(path)`` or ``(path, real)`` with link targets.
    """
    top = 1 if under is None else 2
    steps, last = F.col("path"), F.element_at("path", -1)
    inside = F.lit(True) if under is None else (F.size(steps) > 0) & (F.get(steps, F.lit(0))["key"] == under)
    key = F.get(steps, F.lit(top - 1))["key"]
    in_list = (F.size(steps) == top + 1) & F.get(steps, F.lit(top))["key"].isNull()
    scope = inside & key.isNotNull() & ~key.isin(ignored) & ((F.size(steps) == top) | in_list)
    marked = leaves.withColumn("_scope", F.coalesce(scope, F.lit(False)) & (F.col("kind") == "string") & (F.col("value") != ""))
    marked = marked.withColumn("_list", in_list).withColumn("_item", F.when(in_list, F.get(steps, F.lit(top))["idx"]))
    real = F.col("real") if "real" in listing.columns else F.col("path")
    known = listing.select(F.col("path").alias("_try"), real.alias("_real"))
    wanted = marked.filter("_scope").select("value").distinct()
    tries = wanted.select("value", F.posexplode(F.array(*[F.lit(b) for b in bases])).alias("_rank", "_base")).select(
        "value", "_rank", P.normalize(P.join_path("_base", "value")).alias("_try"))
    found = cut_lineage(
        skew.checked_join(known, tries, ["_try"]).groupBy("value").agg(F.min_by("_real", "_rank").alias("_abs"))
    )
    joined = skew.checked_join(marked, found, ["value"], "left")
    lists = joined.filter("_scope and _list and _item = 0 and _abs is not null").select(
        "rec_id", key.alias("_key")).distinct().withColumn("_open", F.lit(True))
    # Only items of lists ask for them: other leaves have no key and stay where they are.
    full = skew.checked_join(joined.withColumn("_key", F.when(F.col("_list"), key)), lists, ["rec_id", "_key"], "left")
    expand = F.col("_scope") & ~F.col("_list") & F.col("_abs").isNotNull()
    listed = F.col("_list") & F.coalesce("_open", F.lit(False)) & F.coalesce(scope, F.lit(False))
    return full.select(
        "rec_id", "path",
        F.when(listed & F.col("_abs").isNull(), F.lit("null")).otherwise(F.col("kind")).alias("kind"),
        F.when(expand, F.col("_abs")).when(listed, F.coalesce("_abs", F.lit("null"))).otherwise(F.col("value")).alias("value"))


def harvest_folders(leaves: DataFrame, listing: DataFrame, ignored: list[str]) -> DataFrame:
    """Folders of the absolute existing paths in each record: distinct ``(rec_id, folder)``.

    Strings count when they exist. A list counts as a whole when its first item does; its other items
    are not checked.
    """
    path = F.col("path")
    keys_only = F.forall(F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))), lambda s: s["key"].isNotNull())
    usable = (F.col("kind") == "string") & (F.col("value") != "") & (F.size(path) > 0) & keys_only
    base = without_keys(leaves.filter(usable), ignored).withColumn("_item", F.when(
        F.element_at(path, -1)["key"].isNull(), F.element_at(path, -1)["idx"]))
    base = base.withColumn("_list", F.slice(path, F.lit(1), F.size(path) - 1))
    local = listing.select(F.col("path").alias("value")).distinct()
    asked = base.filter((F.col("_item").isNull() | (F.col("_item") == 0)) & F.col("value").startswith("/"))
    there = skew.checked_join(asked, local, ["value"], "left_semi")
    lists = there.filter(F.col("_item").isNotNull()).select("rec_id", "_list")
    items = base.filter(F.col("_item").isNotNull()).join(lists, ["rec_id", "_list"], "left_semi")
    rows = there.filter(F.col("_item").isNull()).select("rec_id", "value").unionByName(items.select("rec_id", "value"))
    return rows.select("rec_id", P.dirname("value").alias("folder")).filter("folder != ''").distinct()


def sorted_mounts(folders: DataFrame) -> DataFrame:
    """Distinct folders in order, each as an identity mount ``folder:folder``."""
    return folders.select("folder").distinct().orderBy("folder").select(
        "folder", F.concat("folder", F.lit(":"), "folder").alias("mount"))
