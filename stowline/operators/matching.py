"""String-match joins rewritten as equality joins.

``ends with``, ``starts with`` and glob conditions would make Spark compare every row with every key.
Here each text is fanned out to the few pieces a key could be equal to (its ``/`` suffixes, or its
prefixes of the lengths that occur among the keys) and joined on equality. Fan-out depends on path depth
or on the number of distinct key lengths, never on the number of keys. Globs are filed in an inverted index of
short literal pieces, each under the piece that the fewest texts have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowline.functions import paths as P
from stowline.operators import skew
from stowline.session import cut_lineage


def _facts(keys: DataFrame, key: str, *extra: Column):
    """One aggregate row about the keys: how many, how wide, plus ``extra`` bounded sets."""
    width = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in keys.columns])))
    return keys.agg(F.count(key).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b"), *extra).first()


def _fits(facts) -> bool:
    return facts["n"] <= skew.BROADCAST_ROWS and facts["b"] <= skew.BROADCAST_BYTES


def suffix_join(rows: DataFrame, text: str, names: DataFrame, name: str = "name") -> DataFrame:
    """Pairs where ``text`` equals ``name`` or ends with ``/`` + ``name`` (names must be distinct)."""
    return _suffix_join(rows, text, names, name, _facts(names, name, _depths(name)))


def _depths(name: str) -> Column:
    return F.collect_set(F.size(F.split(name, "/"))).alias("depths")


def _suffix_join(rows: DataFrame, text: str, names: DataFrame, name: str, facts) -> DataFrame:
    depths = sorted(facts["depths"])
    if not depths:
        return rows.join(names, F.lit(False))
    # A name is the text after some slash, or the whole text. Both mean: equal to one of its tails.
    fanned = rows.withColumn("_tail", F.explode(_tails(F.col(text), depths)))
    keyed = names.withColumn("_tail", F.col(name))
    return skew.checked_join(fanned, keyed, ["_tail"], small_fits=_fits(facts)).drop("_tail")


def _tails(text: Column, depths: list[int]) -> Column:
    """``substring_index`` with a negative count gives the last ``d`` parts; drop repeats of the whole."""
    parts = F.size(F.split(text, "/"))
    return F.filter(
        F.array(*[F.when(parts >= d, F.substring_index(text, "/", -d)) for d in depths]),
        lambda t: t.isNotNull(),
    )


def prefix_join(rows: DataFrame, text: str, keys: DataFrame, key: str) -> DataFrame:
    """Pairs where ``text`` starts with ``key`` (no ``/`` boundary)."""
    facts = _facts(keys, key, F.collect_set(F.length(key)).alias("lengths"))
    lengths = sorted(facts["lengths"])
    if not lengths:
        return rows.join(keys, F.lit(False))
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(text))
    fanned = rows.withColumn("_head", F.explode(F.transform(fits, lambda n: F.substr(F.col(text), F.lit(1), n))))
    keyed = keys.withColumn("_head", F.col(key))
    return skew.checked_join(fanned, keyed, ["_head"], small_fits=_fits(facts)).drop("_head")


#: Characters of a gram of the glob index.
GRAM = 4
#: What a glob holds besides literal text; an opening bracket without its partner only ends a literal part here.
_WILD = r"\*|\?|\[[!^]?\]?[^\]]*\]|\["
#: Marks the end of a text or pattern, so that a gram at the end is another than the same one inside.
_END = "\0"


def _literals(name: Column) -> Column:
    """The literal parts of the glob ``*/name``, the slash and the end mark among them."""
    return F.split(F.concat(F.lit("/"), name, F.lit(_END)), _WILD)


def _grams(text: Column, length: Column) -> Column:
    """All pieces of ``length`` characters of ``text``; an empty array if it is shorter."""
    last = F.length(text) - length + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, length))).otherwise(F.array().cast("array<string>"))


def rarest_grams(rows: DataFrame, text: str, globs: DataFrame, name: str = "name") -> tuple[DataFrame, list[int]]:
    """Each glob with the one of its grams that the fewest texts have, ``(…, _gram)``, and the lengths of these grams.

    All grams of the literal parts are counted over the texts. A glob with a gram that no text has matches nothing and
    is left out. Grams are ``GRAM`` characters long, or as long as the longest literal part of a pattern without
    such a part; the end mark is in every text, so that every pattern has a gram.
    """
    parts = _literals(F.col(name))
    size = F.least(F.lit(GRAM), F.array_max(F.transform(parts, lambda p: F.length(p))))
    asked = globs.select("*", parts.alias("_parts"), size.alias("_q")).select(
        "*", F.explode(F.array_distinct(F.flatten(F.transform("_parts", lambda p: _grams(p, F.col("_q")))))).alias("_gram"))
    wanted = asked.select("_gram").distinct()
    facts = _facts(wanted, "_gram", F.collect_set(F.length("_gram")).alias("sizes"))
    sizes = sorted(facts["sizes"])
    if not sizes:
        return globs.withColumn("_gram", F.lit(None).cast("string")), []
    offered = rows.select(F.explode(_offered(F.col(text), sizes)).alias("_gram"))
    found = skew.checked_join(offered, wanted, ["_gram"], "left_semi", small_fits=_fits(facts))
    counts = found.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    counted = skew.checked_join(asked.drop("_parts", "_q"), counts, ["_gram"], "left", small_fits=_fits(facts))
    keys = list(globs.columns)
    best = counted.groupBy(*keys).agg(
        F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"), F.min(F.coalesce("_n", F.lit(0))).alias("_n"))
    return cut_lineage(best.filter("_n > 0").drop("_n")), sizes


def _offered(text: Column, sizes: list[int]) -> Column:
    whole = F.concat(text, F.lit(_END))
    return F.array_distinct(F.flatten(F.array(*[_grams(whole, F.lit(n)) for n in sizes])))


def glob_candidates(rows: DataFrame, text: str, globs: DataFrame, name: str = "name", made: dict[str, Column] | None = None,
                    also: Column | None = None) -> DataFrame:
    """Pairs of a text and a glob whose rarest gram and whose literal head and tail it has, and for which ``also`` holds.

    ``made`` are columns for ``also`` that are computed once per glob. All tests are one condition, the literal ends first: as
    filters on top of each other they would reach the join in whatever order Spark pushes them there.
    """
    filed, sizes = rarest_grams(rows, text, globs, name)
    if not sizes:
        return rows.join(globs, F.lit(False))
    fanned = rows.withColumn("_gram", F.explode(_offered(F.col(text), sizes)))
    # The ends are cut off once per glob, not once per pair.
    parts = _literals(F.col(name))
    made = {"_first": F.element_at(parts, 1), "_last": F.replace(F.element_at(parts, -1), F.lit(_END), F.lit("")), **(made or {})}
    ends = F.col(text).endswith(F.col("_last")) & F.col(text).contains(F.col("_first"))
    met = skew.checked_join(fanned, filed.withColumns(made), ["_gram"]).filter(ends if also is None else F.when(ends, also).otherwise(F.lit(False)))
    return met.drop("_gram", *made)


def _runs_in_order(text: Column, runs: Column) -> Column:
    """Whether ``text`` matches ``*/name``, if the only wildcard of ``name`` is the star: its literal parts follow each other.

    ``runs`` are the parts of ``/name`` between stars. Each is looked for behind the one before, as early as possible; the last
    one is the end of the text.
    """
    last = F.element_at(runs, -1)
    step = lambda at, run: F.when(
        (at > 0) & (F.call_function("locate", run, text, at) > 0), F.call_function("locate", run, text, at) + F.length(run)).otherwise(F.lit(0))
    at = F.aggregate(F.filter(F.slice(runs, F.lit(1), F.size(runs) - 1), lambda r: r != ""), F.lit(1), step)
    return at.between(1, F.length(text) - F.length(last) + 1) & text.endswith(last)


def name_join(rows: DataFrame, text: str, names: DataFrame, name: str = "name") -> DataFrame:
    """Pairs where ``text`` equals ``name``, ends with ``/name``, or matches the glob ``*/name``.

    Only names that hold a ``*`` are globs. Names must be distinct; every pair comes once. A literal name meets the texts by
    their tails. A glob meets those that have its rarest gram and its literal ends; only patterns with ``?`` or
    brackets need a regular expression then.
    """
    col, is_glob = F.col(text), F.col(name).contains("*")
    facts = _facts(names, name, _depths(name), F.count_if(is_glob).alias("globs"))
    whole = _suffix_join(rows, text, names, name, facts)
    if not facts["globs"]:
        return whole
    simple = ~F.col(name).rlike(r"[?\[]")
    made = {
        "_runs": F.when(simple, F.split(F.concat(F.lit("/"), name), r"\*")),
        "_regex": F.when(~simple, F.concat(F.lit(r"(?s)^.*/"), P.glob_regex(name), F.lit(r"\z"))),
        "_whole": F.concat(F.lit("/"), F.col(name))}
    hit = F.when(F.col("_runs").isNotNull(), _runs_in_order(col, F.col("_runs"))).otherwise(F.rlike(col, F.col("_regex")))
    by_name = (col == F.col(name)) | col.endswith(F.col("_whole"))
    return whole.unionByName(glob_candidates(rows, text, names.filter(is_glob), name, made, ~by_name & hit))
