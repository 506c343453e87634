"""License scan by ordered signature rules, with DataFrame functions only.

A text becomes its words: A-Z in lower case, everything that is no ASCII letter or digit and below U+0080 one space. Each
rule of ``license_rules.RULES`` (some 440 regular expressions over words) is tried on texts that hold its keywords, and
texts without any of ``SIGNS`` skip them all. A rule's detections are spans of words. They are resolved by
priority and containment: a detection within one of an earlier kind, within a longer one of its own kind, or on
the same words as one of an earlier rule, is suppressed. What survives gives the labels.

Detections of a text are swept once, in the order of their starts, longer ones first; for each kind the sweep
remembers the furthest end so far. So the work grows with words and detections, not with pairs of them, and there is no
shuffle: a row is scanned where it is read.

Besides, ``BASE`` phrases are looked up by their words alone; their labels stay whatever the rules say. Null text counts
as empty: no words, no labels, score 0. Equal rows get equal results, an empty table an empty one. Other columns pass
through; columns with the names of the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowline.llm.license_rules import KINDS, RULES, SIGNS

#: Phrases and their labels; no two can overlap. All hold ``BASE_SIGN``.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
BASE_SIGN = " license "
BASE_SCORE = 0.5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_START, _END = "\x01", "\x02"
_RESULTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "licenses"]


def words(text: Column) -> Column:
    """The words of ``text``, as written, with a space before, between and after them; a space if there are none."""
    return F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")


def spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def has_sign(raw: Column) -> Column:
    """Whether some rule or phrase may match; ``lower`` finds at least what lower-casing A-Z alone does."""
    lower, found = F.lower(raw), F.lit(False)
    for sign in SIGNS:
        found = found | F.contains(lower, F.lit(sign))
    return found


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hits(name: str) -> str:
    """SQL: of each rule that matches the column ``name``, its kind, number, label, and the text with its matches marked.

    All of it stands in a lambda: hundreds of rules would make generated code that is too large to be compiled.
    """
    tries = []
    for i, rule in enumerate(RULES):
        pattern = _quoted(f"(?<= )(?:{rule.pattern})(?= )")
        held = " AND ".join(f"contains(t, {_quoted(k)})" for k in rule.keywords)
        tries.append(f"CASE WHEN {held} AND t RLIKE {pattern} THEN named_struct('kind', {list(KINDS).index(rule.kind)}, 'rule', {i}, "
                     f"'label', {_quoted(rule.label)}, 'marked', split(trim(regexp_replace(t, {pattern}, {_quoted(_START + '$0' + _END)})), ' ')) END")
    return f"filter(flatten(transform(array({name}), t -> array({', '.join(tries)}))), h -> h IS NOT NULL)"


def _spans(name: str) -> str:
    """SQL: the matches of the hits ``name`` as spans of words [start, stop), in the order of the sweep."""
    def places(test: str) -> str:
        return f"filter(transform(h.marked, (w, i) -> CASE WHEN {test} THEN i END), i -> i IS NOT NULL)"

    span = "named_struct('start', s, 'longest', s - e, 'kind', h.kind, 'rule', h.rule, 'stop', e + 1, 'label', h.label)"
    starts, ends = places(f"startswith(w, '{_START}')"), places(f"endswith(w, '{_END}')")
    return f"array_sort(flatten(transform({name}, h -> zip_with({starts}, {ends}, (s, e) -> {span}))))"


def _swept(name: str) -> str:
    """SQL: what survives of the spans ``name``: the first detection of each label and kind, and the best score."""
    found = "array<struct<label: string, kind: string, start: int, stop: int>>"
    new = ("named_struct('label', d.label, 'kind', element_at(array({0}), d.kind + 1), 'start', d.start, 'stop', d.stop)"
           .format(", ".join(map(_quoted, KINDS))))
    known = f"exists(acc.found, f -> f.label = d.label AND f.kind = ({new}).kind)"
    score = f"greatest(acc.score, element_at(array({', '.join(f'{v}D' for v in KINDS.values())}), d.kind + 1))"
    return (f"aggregate({name}, named_struct('ends', array_repeat(0, {len(KINDS)}), 'found', CAST(array() AS {found}), 'score', 0D), (acc, d) -> "
            "CASE WHEN array_max(slice(acc.ends, 1, d.kind + 1)) >= d.stop THEN acc ELSE named_struct("
            "'ends', transform(acc.ends, (x, i) -> CASE WHEN i = d.kind THEN greatest(x, d.stop) ELSE x END), "
            f"'found', CASE WHEN {known} THEN acc.found ELSE concat(acc.found, array({new})) END, 'score', {score}) END)")


def scan(docs: DataFrame, drop_text: bool = False) -> DataFrame:
    """``docs`` with its licenses.

    Adds ``n_words``; ``n_base``, ``first_word``, ``last_word``, ``base_labels``: the places of the base phrases; ``labels``: those of the
    rules too; ``score``: how sure the surest detection is; ``licenses``: of each label and kind the words of the first detection.
    """
    # The caller's columns travel in one struct, so that none can clash.
    others = [c for c in docs.columns if c not in _RESULTS and not (drop_text and c == "text")]
    rows = docs.select(F.struct(*others).alias("_kept"), words(F.col("text")).alias("_raw"))
    rows = rows.select("_kept", (spaces(F.col("_raw")) - 1).alias("n_words"),
                       F.when(has_sign(F.col("_raw")), F.translate("_raw", _UPPER, _UPPER.lower())).alias("_words"))
    phrases = f"(?<= )(?:{'|'.join(BASE)})(?= )"
    based = F.contains("_words", F.lit(BASE_SIGN))
    rows = rows.select(
        "_kept", "n_words", F.expr(f"CASE WHEN _words IS NOT NULL THEN {_hits('_words')} END").alias("_hits"),
        F.when(based, F.split("_words", phrases, -1)).alias("_between"), F.when(based, F.regexp_extract_all("_words", F.lit(phrases), F.lit(0))).alias("_found"))
    rows = rows.select("_kept", "n_words", "_between", "_found", F.expr(f"CASE WHEN size(_hits) > 0 THEN {_spans('_hits')} END").alias("_spans"))
    rows = rows.select("_kept", "n_words", "_between", "_found", F.expr(f"CASE WHEN _spans IS NOT NULL THEN {_swept('_spans')} END").alias("_swept"))
    some = F.size("_found") > 0
    last = F.col("n_words") - (spaces(F.element_at("_between", -1)) - 1) - (spaces(F.element_at("_found", -1)) + 1)
    labels = F.create_map(*(F.lit(x) for pair in BASE.items() for x in pair))
    own = F.when(some, F.transform("_found", lambda f: labels[f])).otherwise(F.array().cast("array<string>"))
    ruled = F.coalesce(F.transform("_swept.found", lambda f: f["label"]), F.array().cast("array<string>"))
    score = F.greatest(F.when(some, F.lit(BASE_SCORE)).otherwise(F.lit(0.0)), F.coalesce(F.col("_swept.score"), F.lit(0.0)))
    results = {
        "n_words": F.col("n_words"), "n_base": F.when(some, F.size("_found")).otherwise(0).cast("long"),
        "first_word": F.when(some, spaces(F.element_at("_between", 1)) - 1), "last_word": F.when(some, last),
        "base_labels": F.array_join(F.array_sort(F.array_distinct(own)), ","),
        "labels": F.array_join(F.array_sort(F.array_union(own, ruled)), ","), "score": score,
        "licenses": F.coalesce(F.col("_swept.found"), F.array().cast("array<struct<label: string, kind: string, start: int, stop: int>>")),
    }
    return rows.select(*(F.col("_kept").getField(c).alias(c) for c in others), *(v.alias(k) for k, v in results.items()))


def license_report(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the results of ``scan`` for every row of ``docs``."""
    return scan(docs.select("doc_id", "text"), drop_text=True)
