"""Path and object-name expressions. Every function takes and returns Columns and stays JVM-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The scheme prefix that marks a name as remote, per platform. Local files have none.
REMOTE_PREFIX = {
    "gs": "gs:",
    "keep": "keep:",
    "sbg": "sbg:",
    "dx": "dx:",
    "s3": "s3:/",
}

# Index suffixes that travel with a file.
COMPANION_SUFFIXES = ("", ".idx", ".gbi", ".tbi", ".bai")

# Accepted sample-file extensions: alignments, reads and variants.
SAMPLE_FILE_PATTERN = r"(\.bam|\.(fastq|fq)(\.gz)?|\.vcf(\.gz)?)$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Functions nest, and an argument that is used twice doubles the expression at every level. So each of
# them mentions its argument once: by one regex, or by binding it to a lambda variable.

def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def basename(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def dirname(path: Column | str) -> Column:
    """Parent folder: no trailing slash unless the parent is the root itself."""
    return F.regexp_extract(_col(path), r"(?s)^(/+(?=[^/]*$)|.*[^/](?=/+[^/]*$))?", 1)


def extension(path: Column | str) -> Column:
    """Last extension with its dot; leading dots of a hidden file do not start one."""
    return F.regexp_extract(_col(path), r"(?:^|/)\.*[^./][^/]*?(\.[^./]*)$", 1)


def without_extension(path: Column | str) -> Column:
    """Path minus its last extension (see :func:`extension`)."""
    return F.regexp_replace(_col(path), r"(?s)^((?:.*/)?\.*[^./][^/]*?)\.[^./]*$", "$1")


def without_full_extension(path: Column | str) -> Column:
    """Path minus its extension, counting a compression suffix and the one before it as one."""
    return F.regexp_replace(_col(path), r"(?<=[^/.])(?:(\.[^./]+)?\.(gz|bz2|zip)|\.[^./]+)$", "")


def join_path(folder: Column | str, name: Column | str) -> Column:
    """Join a folder and a name; an absolute name replaces the folder."""
    marked = F.concat(_col(folder), F.lit("\0"), _col(name))
    # Drop the folder before an absolute name, and the joint after a slash or an empty folder.
    joined = F.regexp_replace(marked, "(?s)^.*\0(?=/)|(?<=/)\0|^\0", "")
    return F.replace(joined, F.lit("\0"), F.lit("/"))


#: A path with an empty, ``.`` or ``..`` component; only the first may be empty.
_UNEVEN = r"^$|//|/$|(?:^|/)\.\.?(?:/|$)"

#: A name and the ``..`` that takes it back; an empty component behind them is left, as it might become a leading one.
_BACK = r"(?<![^/])(?!\.\.?/)[^/]+/\.\./(?!/)"


def normalize(path: Column | str) -> Column:
    """Collapse empty, ``.`` and ``..`` components of a path."""
    # Most paths are as they should be: only those with an empty, ``.`` or ``..`` component are walked.
    # A name before ``..`` is taken out by one regex, and what is uneven after that goes step by step.
    walked = lambda p: F.when(p.rlike(_UNEVEN), _normalized(p)).otherwise(p)
    return _with(_col(path), lambda p: F.when(p.rlike(_UNEVEN), _with(F.regexp_replace(p, _BACK, ""), walked)).otherwise(p))


def _normalized(path: Column) -> Column:
    lead = F.regexp_extract(path, r"^(//(?!/)|/)?", 1)
    steps = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(steps, F.array().cast("array<string>"), lambda done, step: _walk(done, step, path))
    return F.coalesce(F.nullif(F.concat(lead, F.array_join(folded, "/")), F.lit("")), F.lit("."))


def _walk(done: Column, step: Column, path: Column) -> Column:
    """One step of :func:`normalize`: push a name, pop on ``..``, keep ``..`` that climbs out."""
    last = F.try_element_at(done, F.lit(-1))
    can_pop = (F.size(done) > 0) & (last != "..")
    return (
        F.when(step != "..", F.concat(done, F.array(step)))
        .when(can_pop, F.slice(done, F.lit(1), F.size(done) - 1))
        .when(path.startswith("/"), done)
        .otherwise(F.concat(done, F.array(step)))
    )


def normalize_remote(uri: Column | str) -> Column:
    """Normalise a path but keep the ``scheme:/`` of a remote ``scheme://…`` name."""
    def parts(u: Column) -> Column:
        cut = F.when(F.instr(u, "://") > 1, F.instr(u, ":/") + 1).otherwise(F.lit(0))
        return F.struct(u.alias("u"), cut.alias("cut"))

    def join(p: Column) -> Column:
        rest = normalize(F.substr(p["u"], p["cut"] + 1))
        return F.concat(F.substr(p["u"], F.lit(1), p["cut"]), rest)

    return _with(_with(_col(uri), parts), join)


def is_remote(name: Column | str, platform: Column | str) -> Column:
    """Whether ``name`` carries the scheme of ``platform`` (a column of platform keys)."""
    name, platform = _col(name), _col(platform)
    hit = F.lit(False)
    for key, prefix in REMOTE_PREFIX.items():
        hit = hit | ((platform == key) & name.startswith(prefix))
    return hit


def is_sample_file(name: Column | str) -> Column:
    return _col(name).rlike(SAMPLE_FILE_PATTERN)


def object_id(uri: Column | str, platform: Column | str) -> Column:
    """Id part of ``scheme:id/path``."""
    return F.regexp_extract(_body(uri, platform), "^[^/]*", 0)


def object_path(uri: Column | str, platform: Column | str) -> Column:
    """Path part of ``scheme:id/path``; the whole body when it holds no slash."""
    return F.regexp_replace(_body(uri, platform), "^[^/]*/", "")


def _body(uri: Column | str, platform: Column | str) -> Column:
    uri, platform = _col(uri), _col(platform)
    return (
        F.when(platform == "keep", F.replace(uri, F.lit("keep:"), F.lit("")))
        .when(platform == "sbg", F.substring_index(uri, ":", -1))
        .otherwise(F.regexp_replace(uri, "^[^:]*:", ""))
    )


def size_mb(size: Column | str) -> Column:
    return _col(size) / F.lit(1024.0 * 1024.0)


def clean_uri(uri: Column | str, platform: Column | str, input_type: Column | str) -> Column:
    """Form of a remote name that a downstream runner can open."""
    uri, platform, input_type = _col(uri), _col(platform), _col(input_type)
    web = input_type.isin("http", "https")
    scheme = F.substring_index(uri, "://", 1)
    rest = F.substr(uri, F.length(scheme) + 4)
    bucket = F.substring_index(F.substring_index(rest, "/", 1), "@", 1)
    key = F.substr(rest, F.instr(rest, "/") + 1)
    s3 = F.when(web, F.concat(F.lit("https://s3.amazonaws.com/"), bucket, F.lit("/"), key)).otherwise(
        F.concat(scheme, F.lit("://"), bucket, F.lit("/"), key)
    )
    gs = F.when(web, F.replace(uri, F.lit("gs:/"), F.lit("https://storage.googleapis.com"))).otherwise(uri)
    return (
        F.when(platform == "gs", gs)
        .when(platform == "s3", s3)
        .when(platform == "sbg", object_id(uri, platform))
        .when(platform == "dx", object_path(uri, platform))
        .otherwise(uri)
    )


def data_root(fasta: Column | str, build: Column | str) -> Column:
    """Components of ``fasta`` before the last one equal to ``build``; null when there is none."""
    parts = F.split(_col(fasta), "/")
    back = F.array_position(F.reverse(parts), _col(build))
    keep = (F.size(parts) - back).cast("int")
    return F.when((back > 0) & (keep > 0), F.array_join(F.slice(parts, F.lit(1), keep), "/"))


def upload_target(sheet_uri: Column | str) -> Column:
    """``scheme://bucket[@region]/key`` → struct(bucket, folder, region) for the results of a sheet."""
    uri = _col(sheet_uri)
    host = F.regexp_extract(uri, r"^[a-z0-9]+://([^/]*)", 1)
    key = F.regexp_extract(uri, r"^[a-z0-9]+://[^/]*/(.*)$", 1)
    region = F.regexp_extract(host, r"@(.+)$", 1)
    return F.struct(
        F.substring_index(host, "@", 1).alias("bucket"),
        join_path(dirname(key), F.lit("final")).alias("folder"),
        F.nullif(region, F.lit("")).alias("region"),
    )


def object_key(folder: Column | str, path: Column | str) -> Column:
    return F.concat_ws("/", _col(folder), basename(path))


def object_uri(bucket: Column | str, folder: Column | str, path: Column | str) -> Column:
    return F.concat(F.lit("s3://"), _col(bucket), F.lit("/"), _col(folder), F.lit("/"), basename(path))


def zone_region(zone: Column | str) -> Column:
    """Availability zone without its trailing letters."""
    return F.regexp_replace(_col(zone), r"[a-z]+$", "")


def glob_regex(pattern: Column | str, star: str = ".*", any_char: str = ".") -> Column:
    """Java regex for a shell pattern (``*``, ``?``, ``[x]``, ``[!x]``), to be anchored by the caller."""
    text = F.regexp_replace(_col(pattern), r"([\\.^$|()+{}\[\]&~])", r"\\$1")
    # Give closed [..] classes their meaning back; an unclosed bracket stays a literal. A ``]`` right
    # after the opening belongs to the class.
    inner = r"((?:\\\])(?:[^\]\\]|\\[^\]])*|(?:[^\]\\]|\\[^\]])+)\\\]"
    text = F.regexp_replace(text, r"\\\[!" + inner, r"[^$1]")
    text = F.regexp_replace(text, r"\\\[(?!!)" + inner, r"[$1]")
    outside = r"(?!(?:[^\[\]\\]|\\.)*\])"
    text = F.regexp_replace(text, r"\*" + outside, star)
    return F.regexp_replace(text, r"\?" + outside, any_char)
