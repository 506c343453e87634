"""Reference-bundle and path-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stowline.functions import paths as P
from stowline.operators import refs as RF
from stowline.operators import resolve as R
from stowline.operators.platforms import PLATFORMS
from stowline.plans import bindings as B
from stowline.plans import oracle_views as V
from stowline.plans.registry import query
from stowline.sources import files as SF
from stowline.sources import inventory as I

REFS = V.PARTS + """,
r AS (SELECT k, 'hg' || (k // 80) || 'x' AS build, kind, psize FROM parts),
refs AS (SELECT k AS ord, build, psize, 'gs://refs/' || build || '/' || CASE kind
    WHEN 'economy' THEN CASE WHEN psize IN (7, 8) THEN 'seq/' || build || '.fa' WHEN psize = 1 THEN 'seq--v' || k || '-wf.tar.gz' ELSE 'seq/f' || k || '.fai' END
    WHEN 'large' THEN CASE WHEN psize = 1 THEN 'rtg--x' || k || '-wf.tar.gz' WHEN psize < 12 THEN 'rtg/f' || k ELSE 'other/' || k || '.txt' END
    WHEN 'standard' THEN CASE WHEN psize = 1 THEN 'bwa-' || k || '-wf.tar.gz' WHEN psize IN (7, 8) THEN 'bwa/mainIndex' ELSE 'bwa/f' || k || '.sa' END
    WHEN 'promo' THEN CASE WHEN psize < 4 THEN 'viral/v' || k || '.fa' WHEN psize < 25 THEN 'viral/v' || k || '.fai'
        ELSE 'coverage/problem_regions/r' || k || CASE WHEN psize < 40 THEN '.gz' ELSE '.txt' END END
    WHEN 'medium' THEN CASE WHEN psize = 1 THEN 'snpeff--db1-wf.tar.gz' WHEN psize IN (7, 8) THEN 'snpeff/db1/snpEffectPredictor.bin' ELSE 'snpeff/db1/f' || k || '.bin' END
    ELSE CASE WHEN psize < 5 THEN 'versions.csv' WHEN psize < 15 THEN 'rnaseq/t' || psize || '.bed' WHEN psize < 30 THEN 'variation/v' || psize || '.vcf.gz'
        ELSE 'rnaseq/ref-transcripts.gtf' END END AS uri FROM r),
builds AS (SELECT DISTINCT 'hg' || (k // 80) || 'x' AS build, CASE WHEN (k // 80) % 3 = 0 THEN '' ELSE 'bwa' END AS aligner,
    'gs://refs/hg' || (k // 80) || 'x' AS prefix, 'gs://refs/hg' || (k // 80) || 'x/seq' AS base_dir FROM parts)
"""


def _build():
    return F.concat(F.lit("hg"), F.floor(F.col("k") / 80).cast("string"), F.lit("x"))


def ref_catalog(t):
    k, size, build = F.col("k").cast("string"), F.col("psize"), F.col("build")
    text = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
    rules = {
        "economy": F.when(size.isin(7, 8), text("seq/", build, ".fa")).when(size == 1, text("seq--v", k, "-wf.tar.gz"))
                    .otherwise(text("seq/f", k, ".fai")),
        "large": F.when(size == 1, text("rtg--x", k, "-wf.tar.gz")).when(size < 12, text("rtg/f", k))
                  .otherwise(text("other/", k, ".txt")),
        "standard": F.when(size == 1, text("bwa-", k, "-wf.tar.gz")).when(size.isin(7, 8), F.lit("bwa/mainIndex"))
                     .otherwise(text("bwa/f", k, ".sa")),
        "promo": F.when(size < 4, text("viral/v", k, ".fa")).when(size < 25, text("viral/v", k, ".fai"))
                  .when(size < 40, text("coverage/problem_regions/r", k, ".gz"))
                  .otherwise(text("coverage/problem_regions/r", k, ".txt")),
        "medium": F.when(size == 1, F.lit("snpeff--db1-wf.tar.gz"))
                   .when(size.isin(7, 8), F.lit("snpeff/db1/snpEffectPredictor.bin")).otherwise(text("snpeff/db1/f", k, ".bin")),
    }
    rel = (
        F.when(size < 5, F.lit("versions.csv")).when(size < 15, text("rnaseq/t", size.cast("string"), ".bed"))
        .when(size < 30, text("variation/v", size.cast("string"), ".vcf.gz")).otherwise(F.lit("rnaseq/ref-transcripts.gtf")))
    for kind, value in rules.items():
        rel = F.when(F.col("kind") == kind, value).otherwise(rel)
    return B.parts(t).withColumn("build", _build()).select(
        F.col("k").alias("ord"), F.concat(F.lit("gs://refs/"), "build", F.lit("/"), rel).alias("uri"))


def builds(t):
    number = F.floor(F.col("k") / 80)
    return B.parts(t).select(
        _build().alias("build"), F.when(number % 3 == 0, F.lit("")).otherwise(F.lit("bwa")).alias("aligner"),
        F.concat(F.lit("gs://refs/"), _build()).alias("prefix"),
        F.concat(F.lit("gs://refs/"), _build(), F.lit("/seq")).alias("base_dir")).distinct()


STATUS = REFS + """,
kinds AS (SELECT build, aligner, prefix, unnest(['seq', 'rtg', 'bwa']) AS kind FROM builds),
wanted AS (SELECT * FROM kinds WHERE kind <> 'bwa' OR aligner = 'bwa'),
tars AS (SELECT w.*, ord, uri FROM wanted w JOIN refs ON starts_with(uri, prefix) AND ends_with(uri, '-wf.tar.gz')
    AND starts_with(regexp_extract(uri, '[^/]*$'), kind)),
files AS (SELECT w.*, ord, uri, ends_with(uri, '/' || w.build || '.fa') OR ends_with(uri, '/mainIndex') AS is_base
    FROM wanted w JOIN refs ON starts_with(uri, prefix || '/' || kind)),
counts AS (SELECT build, aligner, kind, CASE kind WHEN 'seq' THEN 'fasta' ELSE kind END AS key,
    (SELECT count(*) FROM tars x WHERE x.build = w.build AND x.kind = w.kind) AS n_tar,
    (SELECT count(*) FROM files x WHERE x.build = w.build AND x.kind = w.kind AND is_base) AS n_base,
    (SELECT count(*) FROM files x WHERE x.build = w.build AND x.kind = w.kind) AS n_files FROM wanted w),
status AS (SELECT *, CASE WHEN n_tar > 1 THEN 'too many tarballs' WHEN n_tar = 1 AND kind = aligner THEN 'tarball base'
    WHEN n_tar = 1 THEN 'tarball' WHEN n_base > 1 THEN 'too many bases' WHEN n_base = 1 THEN 'base'
    WHEN n_files = 1 THEN 'single' ELSE 'indexes' END AS form FROM counts)
"""


@query("a21_ref_status", f"WITH {STATUS} SELECT * FROM status")
def a21_status(t):
    return RF.reference_status(builds(t), ref_catalog(t))


@query("a21_ref_bundle", f"""
WITH {STATUS}
SELECT s.build, s.aligner, s.kind, key, unnest(CASE WHEN form = 'tarball base' THEN ['base', 'index'] ELSE ['plain'] END) AS role, ord, uri
FROM status s JOIN tars f ON s.build = f.build AND s.kind = f.kind WHERE form IN ('tarball', 'tarball base')
UNION ALL
SELECT s.build, s.aligner, s.kind, key, CASE WHEN form = 'single' THEN 'plain' WHEN is_base THEN 'base' ELSE 'index' END, ord, uri
FROM status s JOIN files f ON s.build = f.build AND s.kind = f.kind WHERE form IN ('base', 'single', 'indexes')
""")
def a21(t):
    return RF.reference_bundle(builds(t), ref_catalog(t))


@query("a22_viral_bundle", f"""
WITH {REFS},
v AS (SELECT b.build, ord, uri, ends_with(uri, '.fa') AS fa FROM builds b JOIN refs ON starts_with(uri, prefix || '/viral')),
f AS (SELECT *, min(CASE WHEN fa THEN ord END) OVER (PARTITION BY build) AS first_fa FROM v)
SELECT build, CASE WHEN first_fa IS NULL THEN 'no base' WHEN ord = first_fa THEN 'base' ELSE 'index' END AS role, ord, uri
FROM f WHERE first_fa IS NULL OR ord = first_fa OR NOT fa
""")
def a22(t):
    return RF.viral_bundle(builds(t), ref_catalog(t))


@query("a23_db_bundle", f"""
WITH {REFS},
tars AS (SELECT b.build, min(ord) AS ord, min(uri) AS uri FROM builds b JOIN refs ON uri = prefix || '/snpeff--db1-wf.tar.gz' GROUP BY 1 HAVING count(*) = 1),
f AS (SELECT b.build, ord, uri, ends_with(uri, '/snpEffectPredictor.bin') AS is_base FROM builds b JOIN refs ON starts_with(uri, prefix || '/snpeff/db1/')
    WHERE b.build NOT IN (SELECT build FROM tars)),
n AS (SELECT *, count(*) FILTER (is_base) OVER (PARTITION BY build) AS n FROM f)
SELECT build, 'db1' AS db, 'plain' AS role, ord, uri FROM tars
UNION ALL SELECT build, 'db1', CASE WHEN n <> 1 THEN 'bad base' WHEN is_base THEN 'base' ELSE 'index' END, ord, uri FROM n
""")
def a23(t):
    return RF.database_bundle(builds(t).withColumn("db", F.lit("db1")), ref_catalog(t))


@query("a24_context_list", f"""
WITH {REFS}
SELECT b.build, regexp_extract(uri, '[^/]*$') AS name, ord, uri FROM builds b JOIN refs
ON starts_with(uri, prefix || '/coverage/problem_regions') AND ends_with(uri, '.gz')
""")
def a24(t):
    return RF.context_files(builds(t), ref_catalog(t))


@query("a19_companions", f"""
WITH {REFS},
v AS (SELECT b.build, min(ord) AS ord FROM builds b JOIN refs ON uri = prefix || '/versions.csv' GROUP BY 1),
g AS (SELECT b.build, min(ord) AS ord FROM builds b JOIN refs ON uri = prefix || '/rnaseq/t9.bed' GROUP BY 1)
SELECT build, v.ord AS versions_ord, CASE WHEN v.ord IS NOT NULL THEN prefix || '/versions.csv' END AS versions,
    g.ord AS gene_bed_ord, CASE WHEN g.ord IS NOT NULL THEN prefix || '/rnaseq/t9.bed' END AS gene_bed
FROM builds LEFT JOIN v USING (build) LEFT JOIN g USING (build)
""")
def a19(t):
    catalog, base = ref_catalog(t), builds(t)
    named = lambda df, name: df.select(
        "build", F.col("ord").alias(name + "_ord"), F.col("uri").alias(name))
    transcripts = F.concat("prefix", F.lit("/rnaseq/t9.gtf.gz"))
    return named(RF.companion(base, catalog, RF.versions_path()), "versions").join(
        named(RF.companion(base, catalog, RF.gene_bed_path(transcripts)), "gene_bed"), "build")


RESOURCES = """,
res AS (SELECT k AS res_id, 'gs://refs/hg' || (k // 80) || 'x/seq' AS base_dir, CASE k % 2 WHEN 0 THEN 'variation' ELSE 'rnaseq' END AS k1,
    'key' || k AS k2, CASE k % 4 WHEN 0 THEN '../variation/v' || (psize % 35) || '.vcf.gz'
        WHEN 1 THEN '../variation/./x/../v' || (psize % 35) || '.vcf.gz' WHEN 2 THEN 'dbsnp-' || psize
        ELSE '../../hg1x/variation/v' || (psize % 35) || '.vcf.gz' END AS value,
    'gs://refs/hg' || CASE WHEN k % 4 = 3 THEN '1x' ELSE (k // 80) || 'x' END || '/variation/v' || (psize % 35) || '.vcf.gz' AS target FROM parts)
"""


def _resources(t):
    k, n = F.col("k"), (F.col("psize") % 35).cast("string")
    value = (
        F.when(k % 4 == 0, F.concat(F.lit("../variation/v"), n, F.lit(".vcf.gz")))
        .when(k % 4 == 1, F.concat(F.lit("../variation/./x/../v"), n, F.lit(".vcf.gz")))
        .when(k % 4 == 2, F.concat(F.lit("dbsnp-"), F.col("psize").cast("string")))
        .otherwise(F.concat(F.lit("../../hg1x/variation/v"), n, F.lit(".vcf.gz"))))
    return B.parts(t).select(
        k.alias("res_id"), F.concat(F.lit("gs://refs/"), _build(), F.lit("/seq")).alias("base_dir"),
        F.when(k % 2 == 0, F.lit("variation")).otherwise(F.lit("rnaseq")).alias("k1"),
        F.concat(F.lit("key"), k.cast("string")).alias("k2"), value.alias("value"))


@query("a18_relative_resources", f"""
WITH {REFS} {RESOURCES}
SELECT res_id, base_dir, k1, k2, value FROM res WHERE NOT starts_with(value, '../')
UNION ALL SELECT res_id, base_dir, k1, k2, target FROM res WHERE starts_with(value, '../') AND target IN (SELECT uri FROM refs)
    AND starts_with(target, regexp_replace(base_dir, '/seq$', ''))
""")
def a18(t):
    return RF.resolve_relative(_resources(t), ref_catalog(t))


@query("a18_relative_lookup", f"""
WITH {REFS} {RESOURCES}
SELECT res_id, base_dir, k1, k2, value FROM res WHERE NOT starts_with(value, '../')
UNION ALL SELECT res_id, base_dir, k1, k2, uri FROM res JOIN refs ON uri = target WHERE starts_with(value, '../')
""")
def a18_lookup(t):
    return RF.resolve_relative(_resources(t), ref_catalog(t), lookup=True)


#: The reference catalog of platforms with ids: key ``<project>:/<build>/…``, and the name with the file's id before it.
_BY_ID = REFS + """,
ids AS (SELECT ord, build, replace(uri, 'gs://refs/', '/') AS path, 'p' || (ord % 2) AS project, 'f' || ord AS file_id FROM refs),
dx AS (SELECT arg_max(file_id, ord) AS file_id, arg_max(project, ord) AS project, min(ord) AS ord, path FROM ids GROUP BY path),
dxb AS (SELECT build, aligner, 'p' || m || ':' || replace(prefix, 'gs://refs/', '/') AS prefix, 'p' || m || ':' || replace(base_dir, 'gs://refs/', '/') AS base_dir
    FROM builds CROSS JOIN (SELECT unnest([0, 1]) AS m))
"""


def _ids(t):
    return ref_catalog(t).select(
        "ord", F.replace("uri", F.lit("gs://refs/"), F.lit("/")).alias("path"), F.concat(F.lit("p"), (F.col("ord") % 2).cast("string")).alias("project"),
        F.concat(F.lit("f"), F.col("ord").cast("string")).alias("file_id"))


def _dx_catalog(t):
    return I.keyed_last_wins(_ids(t))


def _dx_builds(t):
    """Every build in either project; names come with an id, which the comparison leaves out."""
    dx = PLATFORMS["dx"]
    inside = lambda c: dx.strip(F.concat(F.lit("dx:f7/p"), F.col("_m").cast("string"), F.lit(":"), F.replace(c, F.lit("gs://refs/"), F.lit("/"))))
    return builds(t).withColumn("_m", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.concat_ws("@", "build", "_m").alias("key_build"), "build", "aligner", inside(F.col("prefix")).alias("prefix"), inside(F.col("base_dir")).alias("base_dir"))


@query("a21_bundle_dx", f"""
WITH {_BY_ID},
w AS (SELECT build, aligner, prefix, k AS kind FROM dxb, (SELECT unnest(['seq', 'rtg', 'bwa']) AS k) WHERE prefix LIKE 'p1:%' AND (k <> 'bwa' OR aligner = 'bwa')),
named AS (SELECT ord, project || ':' || path AS key, 'dx:' || file_id || '/' || project || ':' || path AS uri FROM dx),
tars AS (SELECT w.*, ord, uri FROM w JOIN named n ON starts_with(n.key, prefix) AND ends_with(n.key, '-wf.tar.gz') AND starts_with(regexp_extract(n.key, '[^/]*$'), kind)),
files AS (SELECT w.*, ord, uri, ends_with(n.key, '/' || w.build || '.fa') OR ends_with(n.key, '/mainIndex') AS is_base FROM w JOIN named n ON starts_with(n.key, prefix || '/' || kind)),
counts AS (SELECT build, aligner, kind, CASE kind WHEN 'seq' THEN 'fasta' ELSE kind END AS key,
    (SELECT count(*) FROM tars x WHERE x.build = w.build AND x.kind = w.kind) AS n_tar,
    (SELECT count(*) FROM files x WHERE x.build = w.build AND x.kind = w.kind AND is_base) AS n_base,
    (SELECT count(*) FROM files x WHERE x.build = w.build AND x.kind = w.kind) AS n_files FROM w),
status AS (SELECT *, CASE WHEN n_tar > 1 THEN 'bad' WHEN n_tar = 1 AND kind = aligner THEN 'tarball base' WHEN n_tar = 1 THEN 'tarball' WHEN n_base > 1 THEN 'bad'
    WHEN n_base = 1 THEN 'base' WHEN n_files = 1 THEN 'single' ELSE 'indexes' END AS form FROM counts)
SELECT s.build, s.aligner, s.kind, key, unnest(CASE WHEN form = 'tarball base' THEN ['base', 'index'] ELSE ['plain'] END) AS role, ord, uri
FROM status s JOIN tars f ON s.build = f.build AND s.kind = f.kind WHERE form IN ('tarball', 'tarball base')
UNION ALL
SELECT s.build, s.aligner, s.kind, key, CASE WHEN form = 'single' THEN 'plain' WHEN is_base THEN 'base' ELSE 'index' END, ord, uri
FROM status s JOIN files f ON s.build = f.build AND s.kind = f.kind WHERE form IN ('base', 'single', 'indexes')
""")
def a21_dx(t):
    """Bundles of the builds in project p1, compared without file ids."""
    return RF.reference_bundle(_dx_builds(t).filter(F.col("prefix").startswith("p1:")).drop("key_build"), PLATFORMS["dx"].keyed(_dx_catalog(t)))


@query("a19_companions_dx", f"""
WITH {_BY_ID}
SELECT b.build || '@' || substr(prefix, 2, 1) AS build, k.ord AS ord, 'dx:' || file_id || '/' || project || ':' || path AS uri
FROM dxb b LEFT JOIN dx k ON project || ':' || path = prefix || '/versions.csv'
""")
def a19_dx(t):
    named = _dx_builds(t).drop("build").withColumnRenamed("key_build", "build")
    return RF.companion(named, PLATFORMS["dx"].keyed(_dx_catalog(t)), RF.versions_path())


@query("a22_viral_bundle_sbg", f"""
WITH {_BY_ID},
v AS (SELECT b.build, i.ord, 'sbg:' || file_id || '/' || path AS uri, ends_with(path, '.fa') AS fa FROM builds b JOIN ids i
    ON starts_with(path, replace(prefix, 'gs://refs/', '/') || '/viral')),
f AS (SELECT *, min(CASE WHEN fa THEN ord END) OVER (PARTITION BY build) AS first_fa FROM v)
SELECT build, CASE WHEN first_fa IS NULL THEN 'no base' WHEN ord = first_fa THEN 'base' ELSE 'index' END AS role, ord, uri
FROM f WHERE first_fa IS NULL OR ord = first_fa OR NOT fa
""")
def a22_sbg(t):
    return RF.viral_bundle(_sbg_builds(t), PLATFORMS["sbg"].keyed(_ids(t)))


def _sbg_builds(t):
    inside = lambda c: PLATFORMS["sbg"].strip(F.concat(F.lit("sbg:f7/"), F.replace(c, F.lit("gs://refs/"), F.lit("/"))))
    return builds(t).select("build", "aligner", inside(F.col("prefix")).alias("prefix"), inside(F.col("base_dir")).alias("base_dir"))


@query("a18_lookup_sbg", f"""
WITH {_BY_ID} {RESOURCES},
own AS (SELECT res_id, replace(base_dir, 'gs://refs/', '/') AS base_dir, k1, k2, value, replace(target, 'gs://refs/', '/') AS target FROM res),
m AS (SELECT path, 'sbg:' || arg_min(file_id, ord) || '/' || path AS uri FROM ids GROUP BY path)
SELECT res_id, base_dir, k1, k2, value FROM own WHERE NOT starts_with(value, '../')
UNION ALL SELECT res_id, base_dir, k1, k2, uri FROM own JOIN m ON path = target WHERE starts_with(value, '../')
""")
def a18_sbg(t):
    sbg, catalog = PLATFORMS["sbg"], _ids(t)
    asked = _resources(t).withColumn("base_dir", sbg.strip(F.concat(F.lit("sbg:f9/"), F.replace("base_dir", F.lit("gs://refs/"), F.lit("/")))))
    return RF.resolve_relative(asked, sbg.keyed(catalog), lambda names: sbg.find(catalog, names, ()))


@query("a18_lookup_dx", f"""
WITH {_BY_ID} {RESOURCES},
own AS (SELECT res_id, 'p' || (res_id % 2) || ':' || replace(base_dir, 'gs://refs/', '/') AS base_dir, k1, k2, value, 'p' || (res_id % 2) AS project,
    replace(target, 'gs://refs/', '/') AS target FROM res),
m AS (SELECT path, project, 'dx:' || file_id || '/' || project || ':' || path AS uri FROM dx)
SELECT res_id, base_dir, k1, k2, value FROM own WHERE NOT starts_with(value, '../')
UNION ALL SELECT res_id, base_dir, k1, k2, uri FROM own JOIN m ON path = target WHERE starts_with(value, '../') AND own.project = 'p1'
UNION ALL SELECT res_id, base_dir, k1, k2, uri FROM own JOIN m ON path = target AND own.project = m.project
    WHERE starts_with(value, '../') AND own.project <> 'p1' AND starts_with(own.project || ':' || target, regexp_replace(base_dir, '/seq$', ''))
""")
def a18_dx(t):
    """Project p1 is configured: there the lookup finds a path whatever its project. Others are compared by key alone."""
    dx, catalog = PLATFORMS["dx"], _dx_catalog(t)
    inside = F.concat(F.lit("dx:f9/p"), (F.col("res_id") % 2).cast("string"), F.lit(":"), F.replace("base_dir", F.lit("gs://refs/"), F.lit("/")))
    asked = _resources(t).withColumn("base_dir", dx.strip(inside))
    return RF.resolve_relative(asked, dx.keyed(catalog), lambda names: dx.find(catalog, names, ((0, "p1", "/none"),)))


JARS = V.PARTS + """,
sheets AS (SELECT k AS sheet_id, 's3://bk' || (k % 40) || '/proj' || (k % 9) || '/sheet' || k || '.yaml' AS uri FROM parts),
jars AS (SELECT k AS ord, 's3://bk' || (k % 40) || '/' || CASE k % 2 WHEN 0 THEN '' ELSE 'proj' || (k % 9) || '/' END || 'jars/' ||
    CASE kind WHEN 'small' THEN 'GenomeAnalysisTK-' || psize WHEN 'large' THEN 'MuTect-' || psize WHEN 'promo' THEN 'muTect-GenomeAnalysisTK-' || psize ELSE 'other-' || psize END || '.jar' AS uri FROM parts)
"""


@query("a25_jar_class", f"""
WITH {JARS},
dirs AS (SELECT sheet_id, 0 AS level, regexp_extract(uri, '^[^/]*//[^/]*') || '/jars' AS dir FROM sheets
    UNION ALL SELECT sheet_id, 1, regexp_replace(uri, '/[^/]*$', '') || '/jars' FROM sheets),
c AS (SELECT ord, uri, CASE WHEN contains(lower(uri), 'genomeanalysistk') THEN 'gatk' WHEN contains(lower(uri), 'mutect') THEN 'mutect' END AS program FROM jars)
SELECT sheet_id, program, uri FROM dirs JOIN c ON starts_with(uri, dir) WHERE program IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY sheet_id, program ORDER BY level DESC, ord DESC) = 1
""")
def a25(t):
    k, size = F.col("k"), F.col("psize").cast("string")
    bucket = F.concat(F.lit("s3://bk"), (k % 40).cast("string"), F.lit("/"))
    project = F.concat(F.lit("proj"), (k % 9).cast("string"), F.lit("/"))
    tool = (
        F.when(F.col("kind") == "small", F.lit("GenomeAnalysisTK-")).when(F.col("kind") == "large", F.lit("MuTect-"))
        .when(F.col("kind") == "promo", F.lit("muTect-GenomeAnalysisTK-")).otherwise(F.lit("other-")))
    parts = B.parts(t)
    sheets = parts.select(
        k.alias("sheet_id"), F.concat(bucket, project, F.lit("sheet"), k.cast("string"), F.lit(".yaml")).alias("uri"))
    where = F.when(k % 2 == 0, F.lit("")).otherwise(project)
    jars = parts.select(k.alias("ord"), F.concat(bucket, where, F.lit("jars/"), tool, size, F.lit(".jar")).alias("uri"))
    return RF.jar_resources(sheets, jars)


# -- path functions over the web pages and the catalog -------------------------------------------------

PLATFORM = "CASE page_id % 5 WHEN 0 THEN 'gs' WHEN 1 THEN 's3' WHEN 2 THEN 'keep' WHEN 3 THEN 'sbg' ELSE 'dx' END"
WEB = f"""
web AS (SELECT page_id AS ord, {PLATFORM} AS platform, url,
    regexp_replace(url, '^https?://', '') AS rest FROM pages)
"""


def _web(t):
    url = F.col("url")
    platform = F.element_at(F.array(*map(F.lit, ("gs", "s3", "keep", "sbg", "dx"))), (F.col("page_id") % 5 + 1).cast("int"))
    return t.pages.select(F.col("page_id").alias("ord"), platform.alias("platform"), url.alias("url"),
                          F.regexp_replace(url, "^https?://", "").alias("rest"))


@query("a7_is_remote", f"""
WITH {WEB}, n AS (SELECT ord, platform, unnest(['gs://' || rest, 's3:' || rest, 's3://' || rest, 'keep:' || rest, 'sbg:' || rest, 'dx:' || rest, rest]) AS name FROM web)
SELECT ord, platform, name, starts_with(name, CASE platform WHEN 's3' THEN 's3:/' ELSE platform || ':' END) AS remote FROM n
""")
def a7(t):
    heads = [F.concat(F.lit(x), "rest") for x in ("gs://", "s3:", "s3://", "keep:", "sbg:", "dx:", "")]
    return _web(t).select("ord", "platform", F.explode(F.array(*heads)).alias("name")).select(
        "ord", "platform", "name", P.is_remote("name", "platform").alias("remote"))


@query("a8_file_kind", f"""
WITH {V.CATALOG}
SELECT ord, uri FROM catalog WHERE ends_with(uri, '.bam') OR ends_with(uri, '.vcf') OR ends_with(uri, '.vcf.gz')
    OR ends_with(uri, '.fastq') OR ends_with(uri, '.fastq.gz') OR ends_with(uri, '.fq') OR ends_with(uri, '.fq.gz')
""")
def a8(t):
    return B.catalog(t).filter(P.is_sample_file("uri")).select("ord", "uri")


@query("a31_size_mb", f"WITH {V.CATALOG} SELECT ord, uri, size / 1048576.0::DOUBLE AS size_mb FROM catalog")
def a31(t):
    return B.catalog(t).select("ord", "uri", P.size_mb("size").alias("size_mb"))


@query("a32_uri_clean", f"""
WITH {WEB}, u AS (SELECT ord, platform, CASE platform WHEN 'gs' THEN 'gs://' || rest WHEN 's3' THEN 's3://' || CASE WHEN ord % 2 = 0
        THEN split_part(rest, '/', 1) || '@eu-1' || substr(rest, instr(rest, '/')) ELSE rest END
        ELSE platform || ':' || rest END AS uri, rest FROM web),
c AS (SELECT *, unnest(['http', 'file']) AS input_type FROM u)
SELECT ord, platform, input_type, CASE platform
    WHEN 'gs' THEN CASE input_type WHEN 'http' THEN 'https://storage.googleapis.com/' || rest ELSE uri END
    WHEN 's3' THEN CASE input_type WHEN 'http' THEN 'https://s3.amazonaws.com/' ELSE 's3://' END || rest
    WHEN 'sbg' THEN split_part(rest, '/', 1) WHEN 'dx' THEN substr(rest, instr(rest, '/') + 1) ELSE uri END AS cleaned FROM c
""")
def a32(t):
    rest, slash = F.col("rest"), F.instr("rest", "/")
    region = F.concat(F.substring_index(rest, "/", 1), F.lit("@eu-1"), F.substr(rest, slash))
    uri = (
        F.when(F.col("platform") == "gs", F.concat(F.lit("gs://"), rest))
        .when(F.col("platform") == "s3", F.concat(F.lit("s3://"), F.when(F.col("ord") % 2 == 0, region).otherwise(rest)))
        .otherwise(F.concat("platform", F.lit(":"), rest)))
    both = F.explode(F.array(F.lit("http"), F.lit("file"))).alias("input_type")
    return _web(t).select("ord", "platform", uri.alias("uri"), both).select(
        "ord", "platform", "input_type", P.clean_uri("uri", "platform", "input_type").alias("cleaned"))


@query("a33_id_split", f"""
WITH {WEB}, u AS (SELECT ord, platform, CASE platform WHEN 'sbg' THEN 'sbg:x:' WHEN 'dx' THEN 'dx:' ELSE 'keep:' END || rest AS uri, rest FROM web WHERE platform IN ('keep', 'sbg', 'dx'))
SELECT ord, platform, uri, split_part(rest, '/', 1) AS file_id, substr(rest, instr(rest, '/') + 1) AS path FROM u
""")
def a33(t):
    head = F.when(F.col("platform") == "sbg", F.lit("sbg:x:")).when(F.col("platform") == "dx", F.lit("dx:")).otherwise(F.lit("keep:"))
    return _web(t).filter(F.col("platform").isin("keep", "sbg", "dx")).select(
        "ord", "platform", F.concat(head, "rest").alias("uri")).select(
        "ord", "platform", "uri", P.object_id("uri", "platform").alias("file_id"), P.object_path("uri", "platform").alias("path"))


@query("a34_normpath", f"""
WITH {WEB}, n AS (SELECT ord, url, rtrim(rest, '/') AS r FROM web)
SELECT ord, 's3://' || r AS remote, '/data/' || r AS absolute, '../' || r AS relative, r AS plain FROM n
""")
def a34(t):
    rest = F.col("rest")
    dotted = F.concat(F.lit("./x/..//"), rest, F.lit("/./"))
    return _web(t).select(
        "ord",
        P.normalize_remote(F.concat(F.lit("s3://b/../"), rest, F.lit("//"))).alias("remote"),
        P.normalize(F.concat(F.lit("/../data/y/../"), rest)).alias("absolute"),
        P.normalize(F.concat(F.lit("q/../../"), dotted)).alias("relative"),
        P.normalize_remote(dotted).alias("plain"))


@query("a35_path_parts", f"""
WITH {V.CATALOG}
SELECT ord, regexp_extract(uri, '[^/]*$') AS base, regexp_replace(uri, '/[^/]*$', '') AS dir, regexp_extract(uri, '(\\.[^./]*)$', 1) AS ext,
    CASE WHEN ends_with(uri, '.vcf.gz') THEN substr(uri, 1, length(uri) - 7) ELSE regexp_replace(uri, '\\.[^./]*$', '') END AS stem FROM catalog
""")
def a35(t):
    return B.catalog(t).select("ord", P.basename("uri").alias("base"), P.dirname("uri").alias("dir"),
                               P.extension("uri").alias("ext"), P.without_full_extension("uri").alias("stem"))


@query("a36_data_root", f"""
WITH {V.PARTS}, f AS (SELECT k AS ord, kind AS build, CASE k % 3 WHEN 0 THEN '/mnt/' || kind || '/genomes/' || kind || '/seq/' || base
    WHEN 1 THEN '/mnt/bio/' || folder || '/seq/' || base ELSE '/none/' || base END AS fasta FROM parts)
SELECT ord, build, fasta, CASE ord % 3 WHEN 0 THEN '/mnt/' || build || '/genomes' WHEN 1 THEN '/mnt/bio' END AS root FROM f
""")
def a36(t):
    k = F.col("k")
    fasta = (
        F.when(k % 3 == 0, F.concat(F.lit("/mnt/"), "kind", F.lit("/genomes/"), "kind", F.lit("/seq/"), "base"))
        .when(k % 3 == 1, F.concat(F.lit("/mnt/bio/"), "folder", F.lit("/seq/"), "base"))
        .otherwise(F.concat(F.lit("/none/"), "base")))
    return B.parts(t).select(k.alias("ord"), F.col("kind").alias("build"), fasta.alias("fasta")).withColumn(
        "root", P.data_root("fasta", "build"))


@query("a37_upload_dest", f"""
WITH {JARS}
SELECT sheet_id, 'bk' || (sheet_id % 40) AS bucket, CASE sheet_id % 2 WHEN 0 THEN 'proj' || (sheet_id % 9) || '/final' ELSE 'final' END AS folder,
    CASE sheet_id % 2 WHEN 0 THEN 'eu-1' END AS region FROM sheets
""")
def a37(t):
    k = F.col("k")
    deep = F.concat(F.lit("@eu-1/proj"), (k % 9).cast("string"))
    uri = F.concat(F.lit("s3://bk"), (k % 40).cast("string"), F.when(k % 2 == 0, deep).otherwise(F.lit("")),
                   F.lit("/sheet"), k.cast("string"), F.lit(".yaml"))
    return B.parts(t).select(k.alias("sheet_id"), P.upload_target(uri).alias("u")).select("sheet_id", "u.*")


@query("a5_resource_name", f"WITH {V.CATALOG} SELECT ord, regexp_replace(uri, '\\.[^./]*$', '') || '-resources.yaml' AS resources FROM catalog")
def a5(t):
    return B.catalog(t).select("ord", RF.resource_file("uri").alias("resources"))


@query("a5_resource_values", """
SELECT '/refs/' || e.event_type || '/' || (e.user_id % 7) || '.json' AS path, 'aliases' AS k1, 'k' || event_id AS k2, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events e
UNION ALL SELECT '/refs/' || e.event_type || '/' || (e.user_id % 7) || '.json', 'rnaseq', 'transcripts', '../rnaseq/t' || event_id || '.gtf' FROM events e
""")
def a5_values(t):
    eid = F.col("event_id").cast("string")
    path = F.concat(F.lit("/refs/"), "event_type", F.lit("/"), (F.col("user_id") % 7).cast("string"), F.lit(".json"))
    doc = F.concat(F.lit('{"aliases":{"k'), eid, F.lit('":'), F.get_json_object("props", "$.k"),
                   F.lit('},"rnaseq":{"transcripts":"../rnaseq/t'), eid, F.lit('.gtf"}}'))
    return SF.resource_values(t.events.select(path.alias("path"), doc.alias("json")))


@query("b2_last_per_key", f"""
WITH {V.PARTS}, l AS (SELECT '/cfg' || (k % 9) || '/tool-data/sam.loc' AS file, k AS line_no, CASE WHEN psize % 7 = 0 THEN '#' ELSE 'index' END AS tag,
    brand AS build, CASE WHEN psize % 5 = 0 THEN '/abs/' ELSE '../genomes/' || pname[1] || '/' END || kind || '/seq/' || base AS target FROM parts),
last AS (SELECT file, build, arg_max(target, line_no) AS target FROM l WHERE tag = 'index' GROUP BY ALL)
SELECT DISTINCT file, regexp_replace(file, '/tool-data/sam.loc$', '') || '/genomes/' || substr(target, 12, 1) AS folder FROM last WHERE NOT starts_with(target, '/')
""")
def b2(t):
    k, size = F.col("k"), F.col("psize")
    tag = F.when(size % 7 == 0, F.lit("#")).otherwise(F.lit("index"))
    root = F.when(size % 5 == 0, F.lit("/abs/")).otherwise(
        F.concat(F.lit("../genomes/"), F.substr("pname", F.lit(1), F.lit(1)), F.lit("/")))
    line = F.concat(tag, F.lit("\t"), "brand", F.lit(" \t"), root, "kind", F.lit("/seq/"), "base")
    lines = B.parts(t).select(
        F.concat(F.lit("/cfg"), (k % 9).cast("string"), F.lit("/tool-data/sam.loc")).alias("file"), k.alias("line_no"),
        line.alias("value"))
    return SF.genome_folders(lines)
