"""Catalog and name-resolution queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stowline.operators import resolve as R
from stowline.plans import bindings as B
from stowline.plans import oracle_views as V
from stowline.plans.registry import query
from stowline.session import checkpoint_ready
from stowline.sources import inventory as I


@query("a10_resolve_multi", f"""
WITH {V.CATALOG} {V.REQUESTS} {V.MATCHES}
SELECT n.req_id, n.pos, n.name, m.ord, m.uri FROM names n JOIN matches m USING (name)
""")
def a10(t):
    names = R.split_requests(B.requests(t))
    return R.resolve(B.catalog(t).select("ord", "uri"), names).select("req_id", "pos", "name", "ord", "uri")


FOLDER_REQUESTS = """,
asked AS (SELECT k AS req_id, unnest([
        {'pos': 0, 'name': base}, {'pos': 1, 'name': 'p1:' || base}, {'pos': 2, 'name': 'dx:f0/' || brand || '/' || base},
        {'pos': 3, 'name': brand || '/*.' || substr(base, instr(base, '.') + 1)}]) AS n,
    [{'rank': 0, 'project': 'p' || (k % 2), 'folder': '/' || folder},
     {'rank': 1, 'project': 'p0', 'folder': '/' || kind}, {'rank': 2, 'project': 'p1', 'folder': '/small'}] AS folders
    FROM parts),
reqs AS (SELECT req_id * 10 + n.pos AS req_id, n.name AS name, folders,
        CASE WHEN n.pos = 1 THEN 'p1' END AS want_project,
        CASE n.pos WHEN 1 THEN substr(n.name, 4) WHEN 2 THEN substr(n.name, 7) ELSE n.name END AS want FROM asked),
opened AS (SELECT req_id, name, want_project, want, unnest(folders) AS f FROM reqs)
"""


def _folder_requests(t):
    p = B.parts(t)
    ext = F.expr("substr(base, instr(base, '.') + 1)")
    names = F.array(
        F.col("base"), F.concat(F.lit("p1:"), "base"), F.concat(F.lit("dx:f0/"), "brand", F.lit("/"), "base"),
        F.concat("brand", F.lit("/*."), ext))
    folder = lambda rank, project, path: F.named_struct(
        F.lit("rank"), F.lit(rank), F.lit("project"), project, F.lit("folder"), path)
    folders = F.array(
        folder(0, F.concat(F.lit("p"), (F.col("k") % 2).cast("string")), F.concat(F.lit("/"), "folder")),
        folder(1, F.lit("p0"), F.concat(F.lit("/"), "kind")),
        folder(2, F.lit("p1"), F.lit("/small")))
    return p.select("k", folders.alias("folders"), F.posexplode(names).alias("pos", "name")).select(
        (F.col("k") * 10 + F.col("pos")).alias("req_id"), "name", "folders")


@query("a11_resolve_prefix", f"""
WITH {V.CATALOG}, names AS (SELECT DISTINCT unnest([folder, kind, base, '*' || brand || '/' || base]) AS name FROM parts),
targets AS (SELECT name, 'gs://b1/' || name AS target FROM names),
last AS (SELECT name, target, max(ord) AS ord FROM targets JOIN catalog ON starts_with(uri, target) GROUP BY ALL),
matches AS (SELECT n.name, c.ord, c.uri FROM names n JOIN catalog c ON c.uri = n.name OR ends_with(c.uri, '/' || n.name)
    OR (contains(n.name, '*') AND c.uri GLOB ('*/' || n.name)))
SELECT name, ord, target AS uri FROM last
UNION ALL SELECT m.name, m.ord, m.uri FROM matches m LEFT JOIN last l ON m.name = l.name WHERE l.ord IS NULL OR m.ord > l.ord
""")
def a11(t):
    names = B.parts(t).select(
        F.explode(F.array("folder", "kind", "base", F.concat(F.lit("*"), "brand", F.lit("/"), "base"))).alias("name"))
    return R.find_with_prefix(B.catalog(t), names, "gs://b1")


TIER_NAMES = "names AS (SELECT DISTINCT unnest([path, brand || '/' || base, folder, brand, 'no/' || base]) AS name FROM parts)"


def _tier_names(t):
    return B.parts(t).select(F.explode(F.array(
        F.col("path"), F.concat_ws("/", "brand", "base"), F.col("folder"), F.col("brand"),
        F.concat(F.lit("no/"), "base"))).alias("name"))


@query("a12_resolve_two_tier", f"""
WITH {V.OBJECTS}, {TIER_NAMES},
hits AS (SELECT name, 1 AS tier, ord, 'keep:' || container || '/' || path AS uri FROM names JOIN objects ON path = name
    UNION ALL SELECT name, 2, ord, 'keep:' || container || '/' || path FROM names JOIN objects ON ends_with(path, '/' || name))
SELECT name, tier, ord, uri FROM hits QUALIFY row_number() OVER (PARTITION BY name ORDER BY tier, ord) = 1
""")
def a12(t):
    return R.find_first_tiers(B.objects(t), _tier_names(t))


@query("a12_resolve_two_tier_folders", f"""
WITH {V.OBJECTS}, {TIER_NAMES},
dirs AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir FROM objects),
hits AS (SELECT name, 1 AS tier, ord, 'keep:' || container || '/' || name AS uri FROM names JOIN objects ON starts_with(path, name)
    UNION ALL SELECT name, 2, ord, 'keep:' || container || '/' || dir FROM names JOIN dirs ON ends_with(dir, '/' || name))
SELECT name, tier, ord, uri FROM hits QUALIFY row_number() OVER (PARTITION BY name ORDER BY tier, ord) = 1
""")
def a12_folders(t):
    return R.find_first_tiers(B.objects(t), _tier_names(t), folders=True)


@query("a13_resolve_first", f"""
WITH {V.OBJECTS}, names AS (SELECT DISTINCT unnest([path, folder, 'sbg:x/' || path]) AS name FROM parts),
w AS (SELECT name, CASE WHEN starts_with(name, 'sbg:') THEN substr(name, 7) ELSE name END AS want FROM names)
SELECT name, ord, 'sbg:' || file_id || '/' || want AS uri FROM w JOIN objects ON path = want
QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord) = 1
""")
def a13(t):
    return R.find_first(B.objects(t), _first_names(t))


def _first_names(t):
    return B.parts(t).select(
        F.explode(F.array(F.col("path"), F.col("folder"), F.concat(F.lit("sbg:x/"), "path"))).alias("name"))


@query("a13_resolve_first_folders", f"""
WITH {V.OBJECTS}, names AS (SELECT DISTINCT unnest([path, folder, 'sbg:x/' || path]) AS name FROM parts),
w AS (SELECT name, CASE WHEN starts_with(name, 'sbg:') THEN substr(name, 7) ELSE name END AS want FROM names)
SELECT name, ord, 'sbg:' || file_id || '/' || want AS uri FROM w JOIN objects ON starts_with(path, want)
QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord) = 1
""")
def a13_folders(t):
    return R.find_first(B.objects(t), _first_names(t), folders=True)


@query("a14_resolve_folder_order", f"""
WITH {V.KEYED} {FOLDER_REQUESTS},
t1 AS (SELECT req_id, name, 1 AS tier, f.rank AS rank, k.ord, 'dx:' || k.file_id || '/' || k.project || ':' || k.path AS uri
    FROM opened JOIN keyed k ON k.path = f.folder || '/' || want WHERE want_project IS NULL OR want_project = f.project
    QUALIFY row_number() OVER (PARTITION BY req_id, name ORDER BY f.rank, k.ord) = 1),
t2 AS (SELECT req_id, name, 2 AS tier, f.rank AS rank, k.ord, 'dx:' || k.file_id || '/' || k.project || ':' || k.path AS uri
    FROM opened JOIN keyed k ON starts_with(k.path, f.folder || '/')
        AND (ends_with(k.path, '/' || want) OR (contains(want, '*') AND k.path GLOB ('*/' || want)))
    WHERE req_id NOT IN (SELECT req_id FROM t1))
SELECT * FROM t1 UNION ALL SELECT * FROM t2
""")
def a14(t):
    return R.find_in_folders(I.keyed_last_wins(B.keyed_listing(t)), _folder_requests(t))


@query("a14_resolve_folder_mode", f"""
WITH {V.KEYED},
dirs AS (SELECT regexp_replace(path, '/[^/]*$', '') AS path, min(ord) AS ord, arg_max(project, ord) AS project FROM keyed GROUP BY 1),
reqs AS (SELECT k AS req_id, brand AS name, '/' || kind AS folder FROM parts)
SELECT req_id, name, 1 AS tier, 0 AS rank, d.ord, 'dx:None/' || d.project || ':' || d.path AS uri
FROM reqs JOIN dirs d ON d.path = folder || '/' || name
""")
def a14_folders(t):
    folders = F.array(F.struct(F.lit(0).alias("rank"), F.lit("p0").alias("project"),
                               F.concat(F.lit("/"), "kind").alias("folder")))
    asked = B.parts(t).select(
        F.col("k").alias("req_id"), F.col("brand").alias("name"), folders.alias("folders"))
    return R.find_in_folders(R.folder_catalog(I.keyed_last_wins(B.keyed_listing(t))), asked)


@query("a15_base_dir", f"""
WITH {V.LISTING}, asked AS (SELECT k AS req_id, kind || '/../' || path AS name, path FROM parts),
tried AS (SELECT req_id, name, unnest([{{'pos': 0, 'b': '/data/ref'}}, {{'pos': 1, 'b': '/data/in0'}}, {{'pos': 2, 'b': '/data/in1'}}]) AS t, path FROM asked)
SELECT req_id, name, t.pos AS pos, l.path FROM tried JOIN listing l ON l.path = t.b || '/' || tried.path
QUALIFY row_number() OVER (PARTITION BY req_id ORDER BY t.pos) = 1
""")
def a15(t):
    asked = B.parts(t).select(
        F.col("k").alias("req_id"), F.concat("kind", F.lit("/../"), "path").alias("name"), B.bases().alias("bases"))
    return R.first_existing(B.listing(t), asked)


@query("a16_glob_expand", f"""
WITH {V.LISTING},
asked AS (SELECT k AS req_id, CASE k % 3 WHEN 0 THEN split_part(base, '.', 1) WHEN 1 THEN split_part(base, '_', 1)
        ELSE '/data/ref/' || path END AS name, ['/data/ref/' || folder, '/data/in0/' || folder] AS inputs FROM parts),
itself AS (SELECT req_id, name, -1 AS pos, name AS path FROM asked WHERE name IN (SELECT path FROM listing)),
missing AS (SELECT req_id, name, unnest([{{'pos': 0, 'd': inputs[1]}}, {{'pos': 1, 'd': inputs[2]}}]) AS t FROM asked
    WHERE name NOT IN (SELECT path FROM listing))
SELECT * FROM itself UNION ALL
SELECT req_id, name, t.pos, l.path FROM missing JOIN listing l ON starts_with(l.path, CASE WHEN starts_with(name, '/') THEN name ELSE t.d || '/' || name END)
WHERE regexp_matches(l.path, '(\\.bam|\\.(fastq|fq)(\\.gz)?|\\.vcf(\\.gz)?)$')
""")
def a16(t):
    name = (
        F.when(F.col("k") % 3 == 0, F.substring_index("base", ".", 1))
        .when(F.col("k") % 3 == 1, F.substring_index("base", "_", 1))
        .otherwise(F.concat(F.lit("/data/ref/"), "path")))
    inputs = F.array(F.concat(F.lit("/data/ref/"), "folder"), F.concat(F.lit("/data/in0/"), "folder"))
    asked = B.parts(t).select(F.col("k").alias("req_id"), name.alias("name"), inputs.alias("inputs"))
    return R.expand_names(B.listing(t), asked)


@query("a16_glob_folders", f"""
WITH {V.LISTING},
asked AS (SELECT k AS req_id, CASE k % 2 WHEN 0 THEN substr(kind, 1, 2) || '*/' || brand || '/' || split_part(base, '_', 1) ELSE kind || '/?rand#' || substr(brand, 7) || '/../' || brand || '/*' END AS name FROM parts),
tried AS (SELECT req_id, name, unnest([{{'pos': 0, 'd': '/data/ref'}}, {{'pos': 1, 'd': '/data/in[01]'}}]) AS t FROM asked),
files AS (SELECT path, split_part(path, '/', 3) AS base, split_part(path, '/', 4) AS kind, split_part(path, '/', 5) AS brand, split_part(path, '/', 6) AS file FROM listing
    WHERE regexp_matches(path, '(\\.bam|\\.(fastq|fq)(\\.gz)?|\\.vcf(\\.gz)?)$'))
SELECT req_id, name, t.pos AS pos, f.path FROM tried JOIN files f ON (CASE WHEN t.pos = 0 THEN f.base = 'ref' ELSE f.base IN ('in0', 'in1') END)
AND (CASE WHEN req_id % 2 = 0 THEN starts_with(f.kind, substr(name, 1, 2)) AND f.brand = split_part(name, '/', 2) AND starts_with(f.file, split_part(name, '/', 3))
    ELSE f.kind = split_part(name, '/', 1) AND f.brand = split_part(name, '/', 4) END)
""")
def a16_folders(t):
    """Wildcards in folders of names and of inputs; a step up is taken out before folders are walked."""
    even = F.concat(F.substring("kind", 1, 2), F.lit("*/"), "brand", F.lit("/"), F.substring_index("base", "_", 1))
    odd = F.concat("kind", F.lit("/?rand#"), F.expr("substr(brand, 7)"), F.lit("/../"), "brand", F.lit("/*"))
    asked = B.parts(t).select(F.col("k").alias("req_id"), F.when(F.col("k") % 2 == 0, even).otherwise(odd).alias("name"),
                              F.array(F.lit("/data/ref"), F.lit("/data/in[01]")).alias("inputs"))
    return R.expand_names(B.listing(t), asked)


@query("a16_unresolved", f"""
WITH {V.LISTING},
asked AS (SELECT k AS req_id, split_part(base, '_', 1) AS name, '/data/ref/' || folder AS d FROM parts)
SELECT req_id, name FROM asked a WHERE NOT EXISTS (SELECT 1 FROM listing l WHERE starts_with(l.path, d || '/' || name)
    AND regexp_matches(l.path, '(\\.bam|\\.(fastq|fq)(\\.gz)?|\\.vcf(\\.gz)?)$'))
""")
def a16_unresolved(t):
    asked = B.parts(t).select(
        F.col("k").alias("req_id"), F.substring_index("base", "_", 1).alias("name"),
        F.array(F.concat(F.lit("/data/ref/"), "folder")).alias("inputs"))
    return R.unresolved(asked, R.expand_names(B.listing(t), asked)).select("req_id", "name")


@query("a20_exists", f"""
WITH {V.CATALOG}, names AS (SELECT DISTINCT unnest(['gs://b' || (k % 3) || '/' || path, 'gs://b0/' || path]) AS name FROM parts)
SELECT name, name IN (SELECT uri FROM catalog) AS found FROM names
""")
def a20(t):
    uri = lambda bucket: F.concat(F.lit("gs://b"), bucket, F.lit("/"), "path")
    names = B.parts(t).select(F.explode(F.array(uri((F.col("k") % 3).cast("string")), uri(F.lit("0")))).alias("name"))
    return R.exists(B.catalog(t), names)


@query("a20_match_counts", f"""
WITH {V.CATALOG} {V.REQUESTS} {V.MATCHES}
SELECT name, CAST(count(m.ord) AS BIGINT) AS n_matches FROM (SELECT DISTINCT name FROM names) n LEFT JOIN matches m USING (name) GROUP BY name
""")
def a20_counts(t):
    names = R.split_requests(B.requests(t))
    return R.match_counts(names, R.find_all(B.catalog(t).select("ord", "uri"), names))


@query("a26_ref_prefix", f"""
WITH {V.CATALOG}, builds AS (SELECT DISTINCT kind AS build FROM parts),
tries AS (SELECT build, 0 AS rank, build AS name FROM builds UNION ALL SELECT build, 1, 'genomes/' || build FROM builds),
gc AS (SELECT CASE WHEN contains(uri, '/small/') THEN uri WHEN contains(uri, '/promo/') THEN replace(uri, '/promo/', '/x/')
    ELSE replace(uri, '://b1/', '://b1/genomes/') END AS uri FROM catalog),
folders AS (SELECT DISTINCT t.name, 'gs://b1/' || t.name AS path FROM tries t JOIN gc ON starts_with(gc.uri, 'gs://b1/' || t.name))
SELECT build, rank, path FROM tries JOIN folders USING (name) QUALIFY row_number() OVER (PARTITION BY build ORDER BY rank) = 1
""")
def a26(t):
    uri = F.col("uri")
    catalog = B.catalog(t).withColumn("uri", F.when(uri.contains("/small/"), uri).when(
        uri.contains("/promo/"), F.replace(uri, F.lit("/promo/"), F.lit("/x/"))).otherwise(
        F.replace(uri, F.lit("://b1/"), F.lit("://b1/genomes/"))))
    builds = B.parts(t).select(F.col("kind").alias("build")).distinct()
    found = R.find_with_prefix(catalog, R.reference_prefix_names(builds), "gs://b1")
    return R.reference_prefix(builds, found.select("name", F.col("uri").alias("path")))


@query("a30_request_split", f"""
WITH {V.PARTS} {V.REQUESTS}
SELECT req_id, pos, name FROM names
""")
def a30(t):
    return R.split_requests(B.requests(t))


NODES = """
nodes AS (SELECT p_partkey AS id, CASE WHEN p_partkey = 0 THEN -1 ELSE (p_partkey - 1) // 4 END AS parent,
    replace(p_name, ' ', '_') || '_' || p_partkey AS name,
    CASE WHEN p_partkey * 4 + 1 <= (SELECT max(p_partkey) FROM part) THEN 'folder' ELSE 'file' END AS type FROM part)
"""


def _nodes(t):
    key = F.col("p_partkey")
    top = t.part.agg(F.max(key)).scalar()
    return t.part.select(
        key.alias("id"), F.when(key == 0, F.lit(-1)).otherwise(F.floor((key - 1) / 4)).cast("long").alias("parent"),
        F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), key.cast("string")).alias("name"),
        F.when(key * 4 + 1 <= top, F.lit("folder")).otherwise(F.lit("file")).alias("type"))


@query("a2_folder_paths", f"""
WITH RECURSIVE {NODES},
walk AS (SELECT id, name AS path, type FROM nodes WHERE parent = 0
    UNION ALL SELECT n.id, w.path || '/' || n.name, n.type FROM nodes n JOIN walk w ON n.parent = w.id)
SELECT id, path FROM walk WHERE type = 'file'
""")
def a2(t):
    return I.expand_folders(_nodes(t), 0)


@query("a2_start_folder", f"""
WITH {NODES}
SELECT a.parent AS root, a.name || '/' || b.name || '/' AS path, b.id AS id FROM nodes b JOIN nodes a ON b.parent = a.id WHERE a.parent >= 0
UNION ALL SELECT parent, '', parent FROM nodes WHERE parent >= 0 GROUP BY parent
""")
def a2_start(t):
    """Every node is looked for from two levels above it, and every folder from itself."""
    nodes = _nodes(t)
    above = nodes.select(F.col("id").alias("parent"), F.col("parent").alias("root"), F.col("name").alias("_name"))
    asked = nodes.join(above, "parent").filter("root >= 0").select("root", F.concat("_name", F.lit("/"), "name", F.lit("/")).alias("path"))
    own = nodes.filter("parent >= 0").select(F.col("parent").alias("root"), F.lit("").alias("path")).distinct()
    return I.find_folders(nodes, asked.unionByName(own))


CONFIGS = """
configs AS (SELECT n_nationkey AS cfg_id, CASE n_nationkey % 5 WHEN 0 THEN 'gs' WHEN 1 THEN 's3' WHEN 2 THEN 'keep' WHEN 3 THEN 'dx' ELSE 'sbg' END AS platform,
    lower(r_name) || '/ref' AS ref, [lower(n_name) || '/in', 'shared', lower(n_name) || '/in'] AS inputs, ['fold'] AS folders,
    'p' || n_regionkey AS project, CASE WHEN n_nationkey % 2 = 0 THEN 'refproj' ELSE '' END AS ref_project,
    CASE WHEN n_nationkey % 3 = 0 THEN 'eu-1' ELSE '' END AS region FROM nation JOIN region ON n_regionkey = r_regionkey)
"""


def _configs(t):
    key = F.col("n_nationkey")
    inp = F.concat(F.lower("n_name"), F.lit("/in"))
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        key.alias("cfg_id"), F.element_at(F.array(*map(F.lit, ("gs", "s3", "keep", "dx", "sbg"))), key % 5 + 1).alias("platform"),
        F.concat(F.lower("r_name"), F.lit("/ref")).alias("ref"), F.array(inp, F.lit("shared"), inp).alias("inputs"),
        F.array(F.lit("fold")).alias("folders"), F.concat(F.lit("p"), F.col("n_regionkey").cast("string")).alias("project"),
        F.when(key % 2 == 0, F.lit("refproj")).otherwise(F.lit("")).alias("ref_project"),
        F.when(key % 3 == 0, F.lit("eu-1")).otherwise(F.lit("")).alias("region"))


@query("a3_catalog_roots", f"""
WITH {CONFIGS},
lists AS (
    SELECT cfg_id, platform, [ref] || inputs AS roots, NULL::VARCHAR[] AS projects FROM configs WHERE platform = 'gs'
    UNION ALL SELECT cfg_id, platform, list_transform(folders || inputs || [ref], lambda f: CASE WHEN region = '' THEN f
        ELSE 's3://' || split_part(f, '/', 1) || '@' || region || '/' || CASE WHEN contains(f, '/') THEN substr(f, instr(f, '/') + 1) ELSE '' END END), NULL
        FROM configs WHERE platform = 's3'
    UNION ALL SELECT cfg_id, platform, list_sort(list_distinct([ref] || inputs)), NULL FROM configs WHERE platform = 'keep'
    UNION ALL SELECT cfg_id, platform, [ref] || inputs, [CASE WHEN ref_project = '' THEN project ELSE ref_project END, project, project, project]
        FROM configs WHERE platform = 'dx'
    UNION ALL SELECT cfg_id, platform, inputs || inputs, [project, project, project, ref, ref, ref] FROM configs WHERE platform = 'sbg')
SELECT cfg_id, platform, CAST(i - 1 AS INTEGER) AS rank, projects[i] AS project, roots[i] AS root
FROM (SELECT *, unnest(range(1, len(roots) + 1)) AS i FROM lists)
""")
def a3(t):
    return I.catalog_roots(_configs(t))


@query("a4_keyed_last_wins", f"""
WITH {V.KEYED} SELECT path, ord, project, file_id FROM keyed
""")
def a4(t):
    return I.keyed_last_wins(B.keyed_listing(t))


@query("a6_prefix_list", f"""
WITH {V.CATALOG}, prefixes AS (SELECT DISTINCT unnest(['gs://b1/' || kind, 'gs://b2/' || folder, 'gs://b0/' || kind || '/Brand#1']) AS prefix FROM parts)
SELECT prefix, ord, uri FROM prefixes JOIN catalog ON starts_with(uri, prefix)
""")
def a6(t):
    prefixes = B.parts(t).select(F.explode(F.array(
        F.concat(F.lit("gs://b1/"), "kind"), F.concat(F.lit("gs://b2/"), "folder"),
        F.concat(F.lit("gs://b0/"), "kind", F.lit("/Brand#1")))).alias("prefix"))
    return I.under_prefixes(B.catalog(t).select("ord", "uri"), prefixes).select("prefix", "ord", "uri")


@query("a6_prefix_scan", f"WITH {V.CATALOG} SELECT ord, uri FROM catalog WHERE starts_with(uri, 'gs://b1/economy/Brand#1')")
def a6_scan(t):
    """One prefix over a stored catalog: the condition reaches the files, whose statistics leave most of them out."""
    checkpoint_ready(t.spark)
    out = f"{t.spark.sparkContext.getCheckpointDir()}/catalog-{uuid.uuid4().hex}"
    I.write_catalog(B.catalog(t).select("ord", "uri"), out)
    return I.under_prefix(t.spark.read.parquet(out), "gs://b1/economy/Brand#1")


@query("a6_prefix_list_by_id", f"""
WITH {V.KEYED}, prefixes AS (SELECT DISTINCT 'dx:f1/p' || (k % 2) || ':/' || folder AS prefix FROM parts)
SELECT prefix, ord, 'dx:' || file_id || '/' || project || ':' || path AS uri
FROM prefixes JOIN keyed ON starts_with(project || ':' || path, substr(prefix, 7))
""")
def a6_by_id(t):
    prefixes = B.parts(t).select(F.concat(
        F.lit("dx:f1/p"), (F.col("k") % 2).cast("string"), F.lit(":/"), "folder").alias("prefix"))
    return I.under_object_prefix(I.keyed_last_wins(B.keyed_listing(t)), prefixes, "dx")


@query("a27_catalog_union", f"""
WITH {V.PARTS}, listings AS (SELECT 'b' || (k % 3) AS root, k AS ord, path AS uri FROM parts),
roots AS (SELECT * FROM (VALUES ('b1', 0), ('b0', 1), ('b1', 2)) v(root, rank))
SELECT rank, ord, uri FROM roots JOIN listings USING (root)
""")
def a27(t):
    listings = B.objects(t).select(F.col("container").alias("root"), "ord", F.col("path").alias("uri"))
    roots = t.spark.createDataFrame([("b1", 0), ("b0", 1), ("b1", 2)], "root string, rank int")
    return I.union_catalogs(listings, roots)
