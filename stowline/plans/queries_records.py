"""Nested-record and transfer-plan queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stowline.operators import records as RC
from stowline.operators import resolve as R
from stowline.operators import transfer as TR
from stowline.plans import bindings as B
from stowline.plans import lifecycle as LC
from stowline.plans import oracle_views as V
from stowline.plans.registry import query
from stowline.session import checkpoint_ready
from stowline.sources import files as SF
from stowline.sources import inventory as I

RECORDS = """
recs AS (SELECT k AS rec_id, unnest([
    {'ctx': 'algorithm.depth', 'pos': '0.0', 'kind': 'number', 'value': CAST(psize AS VARCHAR)},
    {'ctx': 'algorithm.variant_regions', 'pos': '0.1', 'kind': 'string', 'value': '/data/ref/' || path},
    {'ctx': 'algorithm.variantcaller', 'pos': '0.2', 'kind': 'string', 'value': base},
    {'ctx': 'analysis', 'pos': '1', 'kind': 'string', 'value': 'variant.bam'},
    {'ctx': 'attrs', 'pos': '2', 'kind': 'object', 'value': '{}'},
    {'ctx': 'description', 'pos': '3', 'kind': 'string', 'value': kind || '-' || k},
    {'ctx': 'files', 'pos': '4.0', 'kind': 'string', 'value': brand || '/' || base},
    {'ctx': 'files', 'pos': '4.1', 'kind': 'string', 'value': 'miss_' || k || '.bam'},
    {'ctx': 'flag', 'pos': '5', 'kind': 'boolean', 'value': 'true'},
    {'ctx': 'nest.p', 'pos': '6.0.0.0', 'kind': 'string', 'value': '/data/in0/' || path},
    {'ctx': 'nest', 'pos': '6.0.1', 'kind': 'null', 'value': 'null'},
    {'ctx': 'nest', 'pos': '6.1', 'kind': 'string', 'value': 'x'},
    {'ctx': 'note', 'pos': '7', 'kind': 'null', 'value': 'null'},
    {'ctx': 'only', 'pos': '8.0', 'kind': 'null', 'value': 'null'},
    {'ctx': 'reference.alt.v', 'pos': '9.0.0', 'kind': 'null', 'value': 'null'},
    {'ctx': 'reference.fasta.base', 'pos': '9.1.0', 'kind': 'string', 'value': '/mnt/bio/' || folder || '/seq/' || base},
    {'ctx': 'tags', 'pos': '10', 'kind': 'array', 'value': '[]'}]) AS l FROM parts),
leaves AS (SELECT rec_id, l.ctx AS ctx, l.pos AS pos, l.kind AS kind, l.value AS value FROM recs)
"""


def records(t):
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    c, k = F.col, F.col("k").cast("string")
    member = lambda key, value: F.concat(F.lit(f'"{key}":'), value)
    algorithm = F.concat(
        F.lit("{"), member("variantcaller", q(c("base"))), F.lit(","),
        member("variant_regions", q(F.concat(F.lit("/data/ref/"), "path"))), F.lit(","),
        member("depth", c("psize").cast("string")), F.lit("}"))
    files = F.concat(F.lit("["), q(F.concat("brand", F.lit("/"), "base")), F.lit(","),
                     q(F.concat(F.lit("miss_"), k, F.lit(".bam"))), F.lit("]"))
    fasta = F.concat(F.lit('{"fasta":{"base":'), q(F.concat(F.lit("/mnt/bio/"), "folder", F.lit("/seq/"), "base")),
                     F.lit('},"alt":{"v":null}}'))
    nest = F.concat(F.lit('[[{"p":'), q(F.concat(F.lit("/data/in0/"), "path")), F.lit('},null],"x"]'))
    whole = F.concat(
        F.lit("{"), F.concat_ws(
            ",", member("description", q(F.concat("kind", F.lit("-"), k))), member("analysis", q(F.lit("variant.bam"))),
            member("files", files), member("algorithm", algorithm), member("reference", fasta), member("tags", F.lit("[]")),
            member("attrs", F.lit("{}")), member("nest", nest), member("note", F.lit("null")),
            member("only", F.lit("[null]")), member("flag", F.lit("true"))), F.lit("}"))
    return B.parts(t).select(F.col("k").alias("rec_id"), whole.alias("json"))


def leaves(t):
    return RC.flatten(records(t))


def shown(df, *extra):
    return df.select("rec_id", F.array_join(RC.ctx(), ".").alias("ctx"), F.array_join(RC.pos().cast("array<string>"), ".").alias("pos"),
                     "kind", "value", *extra)


@query("b8_tree_leaves", f"WITH {V.PARTS}, {RECORDS} SELECT * FROM leaves")
def b8(t):
    return shown(leaves(t))


@query("b8_event_props", "SELECT event_id AS rec_id, 'k' AS ctx, '0' AS pos, 'number' AS kind, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events")
def b8_events(t):
    return shown(RC.flatten(t.events.select(F.col("event_id").alias("rec_id"), F.col("props").alias("json"))))


@query("b8_conversation_leaves", """
SELECT conv_id * 1000 + turn AS rec_id, unnest(['role', 'turns', 'turns', 'turns.text']) AS ctx, unnest(['0', '1.0', '1.1', '1.2.0']) AS pos,
    unnest(['string', 'number', 'null', 'string']) AS kind, unnest([role, CAST(turn AS VARCHAR), 'null', text]) AS value FROM conversations
""")
def b8_conversations(t):
    tree = F.to_json(F.named_struct(F.lit("role"), F.col("role"), F.lit("text"), F.col("text")))
    pick = lambda name: F.get_json_object(tree, "$." + name)
    quoted = lambda name: F.regexp_replace(F.to_json(F.struct(pick(name).alias("v"))), r'^\{"v":(.*)\}$', "$1")
    json = F.concat(F.lit('{"turns":['), F.col("turn").cast("string"), F.lit(',null,{"text":'), quoted("text"),
                    F.lit('}],"role":'), quoted("role"), F.lit("}"))
    rows = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("rec_id"), json.alias("json"))
    return shown(RC.flatten(rows))


_RECORD_JSON = f"""
WITH {V.PARTS}
SELECT k AS rec_id, '{{"algorithm":{{"depth":' || psize || ',"variant_regions":"/data/ref/' || path || '","variantcaller":"' || base
    || '"}},"analysis":"variant.bam","attrs":{{}},"description":"' || kind || '-' || k || '","files":["' || brand || '/' || base
    || '","miss_' || k || '.bam"],"flag":true,"nest":[[{{"p":"/data/in0/' || path || '"}},null],"x"],"note":null,"only":[null],'
    || '"reference":{{"alt":{{"v":null}},"fasta":{{"base":"/mnt/bio/' || folder || '/seq/' || base || '"}}}},"tags":[]}}' AS json FROM parts
"""


@query("b8_rebuild", _RECORD_JSON)
def b8_rebuild(t):
    return RC.rebuild(leaves(t))


@query("c9_records", f"SELECT json FROM ({_RECORD_JSON})")
def c9(t):
    """Records written as JSON lines and read again."""
    checkpoint_ready(t.spark)
    out = SF.ready_path(f"{t.spark.sparkContext.getCheckpointDir()}/sheet-{uuid.uuid4().hex}.json")
    SF.write_records(RC.rebuild(leaves(t)), out)
    return t.spark.read.text(out).select(F.col("value").alias("json"))


@query("b1_sheet_samples", """
SELECT '/s/' || conv_id || '.json' AS path, CAST(i AS INTEGER) AS pos, '{"turn":' || (turn + i) || ',"role":"' || role || '"}' AS sample, '{"fc_name":"c' || conv_id || '"}' AS sheet
FROM (SELECT *, unnest([0, 1]) AS i FROM conversations)
""")
def b1(t):
    sample = lambda i: F.concat(F.lit('{"turn":'), (F.col("turn") + i).cast("string"), F.lit(',"role":"'), "role", F.lit('"}'))
    conv = F.col("conv_id").cast("string")
    json = F.concat(F.lit('{"fc_name":"c'), conv, F.lit('","details":['), sample(0), F.lit(","), sample(1), F.lit("]}"))
    return SF.sheet_samples(t.conversations.select(
        F.concat(F.lit("/s/"), conv, F.lit(".json")).alias("path"), json.alias("json")))


@query("b3_ignored_keys", f"""
WITH {V.PARTS}, {RECORDS} SELECT * FROM leaves WHERE ctx NOT IN ('analysis', 'description', 'algorithm.variantcaller')
""")
def b3(t):
    rows = RC.without_keys(leaves(t), list(RC.IGNORED_SAMPLE_KEYS))
    return shown(RC.without_keys(rows, list(RC.IGNORED_ALGORITHM_KEYS), under="algorithm"))


@query("c2_null_prune", f"""
WITH {V.PARTS}, {RECORDS} SELECT * FROM leaves WHERE kind NOT IN ('null', 'object')
UNION ALL SELECT rec_id, 'only', '8', 'array', '[]' FROM leaves WHERE ctx = 'only'
""")
def c2(t):
    return shown(RC.prune_nulls(leaves(t)))


@query("a17_fill_refs", f"""
WITH {V.CATALOG}, {RECORDS}, {V.LISTING_ONLY},
cand AS (SELECT *, CASE WHEN kind = 'string' AND regexp_matches(value, '\\.[^./]*$') AND NOT starts_with(value, 'gs:')
    AND value NOT IN (SELECT path FROM listing) THEN value END AS name FROM leaves),
m AS (SELECT n.name, c.ord, c.uri, count(*) OVER (PARTITION BY n.name) AS n FROM (SELECT DISTINCT name FROM cand) n
    JOIN catalog c ON c.uri = n.name OR ends_with(c.uri, '/' || n.name))
SELECT rec_id, ctx, CASE WHEN n > 1 THEN pos || '.' || ord ELSE pos END AS pos, kind, coalesce(uri, value) AS value, uri IS NOT NULL AS filled
FROM cand LEFT JOIN m USING (name)
""")
def a17(t):
    return shown_filled(LC.fill_records(labelled(leaves(t)), B.catalog(t).select("ord", "uri"), B.listing(t), "gs"))


def labelled(df):
    """Leaves with the texts of :func:`shown`, so that a leaf that becomes a long list has them made once."""
    return shown(df, "path").withColumn("_item", F.lit(None).cast("string"))


def shown_filled(df):
    """:func:`shown` for filled leaves of :func:`labelled`: the position of a list's item ends with its number. Paths are not read."""
    item = F.concat("pos", F.lit("."), "_item")
    return df.select("rec_id", "ctx", F.when(F.col("_item").isNotNull(), item).otherwise(F.col("pos")).alias("pos"), "kind", "value", "filled")


def _candidates(scheme: str) -> str:
    """SQL for the leaves with the name that each asks for."""
    return f"""{V.LISTING_ONLY},
cand AS (SELECT *, CASE WHEN kind = 'string' AND regexp_matches(value, '\\.[^./]*$') AND NOT starts_with(value, '{scheme}:')
    AND value NOT IN (SELECT path FROM listing) THEN value END AS name FROM leaves),
wanted AS (SELECT DISTINCT name FROM cand WHERE name IS NOT NULL)
"""


#: SQL for the leaves filled with at most one match each, ``m (name, uri)``.
_FILLED_ONCE = "SELECT rec_id, ctx, pos, kind, coalesce(uri, value) AS value, uri IS NOT NULL AS filled FROM cand LEFT JOIN m USING (name)"


@query("a17_fill_refs_keep", f"""
WITH {V.OBJECTS}, {RECORDS}, {_candidates("keep")},
hits AS (SELECT name, 1 AS tier, ord, container, path FROM wanted JOIN objects ON path = name
    UNION ALL SELECT name, 2, ord, container, path FROM wanted JOIN objects ON ends_with(path, '/' || name)),
m AS (SELECT name, 'keep:' || container || '/' || path AS uri FROM hits QUALIFY row_number() OVER (PARTITION BY name ORDER BY tier, ord) = 1)
{_FILLED_ONCE}
""")
def a17_keep(t):
    return shown(LC.fill_records(leaves(t), B.objects(t), B.listing(t), "keep"), "filled")


@query("a17_fill_refs_sbg", f"""
WITH {V.PARTS}, {RECORDS}, {_candidates("sbg")},
m AS (SELECT w.name, 'sbg:f' || min(k) || '/' || w.name AS uri FROM wanted w JOIN parts p ON p.brand || '/' || p.base = w.name GROUP BY w.name)
{_FILLED_ONCE}
""")
def a17_sbg(t):
    short = B.parts(t).select(F.col("k").alias("ord"), F.concat(F.lit("f"), F.col("k").cast("string")).alias("file_id"),
                              F.concat_ws("/", "brand", "base").alias("path"))
    return shown(LC.fill_records(leaves(t), short, B.listing(t), "sbg"), "filled")


DX_FOLDERS = ((0, "p0", "/economy"), (1, "p1", "/promo"), (2, "p1", "/small/Brand#11"))
_DX_PLACES = "places AS (SELECT * FROM (VALUES " + ", ".join(map(str, DX_FOLDERS)) + ") v(rank, project, folder))"


@query("a17_fill_refs_dx", f"""
WITH {V.KEYED}, {RECORDS}, {_candidates("dx")}, {_DX_PLACES},
t1 AS (SELECT name, rank, ord, file_id, k.project, path FROM wanted CROSS JOIN places p JOIN keyed k ON path = folder || '/' || name
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY rank, ord) = 1),
t2 AS (SELECT name, rank, ord, file_id, k.project, path FROM wanted CROSS JOIN places p JOIN keyed k ON starts_with(path, folder || '/') AND ends_with(path, '/' || name)
    WHERE name NOT IN (SELECT name FROM t1)),
m AS (SELECT name, rank * 1099511627776 + ord AS ord, 'dx:' || file_id || '/' || project || ':' || path AS uri, count(*) OVER (PARTITION BY name) AS n
    FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2))
SELECT rec_id, ctx, CASE WHEN n > 1 THEN pos || '.' || ord ELSE pos END AS pos, kind, coalesce(uri, value) AS value, uri IS NOT NULL AS filled
FROM cand LEFT JOIN m USING (name)
""")
def a17_dx(t):
    catalog = I.keyed_last_wins(B.keyed_listing(t))
    return shown(LC.fill_records(leaves(t), catalog, B.listing(t), "dx", DX_FOLDERS), "filled")


LOCAL_BASES = ("/data/ref/economy", "/data/in0/promo", "/data/in1/small")


@query("a17_fill_refs_local", f"""
WITH {V.PARTS}, {RECORDS}, {_candidates("local")},
bases AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{b}')" for i, b in enumerate(LOCAL_BASES))}) v(pos, base)),
m AS (SELECT name, path AS uri FROM wanted CROSS JOIN bases JOIN listing ON path = CASE WHEN starts_with(name, '/') THEN name ELSE base || '/' || name END
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY bases.pos) = 1)
{_FILLED_ONCE}
""")
def a17_local(t):
    files = B.listing(t)
    return shown(LC.fill_records(leaves(t), files, files, "local", LOCAL_BASES), "filled")


@query("a17_fill_refs_sets", f"""
WITH {V.CATALOG}, {RECORDS}, {_candidates("gs")},
hits AS (SELECT n.name, c.ord, c.uri FROM wanted n JOIN catalog c ON c.uri = n.name OR ends_with(c.uri, '/' || n.name)),
m AS (SELECT name, CASE WHEN count(*) = 1 THEN min(uri) END AS uri, CASE WHEN count(*) > 1 THEN name END AS set_id FROM hits GROUP BY name)
SELECT rec_id, ctx, pos, kind, coalesce(uri, value) AS value, m.name IS NOT NULL AS filled, set_id FROM cand LEFT JOIN m USING (name)
""")
def a17_sets(t):
    """As many rows as leaves; lists are named, not copied."""
    filled, _ = LC.fill_records(leaves(t), B.catalog(t).select("ord", "uri"), B.listing(t), "gs", encoded=True)
    return shown(filled, "filled", "set_id")


@query("a9_path_candidates", f"""
WITH {V.LISTING}, {RECORDS}
SELECT * FROM leaves WHERE kind = 'string' AND regexp_matches(value, '\\.[^./]*$') AND value NOT IN (SELECT path FROM listing)
""")
def a9(t):
    return shown(R.drop_existing(leaves(t).filter(R.is_candidate("value", F.lit("gs"))), B.listing(t)))


REMAP = """,
remap AS (SELECT DISTINCT '/data/ref/' || folder AS src, '/mnt/' || brand || '/' || kind AS dst FROM parts
    UNION SELECT DISTINCT '/data/ref/' || kind, '/kinds/' || kind FROM parts UNION SELECT '/data/in0', '/zero')
"""


def remap_table(t):
    p = B.parts(t)
    deep = p.select(F.concat(F.lit("/data/ref/"), "folder").alias("src"),
                    F.concat(F.lit("/mnt/"), "brand", F.lit("/"), "kind").alias("dst"))
    shallow = p.select(F.concat(F.lit("/data/ref/"), "kind").alias("src"), F.concat(F.lit("/kinds/"), "kind").alias("dst"))
    fixed = p.select(F.lit("/data/in0").alias("src"), F.lit("/zero").alias("dst"))
    return deep.union(shallow).union(fixed).distinct()


@query("b4_longest_prefix", f"""
WITH {V.LISTING} {REMAP},
hits AS (SELECT path, src, dst FROM listing JOIN remap ON starts_with(path, src)
    QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(src) DESC) = 1)
SELECT l.path, coalesce(replace(l.path, src, dst), l.path) AS remapped, src IS NOT NULL AS matched FROM listing l LEFT JOIN hits USING (path)
""")
def b4(t):
    return RC.remap_longest(B.listing(t), "path", remap_table(t))


@query("b4_remap_records", f"""
WITH {V.PARTS} {REMAP}, {RECORDS},
hits AS (SELECT rec_id, pos, src, dst FROM leaves JOIN remap ON kind = 'string' AND starts_with(value, src)
    WHERE NOT (ctx = 'algorithm.variantcaller')
    QUALIFY row_number() OVER (PARTITION BY rec_id, pos ORDER BY length(src) DESC) = 1)
SELECT rec_id, ctx, pos, kind, coalesce(replace(value, src, dst), value) AS value, src IS NOT NULL AS matched FROM leaves LEFT JOIN hits USING (rec_id, pos)
""")
def b4_records(t):
    return shown(RC.remap_leaves(leaves(t), remap_table(t), ["variantcaller"]), "matched")


MOUNTS = """,
mounts AS (SELECT k AS ord, '/ext/' || kind || '/' || (k % 50) AS ext, '/docker/' || (k % 70) AS inner_dir FROM parts)
"""


def _mounts(t):
    k = F.col("k")
    return B.parts(t).select(k.alias("ord"), F.concat(
        F.lit("/ext/"), "kind", F.lit("/"), (k % 50).cast("string"), F.lit(":/docker/"), (k % 70).cast("string")).alias("mount"))


@query("b5_inverse_remap", f"""
WITH {V.PARTS} {MOUNTS},
back AS (SELECT inner_dir AS src, arg_max(ext, ord) AS dst FROM mounts GROUP BY 1),
f AS (SELECT k AS ord, '/docker/' || (k % 90) || '/' || base AS fname FROM parts),
h AS (SELECT * FROM f JOIN back ON starts_with(fname, src) QUALIFY row_number() OVER (PARTITION BY ord ORDER BY length(src) DESC) = 1)
SELECT f.ord, f.fname, coalesce(replace(f.fname, src, dst), f.fname) AS remapped, src IS NOT NULL AS matched FROM f LEFT JOIN h USING (ord)
""")
def b5(t):
    files = B.parts(t).select(F.col("k").alias("ord"), F.concat(
        F.lit("/docker/"), (F.col("k") % 90).cast("string"), F.lit("/"), "base").alias("fname"))
    return RC.remap_longest(files, "fname", RC.parse_mounts(_mounts(t), inward=False))


@query("b5_mount_maps", f"""
WITH {V.PARTS} {MOUNTS} SELECT 'in' AS way, ext AS src, arg_max(inner_dir, ord) AS dst FROM mounts GROUP BY ALL
UNION ALL SELECT 'out', inner_dir, arg_max(ext, ord) FROM mounts GROUP BY ALL
""")
def b5_maps(t):
    mounts = _mounts(t)
    named = lambda way, df: df.select(F.lit(way).alias("way"), "src", "dst")
    return named("in", RC.parse_mounts(mounts)).unionByName(named("out", RC.parse_mounts(mounts, inward=False)))


SHEETS = """,
sheets AS (SELECT k AS rec_id, unnest([
    {'ctx': 'fasta', 'pos': '0', 'v': '/data/ref/' || path}, {'ctx': 'files', 'pos': '1.0', 'v': '/data/in1/' || path},
    {'ctx': 'files', 'pos': '1.1', 'v': '/elsewhere/' || k || '/' || base}, {'ctx': 'phasing', 'pos': '2', 'v': '/data/ref/' || path},
    {'ctx': 'sub.bed', 'pos': '3.0', 'v': '/data/in0/' || path}, {'ctx': 'rel', 'pos': '4', 'v': path}]) AS l FROM parts)
"""


def _sheets(t):
    k = F.col("k").cast("string")
    json = F.concat(
        F.lit('{"fasta":"/data/ref/'), "path", F.lit('","files":["/data/in1/'), "path", F.lit('","/elsewhere/'), k, F.lit("/"),
        "base", F.lit('"],"phasing":"/data/ref/'), "path", F.lit('","rel":"'), "path", F.lit('","sub":{"bed":"/data/in0/'), "path", F.lit('"}}'))
    return B.parts(t).select(F.col("k").alias("rec_id"), json.alias("json"))


@query("b6_dir_harvest", f"""
WITH {V.LISTING} {SHEETS},
one AS (SELECT rec_id, l.v AS v FROM sheets WHERE l.ctx IN ('fasta', 'sub.bed') AND l.v IN (SELECT path FROM listing)),
lists AS (SELECT rec_id FROM sheets WHERE l.pos = '1.0' AND l.v IN (SELECT path FROM listing)),
many AS (SELECT rec_id, l.v FROM sheets WHERE l.ctx = 'files' AND rec_id IN (SELECT rec_id FROM lists))
SELECT DISTINCT rec_id, regexp_replace(v, '/[^/]*$', '') AS folder FROM (SELECT * FROM one UNION ALL SELECT * FROM many)
""")
def b6(t):
    return RC.harvest_folders(RC.flatten(_sheets(t)), B.listing(t), list(RC.IGNORED_ALGORITHM_KEYS))


@query("b7_sorted_mounts", f"""
WITH {V.LISTING}, f AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM listing)
SELECT folder, folder || ':' || folder AS mount FROM f ORDER BY folder
""")
def b7(t):
    from stowline.functions import paths as P

    return RC.sorted_mounts(B.listing(t).select(P.dirname("path").alias("folder")))


@query("b9_abs_paths", f"""
WITH {V.LISTING},
s AS (SELECT k AS rec_id, unnest([{{'ctx': 'description', 'pos': '0', 'v': path}}, {{'ctx': 'files', 'pos': '1.0', 'v': path}},
    {{'ctx': 'files', 'pos': '1.1', 'v': folder || '/../' || path}}, {{'ctx': 'sub.x', 'pos': '2.0', 'v': path}}, {{'ctx': 'vrn', 'pos': '3', 'v': path}}]) AS l, path FROM parts),
tries AS (SELECT path, unnest([{{'r': 0, 'b': '/data/in1'}}, {{'r': 1, 'b': '/data/ref'}}]) AS t FROM (SELECT DISTINCT path FROM parts)),
real AS (SELECT tries.path, t.b || '/' || tries.path AS abs FROM tries JOIN listing ON listing.path = t.b || '/' || tries.path
    QUALIFY row_number() OVER (PARTITION BY tries.path ORDER BY t.r) = 1),
odd AS (SELECT p.path, '/data/in1/' || kind || '/' || path AS a, '/data/ref/' || kind || '/' || path AS b FROM parts p)
SELECT rec_id, l.ctx AS ctx, l.pos AS pos,
    CASE WHEN l.pos = '1.1' AND real.abs IS NOT NULL THEN 'null' ELSE 'string' END AS kind,
    CASE WHEN l.pos IN ('1.0', '3') THEN coalesce(real.abs, l.v) WHEN l.pos = '1.1' AND real.abs IS NOT NULL THEN 'null' ELSE l.v END AS value
FROM s LEFT JOIN real ON real.path = s.path
""")
def b9(t):
    json = F.concat(F.lit('{"description":"'), "path", F.lit('","files":["'), "path", F.lit('","'), "folder", F.lit("/../"), "path",
                    F.lit('"],"sub":{"x":"'), "path", F.lit('"},"vrn":"'), "path", F.lit('"}'))
    rows = RC.flatten(B.parts(t).select(F.col("k").alias("rec_id"), json.alias("json")))
    return shown(RC.absolute_paths(rows, B.listing(t), ["/data/in1", "/data/ref"], list(RC.IGNORED_SAMPLE_KEYS)))


# -- transfer plans ------------------------------------------------------------------------------------

@query("c1_required", f"""
WITH {V.PARTS}, {RECORDS} SELECT * FROM leaves WHERE ctx = 'files' OR ctx LIKE 'reference.fasta%' OR ctx = 'algorithm.depth'
""")
def c1(t):
    rows = leaves(t).withColumn("ctx", RC.ctx())
    return shown(TR.required(rows, [["files"], ["reference", "fasta"], ["algorithm", "depth"]]))


@query("c1_required_table", f"""
WITH {V.PARTS}, {RECORDS}, want AS (SELECT DISTINCT 'k' || (psize % 3) AS a FROM parts)
SELECT * FROM leaves WHERE ctx IN ('files', 'nest', 'nest.p') OR starts_with(ctx, 'reference.fasta')
""")
def c1_table(t):
    filters = B.parts(t).select(
        F.when(F.col("psize") % 3 == 0, F.array(F.lit("files"))).when(F.col("psize") % 3 == 1, F.array(F.lit("nest")))
        .otherwise(F.array(F.lit("reference"), F.lit("fasta"))).alias("keys")).distinct()
    return shown(TR.required(leaves(t).withColumn("ctx", RC.ctx()), filters))


DIRS = """,
dirs AS (SELECT DISTINCT k % 20 AS rec_id, CASE psize % 4 WHEN 0 THEN '/work/' || (k % 20) || '/' || folder WHEN 1 THEN '/bio/genomes/' || folder
    WHEN 2 THEN '/work/' || (k % 20) ELSE '/ext/' || kind || '/' || (k % 11) END AS dir FROM parts)
"""


def _dirs(t):
    rec = (F.col("k") % 20)
    work = F.concat(F.lit("/work/"), rec.cast("string"))
    turn = F.col("psize") % 4
    where = (
        F.when(turn == 0, F.concat(work, F.lit("/"), "folder")).when(turn == 1, F.concat(F.lit("/bio/genomes/"), "folder"))
        .when(turn == 2, work).otherwise(F.concat(F.lit("/ext/"), "kind", F.lit("/"), (F.col("k") % 11).cast("string"))))
    return B.parts(t).select(
        rec.alias("rec_id"), where.alias("dir"), work.alias("work_dir"), F.lit("/bio").alias("data_dir"),
        F.lit("runs").alias("run_bucket"), F.lit("biodata").alias("data_bucket")).distinct()


@query("c5_destinations", f"""
WITH {V.PARTS} {DIRS},
c AS (SELECT *, CASE WHEN starts_with(dir, '/work/' || rec_id) THEN 'run' WHEN starts_with(dir, '/bio') THEN 'data' ELSE 'ext' END AS cls FROM dirs)
SELECT rec_id, dir, CASE cls WHEN 'data' THEN 'biodata' ELSE 'runs' END AS bucket,
    CASE cls WHEN 'run' THEN ltrim(replace(dir, '/work/' || rec_id, ''), '/') WHEN 'data' THEN ltrim(replace(dir, '/bio', ''), '/')
    ELSE 'externalmap/' || (row_number() OVER (PARTITION BY rec_id, cls ORDER BY dir) - 1) END AS folder FROM c
""")
def c5(t):
    return TR.destinations(_dirs(t))


@query("c6_external_ids", f"""
WITH {V.PARTS},
f AS (SELECT k % 20 AS rec_id, k AS pos, CASE psize % 4 WHEN 0 THEN '/work/' || (k % 20) || '/a/x.bam' WHEN 1 THEN '/ext/' || kind || '/' || base
    WHEN 2 THEN '/ext/' || folder || '/' || base ELSE '/ext/' || kind || '/deep/' || brand || '/' || base END AS v, psize % 10 = 1 AS alg FROM parts),
seen AS (SELECT rec_id, regexp_replace(v, '/[^/]*$', '') AS dir, min(pos) AS first FROM f WHERE NOT alg AND NOT starts_with(v, '/work/') GROUP BY ALL),
taken AS (SELECT * FROM seen s WHERE NOT EXISTS (SELECT 1 FROM seen u WHERE u.rec_id = s.rec_id AND starts_with(s.dir, u.dir || '/') AND u.first < s.first))
SELECT rec_id, dir, row_number() OVER (PARTITION BY rec_id ORDER BY first) AS ext_id FROM taken
""")
def c6(t):
    turn = F.col("psize") % 4
    rec = F.col("k") % 20
    value = (
        F.when(turn == 0, F.concat(F.lit("/work/"), rec.cast("string"), F.lit("/a/x.bam")))
        .when(turn == 1, F.concat(F.lit("/ext/"), "kind", F.lit("/"), "base"))
        .when(turn == 2, F.concat(F.lit("/ext/"), "folder", F.lit("/"), "base"))
        .otherwise(F.concat(F.lit("/ext/"), "kind", F.lit("/deep/"), "brand", F.lit("/"), "base")))
    top = F.when(F.col("psize") % 10 == 1, F.lit("algorithm")).otherwise(F.lit("files"))
    return TR.external_ids(B.parts(t).select(
        rec.alias("rec_id"), F.array(top).alias("ctx"), F.array("k").alias("pos"), value.alias("value"),
        F.concat(F.lit("/work/"), rec.cast("string")).alias("work_dir")))


PLAN = """,
files AS (SELECT DISTINCT '/data/' || path AS path, 'bk' || (psize % 2) AS bucket, kind AS folder FROM parts),
source AS (SELECT DISTINCT '/data/' || path || CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN '.tbi' ELSE '.bai' END AS path FROM parts),
target AS (SELECT DISTINCT 'bk' || (psize % 2) AS bucket, kind || '/' || base || CASE k % 3 WHEN 0 THEN '' ELSE '.tbi' END AS key FROM parts WHERE k % 5 = 0),
m AS (SELECT *, path || s AS member FROM files, (SELECT unnest(['', '.idx', '.gbi', '.tbi', '.bai']) AS s))
"""


def _plan_tables(t):
    p, k = B.parts(t), F.col("k")
    bucket = F.concat(F.lit("bk"), (F.col("psize") % 2).cast("string"))
    path = F.concat(F.lit("/data/"), "path")
    end = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.lit(".tbi")).otherwise(F.lit(".bai"))
    files = p.select(path.alias("path"), bucket.alias("bucket"), F.col("kind").alias("folder"))
    source = p.select(F.concat(path, end).alias("path"))
    sent = F.when(k % 3 == 0, F.lit("")).otherwise(F.lit(".tbi"))
    target = p.filter(k % 5 == 0).select(bucket.alias("bucket"), F.concat("kind", F.lit("/"), "base", sent).alias("key"))
    return files, source, target


@query("c3_ship_missing", f"""
WITH {V.PARTS} {PLAN},
k AS (SELECT DISTINCT member, bucket, folder || '/' || regexp_extract(member, '[^/]*$') AS key FROM m WHERE member IN (SELECT path FROM source))
SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.bucket = k.bucket AND t.key = k.key)
""")
def c3(t):
    return TR.ship_missing(*_plan_tables(t))


@query("c8_shipped_uri", f"""
WITH {V.PARTS} {PLAN} SELECT DISTINCT path, 's3://' || bucket || '/' || folder || '/' || regexp_extract(path, '[^/]*$') AS uri FROM files
""")
def c8(t):
    return TR.shipped_uri(_plan_tables(t)[0])


@query("c4_copy_missing", f"""
WITH {V.PARTS} {PLAN},
c AS (SELECT DISTINCT member, '/tmp/w/' || substr(path, 7) || s AS copy FROM m WHERE member IN (SELECT path FROM source))
SELECT member, copy FROM c WHERE copy NOT IN (SELECT '/tmp/w/' || path FROM parts WHERE k % 5 = 0)
""")
def c4(t):
    files, source, _ = _plan_tables(t)
    moved = files.select("path", F.concat(F.lit("/tmp/w/"), F.substr("path", F.lit(7))).alias("new_path"))
    there = B.parts(t).filter("k % 5 = 0").select(F.concat(F.lit("/tmp/w/"), "path").alias("path"))
    return TR.copy_missing(moved, source, there)


@query("c7_prefix_swap", f"""
WITH {V.PARTS}, v AS (SELECT k AS rec_id, CASE k % 3 WHEN 0 THEN 'reference' WHEN 1 THEN 'files' ELSE 'sam_ref' END AS top,
    CASE WHEN k % 7 = 0 THEN '/local/' || path ELSE 's3://bk/' || path END AS value, path FROM parts)
SELECT rec_id, top, CASE WHEN starts_with(value, '/local') THEN value WHEN top = 'files' THEN '/w/bk/' || path ELSE '/w/bk/genomes/' || path END AS value FROM v
""")
def c7(t):
    k = F.col("k")
    top = F.when(k % 3 == 0, F.lit("reference")).when(k % 3 == 1, F.lit("files")).otherwise(F.lit("sam_ref"))
    value = F.when(k % 7 == 0, F.concat(F.lit("/local/"), "path")).otherwise(F.concat(F.lit("s3://bk/"), "path"))
    rows = B.parts(t).select(k.alias("rec_id"), F.array(top).alias("ctx"), value.alias("value"))
    return TR.localize(rows, "bk", "/w/bk").select("rec_id", F.get("ctx", F.lit(0)).alias("top"), "value")
