"""The bindings once more, as SQL common table expressions for the result checks."""

PARTS = """
p AS (SELECT p_partkey AS k, lower(p_type) AS kind, p_brand AS brand,
        replace(p_name, ' ', '_') || '.' || CASE p_size % 5 WHEN 0 THEN 'fa' WHEN 1 THEN 'fa.fai'
            WHEN 2 THEN 'gff' WHEN 3 THEN 'vcf.gz' ELSE 'bed' END AS base,
        CAST(p_size AS BIGINT) AS psize, p_name AS pname FROM part),
parts AS (SELECT *, kind || '/' || brand AS folder, kind || '/' || brand || '/' || base AS path FROM p)
"""
CATALOG = PARTS + """,
catalog AS (SELECT k AS ord, 'gs://b' || (k % 3) || '/' || path AS uri, psize * 1048576 AS size FROM parts)
"""
OBJECTS = PARTS + """,
objects AS (SELECT k AS ord, 'b' || (k % 3) AS container, 'f' || k AS file_id, path FROM parts)
"""
REQUESTS = """,
requests AS (SELECT k AS req_id,
        CASE WHEN k % 21 = 0 THEN base ELSE brand || '/' || base END AS n0,
        CASE (k // 7) % 4
            WHEN 0 THEN folder || '/*_' || split_part(pname, ' ', -1) || '.' || substr(base, instr(base, '.') + 1)
            WHEN 1 THEN '*' || folder || '/' || base
            WHEN 2 THEN replace(base, '_', '?')
            ELSE brand || '/[a-l]*.' || substr(base, instr(base, '.') + 1) END AS n1
    FROM parts),
names AS (SELECT req_id, 0 AS pos, n0 AS name FROM requests UNION ALL SELECT req_id, 1, n1 FROM requests)
"""
MATCHES = """,
matches AS (SELECT DISTINCT n.name, c.ord, c.uri FROM (SELECT DISTINCT name FROM names) n JOIN catalog c
    ON c.uri = n.name OR ends_with(c.uri, '/' || n.name)
    OR (contains(n.name, '*') AND c.uri GLOB ('*/' || n.name)))
"""
KEYED = PARTS + """,
keyed_listing AS (SELECT k AS ord, 'p' || (k % 2) AS project, 'f' || k AS file_id, '/' || path AS path FROM parts),
keyed AS (SELECT min(ord) AS ord, arg_max(project, ord) AS project, arg_max(file_id, ord) AS file_id, path
    FROM keyed_listing GROUP BY path)
"""
LISTING_ONLY = """
listing AS (SELECT DISTINCT CASE k % 4 WHEN 0 THEN '/data/ref' WHEN 1 THEN '/data/in0' WHEN 2 THEN '/data/in1'
    ELSE '/data/ref' END || '/' || path AS path FROM parts)
"""
LISTING = PARTS + "," + LISTING_ONLY
