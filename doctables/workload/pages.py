"""Page and document queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from doctables.operators import pages as P
from doctables.workload import query
from doctables.workload.fixtures import with_fixtures as fx


@query("p1_assemble", fx(r"""
SELECT doc_id, string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page) AS markdown
FROM conv_pages GROUP BY doc_id"""))
def assemble(t):
    return P.assemble(t.conv_pages)


@query("p2_filter_pages", fx("""
SELECT doc_id, page, content_length FROM conv_pages p
WHERE page IN (5, 6, 7) OR page = 4 OR NOT EXISTS (
  SELECT 1 FROM conv_pages q WHERE q.doc_id = p.doc_id AND q.page BETWEEN 4 AND 7)"""))
def filter_pages(t):
    return P.filter_pages(t.conv_pages, "4, 7-5,x").select("doc_id", "page", "content_length")


@query("p3_with_page_context", fx(r"""
SELECT doc_id, page, CASE WHEN prev IS NULL THEN content ELSE
  array_to_string(list_slice(string_split(prev, chr(10)), greatest(len(string_split(prev, chr(10))) - 2, 1), len(string_split(prev, chr(10)))), chr(10))
  || chr(10) || chr(10) || '===== CURRENT PAGE BELOW =====' || chr(10) || chr(10) || content END AS input
FROM (SELECT *, lag(content) OVER (PARTITION BY doc_id ORDER BY page) AS prev FROM conv_pages)"""))
def with_page_context(t):
    return P.with_page_context(t.conv_pages, n=3).select("doc_id", "page", "input")


TILES = """SELECT conv_id AS doc_id, 'conv_page_' || lpad(CAST(turn // 3 + 1 AS VARCHAR), 5, '0') ||
  CASE WHEN conv_id % 2 = 0 THEN '_' || lpad(CAST(turn % 3 AS VARCHAR), 2, '0') ELSE '_' || CAST(turn % 3 AS VARCHAR) END || '.png' AS tile_name, text AS content
  FROM conversations"""


@query("p4_regroup_tiles", f"""
SELECT doc_id, left(tile_name, 15) AS page_key, string_agg(content, chr(10) || chr(10) ORDER BY tile_name) AS content
FROM ({TILES}) GROUP BY ALL""")
def regroup_tiles(t):
    tiles = t.conversations.selectExpr(
        "conv_id AS doc_id", """'conv_page_' || lpad(CAST(turn div 3 + 1 AS STRING), 5, '0') ||
        CASE WHEN conv_id % 2 = 0 THEN '_' || lpad(CAST(turn % 3 AS STRING), 2, '0') ELSE '_' || CAST(turn % 3 AS STRING) END || '.png' AS tile_name""",
        "text AS content")
    return P.regroup_tiles(tiles).select("doc_id", "page_key", "content")


@query("p5_page_scan_flags", fx("""
SELECT doc_id, page, least(image_area / CASE WHEN page_area = 0 THEN 1 ELSE page_area END, 1.0) AS image_coverage,
  char_count < 30 AND least(image_area / CASE WHEN page_area = 0 THEN 1 ELSE page_area END, 1.0) >= 0.25 AS scanned
FROM page_signals"""))
def page_scan_flags(t):
    return P.page_scan_flags(t.page_signals).select("doc_id", "page", "image_coverage", "scanned")


USABLE = """SELECT doc_id, count(*) AS total, CAST(sum(content_length) AS BIGINT) AS total_chars,
  round(sum(content_length) / count(*), 2) AS avg_chars,
  coalesce(string_agg(CASE WHEN scanned THEN CAST(page - 1 AS VARCHAR) END, ',' ORDER BY page), '') AS scanned_pages,
  round(count(*) FILTER (WHERE scanned) / count(*), 4) AS scanned_share,
  sum(content_length) / count(*) >= 30 AND count(*) FILTER (WHERE scanned) < count(*) AS usable
FROM (SELECT *, char_count < 30 AND least(image_area / CASE WHEN page_area = 0 THEN 1 ELSE page_area END, 1.0) >= 0.25 AS scanned FROM page_signals)
GROUP BY doc_id"""


@query("p6_doc_usability", fx(USABLE))
def doc_usability(t):
    out = P.doc_usability(P.page_scan_flags(t.page_signals))
    return out.withColumn("scanned_pages", F.array_join("scanned_pages", ","))


@query("p7_route_docs", fx(f"""
SELECT doc_id, file_name, CASE WHEN doc_id % 4 <> 3 AND usable THEN 'text' ELSE 'needs_conversion' END AS source
FROM (SELECT *, 'doc' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 4 = 3 THEN '.png' ELSE '.PDF' END AS file_name FROM ({USABLE}))"""))
def route_docs(t):
    docs = P.doc_usability(P.page_scan_flags(t.page_signals)).withColumn(
        "file_name", F.expr("'doc' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 4 = 3 THEN '.png' ELSE '.PDF' END"))
    return P.route_docs(docs).select("doc_id", "file_name", "source")


PLAN_SQL = """SELECT doc_id, CAST(floor(n_chars / 500) AS BIGINT) + 1 AS n_pages, CAST(doc_id % 3 AS BIGINT) AS n_arrays,
  doc_id % 5 = 0 AS per_page FROM documents"""


@query("p8_extraction_plan", f"""
SELECT doc_id, n_pages, CASE WHEN n_arrays = 0 OR (n_pages <= 20 AND NOT per_page) THEN 'document' ELSE 'page' END AS strategy,
  CAST(CASE WHEN n_pages <= 20 AND NOT per_page AND n_arrays > 0 THEN 2 ELSE 1 END AS INT) AS attempts,
  CAST(CASE WHEN n_pages BETWEEN 6 AND 20 AND NOT per_page THEN 5 ELSE 0 END AS INT) AS min_rows,
  n_arrays > 0 AND (n_pages > 20 OR per_page) AS protect_arrays
FROM ({PLAN_SQL})""")
def extraction_plan(t):
    docs = t.documents.selectExpr("doc_id", "CAST(floor(n_chars / 500) AS BIGINT) + 1 AS n_pages",
                                  "doc_id % 3 AS n_arrays", "doc_id % 5 = 0 AS per_page")
    return P.extraction_plan(docs).drop("n_arrays", "per_page")


@query("p9_tile_grid", """
WITH images AS (SELECT doc_id, CAST(1000 + (n_chars * 7) % 9000 AS BIGINT) AS width, CAST(800 + (n_chars * 13) % 11000 AS BIGINT) AS height FROM documents),
grid AS (SELECT *, CASE WHEN height > 2400 THEN (height + 2399) // 2400 ELSE 1 END AS r0,
  CASE WHEN width > 2400 AND width > height THEN (width + 2399) // 2400 ELSE 1 END AS c0 FROM images),
sized AS (SELECT doc_id, width, height, CASE WHEN r0 * c0 > 16 THEN 1 ELSE r0 END AS r, CASE WHEN r0 * c0 > 16 THEN 1 ELSE c0 END AS c FROM grid),
cells AS (SELECT *, unnest(range(r * c)) AS tile, (width + c - 1) // c AS tw, (height + r - 1) // r AS th FROM sized),
ov AS (SELECT *, CASE WHEN r * c > 1 THEN CAST(floor(tw * 0.04) AS BIGINT) ELSE 0 END AS ox, CASE WHEN r * c > 1 THEN CAST(floor(th * 0.04) AS BIGINT) ELSE 0 END AS oy FROM cells),
pos AS (SELECT *, greatest((tile % c) * tw - ox, 0) AS lft, greatest((tile // c) * th - oy, 0) AS tp FROM ov)
SELECT doc_id, CAST(tile AS INT) AS tile, CAST(lft AS BIGINT) AS "left", CAST(tp AS BIGINT) AS top,
  CAST(CASE WHEN lft + tw + CASE WHEN lft = 0 THEN ox ELSE 2 * ox END > width THEN width - lft ELSE tw + CASE WHEN lft = 0 THEN ox ELSE 2 * ox END END AS BIGINT) AS tile_width,
  CAST(CASE WHEN tp + th + CASE WHEN tp = 0 THEN oy ELSE 2 * oy END > height THEN height - tp ELSE th + CASE WHEN tp = 0 THEN oy ELSE 2 * oy END END AS BIGINT) AS tile_height
FROM pos""")
def tile_grid(t):
    images = t.documents.selectExpr("doc_id", "1000 + (n_chars * 7) % 9000 AS width", "800 + (n_chars * 13) % 11000 AS height")
    return P.tile_grid(images).select("doc_id", "tile", "left", "top", "tile_width", "tile_height")


@query("p10_pick_with_margin", """
WITH c AS (SELECT doc_id, CAST(r * 90 AS INT) AS rotation, CAST((n_chars * (r * r + 3)) % 101 AS DOUBLE) AS confidence
  FROM documents, (SELECT unnest([0, 1, 2, 3]) AS r)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, rotation) AS rn,
  lead(confidence) OVER (PARTITION BY doc_id ORDER BY confidence DESC, rotation) AS second_score FROM c)
SELECT doc_id, CAST(CASE WHEN rotation <> 0 AND confidence >= 60 AND confidence - second_score >= 10 THEN rotation ELSE 0 END AS INT) AS chosen,
  confidence AS top_score, second_score FROM k WHERE rn = 1""")
def pick_with_margin(t):
    candidates = t.documents.select("doc_id", "n_chars", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("r")).selectExpr(
        "doc_id", "CAST(r * 90 AS INT) AS rotation", "CAST((n_chars * (r * r + 3)) % 101 AS DOUBLE) AS confidence")
    return P.pick_with_margin(candidates, ["doc_id"], "rotation", "confidence", 60, 10, 0)


@query("p11_head_samples", """
WITH s AS (SELECT DISTINCT doc_id, least(size, length(text)) AS sample_size, text FROM documents, (SELECT unnest([30000, 10000, 4000]) AS size))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sample_size DESC) - 1 AS INT) AS attempt,
  CAST(sample_size AS INT) AS sample_size, md5(left(text, sample_size)) AS digest FROM s""")
def head_samples(t):
    return P.head_samples(t.documents).select("doc_id", "attempt", "sample_size", F.md5("sample").alias("digest"))


@query("p12_estimate_time", """
WITH d AS (SELECT doc_id, CAST(n_chars // 400 AS BIGINT) AS n_pages, lang = 'en' AS has_schema,
  CASE WHEN source = 'src1' THEN 'schema' ELSE 'extraction' END AS kind FROM documents),
m AS (SELECT *, CAST(CASE WHEN kind = 'schema' THEN greatest(n_pages, 1) * 25000 + 15000
  ELSE (5 + greatest(n_pages, 1) * CASE WHEN n_pages > 20 THEN 8 WHEN has_schema THEN 12 ELSE 6 END) * 1000 END AS BIGINT) AS estimate_ms FROM d)
SELECT doc_id, estimate_ms, CASE WHEN estimate_ms < 60000 THEN CASE WHEN kind = 'schema' THEN '~' ELSE '' END || CAST(estimate_ms // 1000 AS VARCHAR) || 's'
  ELSE '~' || CAST((estimate_ms + 30000) // 60000 AS VARCHAR) || ' min' END AS estimate FROM m""")
def estimate_time(t):
    docs = t.documents.selectExpr("doc_id", "n_chars div 400 AS n_pages", "lang = 'en' AS has_schema",
                                  "CASE WHEN source = 'src1' THEN 'schema' ELSE 'extraction' END AS kind")
    return P.estimate_time(docs).select("doc_id", "estimate_ms", "estimate")
