"""Keyword, source-line and classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from doctables.operators import match as MT
from doctables.workload import query
from doctables.workload.fixtures import with_fixtures as fx

SCORES = """
kw AS (SELECT id, name, created_at, unnest(list_filter(list_transform(string_split(keywords, ','), lambda k: lower(trim(k))), lambda k: length(k) > 2)) AS k FROM templates WHERE keywords <> ''),
tp AS (SELECT id, name, row_number() OVER (ORDER BY created_at, id) - 1 AS ord FROM templates WHERE keywords <> ''),
h AS (SELECT d.doc_id, t.id, t.name, t.ord, count(k) AS n, coalesce(string_agg(k, '|'), '') AS ks FROM documents d CROSS JOIN tp t LEFT JOIN kw ON kw.id = t.id AND contains(lower(d.text), kw.k) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, ord) AS rn, lead(n) OVER (PARTITION BY doc_id ORDER BY n DESC, ord) AS n2, lead(id) OVER (PARTITION BY doc_id ORDER BY n DESC, ord) AS id2 FROM h)"""


@query("c1_classify", fx(f"""WITH {SCORES.strip()}
SELECT doc_id, CASE WHEN n >= 3 AND n - n2 >= 1 THEN id ELSE 'Unknown' END AS template_id, CASE WHEN n >= 3 AND n - n2 >= 1 THEN rk.name ELSE 'Unknown' END AS template_name,
  CASE WHEN n >= 3 AND n - n2 >= 1 THEN 'high' ELSE 'low' END AS confidence, CASE WHEN n >= 3 AND n - n2 >= 1 THEN 'keywords' ELSE 'ambiguous' END AS method, CAST(n AS INT) AS keyword_hits,
  CAST((SELECT count(*) FROM tp) AS INT) AS n_scores, md5(coalesce((SELECT string_agg(k, '|' ORDER BY no) FROM (SELECT unnest(list_filter(list_transform(string_split(keywords, ','), lambda k: lower(trim(k))), lambda k: length(k) > 2 AND contains(lower(d.text), k))) AS k, generate_subscripts(list_filter(list_transform(string_split(keywords, ','), lambda k: lower(trim(k))), lambda k: length(k) > 2 AND contains(lower(d.text), k)), 1) AS no)), '')) AS matched
FROM rk JOIN templates t USING (id) JOIN documents d USING (doc_id) WHERE rn = 1"""))
def classify(t):
    out = MT.classify(t.documents.select("doc_id", F.col("text").alias("markdown")), t.templates)
    return out.withColumn("n_scores", F.size("all_scores")).withColumn("matched", F.md5(F.array_join("matched_keywords", "|"))).drop("matched_keywords", "all_scores")


@query("l5_review_text", fx(f"""WITH {SCORES.strip()},
o AS (SELECT h.*, (SELECT string_agg(x, ', ') FROM (SELECT unnest(list_filter(list_transform(string_split(keywords, ','), lambda k: lower(trim(k))), lambda k: length(k) > 2 AND contains(lower(d.text), k))[1:3]) AS x)) AS top
  FROM h JOIN templates t ON t.id = h.id JOIN documents d ON d.doc_id = h.doc_id)
SELECT doc_id, string_agg(id || ' (' || name || '): matched ' || CAST(n AS VARCHAR) || ' keywords [' || coalesce(top, '') || ']', chr(10) ORDER BY n DESC, ord) AS review FROM o GROUP BY doc_id"""))
def review_text(t):
    out = MT.classify(t.documents.select("doc_id", F.col("text").alias("markdown")), t.templates)
    return out.select("doc_id", MT.review_text(F.col("all_scores")).alias("review"))


@query("j5_keyword_hits", fx(f"WITH {SCORES.strip()} SELECT doc_id, id, CAST(n AS INT) AS hits FROM h WHERE n > 0"))
def keyword_hits(t):
    hits = MT.keyword_hits(t.documents.select("doc_id", F.col("text").alias("markdown")), t.templates)
    return hits.select("doc_id", F.explode("scores").alias("s")).where("s.rank < 0").select("doc_id", F.col("s.id"), (-F.col("s.rank")).alias("hits"))


@query("j5_substrings_join", """SELECT DISTINCT d.doc_id, w.word FROM documents d JOIN (
  SELECT DISTINCT lower(unnest(string_split(text, ' '))) AS word FROM benchmark) w ON w.word <> '' AND contains(lower(d.text), w.word)""")
def substrings_join(t):
    words = t.benchmark.select(F.explode(F.split(F.lower("text"), " ")).alias("word"))
    return MT.substrings_join(t.documents.select("doc_id", F.lower("text").alias("text")), "text", words, "word")


@query("j5_all_scores", fx(f"WITH {SCORES.strip()} SELECT doc_id, id, name, CAST(ord AS INT) AS ord, CAST(n AS INT) AS hits FROM h"))
def all_scores(t):
    # forces the search for long keyword lists; every template counts, zero hits included
    hits = MT.keyword_hits(t.documents.select("doc_id", F.col("text").alias("markdown")), t.templates, max_inline=0)
    return hits.select("doc_id", F.explode("scores").alias("s")).select("doc_id", "s.id", "s.name", "s.ord", F.size("s.keywords").alias("hits"))


@query("w3_rank_templates", fx(f"WITH {SCORES.strip()} SELECT doc_id, id AS winner, CAST(n AS INT) AS winner_hits, id2 AS runner_up, CAST(n2 AS INT) AS runner_up_hits FROM rk WHERE rn = 1"))
def rank_templates(t):
    hits = MT.keyword_hits(t.documents.select("doc_id", F.col("text").alias("markdown")), t.templates)
    rows = hits.select("doc_id", F.explode("scores").alias("s")).select("doc_id", F.col("s.id").alias("template_id"), "s.ord", (-F.col("s.rank")).alias("hits"))
    return MT.rank_templates(rows)


# source pages: every movement line of an order under its flight, date and time
SOURCE_PAGES = """SELECT doc_id, page, string_agg('| ' || coalesce(substr(flight_number, 1, 2) || ' ' || substr(flight_number, 3), '-') || ' | ' || replace(date, '-', '.') ||
  CASE WHEN time IS NULL THEN '' ELSE ' | ' || time END || ' |', chr(10) ORDER BY pos) AS content FROM items GROUP BY doc_id, page"""


def source_pages(t):
    from doctables.operators.pages import join_ordered
    line = F.expr("""'| ' || coalesce(substr(flight_number, 1, 2) || ' ' || substr(flight_number, 3), '-') || ' | ' || replace(date, '-', '.') ||
      CASE WHEN time IS NULL THEN '' ELSE ' | ' || time END || ' |'""")
    return t.items.withColumn("line", line).groupBy("doc_id", "page").agg(join_ordered(["pos"], "line", "\n").alias("content"))


@query("j7_fix_dates_from_source", fx("""
WITH l AS (SELECT doc_id, page * 10000000000000 + pos AS p, flight_number, date, time FROM items)
SELECT i.doc_id, i.pos, coalesce((SELECT substr(l.date, 7) || '/' || substr(l.date, 4, 2) || '/' || substr(l.date, 1, 2) FROM l
  WHERE l.doc_id = i.doc_id AND contains(replace('|' || l.flight_number || '|' || replace(l.date, '-', '.') || '|' || coalesce(l.time, ''), ' ', ''), i.flight_number)
    AND (i.time IS NULL OR l.time = i.time) ORDER BY p LIMIT 1), 'unread') AS date FROM items i"""))
def fix_dates_from_source(t):
    rows = t.items.select("doc_id", "pos", "flight_number", "time", F.lit("unread").alias("date"))
    return MT.fix_dates_from_source(rows, source_pages(t), ["date"], "DD.MM.YYYY", "YYYY/MM/DD").select("doc_id", "pos", "date")


@query("j8_source_time", fx("""
WITH r AS (SELECT DISTINCT doc_id, flight_number AS flight, date FROM items WHERE flight_number IS NOT NULL),
m AS (SELECT r.doc_id, r.flight, r.date, count(*) AS n, min(l.time) AS source_time FROM r JOIN items l ON l.doc_id = r.doc_id AND l.date = r.date AND contains(coalesce(l.flight_number, '-'), r.flight) GROUP BY ALL)
SELECT doc_id, flight, date, source_time FROM m WHERE n = 1 AND source_time IS NOT NULL"""))
def source_time(t):
    return MT.source_time(t.items, source_pages(t))
