"""Totals, coverage and repair queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from doctables.operators import quality as Q
from doctables.operators.jobs import money_sum
from doctables.workload import query
from doctables.workload.fixtures import with_fixtures as fx

SPECS = {"line_items": {"type": "field", "name": "net_amount"}}


@query("v1_totals_report", fx("""
WITH s AS (SELECT doc_id, CAST(sum(CAST(net_amount AS DECIMAL(28, 4))) AS DOUBLE) AS line_sum FROM items GROUP BY doc_id),
j AS (SELECT h.doc_id, CAST(total_amount AS DOUBLE) AS total_value, line_sum, abs(CAST(total_amount AS DOUBLE) - line_sum) AS diff FROM headers h JOIN s USING (doc_id)),
r AS (SELECT *, CASE WHEN total_value IS NULL THEN 'missing' WHEN NOT (diff <= 0.02 OR diff <= abs(line_sum) * 0.001) THEN 'mismatch' END AS status FROM j)
SELECT doc_id, 'total_amount' AS total_path, status, total_value, line_sum, round(diff, 2) AS difference,
  CASE status WHEN 'missing' THEN 'total_amount is missing; its line items (line_items) sum to ' || CAST(CAST(line_sum AS DECIMAL(28, 2)) AS VARCHAR)
  ELSE 'total_amount = ' || CAST(CAST(total_value AS DECIMAL(28, 2)) AS VARCHAR) || ', line items (line_items) sum to ' || CAST(CAST(line_sum AS DECIMAL(28, 2)) AS VARCHAR)
    || ', difference ' || CAST(CAST(diff AS DECIMAL(28, 2)) AS VARCHAR) END AS message
FROM r WHERE status IS NOT NULL"""))
def totals_report(t):
    return Q.totals_report(t.headers, Q.line_sums(t.items, SPECS), ["total_amount"], arrays=list(SPECS))


TWO_ARRAYS = "SELECT doc_id, page, pos, CASE WHEN pos % 2 = 0 THEN 'landing_items' ELSE 'other_items' END AS array_name, net_amount FROM items"


@query("v1_totals_of_two_arrays", fx(f"""
WITH i AS ({TWO_ARRAYS}),
s AS (
  SELECT doc_id, 'total_amount' AS total_path, CAST(sum(CAST(net_amount AS DECIMAL(28, 4))) AS DOUBLE) AS line_sum, string_agg(DISTINCT array_name, ' + ' ORDER BY array_name) AS label FROM i GROUP BY doc_id
  UNION ALL SELECT doc_id, 'landing_total', CAST(sum(CAST(net_amount AS DECIMAL(28, 4))) AS DOUBLE), 'landing_items' FROM i WHERE array_name = 'landing_items' GROUP BY doc_id),
j AS (SELECT h.doc_id, total_path, label, CAST(total_amount AS DOUBLE) AS total_value, line_sum, abs(CAST(total_amount AS DOUBLE) - line_sum) AS diff FROM headers h JOIN s USING (doc_id)),
r AS (SELECT *, CASE WHEN total_value IS NULL THEN 'missing' WHEN NOT (diff <= 0.02 OR diff <= abs(line_sum) * 0.001) THEN 'mismatch' END AS status FROM j)
SELECT doc_id, total_path, status, line_sum, label FROM r WHERE status IS NOT NULL"""))
def totals_of_two_arrays(t):
    # one total shares a name with an array, the other belongs to both; names from the rules and from the sums agree
    rows = t.spark.sql(TWO_ARRAYS.replace("FROM items", "FROM {items}"), items=t.items)
    specs = {a: SPECS["line_items"] for a in ("landing_items", "other_items")}
    headers, sums = t.headers.withColumn("landing_total", F.col("total_amount")), Q.line_sums(rows, specs)
    given = Q.totals_report(headers, sums, ["total_amount", "landing_total"], arrays=list(specs))
    found = Q.totals_report(headers, sums, ["total_amount", "landing_total"])
    label = F.regexp_extract("message", r"items \(([^)]*)\)", 1).alias("label")
    return given.intersectAll(found).select("doc_id", "total_path", "status", "line_sum", label)


@query("v1_lines_agree_with_headers", fx("""
SELECT count(*) AS checked, count(*) FILTER (WHERE abs(CAST(total_amount AS DOUBLE) - line_sum) > 0.02 AND abs(CAST(total_amount AS DOUBLE) - line_sum) > abs(line_sum) * 0.001) AS reported
FROM headers JOIN (SELECT doc_id, CAST(sum(CAST(CAST(quantity AS DOUBLE) * tax AS DECIMAL(28, 4))) AS DOUBLE) AS line_sum FROM items GROUP BY doc_id) USING (doc_id) WHERE total_amount IS NOT NULL"""))
def product_totals(t):
    sums = Q.line_sums(t.items, {"line_items": {"type": "product", "qty": "quantity", "price": "tax"}})
    joined = t.headers.where("total_amount IS NOT NULL").join(sums, "doc_id")
    agree = Q.within_tolerance(F.col("total_amount").cast("double"), F.col("line_sum"))
    return joined.agg(F.count("*").alias("checked"), F.count_if(~agree).alias("reported"))


@query("a7_line_sums", fx("""
SELECT doc_id, array_name, CAST(sum(CAST(net_amount AS DECIMAL(28, 4))) AS DOUBLE) AS line_sum, count(*) AS n_rows FROM items GROUP BY ALL"""))
def line_sums(t):
    return Q.line_sums(t.items, SPECS)


@query("a8_combined_sum", """
SELECT l_orderkey AS doc_id, CAST(sum(CAST(l_extendedprice AS DECIMAL(28, 4))) AS DOUBLE) AS line_sum FROM lineitem GROUP BY 1""")
def combined_sum(t):
    items = t.lineitem.selectExpr("l_orderkey AS doc_id", "CASE l_returnflag WHEN 'N' THEN 'landing_total' ELSE 'other_total' END AS array_name", "l_extendedprice AS amount")
    spec = {"type": "field", "name": "amount"}
    sums = Q.line_sums(items, {"landing_total": spec, "other_total": spec})
    return sums.groupBy("doc_id").agg(money_sum(F.col("line_sum"), 4).alias("line_sum"))


NAMES = """SELECT n_nationkey AS group_id, CASE n_nationkey % 3 WHEN 0 THEN 'landing.total' WHEN 1 THEN 'fuel_amount' ELSE 'to.tal' END AS total_path FROM nation"""
ARRAYS = """SELECT c_nationkey AS group_id, CASE c_custkey % 3 WHEN 0 THEN 'landing_rows' WHEN 1 THEN 'Fuel.items' ELSE 'misc' END AS array_name FROM customer GROUP BY ALL"""


@query("j11_relevant_arrays", f"""
WITH p AS (SELECT t.group_id, total_path, array_name, (total_path LIKE '%landing%' AND array_name = 'landing_rows') OR (total_path LIKE 'fuel%' AND array_name = 'Fuel.items') AS m
  FROM ({NAMES}) t JOIN ({ARRAYS}) a ON a.group_id = t.group_id)
SELECT group_id, total_path, array_name FROM p QUALIFY m OR NOT max(m) OVER (PARTITION BY group_id, total_path)""")
def relevant_arrays(t):
    totals = t.nation.selectExpr("n_nationkey AS group_id", "CASE n_nationkey % 3 WHEN 0 THEN 'landing.total' WHEN 1 THEN 'fuel_amount' ELSE 'to.tal' END AS total_path")
    arrays = t.customer.selectExpr("c_nationkey AS group_id", "CASE c_custkey % 3 WHEN 0 THEN 'landing_rows' WHEN 1 THEN 'Fuel.items' ELSE 'misc' END AS array_name").distinct()
    return Q.relevant_arrays(totals, arrays)


PAGE_COUNTS = """SELECT doc_id, page, array_name, CASE WHEN doc_id % 10 = 3 AND page = 2 THEN CAST(NULL AS BIGINT) ELSE count(*) + CASE WHEN doc_id % 7 = 0 THEN page - 1 ELSE 0 END END AS counted
FROM {items} GROUP BY doc_id, page, array_name"""
GLOBAL_COUNTS = "SELECT doc_id, array_name, count(*) + CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 0 END AS counted FROM {items} WHERE doc_id % 3 <> 0 GROUP BY doc_id, array_name"
PC, GC = PAGE_COUNTS.format(items="items"), GLOBAL_COUNTS.format(items="items")
EXPECTED = f"""SELECT p.doc_id, p.array_name, CAST(CASE WHEN count(p.counted) = count(*) THEN sum(p.counted) ELSE max(g.counted) END AS BIGINT) AS expected
FROM ({PC}) p LEFT JOIN ({GC}) g ON g.doc_id = p.doc_id AND g.array_name = p.array_name GROUP BY p.doc_id, p.array_name"""
GAPS = f"""SELECT e.doc_id, e.array_name, e.expected, a.actual FROM ({EXPECTED}) e JOIN (SELECT doc_id, array_name, count(*) AS actual FROM items GROUP BY ALL) a
  ON a.doc_id = e.doc_id AND a.array_name = e.array_name WHERE e.expected <> a.actual"""


def page_counts(t):
    return t.spark.sql(PAGE_COUNTS, items=t.items)


def global_counts(t):
    return t.spark.sql(GLOBAL_COUNTS, items=t.items)


def gaps(t):
    return Q.coverage_gap(Q.row_counts(t.items), Q.expected_rows(page_counts(t), global_counts(t)))


@query("a10_expected_rows", fx(EXPECTED))
def expected_rows(t):
    return Q.expected_rows(page_counts(t), global_counts(t))


@query("j12_coverage_gap", fx(GAPS))
def coverage_gap(t):
    return gaps(t)


@query("a13_gap_total", fx(f"SELECT doc_id, CAST(sum(abs(expected - actual)) AS BIGINT) AS gap FROM ({GAPS}) GROUP BY doc_id"))
def gap_total(t):
    return Q.gap_total(gaps(t))


@query("v7_gap_summary", fx(f"SELECT doc_id, string_agg(array_name || ': ' || CAST(actual AS VARCHAR) || '/' || CAST(expected AS VARCHAR), ', ' ORDER BY array_name) AS summary FROM ({GAPS}) GROUP BY doc_id"))
def gap_summary(t):
    return Q.gap_summary(gaps(t))


@query("v3_coverage_report", fx(f"""
SELECT g.doc_id, g.array_name, CAST(g.counted AS BIGINT) AS expected, a.actual, a.actual <= 4 AS repairable FROM ({GC}) g
JOIN (SELECT doc_id, array_name, count(*) AS actual FROM items GROUP BY ALL) a ON a.doc_id = g.doc_id AND a.array_name = g.array_name WHERE a.actual <> g.counted"""))
def coverage_report(t):
    return Q.coverage_report(t.items, global_counts(t), max_rows=4)


@query("v4_page_coverage", fx(f"""
SELECT p.doc_id, p.page, p.array_name, CAST(p.counted AS BIGINT) AS expected, a.actual FROM ({PC}) p
JOIN (SELECT doc_id, page, array_name, count(*) AS actual FROM items GROUP BY ALL) a ON a.doc_id = p.doc_id AND a.page = p.page AND a.array_name = p.array_name WHERE a.actual <> p.counted"""))
def page_coverage(t):
    return Q.page_coverage(t.items, page_counts(t))


ATTEMPTS = "SELECT l_orderkey AS doc_id, CAST(1 + l_linenumber % 3 AS INT) AS attempt, count(*) AS rows FROM lineitem GROUP BY ALL"


@query("a11_best_attempt", f"""
WITH a AS ({ATTEMPTS}), f AS (SELECT doc_id, min(attempt) AS stop FROM a WHERE rows >= 2 GROUP BY doc_id)
SELECT a.doc_id, CASE WHEN a.rows >= 2 THEN attempt END AS attempt, a.rows, a.rows >= 2 AS accepted FROM a LEFT JOIN f ON f.doc_id = a.doc_id
WHERE stop IS NULL OR attempt <= stop QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY rows DESC, attempt) = 1""")
def best_attempt(t):
    attempts = t.lineitem.selectExpr("l_orderkey AS doc_id", "CAST(1 + l_linenumber % 3 AS INT) AS attempt").groupBy("doc_id", "attempt").agg(F.count("*").alias("rows"))
    return Q.best_attempt(attempts, 2)


COUNTS = "SELECT doc_id, array_name, count(*) AS n FROM {items} GROUP BY doc_id, array_name"


@query("v6_choose_retry", fx(f"""
WITH c AS ({COUNTS.format(items="items")}), g AS (SELECT doc_id, abs(doc_id % 8 - 1) AS a, abs(doc_id % 3 - 1) AS b FROM c)
SELECT doc_id, a AS first_gap, CASE WHEN a BETWEEN 1 AND 5 THEN b END AS retry_gap, a BETWEEN 1 AND 5 AS retried,
  CASE WHEN a BETWEEN 1 AND 5 AND b < a THEN 'retry' ELSE 'first' END AS chosen, CASE WHEN a BETWEEN 1 AND 5 AND b < a THEN b ELSE a END AS final_gap FROM g"""))
def choose_retry(t):
    counts = t.spark.sql(COUNTS, items=t.items)
    expected = counts.select("doc_id", "array_name", (F.col("n") + 1).alias("expected"))
    first = counts.select("doc_id", "array_name", (F.col("n") + F.col("doc_id") % 8).alias("actual"))
    second = counts.select("doc_id", "array_name", (F.col("n") + F.col("doc_id") % 3).alias("actual"))
    return Q.choose_retry(first, second, expected)


DOCS = """SELECT doc_id, 'c' || CAST(doc_id AS STRING) AS currency, CASE WHEN doc_id % 2 = 0 THEN array_agg(page) ELSE CAST(array() AS ARRAY<INT>) END AS rows FROM {items} GROUP BY doc_id"""
FIXED = """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'fixed' END AS currency, CASE WHEN doc_id % 5 = 0 THEN CAST(array() AS ARRAY<INT>) ELSE array(1, 2, 3, 4, 5, 6, 7, 8, 9) END AS rows FROM {items} WHERE doc_id % 7 <> 0 GROUP BY doc_id"""


@query("v2_merge_corrected", fx("""
SELECT doc_id, CASE WHEN doc_id % 7 <> 0 AND doc_id % 3 = 0 THEN 'fixed' ELSE 'c' || CAST(doc_id AS VARCHAR) END AS currency,
  CAST(CASE WHEN doc_id % 2 = 0 THEN count(*) WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN 9 ELSE 0 END AS INT) AS n FROM items GROUP BY doc_id"""))
def merge_corrected(t):
    merged = Q.merge_corrected(t.spark.sql(DOCS, items=t.items), t.spark.sql(FIXED, items=t.items), ["rows"])
    return merged.select("doc_id", "currency", F.size("rows").alias("n"))


@query("v5_guard_repair", fx("""
SELECT doc_id, CAST(CASE WHEN doc_id % 5 <> 0 THEN 9 WHEN doc_id % 2 = 0 THEN count(*) ELSE 0 END AS INT) AS n FROM items WHERE doc_id % 7 <> 0 GROUP BY doc_id"""))
def guard_repair(t):
    repaired = Q.guard_repair(t.spark.sql(DOCS, items=t.items), t.spark.sql(FIXED, items=t.items), ["rows"])
    return repaired.select("doc_id", F.size("rows").alias("n"))
