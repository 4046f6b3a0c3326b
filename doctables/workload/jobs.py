"""Job analytics and table maintenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from doctables.operators import jobs as J
from doctables.operators import tables as M
from doctables.workload import query
from doctables.workload.fixtures import with_fixtures as fx

CUTOFF = 900000000000


@query("a1_job_stats", fx("""
SELECT count(*) AS total_jobs, count(*) FILTER (WHERE status = 'done') AS successful, count(*) FILTER (WHERE status = 'error') AS failed,
  count(*) FILTER (WHERE status = 'in-progress') AS in_progress, CAST(sum(CAST(cost_total AS DECIMAL(28, 6))) AS DOUBLE) AS total_cost,
  CAST(sum(calls) AS BIGINT) AS total_calls, CAST(floor(count(*) FILTER (WHERE status = 'done') / count(*) * 100 + 0.5) AS BIGINT) AS success_rate_pct FROM jobs"""))
def job_stats(t):
    return J.success_rate(J.job_stats(t.jobs))


LABEL = """coalesce(t.name, j.template_name, CASE WHEN j.schema IS NOT NULL THEN 'Custom Schema' ELSE 'Raw Markdown' END)"""
STATS = f"""SELECT {LABEL} AS name, count(*) AS count, CAST(sum(coalesce(CAST(cost_total AS DECIMAL(28, 6)), 0)) AS DOUBLE) AS cost
FROM jobs j LEFT JOIN templates t ON t.id = j.template_name WHERE status = 'done' GROUP BY 1"""


@query("a2_template_stats", fx(STATS))
def template_stats(t):
    return J.template_stats(t.jobs, t.templates)


COUNTS = """SELECT count(*) AS total, count(*) FILTER (WHERE template_name = 'schema-generation') AS schema_count,
  count(*) FILTER (WHERE status = 'done' AND (template_name IS NULL OR template_name <> 'schema-generation')) AS filtered_total FROM jobs"""


@query("a3_job_counts", fx(f"SELECT *, least(20, greatest(filtered_total - 40, 0)) + 40 < filtered_total AS has_more FROM ({COUNTS})"))
def job_counts(t):
    return J.job_counts(t.jobs, status="done", tab="extraction", limit=20, offset=40)


@query("a4_template_shares", fx(f"""SELECT *, CAST(floor(count / sum(count) OVER () * 100 + 0.5) AS BIGINT) AS share_pct,
  round(greatest(cost / greatest(max(cost) OVER (), 0.0001) * 100, 0.5), 4) AS cost_bar_pct FROM ({STATS})"""))
def template_shares(t):
    return J.template_shares(J.template_stats(t.jobs, t.templates))


@query("a5_token_cost", fx("""SELECT id, conversion_input + extraction_input AS total_input, conversion_output + extraction_output AS total_output,
  CAST(CAST(CAST((conversion_input + extraction_input) * (CAST(0.15 AS DOUBLE) / 1e6) + (conversion_output + extraction_output) * (CAST(0.60 AS DOUBLE) / 1e6) AS VARCHAR) AS DECIMAL(18, 6)) AS DOUBLE) AS cost FROM jobs"""))
def token_cost(t):
    return J.token_cost(t.jobs).select("id", "total_input", "total_output", "cost")


@query("a6_usage_rollup", """
SELECT l_orderkey AS job_id, CAST(coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 0) AS BIGINT) AS conversion_input,
  CAST(coalesce(sum(l_linenumber) FILTER (WHERE l_returnflag = 'N'), 0) AS BIGINT) AS conversion_output,
  CAST(coalesce(sum(l_quantity) FILTER (WHERE l_returnflag <> 'N'), 0) AS BIGINT) AS extraction_input,
  CAST(coalesce(sum(l_linenumber) FILTER (WHERE l_returnflag <> 'N'), 0) AS BIGINT) AS extraction_output,
  CAST(sum(l_quantity) AS BIGINT) AS total_input, CAST(sum(l_linenumber) AS BIGINT) AS total_output FROM lineitem GROUP BY 1""")
def usage_rollup(t):
    calls = t.lineitem.selectExpr("l_orderkey AS job_id", "CASE WHEN l_returnflag = 'N' THEN 'conversion' ELSE 'extraction' END AS phase",
                                  "CAST(l_quantity AS BIGINT) AS input_tokens", "CAST(l_linenumber AS BIGINT) AS output_tokens")
    return J.usage_rollup(calls)


@query("a12_call_count", """
SELECT doc_id, CAST(CASE WHEN source = 'src0' THEN CASE WHEN lang = 'en' THEN n_chars % 4 ELSE 0 END
  WHEN lang = 'en' THEN n_chars // 400 + greatest(n_chars % 4, 1) ELSE n_chars // 400 END AS BIGINT) AS calls FROM documents""")
def call_count(t):
    docs = t.documents.selectExpr("doc_id", "CASE WHEN source = 'src0' THEN 'text' ELSE 'needs_conversion' END AS source",
                                  "lang = 'en' AS has_schema", "n_chars % 4 AS extraction_calls", "n_chars div 400 AS n_pages")
    return J.call_count(docs).select("doc_id", "calls")


DELTAS = """SELECT event_id, epoch_us(ts) AS tu, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS d1,
  CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN -2 WHEN 'signup' THEN -1 ELSE 0 END AS d2 FROM events"""


@query("a14_counters", f"""
WITH d AS ({DELTAS}), s AS (SELECT *, sum(d1) OVER w AS s1, sum(d2) OVER w AS s2 FROM d WINDOW w AS (ORDER BY tu, event_id))
SELECT event_id, CAST(s1 - least(0, min(s1) OVER w) AS BIGINT) AS total_successful, CAST(s2 - least(0, min(s2) OVER w) AS BIGINT) AS total_calls
FROM s WINDOW w AS (ORDER BY tu, event_id)""")
def counters(t):
    deltas = t.events.selectExpr("event_id", "ts", "CASE event_type WHEN 'purchase' THEN 1L WHEN 'error' THEN -1L ELSE 0L END AS successful",
                                 "CASE event_type WHEN 'view' THEN 2L WHEN 'click' THEN -2L WHEN 'signup' THEN -1L ELSE 0L END AS calls")
    return J.counters(deltas, ["ts", "event_id"], ["successful", "calls"]).select("event_id", "total_successful", "total_calls")


@query("j1_jobs_with_users", fx("""SELECT j.id, j.user_id, u.email AS user_email, u.first_name AS user_first_name, u.last_name AS user_last_name
FROM jobs j LEFT JOIN users u ON u.id = j.user_id"""))
def jobs_with_users(t):
    return J.jobs_with_users(t.jobs.select("id", "user_id"), t.users)


@query("t17_user_display", fx("""SELECT j.id, CASE WHEN u.first_name <> '' AND u.last_name <> '' THEN u.first_name || ' ' || u.last_name
  WHEN u.first_name <> '' THEN u.first_name WHEN u.last_name <> '' THEN u.last_name ELSE coalesce(u.email, 'System') END AS user_name
FROM jobs j LEFT JOIN users u ON u.id = j.user_id"""))
def user_display(t):
    return J.user_display(J.jobs_with_users(t.jobs.select("id", "user_id"), t.users)).select("id", "user_name")


@query("j2_resolve_template", fx("""SELECT j.id, j.template_name, (SELECT t.id FROM templates t WHERE t.id = j.template_name OR t.name = j.template_name
  ORDER BY created_at, id LIMIT 1) AS tpl_id FROM jobs j"""))
def resolve_template(t):
    return J.resolve_template(t.jobs.select("id", "template_name"), t.templates).drop("tpl_name")


@query("j3_job_labels", fx(f"SELECT j.id, {LABEL} AS label FROM jobs j LEFT JOIN templates t ON t.id = j.template_name"))
def job_labels(t):
    return J.job_labels(t.jobs, t.templates).select("id", "label")


@query("j4_key_owner", fx("""SELECT k.id AS key_id, k.name AS key_name, k.user_id, u.email, u.role, u.company_id, coalesce(c.name, '') AS company_name
FROM api_keys k JOIN users u ON u.id = k.user_id LEFT JOIN companies c ON c.id = u.company_id"""))
def key_owner(t):
    return J.key_owner(t.api_keys, t.users, t.companies)


@query("f5_filter_jobs", fx("SELECT id, template_name FROM jobs WHERE template_name IS NULL OR template_name <> 'schema-generation'"))
def filter_tab(t):
    return J.filter_jobs(t.jobs, tab="extraction").select("id", "template_name")


@query("f6_search_jobs", fx("""SELECT j.id, j.user_id FROM jobs j LEFT JOIN users u ON u.id = j.user_id
WHERE j.file_name ILIKE '%mach_nery1%' OR j.id ILIKE '%mach_nery1%' OR j.template_name ILIKE '%mach_nery1%' OR u.email ILIKE '%mach_nery1%'
  OR coalesce(u.first_name, '') || ' ' || coalesce(u.last_name, '') ILIKE '%mach_nery1%'"""))
def search_jobs(t):
    return J.filter_jobs(t.jobs, t.users, q="MACH_nery1").select("id", "user_id")


@query("f7_status_and_template", fx("""SELECT id, status, template_name FROM jobs WHERE status = 'error' AND (template_name IS NULL OR template_name IN ('np_001', 'legacy-layout'))"""))
def status_and_template(t):
    return J.filter_jobs(t.jobs, status="error", templates=["np_001", "__none__", "", "legacy-layout"]).select("id", "status", "template_name")


@query("f8_created_range", fx(f"SELECT id, created_at FROM jobs WHERE created_at BETWEEN 850000000000 AND {CUTOFF}"))
def created_range(t):
    return J.filter_jobs(t.jobs, created_from=850000000000, created_to=CUTOFF).select("id", "created_at")


@query("f9_visible_jobs", fx("SELECT id, user_id FROM jobs WHERE user_id = 'u37' OR user_id = 'system'"))
def visible_jobs(t):
    return J.visible_jobs(t.jobs, "u37").select("id", "user_id")


CARDS = """SELECT j.id, j.file_name, j.pages, j.status, j.total_ms, j.cost_total, j.calls, j.template_name, j.created_at,
  coalesce(nullif(trim(coalesce(u.first_name, '') || ' ' || coalesce(u.last_name, '')), ''), u.email, 'System') AS user_name
FROM jobs j LEFT JOIN users u ON u.id = j.user_id"""


@query("f11_job_cards", fx(CARDS))
def job_cards(t):
    return J.job_cards(t.jobs, t.users)


@query("l1_page_jobs", fx(f"{CARDS} WHERE j.status = 'done' ORDER BY j.created_at DESC, j.id LIMIT 50 OFFSET 100"))
def page_jobs(t):
    # the page is cut before the owner join
    page = J.page_jobs(J.filter_jobs(t.jobs, status="done"), 50, 100)
    return J.page_jobs(J.job_cards(page, t.users))  # the join does not keep the order


@query("l1_page_jobs_deep", fx("SELECT id, created_at FROM jobs ORDER BY created_at DESC, id LIMIT 40 OFFSET 1000"))
def page_jobs_deep(t):
    return J.page_jobs(t.jobs.select("id", "created_at"), 40, 1000)


@query("l2_recent_jobs", fx("SELECT id, created_at FROM jobs ORDER BY created_at DESC, id LIMIT 25"))
def recent_jobs(t):
    return J.recent_jobs(t.jobs.select("id", "created_at"), 25)


@query("l3_list_templates", "SELECT 'reg_' || CAST(c_custkey AS VARCHAR) AS id, c_custkey // 10 AS created_at FROM customer ORDER BY 2, 1")
def list_templates(t):
    return J.list_templates(t.customer.selectExpr("'reg_' || CAST(c_custkey AS STRING) AS id", "c_custkey div 10 AS created_at"))


@query("l4_rank_stats", fx(f"SELECT * FROM ({STATS}) ORDER BY cost DESC, name"))
def rank_stats(t):
    return J.rank_stats(J.template_stats(t.jobs, t.templates), "cost")


REQUESTS = """SELECT o_orderkey AS request_id,
  CASE WHEN o_orderkey % 5 = 0 THEN ' [] ' WHEN o_orderkey % 5 = 1 THEN '  ' END AS schema,
  CASE o_orderpriority WHEN '1-URGENT' THEN ' np_001 ' WHEN '2-HIGH' THEN 'Freight Invoice' WHEN '3-MEDIUM' THEN 'np_005' WHEN '4-NOT SPECIFIED' THEN 'nothing' END AS template,
  CASE WHEN o_orderkey % 7 = 0 THEN '{"keepIf":["x"]}' END AS filter,
  CASE WHEN o_orderkey % 3 = 0 THEN 'true' ELSE '0' END AS verify_coverage,
  CASE WHEN o_orderkey % 4 = 0 THEN 'false' END AS verify_totals,
  CASE WHEN o_orderkey % 6 = 0 THEN '1' END AS per_page,
  CASE WHEN o_orderkey % 8 = 0 THEN ' D/M/YY ' END AS date_format,
  CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'MM/DD/YYYY' END AS date_input_format FROM orders"""
TPL_SCHEMA = """SELECT *, CASE WHEN id <> 'np_005' THEN '[{"name":"t","type":"number"}]' ELSE '' END AS schema,
  CASE WHEN id = 'np_002' THEN '{"dropIf":["a"]}' END AS filter FROM templates"""


@query("d12_resolve_settings", fx(f"""
WITH r AS ({REQUESTS}), tp AS ({TPL_SCHEMA}),
m AS (SELECT r.*, t.schema AS ts, t.filter AS tf, t.verify_coverage AS tc, t.verify_totals AS tt, t.per_page AS tpp, t.date_format AS td, t.date_input_format AS ti, t.domain AS tdom
  FROM r LEFT JOIN tp t ON coalesce(trim(r.schema), '') = '' AND t.schema <> '' AND (t.id = trim(r.template) OR t.name = trim(r.template)))
SELECT request_id, coalesce(nullif(trim(schema), ''), ts) AS schema_used, coalesce(filter, tf) AS filter_used,
  verify_coverage IN ('1', 'true') OR coalesce(tc = 1, false) AS verify_coverage,
  verify_totals IS NULL AND coalesce(tt <> 0, true) AS verify_totals, coalesce(per_page = '1', false) OR coalesce(tpp = 1, false) AS per_page,
  coalesce(trim(date_format), td) AS date_format, coalesce(nullif(date_input_format, ''), ti) AS date_input_format, tdom AS domain FROM m"""))
def resolve_settings(t):
    requests = t.spark.sql(REQUESTS.replace("FROM orders", "FROM {orders}").replace('{"keepIf":["x"]}', '{{"keepIf":["x"]}}'), orders=t.orders)
    templates = t.templates.withColumn("schema", F.when(F.col("id") != "np_005", '[{"name":"t","type":"number"}]').otherwise("")).withColumn(
        "filter", F.when(F.col("id") == "np_002", '{"dropIf":["a"]}'))
    return J.resolve_settings(requests, templates)


@query("m1_append_jobs", fx("""
SELECT id, file_name, pages, status, calls, user_id, created_at FROM jobs UNION ALL
SELECT 'new-' || CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END, CAST(0 AS INT), 'in-progress', CAST(0 AS INT),
  CASE WHEN c_custkey % 3 = 0 THEN 'u1' ELSE 'system' END, 1750000000000 FROM customer"""))
def append_jobs(t):
    new = t.customer.selectExpr("'new-' || CAST(c_custkey AS STRING) AS id", "CASE WHEN c_custkey % 2 = 0 THEN c_name END AS file_name",
                                "CASE WHEN c_custkey % 3 = 0 THEN 'u1' END AS user_id")
    jobs = t.jobs.select("id", "file_name", "pages", "status", "calls", "user_id", "created_at")
    return M.append_jobs(jobs, new, 1750000000000)


@query("m2_patch", fx("""
SELECT id, CASE WHEN o.o_orderkey % 4 = 0 THEN 'done' ELSE status END AS status,
  CASE WHEN o.o_orderkey % 4 = 0 AND o.o_orderkey % 3 <> 0 THEN 'p' || id ELSE file_name END AS file_name,
  CASE WHEN o.o_orderkey % 4 = 0 THEN 1750000000000 ELSE created_at + total_ms END AS completed_at
FROM jobs JOIN orders o ON id = 'job-' || CAST(o.o_orderkey AS VARCHAR)"""))
def patch(t):
    patches = t.orders.where("o_orderkey % 4 = 0").selectExpr(
        "'job-' || CAST(o_orderkey AS STRING) AS id", "'done' AS status",
        "CASE WHEN o_orderkey % 3 <> 0 THEN 'pjob-' || CAST(o_orderkey AS STRING) END AS file_name")
    target = t.jobs.selectExpr("id", "status", "file_name", "created_at + total_ms AS completed_at")
    return M.patch(target, patches, "id", now=1750000000000)


@query("m3_delete_keys", fx("SELECT id, status FROM jobs WHERE user_id NOT IN (SELECT id FROM users WHERE last_name = 'BUILDING')"))
def delete_keys(t):
    owners = t.users.where("last_name = 'BUILDING'").selectExpr("id AS user_id")
    return M.delete_keys(t.jobs, owners, ["user_id"]).select("id", "status")


@query("m4_upsert", """
SELECT user_id AS key, arg_max(props, event_id) AS value, max(event_id) AS updated_at FROM events GROUP BY 1
UNION ALL SELECT c_custkey, 'initial', -1 FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
def upsert(t):
    target = t.customer.selectExpr("c_custkey AS key", "'initial' AS value", "-1L AS updated_at")
    updates = t.events.selectExpr("user_id AS key", "props AS value", "event_id AS updated_at")
    return M.upsert(target, updates, ["key"], "updated_at")


@query("m5_assign_ids", """
SELECT c_name AS name, 'np_' || CASE WHEN length(n) < 3 THEN lpad(n, 3, '0') ELSE n END AS id FROM (
  SELECT c_name, CAST(row_number() OVER (ORDER BY c_acctbal, c_custkey) + 7 AS VARCHAR) AS n FROM customer)""")
def assign_ids(t):
    new = t.customer.select("c_acctbal", "c_custkey", F.col("c_name").alias("name"))
    return M.assign_ids(new, ["c_acctbal", "c_custkey"], start=7).select("name", "id")


@query("m6_rerun_jobs", fx("""
SELECT j.id AS rerun_of, stored_file, CASE WHEN t.id IS NOT NULL THEN template_name END AS template_id,
  CASE WHEN t.id IS NULL THEN schema END AS schema, CASE WHEN t.id IS NULL THEN coalesce(filter, '') END AS filter
FROM jobs j LEFT JOIN templates t ON t.id = j.template_name OR t.name = j.template_name
WHERE stored_file IS NOT NULL AND coalesce(template_name, '') <> 'schema-generation'"""))
def rerun_jobs(t):
    return J.rerun_jobs(t.jobs, t.templates)


@query("j10_insert_new", fx("""
SELECT id, email FROM users UNION ALL SELECT 'new' || CAST(s_suppkey AS VARCHAR), lower(c_mktsegment) || CAST(s_suppkey * 2 AS VARCHAR) || '@example.com'
FROM supplier JOIN customer ON c_custkey = s_suppkey
WHERE lower(c_mktsegment) || CAST(s_suppkey * 2 AS VARCHAR) || '@example.com' NOT IN (SELECT email FROM users)"""))
def insert_new(t):
    new = t.supplier.join(t.customer, F.expr("c_custkey = s_suppkey")).selectExpr(
        "'new' || CAST(s_suppkey AS STRING) AS id", "lower(c_mktsegment) || CAST(s_suppkey * 2 AS STRING) || '@example.com' AS email")
    return M.insert_new(t.users.select("id", "email"), new, "email")


@query("st4_mark_orphans", fx(f"""SELECT id, CASE WHEN status = 'in-progress' AND created_at < {CUTOFF} THEN 'error' ELSE status END AS status,
  CASE WHEN status = 'in-progress' AND created_at < {CUTOFF} THEN 'Server restarted before this task completed' END AS error,
  CASE WHEN status = 'in-progress' AND created_at < {CUTOFF} THEN {CUTOFF} END AS completed_at FROM jobs"""))
def mark_orphans(t):
    return J.mark_orphans(t.jobs, CUTOFF).select("id", "status", "error", "completed_at")


@query("u1_union_pages", fx("SELECT doc_id, page, CAST(0 AS INT) AS part FROM conv_pages UNION ALL SELECT doc_id, page, CAST(1 AS INT) FROM page_signals"))
def union_pages(t):
    return M.union_pages([t.conv_pages.select("doc_id", "page"), t.page_signals.select("doc_id", "page")])


@query("u2_union_distinct", """SELECT l_partkey AS part, l_suppkey AS supp FROM lineitem WHERE l_returnflag = 'R'
UNION SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'O'""")
def union_distinct(t):
    a = t.lineitem.where("l_returnflag = 'R'").selectExpr("l_partkey AS part", "l_suppkey AS supp")
    b = t.lineitem.where("l_linestatus = 'O'").selectExpr("l_suppkey AS supp", "l_partkey AS part")
    return M.union_distinct(a, b)
