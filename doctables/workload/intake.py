"""Source, sink and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from doctables.operators import jobs as J
from doctables.operators import pages as P
from doctables.plans.post_process import Settings, post_process, run_chain
from doctables.session import scratch_path
from doctables.sources import files, sinks
from doctables.streaming import jobs as ST
from doctables.workload import query
from doctables.workload.cleaning import RECORDS
from doctables.workload.export import DETAILS
from doctables.workload.fixtures import with_fixtures as fx
from doctables.workload.quality import GC, global_counts


@query("s1_scan_files", """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'txt' ELSE 'json' END AS ext, CASE WHEN page_id % 2 = 0 THEN strlen(html) + 1 END AS length, page_id % 2 = 0 AS accepted FROM pages""")
def scan_files(t):
    path = scratch_path(t.spark, "files")
    # every page as a file of its own, half of them of a kind that is not taken
    named = t.pages.select(F.col("page_id").cast("string").alias("file_name"), F.col("html").alias("markdown"), "page_id")
    sinks.write_markdown(named.where("page_id % 2 = 0"), f"{path}/texts", per_document=True)
    sinks.write_files(named.where("page_id % 2 = 1").drop("page_id"), f"{path}/others", "json")
    accepted, rejected = files.scan_files(t.spark, path)
    page = F.regexp_extract("path", r"file_name=(\d+)/", 1).cast("bigint").alias("page_id")
    # names that begin with an underscore mark finished writes
    return accepted.select(page, "ext", "length", F.lit(True).alias("accepted")).unionByName(
        rejected.where(F.col("path").contains("file_name=")).select(page, "ext", F.lit(None).cast("bigint").alias("length"), F.lit(False).alias("accepted")))


@query("s1_tag_files", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' WHEN 2 THEN 'exe' ELSE '' END AS ext,
  CASE page_id % 4 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime, page_id % 4 < 2 AS accepted FROM pages""")
def tag_files(t):
    named = t.pages.select("page_id", F.concat(F.lit("s3://b/x.y/"), F.col("page_id").cast("string"), F.expr("CASE page_id % 4 WHEN 0 THEN '.tar.HTML' WHEN 1 THEN '.pdf' WHEN 2 THEN '.exe' ELSE '' END")).alias("path"))
    accepted, rejected = files.tag_files(named)
    cols = ["page_id", "ext", "mime"]
    return accepted.select(*cols, F.lit(True).alias("accepted")).unionByName(rejected.select(*cols, F.lit(False).alias("accepted")))


@query("s2_scan_text_pages", "SELECT page_id, CAST(length(html) AS INT) AS content_length, md5(html) AS digest FROM pages")
def scan_text_pages(t):
    path = scratch_path(t.spark, "texts")
    sinks.write_markdown(t.pages.selectExpr("CAST(page_id AS STRING) AS file_name", "html AS markdown"), path, per_document=True)
    pages = files.scan_text_pages(t.spark, path)
    # the text sink ends a file with a line break
    body = F.regexp_replace("content", r"\n\z", "")
    return pages.select(F.regexp_extract("path", r"file_name=(\d+)/", 1).cast("bigint").alias("page_id"), F.length(body).alias("content_length"), F.md5(body).alias("digest"))


# a CSV file per nation: three kinds of headers, quoted commas, quotes and line breaks, a cell beyond the header
CSV_HEADS = {0: "id,name,segment", 1: "name,id", 2: 'id,"na""me",id'}
CSV_ROWS = {0: """'{id},"a, {name}",{segment}'""", 1: """'"two' || chr(10) || 'lines {name}",{id}'""", 2: "'{id},,{segment},\"say \"\"hi\"\"\"'"}


def _csv_row(kind):
    return CSV_ROWS[kind].replace("{id}", "' || CAST(c_custkey AS STRING) || '").replace("{name}", "' || c_name || '").replace("{segment}", "' || c_mktsegment || '")


@query("s2_scan_csv_rows", """
SELECT CAST(c_nationkey AS BIGINT) AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS row_no, CAST(c_custkey AS VARCHAR) AS id,
  CASE c_nationkey % 3 WHEN 0 THEN 'a, ' || c_name WHEN 1 THEN 'two' || chr(10) || 'lines ' || c_name END AS name, CASE WHEN c_nationkey % 3 = 0 THEN c_mktsegment END AS segment,
  CASE WHEN c_nationkey % 3 = 2 THEN c_mktsegment END AS third, CASE WHEN c_nationkey % 3 = 2 THEN 'say "hi"' END AS fourth, CASE c_nationkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 4 END AS n_cells FROM customer""")
def scan_csv_rows(t):
    from doctables.operators.pages import join_ordered
    path = scratch_path(t.spark, "csv")
    kind = F.expr("c_nationkey % 3")
    row = F.when(kind == 0, F.expr(_csv_row(0))).when(kind == 1, F.expr(_csv_row(1))).otherwise(F.expr(_csv_row(2)))
    head = F.when(kind == 0, CSV_HEADS[0]).when(kind == 1, CSV_HEADS[1]).otherwise(CSV_HEADS[2])
    body = t.customer.withColumn("row", row).groupBy("c_nationkey").agg(join_ordered(["c_custkey"], "row", "\n").alias("body"))
    sinks.write_markdown(body.select(F.col("c_nationkey").cast("string").alias("file_name"), F.concat(head, F.lit("\n"), "body").alias("markdown")), path, per_document=True)
    rows, cell = files.scan_csv_rows(t.spark, path), lambda n: F.try_element_at("cells", F.lit(n))
    return rows.select(F.regexp_extract("path", r"file_name=(\d+)/", 1).cast("bigint").alias("nation"), "row_no", cell("id").alias("id"), cell("name").alias("name"),
                       cell("segment").alias("segment"), cell("_c2").alias("third"), cell("_c3").alias("fourth"), F.size("cells").alias("n_cells"))


@query("s8_write_markdown", fx("SELECT doc_id, md5(string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page)) AS digest FROM conv_pages GROUP BY doc_id"))
def write_markdown(t):
    path = scratch_path(t.spark, "markdown")
    docs = P.assemble(t.conv_pages).select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("file_name"), "markdown")
    sinks.write_markdown(docs, path)
    back = t.spark.read.schema("file_name string, markdown string").json(path)
    return back.select(F.substring("file_name", 4, 20).cast("bigint").alias("doc_id"), F.md5("markdown").alias("digest"))


OUTPUT = """'warning: x ' || CASE WHEN doc_id % 5 = 0 THEN '{"pages":[],"usable":false}' WHEN doc_id % 5 = 1 THEN 'crashed' ELSE"""


@query("s3_scan_converted", """
SELECT doc_id, doc_id % 2 = 0 AS usable, CAST(n AS INT) AS page, CAST(CASE n WHEN 1 THEN length(text) ELSE 6 END AS INT) AS content_length FROM documents, (SELECT unnest([1, 2]) AS n) WHERE doc_id % 5 > 1""")
def scan_converted(t):
    body = F.concat(F.lit("warning: x\n"), F.to_json(F.struct(F.array("text", F.lit("page 2")).alias("pages"), F.lit(2).alias("total"), F.expr("doc_id % 2 = 0").alias("usable"))), F.lit("\ndone"))
    raw = t.documents.select("doc_id", F.when(F.expr("doc_id % 5 = 0"), '{"pages":[],"usable":false}').when(F.expr("doc_id % 5 = 1"), "crashed").otherwise(body).alias("output"))
    return files.scan_converted(raw)[0].select("doc_id", "usable", "page", "content_length")


@query("s3_converter_errors", "SELECT doc_id, 'no pages' AS error FROM documents WHERE doc_id % 5 < 2")
def converter_errors(t):
    body = F.to_json(F.struct(F.array("text").alias("pages"), F.lit(True).alias("usable")))
    raw = t.documents.select("doc_id", F.when(F.expr("doc_id % 5 = 0"), '{"pages":[],"usable":false}').when(F.expr("doc_id % 5 = 1"), "crashed").otherwise(body).alias("output"))
    return files.scan_converted(raw)[1]


CATALOG_ROWS = {
    "users": "id || '|' || email || '|' || coalesce(first_name, '') || '|' || coalesce(company_id, '') || '|' || CAST(role AS STRING) || '|' || CAST(created_at AS STRING)",
    "companies": "id || '|' || name",
    "api_keys": "id || '|' || user_id || '|' || key || '|' || name",
    "templates": "id || '|' || name || '|' || coalesce(keywords, '') || '|' || coalesce(domain, '') || '|' || CAST(created_at AS STRING)",
    "jobs": "id || '|' || file_name || '|' || status || '|' || coalesce(template_name, '') || '|' || CAST(created_at AS STRING) || '|' || coalesce(CAST(calls AS STRING), '')",
    "app_settings": "key || '|' || value",
    "stats": "CAST(id AS STRING) || '|' || CAST(total_calls AS STRING) || '|' || CAST(successful AS STRING) || '|' || CAST(failed AS STRING)",
}
APP_SETTINGS = "SELECT 'domains.' || r_name AS key, '[\"' || r_name || '\"]' AS value FROM region"
STATS = """SELECT CAST(1 AS BIGINT) AS id, count(*) AS total_calls, count(CASE WHEN status = 'done' THEN 1 END) AS successful,
  count(CASE WHEN status = 'error' THEN 1 END) AS failed FROM jobs WHERE status <> 'in-progress'"""


@query("s4_load_catalog", fx("WITH app_settings AS (" + APP_SETTINGS + "), stats AS (" + STATS + ") " + " UNION ALL ".join(
    f"SELECT '{n}' AS name, md5({row.replace('STRING', 'VARCHAR')}) AS digest FROM {n}" for n, row in CATALOG_ROWS.items())))
def load_catalog(t):
    folder = scratch_path(t.spark, "catalog")
    made = {"app_settings": t.spark.sql(APP_SETTINGS.replace("FROM region", "FROM {region}"), region=t.region),
            "stats": t.spark.sql(STATS.replace("FROM jobs", "FROM {jobs}"), jobs=t.jobs)}
    for name in files.CATALOG:
        (made[name] if name in made else getattr(t, name)).write.parquet(f"{folder}/{name}")
    out = None
    for name, df in files.load_catalog(t.spark, folder).items():
        one = df.select(F.lit(name).alias("name"), F.md5(F.expr(CATALOG_ROWS[name])).alias("digest"))
        out = one if out is None else out.unionByName(one)
    return out


@query("s5_scan_results", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' ELSE '{}' END AS result FROM events""")
def scan_results(t):
    stored = t.events.select("event_id", F.when(F.expr("event_id % 3 = 0"), F.col("props")).when(F.expr("event_id % 3 = 1"), "{oops").alias("result_data"))
    return files.scan_results(stored)


@query("s7_write_details_csv", fx(f'SELECT doc_id, "Key" AS key, "Value" AS value FROM ({DETAILS})'))
def write_details_csv(t):
    """Every key and value of every document, read back."""
    from doctables.operators.export import details_table
    from doctables.workload.export import records
    path = scratch_path(t.spark, "details")
    sinks.write_details_csv(details_table(records(t)), path)
    back = t.spark.read.schema("doc_id bigint, Key string, Value string").option("header", "true").option("escape", '"').csv(path)
    return back.select("doc_id", F.col("Key").alias("key"), F.coalesce("Value", F.lit("")).alias("value"))


@query("s9_write_jobs", fx("SELECT id, status, '{\"total\":' || CAST(total_ms AS VARCHAR) || '}' AS timing, created_at FROM jobs"))
def write_jobs(t):
    path = scratch_path(t.spark, "jobs")
    sinks.write_jobs(t.jobs.select("id", "status", F.struct(F.col("total_ms").alias("total")).alias("timing"), "created_at"), path, grain="month")
    return t.spark.read.parquet(path).select("id", "status", "timing", "created_at")


@query("s11_storage_keys", """
SELECT page_id, regexp_replace(list_last(string_split(url, '/')), '[^0-9A-Za-z_.\\- ]+', '_', 'g') AS safe_name,
  'in/box/' || CAST(page_id % 7 AS VARCHAR) || '/' || regexp_replace(list_last(string_split(url, '/')), '[^0-9A-Za-z_.\\- ]+', '_', 'g') AS storage_key FROM pages""")
def storage_keys(t):
    uploads = t.pages.select("page_id", F.expr("CAST(page_id % 7 AS STRING)").alias("job_id"), F.col("url").alias("file_name"))
    return files.storage_keys(uploads, "//in/box/").select("page_id", "safe_name", "storage_key")


@query("s12_file_stem", """
SELECT page_id, left(lower(regexp_replace(regexp_replace(split_part(list_last(string_split(url || ' My File.v2.pdf', '/')), '.', 1), '[^0-9A-Za-z_\\s]', '', 'g'), '\\s+', '_', 'g')), 255) AS stem FROM pages""")
def stem(t):
    return files.file_stem(t.pages.select("page_id", F.concat("url", F.lit(" My File.v2.pdf")).alias("name")), "name").select("page_id", "stem")


# the chain from the base rows: {input} has the rows, {read} turns DD-MM-YYYY into the format of the chain
CHAIN = f"""
WITH lines AS (SELECT doc_id, page, pos, clock, replace(date_text, '.', '-') AS dmy, regexp_replace(line, '\\s', '', 'g') AS flat FROM rendered WHERE kind = 'movement' AND length(date_text) = 10),
dated AS (
  SELECT i.* EXCLUDE (date), coalesce((SELECT {{read_line}} FROM lines l WHERE l.doc_id = i.doc_id AND contains(l.flat, i.flight_number) AND (i.time IS NULL OR l.clock = i.time) ORDER BY l.page, l.pos LIMIT 1),
    {{read_item}}) AS date FROM ({{input}}) i),
src AS (
  SELECT d.doc_id, d.flight_number, d.date, min(l.clock) AS clock FROM (SELECT DISTINCT doc_id, flight_number, date FROM dated WHERE flight_number IS NOT NULL) d
  JOIN lines l ON l.doc_id = d.doc_id AND l.dmy = d.date AND contains(l.flat, d.flight_number) GROUP BY ALL HAVING count(*) = 1),
r AS (
  SELECT d.*, page * 100000000000000000000000 + pos AS atp, s.clock IS NOT NULL AS sourced,
    (coalesce(registration, 'null') <> 'null')::INT + (time IS NOT NULL)::INT + (airport <> '')::INT AS complete
  FROM dated d LEFT JOIN src s USING (doc_id, flight_number, date) WHERE flight_number IS NOT NULL),
g AS (SELECT *, min(time) OVER gw AS lo, max(time) OVER gw AS hi FROM r WINDOW gw AS (PARTITION BY doc_id, flight_number, date)),
p AS (SELECT *, CASE WHEN sourced THEN 'source' ELSE coalesce(time, CASE WHEN lo = hi THEN lo ELSE '?' || CAST(atp AS VARCHAR) END) END AS part FROM g),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, flight_number, date, part, charges_type) AS nt FROM p),
x AS (SELECT *, max(nt) OVER (PARTITION BY doc_id, flight_number, date, part) AS top FROM n),
y AS (SELECT doc_id, flight_number, date, part, count(DISTINCT charges_type) FILTER (WHERE nt = top) AS tied FROM x GROUP BY ALL),
z AS (SELECT x.*, tied > 1 AND ((flight_number LIKE '%/A' AND charges_type ILIKE '%landing%') OR (flight_number LIKE '%/D' AND charges_type ILIKE '%takeoff%')) AS favored
  FROM x JOIN y USING (doc_id, flight_number, date, part)),
moved AS (
  SELECT doc_id, array_name, page, pos, description, charges_type, flight_number, date, net_amount, airport FROM z
  QUALIFY row_number() OVER (PARTITION BY doc_id, flight_number, date, part ORDER BY favored DESC, CASE WHEN favored THEN 0 ELSE -complete END, time IS NULL AND NOT sourced, atp) = 1
  UNION ALL SELECT doc_id, array_name, page, pos, description, charges_type, flight_number, date, net_amount, airport FROM dated WHERE flight_number IS NULL),
rec AS ({RECORDS}),
enough AS (SELECT doc_id FROM rec GROUP BY doc_id HAVING count(*) >= {{least}}),
c AS (SELECT doc_id, airport, count(*) AS n, min(page * 10000000000000000 + pos) AS f FROM moved WHERE airport <> '' GROUP BY ALL),
m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1),
done AS (
  SELECT r.doc_id, 'line_items' AS array_name, r.page, coalesce(r.charges_type, 'Landing Charge') AS description, coalesce(r.charges_type, 'Landing Charge') AS charges_type, r.flight_number,
    {{read_record}} AS date, r.net_amount, coalesce(m.airport, {{airport}}) AS airport FROM rec r JOIN enough USING (doc_id) LEFT JOIN m ON m.doc_id = r.doc_id
  UNION ALL SELECT doc_id, array_name, page, description, charges_type, flight_number, date, net_amount, airport FROM moved WHERE doc_id NOT IN (SELECT doc_id FROM enough))
SELECT doc_id, array_name, page, description, CASE WHEN charges_type ILIKE 'landing%' THEN 'LANDING FEES' WHEN trim(charges_type) ILIKE 'take%' THEN 'TAKE OFF FEES' ELSE charges_type END AS charges_type,
  flight_number, date, net_amount, airport FROM done WHERE NOT charges_type ILIKE '%noise%'"""
ISO = "substr({0}, 7) || '-' || substr({0}, 4, 2) || '-' || substr({0}, 1, 2)"
CHAIN_COLUMNS = {"description": "string", "charges_type": "string", "flight_number": "string", "date": "string", "net_amount": "double", "airport": "string"}


@query("r3_post_process", fx(CHAIN.format(
    input="SELECT *, aircraft_registration AS registration FROM items", read_line=ISO.format("l.dmy"), read_item=ISO.format("i.date"), read_record=ISO.format("r.date"), least=10, airport="NULL")))
def chain(t):
    out = post_process(t.items.drop("tax", "quantity"), t.invoice_pages, Settings(
        domain="aviation", date_columns=["date"], date_format="YYYY-MM-DD", date_input_format="DD.MM.YYYY", columns=CHAIN_COLUMNS, filter={"dropIf": ["noise"]}))
    return out.drop("pos")


# what a reading page by page gives: every line once more on a later page, with some values left out
PAGE_ROWS = """SELECT doc_id, array_name, page, pos, flight_number, date, description, charges_type, net_amount, airport FROM items
UNION ALL SELECT doc_id, array_name, CAST(9 AS INT), pos, flight_number, date, CASE WHEN pos % 3 = 0 THEN '' ELSE description END, charges_type,
  CASE WHEN pos % 2 = 0 THEN net_amount END, CASE WHEN pos % 5 = 0 THEN '' ELSE airport END FROM items"""


def page_chain(t, counts=None):
    rows = t.spark.sql(PAGE_ROWS.replace("FROM items", "FROM {items}"), items=t.items)
    stored = t.nation.where("n_nationkey = 0").select(F.lit("domains").alias("key"), F.to_json(F.struct(F.struct(
        F.lit("Own").alias("label"), F.expr("named_struct('LANDING FEES', array('^landing'), 'TAKE OFF FEES', '^take')").alias("chargeTypeAliases"),
        F.struct(F.lit("XXX").alias("defaultAirport")).alias("movementPattern")).alias("mine"))).alias("value"))
    return run_chain(rows, t.invoice_pages, Settings(
        domain="mine", date_columns=["date"], date_format="DD-MM-YYYY", date_input_format="DD.MM.YYYY", columns=CHAIN_COLUMNS, filter={"dropIf": ["noise"]},
        min_records=4, per_page=True), stored, counts=counts)


@query("r3_page_chain", fx(CHAIN.format(
    input="SELECT *, CAST(NULL AS VARCHAR) AS registration FROM (SELECT * REPLACE (CAST(NULL AS VARCHAR) AS time) FROM items)", read_line="l.dmy", read_item="i.date", read_record="r.date", least=4, airport="'XXX'")))
def chain_of_pages(t):
    return page_chain(t)["rows"].drop("pos")


@query("r3_page_reports", fx(f"""
SELECT g.doc_id, g.array_name, CAST(g.counted AS BIGINT) AS expected, a.actual FROM ({GC}) g
JOIN (SELECT doc_id, array_name, count(*) AS actual FROM items GROUP BY ALL) a ON a.doc_id = g.doc_id AND a.array_name = g.array_name WHERE a.actual <> g.counted"""))
def chain_reports(t):
    return page_chain(t, global_counts(t))["coverage"].select("doc_id", "array_name", "expected", "actual")


@query("st1_stream_documents", "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines FROM documents")
def stream_documents(t):
    source, out = scratch_path(t.spark, "inbox"), scratch_path(t.spark, "outbox")
    t.documents.select("doc_id", "text").write.parquet(source)
    ST.stream_documents(t.spark, source, "doc_id bigint, text string",
                        lambda b: b.select("doc_id", F.size(F.split("text", "\n")).cast("bigint").alias("n_lines")), out, scratch_path(t.spark, "state"))
    return t.spark.read.parquet(out).select("doc_id", "n_lines")


def event_stream(t, label):
    source = scratch_path(t.spark, label)
    t.events.select("ts", "user_id", "event_type", "value").write.parquet(source)
    return ST.job_events(t.spark.readStream.schema("ts timestamp_ntz, user_id bigint, event_type string, value double").parquet(source))


def drained(t, df):
    """The rows of a finished stream."""
    out = scratch_path(t.spark, "rows")
    with ST.rocksdb(t.spark):
        query = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(t.spark, "state"))
                 .trigger(availableNow=True).start())
    query.awaitTermination()
    return t.spark.read.schema(df.schema).parquet(out)


# what the watermark has passed at the end: the latest event less the delay
PASSED = """
e AS (SELECT user_id, epoch_us(ts) AS us, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE {other} END AS kind, value FROM events),
h AS (SELECT max(us) // 1000 - {delay} AS passed FROM e)"""


@query("st2_stream_job_counters", f"""
WITH {PASSED.format(other="'in-progress'", delay=3_600_000).strip()},
f AS (SELECT e.* FROM e, h WHERE kind <> 'in-progress' AND us // 1000 < passed QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us, kind, value) = 1)
SELECT count(*) AS total, count(*) FILTER (WHERE kind = 'done') AS successful, count(*) FILTER (WHERE kind = 'error') AS failed,
  CAST(sum(CAST(value / 1000 AS DECIMAL(28, 6))) AS DOUBLE) AS total_cost, count(*) AS total_calls FROM f""")
def stream_job_counters(t):
    return ST.count_finished(drained(t, ST.stream_finished_jobs(event_stream(t, "events"))))


TTL, TIMEOUT = 21_600_000, 10_800_000


@query("st3_stream_job_state", f"""
WITH RECURSIVE {PASSED.format(other="CASE event_type WHEN 'view' THEN 'read' ELSE 'in-progress' END", delay=10_000).strip()},
o AS MATERIALIZED (SELECT e.*, row_number() OVER (PARTITION BY user_id ORDER BY us, kind) AS i FROM e, h WHERE us // 1000 < passed),
f AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS BIGINT) AS deadline, CAST(NULL AS BIGINT) AS gone, CAST(NULL AS VARCHAR) AS shown, CAST(NULL AS BIGINT) AS us FROM o
  UNION ALL
  SELECT user_id, i, CASE kind WHEN 'read' THEN status ELSE kind END, CASE WHEN kind = 'read' AND status IN ('done', 'error') AND deadline IS NULL THEN us + {TTL * 1000} ELSE deadline END,
    gone, CASE WHEN kind <> 'read' THEN kind END, us
  FROM (SELECT o.user_id, o.i, o.kind, o.us, CASE WHEN f.deadline <= o.us THEN f.deadline END AS gone, CASE WHEN f.deadline <= o.us THEN NULL ELSE f.status END AS status,
    CASE WHEN f.deadline <= o.us THEN NULL ELSE f.deadline END AS deadline FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)),
last AS (SELECT user_id, arg_max(coalesce(deadline, -1), i) AS deadline FROM f GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS job_id, shown AS state, us FROM f WHERE shown IS NOT NULL
UNION ALL SELECT CAST(user_id AS VARCHAR), 'expired', gone FROM f WHERE gone IS NOT NULL
UNION ALL SELECT CAST(user_id AS VARCHAR), 'expired', deadline FROM last, h WHERE deadline BETWEEN 0 AND passed * 1000 - 1""")
def stream_job_state(t):
    def of(kind):
        source = scratch_path(t.spark, "events")
        t.events.where(f"event_type {kind} 'view'").select("ts", "user_id", "event_type", "value").write.parquet(source)
        return ST.job_events(t.spark.readStream.schema("ts timestamp_ntz, user_id bigint, event_type string, value double").parquet(source))
    out = drained(t, ST.stream_job_state(of("<>"), of("=").select("job_id", "ts"), TTL))
    return out.select("job_id", "state", F.unix_micros("ts").alias("us"))


@query("st4_stream_orphans", f"""
WITH RECURSIVE {PASSED.format(other="'in-progress'", delay=10_000).strip()},
s AS (SELECT user_id, us, kind FROM e UNION ALL SELECT user_id, min(us) - 86400000000, 'in-progress' FROM e WHERE user_id % 2 = 0 GROUP BY user_id),
o AS MATERIALIZED (SELECT s.*, row_number() OVER (PARTITION BY user_id ORDER BY us, kind) AS i FROM s, h WHERE us // 1000 < passed),
f AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS created, CAST(NULL AS BIGINT) AS gone FROM o
  UNION ALL
  SELECT user_id, i, CASE WHEN kind = 'in-progress' THEN coalesce(created, us) END, gone
  FROM (SELECT o.user_id, o.i, o.kind, o.us, CASE WHEN f.created + {TIMEOUT * 1000} <= o.us THEN f.created END AS gone,
    CASE WHEN f.created + {TIMEOUT * 1000} <= o.us THEN NULL ELSE f.created END AS created FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)),
last AS (SELECT user_id, arg_max(coalesce(created, -1), i) AS created FROM f GROUP BY user_id),
g AS (SELECT user_id, gone FROM f WHERE gone IS NOT NULL UNION ALL SELECT user_id, created FROM last, h WHERE created >= 0 AND created + {TIMEOUT * 1000} <= passed * 1000 - 1)
SELECT CAST(user_id AS VARCHAR) AS job_id, 'error' AS status, 'Server restarted before this task completed' AS error, gone AS created_us, gone + {TIMEOUT * 1000} AS completed_us FROM g""")
def stream_orphans(t):
    events = event_stream(t, "events")
    # every second job is known from the stored table, created a day before its first event
    known = ST.job_events(t.events).where("job_id % 2 = 0").groupBy("job_id").agg((F.min("ts") - F.expr("INTERVAL 1 DAY")).alias("ts"), F.lit("in-progress").alias("status"))
    out = drained(t, ST.stream_orphans(events, known, TIMEOUT))
    return out.select("job_id", "status", "error", F.unix_micros("created_at").alias("created_us"), F.unix_micros("completed_at").alias("completed_us"))
