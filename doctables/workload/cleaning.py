"""Record extraction and cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from doctables.operators import cleaning as C
from doctables.operators import filters as FL
from doctables.operators import records as R
from doctables.operators.extract import DOMAINS
from doctables.workload import query
from doctables.workload.fixtures import with_fixtures as fx

AVIATION = DOMAINS["aviation"]

# nearest movements and the stop flag, from the base rows instead of the text
SCANNED = """
mv AS (SELECT *, CASE WHEN kind = 'movement' AND style <> 1 THEN pos END AS arr_pos, CASE WHEN kind = 'movement' AND style <> 0 THEN pos END AS dep_pos FROM rendered),
sc AS (SELECT *, max(arr_pos) OVER w AS last_arr, max(dep_pos) OVER w AS last_dep,
    kind = 'total' AND coalesce(max(kind = 'movement') OVER (PARTITION BY doc_id ORDER BY page, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS is_stop
  FROM mv WINDOW w AS (PARTITION BY doc_id ORDER BY page, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
st AS (SELECT *, coalesce(max(is_stop) OVER (PARTITION BY doc_id ORDER BY page, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS stopped,
    row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) + 3 AS line_no FROM sc)"""

RECORDS = f"""
WITH {SCANNED.strip()},
charges AS (
  SELECT doc_id, page, line_no, 0 AS n, pos AS mov_pos, 'own' AS what, amount, CAST(NULL AS VARCHAR) AS name FROM st WHERE kind = 'movement' AND NOT stopped AND amount > 1
  UNION ALL SELECT doc_id, page, line_no, 0, last_arr, 'arr', amount, 'Landing Fee' FROM st WHERE kind = 'pairs' AND NOT stopped
  UNION ALL SELECT doc_id, page, line_no, 1, last_dep, 'dep', CAST(replace(fee_text, ',', '.') AS DOUBLE), 'Take off Fee' FROM st WHERE kind = 'pairs' AND NOT stopped
  UNION ALL SELECT doc_id, page, line_no, 0, last_arr, 'arr', amount, 'LANDING FEES' FROM st WHERE kind = 'fee' AND NOT stopped AND amount > 1)
SELECT c.doc_id, c.page, CAST(c.line_no AS INT) AS line_no,
  CASE WHEN c.what = 'dep' THEN CASE m.style WHEN 2 THEN split_part(m.flights, ' ', 2) ELSE m.flights END
    WHEN m.style = 2 THEN split_part(m.flights, ' ', 1) WHEN m.style = 1 THEN NULL ELSE m.flights END AS flight_number,
  m.reg AS aircraft_registration,
  replace(substr(m.date_text, 1, 5), '.', '-') || '-' || CASE WHEN length(m.date_text) = 5 THEN '2024' ELSE substr(m.date_text, 7) END AS date,
  m.origin, c.amount AS net_amount, c.name AS charges_type, CASE WHEN c.what = 'arr' THEN m.clock END AS ata, CASE WHEN c.what = 'dep' THEN m.clock END AS atd
FROM charges c JOIN rendered m ON m.doc_id = c.doc_id AND m.pos = c.mov_pos"""


@query("r1_extract_records", fx(RECORDS))
def extract_records(t):
    return R.extract_records(t.invoice_pages, AVIATION).select(
        "doc_id", "page", "line_no", "flight_number", "aircraft_registration", "date", "origin", "net_amount", "charges_type", "ata", "atd")


@query("w1_scan_movements", fx(f"""WITH {SCANNED.strip()}
SELECT s.doc_id, s.page, CAST(s.line_no AS INT) AS line_no, a.reg AS arrival_reg, d.reg AS departure_reg FROM st s
LEFT JOIN rendered a ON a.doc_id = s.doc_id AND a.pos = s.last_arr LEFT JOIN rendered d ON d.doc_id = s.doc_id AND d.pos = s.last_dep"""))
def scan_movements(t):
    out = R.scan_movements(R.movement_lines(t.invoice_pages, AVIATION))
    return out.select("doc_id", "page", "line_no", F.col("arrival.reg").alias("arrival_reg"), F.col("departure.reg").alias("departure_reg"))


@query("w2_stop_at_total", fx(f"WITH {SCANNED.strip()} SELECT doc_id, page, CAST(line_no AS INT) AS line_no FROM st WHERE NOT stopped"))
def stop_at_total(t):
    return R.stop_at_total(R.movement_lines(t.invoice_pages, AVIATION)).select("doc_id", "page", "line_no")


@query("j9_attach_charges", fx(f"""
{RECORDS.replace("SELECT c.doc_id, c.page", "SELECT doc_id, count(*) AS charges, CAST(sum(CAST(net_amount AS DECIMAL(18, 2))) AS DOUBLE) AS amount FROM (SELECT c.doc_id, c.page", 1)}) GROUP BY doc_id"""))
def attach_charges(t):
    charges = R.attach_charges(R.movement_lines(t.invoice_pages, AVIATION))
    return charges.groupBy("doc_id").agg(F.count("*").alias("charges"), F.sum(F.col("charge.amount").cast("decimal(18,2)")).cast("double").alias("amount"))


SCHEMA_COLUMNS = {"description": "string", "charges_type": "string", "flight_number": "string", "net_amount": "double", "tax": "double", "airport": "string"}
# documents by supplier, so that many reach ten records
SUPPLIER_ITEMS = "SELECT doc_id % 50 AS doc_id, page, pos * 1000 + doc_id // 50 AS pos, array_name, description, charges_type, flight_number, net_amount, tax, airport FROM items"


@query("a9_mode_value", fx("""
WITH c AS (SELECT doc_id, airport, count(*) AS n, min(page * 10000000000000000 + pos) AS f FROM items WHERE airport <> '' AND airport NOT LIKE '%3' GROUP BY ALL)
SELECT d.doc_id, coalesce(m.airport, 'none') AS mode FROM (SELECT DISTINCT doc_id FROM items) d LEFT JOIN (
  SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1) m ON m.doc_id = d.doc_id"""))
def mode_value(t):
    return R.mode_value(t.items, ["doc_id"], "airport", ["page", "pos"], "3$", "none")


@query("r2_rebuild_rows", fx(f"""
WITH rec AS ({RECORDS.strip()}), n AS (SELECT doc_id FROM rec GROUP BY doc_id HAVING count(*) >= 4),
c AS (SELECT doc_id, airport, count(*) AS k, min(page * 10000000000000000 + pos) AS f FROM items WHERE airport <> '' GROUP BY ALL),
m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, f) = 1)
SELECT r.doc_id, coalesce(r.charges_type, 'Landing Charge') AS description, coalesce(r.charges_type, 'Landing Charge') AS charges_type, r.flight_number, r.net_amount,
  CAST(0 AS DOUBLE) AS tax, coalesce(m.airport, 'XXX') AS airport FROM rec r JOIN n ON n.doc_id = r.doc_id LEFT JOIN m ON m.doc_id = r.doc_id
UNION ALL SELECT doc_id, description, charges_type, flight_number, net_amount, tax, airport FROM items WHERE doc_id NOT IN (SELECT doc_id FROM n)"""))
def rebuild_rows(t):
    records = R.extract_records(t.invoice_pages, AVIATION)
    return R.rebuild_rows(records, t.items, SCHEMA_COLUMNS, min_records=4, default_airport="XXX").drop("array_name", "page", "pos")


# repeated rows: every line of an order once more on page 9
REPEATED = """SELECT doc_id, array_name, page, pos, flight_number, date, description, net_amount FROM items
UNION ALL SELECT doc_id, array_name, CAST(9 AS INT), pos, flight_number, date, CASE WHEN pos % 3 = 0 THEN '' ELSE description END, CASE WHEN pos % 2 = 0 THEN net_amount END FROM items"""


def repeated(t):
    return t.spark.sql(REPEATED.replace("FROM items", "FROM {items}"), items=t.items)


@query("w4_dedupe_rows", fx(f"""SELECT doc_id, page, pos, description, net_amount FROM ({REPEATED})
QUALIFY row_number() OVER (PARTITION BY doc_id, flight_number, date, description, net_amount ORDER BY page, pos) = 1"""))
def dedupe_rows(t):
    # no order repeats a row more than 50 kept rows later, so the look-back bound does not show in the check
    return C.dedupe_rows(repeated(t), merge=False).select("doc_id", "page", "pos", "description", "net_amount")


@query("w4_dedupe_exact", fx(f"""SELECT doc_id, min(page * 10000000000000000 + pos) AS place, description, net_amount FROM ({REPEATED}) GROUP BY doc_id, flight_number, date, description, net_amount"""))
def dedupe_exact(t):
    return C.dedupe_exact(repeated(t)).select("doc_id", (F.col("page") * 10000000000000000 + F.col("pos")).alias("place"), "description", "net_amount")


# a repeated line holds only values of its first copy, so the first copies remain
@query("w5_merge_subset_rows", fx("SELECT doc_id, array_name, page, pos, flight_number, date, description, net_amount FROM items"))
def merge_subset_rows(t):
    return C.merge_subset_rows(repeated(t))


# all orders of a group as one long document, an order's pages apart from the next one's, so that documents span many blocks of pages
LONG_ROWS = """SELECT doc_id % 40 AS doc_id, array_name, CAST(floor(doc_id / 40) * 60 + page AS INT) AS page, pos, {columns} FROM items"""
LOOK_BACK = """
WITH RECURSIVE ordered AS MATERIALIZED (
  SELECT *, charges_type || '|' || quantity || '|' || coalesce(airport, '') AS x, row_number() OVER (PARTITION BY doc_id ORDER BY page, pos, charges_type, quantity, airport) AS i FROM ({rows})),
fold AS (
  SELECT doc_id, i, [x] AS recent, true AS kept FROM ordered WHERE i = 1
  UNION ALL
  SELECT o.doc_id, o.i, CASE WHEN list_contains(f.recent, o.x) THEN f.recent ELSE list_append(f.recent, o.x)[-50:] END, NOT list_contains(f.recent, o.x)
  FROM fold f JOIN ordered o ON o.doc_id = f.doc_id AND o.i = f.i + 1)
SELECT o.doc_id, o.page, o.pos, o.charges_type, o.quantity, o.airport FROM ordered o JOIN fold f ON f.doc_id = o.doc_id AND f.i = o.i WHERE f.kept"""


@query("w4_dedupe_long_documents", fx(LOOK_BACK.replace("{rows}", LONG_ROWS.format(columns="charges_type, quantity, airport"))))
def dedupe_long_documents(t):
    # rows repeat both within the last 50 kept ones and beyond them
    rows = t.spark.sql(LONG_ROWS.format(columns="charges_type, quantity, airport").replace("FROM items", "FROM {items}"), items=t.items)
    return C.dedupe_rows(rows, merge=False).drop("array_name")


MERGE_BACK = """
WITH RECURSIVE ordered AS MATERIALIZED (
  SELECT *, page * 10000000000000000::HUGEINT + pos AS place, coalesce(flight_number, '') AS ident, coalesce(trim(charges_type), '') AS c, coalesce(trim(airport), '') AS a,
    coalesce(flight_number, chr(1)) || '|' || coalesce(charges_type, chr(1)) || '|' || coalesce(airport, chr(1)) AS x,
    row_number() OVER (PARTITION BY doc_id ORDER BY page, pos, charges_type, airport) AS i FROM ({rows})),
fold AS (
  SELECT doc_id, i, [{'place': place, 'ident': ident, 'x': x, 'c': c, 'a': a, 'from': i}] AS recent FROM ordered WHERE i = 1
  UNION ALL
  SELECT doc_id, i, CASE
      WHEN same OR (t > 0 AND NOT fuller AND poorer) THEN recent
      WHEN t > 0 AND fuller THEN list_transform(recent, lambda e, k: CASE WHEN k = t THEN {'place': e.place, 'ident': e.ident, 'x': e.x, 'c': c, 'a': a, 'from': i} ELSE e END)
      ELSE list_append(recent, {'place': place, 'ident': ident, 'x': x, 'c': c, 'a': a, 'from': i})[-50:] END
  FROM (
    SELECT *, recent[t].c IN ('', c) AND recent[t].a IN ('', a) AS fuller, c IN ('', recent[t].c) AND a IN ('', recent[t].a) AS poorer FROM (
      SELECT o.*, f.recent, list_contains(list_transform(f.recent, lambda e: e.x), o.x) AS same,
        CASE WHEN o.ident = '' THEN 0 ELSE coalesce(list_position(list_transform(f.recent, lambda e: e.ident), o.ident), 0) END AS t
      FROM fold f JOIN ordered o ON o.doc_id = f.doc_id AND o.i = f.i + 1))),
last AS (SELECT doc_id, e.place AS place, max(e.from) AS i FROM (SELECT doc_id, unnest(recent) AS e FROM fold) GROUP BY ALL)
SELECT l.doc_id, p.page, p.pos, o.flight_number, o.charges_type, o.airport
FROM last l JOIN ordered o ON o.doc_id = l.doc_id AND o.i = l.i JOIN (SELECT DISTINCT doc_id, place, page, pos FROM ordered) p ON p.doc_id = l.doc_id AND p.place = l.place"""


@query("w5_merge_long_documents", fx(MERGE_BACK.replace("{rows}", LONG_ROWS.format(columns="flight_number, charges_type, airport"))))
def merge_long_documents(t):
    rows = t.spark.sql(LONG_ROWS.format(columns="flight_number, charges_type, airport").replace("FROM items", "FROM {items}"), items=t.items)
    return C.merge_subset_rows(rows).drop("array_name")


@query("j6_normalize_by_alias", fx("""SELECT doc_id, pos, CASE WHEN charges_type LIKE 'landing%' THEN 'LANDING FEES' WHEN trim(charges_type) LIKE 'Takeoff%' THEN 'TAKE OFF FEES' ELSE charges_type END AS charges_type FROM items"""))
def normalize_by_alias(t):
    nested = t.items.select("doc_id", "pos", F.array(F.struct("charges_type")).alias("rows"))
    out = C.normalize_by_alias(nested, AVIATION["charge_aliases"])
    return out.select("doc_id", "pos", F.get("rows.charges_type", F.lit(0)).alias("charges_type"))


MOVES = """SELECT doc_id % {k} AS doc_id, array_name, page, pos * 1000000 + doc_id AS pos, flight_number, date, time, charges_type, airport FROM items"""
CANON = """
WITH base AS ({moves}),
r AS (SELECT *, page * 100000000000000000000000 + pos AS atp, CASE WHEN flight_number IS NOT NULL THEN 1 ELSE 0 END + 1 + 1 +
    CASE WHEN time IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN airport <> '' THEN 1 ELSE 0 END AS complete FROM base WHERE flight_number IS NOT NULL),
g AS (SELECT *, min(time) OVER gw AS lo, max(time) OVER gw AS hi FROM r WINDOW gw AS (PARTITION BY doc_id, flight_number, date)),
p AS (SELECT *, coalesce(time, CASE WHEN lo = hi THEN lo ELSE '?' || CAST(atp AS VARCHAR) END) AS part FROM g),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, flight_number, date, part, charges_type) AS nt FROM p),
x AS (SELECT *, max(nt) OVER pw AS top FROM n WINDOW pw AS (PARTITION BY doc_id, flight_number, date, part)),
y AS (SELECT doc_id, flight_number, date, part, count(DISTINCT charges_type) FILTER (WHERE nt = top) AS tied FROM x GROUP BY ALL),
z AS (SELECT x.*, tied > 1 AND ((flight_number LIKE '%/A' AND charges_type ILIKE '%landing%') OR (flight_number LIKE '%/D' AND charges_type ILIKE '%takeoff%')) AS favored
  FROM x JOIN y USING (doc_id, flight_number, date, part))
SELECT doc_id, page, pos, flight_number, date, time, charges_type, airport FROM z
QUALIFY row_number() OVER (PARTITION BY doc_id, flight_number, date, part ORDER BY favored DESC, CASE WHEN favored THEN 0 ELSE -complete END, time IS NULL, atp) = 1
UNION ALL SELECT doc_id, page, pos, flight_number, date, time, charges_type, airport FROM base WHERE flight_number IS NULL"""


@query("w6_canonicalize_movements", fx(CANON.replace("{moves}", MOVES.format(k=20))))
def canonicalize_movements(t):
    rows = t.spark.sql(MOVES.format(k=20).replace("FROM items", "FROM {items}"), items=t.items)
    return C.canonicalize_movements(rows).select("doc_id", "page", "pos", "flight_number", "date", "time", "charges_type", "airport")


@query("f1_filter_rows_by_words", fx("""
SELECT doc_id, pos FROM items WHERE NOT (lower(charges_type) LIKE '%noise%')
  AND (regexp_replace(lower(description), '[-_]+', ' ', 'g') LIKE '%passenger handling%' OR lower(description || ' ' || charges_type) LIKE '%passenger%'
    OR lower(description || ' ' || charges_type) LIKE '%handling%' OR lower(description || ' ' || charges_type) LIKE '%landing%' OR lower(description || ' ' || charges_type) LIKE '%xyz%')"""))
def filter_rows_by_words(t):
    return FL.apply_filter(t.items, {"dropIf": ["NOISE"], "keepIf": ["passenger-handling of", "xyz landing"]}).select("doc_id", "pos")


@query("f2_drop_if", fx("""
SELECT doc_id, pos FROM items WHERE NOT (regexp_matches(description, '(?i)^landing') OR coalesce(airport, '') = '' OR lower(charges_type) LIKE '%noise%'
  OR net_amount = 1000.5 OR flight_number IS NULL)"""))
def drop_if(t):
    rules = {"line_items": {"description": "^LANDING", "airport": "", "charges_type": ["noise"], "net_amount": 1000.5, "flight_number": "^$", "nothing": False},
             "other_rows": {"description": None}}
    return FL.drop_if(t.items, rules).select("doc_id", "pos")


@query("f3_keep_if", fx("""
SELECT doc_id, pos FROM items WHERE regexp_matches(description, '(?i)fee|handling') AND time IS NOT NULL AND airport <> '' AND (lower(charges_type) LIKE '%landing%' OR lower(charges_type) LIKE '%takeoff%')"""))
def keep_if(t):
    rules = {"line_items": {"description": "FEE|handling", "time": True, "airport": 1, "charges_type": ["landing", "Takeoff"], "tax": ""}}
    return FL.keep_if(t.items, rules).select("doc_id", "pos")


@query("f4_parse_filter", """
SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 2) THEN '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' END AS filter FROM events""")
def parse_filter(t):
    quoted = F.concat(F.lit('"'), F.replace(F.replace("props", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    twice = F.concat(F.lit('"'), F.replace(F.replace(quoted, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    k = F.col("event_id") % 6
    source = F.when(k == 0, F.col("props")).when(k == 1, quoted).when(k == 2, twice).when(k == 3, F.concat(F.lit("["), "props", F.lit("]"))).when(k == 4, "{broken")
    return t.events.select("event_id", FL.parse_filter(source).alias("filter"))


@query("f10_has_data", "SELECT event_id, event_id % 8 NOT IN (0, 1, 2, 6) AS has_data FROM events")
def has_data(t):
    k = F.col("event_id") % 8
    record = (F.when(k == 0, '{"a":null,"b":"  ","c":[],"d":{},"e":true}').when(k == 1, "{}").when(k == 2, F.lit("not json"))
              .when(k == 3, F.concat(F.lit('{"a":'), F.col("event_id").cast("string"), F.lit("}"))).when(k == 4, '{"a":[1],"b":null}')
              .when(k == 5, F.col("props")).when(k == 6, F.lit("[1]")).otherwise(F.concat(F.lit('{"t":"'), "event_type", F.lit('"}'))))
    return t.events.select("event_id", FL.has_data(record).alias("has_data"))
