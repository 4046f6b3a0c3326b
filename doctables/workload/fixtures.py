"""Document, job and template tables derived from the driver tables.

Every derivation is one SELECT that both Spark and DuckDB understand, so the queries and their checks
start from the same rows. ``Tables`` runs them in Spark; ``with_fixtures`` puts them in front of a
DuckDB statement.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
        "embeddings", "pages", "benchmark", "labels", "conversations")

DAY_MS = "86400000"
# days since 1970 without a time zone
ORDER_DAYS = "datediff(DAY, DATE '1970-01-01', CAST(o_orderdate AS DATE))"

FIXTURES: dict[str, str] = {}

FIXTURES["jobs"] = f"""
SELECT 'job-' || CAST(o_orderkey AS STRING) AS id,
  'Invoice ' || CAST(o_orderkey AS STRING) || CASE WHEN o_orderpriority = '1-URGENT' THEN '.docx' ELSE '.pdf' END
    AS file_name,
  CAST(1 + o_orderkey % 7 AS INT) AS pages,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'in-progress' ELSE 'error' END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'np_001' WHEN '2-HIGH' THEN 'schema-generation'
    WHEN '3-MEDIUM' THEN 'Freight Invoice' WHEN '5-LOW' THEN 'legacy-layout' END AS template_name,
  CASE WHEN o_orderkey % 3 = 0 THEN '["total"]' END AS schema,
  CASE WHEN o_orderkey % 4 = 0 THEN '["noise"]' END AS filter,
  CASE WHEN o_custkey % 10 = 0 THEN 'system' ELSE 'u' || CAST(o_custkey AS STRING) END AS user_id,
  CAST({ORDER_DAYS} AS BIGINT) * {DAY_MS} + o_orderkey % {DAY_MS} AS created_at,
  CAST(floor(o_totalprice / 10) AS BIGINT) AS conversion_input,
  CAST(floor(o_totalprice / 50) AS BIGINT) AS conversion_output,
  CAST(floor(o_totalprice / 7) AS BIGINT) AS extraction_input,
  CAST(floor(o_totalprice / 90) AS BIGINT) AS extraction_output,
  CASE WHEN o_orderkey % 11 = 0 THEN CAST(NULL AS INT) ELSE CAST(1 + o_orderkey % 9 AS INT) END AS calls,
  CASE WHEN o_orderkey % 5 = 0 THEN CAST(NULL AS DOUBLE) ELSE round(o_totalprice / 1000000, 6) END AS cost_total,
  CAST(1000 + floor(o_totalprice / 4) AS BIGINT) AS total_ms,
  CASE WHEN o_orderkey % 6 <> 0 THEN 'scan ' || CAST(o_orderkey AS STRING) || '.pdf' END AS stored_file
FROM {{orders}}
"""

FIXTURES["users"] = """
SELECT 'u' || CAST(c_custkey AS STRING) AS id,
  lower(c_mktsegment) || CAST(c_custkey AS STRING) || '@example.com' AS email,
  CASE WHEN c_custkey % 4 = 0 THEN CAST(NULL AS STRING) WHEN c_custkey % 9 = 0 THEN '' ELSE c_name END AS first_name,
  CASE WHEN c_custkey % 6 = 0 THEN CAST(NULL AS STRING) ELSE c_mktsegment END AS last_name,
  CASE WHEN c_custkey % 7 = 0 THEN CAST(NULL AS STRING) ELSE 'co' || CAST(c_nationkey AS STRING) END AS company_id,
  CAST(CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 2 END AS INT) AS role,
  CAST(c_custkey AS BIGINT) * 1000 AS created_at
FROM {customer}
"""

FIXTURES["companies"] = """
SELECT 'co' || CAST(n_nationkey AS STRING) AS id, n_name AS name FROM {nation} WHERE n_nationkey % 8 <> 7
"""

FIXTURES["api_keys"] = """
SELECT 'k' || CAST(s_suppkey AS STRING) AS id, 'u' || CAST(s_suppkey * 3 AS STRING) AS user_id,
  'key_' || CAST(s_suppkey AS STRING) AS key, s_name AS name
FROM {supplier}
"""

# The five templates of the workload: id, name, keywords and flags (configuration, not data).
FIXTURES["templates"] = """
SELECT * FROM (VALUES
  ('np_001', 'Airport Statement', 'the, and, whou, of, ti', 0, 1, 0, 'DD-MM-YYYY', 'DD.MM.YYYY', 'aviation', 100),
  ('np_002', 'Freight Invoice', 'que, les, ement, aux, la', 1, 1, 0, 'YYYY-MM-DD', CAST(NULL AS STRING), 'generic', 200),
  ('np_003', 'Hotel Folio', 'der, ich, ung, schen, die', 0, 0, 1, CAST(NULL AS STRING), 'MM/DD/YYYY', 'generic', 300),
  ('np_004', 'Fuel Receipt', 'email, call, license, copyright, password', 1, 0, 1, 'DD MMM YYYY', CAST(NULL AS STRING), CAST(NULL AS STRING), 300),
  ('np_005', 'Unused', CAST(NULL AS STRING), 0, 1, 0, CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), 50)
) AS t(id, name, keywords, verify_coverage, verify_totals, per_page, date_format, date_input_format, domain, created_at)
"""

FIXTURES["conv_pages"] = """
SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page, text AS content, CAST(length(text) AS INT) AS content_length
FROM {conversations}
"""

FIXTURES["page_signals"] = """
SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page,
  CAST(CASE WHEN (conv_id + turn) % 3 = 0 THEN turn ELSE length(text) END AS BIGINT) AS content_length,
  CAST(CASE WHEN (conv_id + turn) % 3 = 0 THEN turn ELSE length(text) END AS BIGINT) AS char_count,
  CAST((conv_id * 37 + turn * 11) % 120 AS DOUBLE) AS image_area,
  CAST(CASE WHEN conv_id % 13 = 0 THEN 0 ELSE 100 END AS DOUBLE) AS page_area
FROM {conversations}
"""

FIXTURES["headers"] = """
SELECT o_orderkey AS doc_id, 'INV-' || CAST(o_orderkey AS STRING) AS invoice_number,
  CASE WHEN o_orderkey % 17 = 0 THEN CAST(NULL AS STRING) ELSE CAST(o_totalprice AS STRING) END AS total_amount,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'EUR' WHEN '2-HIGH' THEN '' ELSE 'AED' END AS currency
FROM {orders}
"""

# one invoice row per line; (doc_id, page, pos, part) orders the rows of a document totally
FIXTURES["items"] = """
SELECT l_orderkey AS doc_id, CAST(CASE WHEN l_linenumber > 4 THEN 2 ELSE 1 END AS INT) AS page,
  CAST(l_linenumber AS BIGINT) * 100000000000 + l_partkey * 100000 + CAST(l_quantity AS BIGINT) * 1000 + l_suppkey % 1000 AS pos,
  'line_items' AS array_name,
  CASE l_returnflag WHEN 'N' THEN 'Landing Charge' WHEN 'R' THEN 'Take-off fee' ELSE 'Passenger_handling' END AS description,
  CASE WHEN l_suppkey % 3 = 0 THEN 'landing fees' WHEN l_suppkey % 3 = 1 THEN ' Takeoff charge' ELSE 'Noise' END AS charges_type,
  CASE WHEN l_partkey % 29 = 0 THEN CAST(NULL AS STRING)
    ELSE 'EK' || lpad(CAST(l_partkey % 100 AS STRING), 3, '0') ||
      CASE WHEN l_suppkey % 3 = 0 THEN '/A' WHEN l_suppkey % 3 = 1 THEN '/D' ELSE '' END END AS flight_number,
  CASE WHEN l_partkey % 31 = 0 THEN 'null' ELSE 'A6' || chr(CAST(65 + l_suppkey % 26 AS INT)) || 'BC' END AS aircraft_registration,
  lpad(CAST(extract(day FROM l_shipdate) AS STRING), 2, '0') || '-' ||
    lpad(CAST(extract(month FROM l_shipdate) AS STRING), 2, '0') || '-' || CAST(extract(year FROM l_shipdate) AS STRING) AS date,
  CASE WHEN l_linenumber % 3 = 0 THEN CAST(NULL AS STRING)
    ELSE lpad(CAST(l_partkey % 24 AS STRING), 2, '0') || ':' || lpad(CAST(l_suppkey % 60 AS STRING), 2, '0') END AS time,
  CAST(l_quantity AS STRING) AS quantity, l_extendedprice AS net_amount, l_tax AS tax,
  CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE 'APT' || CAST(l_suppkey % 4 AS STRING) END AS airport
FROM {lineitem}
"""

# the text of each invoice line; see invoice_pages()
FIXTURES["rendered"] = """
SELECT doc_id, page, pos, kind, flights, reg, date_text, clock, origin, amount, amount_text, fee_text, style,
  CASE kind
    WHEN 'movement' THEN '| ' || flights || ' | ' || reg || ' | ' || date_text || ' | ' || clock || ' | ' || origin || ' | ' || amount_text || ' |'
    WHEN 'pairs' THEN '| **Landing Fee**: ' || amount_text || '<br/>Take off Fee: ' || fee_text || ' |'
    WHEN 'total' THEN '| Grand total | ' || amount_text || ' |'
    ELSE '| Landing charges | ref 22.07. 1.952.449 | ' || fee_text || ' | ' || amount_text || ' |' END AS line
FROM (
  SELECT l_orderkey AS doc_id, CAST(CASE WHEN l_linenumber > 4 THEN 2 ELSE 1 END AS INT) AS page,
    CAST(l_linenumber AS BIGINT) * 100000000000 + l_partkey * 100000 + CAST(l_quantity AS BIGINT) * 1000 + l_suppkey % 1000 AS pos,
    CASE WHEN l_linenumber = 6 THEN 'total' WHEN l_returnflag = 'N' THEN 'movement' WHEN l_returnflag = 'R' THEN 'pairs' ELSE 'fee' END AS kind,
    l_suppkey % 3 AS style,
    CASE l_suppkey % 3 WHEN 0 THEN 'EK' || lpad(CAST(l_partkey % 1000 AS STRING), 3, '0') || '/A'
      WHEN 1 THEN 'EK' || lpad(CAST(l_partkey % 1000 AS STRING), 3, '0') || '/D'
      ELSE 'EK' || lpad(CAST(l_partkey % 1000 AS STRING), 3, '0') || ' FZ' || lpad(CAST(l_partkey % 1000 AS STRING), 3, '0') END AS flights,
    'A6' || chr(CAST(65 + l_suppkey % 26 AS INT)) || chr(CAST(65 + l_partkey % 26 AS INT)) || 'X' AS reg,
    lpad(CAST(extract(day FROM l_shipdate) AS STRING), 2, '0') || '.' || lpad(CAST(extract(month FROM l_shipdate) AS STRING), 2, '0') ||
      CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE '.' || CAST(extract(year FROM l_shipdate) AS STRING) END AS date_text,
    lpad(CAST(l_partkey % 24 AS STRING), 2, '0') || ':' || lpad(CAST(l_suppkey % 60 AS STRING), 2, '0') AS clock,
    'OM' || chr(CAST(65 + l_partkey % 26 AS INT)) || 'B' AS origin,
    CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS DOUBLE) / 100 AS amount,
    CAST(CAST(floor(round(l_extendedprice * 100) / 100) AS BIGINT) AS STRING) || '.' ||
      lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 100 AS STRING), 2, '0') AS amount_text,
    CAST(CAST(l_quantity AS BIGINT) AS STRING) || ',50' AS fee_text
  FROM {lineitem}
) AS x
"""

def _field(name: str, kind: str, more: str = "", description: str = "Some text") -> str:
    about = f',"description":"{description}"' if description is not None else ""
    return f'{{"name":"{name}","type":"{kind}"{about}{more}}}'


def _registry() -> str:
    """One template per customer; the fields vary with the customer's keys, the spelling with the nation."""
    def lit(text: str) -> str:
        return "'" + text.replace("{", "{{").replace("}", "}}") + "'"

    supplier = _field("supplier", "object", ',"children":[' + ",".join(
        [_field("name", "string"), _field("vat_total", "number"), _field("Grand_Total", "number")]) + "]")
    lines_a = _field("line_items", "array", ',"children":[' + ",".join(
        [_field("service_date", "string"), _field("quantity", "number"), _field("unit_price", "number"),
         _field("line_total", "number"), _field("net_amount", "number")]) + "]")
    lines_b = _field("line_items", "array", ',"children":[' + ",".join(
        [_field("quantity", "number"), _field("unit_price", "number"), _field("note", "string")]) + "]")
    tags = _field("tags", "array", ',"children":[' + _field("tag", "string") + "]")
    nested = _field("extra", "object", ',"children":[' + _field("empty", "array") + "," + _field("gone", "object", ',"children":[]') + "]")
    fields = " || ',' || ".join([
        f"CASE WHEN c_custkey % 2 = 0 THEN {lit(_field('invoice_number', 'string', ',\"required\":true', 'Number as printed'))} ELSE {lit(_field('Invoice_Number ', 'string', '', ''))} END",
        f"CASE WHEN c_custkey % 3 = 0 THEN {lit(_field('issueDate', 'string'))} WHEN c_custkey % 3 = 1 THEN {lit(_field('due-date', 'string'))} ELSE {lit(_field('period', 'string', ',\"format\":\"MM/YYYY\"'))} END",
        f"CASE WHEN c_custkey % 5 = 0 THEN {lit(_field('total_amount', 'number', '', None))} ELSE {lit(_field('total_amount', 'number'))} END",
        lit(supplier),
        f"CASE WHEN c_custkey % 2 = 0 THEN {lit(lines_a)} ELSE {lit(lines_b)} END",
        f"CASE WHEN c_custkey % 7 = 0 THEN {lit(_field('status', 'enum', ',\"values\":[]'))} WHEN c_custkey % 7 = 1 THEN {lit(_field('status', 'enum', ',\"values\":[\"a\",1]'))} ELSE {lit(_field('status', 'enum', ',\"values\":[\"open\",\"paid\"]'))} END",
        f"CASE WHEN c_custkey % 4 = 0 THEN {lit(nested)} WHEN c_custkey % 4 = 1 THEN {lit(_field(' ', 'date'))} ELSE {lit(tags)} END",
    ])
    json_schema = ('{"type":"object","properties":{"invoice_number":{"type":"string","description":"Number"},"total_amount":{"type":"number"},'
                   '"untyped":{"format":"DD.MM.YYYY"},"supplier":{"type":"object","properties":{"name":{"type":"string"},"grand_total":{"type":"number"}},"required":["name"]},'
                   '"line_items":{"type":"array","items":{"type":"object","properties":{"qty":{"type":"number"},"price":{"type":"number"}}}},'
                   '"scores":{"type":"array","items":{"type":"number"}}},"required":["invoice_number"]}')
    return f"""
SELECT 'r' || CAST(c_custkey AS STRING) AS template_id, c_custkey AS seq, c_nationkey AS nation,
  CASE c_nationkey % 4 WHEN 0 THEN '[' || {fields} || ']' WHEN 1 THEN ' {{{{"fields":[' || {fields} || ']}}}}'
    WHEN 2 THEN {lit(lines_a)} ELSE {lit(json_schema)} END AS schema
FROM {{customer}}
"""


FIXTURES["registry"] = _registry()

PLACEHOLDER = re.compile(r"\{(\w+)\}")


def _unescape(sql: str) -> str:
    return sql.replace("{{", "\x01").replace("}}", "\x02")


def with_fixtures(sql: str) -> str:
    """A DuckDB statement with every fixture it mentions defined in front."""
    needed: list[str] = []  # in order of definition

    def visit(text: str) -> None:
        for name in FIXTURES:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(_unescape(FIXTURES[name]))
                needed.append(name)

    visit(sql)
    ctes = []
    for name in needed:
        body = PLACEHOLDER.sub(r"\1", _unescape(FIXTURES[name])).replace("\x01", "{").replace("\x02", "}")
        body = body.replace("datediff(DAY,", "datediff('day',")
        ctes.append(f"{name} AS ({body})")
    if not ctes:
        return sql
    head = ",\n".join(ctes)
    found = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, flags=re.IGNORECASE)
    if found:
        return f"WITH {found[1] or ''}{head},\n{sql[found.end():]}"
    return f"WITH {head}\n{sql}"


class Tables:
    """Driver tables and derived tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in FIXTURES:
            sql = FIXTURES[name]
            needed = {n: getattr(self, n) for n in PLACEHOLDER.findall(_unescape(sql))}
            return self.spark.sql(sql, **needed) if needed else self.spark.sql(sql)
        if name in BASE:
            return self.base(name)
        raise AttributeError(name)

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def invoice_pages(self) -> DataFrame:
        """Each order as markdown pages of pipe-table lines."""
        from pyspark.sql import functions as F

        from doctables.operators.pages import join_ordered
        body = self.rendered.groupBy("doc_id", "page").agg(join_ordered(["pos"], "line", "\n").alias("_body"))
        content = F.concat(F.lit("# Statement 2024\n\n| Flight | Details |\n|---|---|\n"), "_body")
        return body.select("doc_id", "page", content.alias("content"), F.length(content).alias("content_length"))
