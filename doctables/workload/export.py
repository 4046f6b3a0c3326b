"""Export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from doctables.operators import export as E
from doctables.sources import sinks
from doctables.session import scratch_path
from doctables.workload import query
from doctables.workload.fixtures import with_fixtures as fx


def records(t):
    """One record per order, its lines in one of two arrays."""
    row = F.struct(F.col("date").alias("flight_date"), F.col("aircraft_registration").alias("Reg"), F.col("flight_number").alias("flightNumber"),
                   F.when(F.expr("pos % 3 = 0"), F.col("airport")).alias("ac_type"), F.when(F.expr("pos % 2 = 0"), F.col("net_amount").cast("decimal(18,2)").cast("string")).alias("mtow"),
                   F.col("net_amount").cast("decimal(18,2)").cast("string").alias("NET_AMOUNT"), F.col("charges_type").alias("type"), "page", "pos")
    lines = t.items.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("page").alias("p"), F.col("pos").alias("q"), row.alias("row")))), lambda x: x["row"]).alias("_lines"))
    head = t.headers.select("doc_id", "invoice_number", "total_amount", "currency")
    return head.join(lines, "doc_id").select(
        "doc_id", F.concat(F.lit("Scan "), "invoice_number", F.lit(".PDF")).alias("file_name"),
        F.when(F.expr("doc_id % 5 = 0"), F.lit("null")).alias("sector"),
        F.struct("currency", F.col("total_amount").alias("Total Amount")).alias("summary"), F.struct("invoice_number", F.lit("ZZZ").alias("currency")).alias("reference"),
        F.when(F.expr("doc_id % 2 = 0"), F.col("_lines")).alias("charges"), F.when(F.expr("doc_id % 2 = 1"), F.col("_lines")).alias("other_lines"))


CELL = """CASE WHEN {c} IS NULL OR {c} IN ('null', 'undefined') THEN '' ELSE {c} END"""
MONEY = "CAST(CAST(net_amount AS DECIMAL(18, 2)) AS VARCHAR)"


@query("e3_charges_table", fx(f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) - 1 AS INT) AS row_no, date AS "Date", {CELL.format(c='aircraft_registration')} AS "AircraftRegistration",
  {CELL.format(c='flight_number')} AS "Flight Number", CASE WHEN pos % 6 = 0 AND airport <> '' THEN airport || '/' || {MONEY} WHEN pos % 3 = 0 AND airport <> '' THEN airport WHEN pos % 2 = 0 THEN {MONEY} ELSE '' END AS "AC Type/MTOW",
  {MONEY} AS "NetAmount", '' AS "Tax", '' AS "Tons", '' AS "Status", 'Scan INV-' || CAST(doc_id AS VARCHAR) || '.PDF' AS "FileName", charges_type AS "Charges Type" FROM items"""))
def charges_table(t):
    return E.charges_table(records(t))


DETAILS = """SELECT doc_id, CAST(k.ord AS INT) AS ord, k.key AS "Key", CASE k.key WHEN 'Currency' THEN CASE WHEN currency <> '' THEN currency ELSE 'ZZZ' END WHEN 'InvoiceNumber' THEN invoice_number
  WHEN 'TotalAmount' THEN coalesce(total_amount, '') ELSE '' END AS "Value" FROM headers, (SELECT unnest(range(11)) AS ord,
  unnest(['InvoiceDate', 'Currency', 'GrossValue', 'Supplier', 'InvoiceNumber', 'Entity', 'TotalAmount', 'TaxAmount', 'Withholding', 'TaxCode', 'Sector']) AS key) k
WHERE doc_id IN (SELECT doc_id FROM items)"""


@query("e4_details_table", fx(DETAILS))
def details_table(t):
    return E.details_table(records(t))


@query("e5_export_summary", fx("SELECT doc_id, 'Scan INV-' || CAST(doc_id AS VARCHAR) || '.PDF' AS file_name, CAST(count(*) AS INT) AS row_count FROM items GROUP BY doc_id"))
def export_summary(t):
    return E.export_summary(records(t))


@query("e1_resolve_alias", fx(f"SELECT doc_id, pos, {MONEY} AS net_amount FROM items"))
def resolve_alias(t):
    rows = E.charges_rows(records(t))
    return rows.select("doc_id", "row.pos", E.resolve_alias(F.col("row"), rows.schema["row"].dataType, E.CHARGES_COLUMNS["NetAmount"]).alias("net_amount"))


@query("e2_charges_array", fx("SELECT doc_id, page, pos FROM items"))
def charges_array(t):
    return E.charges_rows(records(t)).select("doc_id", "row.page", "row.pos")


@query("s6_write_charges_csv", fx(f"""SELECT date AS date, {CELL.format(c='flight_number')} AS flight, '"q", ' || chr(10) || charges_type AS charges_type FROM items"""))
def write_charges_csv(t):
    path = scratch_path(t.spark, "charges")
    table = E.charges_table(records(t)).withColumn("Charges Type", F.concat(F.lit('"q", \n'), F.col("`Charges Type`")))
    sinks.write_charges_csv(table, path)
    back = t.spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").option("emptyValue", "").option(
        "nullValue", "\x00").option("ignoreLeadingWhiteSpace", "false").csv(path)
    return back.select(F.col("Date").alias("date"), F.coalesce("`Flight Number`", F.lit("")).alias("flight"), F.col("`Charges Type`").alias("charges_type"))


@query("s10_result_envelope", fx("""
SELECT o_orderkey AS doc_id, '{"success":true,"pages":' || CAST(1 + o_orderkey % 7 AS VARCHAR) ||
  CASE WHEN o_orderkey % 2 = 0 THEN ',"data":{"total":' || CAST(o_orderkey AS VARCHAR) || '}' ELSE ',"markdown":"text"' END || ',"fileName":"f' || CAST(o_orderkey AS VARCHAR) || '","timing":{"total":5,"conversion":2' ||
  CASE WHEN o_orderkey % 2 = 0 THEN ',"extraction":3' ELSE '' END || '},"tokens":{"conversion":{"input":1000,"output":500},' ||
  CASE WHEN o_orderkey % 2 = 0 THEN '"extraction":{"input":0,"output":500},' ELSE '' END || '"total":{"input":1000,"output":' || CASE WHEN o_orderkey % 2 = 0 THEN '1000' ELSE '1000' END || '}}' ||
  CASE WHEN o_orderkey % 2 = 0 THEN ',"cost":{"total":7.5E-4,"inputPricePerM":0.15,"outputPricePerM":0.6,"currency":"USD"}' ELSE '' END ||
  CASE WHEN o_orderkey % 3 = 0 THEN ',"reconciledTotals":true' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN ',"coverageGap":{"rows":{"actual":1,"expected":2}}' ELSE '' END || '}' AS envelope FROM orders"""))
def result_envelope(t):
    docs = t.orders.selectExpr("o_orderkey AS doc_id", "1 + o_orderkey % 7 AS pages", "CASE WHEN o_orderkey % 2 = 0 THEN '{\"total\":' || CAST(o_orderkey AS STRING) || '}' END AS data",
                               "'text' AS markdown", "'f' || CAST(o_orderkey AS STRING) AS file_name", "5L AS total_ms", "2L AS conversion_ms", "3L AS extraction_ms",
                               "1000L AS conversion_input", "500L AS conversion_output", "CAST(NULL AS BIGINT) AS extraction_input", "500L AS extraction_output",
                               "o_orderkey % 3 = 0 AS reconciled", "false AS adjusted", "CASE WHEN o_orderkey % 5 = 0 THEN '{\"rows\":{\"actual\":1,\"expected\":2}}' END AS coverage_gap")
    return E.result_envelope(docs)
