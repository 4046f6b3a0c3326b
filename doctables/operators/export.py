"""Export tables: charges, details, result envelopes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctables.functions.text import trim_all
from doctables.operators.jobs import PRICE_IN_PER_M, PRICE_OUT_PER_M

# Export headers with the column names that may feed them, in order of preference.
CHARGES_COLUMNS = {
    "Date": ("date", "flight_date", "movement_date", "landing_date", "service_date", "movementDate"),
    "AircraftRegistration": ("aircraft_registration", "aircraftRegistration", "registration", "reg", "tail_number", "ac_reg"),
    "Flight Number": ("flight_number", "flightNumber", "flight", "flt_no", "flight_no"),
    "AC Type/MTOW": ("ac_type_mtow", "acTypeMtow"),
    "NetAmount": ("net_amount", "netAmount", "net"),
    "Tax": ("tax", "tax_amount", "taxAmount"),
    "Tons": ("tons", "mtow_tons", "tonnage"),
    "Status": ("status",),
    "FileName": ("file_name", "fileName", "filename"),
    "Charges Type": ("charges_type", "chargesType", "charge_type", "type"),
}
DETAIL_KEYS = {
    "InvoiceDate": ("invoice_date", "invoiceDate", "invoice date"),
    "Currency": ("currency",),
    "GrossValue": ("gross_value", "grossValue", "gross", "gross_amount"),
    "Supplier": ("supplier",),
    "InvoiceNumber": ("invoice_number", "invoiceNumber", "invoice_no", "ref_number", "reference_number", "doc_number"),
    "Entity": ("entity",),
    "TotalAmount": ("total_amount", "totalAmount", "total", "invoice_total", "grand_total"),
    "TaxAmount": ("tax_amount", "taxAmount", "vat_amount", "vat"),
    "Withholding": ("withholding", "withholding_amount", "whd", "withholding_tax"),
    "TaxCode": ("tax_code", "taxCode"),
    "Sector": ("sector",),
}
ARRAY_NAMES = ("landing_charges", "charges", "line_items", "items", "movements", "rows", "charge_lines")
AIRCRAFT_TYPES = ("aircraft_type", "aircraftType", "ac_type")


def plain_name(name: str) -> str:
    return re.sub("[^a-z0-9]+", "", name.lower())


def alias_columns(names: Sequence[str], candidates: Sequence[str]) -> list[str]:
    """Columns that may feed a target: exact names first, then names equal once normalised."""
    exact = [c for c in candidates if c in names]
    wanted = {plain_name(c) for c in candidates}
    return exact + [n for n in names if plain_name(n) in wanted and n not in exact]


def resolve_alias(source: Column | None, kind: T.StructType, candidates: Sequence[str]) -> Column:
    """First non-null value among the matching columns, as text.

    ``source`` is a struct column, or None for the columns of the table itself. The columns are found
    when the plan is made, so only they are read.
    """
    found = alias_columns(kind.names, candidates)
    values = [(F.col(f"`{n}`") if source is None else source[n]).cast("string")
              if not isinstance(kind[n].dataType, (T.StructType, T.ArrayType)) else
              F.to_json(F.col(f"`{n}`") if source is None else source[n]) for n in found]
    return F.coalesce(*values) if values else F.lit(None).cast("string")


def csv_text(c: Column) -> Column:
    """Null and the words ``null`` and ``undefined`` become empty."""
    return F.when(c.isNull() | c.isin("null", "undefined"), "").otherwise(c)


def _filled(c: Column) -> Column:
    return F.coalesce(trim_all(c) != "", F.lit(False))


def type_and_weight(source: Column | None, kind: T.StructType) -> Column:
    """The combined type/weight value, else ``type/weight``, else whichever of the two is there."""
    both = resolve_alias(source, kind, CHARGES_COLUMNS["AC Type/MTOW"])
    name = resolve_alias(source, kind, AIRCRAFT_TYPES)
    weight = resolve_alias(source, kind, ("mtow",))
    return (F.when(_filled(both), both).when(_filled(name) & _filled(weight), F.concat(name, F.lit("/"), weight))
            .when(_filled(name), name).when(_filled(weight), weight).otherwise(""))


def charges_array(records: DataFrame) -> str | None:
    """Name of the line-item array: a known name, else the first array of objects."""
    for name in ARRAY_NAMES:
        if name in records.columns and isinstance(records.schema[name].dataType, T.ArrayType):
            return name
    return next((f.name for f in records.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)), None)


def charges_rows(records: DataFrame) -> DataFrame:
    """One row per line item: doc_id, file_name, row_no and the item as ``row``.

    Per record the first known array that is present counts, even when empty; the other arrays of
    objects are looked at only when none is.
    """
    arrays = {f.name: f.dataType.elementType for f in records.schema
              if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)}
    known = [n for n in ARRAY_NAMES if n in arrays]
    others = [n for n in arrays if n not in known]
    names = known + others
    if not names:
        return records.select("doc_id", "file_name", F.lit(0).alias("row_no")).where(F.lit(False))
    # all arrays take one common item type, so that one of them can be chosen per record
    merged: dict[str, T.DataType] = {}
    for n in names:
        for f in arrays[n]:
            merged.setdefault(f.name, f.dataType if f.dataType == merged.get(f.name, f.dataType) else T.StringType())

    def common(n: str) -> Column:
        return F.transform(n, lambda x: F.struct(*[
            (x[c] if c in arrays[n].names else F.lit(None)).cast(k).alias(c) for c, k in merged.items()]))

    choice = F.coalesce(*[common(n) for n in known], *[F.when(F.size(n) > 0, common(n)) for n in others])
    return records.select("doc_id", "file_name", F.posexplode(choice).alias("row_no", "row"))


def charges_table(records: DataFrame) -> DataFrame:
    """The ten charges columns, one row per line item; empty text where nothing is known."""
    rows = charges_rows(records)
    if "row" not in rows.columns:
        return rows.select("doc_id", "row_no", *[F.lit("").alias(h) for h in CHARGES_COLUMNS])
    kind = rows.schema["row"].dataType
    cols = []
    for header, names in CHARGES_COLUMNS.items():
        if header == "FileName":
            value = F.col("file_name")
        elif header == "AC Type/MTOW":
            value = type_and_weight(F.col("row"), kind)
        else:
            value = resolve_alias(F.col("row"), kind, names)
        cols.append(csv_text(value).alias(header))
    return rows.select("doc_id", "row_no", *cols)


def details_table(records: DataFrame) -> DataFrame:
    """Eleven key/value rows per document: the first non-blank value on the record, then in its objects."""
    scalars = T.StructType([f for f in records.schema if f.name != "doc_id" and not isinstance(f.dataType, T.ArrayType)])
    nested = [f for f in records.schema if isinstance(f.dataType, T.StructType)]
    entries = []
    for i, (key, names) in enumerate(DETAIL_KEYS.items()):
        sources = [resolve_alias(None, scalars, names)] + [resolve_alias(F.col(f.name), f.dataType, names) for f in nested]
        value = F.coalesce(*[F.when(_filled(s), s) for s in sources])
        entries.append(F.struct(F.lit(i).alias("ord"), F.lit(key).alias("Key"), csv_text(value).alias("Value")))
    return records.select("doc_id", F.explode(F.array(*entries)).alias("_d")).select("doc_id", "_d.ord", "_d.Key", "_d.Value")


def export_summary(records: DataFrame) -> DataFrame:
    """File name and number of charge rows per document."""
    names = [n for n in ARRAY_NAMES if n in records.columns]
    others = [f.name for f in records.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType) and f.name not in names]
    sizes = [F.when(F.col(n).isNotNull(), F.size(n)) for n in names] + [F.when(F.size(n) > 0, F.size(n)) for n in others]
    return records.select("doc_id", F.coalesce("file_name", F.lit("")).alias("file_name"), F.coalesce(*sizes, F.lit(0)).alias("row_count"))


def result_envelope(docs: DataFrame) -> DataFrame:
    """Result text per document; flags and parts that are not set do not appear.

    ``data`` and ``coverage_gap`` are JSON text and embedded as they are.
    """
    total_in = F.coalesce("conversion_input", F.lit(0)) + F.coalesce("extraction_input", F.lit(0))
    total_out = F.coalesce("conversion_output", F.lit(0)) + F.coalesce("extraction_output", F.lit(0))
    extracted = F.col("data").isNotNull()

    def usage(a: Column, b: Column) -> Column:
        return F.struct(a.cast("bigint").alias("input"), b.cast("bigint").alias("output"))

    cost = F.round(total_in * (PRICE_IN_PER_M / 1e6) + total_out * (PRICE_OUT_PER_M / 1e6), 6)
    body = F.struct(
        F.lit(True).alias("success"), F.col("pages").cast("bigint").alias("pages"),
        F.when(extracted, F.try_parse_json("data")).alias("data"), F.when(~extracted, F.col("markdown")).alias("markdown"),
        F.col("file_name").alias("fileName"),
        F.struct(F.col("total_ms").alias("total"), F.col("conversion_ms").alias("conversion"),
                 F.when(extracted, F.col("extraction_ms")).alias("extraction")).alias("timing"),
        F.struct(usage(F.coalesce("conversion_input", F.lit(0)), F.coalesce("conversion_output", F.lit(0))).alias("conversion"),
                 F.when(extracted, usage(F.coalesce("extraction_input", F.lit(0)), F.coalesce("extraction_output", F.lit(0)))).alias("extraction"),
                 usage(total_in, total_out).alias("total")).alias("tokens"),
        F.when(extracted, F.struct(cost.alias("total"), F.lit(PRICE_IN_PER_M).alias("inputPricePerM"), F.lit(PRICE_OUT_PER_M).alias("outputPricePerM"),
                                   F.lit("USD").alias("currency"))).alias("cost"),
        F.when(F.col("reconciled"), F.lit(True)).alias("reconciledTotals"),
        F.when(F.col("adjusted"), F.lit(True)).alias("coverageAdjusted"),
        F.try_parse_json("coverage_gap").alias("coverageGap"))
    return docs.select("doc_id", F.to_json(body).alias("envelope"))
