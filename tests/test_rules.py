"""Small cases with known answers: odd white space, accents, deep encoding, sizes and repeats."""

import json

import pytest
from pyspark.sql import functions as F

from doctables import session
from doctables.functions import money, text
from doctables.operators import cleaning, filters, quality, records
from doctables.sources import files


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("blank", [" ", "\u00a0", "\u2009", "\u3000", "\ufeff"])
def test_blanks_of_all_kinds(spark, blank):
    assert one(spark, f"1{blank}234.50{blank}€", money.to_num) == 1234.5
    assert one(spark, f"a{blank}{blank}b", text.cap_words) == "a b"
    assert one(spark, f"##{blank}Title", lambda c: F.regexp_replace(c, text.PLAIN_TEXT_REWRITES[2][0], "")) == "Title"


def test_aliases_fold_accents(spark):
    items = spark.createDataFrame([("DÉCOLLAGE nuit",), ("autre",)], "charges_type string")
    got = cleaning.normalize_by_alias(items, {"Take-off": ["^décollage"]}).collect()
    assert [r.charges_type for r in got] == ["Take-off", "autre"]


@pytest.mark.parametrize("levels", [0, 1, 8, 9, 12])
def test_filters_unwrap_any_level(spark, levels):
    wrapped = json.dumps({"dropIf": ["noise"]})
    for _ in range(levels):
        wrapped = json.dumps(wrapped)
    assert json.loads(one(spark, wrapped, filters.parse_filter)) == {"dropIf": ["noise"]}


def test_filters_of_other_texts(spark):
    assert [one(spark, v, filters.parse_filter) for v in (None, "", "[1]", '"x"', "{", "null")] == [None] * 6


def test_extensions_in_any_case(spark, tmp_path):
    for name in ("A.TXT", "b.txt", "c.Html", "d.pdf", "e.CSV", "f"):
        (tmp_path / name).write_text("x")
    got = {r.path.rsplit("/", 1)[1] for r in files.scan_text_pages(spark, str(tmp_path)).collect()}
    assert got == {"A.TXT", "b.txt", "c.Html", "e.CSV"}
    _, rejected = files.scan_files(spark, str(tmp_path), files.TEXT_ALLOWED)
    assert {r.path.rsplit("/", 1)[1] for r in rejected.collect()} == {"d.pdf", "f"}


@pytest.mark.parametrize("value, n, total", [("0.00004", 1000, 0.04), ("1e25", 3, 3e25), ("1e40", 2, 2e40), (None, 2, 0.0), ("0.1", 10, 1.0)])
def test_line_sums(spark, value, n, total):
    items = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit("rows").alias("array_name"), F.lit(value).cast("string").alias("amount"))
    row = quality.line_sums(items, {"rows": {"type": "column", "name": "amount"}}).first()
    assert row.line_sum == pytest.approx(total, rel=1e-12) and row.n_rows == n
    assert spark.range(1).select(quality.two_places(F.lit(total))).first()[0]


def test_totals_belong_to_arrays_of_their_name(spark):
    headers = spark.createDataFrame([(1, "100", "7"), (2, "100", "8")], "doc_id int, landing_total string, fuel_total string")
    items = spark.createDataFrame([(d, a, v) for d in (1, 2) for a, v in (("landing_rows", "60"), ("landing_rows", "40"), ("fuel_rows", "7"))], "doc_id int, array_name string, amount string")
    sums = quality.line_sums(items, {a: {"type": "column", "name": "amount"} for a in ("landing_rows", "fuel_rows")})
    got = quality.totals_report(headers, sums, ["landing_total", "fuel_total"]).collect()
    assert [(r.doc_id, r.total_path, r.status, r.difference) for r in got] == [(2, "fuel_total", "mismatch", 1.0)]
    linked = quality.totals_report(headers, sums, ["landing_total"], {"landing_total": ["fuel_rows"]}).collect()
    assert [r.difference for r in linked] == [93.0, 93.0]


def test_empty_declared_arrays_are_rebuilt(spark):
    kinds = "doc_id int, page int, line_no int, charge_no int, description string, charges_type string, net_amount double"
    found = spark.createDataFrame([(1, 1, i, 0, "d", None, 1.0) for i in range(12)] + [(2, 1, 0, 0, "d", None, 1.0)], kinds)
    items = spark.createDataFrame([(2, "rows", 1, 0, "x", "A")], "doc_id int, array_name string, page int, pos int, description string, airport string")
    declared = spark.createDataFrame([(1, "rows"), (2, "rows")], "doc_id int, array_name string")
    out = records.rebuild_rows(found, items, {"description": "string", "airport": "string"}, default_airport="ZZZ", arrays=declared)
    got = sorted((r.doc_id, r.description, r.airport) for r in out.collect())
    assert got == [(1, "d", "ZZZ")] * 12 + [(2, "x", "A")]


def test_blank_identity_is_none(spark):
    rows = [(1, "a", 1, 0, "", "x", None), (1, "a", 1, 1, "", "x", "y"), (1, "a", 1, 2, "F1", "x", None), (1, "a", 1, 3, "F1", "x", "y")]
    items = spark.createDataFrame(rows, "doc_id int, array_name string, page int, pos int, flight_number string, p string, q string")
    got = cleaning.dedupe_rows(items).orderBy("pos").collect()
    assert [(r.pos, r.flight_number, r.q) for r in got] == [(0, "", None), (1, "", "y"), (2, "F1", "y")]


def test_scratch_folder_needs_a_shared_one(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()
    with pytest.raises(ValueError):
        session.shared_dir(Session())
