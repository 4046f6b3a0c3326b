"""Small examples with known answers."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctables.functions import dates, money, text
from doctables.operators import cleaning, export, extract, filters, jobs, match, pages, quality, records, scan, schema, tables
from doctables.operators import text as tx
from doctables.session import scratch_path
from doctables.sources import files, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("source, value", [
    ("1.234,56", 1234.56), ("1,234.56", 1234.56), ("1234", 12.34), ("999", 999.0), ("1,5", 1.5), ("1,234", 1234.0),
    ("1.234.567", 1.234), ("EUR **12,50**", 12.5), ("none", None), ("1,2,3", 1.2)])
def test_parse_amount(spark, source, value):
    assert one(spark, money.parse_amount(F.lit(source))) == value


@pytest.mark.parametrize("source, value", [
    ("12abc", 12.0), ("(5)", None), ("$ 1,234.50", 1234.5), ("1.234,56", 1.23456), ("-3e2x", -300.0), ("", None), (".5", 0.5)])
def test_to_num(spark, source, value):
    assert one(spark, money.to_num(F.lit(source))) == value


def test_money_tokens(spark):
    line = "| 1.952.449 | 22.07. | 1,234.50 | 12,50 | 7 |"
    assert one(spark, money.money_tokens(F.lit(line))) == ["1,234.50", "12,50"]


@pytest.mark.parametrize("source, hint, value", [
    ("01.07.2026", "DD", (2026, 7, 1)), ("13.07.2026", "MM", (2026, 7, 13)), ("01.07.2026", "MM", (2026, 1, 7)), ("01.07.2026", "", (2026, 7, 1)),
    ("2026-07-01T10:30:00", "DD", (2026, 7, 1)), ("12 October 2026", "", (2026, 10, 12)), ("31/02/24", "", (2024, 2, 31)),
    ("1/2", "", None), ("45.45.2026", "", None), ("July 4, 2026 9:00 AM", "", (2026, 7, 4)), ("99999999999999999999 1 2026", "", None), ("", "", None)])
def test_parse_dates(spark, source, hint, value):
    got = one(spark, dates.parse_date_parts(F.lit(source), hint))
    assert (tuple(got) if got else None) == value


def test_format_dates(spark):
    assert one(spark, dates.format_date(F.lit("1/7/26"), "DD MMM YYYY")) == "01 Jul 2026"
    assert one(spark, dates.format_date(F.lit("soon"), "DD MMM YYYY")) == "soon"
    again = dates.format_date(dates.format_date(F.lit("5.3.2026"), "YYYY-MM-DD"), "YYYY-MM-DD")
    assert one(spark, again) == "2026-03-05"


def test_compact_and_short_dates(spark):
    assert one(spark, dates.compact_dates(F.lit("| 2162026 |"))) == ["21-6-2026"]
    assert one(spark, dates.complete_date(F.lit("5/3"), F.lit("2026"))) == "05-03-2026"
    assert one(spark, dates.complete_date(F.lit("5/3/24"), F.lit("2026"))) == "05-03-2024"
    assert one(spark, dates.complete_date(F.lit("45/3"), F.lit("2026"))) == "45/3"


def test_markdown(spark):
    fenced = "```markdown\n```markdown\n# A\n```\n```"
    assert one(spark, text.clean_markdown(F.lit(fenced))) == "# A"
    assert one(spark, text.markdown_to_text(F.lit("**b** _i_ [l](u) ![p](q)\n\n\n| x | y-"))) == "b i l !p\nx y"
    assert one(spark, text.cap_words(F.lit(" a  b c "), 2)) == "a b…"
    assert one(spark, text.clean_charge_name(F.lit(" 7 ABC XYZ Landing "))) == "Landing"


def test_page_ranges(spark):
    assert pages.parse_page_spec("1,3,5-7") == [(1, 1), (3, 3), (5, 7)]
    assert pages.parse_page_spec("9-1, x, 4") == [(1, 9), (4, 4)]
    assert pages.parse_page_spec("") == []
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "doc_id int, page int, content string")
    kept = {(r.doc_id, r.page) for r in pages.filter_pages(df, "2-3").collect()}
    assert kept == {(1, 2), (2, 1)}


def test_estimates(spark):
    df = spark.createDataFrame([(1, 6, True, "extraction"), (2, 2, True, "schema"), (3, 1, False, "extraction")], "id int, n_pages int, has_schema boolean, kind string")
    got = {r.id: (r.estimate_ms, r.estimate) for r in pages.estimate_time(df).collect()}
    assert got == {1: (77000, "~1 min"), 2: (65000, "~1 min"), 3: (11000, "11s")}


def test_word_filter(spark):
    rows = [(1, "Landing fee"), (2, "Noise charge"), (3, "Passenger Service Charge"), (4, "Parking")]
    df = spark.createDataFrame([(i, "items", d) for i, d in rows], "id int, array_name string, description string")
    ids = lambda out: {r.id for r in out.collect()}
    assert ids(filters.apply_filter(df, {"keepIf": ["landing"], "dropIf": ["noise"]})) == {1}
    assert ids(filters.apply_filter(df, {"dropIf": ["passenger-handling"]})) == {1, 2, 4}
    assert ids(filters.apply_filter(df, {"dropIf": [], "keepIf": {"items": {"description": "^Land"}}})) == {1, 2, 3, 4}
    assert ids(filters.apply_filter(df, {"keepIf": {"items": {"description": "^Land"}, "other": {"description": "x"}}})) == {1}
    assert ids(filters.apply_filter(df, {"dropIf": {"items": {"missing": ""}}})) == set()


def test_parse_filter(spark):
    plain = '{"dropIf":["a"]}'
    nested = plain
    for _ in range(4):
        nested = json.dumps(nested)
    for source, want in ((plain, plain), (nested, plain), ("[1]", None), ("oops", None), ('"text"', None)):
        assert one(spark, filters.parse_filter(F.lit(source))) == want


def test_carry_forward_over_blocks(spark):
    rows = [(d, p, f"v{p}" if p % 7 == 3 else None) for d in (1, 2) for p in range(40)]
    df = spark.createDataFrame(rows, "doc int, page int, v string")
    for inclusive in (True, False):
        out = scan.carry_forward(df, ["doc"], ["page"], F.col("v"), "w", scan.page_block(F.col("page"), 5), inclusive)
        for r in out.collect():
            last = [p for p in range(40) if p % 7 == 3 and (p <= r.page if inclusive else p < r.page)]
            assert r.w == (f"v{last[-1]}" if last else None)


def test_floored_sums_and_numbers(spark):
    deltas = [(i, (i * 7) % 5 - 2) for i in range(200)]
    df = spark.createDataFrame(deltas, "i int, d long").repartition(6)
    want, total = {}, 0
    for i, d in deltas:
        total = max(total + d, 0)
        want[i] = total
    assert {r.i: r.total_d for r in scan.floored_running_sums(df, ["i"], ["d"]).collect()} == want
    assert {r.i: r.n for r in scan.number_rows(df, ["i"], "n").collect()} == {i: i + 1 for i, _ in deltas}


def brute_dedupe(rows, ids, window=50):
    """The rule, row by row: rows are (page, pos, dict)."""
    out, recent = [], []
    filled = lambda r: {k: str(v).strip() for k, v in r.items() if v not in (None, "")}
    for page, pos, r in rows:
        exact, key = json.dumps(r, sort_keys=True), "|".join(str(r[k] if r[k] is not None else "") for k in sorted(ids))
        if any(e["exact"] == exact for e in recent):
            continue
        twin = next((e for e in recent if e["key"] == key), None) if ids and key else None  # an empty identity is none
        if twin is not None:
            a, b = filled(twin["r"]), filled(r)
            if a and all(b.get(k) == v for k, v in a.items()):
                out[twin["at"]] = (*out[twin["at"]][:2], r)
                twin["r"] = r
                continue
            if b and all(a.get(k) == v for k, v in b.items()):
                continue
        recent.append({"exact": exact, "key": key, "r": r, "at": len(out)})
        out.append((page, pos, r))
        if len(recent) > window:
            recent.pop(0)
    return out


@pytest.mark.parametrize("merge, block", [(True, 256), (True, 2), (False, 3), (True, 1)])
def test_dedupe_matches_sequential_rule(spark, merge, block):
    import random
    rnd = random.Random(5)
    data = {}
    for doc in (1, 2, 3):
        n = 400 if doc < 3 else 12
        data[doc] = [(i // 10, i, {"flight_number": rnd.choice(["A1", "B2", "C3", None]), "note": rnd.choice(["x", "y", "", None]),
                                   "amount": rnd.choice([None, f"{rnd.randint(1, 25)}"])}) for i in range(n)]
    flat = [(doc, "items", p, i, r["flight_number"], r["note"], r["amount"]) for doc, rows in data.items() for p, i, r in rows]
    df = spark.createDataFrame(flat, "doc_id int, array_name string, page int, pos int, flight_number string, note string, amount string").repartition(5)
    got = {}
    for r in cleaning.dedupe_rows(df, window=8, merge=merge, block_pages=block).collect():
        got.setdefault(r.doc_id, []).append((r.page, r.pos, {"flight_number": r.flight_number, "note": r.note, "amount": r.amount}))
    for doc, rows in data.items():
        want = brute_dedupe(rows, ["flight_number"] if merge else [], 8)
        assert sorted(got[doc], key=lambda x: x[:2]) == want


def test_dedupe_is_stable(spark):
    df = spark.createDataFrame([(1, "items", p, p, "A1", "x") for p in range(20)], "doc_id int, array_name string, page int, pos int, flight_number string, note string")
    first = cleaning.dedupe_rows(df)
    assert first.count() == 1
    assert cleaning.dedupe_rows(first).count() == 1


AVIATION = extract.DOMAINS["aviation"]


@pytest.mark.parametrize("block", [1, 2, 256])
def test_extract_records_across_blocks(spark, block):
    content = [
        "Statement 2024\n| EK101/A EK102/D | A6ABC | 05.03 | 10:20 | OMDB | 120 |",
        "| Landing charges | 44,50 |\n| Take off: 3.25 Landing: 0.00 |",
        "| Take off fees | 12,75 |\n| Grand total | 99.00 |\n| Landing charges | 77.00 |",
    ]
    df = spark.createDataFrame([(1, i + 1, c) for i, c in enumerate(content)], "doc_id int, page int, content string")
    got = [(r.flight_number, r.date, r.net_amount, r.charges_type, r.ata, r.atd)
           for r in records.extract_records(df, AVIATION, block_pages=block).orderBy("page", "line_no", "charge_no").collect()]
    assert got == [
        ("EK101/A", "05-03-2024", 44.5, "LANDING FEES", "10:20", None),
        ("EK102/D", "05-03-2024", 3.25, "Take off", None, "10:20"),
        ("EK102/D", "05-03-2024", 12.75, "TAKE OFF FEES", None, "10:20")]


def test_canonicalize_with_source(spark):
    cols = "doc_id int, array_name string, page int, pos int, flight_number string, date string, ata string, charges_type string, amount string"
    df = spark.createDataFrame([
        (1, "m", 1, 1, "EK1/A", "01-07-2026", "10:00", "Take off", "1"), (1, "m", 1, 2, "EK1/A", "01-07-2026", "11:00", "Landing", None),
        (1, "m", 1, 3, "EK2", "02-07-2026", None, "Landing", None), (1, "m", 1, 4, "EK2", "02-07-2026", "12:00", "Landing", "5"),
        (1, "m", 1, 5, "EK3", "02-07-2026", None, "Landing", None), (1, "m", 1, 6, "EK3", "02-07-2026", None, "Landing", None),
        (1, "m", 1, 7, None, "02-07-2026", None, "Other", None)], cols)
    source = spark.createDataFrame([(1, 1, "| EK 1/A | 01.07.2026 | 10:30 |\n| EK3 | 02.07.2026 |\n| EK3 | 02.07.2026 |")], "doc_id int, page int, content string")
    got = sorted((r.pos, r.ata) for r in cleaning.canonicalize_movements(df, source).collect())
    # the only source line makes EK1/A one movement; types tie, so the landing row represents it
    assert got == [(2, "10:30"), (4, "12:00"), (5, None), (6, None), (7, None)]


@pytest.mark.parametrize("max_keys", [0, 200])
def test_key_lookup_paths_agree(spark, monkeypatch, max_keys):
    import functools
    monkeypatch.setattr(match, "_key_cuts", functools.partial(match._key_cuts, max_keys=max_keys))
    items = spark.createDataFrame([(1, "EK 1", "10:00", "?"), (1, "EK12", None, "?"), (1, "Z", None, "?"), (1, "EK12", "12:30:45", "?"), (2, "EK1", None, "?"), (1, None, None, "?")],
                                  "doc_id int, flight_number string, time string, date string")
    pages_df = spark.createDataFrame([(1, 1, "| E K12 | 01.02.2026 | 11:00 |\n| EK1 | 03.02.2026 | 10:00 |\n| EK12 | 13.14.2026 |\n| EK12 | 05.06.2026 | 12:30:45 |"),
                                      (2, 1, "nothing here 01.01.2026")], "doc_id int, page int, content string")
    out = match.fix_dates_from_source(items, pages_df, ["date"], "DD.MM.YYYY", "YYYY-MM-DD")
    got = {(r.doc_id, r.flight_number, r.time): r.date for r in out.collect()}
    assert got == {(1, "EK 1", "10:00"): "2026-02-03", (1, "EK12", None): "2026-02-01", (1, "Z", None): "?", (1, "EK12", "12:30:45"): "2026-06-05",
                   (2, "EK1", None): "?", (1, None, None): "?"}


def test_classify_paths_agree(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "Alpha only"), (3, "nothing"), (4, "ALPHABETAGAMMA xx")], "doc_id int, markdown string")
    templates = spark.createDataFrame([("a", "A", "alpha, beta, gamma, de", 2), ("b", "B", "alpha,delta", 1), ("c", "C", "", 0)], "id string, name string, keywords string, created_at int")
    got = {r.doc_id: (r.template_id, r.keyword_hits) for r in match.classify(docs, templates).collect()}
    assert got == {1: ("a", 3), 2: ("Unknown", 1), 3: ("Unknown", 0), 4: ("a", 3)}
    small = match.keyword_hits(docs, templates).select("doc_id", F.explode("scores").alias("s")).select("doc_id", "s.id", "s.keywords")
    large = match.keyword_hits(docs, templates, max_inline=0).select("doc_id", F.explode("scores").alias("s")).select("doc_id", "s.id", "s.keywords")
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def test_totals(spark):
    headers = spark.createDataFrame([(1, "100.02"), (2, "100.30"), (3, None), (4, "5"), (5, "1,000,500.00")], "doc_id int, total string")
    items = spark.createDataFrame([(1, "rows", 100.0), (2, "rows", 100.0), (3, "rows", 7.0), (5, "rows", 1000000.0)], "doc_id int, array_name string, amount double")
    out = quality.totals_report(headers, quality.line_sums(items, {"rows": {"type": "field", "name": "amount"}}), ["total"])
    assert {r.doc_id: (r.status, r.difference) for r in out.collect()} == {2: ("mismatch", 0.3), 3: ("missing", None)}


def test_attempts_and_retry(spark):
    df = spark.createDataFrame([(1, 1, 11), (1, 2, 77), (2, 1, 4), (2, 2, 3), (3, 1, 9), (3, 2, 90)], "doc_id int, attempt int, rows int")
    got = {r.doc_id: (r.attempt, r.rows) for r in quality.best_attempt(df, 12).collect()}
    assert got == {1: (2, 77), 2: (None, 4), 3: (2, 90)}
    assert {r.doc_id: r.attempt for r in quality.best_attempt(df, 0).collect()} == {1: 1, 2: 1, 3: 1}


def test_schema_types_and_outline(spark):
    spec = [{"name": "no", "type": "string", "required": True}, {"name": "tags", "type": "array", "children": [{"name": "t", "type": "string"}]},
            {"name": "rows", "type": "array", "children": [{"name": "q", "type": "number"}, {"name": "p", "type": "number"}]},
            {"name": "who", "type": "object", "children": [{"name": "x", "type": "enum", "values": ["a"]}]}, {"name": "hollow", "type": "object"}]
    df = spark.createDataFrame([("t", 1, json.dumps(spec))], "template_id string, seq int, schema string")
    fields = schema.normalize_schemas(df)
    kind = schema.to_struct_type(fields, "t")
    assert kind["no"].nullable is False and kind["tags"].dataType == T.ArrayType(T.StringType()) and "hollow" not in kind.names
    assert kind["rows"].dataType.elementType.names == ["q", "p"]
    outline = schema.schema_outline(fields).first().outline
    assert outline == "  no: string\n  tags: [string]\n  rows: [ {\n      q: number\n      p: number\n  } ]\n  who: {\n    x: string\n  }"
    pruned = {r.path for r in schema.prune_schemas(fields).collect()}
    assert "hollow" not in pruned and "who.x" in pruned


def test_maintenance(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, "y", 9)], "k int, v string, at int")
    b = spark.createDataFrame([(2, "z", 9), (3, "w", 1)], "k int, v string, at int")
    assert {r.k: r.v for r in tables.upsert(a, b, ["k"], "at").collect()} == {1: "x", 2: "z", 3: "w"}
    ids = tables.assign_ids(spark.createDataFrame([("b",), ("a",)], "n string"), ["n"], 998).collect()
    assert {r.n: r.id for r in ids} == {"a": "np_999", "b": "np_1000"}
    assert tables.delete_keys(a, b, ["k"]).count() == 1


def test_listing_counts(spark):
    rows = [(str(i), "schema-generation" if i < 13 else None) for i in range(104)]
    df = spark.createDataFrame(rows, "id string, template_name string").selectExpr("*", "'done' AS status", "1L AS created_at", "'f' AS file_name")
    c = jobs.job_counts(df, limit=20).first()
    assert (c.total, c.schema_count, c.has_more) == (104, 13, True)
    assert jobs.job_counts(df, limit=20, offset=84).first().has_more is False


def test_search_text_is_a_pattern(spark):
    df = spark.createDataFrame([("a_1.pdf",), ("ab1.pdf",), ("x.pdf",)], "file_name string").selectExpr(
        "file_name", "file_name AS id", "CAST(NULL AS STRING) AS template_name", "'u' AS user_id", "'' AS user_email", "'' AS user_first_name", "'' AS user_last_name")
    hits = lambda q: {r.file_name for r in jobs.filter_jobs(df, q=q).collect()}
    assert hits("A_1") == {"a_1.pdf", "ab1.pdf"}
    assert hits(r"a\_1") == {"a_1.pdf"}
    assert hits(r"\x") == {"x.pdf"}


def test_export_blank_and_nested(spark):
    df = spark.createDataFrame(
        [(1, "f.pdf", None, ("USD", None), [("A", "null", 3.5)])],
        "doc_id int, file_name string, currency string, head struct<currency:string,supplier:string>, odd_rows array<struct<flight:string,status:string,mtow:double>>")
    row = export.charges_table(df).first()
    assert (row["Flight Number"], row["Status"], row["AC Type/MTOW"], row["FileName"]) == ("A", "", "3.5", "f.pdf")
    details = {r.Key: r.Value for r in export.details_table(df).collect()}
    assert len(details) == 11 and details["Currency"] == "USD" and details["Supplier"] == ""


def test_csv_files(spark):
    table = spark.createDataFrame([(1, 0, *["x"] * 9, 'say "hi",\nyou')], "doc_id int, row_no int, " + ", ".join(f"`{c}` string" for c in export.CHARGES_COLUMNS))
    path = scratch_path(spark, "csv")
    sinks.write_charges_csv(table, path, bom=True)
    raw = spark.read.text(path, wholetext=True).first().value
    assert raw.startswith("\ufeffDate,AircraftRegistration") and '"say ""hi"",\nyou"' in raw
    assert one(spark, sinks.export_name(F.lit("My.Scan.PDF"), "charges")) == "My.Scan-charges.csv"


def test_text_sources(spark):
    df = spark.createDataFrame([(1, 'noise {"pages":["a","bb"],"usable":true} tail'), (2, "{}"), (3, "junk")], "id int, output string")
    good, bad = files.scan_converted(df)
    assert [(r.id, r.page, r.content_length) for r in good.orderBy("page").collect()] == [(1, 1, 1), (1, 2, 2)]
    assert {r.id for r in bad.collect()} == {2, 3}
    assert one(spark, text.file_stem(F.lit("/a/b/My Big-File (1).v2.PDF"))) == "my_bigfile_1"


def test_label_pairs_consume_the_line(spark):
    pairs = one(spark, tx.label_amount_pairs(F.lit("| Landing: 10.00 Parking: 0.00 |")))
    assert [(p["name"], p["amount"]) for p in pairs] == [("Landing", 10.0)]
    assert one(spark, tx.label_amount_pairs(F.lit("| Landing: ten |"))) is None
