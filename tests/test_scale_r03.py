"""Work is dealt out to as many tasks as the input has, and done once."""

import glob

from pyspark.sql import functions as F

from doctables.functions import text
from doctables.operators import match as MT
from doctables.operators import records as R
from doctables.operators import schema as S
from doctables.operators.extract import DOMAINS
from doctables.session import shared_dir
from doctables.workload import load_all
from doctables.workload.fixtures import Tables


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_schemas_are_dealt_out_and_their_children_parsed_once(spark):
    one = spark.createDataFrame([("a", 1, '[{"name":"x","type":"object","children":[{"name":"y","type":"string"}]}]'), ("b", 2, "[]"), ("c", 3, None)],
                                "template_id string, seq int, schema string").coalesce(1)
    fields = S.normalize_schemas(one)
    assert "Repartition" in plan(fields)
    assert not [line for line in plan(fields).splitlines() if "Filter" in line and "from_json" in line]
    assert sorted(r.path for r in fields.collect()) == ["x", "x.y"]


def test_types_are_read_from_stored_fields(spark, monkeypatch):
    seen, real = [], S.to_struct_type
    monkeypatch.setattr(S, "to_struct_type", lambda fields, template: seen.append(plan(fields)) or real(fields, template))
    assert load_all()["d4_struct_types"].run(spark, "/root/testdata/sf0.001").count() == len(seen) > 1
    assert not [p for p in seen if "UnionLoop" in p]


def test_streamed_documents_lie_in_as_many_files_as_they_have_parts(spark):
    before = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/inbox-*"))
    name = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(name)
    spark.conf.set(name, "32k")
    try:
        out = load_all()["st1_stream_documents"].run(spark, "/root/testdata/sf0.01")
        assert out.agg(F.count("*")).first()[0] == 1000
        parts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").rdd.getNumPartitions()
    finally:
        spark.conf.set(name, old)
    new, = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/inbox-*")) - before
    files = glob.glob(f"{new}/part-*.parquet")
    assert len(files) != 4 and 1 <= len(files) <= parts


def test_lines_of_movements_are_parsed_once(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    scanned = R.scan_movements(R.movement_lines(t.invoice_pages, DOMAINS["aviation"]))
    assert "Generate" not in plan(scanned) and scanned.count() > 0


def test_source_times_need_one_join_and_read_each_date_once(spark):
    items = spark.createDataFrame([(1, 1, 1, "EK001", "02-01-2024"), (1, 1, 2, "EK001", "02-01-2024"), (2, 1, 1, "FZ9", "03-01-2024"), (3, 1, 1, None, None)],
                                  "doc_id long, page int, pos long, flight_number string, date string")
    pages = spark.createDataFrame([(1, 1, "| EK 001 | 2.1.2024 | 10:05 |"), (2, 1, "FZ9 3/1/2024 11:00\nFZ9 03.01.2024 12:00"), (3, 1, None)],
                                  "doc_id long, page int, content string")
    out = MT.source_time(items, pages)
    assert sum("Join" in line for line in plan(out).splitlines()) == 1
    assert [tuple(r) for r in out.collect()] == [(1, "EK001", "02-01-2024", "10:05")]


def test_lines_of_few_keys_are_tested_where_they_are(spark, monkeypatch):
    items = spark.createDataFrame([(1, "EK001", "10:05", "x"), (1, "EK001", None, "x"), (1, "EK001", "11:00", "x"), (2, None, "10:05", "x")],
                                  "doc_id long, flight_number string, time string, date string")
    pages = spark.createDataFrame([(1, 1, "EK 001 2.1.2024 9:00\nEK 001 03.01.2024 10:05")], "doc_id long, page int, content string")
    monkeypatch.setattr(MT, "_piece_cuts", None)
    out = MT.fix_dates_from_source(items, pages, ["date"], "DD.MM.YYYY", "YYYY/MM/DD")
    assert sorted((r.doc_id, r.time or "", r.date) for r in out.collect()) == [(1, "", "2024/01/02"), (1, "10:05", "2024/01/03"), (1, "11:00", "x"), (2, "10:05", "x")]


def test_copies_of_a_document_are_joined_before_their_words_are_rows(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "two three"), (2, None), (None, "one"), (None, "one"), (3, "")], "doc_id long, text string")
    words = spark.createDataFrame([("one",), ("two",), ("three",), ("",), ("one",)], "word string")
    for part_chars in (4, 100):
        out = MT.substrings_join(docs, "text", words, "word", part_chars)
        assert all("word" not in line for line in plan(out).splitlines() if "Aggregate" in line)
        assert sorted((r.doc_id or 0, r.word) for r in out.collect()) == [(0, "one"), (1, "one"), (1, "three"), (1, "two")]


def test_plain_text_of_cells(spark):
    texts = ["| a | b |", "||", "|  a b\n|c", "|a", "a|b|c|d", "x >> y -- z", "|  |"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.markdown_to_text(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["a b |".strip(), "", "a bc", "|a", "abc|d", "x  y  z", ""]
    assert not [p for p, _, marks in text.PLAIN_TEXT_REWRITES if marks == ("|",)]
