"""The post-processing chain: what it leaves on disk, and short cuts that must give what the long way gives."""

import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from doctables import session
from doctables.functions import dates, money, text
from doctables.operators import records
from doctables.operators import text as tx
from doctables.operators.extract import DOMAINS
from doctables.plans.post_process import Settings, run_chain
from doctables.session import drop, passing, stored

COLUMNS = {"description": "string", "charges_type": "string", "flight_number": "string", "date": "string", "net_amount": "double", "airport": "string"}
PAGE = "# Statement 2024\n| EK123/A | A6ABX | 01.02.2024 | 10:20 | OMAB | 55.50 |\n| EK124/D | A6ABX | 02.02.2024 | 11:20 | OMAB | 66.50 |"


@pytest.fixture
def tables(tmp_path, monkeypatch):
    """Names and labels of the scratch tables, in a folder of the test's own."""
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    return lambda: {n: n.rsplit("-", 1)[0] for n in os.listdir(tmp_path)}


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {b for i in range(blocks.size()) if (b := blocks.apply(i).name()).startswith("shuffle_")}


def chain(spark, counts=None, **more):
    items = spark.createDataFrame(
        [(d, "line_items", p, i, "Landing", "landing fees", f, "01.02.2024", 5.0, "APT1") for d in range(3) for p in (1, 2) for i, f in enumerate(("EK123/A", "EK124/D", "EK125/A"))],
        "doc_id bigint, array_name string, page int, pos bigint, description string, charges_type string, flight_number string, date string, net_amount double, airport string")
    pages = spark.createDataFrame([(d, p, PAGE) for d in range(3) for p in (1, 2)], "doc_id bigint, page int, content string")
    return run_chain(items, pages, Settings(domain="aviation", date_columns=["date"], date_format="DD-MM-YYYY", date_input_format="DD.MM.YYYY", columns=COLUMNS, **more), counts=counts)


def test_chain_leaves_only_tables_that_are_read(spark, tables):
    before = tables()
    rows = chain(spark, per_page=True)["rows"]
    assert {v for k, v in tables().items() if k not in before} == {"movements", "records"}
    assert sorted({(r.flight_number, r.date) for r in rows.collect()}) == [("EK123/A", "01-02-2024"), ("EK124/D", "02-02-2024"), ("EK125/A", "01-02-2024")]
    before = tables()
    counts = spark.createDataFrame([(0, "line_items", 9)], "doc_id bigint, array_name string, counted bigint")
    out = chain(spark, counts, page_limit=1)
    assert {v for k, v in tables().items() if k not in before} == {"movements", "records", "merged-pages"}
    assert [(r.doc_id, r.expected, r.actual) for r in out["coverage"].collect()] == [(0, 9, 3)] and out["rows"].count()


def test_chain_without_dates_keeps_its_reports(spark, tables):
    before = tables()
    counts = spark.createDataFrame([(1, "line_items", 9)], "doc_id bigint, array_name string, counted bigint")
    items = spark.createDataFrame([(1, "line_items", 1, 1, "EK123/A", "01-02-2024")], "doc_id bigint, array_name string, page int, pos bigint, flight_number string, date string")
    pages = spark.createDataFrame([(1, 1, PAGE)], "doc_id bigint, page int, content string")
    for given, left in ((counts, {"movements", "merged-pages"}), (None, {"movements"})):
        out = run_chain(items, pages, Settings(), counts=given)
        assert {v for k, v in tables().items() if k not in before} == left
        assert out["rows"].count() == 1 and ("coverage" not in out or out["coverage"].count() == 1)
        before = tables()


def test_stored_steps_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    df = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    until = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and df.count() == 7


def test_passing_tables(spark, tables):
    before = tables()
    with passing(spark):
        a = stored(spark.range(3), "a")
        with passing(spark):
            b = stored(a, "b", keep=True)
            stored(a, "c")
        assert {v for k, v in tables().items() if k not in before} == {"a", "b"}
        d = stored(b, "d", keep=True)
    assert {v for k, v in tables().items() if k not in before} == {"d"} and d.count() == 3
    drop(d)
    assert tables().keys() <= before.keys()


def test_chain_makes_its_pages_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    pages = spark.createDataFrame([(d, p, PAGE) for d in range(3) for p in (1, 2)], "doc_id bigint, page int, content string").mapInArrow(seen, "doc_id bigint, page int, content string")
    items = spark.createDataFrame([(1, "line_items", 1, 1, "EK123/A", "01.02.2024", "APT1")], "doc_id bigint, array_name string, page int, pos bigint, flight_number string, date string, airport string")
    out = run_chain(items, pages, Settings(domain="aviation", date_columns=["date"], date_format="DD-MM-YYYY", date_input_format="DD.MM.YYYY", columns=COLUMNS, min_records=2))
    assert {(r.flight_number, r.net_amount) for r in out["rows"].collect()} == {("EK123/A", 55.5), (None, 66.5)}
    assert made.value == 6


def scanned_by_hand(rows):
    """(doc_id, page, line_no) to arrival, departure and whether the line is at or after the first summary after a movement."""
    out, state = {}, {}
    for doc, page, line, summary, movement in sorted(rows, key=lambda r: r[:3]):
        arrival, departure, moved, stopped = state.get(doc, (None, None, False, False))
        stopped |= summary and moved
        if movement:
            arrival, departure, moved = movement[0] and movement or arrival, movement[1] and movement or departure, True
        state[doc] = arrival, departure, moved, stopped
        out[doc, page, line] = arrival, departure, stopped
    return out


def test_only_documents_of_several_blocks_are_summed_up(spark, monkeypatch):
    rng, rows = random.Random(4), []
    for doc in range(40):
        for page in range(1, 2 if doc % 4 else 10):
            for line in range(rng.randint(1, 6)):
                kind = rng.choice("mmso")
                rows.append((doc, page, line, kind == "s", (rng.choice([None, f"{line}/A"]), rng.choice([None, f"{line}/D"]), f"R{page}", "1-1", None, None) if kind == "m" else None))
    kind = "struct<arrival:string,departure:string,reg:string,date:string,time:string,origin:string>"
    lines = spark.createDataFrame(rows, f"doc_id bigint, page int, line_no int, summary boolean, movement {kind}")
    tables, write = {}, records.stored
    monkeypatch.setattr(records, "stored", lambda df, label, **more: tables.setdefault(label, write(df, label, **more)))
    got = {(r.doc_id, r.page, r.line_no): (r.arrival and tuple(r.arrival), r.departure and tuple(r.departure), r.stopped) for r in records.scan_movements(lines, 3).collect()}
    assert got == scanned_by_hand(rows)
    assert {r.doc_id for r in tables["long-documents"].collect()} == set(range(0, 40, 4))


def test_page_reports_of_a_chain(spark):
    counts = spark.createDataFrame([(0, "line_items", 4), (1, "line_items", 3), (2, "line_items", 7)], "doc_id bigint, array_name string, counted bigint")
    out = chain(spark, counts, per_page=True)
    assert sorted((r.doc_id, r.expected, r.actual) for r in out["coverage"].collect()) == [(0, 4, 3), (2, 7, 3)]


@pytest.mark.parametrize("value, shown", [("31.12.2023", "2023/12/31"), ("12/31/2023", "2023/12/31"), ("31/31/2023", "31/31/2023"), ("05-04-1000", "3000/04/05"), ("5.4.2023", "2023/04/05"),
                                          ("00.01.2023", "00.01.2023"), ("05.04.2023\n", "2023/04/05"), ("x", "x"), (None, None)])
def test_padded_dates(spark, value, shown):
    got = spark.createDataFrame([(value,)], "d string").select(dates.format_date(F.col("d"), "YYYY/MM/DD", "DD.MM.YYYY").alias("d")).first().d
    assert got == shown


@pytest.mark.parametrize("value, amount", [("12.50", 12.5), ("1.234,5", 1234.5), ("12,50", 12.5), ("1,234", 1234.0), ("1234", 12.34), ("12,", 12.0), ("1.2.3", 1.2), ("12.5 EUR", 12.5), ("", None), (None, None)])
def test_plain_amounts(spark, value, amount):
    assert spark.createDataFrame([(value,)], "a string").select(money.parse_amount(F.col("a")).alias("a")).first().a == amount


def test_white_space_class():
    assert {c for c in map(chr, range(0x10000)) if re.match(text.WS, c)} == set(text.BLANKS)


def test_other_vocabulary_is_searched_for_where_asked(spark):
    lines = spark.createDataFrame([("| EK123/A | A6ABX | 01.02.2024 | 10:20 | OMAB |",), ("| Fee 01.02.2024 10:20 |",)], "line string")
    vocab = DOMAINS["aviation"]["vocabulary"]
    every, asked = (tx.extract_vocab(lines, vocab, c).collect() for c in (None, F.size("flights") > 0))
    assert every[0] == asked[0] and every[1].time == "10:20" and (asked[1].dates, asked[1].time, asked[1].origin) == (None, None, None)
