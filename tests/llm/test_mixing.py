"""Mixing by weighted fair queueing: targets, the mix, and odd rows."""

from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from doctables.llm import mixing
from doctables.llm.running import running

DOCS = "doc_id long, text string, source string, size long, row long, target double"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, 7, 7, 7.0) for d, t, s in rows], DOCS).repartition(3)


def brute_targets(sizes, weights=(5, 2, 1), repeats=3):
    """Sizes by source; the targets by plain rounds."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        left, share = total - sum(repeats * sizes[s] for s in full), sum(w for s, w in weight.items() if s not in full)
        more = {s for s in sizes if s not in full and weight[s] * left > repeats * sizes[s] * share}
        if not more:
            return {s: float(repeats * sizes[s]) if s in full else weight[s] * left / share for s in sizes}
        full |= more


ODD = [(1, "a b c", "x"), (1, "a b c", "x"), (2, "", "y"), (3, None, None), (None, "d e", None), (4, "\x0b f\x1cg \x0c", "é"), (5, "h " * 900, "z"),
       (6, "i j\tk\nl", "y"), (None, None, "only empty"), (7, "m", "B"), (8, "n o", "B")]


def checked(spark, rows):
    """The mix of ``rows`` after its checks: words taken by source."""
    size = [len([w for w in mixing_split(t)]) for _, t, _ in rows]
    by_source = defaultdict(int)
    for n, (_, _, s) in zip(size, rows):
        by_source[s] += n
    sizes, targets, mixed = mixing.queue(frame(spark, rows))
    got = {r.source: (r.source_size, r.target) for r in targets.collect()}
    expected = brute_targets(dict(by_source))
    assert got == {s: (by_source[s], t) for s, t in expected.items()}
    parts = mixed.orderBy("position").collect()
    assert sum(p.words for p in parts) == sum(size)
    at = 0
    for p in parts:
        assert p.words > 0 and p.position == at
        at += p.words
    assert [p.finish for p in parts] == sorted(p.finish for p in parts)
    taken, where = defaultdict(int), {r.row: r for r in sizes.collect()}
    per_row = defaultdict(int)
    for p in parts:
        taken[where[p.row].source] += p.words
        per_row[p.row] += p.words
        assert where[p.row].doc_id == p.doc_id
    assert all(n <= 3 * where[r].size for r, n in per_row.items())
    for s, t in expected.items():
        assert abs(taken[s] - t) <= len(expected)
    return taken


def mixing_split(text):
    import re
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_odd_rows(spark):
    checked(spark, ODD)


def test_one_source_and_equal_rows(spark):
    taken = checked(spark, [(1, "a b c", "x")] * 5)
    assert dict(taken) == {"x": 15}


def test_small_sources_stop_at_three_times_their_size(spark):
    taken = checked(spark, [(i, "w " * 400, "b") for i in range(5)] + [(9, "v " * 100, "a"), (10, "u", "c")])
    assert taken["a"] == 300 and taken["c"] == 3


def test_empty_tables(spark):
    assert mixing.mix_documents(frame(spark, [])).count() == 0
    assert mixing.mix_documents(frame(spark, [(1, None, "x"), (2, "", None)])).count() == 0


def test_word_counts_of_slices():
    texts = pa.array(["zz", "", None, " a", "b ", "c d", "   x", " "])
    assert mixing.word_counts(texts).tolist() == [1, 0, 0, 1, 1, 2, 2, 0]
    assert mixing.word_counts(texts.slice(3, 3)).tolist() == [1, 1, 2]
    assert mixing.word_counts(pa.array([], pa.string())).tolist() == []


def test_reruns_agree_and_seeds_differ(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, two, other = (mixing.mix_documents(d, seed=s).toPandas().sort_values("position") for d, s in ((docs, 0), (docs.repartition(7), 0), (docs, 1)))
    assert one.doc_id.tolist() == two.doc_id.tolist() and one.words.tolist() == two.words.tolist()
    assert one.doc_id.tolist() != other.doc_id.tolist()


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_running_totals(spark, parts):
    """Against numpy, with a group that spans most blocks."""
    rng = np.random.default_rng(4)
    g = np.sort(rng.choice([1, 1, 1, 1, 2, 3, 4, 5], 500))
    rows = [(int(a), i, int(rng.integers(-9, 9)), int(rng.integers(-2**62, 2**62))) for i, a in enumerate(g)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        df = spark.createDataFrame(rows, "g long, i long, n long, x long").repartition(4)
        got = sorted(map(tuple, running(df, ["g", "i"], sums=["n"], xors=["x"], group="g").collect()))
        all_of = sorted((r.i, r.n_upto) for r in running(df, ["i"], sums=["n"]).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected, n, x, last = [], 0, 0, None
    for a, i, v, w in rows:
        n, x = (v, w) if a != last else (n + v, x ^ w)
        last = a
        expected.append((a, i, v, w, n, x))
    assert got == expected
    assert all_of == list(enumerate(np.cumsum([r[2] for r in rows]).tolist()))


def test_shares_of_the_smallest_table():
    """The statement's targets against plain rounds."""
    rows = duckdb.sql(mixing.SQL.replace("documents", "'/root/testdata/sf0.001/documents.parquet'")).fetchall()
    docs = dict(duckdb.sql("SELECT doc_id, source FROM '/root/testdata/sf0.001/documents.parquet'").fetchall())
    sizes = defaultdict(int)
    for d, n, *_ in rows:
        sizes[docs[d]] += n
    expected = brute_targets(dict(sizes))
    assert all(t == expected[docs[d]] for d, _, _, t, _ in rows)
