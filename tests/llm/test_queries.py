"""Each registered query over the smallest tables: against DuckDB where SQL can say it, else against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from doctables.llm import decontaminate, queries
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def run(spark, name):
    return queries.QUERIES[name](spark, FOLDER).toPandas()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    result = compare(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.SQL[name])
    assert result is None, result


def test_token_counts(spark, docs, library):
    got = run(spark, "op1_token_counts")
    assert len(got) == len(docs) and got.complete.all()
    for doc, n in zip(got.doc_id, got.n_tokens):
        assert n == len(library.encode(docs[doc], add_special_tokens=False).ids)


def repeated_words(docs, size):
    """Words of each text in windows of ``size`` words that stand in two places."""
    words, places, out = {d: WORD.findall(t or "") for d, t in docs.items()}, defaultdict(list), defaultdict(set)
    for d, w in words.items():
        for i in range(len(w) - size + 1):
            places[tuple(w[i:i + size])].append((d, i))
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                out[d] |= set(range(i, i + size))
    return out


def test_repeats(spark, docs):
    got = run(spark, "op2_suffix_array_dedup")
    covered = defaultdict(set)
    for d, a, b in zip(got.doc_id, got.start, got.end):
        assert b - a >= 50
        covered[d] |= set(range(a, b))
    shorter = repeated_words(docs, 35)
    for d, words in repeated_words(docs, 50).items():
        assert words <= covered[d]
    for d, words in covered.items():
        assert words <= shorter[d]


def test_decontamination(spark, docs):
    got = {(d, i): n for d, i, n in run(spark, "op3_decontaminate")[["doc_id", "item_id", "distance"]].itertuples(index=False)}
    items = duckdb.sql(f"SELECT item_id, text FROM '{FOLDER}/benchmark.parquet'").fetchall()
    plain = {i: decontaminate.plain_words(pa.array([t]))[0] for i, t in items}
    expected = {}
    for d, t in docs.items():
        words = decontaminate.plain_words(pa.array([t]))[0]
        for i, item in plain.items():
            n, _ = decontaminate.best_match(item, words)
            if n <= decontaminate.allowed(len(item)):
                expected[d, i] = n
    assert expected and set(got) <= set(expected)
    assert len(set(got)) >= 0.98 * len(expected)
    assert all(expected[k] == n for k, n in got.items())


def test_toxicity(spark, docs):
    got = run(spark, "op5_toxicity").set_index("doc_id")
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    for d, out in got.held_out.items():
        assert out == (zlib.crc32(str(d).encode()) % 4 == 2)


def test_toxicity_accuracy(spark):
    """Held-out labels of a larger table."""
    got = queries.QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.1").toPandas().set_index("doc_id")
    labels = duckdb.sql("SELECT doc_id, toxic FROM '/root/testdata/sf0.1/labels.parquet'").df().set_index("doc_id")
    both = got[got.held_out].join(labels, how="inner")
    found = both.predicted[both.toxic == 1].mean(), both.predicted[both.toxic == 0].mean()
    assert found[0] > 0.7 and found[1] < 0.04, found


def brute_components(docs):
    sets = {}
    for d, t in docs.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d
    inverted = defaultdict(list)
    for d, s in sets.items():
        shared = Counter(e for g in s for e in inverted[g])
        for e, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[e]) - n) and find(d) != find(e):
                a, b = sorted((find(d), find(e)))
                root[b] = a
        for g in s:
            inverted[g].append(d)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_ngram_join(spark, docs):
    got = run(spark, "op6_ngram_join")
    assert {d: (n, c) for d, n, c in got.itertuples(index=False)} == brute_components(docs)


def test_quality_rules(spark, docs):
    got = run(spark, "op8_quality_rules").set_index("doc_id")
    assert len(got) == len(docs)
    for d, t in docs.items():
        w = WORD.findall(t)
        seen, covered = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)), set()
        for i in range(len(w) - 4):
            if seen[tuple(w[i:i + 5])] > 1:
                covered |= set(range(i, i + 5))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        expected = [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)]
        row = got.loc[d]
        assert row[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]].tolist() == expected
        assert row.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (row.kept and row.base_failed)


def test_packing(spark, docs, library):
    got = run(spark, "op9_best_fit_packing")
    lengths = []
    for d, pieces in got.groupby("doc_id"):
        ids = np.array([*library.encode(docs[d], add_special_tokens=False).ids, 2], "<u4")
        pieces = pieces.sort_values("piece")
        assert pieces.piece.tolist() == list(range(len(pieces))) and pieces.length.sum() == len(ids)
        assert (pieces.length.iloc[1:] == 1024).all()
        for s, n, crc in zip(pieces.start, pieces.length, pieces.ids_crc32):
            assert zlib.crc32(ids[s:s + n].tobytes()) == crc
    for _, sequence in got.groupby("sequence_id"):
        sequence = sequence.sort_values("offset")
        assert sequence.length.sum() <= 1024
        assert sequence.offset.tolist() == [0, *np.cumsum(sequence.length)[:-1]]
    lengths = sorted(got.length, reverse=True)
    assert got.sequence_id.nunique() == best_fit(lengths)


def best_fit(lengths):
    gaps = []
    for n in lengths:
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(1024 - n)
    return len(gaps)
