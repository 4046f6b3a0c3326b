"""Phrases against plain counting, with budgets so small that prefixes are lengthened at every level."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from doctables.llm import collocations
from doctables.llm.common import Bitmap

DOCS = "doc_id long, text string, lang string, key long, n long, words string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, 1, "w") for i, (t, lang) in enumerate(rows)], DOCS).repartition(3)


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        kept = []
        common = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        longer = Counter()
        for q, b in common.items():
            for m in range(2, len(q)):
                for i in range(len(q) - m + 1):
                    longer[q[i:i + m]] = max(longer[q[i:i + m]], b)
        for p, a in common.items():
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if 100 * longer[p] < 80 * a:
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "The", "of", "and", "é", "ÉA", "x1", "zz\x0bq", "of\ttheir", "a.b", "naïve", "-", "\x1c", "very  long", "end.\n", "new;york", "new york", "york"]
    return [(" ".join(rng.choices(words, range(len(words), 0, -1), k=rng.randrange(60))), rng.choice(["en", "en", "en", None, "und", "dé"])) for _ in range(n)]


@pytest.mark.parametrize(("budget", "least"), [(1 << 20, 5), (64, 3), (2, 4)])
def test_counts_and_scores(spark, budget, least):
    rows = texts(budget)
    expected = brute(rows, least, 2000)
    assert len(expected) > 50
    assert rows_of(collocations.collocations(frame(spark, rows), least, 2000, budget)) == expected


def test_first_phrases_and_ties(spark):
    rows = texts(9)
    assert rows_of(collocations.collocations(frame(spark, rows), 3, 7, 100)) == brute(rows, 3, 7)


def test_gathered_in_small_steps(spark, monkeypatch):
    """Map tasks that add up often give the same."""
    rows = texts(10) + [("w " * 30_000, "en"), ("v w. " * 9000, None)]
    df = collocations.phrase_counts(frame(spark, rows), 3, 1000)[0]
    got = Counter({tuple(r.words): r.f for r in df.collect()})
    assert len(got) == df.count()
    f = Counter()
    for text, lang in rows:
        for words in pieces(text):
            f.update((lang or "und", *words[i:i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    assert sorted(got.values()) == sorted(a for a in f.values() if a >= 3)


def test_nothing_to_find(spark):
    for rows in ([], [(None, None), ("", "en"), (" .\n", "en")], [("a b c", "en")] * 29):
        assert rows_of(collocations.collocations(frame(spark, rows))) == brute(rows, 30, 2000) == []
    assert rows_of(collocations.collocations(frame(spark, [("a b c", None)] * 30))) == [("und", 1, "a b c", 30, 30, 30, 90, 1_000_000)]


def test_words_of_slices():
    got = pa.array(["left out", "Ab c", None, "", "d.e f", "\xe9", " g"])
    langs = pa.array(["en", "en", None, "en", "en", "en", "fr"])
    words = collocations.Words(got.slice(1), langs.slice(1), 0)
    assert [words.data[a:b].tobytes().decode() for a, b in zip(words.start, words.end)] == ["ab", "c", "d", "e", "f", "é", "g"]
    assert words.last.tolist() == [False, True, True, False, True, True, True]
    assert words.text.tolist() == [0, 0, 3, 3, 3, 4, 5] and len(set(words.key.tolist())) == 7
    assert len(collocations.Words(pa.array([""]), pa.array(["en"]), 0).key) == 0
    assert isinstance(Bitmap, type) and np.array_equal(collocations.among(np.array([1, 2, 3]), np.array([2])), [False, True, False])
