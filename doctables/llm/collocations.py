"""Frequent phrases and how strongly their words belong together, by vertically partitioned suffix trees.

Words stand for themselves as 64-bit hashes that include the language. Word prefixes of suffixes are counted and grouped so that a
group has at most ``budget`` suffixes; a prefix with more is lengthened by a word and counted again. Each group's suffixes, cut to
``LONGEST`` words, go to one task, which sorts them to a depth-truncated suffix subtree and reads phrase counts from its leaf totals,
apart from all other groups. A word that is too rare for any phrase ends a suffix, as a punctuation mark does.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from doctables.llm.common import INVERSE, MULTIPLIER, Bitmap, column, give_back, mixed, slices, written
from doctables.llm.running import running

LONGEST, LEAST, TOP = 4, 30, 2000
#: Suffixes that a group may have; suffixes and different words that a task gathers before it adds up equal ones and sends them.
BUDGET, GATHERED, GATHERED_WORDS = 1 << 20, 1 << 19, 1 << 17
#: There are this many groups at least, for as many tasks: a group takes less than the budget of a small corpus.
LEAST_GROUPS = 256
#: Text bytes of one step; a step takes some fifty times as much memory.
STEP_BYTES = 1 << 19
#: Bits of the filter of frequent words: 16 for each word, within these bounds (64 MB at most; more words only make it pass more).
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 29
# what a byte is: 0 part of a word, 1 blank, 2 end of a piece
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Words:
    """The words of a batch of texts: ``key`` (hash with the language), ``start`` and ``end`` bytes in ``data`` (lower case), ``last`` of a piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array, seed: int):
        texts = texts.fill_null("").cast(pa.large_binary())
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        self.data = LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]]
        at = at - at[0]
        inside = KIND[self.data] == 0
        # a text's edges are word edges
        edge = np.zeros(len(self.data) + 1, bool)
        edge[at] = True
        before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1] if len(inside) else inside
        self.start = np.flatnonzero(inside & ~before)
        after = np.concatenate([inside[1:], [False]]) & ~edge[1:] if len(inside) else inside
        self.end = np.flatnonzero(inside & ~after) + 1
        # ends of pieces up to each byte; a word is its piece's last when an end lies between it and the next word
        breaks = np.cumsum((KIND[self.data] == 2) | edge[:-1]) if len(inside) else np.zeros(0, np.int64)
        self.last = np.ones(len(self.start), bool)
        if len(self.start):
            self.last[:-1] = breaks[self.start[1:]] != breaks[self.end[:-1] - 1]
        self.text = np.searchsorted(at, self.start, side="right") - 1
        values = np.random.default_rng(seed).integers(0, 1 << 64, 256, np.uint64)[self.data]
        power = np.full(len(self.data), MULTIPLIER, np.uint64)
        back = np.full(len(self.data), INVERSE, np.uint64)
        if len(power):
            power[0] = back[0] = 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * np.multiply.accumulate(power), dtype=np.uint64)])
        coded = langs.fill_null("und").dictionary_encode()
        names, coded = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        of = np.array([xxhash.xxh3_64_intdigest(x, seed) for x in names], np.uint64)
        lang = of[coded] if len(names) else np.zeros(0, np.uint64)
        plain = (sums[self.end] - sums[self.start]) * np.multiply.accumulate(back)[self.start] + (self.end - self.start).astype(np.uint64)
        self.langs, self.lang = names, coded
        self.key = (mixed(mixed(plain) ^ lang[self.text]) | np.uint64(1)).view(np.int64)  # 0 stands for no word


def lengthened(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a prefix with one more word."""
    return mixed(prefix.view(np.uint64) * MULTIPLIER + word.view(np.uint64)).view(np.int64)


def among(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array ``of``."""
    if not len(of):
        return np.zeros(len(keys), bool)
    return of[np.minimum(np.searchsorted(of, keys), len(of) - 1)] == keys


def added_up(columns: list[np.ndarray], counts: np.ndarray, carried: int = 0) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows as one, sorted, with their counts summed; the last ``carried`` columns follow from the others."""
    keys = columns[: len(columns) - carried]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in keys:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return [c[order[at]] for c in columns], np.add.reduceat(counts[order], at) if len(at) else counts


def _counted_words(seed: int):
    """Words with their language and count, equal ones added up in the task."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}
        strings: list[bytes] = []
        langs: list[str] = []
        total = np.zeros(0, np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(known), pa.int64()), pa.array(langs, pa.string()), pa.array(strings, pa.binary()).cast(pa.string()), pa.array(total)],
                                              ["key", "lang", "word", "n"])
        for batch in slices(batches, limit=STEP_BYTES):
            words = Words(column(batch, "text"), column(batch, "lang"), seed)
            keys, first, counts = np.unique(words.key, return_index=True, return_counts=True)
            place = np.zeros(len(keys), np.int64)
            for i, (key, at) in enumerate(zip(keys.tolist(), first.tolist())):
                place[i] = k = known.setdefault(key, len(known))
                if k == len(strings):
                    strings.append(words.data[words.start[at]:words.end[at]].tobytes())
                    langs.append(words.langs[words.lang[words.text[at]]])
            total = np.concatenate([total, np.zeros(len(known) - len(total), np.int64)])
            total[place] += counts
            if len(known) > GATHERED_WORDS:
                yield out()
                known.clear(), strings.clear(), langs.clear()
                total = total[:0]
        yield out()
    return run


def _suffixes(words: Words, frequent: Bitmap) -> list[np.ndarray]:
    """The columns of all suffixes of at least two words: their first words, 0 behind their end."""
    common = frequent.has(words.key.view(np.uint64))
    n, alive, columns = len(words.key), common.copy(), [words.key]
    for d in range(1, LONGEST):
        alive = alive & np.concatenate([~words.last[d - 1:n - 1] & common[d:], np.zeros(min(d, n), bool)])[:n]
        columns.append(np.where(alive, np.concatenate([words.key[d:], np.zeros(min(d, n), np.int64)])[:n], 0))
    some = columns[1] != 0
    return [c[some] for c in columns]


def _gathered(batches: Iterable[pa.RecordBatch], seed: int, frequent, choose, carried: int = 0) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns that ``choose`` makes of the suffixes, added up whenever there are ``GATHERED`` rows."""
    held, rows = [], 0
    for batch in slices(batches, limit=STEP_BYTES):
        held.append(choose(_suffixes(Words(column(batch, "text"), column(batch, "lang"), seed), frequent.value)))
        rows += len(held[-1][0])
        if rows > GATHERED:
            yield added_up([np.concatenate(c) for c in zip(*held)], np.ones(rows, np.int64), carried)
            held, rows = [], 0
            give_back()
    if rows:
        yield added_up([np.concatenate(c) for c in zip(*held)], np.ones(rows, np.int64), carried)


def _counted_prefixes(seed: int, frequent, hot: list[np.ndarray]):
    """Prefixes of one word more than the last of ``hot``, below hot ones."""
    def choose(columns):
        prefix = columns[0]
        for d, h in enumerate(hot, 1):
            some = among(prefix, h) & (columns[d] != 0)
            columns = [c[some] for c in columns]
            prefix = lengthened(prefix[some], columns[d])
        return [*columns[: len(hot) + 1], prefix]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, counts in _gathered(batches, seed, frequent, choose, 1):
            words = columns[:-1] + [np.zeros_like(counts)] * (LONGEST - len(columns) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (columns[-1], *words, counts)], ["key", "w1", "w2", "w3", "w4", "n"])
    return run


def _grouped_suffixes(seed: int, frequent, hot: list[np.ndarray], bounds: np.ndarray):
    """Suffixes by group, as arrays: a row has the suffixes of one group that a task has gathered."""
    def choose(columns):
        prefix, depth = columns[0], np.ones(len(columns[0]), np.int64)
        keep, below = np.ones(len(prefix), bool), np.ones(len(prefix), bool)
        for d, h in enumerate(hot, 1):
            below &= among(prefix, h)
            # a suffix that ends at a hot prefix is counted there
            keep &= ~below | (columns[d] != 0)
            prefix = np.where(below, lengthened(prefix, columns[d]), prefix)
            depth[below] = d + 1
        group = np.maximum(np.searchsorted(bounds, prefix, side="right") - 1, 0)
        return [c[keep] for c in (*columns, depth, group)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, counts in _gathered(batches, seed, frequent, choose, 2):
            order = np.argsort(columns[-1], kind="stable")
            *columns, group, counts = (c[order] for c in (*columns, counts))
            at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            ends = [*at[1:].tolist(), len(group)]
            blobs = [pa.array([c[a:b].tobytes() for a, b in zip(at.tolist(), ends)], pa.binary()) for c in (*columns, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(group[at].astype(np.int64)), *blobs], ["grp", "w1", "w2", "w3", "w4", "depth", "n"])
    return run


def _subtree(least: int):
    """Phrase counts of one group: its sorted suffixes are the leaves, runs of equal first words the inner nodes."""
    def run(group: pa.Table) -> pa.Table:
        *words, depth, n = ([np.frombuffer(x, np.int64) for x in group.column(c).to_pylist()] for c in ("w1", "w2", "w3", "w4", "depth", "n"))
        (*words, depth), n = added_up([np.concatenate(c) for c in (*words, depth)], np.concatenate(n), 1)
        out = [[] for _ in range(LONGEST + 1)]
        new = np.zeros(len(n), bool)
        new[0] = True
        for d, w in enumerate(words, 1):
            new[1:] |= w[1:] != w[:-1]
            at = np.flatnonzero(new)
            total = np.add.reduceat(n, at)
            kept = (d > 1) & (w[at] != 0) & (total >= least) & (depth[at] <= d)
            for values, c in zip(out, (*words[:d], *[np.zeros_like(n)] * (LONGEST - d), None)):
                values.append(total[kept] if c is None else c[at[kept]])
        give_back()
        return pa.table([np.concatenate(v) for v in out], names=["w1", "w2", "w3", "w4", "f"])
    return run


def _frequent_words(docs: DataFrame, least: int) -> tuple[int, DataFrame, DataFrame]:
    """A hash seed that tells all frequent words apart, the words ``(key, lang, word, n)`` that are frequent, and ``(lang, n)`` of all words."""
    seed = 0
    while True:
        rows = docs.mapInArrow(_counted_words(seed), "key long, lang string, word string, n long")
        words = written(rows.groupBy("key", "lang", "word").agg(F.sum("n").alias("n")), "words")
        several = words.groupBy("key").agg(F.count("*").alias("words"), F.sum("n").alias("n")).where(f"words > 1 and n >= {least}")
        if several.isEmpty():
            return seed, written(words.where(f"n >= {least}"), "frequent-words"), words.groupBy("lang").agg(F.sum("n").alias("n"))
        seed += 1


def phrase_counts(docs: DataFrame, least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(words array<long>, f)`` of all phrases of 1 to ``LONGEST`` words that occur ``least`` times, by language; what
    :func:`_frequent_words` says of the words; and ``(lang, n)`` of all words.

    At most 2 / ``budget`` prefixes per suffix are hot, and as many groups have bounds that the driver sees and sends out.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    seed, frequent, totals = _frequent_words(docs, least)
    bits = LEAST_BITS
    while bits < min(16 * frequent.count(), MOST_BITS):
        bits *= 2
    sent = [spark.sparkContext.broadcast(Bitmap(frequent, "key", bits, hashed=True))]
    occurrences = frequent.agg(F.sum("n")).first()[0] or 0
    half = max(min(budget, occurrences // LEAST_GROUPS * 2) // 2, 1)
    level = frequent.select("key", F.col("key").alias("w1"), *(F.lit(0).cast("long").alias(w) for w in ("w2", "w3", "w4")), "n")
    levels, hot, schema = [], [], "key long, w1 long, w2 long, w3 long, w4 long, n long"
    while True:
        levels.append(level)
        keys = np.sort(level.where(f"n > {half}").select("key").toArrow().column(0).to_numpy())
        if not len(keys) or len(levels) == LONGEST:
            break
        hot.append(keys)
        level = docs.mapInArrow(_counted_prefixes(seed, sent[0], list(hot)), schema).groupBy("key", "w1", "w2", "w3", "w4").agg(F.sum("n").alias("n"))
        level = written(level, "prefixes")
    # prefixes in the order of their keys, cut where half a budget of suffixes is full; hot ones are left to their longer prefixes
    ends = [lv.where(f"n <= {half} or w4 <> 0").select("key", F.least("n", F.lit(half)).alias("n")) for lv in levels]
    prefixes = ends[0]
    for more in ends[1:]:
        prefixes = prefixes.unionByName(more)
    groups = running(prefixes, ["key", "n"], sums=["n"], label="groups").groupBy(F.expr(f"(n_upto - n) div {half}").alias("g")).agg(F.min("key").alias("key"))
    bounds = np.sort(groups.select("key").toArrow().column(0).to_numpy())
    rows = docs.mapInArrow(_grouped_suffixes(seed, sent[0], hot, bounds), "grp long, w1 binary, w2 binary, w3 binary, w4 binary, depth binary, n binary")
    found = rows.groupBy("grp").applyInArrow(_subtree(least), "w1 long, w2 long, w3 long, w4 long, f long")
    # the counts of hot prefixes, and of single words
    for lv in levels[:1]:
        found = found.unionByName(lv.select("w1", "w2", "w3", "w4", F.col("n").alias("f")))
    for lv in levels[1:LONGEST - 1]:
        found = found.unionByName(lv.where(f"n > {half} and n >= {least}").select("w1", "w2", "w3", "w4", F.col("n").alias("f")))
    counts = written(found.select(F.filter(F.array("w1", "w2", "w3", "w4"), lambda w: w != 0).alias("words"), "f"), "phrases")
    for x in sent:
        x.unpersist()
    return counts, frequent, totals


def scored_phrases(counts: DataFrame) -> DataFrame:
    """``(words, a, l, r, score)`` of the phrases of two words and more that no longer phrase stands for.

    The score is that of the weakest cut, floor(2000000 a / (l + r)) in exact decimals; the first of equal cuts counts. A phrase goes when a
    longer one that holds it has four fifths of its count.
    """
    phrases = counts.where("size(words) > 1")
    cuts = phrases.select("words", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
    parts = cuts.select("words", "a", "k", F.inline(F.expr("array(struct(1 AS side, slice(words, 1, k) AS part), struct(2 AS side, slice(words, k + 1, size(words) - k) AS part))")))
    known = counts.select(F.col("words").alias("part"), F.col("f").alias("of_part"))
    cuts = parts.join(known, "part").groupBy("words", "a", "k").agg(*(F.max(F.when(F.col("side") == s, F.col("of_part"))).alias(c) for s, c in ((1, "l"), (2, "r"))))
    score = F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").alias("score")
    scored = cuts.groupBy("words", "a").agg(F.min(F.struct(score, "k", "l", "r")).alias("c")).select("words", "a", "c.l", "c.r", "c.score")
    inner = phrases.where("size(words) > 2").select("f", F.explode(F.expr(
        "flatten(transform(sequence(2, size(words) - 1), n -> transform(sequence(1, size(words) - n + 1), i -> slice(words, i, n))))")).alias("words"))
    longer = inner.groupBy("words").agg(F.max("f").alias("most"))
    stands = F.col("most").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * 80
    return scored.join(longer, "words", "left").where(~F.coalesce(stands, F.lit(False))).drop("most")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """Each language's first ``top`` phrases of ``docs (lang, text)``: lang, rank, phrase, a, l, r, n, score.

    A null lang is ``und``; a null or empty text has no words, and repeated rows count again. Other columns are ignored. An empty
    table, or one without frequent phrases, gives no rows.
    """
    counts, frequent, totals = phrase_counts(docs, least, budget)
    scored = written(scored_phrases(counts), "scored")
    named = frequent.select(F.col("key").alias("w"), "lang", "word")
    best = scored.join(named.select(F.col("w").alias("first"), "lang"), F.col("words")[0] == F.col("first")).drop("first")
    # per language first the best of each of many parts, then the best of those, with all ties; only these get their text
    spread = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    best = best.withColumn("part", F.pmod(F.hash("words"), F.lit(spread)))
    for by in (["lang", "part"], ["lang"]):
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"))
        best = best.withColumn("at", F.rank().over(order)).where(F.col("at") <= top)
    best = written(best.drop("at", "part"), "best")
    spelled = best.select("words", F.posexplode("words").alias("i", "w")).join(named.drop("lang"), "w").groupBy("words").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = best.join(spelled, "words").join(totals, "lang").withColumn("rank", F.row_number().over(order).cast("long"))
    return rows.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir):
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS pid, lang, words FROM (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM (
      SELECT coalesce(lang, 'und') AS lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents)) WHERE len(words) > 0),
grams AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM pieces), (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(words)),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
frequent AS (SELECT *, string_split(phrase, ' ') AS words FROM counts WHERE f >= 30),
cuts AS (
  SELECT c.*, l.f AS l, r.f AS r, cut, (2000000::HUGEINT * c.f) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM frequent WHERE k > 1) c
  JOIN frequent l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1:cut], ' ')
  JOIN frequent r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[cut + 1:], ' ')),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, max(f) AS most
  FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM frequent WHERE k > 2), (SELECT unnest([2, 3]) AS m) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
left_over AS (
  SELECT w.* FROM weakest w LEFT JOIN inside s ON s.lang = w.lang AND s.phrase = w.phrase WHERE s.most IS NULL OR 100 * s.most::HUGEINT < 80 * w.f::HUGEINT),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank FROM left_over)
SELECT lang, rank, phrase, f AS a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
