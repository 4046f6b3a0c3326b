"""Repeated passages by a sparse suffix array.

Suffixes are kept only where a text's own words choose them: at minimisers, the smallest hash of ``GRAM`` words among ``SPREAD``
neighbouring places. A passage of ``MIN_WORDS`` words that stands in two places has the same minimisers in both, the first within
its first ``SPREAD`` words, so ``SUFFIX`` words from there on lie inside it. Suffixes that stand elsewhere too, by a 64-bit hash of those
words, make one row each: the hash, and hashes of the ``REACH`` words to its right and to its left. The rows are sorted over all
partitions by that, so a passage of very many copies spreads over tasks, and each is compared with its neighbours: by how
many words both go on alike to the right and to the left, every window of ``MIN_WORDS`` words around the suffix is settled that the neighbour
has as well. Neighbours are those in the order of the right words and, within a batch, in that of the left words.

A window whose like is no neighbour in either order is left over. Of a suffix whose equals have other words around them, the windows
that may stand elsewhere by the longest extension on both sides go into a second round, which compares them by a hash; of neighbours
that share a window only one does. The first and the last row of a batch, which have a neighbour elsewhere, take part in full. So
no shorter partner stands in for a longer one, and every window of ``MIN_WORDS`` words that stands twice is found.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from doctables.llm.common import MULTIPLIER, Bitmap, column, hashed, mixed, signed, slices, window_hashes, words_of, written

MIN_WORDS = 50
GRAM, SPREAD = 10, 16
SUFFIX = MIN_WORDS - SPREAD + 1
#: Words on each side of a suffix that windows around it can reach.
REACH = SPREAD - 1
#: The filter of shared suffixes has this many bits for each, 128 MB at most; what else passes finds no equal neighbour.
BITS_PER_KEY, MOST_BITS = 16, 1 << 30


def _sliding(x: np.ndarray, size: int, by) -> np.ndarray:
    """``by`` over ``size`` values (a power of two) from each place on."""
    step = 1
    while step < size:
        x = by(x[:-step], x[step:]) if len(x) > step else x[:0]
        step *= 2
    return x


def minimisers(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of kept suffixes among the words of all texts, their text, and the windows that each is a minimiser of.

    ``starts`` has one more entry than there are texts. Bit ``i`` of the windows is the one that begins ``i`` words before the suffix.
    """
    grams = window_hashes(values, GRAM)
    least = _sliding(grams, SPREAD, np.minimum)
    if not len(least):
        return (np.zeros(0, np.int64),) * 3
    # windows that lie in one text
    ends = np.repeat(starts[1:], np.diff(starts))
    least = np.where(np.arange(len(least)) + SPREAD + GRAM - 1 <= ends[: len(least)], least, np.uint64(0))
    padded = np.concatenate([np.zeros(REACH, np.uint64), least, np.zeros(len(grams) - len(least), np.uint64)])
    at = np.flatnonzero(_sliding(padded, SPREAD, np.maximum)[: len(grams)] == grams)
    of = np.searchsorted(starts, at, side="right") - 1
    windows = np.zeros(len(at), np.int64)
    for i in range(SPREAD):
        begin = at - i
        inside = (begin >= starts[of]) & (begin + MIN_WORDS <= starts[of + 1])
        windows |= (inside & (least[np.clip(begin, 0, len(least) - 1)] == grams[at])).astype(np.int64) << i
    kept = windows > 0
    return at[kept], of[kept], windows[kept]


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words, starts = words_of(column(batch, "text"))
        values = hashed(words)
        at, *_ = minimisers(values, starts)
        yield pa.RecordBatch.from_arrays([signed(window_hashes(values, SUFFIX)[at])], ["key"])


def around(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """32-bit hashes of the ``REACH`` words behind each suffix and, going back, of those before it; 0 beyond the first and last text."""
    steps = np.concatenate([np.arange(SUFFIX, SUFFIX + REACH), -np.arange(1, REACH + 1)])
    places = at[:, None] + steps
    there = (places >= 0) & (places < len(values))
    return np.where(there, values[np.clip(places, 0, max(len(values) - 1, 0))] >> np.uint64(32), np.uint64(0)).astype(np.uint32)


def _suffixes(shared):
    """One row per suffix whose key may be shared."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, starts = words_of(column(batch, "text"))
            values = hashed(words)
            at, of, windows = minimisers(values, starts)
            keys = window_hashes(values, SUFFIX)[at]
            hit = shared.value.has(keys)
            at, of = at[hit], of[hit]
            sides = around(values, at).tobytes()
            width = 8 * REACH
            yield pa.RecordBatch.from_arrays([signed(keys[hit]), pa.array([sides[i:i + width] for i in range(0, len(sides), width)], pa.binary()),
                                              column(batch, "doc_id").take(pa.array(of)), pa.array(at - starts[of]), pa.array(windows[hit])],
                                             ["key", "sides", "doc_id", "place", "windows"])
    return run


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words two rows have in common before the first that differs."""
    return np.logical_and.accumulate(a == b, axis=1).sum(axis=1)


def _between(right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The windows, as bits, that extensions to the right and the left hold."""
    return np.maximum((2 << left) - (1 << (REACH - right)), 0)


def compare(key: np.ndarray, sides: np.ndarray, doc: np.ndarray, place: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted suffixes: the windows that a neighbour has too, the smallest document met, and the windows left for the second round."""
    n = len(key)
    right, left = sides[:, :REACH], sides[:, REACH:]
    new_run = np.concatenate([[True], key[1:] != key[:-1]])
    new_text = np.concatenate([[True], new_run[1:] | (sides[1:] != sides[:-1]).any(axis=1)])
    # rows of equal surroundings come by document, so the first has the smallest
    head = doc[np.maximum.accumulate(np.where(new_text, np.arange(n), 0))]
    settled, before, source = np.zeros(n, np.int64), np.zeros(n, np.int64), doc.copy()
    reach = np.zeros((2, n), np.int64)
    # a stable sort by the left words keeps the order of the right words
    for side, order in enumerate((np.arange(n), np.lexsort((*left.T[::-1], key)))):
        a, b = order[:-1], order[1:]
        equal = key[a] == key[b]
        a, b = a[equal], b[equal]
        r, l = _alike(right[a], right[b]), _alike(left[a], left[b])
        both = np.where((doc[a] != doc[b]) | (place[a] != place[b]), _between(r, l), 0) & windows[a] & windows[b]
        if side == 0:
            before[b] = both
        for one in (a, b):
            settled[one] |= both
            source[one] = np.where(both > 0, np.minimum(source[one], np.minimum(head[a], head[b])), source[one])
            reach[side, one] = np.maximum(reach[side, one], l if side else r)
    # rows whose neighbours lie in another batch: any extension is possible
    reach[0, [0, -1]] = REACH
    run = np.cumsum(new_run) - 1
    cut = (run == run[0]) | (run == run[-1])
    reach[1, cut] = REACH
    several = cut | (np.bincount(run, new_text)[run] > 1)
    return settled, source, np.where(several, windows & ~before & _between(*reach), 0)


def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Found spans (no key), and windows of the second round (with their hash as key)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc, place, windows = (column(batch, c).to_numpy() for c in ("key", "doc_id", "place", "windows"))
        sides = np.frombuffer(b"".join(column(batch, "sides").to_pylist()), np.uint32).reshape(-1, 2 * REACH)
        settled, source, left = compare(key, sides, doc, place, windows)
        hit = np.flatnonzero(settled)
        # the windows around a suffix overlap, so the outermost two span all of them
        bits = (settled[hit, None] >> np.arange(SPREAD)) & 1
        first, last = place[hit] - (REACH - np.argmax(bits[:, ::-1], axis=1)), place[hit] - np.argmax(bits, axis=1) + MIN_WORDS
        yield pa.RecordBatch.from_arrays([pa.nulls(len(hit), pa.int64()), pa.array(doc[hit]), pa.array(first), pa.array(last), pa.array(source[hit])], FOUND)
        row, i = np.nonzero((left[:, None] >> np.arange(SPREAD)) & 1)
        if len(row):
            begin = place[row] - i
            yield pa.RecordBatch.from_arrays([signed(_window_keys(key[row], sides[row], i)), pa.array(doc[row]), pa.array(begin), pa.array(begin + MIN_WORDS), pa.array(doc[row])], FOUND)


FOUND = ["key", "doc_id", "first", "last", "source"]


def _window_keys(key: np.ndarray, sides: np.ndarray, i: np.ndarray) -> np.ndarray:
    """A hash of the window that begins ``i`` words before the suffix: of its key, the words behind it and those before it."""
    out = mixed(key.view(np.uint64) + i.astype(np.uint64) * MULTIPLIER)
    for k in range(REACH):
        out = np.where(k < REACH - i, mixed(out * MULTIPLIER + sides[:, k]), out)
    for k in range(REACH):
        out = np.where(k < i, mixed(out * MULTIPLIER + sides[:, REACH + k]), out)
    return out


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``(doc_id, start, end, n_words, first_doc_id)``: the passages of at least ``MIN_WORDS`` words that also stand elsewhere.

    Start and end (exclusive) count words ``[^\\x20\\x09-\\x0D]+`` of the text; overlapping windows of a document are one passage. Its
    ``first_doc_id`` is the smallest document that a comparison of its windows met, itself included: a window can go where that is a
    smaller one, and one copy of each stays. Rows with a null id, null and short texts give nothing; rows of one id are one document,
    so repeats of a row find nothing new. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    shared = written(docs.mapInArrow(_keys, "key long").groupBy("key").count().where("count > 1").select("key"), "shared-suffixes")
    bits = min(MOST_BITS, 1 << max(16, (BITS_PER_KEY * shared.count() - 1).bit_length()))
    bitmap = spark.sparkContext.broadcast(Bitmap(shared, "key", bits, hashed=True))
    rows = written(docs.mapInArrow(_suffixes(bitmap), "key long, sides binary, doc_id long, place long, windows long"), "suffixes")
    bitmap.unpersist()
    order = ["key", "sides", "doc_id", "place"]
    found = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, ", ".join(f"{c} long" for c in FOUND))
    found = written(found, "neighbours")
    left = found.where("key is not null")
    where = F.struct("doc_id", "first")
    heads = left.groupBy("key").agg(F.min(where).alias("h"), F.max(where).alias("other")).where("h < other").select("key", F.col("h.doc_id").alias("head"))
    again = left.join(heads, "key").select("doc_id", "first", "last", F.col("head").alias("source"))
    # spans that begin within MIN_WORDS words overlap: they are one
    met = found.where("key is null").select("doc_id", "first", "last", "source").union(again).groupBy("doc_id", F.expr(f"first div {MIN_WORDS}").alias("block"))
    spans = written(met.agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("source").alias("source")).drop("block"), "spans")
    order = Window.partitionBy("doc_id").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", (F.col("first") > F.coalesce(reach, F.lit(-1))).cast("int")).withColumn("island", F.sum("new").over(order))
    merged = islands.groupBy("doc_id", "island").agg(F.min("first").alias("start"), F.max("last").alias("end"), F.min("source").alias("first_doc_id"))
    return merged.where(F.col("end") - F.col("start") >= MIN_WORDS).select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("n_words"), "first_doc_id")


def op2_suffix_array_dedup(spark, sf_dir):
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
