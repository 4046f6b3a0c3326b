"""Benchmark decontamination by edit distance of words.

CGK walks turn an item and each item-sized window of a text into strings of twice the length, about as far as a walk reads words, such
that few edits become few differing places; bit sampling looks windows up by some of those places, in as many tables as find
more than 0.9 of the pairs with all allowed edits and less than 0.01 of unrelated ones; every candidate is verified by exact edit distance. Before a window is embedded, it must hold as many ``GRAM``-word sequences of items of
its length as the edits that are allowed can leave (each changes ``GRAM`` of them), so no match is lost there and most text is
passed over by running sums; what is left is embedded at a stride that is small against the allowed edits. The sums count sequences
of all items of a length, so they do not tell which of two neighbours is an edited item and which another one's copy.

Items of fewer than ``LEAST_WORDS`` words, where an edit makes another item, are looked for as they stand, by a hash of their words. A
character of a script that is written without blanks counts as a word.

Items are sent to the tasks in parts of bounded size, texts never move.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from doctables.llm.common import MULTIPLIER, column, mixed, slices, window_hashes, words_of

#: Edits (word inserted, deleted or replaced) per 100 words of an item, and the fewest words of an item that may have any.
EDIT_PERCENT = 25
LEAST_WORDS = 8
#: Walks; tables per walk and places per key go by the length of the item.
WALKS = 16
GRAM = 3
#: Text of the benchmark that is sent to the tasks at once.
PART_CHARS = 4 << 20
MOST_SLOTS = 1 << 22
#: Keys that are made at once.
KEYS_AT_ONCE = 500_000
BLOCK = 12

_PLAIN = re.compile(r"[\W_]+")
#: Characters of scripts without blanks: Thai, Lao, Myanmar, Khmer, kana, Han.
_BLANKLESS = "\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_PIECES = re.compile(f"[{_BLANKLESS}]|[^{_BLANKLESS}]+")


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words without case and punctuation, and where each text's words start."""
    words, starts = words_of(texts)
    if not len(words):
        return np.zeros(0, np.uint64), starts
    coded = words.dictionary_encode()
    forms = [_PLAIN.sub("", w.lower()) for w in coded.dictionary.to_pylist()]
    pieces = [([f] if f else []) if f.isascii() else _PIECES.findall(f) for f in forms]
    counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
    of = np.fromiter((xxhash.xxh3_64_intdigest(p) for own in pieces for p in own), np.uint64, int(counts.sum()))
    at = coded.indices.to_numpy(zero_copy_only=False)
    kept = np.concatenate([[0], np.cumsum(counts[at])])
    within = np.arange(kept[-1]) - np.repeat(kept[:-1], counts[at])
    return of[np.repeat((np.cumsum(counts) - counts)[at], counts[at]) + within], kept[starts]


def allowed(words: int) -> int:
    return words * EDIT_PERCENT // 100 if words >= LEAST_WORDS else 0


def gram_of(words: int) -> int:
    """The length of the word sequences that an item is known by: ``GRAM``, or the longest that the allowed edits leave one of."""
    return next(g for g in range(GRAM, 0, -1) if words - g + 1 - g * allowed(words) >= 1)


def needed(words: int) -> int:
    """Word sequences of an item that a window with the allowed edits still holds."""
    gram = gram_of(words)
    return words - gram + 1 - gram * allowed(words)


def stride(words: int) -> int:
    """How far apart windows are embedded: small against the allowed edits, so that one lies close to each match."""
    return max(1, allowed(words) // 4)


def steps(words: int) -> int:
    """Steps of a walk over so many words: each reads on with one chance in two, so later ones would read padding."""
    return 2 * words


def sampled(words: int) -> int:
    """Places per key. With all allowed edits, half of the places of two walks agree at 8 words and a third at 59, and a walk over few
    words reads some of them several times, so short items take more places (tests measure recall and selectivity per length)."""
    return 6 if words < 10 else 5 if words < 14 else 4


def tables(words: int) -> int:
    """Tables per walk. Walks that lost each other meet again ever more rarely, so long items take more."""
    return max(8, -(-words // 5))


@lru_cache(maxsize=4096)
def places(words: int) -> np.ndarray:
    """The sampled places (walks x tables x places), different ones in each key."""
    rng = np.random.default_rng((11, words))
    return np.stack([rng.choice(steps(words), sampled(words), replace=False) for _ in range(WALKS * tables(words))]).reshape(WALKS, tables(words), -1)


def keys_of(windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The keys (windows x tables) of padded windows: CGK walks, then sampled places. 0 stands for no key: one of padding alone, or a table that only longer windows have."""
    n, width = windows.shape
    most = tables(int(lengths.max()))
    rows, out = np.arange(n), np.zeros((n, WALKS, most), np.uint64)
    padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], axis=1)
    groups = [(int(k), np.flatnonzero(lengths == k)) for k in np.unique(lengths)]
    for walk in range(WALKS):
        at, seen = np.zeros(n, np.int64), np.zeros((n, steps(width)), np.uint64)
        salts = mixed(np.arange(steps(width), dtype=np.uint64) + np.uint64(1000 * (walk + 1)))
        for j in range(steps(width)):
            symbol = padded[rows, np.minimum(at, width)]
            seen[:, j] = symbol
            at = np.where(at < lengths, at + (mixed(symbol ^ salts[j]) & np.uint64(1)).astype(np.int64), at)
        for words, own in groups:
            drawn = places(words)[walk]
            number = np.uint64(walk * len(drawn)) + np.arange(len(drawn), dtype=np.uint64)
            key, some = np.tile(number * MULTIPLIER + np.uint64(words), (len(own), 1)), np.zeros((len(own), len(drawn)), bool)
            for k in range(drawn.shape[1]):
                read = seen[own[:, None], drawn[:, k]]
                key, some = mixed(key * MULTIPLIER + read), some | (read != 0)
            out[own, walk, :len(drawn)] = np.where(some, key, np.uint64(0))
    return out.reshape(n, WALKS * most)


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The smallest edit distance of ``item`` to a stretch of ``text``, and where the first such stretch ends."""
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, symbol in enumerate(item, 1):
        new = np.concatenate([[i], np.minimum(row[:-1] + (text != symbol), row[1:] + 1)])
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


@dataclass
class Sequences:
    """The word sequences of all items that are known by sequences of one length."""
    gram: int
    marks: np.ndarray  # per slot of a hashed word sequence: a bit for each length (modulo 64) of the items that hold it
    lengths: np.ndarray  # the different lengths
    needed: np.ndarray  # per length
    block_need: int


@dataclass
class Items:
    """A part of the benchmark, prepared for lookup."""
    ids: list
    words: list[np.ndarray]
    sequences: list[Sequences]
    keys: np.ndarray  # sorted
    owner: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # per number of words: sorted hashes of the items below LEAST_WORDS, and their places


def _slots(values: np.ndarray, slots: int, gram: int) -> np.ndarray:
    return (window_hashes(values, gram) >> np.uint64(20)).astype(np.int64) & (slots - 1)


def _sequences(words: list[np.ndarray], gram: int) -> Sequences:
    lengths = np.array([len(w) for w in words])
    slots = min(MOST_SLOTS, 1 << int(64 * lengths.sum() - 1).bit_length())
    marks = np.zeros(slots, np.uint64)
    for w in words:
        marks[_slots(w, slots, gram)] |= np.uint64(1) << np.uint64(len(w) % 64)
    block_need = min(-(-needed(n) // -(-(n - gram + 1) // BLOCK)) for n in set(lengths.tolist()))
    return Sequences(gram, marks, np.unique(lengths), np.array([needed(n) for n in np.unique(lengths).tolist()]), max(1, block_need))


def prepare(ids: list, texts: list[str]) -> Items | None:
    values, starts = plain_words(pa.array(texts, pa.string()))
    own = [(i, values[a:b]) for i, a, b in zip(ids, starts[:-1], starts[1:]) if b > a]
    if not own:
        return None
    words = [w for _, w in own]
    lengths = np.array([len(w) for w in words])
    long, short = np.flatnonzero(lengths >= LEAST_WORDS), {}
    for n in np.unique(lengths[lengths < LEAST_WORDS]).tolist():
        at = np.flatnonzero(lengths == n)
        hashes = np.concatenate([window_hashes(words[k], n) for k in at])
        order = np.argsort(hashes, kind="stable")
        short[n] = hashes[order], at[order]
    keys, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    size = max(1, KEYS_AT_ONCE // (WALKS * tables(int(lengths.max()))))
    for at in range(0, len(long), size):
        some = long[at:at + size]
        table = np.zeros((len(some), int(lengths[some].max())), np.uint64)
        for k, i in enumerate(some):
            table[k, :lengths[i]] = words[i]
        found = keys_of(table, lengths[some])
        keys.append(found[found != 0])
        owner.append(np.repeat(some, (found != 0).sum(axis=1)))
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    order = np.argsort(keys, kind="stable")
    grams: dict[int, list] = {}
    for i in long:
        grams.setdefault(gram_of(int(lengths[i])), []).append(words[i])
    return Items([i for i, _ in own], words, [_sequences(w, g) for g, w in grams.items()], keys[order], owner[order], short)


def _windows(marks: np.ndarray, known: Sequences) -> list[tuple[int, int]]:
    """``(start, length)`` of windows of one text that hold enough of the items' word sequences: of each run of such windows the first and every few from there on."""
    out, found = [], marks[marks != 0]
    total = ((found[:, None] >> (known.lengths % 64).astype(np.uint64)) & np.uint64(1)).sum(axis=0)
    for n in known.lengths[total >= known.needed].tolist():
        sums = np.concatenate([[0], np.cumsum((marks >> np.uint64(n % 64)) & np.uint64(1), dtype=np.int64)])
        width = n - known.gram + 1
        held = sums[width:] - sums[:-width] if width <= len(marks) else sums[-1:]  # a text somewhat shorter is a window itself
        enough = held >= needed(n)
        first = np.maximum.accumulate(np.where(enough & ~np.concatenate([[False], enough[:-1]]), np.arange(len(held)), 0))
        out += [(s, n) for s in np.flatnonzero(enough & ((np.arange(len(held)) - first) % stride(n) == 0)).tolist()]
    return out


def _promising(values: np.ndarray, starts: np.ndarray, known: Sequences) -> list[tuple[int, int, int]]:
    """``(text, start, length)`` of the windows of all texts that are to be embedded."""
    gram = known.gram
    if len(values) < gram:
        return []
    marks = known.marks[_slots(values, len(known.marks), gram)]
    for back in range(1, gram):  # sequences over the edge of two texts
        edge = starts[1:-1] - back
        marks[edge[(edge >= 0) & (edge < len(marks))]] = 0
    sums = np.concatenate([[0], np.cumsum(marks != 0)])
    ahead = np.minimum(np.arange(len(marks)) + BLOCK, len(marks))
    dense = np.flatnonzero(sums[ahead] - sums[:-1] >= known.block_need)
    near = np.unique(np.searchsorted(starts, dense, side="right") - 1)
    return [(t, s, n) for t in near.tolist() for s, n in _windows(marks[starts[t]:max(starts[t], starts[t + 1] - gram + 1)], known)]


def _short_items(values: np.ndarray, starts: np.ndarray, items: Items) -> Iterator[tuple[int, int, int, int, int]]:
    """The first place of each short item in each text that holds it as it stands."""
    for n, (hashes, places) in items.short.items():
        windows = window_hashes(values, n)
        at = np.flatnonzero(np.isin(windows, hashes))
        text = np.searchsorted(starts, at, side="right") - 1
        inside = at + n <= starts[text + 1]
        at, text = at[inside], text[inside]
        # the first place of each item in each text
        _, first = np.unique(np.stack([text.astype(np.uint64), windows[at]]), axis=1, return_index=True)
        for t, s in zip(text[first].tolist(), at[first].tolist()):
            low, high = np.searchsorted(hashes, windows[s], "left"), np.searchsorted(hashes, windows[s], "right")
            for i in places[low:high].tolist():
                yield t, i, 0, s - int(starts[t]), s - int(starts[t]) + n


def find_items(texts: pa.Array, items: Items) -> list[tuple[int, int, int, int, int]]:
    """``(text, item, distance, start, end)`` of the best match of each item in each text, within the allowed edits."""
    values, starts = plain_words(texts)
    if not len(values):
        return []
    found = [w for known in items.sequences for w in _promising(values, starts, known)]
    candidates: dict[tuple[int, int], list[int]] = {}
    size = max(1, KEYS_AT_ONCE // (WALKS * tables(max((n for _, _, n in found), default=1))))
    for at in range(0, len(found), size):
        some = found[at:at + size]
        lengths = np.array([n for _, _, n in some])
        table = np.zeros((len(some), int(lengths.max())), np.uint64)
        for k, (t, s, n) in enumerate(some):
            own = values[starts[t] + s:min(starts[t] + s + n, starts[t + 1])]
            table[k, :len(own)] = own
        keys = keys_of(table, lengths)
        low, high = np.searchsorted(items.keys, keys, "left"), np.searchsorted(items.keys, keys, "right")
        for k, c in zip(*np.nonzero(high > low)):
            t, s, n = some[k]
            for i in set(items.owner[low[k, c]:high[k, c]].tolist()):
                candidates.setdefault((t, i), []).append(s)
    out = list(_short_items(values, starts, items))
    for (t, i), at in candidates.items():
        item, text = items.words[i], values[starts[t]:starts[t + 1]]
        most, best = allowed(len(item)), None
        at = sorted(set(at))
        groups = np.split(np.array(at), np.flatnonzero(np.diff(at) > len(item)) + 1)  # windows that overlap are looked at together
        for g in groups:
            a, b = max(0, int(g[0]) - most), min(len(text), int(g[-1]) + len(item) + most)
            distance, end = best_match(item, text[a:b])
            if distance <= most and (best is None or distance < best[0]):
                _, back = best_match(item[::-1], text[a:a + end][::-1])
                best = (distance, a + end - back, a + end)
        if best:
            out.append((t, i, *best))
    return out


def item_parts(benchmark: DataFrame, chars: int = PART_CHARS) -> Iterator[Items]:
    """The benchmark in parts of about ``chars`` characters, each small enough for the driver and the tasks."""
    benchmark = benchmark.where("text is not null and item_id is not null").select("item_id", "text")
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // chars))
    for part in range(parts):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        items = prepare([r.item_id for r in rows], [r.text for r in rows])
        if items:
            yield items


def contaminated(docs: DataFrame, benchmark: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """``(doc_id, item_id, distance, start, end, item_words)``: each item that a document holds, at its best place, in plain words.

    Distances count words without case and punctuation; at most ``EDIT_PERCENT`` edits per 100 words of the item, none in items of fewer
    than ``LEAST_WORDS`` words. Items without words, null ids of items and null texts are left out. Repeated rows of documents give repeated rows, repeated
    items one row each; other columns are ignored; without items or documents there are no rows.
    """
    spark, out = docs.sparkSession, None
    schema = "doc_id long, item_id long, distance int, start long, end long, item_words int"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for items in item_parts(benchmark, part_chars):
        sent = spark.sparkContext.broadcast(items)

        def search(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                ids, own = column(batch, "doc_id").to_pylist(), sent.value
                rows = [(ids[t], own.ids[i], d, a, b, len(own.words[i])) for t, i, d, a, b in find_items(column(batch, "text"), own)]
                if rows:
                    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), types)], ["doc_id", "item_id", "distance", "start", "end", "item_words"])
        found = docs.mapInArrow(search, schema)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item. Repeated rows share a fate, rows without text stay, null ids are ids as any other; other columns
    are carried along, whatever their names. Without items all rows stay; without documents there are none."""
    for items in item_parts(benchmark, part_chars):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def clean(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                bad = {t for t, *_ in find_items(column(batch, "text"), sent.value)}
                yield batch.filter(pa.array([t not in bad for t in range(batch.num_rows)]))
        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op3_decontaminate(spark, sf_dir):
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
