"""N-gram Jaccard join with prefix trees, exact at every size.

A text is the set of its distinct word n-grams. Texts with equal sets are one class, known by a fingerprint, before anything is
joined. All sets are written in one global order, rare n-grams first, so that two sets of the wanted similarity must share one of
their first ones: the root edges of a trie, whose subtrees are spread over the tasks by that n-gram.

1. In each subtree every set meets the first one of it, the one with the fewest n-grams of its own, and is paired with the one that
   it meets most often: one pair a set, which is
   checked exactly. Copies with small changes become one component here, however many they are.
2. Then each subtree that still holds several components gives the pairs of sets from different ones. Those that share as many of
   their first n-grams as the overlap takes are checked too, and no link between components is missed.

Pairs are checked in tries: the partners of one set are stored in a radix tree of their ordered n-grams, and the set walks it with
shared partial overlaps, leaving a subtree as soon as the lengths that remain cannot reach the overlap.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from doctables.llm.common import Bitmap, column, components, hashed, signed, slices, window_hashes, words_of, written

NGRAM = 5
PERCENT = 75
#: N-grams that many of the sets with the smallest fingerprints (one in SAMPLE) share are ordered last. This changes the order only.
SAMPLE, FREQUENT_SETS, FREQUENT_MOST = 64, 4, 1 << 16
#: Partners of one set that are checked in one trie; a set with more is sent to several.
TRIE_SETS = 256


def ngram_sets(texts: pa.Array, n: int = NGRAM) -> list[np.ndarray]:
    """Each text's distinct n-grams as sorted hashes; with fewer words the whole sequence is one; without words none."""
    words, starts = words_of(texts, lower=True)
    values = hashed(words)
    windows = window_hashes(values, n)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(windows[a:b - n + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(values[a:b].tobytes(), seed=1 + b - a)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(ngrams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(ngrams.tobytes()) >> 1 if len(ngrams) else -1


def least_overlap(size: int, other: int, percent: int) -> int:
    """The smallest overlap at which two sets of these sizes are linked."""
    return -(-percent * (size + other) // (100 + percent))


class Order:
    """The global order of n-grams: those not known as frequent by hash, then the frequent ones, the rarest first."""

    def __init__(self, frequent: dict[int, int]):
        keys = np.array(sorted(frequent), np.int64).view(np.uint64)
        at = np.argsort(keys)
        self.keys = keys[at]
        self.counts = np.array([frequent[k] for k in sorted(frequent)], np.int64)[at]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def sort(self, ngrams: np.ndarray) -> np.ndarray:
        return self.place(ngrams)[0]

    def place(self, ngrams: np.ndarray) -> tuple[np.ndarray, int]:
        """The n-grams in order, and how many of them are not frequent."""
        maybe = self.seen[(ngrams >> np.uint64(44)).astype(np.int64)]
        if not maybe.any() or not len(self.keys):
            return ngrams, len(ngrams)
        at = np.minimum(np.searchsorted(self.keys, ngrams[maybe]), len(self.keys) - 1)
        rank = np.zeros(len(ngrams), np.int64)
        rank[maybe] = np.where(self.keys[at] == ngrams[maybe], self.counts[at], 0)
        return ngrams[np.argsort(rank, kind="stable")], int((rank == 0).sum())


@dataclass(slots=True)
class Node:
    run: np.ndarray  # the n-grams from the parent to here
    sets: list[int]  # numbers of the sets that end here
    low: int  # sizes of the sets in the subtree
    high: int
    children: list[Node]


def build_trie(rows: list[tuple[np.ndarray, int]]) -> Node:
    """A radix tree over ordered n-gram sets with their numbers; each node keeps the sizes that its subtree holds."""
    def node_of(own: list[tuple[np.ndarray, int]], depth: int) -> tuple[Node, list, int]:
        first, shared = own[0][0], min(len(s) for s, _ in own)
        for s, _ in own[1:]:
            differ = np.flatnonzero(s[depth:shared] != first[depth:shared])
            shared = depth + int(differ[0]) if len(differ) else shared
        groups: dict[int, list] = {}
        for s, k in own:
            if len(s) > shared:
                groups.setdefault(int(s[shared]), []).append((s, k))
        lengths = [len(s) for s, _ in own]
        return Node(first[depth:shared], [k for s, k in own if len(s) == shared], min(lengths), max(lengths), []), list(groups.values()), shared

    root, *rest = node_of(rows, 0)
    open_ = [(root, *rest)]
    while open_:  # no recursion: a trie may be as deep as a text is long
        node, groups, depth = open_.pop()
        below = [node_of(g, depth) for g in groups]
        node.children += [child for child, _, _ in below]
        open_ += below
    return root


def trie_links(root: Node, probe: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """``(number, overlap)`` of the sets in the trie that are linked with ``probe`` (sorted by hash)."""
    size, stack = len(probe), [(root, 0, 0)]
    while stack:
        node, depth, overlap = stack.pop()
        if len(node.run):
            at = np.minimum(np.searchsorted(probe, node.run), size - 1)
            overlap += int((probe[at] == node.run).sum())
            depth += len(node.run)
        best = min(node.high - depth, size - overlap)
        if overlap + best < least_overlap(size, node.low, percent):
            continue
        for k in node.sets:
            if overlap >= least_overlap(size, depth, percent):
                yield k, overlap
        stack += [(child, depth, overlap) for child in node.children]


def _summaries(n: int, sample: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = ngram_sets(column(batch, "text"), n)
            sid = [fingerprint(s) for s in sets]
            some = [s.view(np.int64) if k >= 0 and k % sample == 0 else None for s, k in zip(sets, sid)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(sid, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(some, pa.list_(pa.int64()))],
                                             ["doc_id", "sid", "n", "sampled"])
    return run


def _prefixes(n: int, percent: int, order):
    """Rows ``(ngram, sid, n, own)`` of each distinct set's prefix; sets that a task sees twice give them once."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            parts, sids, sizes, rare = [], [], [], []
            for s in ngram_sets(column(batch, "text"), n):
                sid = fingerprint(s)
                if sid >= 0 and sid not in seen:
                    if len(seen) < 1 << 18:
                        seen.add(sid)
                    ordered, own = order.value.place(s)
                    parts.append(ordered[: len(s) - -(-percent * len(s) // 100) + 1])
                    sids.append(sid)
                    sizes.append(len(s))
                    rare.append(own)
            if parts:
                lengths = np.array([len(p) for p in parts])
                yield pa.RecordBatch.from_arrays([signed(np.concatenate(parts)), pa.array(np.repeat(sids, lengths)), pa.array(np.repeat(sizes, lengths).astype(np.int32)),
                                                  pa.array(np.repeat(rare, lengths).astype(np.int32))], ["ngram", "sid", "n", "own"])
    return run


def _verifier(n: int, percent: int, order):
    """Groups of rows ``(a, chunk, own, sid, text)`` in order: the set ``a`` itself first, then its partners."""
    def linked(a: int, own: np.ndarray, sids: list[int], partners: list[np.ndarray]) -> list[tuple[int, int]]:
        # frequent n-grams first in the trie: similar texts share long runs from the root
        trie = build_trie([(order.value.sort(s)[::-1], k) for k, s in enumerate(partners)])
        return [(a, sids[k]) for k, _ in trie_links(trie, own, percent)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, sids, partners = None, None, [], []
        for batch in slices(batches):
            found: list[tuple[int, int]] = []
            columns = [column(batch, c).to_pylist() for c in ("a", "chunk", "own", "sid")]
            for a, chunk, first, sid, ngrams in zip(*columns, ngram_sets(column(batch, "text"), n)):
                if key != (a, chunk):
                    if own is not None and partners:
                        found += linked(key[0], own, sids, partners)
                    key, own, sids, partners = (a, chunk), None, [], []
                if first:
                    own = ngrams
                else:
                    sids.append(sid)
                    partners.append(ngrams)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])
        if own is not None and partners and (found := linked(key[0], own, sids, partners)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])
    return run


def verified(pairs: DataFrame, docs: DataFrame, places: DataFrame, n: int, percent: int, order) -> DataFrame:
    """The pairs ``(a, b)`` of set ids that are linked. ``places (sid, doc_id)`` names one document per set."""
    spark = docs.sparkSession
    pairs = written(pairs, "pairs")
    partners = pairs.groupBy("a").agg(F.ceil(F.count("*") / TRIE_SETS).alias("tries"))
    chunked = pairs.join(partners, "a").select("a", F.pmod(F.xxhash64("b"), F.col("tries")).alias("chunk"), "b")
    wanted = chunked.select("a", "chunk", F.lit(False).alias("own"), F.col("b").alias("sid")).union(
        chunked.select("a", "chunk", F.lit(True).alias("own"), F.col("a").alias("sid")).distinct())
    wanted = written(wanted, "wanted")
    needed = written(wanted.select("sid").distinct().join(places, "sid"), "needed")
    bitmap = spark.sparkContext.broadcast(Bitmap(needed, "doc_id"))

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = (b.filter(pa.array(bitmap.value.hit(column(b, "slot").to_numpy(zero_copy_only=False)))) for b in batches)
        for batch in slices(some):
            sids = [fingerprint(s) for s in ngram_sets(column(batch, "text"), n)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "text"), pa.array(sids, pa.int64())], ["doc_id", "text", "sid"])
    # the id and the set: rows of an id that was given to several texts do not mix
    texts = docs.withColumn("slot", bitmap.value.slots("doc_id")).mapInArrow(pick, "doc_id long, text string, sid long")
    texts = texts.join(needed, ["sid", "doc_id"]).groupBy("sid").agg(F.first("text").alias("text"))
    rows = wanted.join(texts, "sid").select("a", "chunk", "own", "sid", "text")
    return rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.desc("own"), "sid").mapInArrow(_verifier(n, percent, order), "a long, b long")


def link_documents(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: doc_id, n_shingles, component_id, ``sid``, the id of its n-gram set, and ``root``,
    the set that stands for its component (two components of one component_id differ in it; -1 without words).

    Texts are linked if ``100 * intersection >= percent * union`` of their sets; component_id is the smallest doc_id that links
    reach. Null and empty texts, and those without words, are linked with nothing. Rows with a null id take no part and have a null
    component. Repeated rows each get a row; other columns are ignored; an empty table gives no rows. Sets are told apart by
    64-bit hashes of their words.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(docs.mapInArrow(_summaries(n, SAMPLE), "doc_id long, sid long, n long, sampled array<long>"), "sets")
    sampled = rows.where("sampled is not null").dropDuplicates(["sid"]).select(F.explode("sampled").alias("g"))
    counts = sampled.groupBy("g").count().where(F.col("count") >= FREQUENT_SETS).orderBy(F.desc("count"), "g").limit(FREQUENT_MOST).collect()
    order = spark.sparkContext.broadcast(Order({r.g: r["count"] for r in counts}))
    places = rows.where("sid >= 0 and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))

    docs = docs.where("doc_id is not null")
    prefix = docs.mapInArrow(_prefixes(n, percent, order), "ngram long, sid long, n int, own int").withColumn("n", F.col("n").cast("long"))
    tree = Window.partitionBy("ngram")
    several = lambda df, of: df.withColumn("lowest", F.min(of).over(tree)).withColumn("highest", F.max(of).over(tree)).where("lowest < highest").drop("lowest", "highest")
    subtrees = written(several(prefix.withColumn("first", F.min(F.struct("own", "n", "sid")).over(tree)), "sid").drop("own"), "subtrees")
    fits = lambda a, b: (100 * F.least(a, b) >= percent * F.greatest(a, b))
    # shared n-grams that two prefixes need: what is not in both lies behind the shorter-reaching one
    rest = F.ceil(percent * F.greatest("n", "n_b") / 100) - 1
    need = F.greatest(F.ceil(percent * (F.col("n") + F.col("n_b")) / (100 + percent)) - rest, F.lit(1))
    # the first set that a set shares most with; which ones are tried here changes no result, only how much is left for step 2
    met = (subtrees.where((F.col("sid") != F.col("first.sid")) & fits(F.col("n"), F.col("first.n")))
           .groupBy(F.col("first.sid").alias("a"), F.col("first.n").alias("n_b"), F.col("sid").alias("b"), "n").agg(F.count("*").alias("shared")))
    stars = met.where(4 * F.col("shared") >= need).groupBy("b").agg(F.max(F.struct("shared", "a")).alias("most")).select("most.a", "b")
    links = written(verified(stars, docs, places, n, percent, order), "links")
    roots = written(components(links), "roots")

    labelled = subtrees.drop("first").join(roots.withColumnRenamed("v", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    mixed_trees = written(several(labelled, "root").distinct(), "mixed")
    other = mixed_trees.select("ngram", *(F.col(c).alias(f"{c}_b") for c in ("sid", "n", "root")))
    crossing = (mixed_trees.join(other, "ngram").where((F.col("root") < F.col("root_b")) & fits(F.col("n"), F.col("n_b")))
                .groupBy(F.col("sid").alias("a"), F.col("sid_b").alias("b"), "n", "n_b").agg(F.count("*").alias("shared"))
                .where(F.col("shared") >= need).select("a", "b"))
    more = written(verified(crossing, docs, places, n, percent, order), "more-links")
    all_roots = written(components(links.union(more)), "all-roots")

    known = rows.select("doc_id", "sid", "n").join(all_roots.withColumnRenamed("v", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = written(known.where("sid >= 0 and doc_id is not null").groupBy("root").agg(F.min("doc_id").alias("component")), "least")
    return known.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"),
                                                    F.when(F.col("doc_id").isNull() | (F.col("sid") < 0), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), "sid", "root")


def set_ids(docs: DataFrame, name: str, n: int = NGRAM) -> DataFrame:
    """``docs`` and a column ``name``: the id of each text's n-gram set, -1 without words."""
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sids = [fingerprint(s) for s in ngram_sets(column(batch, "text"), n)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sids, pa.int64())], [*batch.schema.names, name])
    return docs.mapInArrow(add, docs.withColumn(name, F.lit(0).cast("long")).schema)


def op6_ngram_join(spark, sf_dir):
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
