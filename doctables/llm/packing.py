"""Best-fit packing of documents into sequences of at most ``capacity`` tokens.

Bulk-synchronous best fit by size class. Documents of one length are ranked over all partitions, gaps of one size are intervals of
sequence numbers. A superstep takes the next smaller length: its documents sweep to the smallest gap that holds them, the
document of rank r takes the r-th place, gaps become smaller, and the next step follows. Which documents a step moves is
stated by rank intervals, so the sweep itself works on at most ``capacity`` lengths and on intervals (a sequence holds documents
of at most sqrt(2 * capacity) different lengths, which bounds the moves to some 180,000 for 1024 tokens, whatever the input);
ranks, and the join that gives each document its place, are distributed. The result is that of best fit decreasing.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from doctables.llm.common import column, slices, written
from doctables.llm.tokens import VOCABULARY, encoder

CAPACITY = 1024
DOCUMENT_END = 2

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: all full but the first."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _cutter(vocabulary: str, capacity: int, end: int):
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(vocabulary), TaskContext.get().partitionId(), defaultdict(int)
        last = np.array([end], "<u4").tobytes()
        for batch in slices(batches, caches=True):
            out: list[list] = [[] for _ in range(6)]
            for doc, ids in zip(column(batch, "doc_id").to_pylist(), enc.encode(column(batch, "text").to_pylist())):
                ids += last
                for k, (s, n) in enumerate(cut_points(len(ids) // 4, capacity)):
                    for values, v in zip(out, (doc, k, s, n, zlib.crc32(ids[4 * s:4 * (s + n)]), seen[n])):
                        values.append(v)
                    seen[n] += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(v, t) for v, t in zip(out, types)]
            yield pa.RecordBatch.from_arrays([*arrays[:5], pa.array([part] * len(out[0]), pa.int32()), arrays[5]],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])
    return cut


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = DOCUMENT_END) -> DataFrame:
    """One row per piece, with its number ``nth`` among those of its length in partition ``part``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cutter(vocabulary, capacity, end), PIECES)


def best_fit_moves(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over size classes: ``(length, first_rank, last_rank, sequence, sequences, offset)``.

    Document r of a move goes to sequence ``sequence + (r - first_rank) % sequences``, at ``offset`` plus ``length`` for each
    document of the move that is there before it.
    """
    gaps: dict[int, deque] = defaultdict(deque)  # gap -> intervals (first sequence, number)
    moves, opened = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]

        def place(first: int, sequences: int, each: int, gap: int) -> None:
            nonlocal rank, left
            if sequences * each:
                moves.append((length, rank, rank + sequences * each - 1, first, sequences, capacity - gap))
                rank, left = rank + sequences * each, left - sequences * each
                if gap - each * length:
                    gaps[gap - each * length].append((first, sequences))

        for gap in [g for g in sorted(gaps) if g >= length]:
            each = gap // length  # a gap takes as many as fit before a larger one is opened
            while left and gaps[gap]:
                first, number = gaps[gap].popleft()
                full = min(number, left // each)
                rest = left - full * each if full < number else 0
                place(first, full, each, gap)
                if rest:
                    place(first + full, 1, rest, gap)
                    full += 1
                if full < number:
                    gaps[gap].appendleft((first + full, number - full))
            if not gaps[gap]:
                del gaps[gap]
        if left:
            each = capacity // length
            full, rest = divmod(left, each)
            place(opened, full, each, capacity)
            if rest:
                place(opened + full, 1, rest, capacity)
            opened += full + bool(rest)
    return moves


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a stored table with ``part``, ``length`` and ``nth``) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    groups = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = written(groups.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")), "ranks")
    counts = {r.length: r.n for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    moves = spark.createDataFrame([(int(n), *m) for n, *m in best_fit_moves(counts, capacity)],
                                  "length long, _first long, _last long, _sequence long, _sequences long, _offset long")
    ranked = pieces.join(groups.select("part", "length", "_before"), ["part", "length"]).withColumn("_rank", F.col("_before") + F.col("nth"))
    placed = ranked.join(F.broadcast(moves), ["length"]).where(F.col("_rank").between(F.col("_first"), F.col("_last")))
    at = F.col("_rank") - F.col("_first")
    return placed.select(*(c for c in pieces.columns if c not in ("part", "nth")), (F.col("_sequence") + at % F.col("_sequences")).alias("sequence_id"),
                         (F.col("_offset") + F.col("length") * F.floor(at / F.col("_sequences"))).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = DOCUMENT_END) -> DataFrame:
    """Tokenise ``docs (doc_id, text)`` and place every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone. Repeated rows and null ids are packed like others; other columns are ignored. An
    empty table gives no rows. The pieces are stored in the shared folder, so ranks stay the same when a task is repeated.
    """
    return pack_pieces(written(token_pieces(docs, capacity, vocabulary, end), "pieces"), capacity)


def op9_best_fit_packing(spark, sf_dir):
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
