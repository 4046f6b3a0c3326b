"""Token counts of documents in flat token files that have no index.

A token file is nothing but ids, with an end-of-document id behind each document. It is read in blocks that ignore documents; each
block is searched for the end id in one vectorised step. A prefix scan over the blocks of a file carries the number of ends and the
place of the last one, which gives each document its number and stitches those that go over block boundaries.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from doctables.llm.common import column, slices
from doctables.llm.tokens import END_OF_DOCUMENT, VOCABULARY, encoder
from doctables.session import scratch_path

BLOCK_TOKENS = 1 << 16


def _streamer(vocabulary: str, end: int, block: int, width: str):
    names = ["kind", "file", "start", "tokens", "number", "doc_id"]

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, rest, start, number = encoder(vocabulary, ordinary=True), TaskContext.get().partitionId(), b"", 0, 0
        size, last = block * np.dtype(width).itemsize, np.array([end], width).tobytes()

        def blocks(parts: list[bytes]) -> pa.RecordBatch:
            nonlocal start
            at = [start + k * block for k in range(len(parts))]
            start += sum(map(len, parts)) // np.dtype(width).itemsize
            n = len(parts)
            return pa.RecordBatch.from_arrays([pa.array(["tokens"] * n), pa.array([part] * n, pa.int32()), pa.array(at, pa.int64()), pa.array(parts, pa.binary()),
                                               pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)

        for batch in slices(batches, caches=True):
            ids = column(batch, "doc_id").cast(pa.int64())
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(["documents"] * n), pa.array([part] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
                                              pa.array(range(number, number + n), pa.int64()), ids], names)
            number += n
            encoded = enc.encode(column(batch, "text").to_pylist())
            rest += b"".join([np.frombuffer(e, "<u4").astype(width).tobytes() + last for e in encoded])
            full = len(rest) // size
            if full:
                yield blocks([rest[k * size:(k + 1) * size] for k in range(full)])
                rest = rest[full * size:]
        if rest:
            yield blocks([rest])
    return stream


def write_token_stream(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END_OF_DOCUMENT, block: int = BLOCK_TOKENS, width: str = "<u2") -> None:
    """Write ``docs`` as token blocks below ``path/kind=tokens`` and the order of their ids below ``path/kind=documents``.

    A task's documents are one file of tokens. A null text is an empty document; ``width`` must hold the vocabulary.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _streamer(vocabulary, end, block, width), "kind string, file int, start long, tokens binary, number long, doc_id long")
    rows.write.partitionBy("kind").option("compression", "zstd").parquet(path)


def read_stream_blocks(spark, path: str) -> DataFrame:
    rows = spark.read.schema("file int, start long, tokens binary, kind string").parquet(path)
    return rows.where("kind = 'tokens'").drop("kind")


def read_flat_files(spark, path: str, width: str = "<u2", block: int = BLOCK_TOKENS) -> DataFrame:
    """``(file, start, tokens)`` blocks of raw token files (each below 2 GB, as Spark reads them); a broken last id is an error."""
    size = block * np.dtype(width).itemsize

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(column(batch, "path").to_pylist(), column(batch, "content").to_pylist()):
                if len(data) % np.dtype(width).itemsize:
                    raise ValueError(f"{name}: {len(data)} bytes are no whole number of ids")
                for at in range(0, len(data), size):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at // np.dtype(width).itemsize], pa.int64()), pa.array([data[at:at + size]], pa.binary())],
                                                     ["file", "start", "tokens"])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(cut, "file string, start long, tokens binary")


def _searcher(end: int, width: str):
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for tokens in column(batch, "tokens"):
                ids = np.frombuffer(tokens.as_buffer(), width)
                found.append(np.flatnonzero(ids == end))
                sizes.append(len(ids))
            ends = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32()),
                                            pa.array(np.concatenate([np.zeros(0, np.int64), *found]), pa.int64()))
            yield pa.RecordBatch.from_arrays([column(batch, "file"), column(batch, "start"), pa.array(sizes, pa.int64()), ends], ["file", "start", "n", "ends"])
    return search


def scan_separators(blocks: DataFrame, end: int = END_OF_DOCUMENT, width: str = "<u2") -> DataFrame:
    """``(file, number, n_tokens, complete)``: each document of ``blocks (file, start, tokens)``, the end id not counted.

    Tokens behind the last end of a file are one more document with ``complete`` false. Empty documents count 0; empty blocks
    and empty tables give no rows. The blocks of a file may come in any order, but each once.
    """
    kind = blocks.schema["file"].dataType.simpleString()
    found = blocks.select("file", "start", "tokens").mapInArrow(_searcher(end, width), f"file {kind}, start long, n long, ends array<long>")
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.size("ends") > 0, F.col("start") + F.element_at("ends", -1)))
    scanned = found.select("file", "start", "n", "ends", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("first"),
                           F.coalesce(last.over(before), F.lit(-1)).alias("last_end"),
                           F.lead("start").over(order).isNull().alias("final"))
    ended = scanned.select("file", "start", "first", "last_end", "ends", F.posexplode("ends").alias("k", "e")).select(
        "file", (F.col("first") + F.col("k")).alias("number"),
        F.when(F.col("k") > 0, F.col("e") - F.get("ends", F.col("k") - 1) - 1).otherwise(F.col("start") + F.col("e") - F.col("last_end") - 1).alias("n_tokens"),
        F.lit(True).alias("complete"))
    total = F.col("start") + F.col("n")
    seen = F.greatest("last_end", F.when(F.size("ends") > 0, F.col("start") + F.element_at("ends", -1)))
    open_end = scanned.where("final").select("file", (F.col("first") + F.size("ends")).alias("number"), (total - seen - 1).alias("n_tokens"),
                                             F.lit(False).alias("complete")).where("n_tokens > 0")
    return ended.unionByName(open_end)


def op1_token_counts(spark, sf_dir):
    path = scratch_path(spark, "token-stream")
    write_token_stream(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    names = spark.read.schema("file int, number long, doc_id long, kind string").parquet(path).where("kind = 'documents'").drop("kind")
    counted = scan_separators(read_stream_blocks(spark, path))
    return names.join(counted, ["file", "number"], "left").select("doc_id", "file", "number", "n_tokens", "complete")
