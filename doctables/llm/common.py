"""What several operators share: reading, written intermediates, word hashes, bitmaps and components."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from doctables.session import scratch_path

#: Text bytes that one numpy step works on; a longer document is one step of its own.
SLICE_BYTES = 2 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it one that ``df`` has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, and Spark knows its size."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Let a Python worker wait for its next task without the memory of this one."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


#: What operators keep in a Python worker for their next task; others clear it, since workers are used again.
CACHES: list[dict] = []


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, caches: bool = False) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each has about ``limit`` bytes of text; without ``caches``, clear what earlier operators left in the worker."""
    if not caches and any(CACHES):
        for cache in CACHES:
            cache.clear()
        give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // limit
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    give_back()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def words_of(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of all texts in a row, and where each text's words start (one more entry than texts)."""
    texts = pc.fill_null(texts, "")
    # lower case before the cast: Arrow's ascii_lower breaks cast slices
    lists = pc.ascii_split_whitespace((pc.ascii_lower(texts) if lower else texts).cast(pa.large_string()))
    words, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    keep = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    kept = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
    return (words if keep.all() else words.filter(pa.array(keep))), kept[ends]


def hashed(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; equal words are hashed once."""
    coded = words.dictionary_encode()
    of = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    return of[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of ``size`` values from each position on, from prefix sums; also over the edges of texts."""
    n = len(values)
    if n < size:
        return np.zeros(0, np.uint64)
    powers = np.full(n, MULTIPLIER, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers, dtype=np.uint64)])
    back = np.full(n, INVERSE, np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    return mixed((sums[size:] - sums[:-size]) * back[: n - size + 1] + np.uint64(size))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class Bitmap:
    """A bitmap of 64-bit keys with a fixed number of bits: no key is missed, others may pass.

    Built by a pre-aggregated ``bit_or``; at most ``bits / 64`` words reach the driver, however many keys there are.
    ``hashed`` keys are spread already and take their place from their own bits.
    """

    def __init__(self, keys: DataFrame, name: str, bits: int = 1 << 23, hashed: bool = False):
        self.bits, self.hashed = bits, hashed
        rows = (keys.select(self.slots(name).alias("s")).selectExpr("cast(shiftrightunsigned(s, 6) as int) as w", "shiftleft(1L, cast(s & 63 as int)) as b")
                .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
        self.words = np.zeros(bits // 64, np.int64)
        self.words[rows.column("w").to_numpy()] = rows.column("b").to_numpy()

    def slots(self, name: str):
        """The place of a key, as a column expression."""
        return F.expr(f"shiftrightunsigned({name}, 20) & {self.bits - 1}L") if self.hashed else F.pmod(F.xxhash64(name), F.lit(self.bits))

    def hit(self, slots: np.ndarray) -> np.ndarray:
        return (self.words[slots >> 6] >> (slots & 63)) & 1 == 1

    def has(self, keys: np.ndarray) -> np.ndarray:
        """For hashed keys."""
        return self.hit(((keys >> np.uint64(20)) & np.uint64(self.bits - 1)).astype(np.int64))


def components(edges: DataFrame) -> DataFrame:
    """``(v, root)``: the smallest vertex that each vertex of ``edges (a, b)`` reaches.

    Alternating large-star and small-star rounds; each round is written to the shared folder, so a lost executor repeats
    one round at most. All steps are joins and pre-aggregated minima: a vertex with very many links is split by Spark.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = written(small, "small-star")
        before, edges = seen, small
        seen = edges.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == before:
            break
    return edges.select(F.col("u").alias("v"), F.col("v").alias("root")).union(edges.select("v", F.col("v").alias("root")).distinct())
