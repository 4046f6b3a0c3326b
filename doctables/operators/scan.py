"""Ordered scans that survive a very long document.

A window over one whole document puts all its rows into one task. Here every document is cut into
blocks of consecutive pages, each block is scanned on its own, and only one small row per block takes
part in the scan over the document. The result is the same as that of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doctables.session import shared_dir

PAGES_PER_BLOCK = 256


def page_block(page: Column, size: int = PAGES_PER_BLOCK) -> Column:
    """Block number of a page; grows with the page."""
    return F.floor(page / F.lit(size)).cast("bigint")


def where_once(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on computed columns without computing them a second time inside the filter.

    The optimizer moves a filter below the projection it depends on and repeats the expressions there.
    A non-deterministic column in the projection stops that; the partition id costs nothing.
    """
    return df.withColumn("_part", F.spark_partition_id()).where(condition & (F.col("_part") >= 0)).drop("_part")


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str,
                  block: Column, inclusive: bool = True) -> DataFrame:
    """Add ``out``: the last non-null ``value`` up to (or strictly before) each row.

    ``block`` must grow with ``order``; ``order`` must be a total order within ``keys``.
    """
    df = df.withColumn("_blk", block).withColumn("_val", value)
    local = Window.partitionBy(*keys, "_blk").orderBy(*order)
    frame = local.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    # one row per block, reduced before the shuffle; a block takes the value of the nearest earlier
    # block that has one
    blocks = df.groupBy(*keys, "_blk").agg(F.max(F.when(
        F.col("_val").isNotNull(), F.struct(*order, "_val")))["_val"].alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*keys, "_blk", F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    scanned = df.withColumn("_local", F.last("_val", ignorenulls=True).over(frame))
    return (
        scanned.join(carried.where(F.col("_carry").isNotNull()), [*keys, "_blk"], "left")
        .withColumn(out, F.coalesce("_local", "_carry"))
        .drop("_blk", "_val", "_local", "_carry")
    )


def range_blocks(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Cut a table into balanced, ordered blocks (column ``_blk``) for a scan over all its rows.

    Range partitioning balances repeated leading values through the later order columns. The block
    assignment is written to the checkpoint folder, so every later pass sees the same one.
    """
    shared_dir(df.sparkSession)
    return df.repartitionByRange(*order).withColumn("_blk", F.spark_partition_id()).checkpoint()


def number_rows(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Consecutive numbers from 1 over the whole table without a single-task window."""
    blocked = range_blocks(df, order)
    sizes = blocked.groupBy("_blk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_blk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_blk").orderBy(*order)
    return (
        blocked.join(offsets, "_blk")
        .withColumn(out, F.row_number().over(inside) + F.col("_off"))
        .drop("_blk", "_off")
    )


def floored_running_sums(df: DataFrame, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Running sums over the whole table that never fall below zero.

    A sum floored at zero after every step equals the plain running sum minus its lowest value so far
    (or zero), which splits into per-block sums and minima.
    """
    blocked = range_blocks(df, order)
    inside = Window.partitionBy("_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked
    for c in columns:
        local = local.withColumn(f"_s_{c}", F.sum(c).over(inside))
    for c in columns:
        local = local.withColumn(f"_m_{c}", F.min(f"_s_{c}").over(inside))
    ends = local.groupBy("_blk").agg(
        *[F.max_by(f"_s_{c}", F.struct(*order)).alias(f"_t_{c}") for c in columns],
        *[F.min(f"_s_{c}").alias(f"_l_{c}") for c in columns])
    before = Window.partitionBy(F.lit(0)).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    for c in columns:
        ends = ends.withColumn(f"_o_{c}", F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)))
    for c in columns:
        ends = ends.withColumn(f"_p_{c}", F.coalesce(
            F.min(F.col(f"_o_{c}") + F.col(f"_l_{c}")).over(before), F.lit(0)))
    heads = ends.select("_blk", *[f"_{k}_{c}" for c in columns for k in "op"])
    out = local.join(heads, "_blk")
    for c in columns:
        total = F.col(f"_s_{c}") + F.col(f"_o_{c}")
        lowest = F.least(F.lit(0), F.col(f"_p_{c}"), F.col(f"_m_{c}") + F.col(f"_o_{c}"))
        out = out.withColumn(f"total_{c}", total - lowest)
    return out.drop("_blk", *[f"_{k}_{c}" for c in columns for k in "smop"])
