"""Running totals over a global order: range-sorted blocks, a scan of each block, one carried row per block.

No window holds a whole group or table: a block is one range partition, which also splits the rows of a hot group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from doctables.llm.common import column, written


def _scan(group: str | None, kinds: dict[str, np.ufunc], names: list[str]):
    """Running totals within the partition; they start anew where ``group`` changes."""
    undo = {np.add: np.subtract, np.bitwise_xor: np.bitwise_xor}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen, last, carry = TaskContext.get().partitionId(), 0, None, {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            g = column(batch, group).to_numpy() if group else np.zeros(n, np.int64)
            new = np.concatenate([[True], g[1:] != g[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            goes_on = (start == 0) & (g[0] == last)
            totals = []
            for name, kind in kinds.items():
                upto = kind.accumulate(column(batch, name).to_numpy())
                local = undo[kind](upto, np.concatenate([np.zeros(1, np.int64), upto[:-1]])[start])
                if name in carry:
                    local[goes_on] = kind(local[goes_on], carry[name])
                carry[name] = local[-1]
                totals.append(pa.array(local))
            last = g[-1]
            at = pa.array(np.arange(seen, seen + n))
            seen += n
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names[: -len(kinds) - 2]), *totals, pa.array(np.full(n, block, np.int64)), at], names)
    return run


def running(df: DataFrame, order: Sequence[str | Column], sums: Sequence[str] = (), xors: Sequence[str] = (), group: str | None = None,
            drop: Sequence[str] = (), label: str = "running") -> DataFrame:
    """``df`` without the columns of ``drop`` and with ``<column>_upto`` for each long column of ``sums`` and ``xors``: its total up to and with the row.

    ``order`` must begin with ``group`` (a long column, never null) where there is one; totals start anew for each of its values. Rows
    that are equal by ``order`` come in any order, so let it end with what tells rows apart. The scanned blocks are stored, so
    totals stay the same when a task is repeated; only one row per block is broadcast. An empty table stays empty.
    """
    kinds = {**{c: np.add for c in sums}, **{c: np.bitwise_xor for c in xors}}
    kept = [c for c in df.columns if c not in drop]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema), *(f"`{c}_upto` long" for c in kinds), "_block long", "_at long"])
    names = [*kept, *(f"{c}_upto" for c in kinds), "_block", "_at"]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(ranged.mapInArrow(_scan(group, kinds, names), schema), label)
    key = F.col(group) if group else F.lit(0)
    last = F.max_by(F.struct(key.alias("g"), *(f"{c}_upto" for c in kinds)), "_at")
    blocks = rows.groupBy("_block").agg(F.min_by(key, "_at").alias("_first"), last.alias("l"))
    # one row per block: totals of the group that a block ends with, over all blocks that end with it
    through = Window.partitionBy("l.g").orderBy("_block")
    total = {c: (F.sum if k is np.add else F.bit_xor)(f"l.{c}_upto").over(through) for c, k in kinds.items()}
    blocks = blocks.select("_block", "_first", F.col("l.g").alias("_g"), *(t.alias(f"_{c}") for c, t in total.items()))
    order_of_blocks = Window.orderBy("_block")
    before = F.lag("_g").over(order_of_blocks) == F.col("_first")
    carry = blocks.select("_block", "_first", *(F.when(before, F.lag(f"_{c}").over(order_of_blocks)).otherwise(F.lit(0)).alias(f"_{c}") for c in kinds))
    mine = key == F.col("_first")
    whole = [(F.col(f"{c}_upto") + F.when(mine, F.col(f"_{c}")).otherwise(0)) if k is np.add
             else F.col(f"{c}_upto").bitwiseXOR(F.when(mine, F.col(f"_{c}")).otherwise(F.lit(0).cast("long"))) for c, k in kinds.items()]
    return rows.join(F.broadcast(carry), "_block").select(*kept, *(w.alias(f"{c}_upto") for c, w in zip(kinds, whole)))
