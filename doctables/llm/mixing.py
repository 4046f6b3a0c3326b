"""Mixing sources to target weights by weighted fair queueing.

Every source queues its documents in a shuffled order, up to ``repeats`` times over. A document's virtual finish time is the number
of its source's words up to its end, divided by the source's target. All queues are sorted together by that time, over range
partitions, and the order is cut where the running sum of words reaches the budget. A document that lies across the end of
its source's share is queued in two parts, so that a source ends within some words of its target, however long its documents are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from doctables.llm.common import column, slices, written
from doctables.llm.running import running

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_counts(texts: pa.Array) -> np.ndarray:
    """How many ``[^\\x20\\x09-\\x0D]+`` each text has (null: 0)."""
    texts = texts.fill_null("").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if at[0] == at[-1]:
        return np.zeros(len(texts), np.int64)
    blank = BLANK[np.frombuffer(texts.buffers()[2], np.uint8)[at[0]:at[-1]]]
    start = ~blank
    start[1:] &= blank[:-1]
    first = (at - at[0])[:-1][np.diff(at) > 0]
    start[first] = ~blank[first]
    return np.diff(np.concatenate([[0], np.cumsum(start)])[at - at[0]])


def _sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "source"), pa.array(word_counts(column(batch, "text")))],
                                         ["doc_id", "source", "size"])


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``(source, source_no, source_size, target)`` from ``(source, size)``.

    Sources by code point, null last, take the weights in turn and share all words by them; a target stops at ``repeats`` times its
    source's size, and what that leaves is shared again. Each round is one aggregate over the sources, with integers throughout.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    ranked = running(totals, [F.col("source").isNull(), "source"], sums=["one"], label="sources")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("one_upto") - 1).cast("int") % len(weights) + 1)
    sources = written(ranked.select("source", F.col("one_upto").alias("source_no"), "source_size", weight.cast("decimal(38,0)").alias("weight"),
                                    (F.col("source_size").cast("decimal(38,0)") * repeats).cast("decimal(38,0)").alias("most")), "weights")
    left, share = sources.agg(F.sum("source_size"), F.sum(F.col("weight"))).first()
    budget, left = Decimal(left or 0), Decimal(left or 0)
    while True:
        above = _above(left, share or Decimal(0))
        full, rest = sources.agg(F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("weight")))).first()
        if (budget - (full or 0), rest) == (left, share):
            break
        left, share = budget - (full or 0), rest
    even = (F.col("weight") * _exact(left)).cast("double") / _exact(share or Decimal(1)).cast("double")
    target = F.when(_above(left, share or Decimal(0)), F.col("most").cast("double")).otherwise(even)
    return written(sources.select("source", "source_no", "source_size", target.alias("target")), "targets")


def _exact(x: Decimal) -> Column:
    return F.lit(int(x)).cast("decimal(20,0)")


def _above(left: Decimal, share: Decimal) -> Column:
    """Whether a source's part of ``left`` by its weight of ``share`` is more than the source can give."""
    return F.col("weight").cast("decimal(10,0)") * _exact(left) > F.col("most").cast("decimal(20,0)") * F.lit(int(share)).cast("decimal(18,0)")


def queue(docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents' sizes ``(row, doc_id, source, size)``, the sources' targets, and the mix (see :func:`mix_documents`) with ``row``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    sizes = written(docs.mapInArrow(_sizes, "doc_id long, source string, size long").withColumn("row", F.monotonically_increasing_id()), "sizes")
    targets = source_targets(sizes, weights, repeats)
    named = targets.withColumnRenamed("source", "_source")
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    waiting = sizes.where("size > 0").join(named, F.col("source").eqNullSafe(F.col("_source"))).select(
        "source_no", F.conv(F.substring(mark, 1, 15), 16, 10).cast("long").alias("shuffled"), "doc_id", "size", "row", "source_size", "target")
    waiting = running(waiting, ["source_no", "shuffled", "doc_id", "size", "row"], sums=["size"], group="source_no", label="queues")
    # each repeat that begins before the source's share ends; the share's end cuts one document of a source in two
    turn = waiting.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)).cast("array<long>")))
    turn = turn.withColumn("end", F.expr("repeat * source_size + size_upto")).withColumn("begin", F.expr("end - size")).where("begin <= target")
    parts = F.expr("""CASE WHEN begin < floor(target) AND floor(target) < end
        THEN array(struct(begin AS a, floor(target) AS b), struct(floor(target) AS a, end AS b)) ELSE array(struct(begin AS a, end AS b)) END""")
    parts = turn.withColumn("p", F.explode(parts)).selectExpr(
        "row", "doc_id", "source_no", "repeat", "p.a - begin AS skipped", "p.b - p.a AS words", "p.b / target AS finish", "p.b AS served")
    budget = sizes.agg(F.sum("size")).first()[0] or 0
    mixed = running(parts, ["finish", "source_no", "served", "row"], sums=["words"], label="mix")
    mixed = mixed.withColumn("position", F.col("words_upto") - F.col("words")).where(F.col("position") < budget)
    return sizes, targets, mixed.withColumn("words", F.least("words", F.lit(budget) - F.col("position"))).drop("words_upto", "served")


def mix_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, seed: int = 0) -> DataFrame:
    """The mix of ``docs (doc_id, source, text)``: doc_id, source_no, repeat, skipped, words, finish, position.

    A row takes ``words`` words of a document after its first ``skipped``; ``position`` counts the words before it in the mix, which has
    as many words as all documents. Each row of ``docs`` is a document, also when its id repeats or is null. A null text
    has no words and is never taken; other columns are ignored; an empty table gives an empty mix. ``seed`` changes the order.
    """
    return queue(docs, weights, repeats, seed)[2].drop("row")


def op11_mix_sources(spark, sf_dir):
    sizes, targets, mixed = queue(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = mixed.groupBy("row").agg(F.sum("words").alias("taken"))
    named = targets.withColumnRenamed("source", "_source")
    rows = sizes.join(named, F.col("source").eqNullSafe(F.col("_source"))).join(taken, "row", "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, row_number() OVER () AS rid FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM totals),
weighted AS (SELECT *, [5, 2, 1][(source_no - 1) % 3 + 1]::HUGEINT AS weight, 3 * source_size::HUGEINT AS most FROM ranked),
filled AS (
  SELECT *, (sum(source_size) OVER ())::HUGEINT - coalesce(sum(most) OVER w, 0)::HUGEINT AS remaining,
    (sum(weight) OVER ())::HUGEINT - coalesce(sum(weight) OVER w, 0)::HUGEINT AS share, row_number() OVER (ORDER BY most * 10 // weight, source_no) AS i
  FROM weighted WINDOW w AS (ORDER BY most * 10 // weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT remaining, share FROM filled WHERE weight * remaining <= most * share ORDER BY i LIMIT 1),
targets AS (
  SELECT source, source_no, source_size, CASE WHEN weight * l.remaining > most * l.share THEN most::DOUBLE
    ELSE (weight * l.remaining)::DOUBLE / l.share::DOUBLE END AS target
  FROM weighted, level l),
queued AS (
  SELECT s.rid, s.size, t.*, sum(s.size) OVER (PARTITION BY source_no ORDER BY ('0x' || substr(md5('0:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 15))::BIGINT, s.doc_id NULLS FIRST, s.size, s.rid
    ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source WHERE s.size > 0),
turns AS (
  SELECT *, r * source_size + upto AS e, r * source_size + upto - size AS b, floor(target)::BIGINT AS cut
  FROM queued, (SELECT unnest([0, 1, 2])::BIGINT AS r) WHERE r * source_size + upto - size <= target),
parts AS (
  SELECT rid, source_no, b AS a, CASE WHEN b < cut AND cut < e THEN cut ELSE e END AS z, target FROM turns
  UNION ALL SELECT rid, source_no, cut, e, target FROM turns WHERE b < cut AND cut < e),
mix AS (
  SELECT rid, z - a AS words, sum(z - a) OVER (ORDER BY z::DOUBLE / target, source_no, z, rid ROWS UNBOUNDED PRECEDING)::BIGINT AS upto,
    (SELECT sum(size) FROM sized)::BIGINT AS budget
  FROM parts),
taken AS (SELECT rid, sum(greatest(0, least(words, budget - upto + words)))::BIGINT AS taken FROM mix GROUP BY rid)
SELECT s.doc_id, s.size, t.source_size, t.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN taken k ON k.rid = s.rid
"""
