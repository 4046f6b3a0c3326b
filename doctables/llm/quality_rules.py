"""Quality rules: counts of each text, hard limits on them, and isolation forests on their ratios.

One forest splits on all ratios, and one on each ratio alone, since a group of equal faults hides among the random splits of
other ratios. Forests are grown on a bounded sample of all documents; path lengths over the random splits give each document an
anomaly between 0 and 1 per forest. Thresholds come from all labelled documents: per forest, the anomaly above which the most
bad ones lie, while at most ``max_loss`` of the good ones do; a forest that catches less than ``min_gain`` of them rejects nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from doctables.llm.common import column, hashed, slices, window_hashes, words_of, written

WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: The forest: number of trees, rows per tree, and score bins in which labelled documents are counted.
TREES, ROWS_PER_TREE, BINS = 50, 256, 2000
MAX_LOSS, MIN_GAIN = 0.002, 0.05
RATIOS = ("n_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "marks", "distinct")
#: The ratios that each forest splits on; the first one is the joint forest.
FORESTS = (tuple(range(1, len(RATIOS))), *((i,) for i in range(len(RATIOS))))

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct_words")
_SPACES = " \t\n\x0b\x0c\r"


def _lut(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


SYMBOLS, UPPER, MARKS = _lut("#*$%&|<>"), _lut("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _lut("!?")


def _byte_counts(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
    return sums[offsets[1:] - offsets[0]] - sums[offsets[:-1] - offsets[0]]


def repeated_words(windows: np.ndarray, size: int) -> int:
    """Words of a text in windows that it holds twice or more, from the hashes of its windows."""
    if len(windows) < 2:
        return 0
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    if len(counts) == len(windows):
        return 0
    edge = np.zeros(len(windows) + size, np.int64)
    at = np.flatnonzero(counts[inverse] > 1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge) > 0).sum())


def _statistics(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = pc.fill_null(column(batch, "text"), "").cast(pa.large_string())
        words, starts = words_of(texts)
        n_words = np.diff(starts)
        chars = np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)])
        values = hashed(words)
        windows = window_hashes(values, WINDOW)
        repeats, distinct, dup, lines = [], [], [], []
        for a, b, text in zip(starts[:-1].tolist(), starts[1:].tolist(), texts.to_pylist()):
            repeats.append(repeated_words(windows[a:max(a, b - WINDOW + 1)], WINDOW))
            distinct.append(len(np.unique(values[a:b])))
            split = text.split("\n")
            filled = [x for x in split if x.strip(_SPACES)]
            dup.append(len(filled) - len(set(filled)))
            lines.append(len(filled))
        found = (n_words, chars[starts[1:]] - chars[starts[:-1]], _byte_counts(texts, SYMBOLS), dup, repeats, lines,
                 _byte_counts(texts, UPPER), _byte_counts(texts, MARKS), distinct)
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in found)], ["doc_id", *STATISTICS])


def rule_statistics(docs: DataFrame) -> DataFrame:
    """Counts per row of ``docs (doc_id, text)``, and ``base_failed``. A null or empty text counts 0 throughout, and fails."""
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_statistics, "doc_id long, " + ", ".join(f"{s} long" for s in STATISTICS))
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")))


def ratios(counts: dict[str, np.ndarray]) -> np.ndarray:
    c = {k: v.astype(float) for k, v in counts.items()}
    n, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.column_stack([np.log1p(c["n_words"]), chars / n, c["n_symbols"] / n, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / n,
                            c["n_upper"] / chars, c["n_marks"] / n, c["n_distinct_words"] / n])


def _expected(n: float) -> float:
    """Mean path length of a failed search in a binary tree of n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


@dataclass
class Forest:
    feature: np.ndarray  # trees x nodes, -1 at leaves
    split: np.ndarray
    path: np.ndarray  # path length that a row ends with at a leaf
    norm: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, split, path in zip(self.feature, self.split, self.path):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(feature) + 1)) - 1):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (x[rows, np.maximum(f, 0)] >= split[node]))
            total += path[node]
        return np.exp2(-total / len(self.feature) / self.norm)


def grow(sample: np.ndarray, trees: int = TREES, rows: int = ROWS_PER_TREE, seed: int = 7) -> Forest:
    """An isolation forest; each tree splits its rows at random values of random features down to single rows or the depth limit."""
    rng = np.random.default_rng(seed)
    rows = min(rows, len(sample))
    depth = max(1, int(np.ceil(np.log2(max(rows, 2)))))
    nodes = (1 << (depth + 1)) - 1
    feature, split, path = np.full((trees, nodes), -1, np.int16), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for t in range(trees):
        stack = [(0, 0, rng.choice(len(sample), rows, replace=False))]
        while stack:
            node, level, own = stack.pop()
            low, high = sample[own].min(axis=0), sample[own].max(axis=0)
            open_ = np.flatnonzero(high > low)
            if level == depth or len(own) < 2 or not len(open_):
                path[t, node] = level + _expected(len(own))
                continue
            f = rng.choice(open_)
            feature[t, node], split[t, node] = f, rng.uniform(low[f], high[f])
            right = sample[own, f] >= split[t, node]
            stack += [(2 * node + 1, level + 1, own[~right]), (2 * node + 2, level + 1, own[right])]
    return Forest(feature, split, path, max(_expected(rows), 1e-9))


def fit_forests(statistics: DataFrame, trees: int = TREES, rows: int = ROWS_PER_TREE) -> list[Forest]:
    """Grown on at most ``trees * rows`` documents, those with the smallest hashes of their counts and ids; none if there are none."""
    some = statistics.select(*STATISTICS).orderBy(F.xxhash64("doc_id", *STATISTICS), *STATISTICS).limit(trees * rows).toPandas()
    x = ratios({s: some[s].to_numpy() for s in STATISTICS})
    return [grow(x[:, list(of)], trees, rows, seed) for seed, of in enumerate(FORESTS)] if len(x) else []


def with_scores(statistics: DataFrame, forests: list[Forest]) -> DataFrame:
    """``statistics`` and a column ``anomalies``, one per forest."""
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = ratios({s: column(batch, s).to_numpy(zero_copy_only=False) for s in STATISTICS})
            found = np.column_stack([f.scores(x[:, list(of)]) for f, of in zip(forests, FORESTS)]) if forests else np.zeros((len(x), 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "anomalies"])
    return statistics.mapInArrow(score, statistics.withColumn("anomalies", F.expr("cast(array() as array<double>)")).schema)


def calibrate(scored: DataFrame, labels: DataFrame, bins: int = BINS, max_loss: float = MAX_LOSS, min_gain: float = MIN_GAIN) -> list[float]:
    """A threshold per forest from all labelled rows, counted in score bins; 1.1, which no score reaches, where none is worth it.

    A document with several labels counts with its best one. At most two rows per forest and bin reach the driver.
    """
    best = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = (scored.where("not base_failed").join(best, "doc_id").select((F.col("quality") > 0).alias("good"), F.posexplode("anomalies").alias("forest", "s"))
            .groupBy("forest", F.floor(F.col("s") * bins).cast("int").alias("bin"), "good").count().collect())
    counts = np.zeros((2, len(FORESTS), bins + 2))
    for r in rows:
        counts[int(r.good), r.forest, r.bin] += r["count"]
    out = []
    for good, bad in zip(counts[1], counts[0]):
        lost, caught = np.cumsum(good[::-1])[::-1] / max(good.sum(), 1), np.cumsum(bad[::-1])[::-1] / max(bad.sum(), 1)
        fits = np.flatnonzero((lost <= max_loss) & (caught >= min_gain))
        out.append(float(fits[np.argmax((caught - lost)[fits])] / bins) if len(fits) and good.sum() else 1.1)
    return out


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: the counts, base_failed, anomalies and ``kept``.

    ``kept`` is false if base_failed or if an anomaly reaches its forest's threshold. Repeated rows each get a row; other columns are
    ignored; an empty table gives no rows.
    """
    statistics = written(rule_statistics(docs), "rule-statistics")
    scored = with_scores(statistics, fit_forests(statistics.where("not base_failed")))
    limits = F.array(*(F.lit(t) for t in calibrate(scored, labels)))
    caught = F.exists(F.zip_with("anomalies", limits, lambda s, t: s >= t), lambda x: x)
    return scored.withColumn("kept", ~F.col("base_failed") & ~caught)


def op8_quality_rules(spark, sf_dir):
    judged = judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", *STATISTICS[:5], "base_failed", "kept", F.get("anomalies", F.lit(0)).alias("anomaly"))
