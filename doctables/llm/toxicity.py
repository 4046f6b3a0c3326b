"""Toxicity by class-conditional Kneser-Ney models of the spelling of words.

Characters of a word are predicted from up to ``ORDER - 1`` before them. Each class has its own counts at the highest order; both
back off to shared continuation counts (in how many different places an expression was seen), so a rare expression is judged
by the more frequent ones that it is like. A text's evidence is the difference of its toxic and ordinary log-likelihoods per
word, over the whole text and over its most toxic passage; a logistic fit turns it into a probability.

N-grams are counted exactly by Spark over all labelled training rows and only then added up in ``BUCKETS`` hash buckets, so the
model that is sent to the tasks has one size (40 MB) for any corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from doctables.llm.common import Bitmap, column, give_back, mixed, slices, words_of, written

ORDER = 6
BUCKETS = 1 << 20
DISCOUNT = 0.75
ALPHABET = 4096  # uniform base of the shared back-off
PASSAGE = 16
#: Of the training rows every eighth, and at most so many of them, fit the logistic; they are not counted.
CALIBRATION_SHARE, CALIBRATION_ROWS = 8, 40_000
THRESHOLD = 0.3
#: Word scores kept per Python worker.
KEPT_WORDS = 200_000

FIRST, LAST = "\x02", "\x03"
_NO_LETTER = re.compile(r"[\W\d_]+")
_CLASSES = ("ordinary", "toxic")


def spelled(word: str) -> str:
    """Letters of a word in lower case; empty if it has none."""
    return _NO_LETTER.sub("", word.lower())


def _symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each between a first and a last mark, and the place of each in its word."""
    text = "".join([f"{FIRST}{w}{LAST}" for w in words])
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(words) else np.zeros(0, np.int64)
    return points, np.arange(len(points)) - np.repeat(starts, lengths)


def gram_hashes(points: np.ndarray) -> list[np.ndarray]:
    """For k = 1..ORDER the hash of the k symbols that end at each place (of no use where the word is shorter)."""
    out = [mixed(points + np.uint64(1))]
    for k in range(2, ORDER + 1):
        before = np.concatenate([np.zeros(min(k - 1, len(points)), np.uint64), points[:max(0, len(points) - k + 1)]])
        out.append(mixed(out[-1] * np.uint64(0x9E3779B97F4A7C15) + before + np.uint64(k)))
    return out


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1)


@dataclass
class Model:
    """Bucket arrays: class counts of highest-order grams and contexts, and shared continuation counts of the lower ones."""
    gram: np.ndarray  # class x bucket: count
    context: np.ndarray  # class x bucket: count of a context's grams
    kinds: np.ndarray  # class x bucket: different grams of a context
    places: np.ndarray  # bucket: different symbols before a lower gram
    base: np.ndarray  # bucket: sum of places over the grams of a lower context
    base_kinds: np.ndarray  # bucket: different grams of a lower context
    symbols: tuple[float, float]  # base and base_kinds of the empty context

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Toxic minus ordinary log-likelihood of each spelled word."""
        if not words:
            return np.zeros(0)
        points, place = _symbols(words)
        grams = [_bucket(h) for h in gram_hashes(points)]  # grams[k - 1]: the k symbols that end here
        before = [np.concatenate([[0], g[:-1]]) for g in grams]  # the k symbols that end at the symbol before
        shared = np.full(len(points), 1.0 / ALPHABET)
        for k in range(1, ORDER):
            total, kinds = (self.base[before[k - 2]], self.base_kinds[before[k - 2]]) if k > 1 else self.symbols
            mass = np.maximum(self.places[grams[k - 1]] - DISCOUNT, 0) + DISCOUNT * kinds * shared
            shared = np.where((place >= k) & (total > 0), mass / np.maximum(total, 1), shared)
        top = np.minimum(place + 1, ORDER)  # the length of the gram that the classes count here
        gram, context = np.choose(top - 1, grams), np.choose(np.maximum(top - 2, 0), before)
        logs = []
        for c in range(len(_CLASSES)):
            total = self.context[c][context]
            mass = np.maximum(self.gram[c][gram] - DISCOUNT, 0) + DISCOUNT * self.kinds[c][context] * shared
            logs.append(np.log(np.maximum(np.where(total > 0, mass / np.maximum(total, 1), shared), 1e-12)))
        return np.add.reduceat(np.where(place > 0, logs[1] - logs[0], 0.0), np.flatnonzero(place == 0))


def text_features(texts: pa.Array, model: Model, kept: dict[str, float]) -> np.ndarray:
    """Per text: evidence per word, that of its most toxic passage, its most toxic word's, and the log of its words."""
    words, starts = words_of(texts)
    coded = words.dictionary_encode()
    forms = [spelled(w) for w in coded.dictionary.to_pylist()]
    new = list(dict.fromkeys(f for f in forms if f not in kept))
    if len(kept) + len(new) > KEPT_WORDS:
        kept.clear()
        new = list(dict.fromkeys(forms))
    for at in range(0, len(new), 20_000):
        some = new[at:at + 20_000]
        kept.update(zip(some, model.word_scores(some).tolist()))
    kept[""] = 0.0
    of = np.fromiter((kept[f] for f in forms), float, len(forms))
    scores = of[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0)
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    out = np.zeros((len(texts), 4))
    a, b = starts[:-1], starts[1:]
    n = b - a
    out[:, 0] = (sums[b] - sums[a]) / np.maximum(n, 1)
    out[:, 3] = np.log1p(n)
    window = np.concatenate([sums[PASSAGE:] - sums[:-PASSAGE], [-np.inf]]) if len(scores) >= PASSAGE else np.array([-np.inf])
    for i in np.flatnonzero(n):
        s, e = a[i], b[i]
        out[i, 1] = window[s:e - PASSAGE + 1].max() / PASSAGE if n[i] > PASSAGE else (sums[e] - sums[s]) / PASSAGE
        out[i, 2] = scores[s:e].max()
    return out


def _counter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Highest-order grams of the words of labelled texts with their count per class, added up within a slice."""
    for batch in slices(batches):
        toxic = column(batch, "toxic").to_numpy(zero_copy_only=False)
        counts: dict[str, list[int]] = {}
        for c in range(len(_CLASSES)):
            words, _ = words_of(column(batch, "text").filter(pa.array(toxic == c)))
            for row in words.value_counts().to_pylist():
                word = spelled(row["values"])
                if word:
                    word = FIRST + word + LAST
                    for i in range(1, len(word)):
                        counts.setdefault(word[max(0, i - ORDER + 1):i + 1], [0, 0])[c] += row["counts"]
        values = np.array(list(counts.values()), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(values[:, 0]), pa.array(values[:, 1])], ["gram", *_CLASSES])


def string_buckets(grams: list[str]) -> np.ndarray:
    """The buckets of whole grams, as :meth:`Model.word_scores` finds them inside words."""
    points = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, grams), np.int64, len(grams))
    hashes, ends = gram_hashes(points), np.cumsum(lengths) - 1
    out = np.zeros(len(grams), np.int64)
    for k in range(1, ORDER + 1):
        own = lengths == k
        out[own] = _bucket(hashes[k - 1])[ends[own]]
    return out


def _with_buckets(df: DataFrame) -> DataFrame:
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(string_buckets(column(batch, "gram").to_pylist()))], [*batch.schema.names, "bucket"])
    return df.mapInArrow(add, df.withColumn("bucket", F.lit(0).cast("long")).schema)


def _arrays(df: DataFrame, names: list[str]) -> list[np.ndarray]:
    """Sums per bucket as arrays; at most ``BUCKETS`` rows reach the driver."""
    rows = _with_buckets(df).groupBy("bucket").agg(*(F.sum(n).cast("double").alias(n) for n in names)).toArrow()
    out = []
    for n in names:
        out.append(np.zeros(BUCKETS, np.float32))
        out[-1][rows.column("bucket").to_numpy()] = rows.column(n).to_numpy()
    return out


def fit_language_models(labelled: DataFrame) -> Model:
    """Count ``labelled (text, toxic)``, all rows of it."""
    counted = labelled.mapInArrow(_counter, "gram string, ordinary long, toxic long")
    grams = written(counted.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")), "grams")
    gram = _arrays(grams, list(_CLASSES))
    contexts = grams.select(F.expr("left(gram, length(gram) - 1)").alias("gram"), *_CLASSES, *((F.col(c) > 0).cast("long").alias(f"k_{c}") for c in _CLASSES))
    context = _arrays(contexts, [*_CLASSES, *(f"k_{c}" for c in _CLASSES)])
    # every ending of a gram is a gram that was seen; what stands before it counts once
    endings = grams.select(F.explode(F.expr("transform(sequence(1, length(gram) - 1), i -> substring(gram, i))")).alias("gram")).distinct()
    places = written(endings.select(F.expr("substring(gram, 2)").alias("gram")).groupBy("gram").agg(F.count("*").alias("places")), "places")
    [place] = _arrays(places, ["places"])
    lower = places.where("length(gram) > 1").select(F.expr("left(gram, length(gram) - 1)").alias("gram"), "places", F.lit(1).alias("kinds"))
    base = _arrays(lower, ["places", "kinds"])
    one = places.where("length(gram) = 1").agg(F.coalesce(F.sum("places"), F.lit(0)), F.count("*")).first()
    return Model(np.stack(gram), np.stack(context[:2]), np.stack(context[2:]), place, *base, (float(one[0]), float(one[1])))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Weights of (1, features) by Newton steps; without both labels the constant is the smoothed share of label 1."""
    out = np.zeros(x.shape[1] + 1)
    if not len(y) or y.min() == y.max():
        out[0] = np.log((y.sum() + 0.1) / (len(y) - y.sum() + 1.0))
        return out
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(y) + l2 * np.eye(len(w)), z.T @ (p - y) / len(y) + l2 * w)
    out[1:] = w[1:] / sd
    out[0] = w[0] - (out[1:] * mean).sum()
    return out


class Scorer:
    """A fitted model in a broadcast of fixed size, for use in tasks."""

    def __init__(self, spark, model: Model):
        self.model = spark.sparkContext.broadcast(model)
        self.weights = None
        self.kept: dict[str, float] = {}

    def __getstate__(self):
        return {"model": self.model, "weights": self.weights, "kept": {}}

    def features(self, texts: pa.Array) -> np.ndarray:
        return text_features(texts, self.model.value, self.kept)

    def free(self) -> None:
        """Let the worker wait for its next task without the words of this one."""
        self.kept.clear()
        give_back()

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        x = self.features(texts)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -50, 50)))


def held_out(doc_id: str = "doc_id"):
    """The rows whose labels are never read: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, text, toxic)`` of labelled rows outside the held-out part.

    A bitmap of the labelled ids, of fixed size, keeps most other texts out of the exact join. A document with several labels
    counts as toxic if one says so.
    """
    known = written(labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")), "labels")
    bitmap = docs.sparkSession.sparkContext.broadcast(Bitmap(known, "doc_id"))

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pa.array(bitmap.value.hit(column(batch, "slot").to_numpy(zero_copy_only=False))))
            yield own.select(["doc_id", "text"])
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    some = some.withColumn("slot", bitmap.value.slots("doc_id")).mapInArrow(pick, "doc_id long, text string")
    return some.join(known, "doc_id")


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Count seven eighths of the training rows, all of them, and fit the logistic on a bounded sample of the rest."""
    train = written(labelled_texts(docs, labels), "labelled")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION_SHARE))
    scorer = Scorer(docs.sparkSession, fit_language_models(train.where(part != 0).select("text", "toxic")))
    some = train.where(part == 0).select(F.xxhash64(F.lit(1), "doc_id").alias("h"), "text", F.col("toxic").alias("label"))

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = scorer.features(column(batch, "text"))
            yield pa.RecordBatch.from_arrays([column(batch, "h"), column(batch, "label"), *(pa.array(x[:, i]) for i in range(x.shape[1]))], ["h", "label", "f0", "f1", "f2", "f3"])
    # features, not texts, are what the bounded sample gathers
    rows = some.mapInArrow(measure, "h long, label int, f0 double, f1 double, f2 double, f3 double").orderBy("h", "label", "f0").limit(CALIBRATION_ROWS).toPandas()
    scorer.weights = fit_logistic(rows[["f0", "f1", "f2", "f3"]].to_numpy(), rows["label"].to_numpy(float))
    return scorer


def score_texts(docs: DataFrame, scorer: Scorer, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row and its ``score``; null and empty texts get the score of a text without words."""
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_scored"):
            p = scorer.probabilities(column(batch, "_scored"))
            yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in keep), pa.array(p)], [*keep, "score"])
        scorer.free()
    return docs.select(*keep, F.col("text").alias("_scored")).mapInArrow(score, docs.select(*keep).withColumn("score", F.lit(0.0)).schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score stays below the threshold."""
    scorer = fit(docs, labels)

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(scorer.probabilities(column(batch, "text")) < threshold))
        scorer.free()
    return docs.mapInArrow(clean, docs.schema)


def op5_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scorer = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_texts(docs, scorer, ["doc_id"]).select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
