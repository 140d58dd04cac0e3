"""Quality classifier: ordinal cumulative-link regression over hashed text.

A grade is 0 .. m. One weight vector w over hashed text features is shared by
all grades; ordered thresholds t1 < .. < tm cut the same score:
P(grade >= k) = sigmoid(w.x - tk). The sum of these tails is the expected
grade, a single tail selects documents.

Features are shares within a document: hashed words, hashed triples of character
classes (letters, digits, marks, symbols, ..) and words equal to the one before,
which count as repeats in place of their own bucket: a text of one word said over and
over is a matter of repetition, not of that word. A score is thus a mean of looked-up weights over the whole text; no feature
vector of a document is built when scoring.

The fit takes a bounded sample of graded documents, the ``most`` with the
smallest id hash; only their sparse features reach the driver. Defined cases:
a null or empty text has no features, its score is 0; grades that are null and
documents without grade are not trained on; of several grades of one id the
lowest counts; without any grade all weights are 0. Repeated rows are scored
each; only the named columns are read. A column of the given table that is called
``quality`` comes back as ``quality_given``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_of
from tidemark.llm.words import SPACE, Words, buffers, slices

WORD_BITS = 15
#: graded documents the fit takes at most
MOST = 8192
#: classes of bytes, 4 bits each: blank, lower, upper, digit, sentence mark, shout, bracket or quote, symbol, beyond ASCII, line end
CLASS = np.full(256, 10, np.uint8)
for _code, _members in enumerate([" \t", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "!?", "()[]{}'\"`", "#$%&*|@^~=<>+_\\/-"]):
    CLASS[[ord(c) for c in _members]] = _code
CLASS[128:] = 8
CLASS[[10, 13]] = 9
N_WORD, N_CLASS = 1 << WORD_BITS, 1 << 12
SIZE = N_WORD + N_CLASS + 1


def _codes(raw: np.ndarray, offs: np.ndarray, i: int, j: int):
    """Word buckets, repeat flags, class triples and their bounds for one slice."""
    w = Words(raw, offs, i, j, SPACE)
    buckets = (w.hashes & np.uint64(N_WORD - 1)).astype(np.int64)
    again = np.zeros(len(buckets), bool)
    again[1:] = w.hashes[1:] == w.hashes[:-1]
    again[w.bounds[:-1][np.diff(w.bounds) > 0]] = False
    kinds = CLASS[w.raw].astype(np.int64)
    triples = kinds.copy()
    triples[1:] += kinds[:-1] << 4
    triples[2:] += kinds[:-2] << 8
    # the first two bytes of a document have no triple of their own
    first = w.docs[:-1][np.diff(w.docs) > 0]
    triples[first] = kinds[first]
    second = w.docs[:-1][np.diff(w.docs) > 1] + 1
    triples[second] &= 255
    return buckets, again, w.bounds, triples, w.docs


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and values of the non-zero features of each text."""
    raw, offs = buffers(texts)
    for i, j in slices(offs):
        buckets, again, wb, triples, tb = _codes(raw, offs, i, j)
        for d in range(j - i):
            same, n = again[wb[d] : wb[d + 1]], wb[d + 1] - wb[d]
            words = buckets[wb[d] : wb[d + 1]][~same]
            kinds, m = triples[tb[d] : tb[d + 1]], tb[d + 1] - tb[d]
            a, ca = np.unique(words, return_counts=True)
            b, cb = np.unique(kinds, return_counts=True)
            repeat = same.sum() / max(n, 1)
            yield (np.concatenate([a, b + N_WORD, [SIZE - 1]]).astype(np.int32),
                   np.concatenate([ca / max(n, 1), cb / max(m, 1), [repeat]]).astype(np.float32))


def scores(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """w.x of each text: means of looked-up weights."""
    raw, offs = buffers(texts)
    out = np.zeros(len(offs) - 1)
    for i, j in slices(offs):
        buckets, again, wb, triples, tb = _codes(raw, offs, i, j)
        for values, bounds in ((np.where(again, weights[SIZE - 1], weights[buckets]), wb), (weights[N_WORD + triples], tb)):
            total = np.zeros(len(values) + 1)
            np.cumsum(values, out=total[1:])
            out[i:j] += (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. m, one row per score."""
        return sigmoid(score[:, None] - self.thresholds[None, :])


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, grade_count: int, steps: int = 250,
                rate: float = 0.08, ridge: float = 4e-3) -> OrdinalModel:
    """Maximum likelihood by full-batch Adam; thresholds stay ordered as sums of positive gaps."""
    m = grade_count - 1
    weights = np.zeros(SIZE)
    if not len(rows):
        return OrdinalModel(weights, np.arange(m) * 1.0)
    place = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows]).astype(np.float64)
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    n = len(rows)
    # features are scaled by their root mean square; rare ones are held back
    scale = 1 / np.sqrt(np.bincount(place, value**2, SIZE) / n + 1e-4)
    value *= scale[place]
    share = (np.array([(grades >= k).sum() for k in range(1, grade_count)]) + 0.5) / (n + 1)
    cuts = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(cuts), 1e-3))
    params = np.concatenate([weights, cuts[:1], gaps])
    first, second = np.zeros_like(params), np.zeros_like(params)
    every = np.arange(n)
    for step in range(1, steps + 1):
        w, t0, g = params[:SIZE], params[SIZE], params[SIZE + 1 :]
        t = t0 + np.concatenate([[0], np.cumsum(np.exp(g))])
        eta = np.bincount(row, value * w[place], n)
        c = np.hstack([np.ones((n, 1)), sigmoid(eta[:, None] - t), np.zeros((n, 1))])
        p = np.maximum(c[every, grades] - c[every, grades + 1], 1e-9)
        slope = c * (1 - c)
        d_eta = (slope[every, grades] - slope[every, grades + 1]) / p
        d_t = np.zeros((n, m + 2))
        d_t[every, grades] -= slope[every, grades] / p
        d_t[every, grades + 1] += slope[every, grades + 1] / p
        d_t = d_t[:, 1:-1].mean(0)
        grad = np.empty_like(params)
        grad[:SIZE] = np.bincount(place, value * d_eta[row], SIZE) / n - ridge * w
        grad[SIZE] = d_t.sum()
        grad[SIZE + 1 :] = np.cumsum(d_t[::-1])[::-1][1:] * np.exp(g)
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        params += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    t = params[SIZE] + np.concatenate([[0], np.cumsum(np.exp(params[SIZE + 1 :]))])
    return OrdinalModel(params[:SIZE] * scale, t)


def train(docs: DataFrame, grades: DataFrame, grade_count: int, id_col: str = "doc_id", text_col: str = "text",
          grade_col: str = "grade", most: int = MOST) -> OrdinalModel:
    """Fit on at most ``most`` graded documents (those with the smallest id hash)."""
    chosen = (grades.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade"))
              .filter("id IS NOT NULL AND grade IS NOT NULL").groupBy("id").agg(F.min("grade").alias("grade"))
              .orderBy(F.xxhash64("id"), "id").limit(most))
    # the chosen ids are at most `most` rows, which bounds this broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(features(batch.column(0)))
            yield pa.RecordBatch.from_pydict({"grade": batch.column(1), "place": pa.array([g[0].tobytes() for g in got], pa.binary()),
                                              "value": pa.array([g[1].tobytes() for g in got], pa.binary())})

    # repeated rows of one id could exceed the bound, so the limit is set again
    got = rows.select("text", "grade").mapInArrow(run, "grade int, place binary, value binary").limit(most).toArrow()
    sparse = [(np.frombuffer(p, np.int32), np.frombuffer(v, np.float32)) for p, v in zip(got["place"].to_pylist(), got["value"].to_pylist(), strict=True)]
    order = sorted(range(len(sparse)), key=lambda r: (sparse[r][0].tobytes(), sparse[r][1].tobytes()))
    labels = np.array(got["grade"].to_pylist(), np.int64)
    return fit_ordinal([sparse[r] for r in order], np.clip(labels[order], 0, grade_count - 1) if len(order) else labels, grade_count)


def graded(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", tail: int = 1,
           keep_at: float = 0.5) -> DataFrame:
    """All columns of ``docs`` plus ``quality`` (expected grade, tail probability, keep).

    The text goes through Python once; other columns ride along unread.
    """
    docs = free_of(docs, "quality")
    kept = spark_broadcast(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept.value
        for batch in batches:
            tails = own.tails(scores(batch.column(0).field(text_col), own.weights))
            p = tails[:, tail - 1]
            result = pa.StructArray.from_arrays([pa.array(tails.sum(1)), pa.array(p), pa.array(p >= keep_at)], ["expected_grade", "p_tail", "keep"])
            yield pa.RecordBatch.from_arrays([batch.column(0), result], names=["row", "quality"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(run, f"row {kind}, quality struct<expected_grade:double,p_tail:double,keep:boolean>")
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], "quality")


def spark_broadcast(df: DataFrame, value):
    """A model of fixed size, sent once to each executor."""
    return df.sparkSession.sparkContext.broadcast(value)


def label_grades(labels: DataFrame) -> DataFrame:
    """Grades of the given labels: 0 poor, 1 sound but toxic, 2 sound and clean."""
    return labels.select("doc_id", (F.col("quality") * (2 - F.coalesce(F.col("toxic"), F.lit(0)))).alias("grade"))


GRADES = 3
