"""Toxicity by nearest labelled examples: exact TF-IDF cosine with block-max pruning.

Terms are the words of labelled examples that go with the label: those whose
share of toxic examples, at the lower end of its confidence interval, is well
over the base rate. Inverse document frequencies of the terms come from all
documents. Examples form an inverted index cut into blocks of example ids; each
term keeps its largest weight per block. A query visits blocks in the order of
their upper bound and stops when no block can still reach the k best, so the k
nearest are exact. Their votes, weighted by cosine, are calibrated by isotonic
regression on leave-one-out votes of the examples themselves.

The fit takes at most ``most`` labelled documents (smallest id hash), so the
index is bounded and is broadcast. Defined cases: a null or empty text, or one
without any term, has no neighbour and gets the rate of such examples; ties in
cosine go to the smaller id; of several labels of one id the highest counts;
null labels are left out; without labels every score is 0. Repeated rows are
scored each. Only the named columns are read.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import PUNCTUATION, Words, buffers, slices

#: labelled documents in the index, terms, and examples per block
MOST, MOST_TERMS, BLOCK = 20_000, 16_384, 256
K = 15
#: a term needs this many examples, and this multiple of the base rate at the lower bound
LEAST, TIMES, Z = 4, 2.0, 3.3


def term_counts(texts: pa.Array, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``terms`` (sorted hashes) and counts of the terms of each text."""
    raw, offs = buffers(texts)
    none = np.zeros(0, np.int64)
    for i, j in slices(offs):
        w = Words(raw, offs, i, j, PUNCTUATION)
        if not len(terms):
            yield from ((none, none) for _ in range(j - i))
            continue
        at = np.minimum(np.searchsorted(terms, w.hashes), len(terms) - 1)
        hit = np.flatnonzero(terms[at] == w.hashes)
        bounds = np.searchsorted(hit, w.bounds)
        found = at[hit]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield (none, none) if a == b else np.unique(found[a:b], return_counts=True)


class Index:
    """Example vectors, inverted and cut into blocks."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: np.ndarray, k: int = K):
        self.terms, self.idf, self.labels, self.ids, self.k = terms, idf, labels, ids, k
        vectors = [self.vector(*e) for e in examples]
        postings: list[list[tuple[int, float]]] = [[] for _ in terms]
        for e, (places, weights) in enumerate(vectors):
            for p, x in zip(places.tolist(), weights.tolist(), strict=True):
                postings[p].append((e, x))
        self.rows = [np.array([e for e, _ in p], np.int64) for p in postings]
        self.weights = [np.array([x for _, x in p]) for p in postings]
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for rows, weights in zip(self.rows, self.weights, strict=True):
            block, start = np.unique(rows // BLOCK, return_index=True)
            self.blocks.append((block, np.append(start, len(rows)), np.maximum.reduceat(weights, start) if len(rows) else weights))
        self.n_blocks = len(labels) // BLOCK + 1
        empty = np.array([not len(v[0]) for v in vectors], bool)
        self.no_term = float((labels[empty].sum() + 0.5) / (empty.sum() + 1)) if len(labels) else 0.0
        self.calibration = self._calibrated([(self.vote(*self.nearest(*v, leave=e)), int(labels[e])) for e, v in enumerate(vectors) if len(v[0])])

    def vector(self, places: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weights = (1 + np.log(counts)) * self.idf[places] if len(places) else np.zeros(0)
        return places, weights / (np.sqrt((weights**2).sum()) or 1.0)

    def nearest(self, places: np.ndarray, weights: np.ndarray, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest positive cosine, exactly; ties by place."""
        bound = np.zeros(self.n_blocks)
        for p, x in zip(places.tolist(), weights.tolist(), strict=True):
            block, _, most = self.blocks[p]
            bound[block] += x * most
        best_rows, best = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bound, kind="stable").tolist():
            # a little slack, as sums in another order may differ in the last place
            if bound[b] <= 0 or len(best) == self.k and bound[b] < best[-1] - 1e-12:
                break
            total = np.zeros(BLOCK)
            for p, x in zip(places.tolist(), weights.tolist(), strict=True):
                block, start, _ = self.blocks[p]
                i = bisect.bisect_left(block, b)
                if i < len(block) and block[i] == b:
                    part = slice(start[i], start[i + 1])
                    total[self.rows[p][part] - b * BLOCK] += x * self.weights[p][part]
            found = np.flatnonzero(total > 0)
            found = found[found + b * BLOCK != leave]
            best_rows, best = np.concatenate([best_rows, found + b * BLOCK]), np.concatenate([best, total[found]])
            order = np.lexsort((best_rows, -np.round(best, 12)))[: self.k]
            best_rows, best = best_rows[order], best[order]
        return best_rows, best

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        """Share of the label among neighbours by cosine; one prior vote of weight one tenth."""
        return float(((cosines * self.labels[rows]).sum() + 0.1 * self.no_term) / (cosines.sum() + 0.1))

    @staticmethod
    def _calibrated(votes: list[tuple[float, int]]) -> tuple[list[float], list[float]]:
        """Isotonic steps: pool neighbours until rates rise with the vote."""
        pools: list[list[float]] = []
        for v, y in sorted(votes):
            pools.append([v, y, 1])
            while len(pools) > 1 and (pools[-2][0] == pools[-1][0] or pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]):
                _, s, n = pools.pop()
                pools[-1][1] += s
                pools[-1][2] += n
        return [p[0] for p in pools], [(p[1] + 0.1) / (p[2] + 0.2) for p in pools]

    def score(self, places: np.ndarray, counts: np.ndarray) -> tuple[float, list[int]]:
        """Calibrated score and the ids of the three nearest examples."""
        if not len(places):
            return self.no_term, []
        rows, cosines = self.nearest(*self.vector(places, counts))
        starts, rates = self.calibration
        vote = self.vote(rows, cosines)
        if not starts:
            return vote, self.ids[rows[:3]].tolist()
        step = rates[max(bisect.bisect_right(starts, vote) - 1, 0)]
        # within a step the vote itself keeps the order
        return min(1.0, max(0.0, 0.98 * step + 0.02 * vote)), self.ids[rows[:3]].tolist()


def build(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST) -> Index:
    """Terms from the labelled sample, document frequencies from all documents."""
    chosen = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
              .filter("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("id"), "id").limit(most))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # at most `most` ids, which bounds this broadcast
    sample = rows.join(F.broadcast(chosen), "id")

    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.array(batch.column(1).to_pylist(), np.int64)
            raw, offs = buffers(batch.column(0))
            for i, j in slices(offs):
                w = Words(raw, offs, i, j, PUNCTUATION)
                doc = np.repeat(np.arange(j - i), np.diff(w.bounds))
                pairs = np.unique(np.stack([w.hashes, doc.astype(np.uint64)]), axis=1) if len(doc) else np.zeros((2, 0), np.uint64)
                words, place = np.unique(pairs[0], return_inverse=True)
                hits = label[i + pairs[1].astype(np.int64)]
                yield pa.RecordBatch.from_pydict({"term": words.view(np.int64), "n": np.bincount(place, minlength=len(words)).astype(np.int64),
                                                  "hits": np.bincount(place, hits, len(words)).astype(np.int64)})

    total = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("hits")).first()
    n, hits = total["n"], total["hits"] or 0
    base = hits / n if n else 0.0
    words = sample.select("text", "label").mapInArrow(occurring, "term long, n long, hits long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    p, z2 = F.col("hits") / F.col("n"), Z * Z
    lower = (p + z2 / (2 * F.col("n")) - Z * F.sqrt(p * (1 - p) / F.col("n") + z2 / (4 * F.col("n") * F.col("n")))) / (1 + z2 / F.col("n"))
    found = (words.filter(F.col("n") >= LEAST).withColumn("lower", lower).filter(F.col("lower") > min(TIMES * base, (1 + base) / 2))
             .orderBy(F.desc("lower"), "term").limit(MOST_TERMS).select("term").collect())
    terms = np.sort(np.array([r["term"] for r in found], np.int64).view(np.uint64))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            seen += batch.num_rows
            for places, _ in term_counts(batch.column(0), terms):
                df[places] += 1
        yield pa.RecordBatch.from_pydict({"place": np.arange(-1, len(terms)), "df": np.concatenate([[seen], df])})

    counts = {r["place"]: r["df"] for r in rows.select("text").mapInArrow(counted, "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).collect()}
    every = counts.get(-1, 0)
    idf = np.array([math.log((1 + every) / (1 + counts.get(i, 0))) + 1 for i in range(len(terms))])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(term_counts(batch.column(2), terms))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0].tolist() for g in got], pa.list_(pa.int64())),
                                              pa.array([g[1].tolist() for g in got], pa.list_(pa.int64()))], names=["id", "label", "places", "counts"])

    got = sample.select("id", "label", "text").mapInArrow(vectors, "id long, label int, places array<long>, counts array<long>").limit(most).toArrow().to_pylist()
    got.sort(key=lambda r: (r["id"], r["places"], r["counts"]))
    examples = [(np.array(r["places"], np.int64), np.array(r["counts"], np.int64)) for r in got]
    return Index(terms, idf, examples, np.array([r["label"] for r in got], np.int64), np.array([r["id"] for r in got], np.int64))


def scored(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` and ``evidence`` (ids of the nearest examples) of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            got = [own.score(*c) for c in term_counts(batch.column(1), own.terms)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.list_(pa.int64()))],
                                             names=["id", "score", "evidence"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double, evidence array<long>").withColumnRenamed("id", id_col)
