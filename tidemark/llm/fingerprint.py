"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the k smallest hashes of a document's distinct five-word
shingles. Sketches of parts merge by keeping the k smallest of their union, so
a corpus, a source or a document cut into parts gets the same sketch whichever
way it was dealt. Two sketches estimate resemblance and containment; one
estimates the number of distinct shingles. All are exact while a set has at
most k shingles.

Defined cases: a null text is an empty text; it has an empty sketch. Two empty
sketches resemble each other fully, an empty and a non-empty one not at all.
Fewer than five words count as one shingle. Repeated rows are rows of their own.
Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import partitions
from tidemark.llm.words import Words, buffers, sets, slices

WORDS, K = 5, 128
#: most cuts of the id range: keeps the list of cuts small, whatever the input
MOST_BLOCKS, BLOCK_ROWS = 4096, 512
FIRST = -(2**63)


def sketch_arrays(texts: pa.Array, k: int = K, words: int = WORDS) -> list[np.ndarray]:
    """The k smallest shingle hashes of each text, ascending."""
    raw, offs = buffers(texts)
    out = []
    for i, j in slices(offs):
        h, b = sets(*Words(raw, offs, i, j).shingles(words))
        out.extend(h[b[d] : min(b[d] + k, b[d + 1])].copy() for d in range(j - i))
    return out


def as_text(sketch: np.ndarray) -> str:
    """Sixteen hex digits for each hash, smallest first."""
    return sketch.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the two shingle sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) == len(b) and np.array_equal(a, b):
        return 1.0
    union = np.union1d(a, b)
    if len(a) == k or len(b) == k:
        # a full sketch is cut off, so only the k smallest of the union are known
        union = union[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, union[-1], "right")) / len(union)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first set that the second has too."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    return min(1.0, j * (distinct_count(a, k) + distinct_count(b, k)) / (1 + j) / distinct_count(a, k))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """One row per document: id, ``fingerprint`` and ``n_distinct`` (estimated)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = sketch_arrays(batch.column(1), k, words)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(as_text, arrays), pa.string()), pa.array([distinct_count(a, k) for a in arrays], pa.float64())],
                names=["id", "fingerprint", "n_distinct"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, fingerprint string, n_distinct double").withColumnRenamed("id", id_col)


def merged(fingerprints: DataFrame, by: list[str], k: int = K, column: str = "fingerprint") -> DataFrame:
    """The sketch of each group's union.

    Ranking under the limit k is pushed below the shuffle, so a task sends at
    most k hashes of a group, however many documents the group has.
    """
    hashes = fingerprints.select(*by, F.explode(F.expr(f"regexp_extract_all({column}, '[0-9a-f]{{16}}', 0)")).alias("hash")).distinct()
    ranked = hashes.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("hash"))).filter(F.col("place") <= k)
    return ranked.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("hash")), "").alias(column))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (block, id, text, borrowed), dealt so that each row's successor follows it.

    The order is by id, descending, rows without id last, then by text. The id
    range is cut at quantiles into blocks (their number is bounded); each block
    also gets, as its last row, a copy of the first row of the block after it
    (after the last block: of the first block). Texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("id", F.lit(FIRST)))
    n = rows.count()
    blocks = max(1, min(MOST_BLOCKS, n // BLOCK_ROWS))
    cuts = rows.agg(F.percentile_approx("key", [i / blocks for i in range(1, blocks)] or [0.5], 10_000)).first()[0] if n else []
    splits = [-float("inf"), *sorted(set(map(float, cuts))), float("inf")]
    if len(splits) == 2:
        splits.insert(1, 0.0)
    cut = Bucketizer(splits=splits, inputCol="place", outputCol="bucket")
    rows = cut.transform(rows.withColumn("place", F.col("key").cast("double"))).select(F.col("bucket").cast("int").alias("block"), "key", "id", "text")
    # one row per block, so at most MOST_BLOCKS + 1 rows reach the driver
    tops = sorted(rows.groupBy("block").agg(F.max("key").alias("key")).collect())
    if not tops:
        return rows.withColumn("borrowed", F.lit(0))
    before = {block: tops[i - 1]["block"] for i, (block, _) in enumerate(tops)}
    # the block whose last row is followed by the first row of `block`
    lends = [(block, key, next(b for b, p in before.items() if p == block)) for block, key in tops]
    lent = spark.createDataFrame(lends, "block int, key long, to int")
    heads = rows.join(F.broadcast(lent), ["block", "key"]).groupBy("to").agg(F.min(F.struct("text", "id")).alias("head"))
    extra = heads.select(F.col("to").alias("block"), F.lit(FIRST).alias("key"), "head.id", "head.text", F.lit(1).alias("borrowed"))
    both = rows.withColumn("borrowed", F.lit(0)).unionByName(extra)
    return (both.repartition(partitions(spark), "block")
            .sortWithinPartitions("block", "borrowed", F.desc("key"), "text").drop("key"))


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as many first code points of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
          "near_next double, n_distinct double, contained_in_edited double")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness."""
    def finish(pairs: list[tuple], heads: list[tuple]) -> pa.RecordBatch:
        texts = [p[2] for p in pairs]
        changed = [edited(p[2], q[2]) for p, q in zip(pairs, heads, strict=True)]
        # the next row's sketch serves twice: as its own and as this row's neighbour
        own = sketch_arrays(pa.array([*texts, heads[-1][2]], pa.string()), k)
        near = [own[i + 1] if i + 1 < len(pairs) and heads[i] is pairs[i + 1] else None for i in range(len(pairs))]
        near[-1] = own.pop()
        missing = [i for i, x in enumerate(near) if x is None]
        if missing:
            for i, s in zip(missing, sketch_arrays(pa.array([heads[i][2] for i in missing], pa.string()), k), strict=True):
                near[i] = s
        new = sketch_arrays(pa.array(changed, pa.string()), k)
        columns = {
            "doc_id": pa.array([p[1] for p in pairs], pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
            "fingerprint": [as_text(a) for a in own], "edited_fingerprint": [as_text(a) for a in new],
            "near_edited": [resemblance(a, b, k) for a, b in zip(own, new, strict=True)],
            "near_next": [resemblance(a, b, k) for a, b in zip(own, near, strict=True)],
            "n_distinct": [distinct_count(a, k) for a in own],
            "contained_in_edited": [containment(a, b, k) for a, b in zip(own, new, strict=True)],
        }
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                pairs, heads = [], []
                part = whole.slice(at, 256)
                for row in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    if held is not None and held[0] == row[0] and not held[3]:
                        pairs.append(held)
                        heads.append(row)
                    held = row
                if pairs:
                    yield finish(pairs, heads)

    return with_next(docs, id_col, text_col).mapInArrow(run, SCHEMA)
