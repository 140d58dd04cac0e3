"""Importance resampling of documents towards a target corpus.

Features are runs of one to three words, counted in a fixed number of buckets.
The gain of a bucket is the log ratio of its smoothed shares in target and
source, and a document weighs the sum of its features' gains, looked up in one
array. With Gumbel noise drawn from the id, the k highest scores are a draw of
k documents without replacement. The k-th key is found by quickselect over the
scored table: random pivots, exact counts below, at and above each, and on with
the part that holds place k. Only the winners are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, stage
from tidemark.llm.words import LOWER, PUNCTUATION, Words, buffers, slices

BUCKETS = 10_000
LONGEST = 3
#: pivots of one counting pass; a pass leaves about one part in so many
PIVOTS = 32
#: words beyond this length are hashed one by one, not by columns of bytes
LONG_WORD = 64
#: the register's own table: crc32 of one byte without the inversions at start and end
TABLE = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)


def _shifts(limit: int) -> np.ndarray:
    """``[n, j, b]``: what byte j of a register, being b, becomes after n zero bytes."""
    out = np.zeros((limit + 1, 4, 256), np.uint32)
    for j in range(4):
        value = np.arange(256, dtype=np.uint32) << np.uint32(8 * j)
        for n in range(limit + 1):
            out[n, j] = value
            value = TABLE[value & 255] ^ (value >> np.uint32(8))
    return out


SHIFTS = _shifts(LONG_WORD)


def _joined(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of two byte strings one after the other, from theirs and the length of the second."""
    out = right.copy()
    for j in range(4):
        out ^= SHIFTS[size, j, (left >> np.uint32(8 * j)) & np.uint32(255)]
    return out


def _word_crcs(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """crc32 and byte length of each word, in lower case."""
    raw, size = LOWER[w.raw], w.ends - w.starts
    register = np.full(len(size), 0xFFFFFFFF, np.uint32)
    live = np.flatnonzero(size <= LONG_WORD)
    for k in range(int(size[live].max(initial=0))):
        live = live[size[live] > k]
        r = register[live]
        register[live] = TABLE[(r ^ raw[w.starts[live] + k]) & 255] ^ (r >> np.uint32(8))
    crc = register ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > LONG_WORD):
        crc[i] = zlib.crc32(raw[w.starts[i] : w.ends[i]].tobytes())
    return crc, size


def features(w: Words, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each run length: first word's place and crc32 of every run inside a document."""
    raw = LOWER[w.raw]
    crc, size = _word_crcs(w)
    blank = np.uint32(zlib.crc32(b" "))
    n = len(crc)
    doc = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
    run, first = crc, np.arange(n)
    yield first, run
    for k in range(1, longest):
        first = first[:-1] if len(first) else first
        whole = doc[first] == doc[first + k] if len(first) else np.zeros(0, bool)
        # runs lie at their first word's place; those that leave the document go
        last = first + k
        spaced = _joined(run[: len(first)], np.full(len(first), blank), np.ones(len(first), np.int64))
        run = _joined(spaced, crc[last], np.minimum(size[last], LONG_WORD))
        for i in np.flatnonzero(whole & (size[last] > LONG_WORD)):
            words = (raw[w.starts[t] : w.ends[t]].tobytes() for t in range(first[i], last[i] + 1))
            run[i] = zlib.crc32(b" ".join(words))
        yield first[whole], run[whole]


def _counted(longest: int, n_buckets: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(n_buckets, np.int64)
        for batch in batches:
            raw, offs = buffers(batch.column(0))
            for i, j in slices(offs):
                for _, crc in features(Words(raw, offs, i, j, PUNCTUATION), longest):
                    totals += np.bincount(crc % np.uint32(n_buckets), minlength=n_buckets)
        seen = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(totals[seen])], ["bucket", "n"])

    return step


def bucket_counts(docs: DataFrame, text_col: str = "text", longest: int = LONGEST, n_buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: features of all texts by bucket. Each task sends at most one row a bucket."""
    part = docs.select(text_col).mapInArrow(_counted(longest, n_buckets), "bucket long, n long")
    return part.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """Integer gain of each bucket. Only ``n_buckets`` numbers reach the driver, whatever the corpus."""
    counts = []
    for df in (source, target):
        found = np.zeros(n_buckets, np.int64)
        for r in df.collect():
            found[r["bucket"]] = r["n"]
        counts.append([float(x) for x in found])
    total_s, total_t = sum(counts[0]), sum(counts[1])
    return np.array([
        math.floor(1000 * math.log((t + 1) * (total_s + n_buckets) / ((s + 1) * (total_t + n_buckets))))
        for s, t in zip(*counts, strict=True)], np.int64)


def _weighed(gains: np.ndarray, longest: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = buffers(batch.column(1))
            n = batch.num_rows
            words, many, weight = (np.zeros(n, np.int64) for _ in range(3))
            for i, j in slices(offs):
                w = Words(raw, offs, i, j, PUNCTUATION)
                words[i:j] = np.diff(w.bounds)
                for first, crc in features(w, longest):
                    running = np.zeros(len(crc) + 1, np.int64)
                    np.cumsum(gains[crc % np.uint32(len(gains))], out=running[1:])
                    at = np.searchsorted(first, w.bounds)
                    many[i:j] += np.diff(at)
                    weight[i:j] += np.diff(running[at])
            columns = [batch.column(0), pa.array(words), pa.array(many), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_features", "weight"])

    return step


def _below(key: tuple) -> Column:
    """Rows whose key comes before the given one."""
    score, doc, row = F.col("score"), F.col("id"), F.col("row")
    return (score > key[0]) | ((score == key[0]) & ((doc < key[1]) | ((doc == key[1]) & (row < key[2]))))


def _at(key: tuple) -> Column:
    return (F.col("score") == key[0]) & (F.col("id") == key[1]) & (F.col("row") == key[2])


def select_key(scored: DataFrame, k: int, pivots: int = PIVOTS) -> tuple:
    """The k-th key (from 1) of ``score`` descending, ``id``, ``row``, by distributed quickselect.

    ``row`` makes keys unique. Each pass draws random rows of the part still open
    as pivots, counts the rows before, at and between them in one aggregation of at
    most ``2 * pivots + 1`` groups, and keeps the part that holds place k.
    """
    low = high = None  # keys that bound the open part, themselves outside it
    before = 0  # rows up to and with ``low``
    turn = 0
    while True:
        part = scored
        if low is not None:
            part = part.filter(~_below(low) & ~_at(low))
        if high is not None:
            part = part.filter(_below(high))
        drawn = part.select("score", "id", "row").orderBy(F.xxhash64(F.lit(turn), "row"), "row").limit(pivots).collect()
        keys = sorted((tuple(r) for r in drawn), key=lambda x: (-x[0], x[1], x[2]))
        if not keys:
            raise ValueError(f"there is no place {k}")
        place = sum((F.when(_below(p), 0).when(_at(p), 1).otherwise(2) for p in keys), F.lit(0))
        counts = {r["place"]: r["n"] for r in part.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for i, key in enumerate(keys):
            ahead = counts.get(2 * i, 0)  # between the pivot before and this one
            if before + ahead >= k:
                high = key
                break
            before += ahead + counts.get(2 * i + 1, 0)
            if before >= k:
                return key
            low = key
        turn += 1


def ranked(rows: DataFrame) -> DataFrame:
    """``rank`` from 1 in key order: ranges sorted each by itself, with the sizes of those before."""
    n = partitions(rows.sparkSession)
    ranged = rows.repartitionByRange(n, F.col("score").desc(), "id", "row").withColumn("part", F.spark_partition_id())
    ranged = stage(ranged, "winners")
    sizes = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    start, starts = 0, []
    for p in range(n):
        starts.append(F.lit(start))
        start += sizes.get(p, 0)
    inside = Window.partitionBy("part").orderBy(F.col("score").desc(), "id", "row")
    return ranged.withColumn("rank", F.row_number().over(inside) + F.array(*starts)[F.col("part")]).drop("part")


def resampled(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
    percent: int = 5, least_words: int = 20, seed: int = 42, longest: int = LONGEST, n_buckets: int = BUCKETS,
) -> DataFrame:
    """``<id_col>, n_features, weight, score, rank`` of every row; ``rank`` is null where not drawn.

    ``percent`` of the rows of at least ``least_words`` words are drawn (rounded
    down). Null and empty texts have no features and weight 0. A row without id has
    no score and is never drawn nor counted among those to draw from. Equal scores
    go by id, repeated rows of one id by their place in the staged table; an empty
    table gives an empty result, an empty target gains by the source alone. Columns
    but id and text are not read, so their names can't clash.
    """
    kind = docs.schema[id_col].dataType
    gains = bucket_gains(bucket_counts(docs, text_col, longest, n_buckets), bucket_counts(target, target_text_col, longest, n_buckets), n_buckets)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    weighed = rows.mapInArrow(_weighed(gains, longest), "id long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    noise = F.floor(-1000 * F.log(-F.log(uniform)))
    scored = stage(weighed.select("*", (F.col("weight") + noise).alias("score"), F.monotonically_increasing_id().alias("row")), "scored")
    open_rows = scored.filter((F.col("n_words") >= least_words) & F.col("score").isNotNull())
    k = percent * open_rows.count() // 100
    out = [F.col("id").cast(kind).alias(id_col), "n_features", "weight", "score"]
    if not k:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    last = select_key(open_rows, k)
    drawn = (F.col("n_words") >= least_words) & F.col("score").isNotNull() & (_below(last) | _at(last))
    winners = ranked(scored.filter(drawn)).select(*out, F.col("rank").cast("long").alias("rank"))
    others = scored.filter(~F.coalesce(drawn, F.lit(False))).select(*out, F.lit(None).cast("long").alias("rank"))
    return winners.unionByName(others)
