"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are compared without case and punctuation. A benchmark item's n-grams are
looked up in every document; how many documents hold each n-gram is counted over
all documents. An item's seeds are its n-grams that at most ``common`` of the
documents hold, and in any case those no commoner than their median (ties included)
and the rarer half of every four neighbours, so an item that leaked into very many
documents keeps seeds in all its parts. Around its seeds a passage is aligned with
the item (local alignment, a match scores 1, a mismatch or gap -1/2, a repeated
n-gram is met on every diagonal); the score divided by the item's length decides.

The benchmark reaches the workers in blocks of bounded text, one pass over the
documents for each block, so its size is not limited; in practice it is one.

Defined cases: null or empty texts and items match nothing, items of fewer than
n words are too short to seed and match nothing; of items with equal words all
are reported; repeated rows and rows without id are aligned like others. Other
columns of any name ride along unread; one called ``leaks`` comes back as ``leaks_given``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_of
from tidemark.llm.words import PUNCTUATION, Words, buffers, slices

N = 3
#: share of the documents above which an n-gram is no seed, unless it is among the rarer ones of its item or of its four neighbours
COMMON = 0.0005
AT_LEAST = 0.5
MISS = 0.5
#: bytes of benchmark text sent to the workers at a time
BLOCK_BYTES = 4_000_000


class Items:
    """One block of benchmark items: word hashes and a sorted n-gram table."""

    def __init__(self, ids: list, texts: list[str], n: int = N):
        raw, offs = buffers(pa.array(texts, pa.large_string()))
        self.ids, self.words, self.n = ids, [], n
        grams, owners, places = [], [], []
        for i, j in slices(offs):
            w = Words(raw, offs, i, j, PUNCTUATION)
            g, b = w.shingles(n, short=False)
            for d in range(j - i):
                own = g[b[d] : b[d + 1]]
                self.words.append(w.hashes[w.bounds[d] : w.bounds[d + 1]])
                grams.append(own)
                owners.append(np.full(len(own), i + d))
                places.append(np.arange(len(own)))
        gram, owner, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (grams, owners, places))
        order = np.argsort(gram, kind="stable")
        self.gram, self.owner, self.place = gram[order], owner[order], place[order]
        self.distinct = np.unique(self.gram)

    def keep_rare(self, df: np.ndarray, most: float) -> None:
        """Leave the seeds.

        They are the n-grams in at most ``most`` documents, those no commoner than the
        median of their item, ties included, and the rarer half of every four neighbours.
        """
        count = df[np.searchsorted(self.distinct, self.gram)]
        size = np.bincount(self.owner, minlength=len(self.words))
        start = np.cumsum(size) - size
        by_count = np.lexsort((count, self.owner))
        median = np.zeros(len(size), count.dtype)
        some = size > 0
        median[some] = count[by_count][(start + size // 2)[some]]
        # places of one item are numbered from 0, so every four neighbours are a block
        order = np.lexsort((self.place, count, self.place // 4, self.owner))
        own, block = self.owner[order], self.place[order] // 4
        first = np.r_[True, (own[1:] != own[:-1]) | (block[1:] != block[:-1])] if len(order) else np.zeros(0, bool)
        at = np.arange(len(order))
        rank = np.empty(len(order), np.int64)
        rank[order] = at - np.maximum.accumulate(np.where(first, at, 0))
        keep = (count <= most) | (count <= median[self.owner]) | (rank < 2)
        self.gram, self.owner, self.place = self.gram[keep], self.owner[keep], self.place[keep]
        self.distinct = np.unique(self.gram)


def found(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values that are in the sorted table, and where in the table."""
    if not len(table) or not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    hit = np.flatnonzero(table[at] == values)
    return hit, at[hit]


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment score of two word sequences, and its word range in the text."""
    m = len(text)
    gap = MISS * np.arange(m + 1)
    row, begin = np.zeros(m + 1), np.arange(m + 1)
    best, span = 0.0, (0, 0)
    for word in item:
        step = np.where(text == word, 1.0, -MISS)
        over = row[:-1] + step
        down = row - MISS
        new, start = np.zeros(m + 1), np.arange(m + 1)
        better = down > new
        new[better], start[better] = down[better], begin[better]
        better = np.flatnonzero(over > new[1:]) + 1
        new[better], start[better] = over[better - 1], begin[better - 1]
        # gaps in the item: the best earlier cell, less the gap up to here
        lifted = new + gap
        peak = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted >= peak, np.arange(m + 1), 0))
        gained = peak - gap > new
        start[gained] = start[source[gained]]
        new[gained] = (peak - gap)[gained]
        row, begin = new, start
        top = int(np.argmax(row))
        if row[top] > best:
            best, span = float(row[top]), (int(begin[top]), top)
    return best, *span


def matches(words: np.ndarray, grams: np.ndarray, items: Items, at_least: float = AT_LEAST) -> list[tuple]:
    """(item id, score, first word, word after the last) of each item the words hold a copy of."""
    hit, where = found(items.distinct, grams)
    if not len(hit):
        return []
    low = np.searchsorted(items.gram, items.distinct[where], "left")
    many = np.searchsorted(items.gram, items.distinct[where], "right") - low
    ramp = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    entry = np.repeat(low, many) + ramp
    owner, diagonal = items.owner[entry], np.repeat(hit, many) - items.place[entry]
    out = []
    order = np.lexsort((diagonal, owner))
    owner, diagonal = owner[order], diagonal[order]
    for o in np.unique(owner).tolist():
        item = items.words[o]
        size = len(item)
        slack = size // 2 + 1
        own = np.unique(diagonal[np.searchsorted(owner, o) : np.searchsorted(owner, o, "right")])
        # passages of nearby diagonals are aligned together
        cuts = np.flatnonzero(np.diff(own) > slack) + 1
        best: tuple | None = None
        for part in np.split(own, cuts):
            a, b = max(0, int(part[0]) - slack), min(len(words), int(part[-1]) + size + slack)
            text = words[a:b]
            # no alignment scores more than the words in common
            if np.isin(item, text).sum() < at_least * size:
                continue
            score, s, e = align(item, text)
            if best is None or score / size > best[1]:
                best = (items.ids[o], score / size, a + s, a + e)
        if best is not None and best[1] >= at_least:
            out.append(best)
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[Items]:
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, math.ceil(size / block_bytes))
    for b in range(count):
        got = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == b).toArrow()
        items = sorted(zip(got["id"].to_pylist(), got["text"].to_pylist(), strict=True), key=lambda x: (x[0] is None, x))
        yield Items([i for i, _ in items], [t for _, t in items])


def with_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                 at_least: float = AT_LEAST, common: float = COMMON, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` plus ``leaks``: array of (item, score, first_word, last_word)."""
    spark, docs = docs.sparkSession, free_of(docs, "leaks")
    texts = docs.select(F.col(text_col).alias("text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    leak = "array<struct<item:bigint,score:double,first_word:bigint,last_word:bigint>>"
    leak_type = pa.list_(pa.struct([("item", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))
    rows = rows.withColumn("leaks", F.lit(None).cast(leak))
    for items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        if not len(items.gram):
            continue

        def counted(batches: Iterator[pa.RecordBatch], table=items.distinct) -> Iterator[pa.RecordBatch]:
            df, seen = np.zeros(len(table), np.int64), 0
            for batch in batches:
                seen += batch.num_rows
                raw, offs = buffers(batch.column(0))
                for i, j in slices(offs):
                    grams, bounds = Words(raw, offs, i, j, PUNCTUATION).shingles(N, short=False)
                    hit, where = found(table, grams)
                    doc = np.searchsorted(bounds, hit, "right")
                    pairs = np.unique(doc * len(table) + where)
                    df += np.bincount(pairs % len(table), minlength=len(table))
            hit = np.flatnonzero(df)
            yield pa.RecordBatch.from_pydict({"place": np.concatenate([[-1], hit]), "df": np.concatenate([[seen], df[hit]])})

        # one row per n-gram of the block from each task; the block is bounded
        counts = {r["place"]: r["df"] for r in texts.mapInArrow(counted, "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).collect()}
        df = np.array([counts.get(i, 0) for i in range(len(items.distinct))])
        items.keep_rare(df, max(1, common * counts.get(-1, 0)))
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                before = batch.column(1).to_pylist()
                raw, offs = buffers(batch.column(0).field(text_col))
                for i, j in slices(offs):
                    w = Words(raw, offs, i, j, PUNCTUATION)
                    grams, bounds = w.shingles(N, short=False)
                    for d in range(j - i):
                        got = matches(w.hashes[w.bounds[d] : w.bounds[d + 1]], grams[bounds[d] : bounds[d + 1]], own, at_least)
                        if got:
                            before[i + d] = (before[i + d] or []) + [dict(zip(("item", "score", "first_word", "last_word"), g, strict=True)) for g in got]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(before, leak_type)], names=["row", "leaks"])

        rows = rows.mapInArrow(run, f"row {kind}, leaks {leak}")
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], "leaks")
