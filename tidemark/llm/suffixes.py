"""Suffix-array dedup: every byte under a 50-byte string that an earlier document also has.

1. Anchors. In each 50-byte window the 18-byte string with the smallest hash is
   its anchor; equal windows have equal anchors. The windows of one anchor are
   consecutive and make a context of some 66 bytes. A row per anchor goes through
   one shuffle. A context that an earlier document has as a whole is covered.
2. Contexts that share an anchor with an earlier document but differ as wholes
   are fetched from their documents and go, by anchor, into blocks of bounded
   size. A block's suffix array is built in two stages: suffixes smaller than
   their successor are sorted directly, the others are induced by scanning the
   buckets from the smallest up; neighbours in the array are then compared over
   50 bytes. Windows equal to one of an earlier document are covered. An anchor
   with more contexts than a block hands on the hashes of its windows.
3. Covered ranges go back to their documents.

Defined cases: null and empty texts have no bytes; texts under 50 bytes lose
nothing; rows without id come after all others and, having no order among
themselves, don't cover each other; the same holds for rows that share an id.
Repeated rows get equal results. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, stage
from tidemark.llm.words import buffers, mix, powers, slices

LENGTH, GRAM = 50, 18
REACH = LENGTH - GRAM + 1
LAST = 2**63 - 1
#: bytes of contexts whose suffixes are sorted at a time
BLOCK_BYTES = 1 << 20
#: never part of UTF-8
STOP = 0xFF


def anchors(raw: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor and context hashes, document, first byte and size of each context of a slice."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    power, inverse = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    gram = mix((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1])
    bits = max(int(n).bit_length(), 1)
    low = np.uint64((1 << bits) - 1)
    key = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    least, span = key, 1
    while 2 * span <= REACH:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < REACH:
        least = np.minimum(least[: n - LENGTH + 1], least[REACH - span : REACH - span + n - LENGTH + 1])
    size = np.diff(docs)
    many = np.maximum(size - LENGTH + 1, 0)
    begins = np.cumsum(many) - many
    window = np.repeat(docs[:-1] - begins, many) + np.arange(many.sum())
    if not len(window):
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    chosen = (least[window] & low).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (window[1:] != window[:-1] + 1)
    at = np.flatnonzero(new)
    start = window[at]
    end = window[np.append(at[1:], len(window)) - 1] + LENGTH
    context = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    doc = np.searchsorted(docs, start, "right") - 1
    # the hash is of the anchor's place within its context, too: equal contexts have it at the same place
    return gram[chosen[at]], context, doc, start - docs[doc], end - start


def suffix_array(text: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Order of all suffixes by at least their first 56 bytes, built in two stages.

    ``words[i]`` holds bytes i .. i + 7, most significant first.
    """
    n = len(text)
    step = np.sign(np.append(text[1:].astype(np.int16), -1) - text)
    # equal neighbours have the type of the next unequal place
    at = np.where(step != 0, np.arange(n), n - 1)
    kind = step[np.minimum.accumulate(at[::-1])[::-1]]
    small = np.flatnonzero(kind > 0)
    # stage one: sort the suffixes that are smaller than their successor, eight bytes at a time
    order = small[np.argsort(words[small], kind="stable")]
    group = np.zeros(len(order), np.int64)
    if len(order):
        group[1:] = np.cumsum(words[order[1:]] != words[order[:-1]])
    for depth in range(8, 56, 8):
        tied = np.zeros(len(order), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        where = np.flatnonzero(tied)
        if not len(where):
            break
        inner = order[where]
        deep = words[np.minimum(inner + depth, len(words) - 1)]
        again = np.lexsort((deep, group[where]))
        order[where] = inner[again]
        deep, old = deep[again], group[where]
        fresh = np.ones(len(order), bool)
        fresh[1:] = group[1:] != group[:-1]
        fresh[where[1:]] |= (deep[1:] != deep[:-1]) & (old[1:] == old[:-1])
        group = np.cumsum(fresh)
    # stage two: scan buckets upward; a scanned suffix places its larger predecessor
    first = text[order]
    ends = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def place(scanned: np.ndarray, own: int) -> np.ndarray:
        before = scanned[scanned > 0] - 1
        before = before[kind[before] < 0]
        heads = text[before]
        by = np.argsort(heads, kind="stable")
        before, heads = before[by], heads[by]
        cut = np.flatnonzero(np.diff(heads)) + 1
        mine = before[:0]
        for part in np.split(before, cut) if len(before) else []:
            if (c := int(text[part[0]])) == own:
                mine = part
            else:
                waiting[c].append(part)
        return mine

    if n:
        waiting[int(text[-1])].append(np.array([n - 1]))
    for c in range(256):
        front = np.concatenate(waiting[c]) if waiting[c] else order[:0]
        while len(front):
            out.append(front)
            front = place(front, c)
        if ends[c] < ends[c + 1]:
            out.append(order[ends[c] : ends[c + 1]])
            place(out[-1], c)
    return np.concatenate(out) if out else order


def repeated_windows(contexts: list[np.ndarray], docs: np.ndarray, known: np.ndarray, want: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, offset) of the windows that an earlier document has, and hashes of all windows if wanted.

    ``known`` are sorted window hashes of earlier documents, handed on from blocks before.
    """
    size = np.array([len(c) for c in contexts])
    start = np.cumsum(size + 1) - size - 1
    text = np.full(int((size + 1).sum()), STOP, np.uint8)
    owner = np.repeat(np.arange(len(contexts)), size + 1)
    offset = np.arange(len(text)) - start[owner]
    text[offset < size[owner]] = np.concatenate(contexts)
    padded = np.concatenate([text, np.zeros(64, np.uint8)]).astype(np.uint64)
    words = np.zeros(len(padded) - 7, np.uint64)
    for b in range(8):
        words |= padded[b : len(words) + b] << np.uint64(56 - 8 * b)
    whole = offset + LENGTH <= size[owner]
    order = suffix_array(text, words)
    order = order[whole[order]]
    if not len(order):
        return order, order, np.zeros(0, np.uint64)
    # neighbours with a common prefix of at least 50 bytes: six words and the one that ends at byte 50
    alike = np.ones(len(order) - 1, bool)
    for depth in (0, 8, 16, 24, 32, 40, LENGTH - 8):
        at = words[order + depth]
        alike &= at[1:] == at[:-1]
    run = np.concatenate([[0], np.cumsum(~alike)])
    heads = np.flatnonzero(np.concatenate([[True], ~alike]))
    doc = docs[owner[order]]
    hit = doc > np.minimum.reduceat(doc, heads)[run]
    marks = np.zeros(0, np.uint64)
    if want or len(known):
        power, inverse = powers(len(text) + 1)
        total = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[: len(text)], out=total[1:])
        marks = mix((total[order + LENGTH] - total[order]) * inverse[order])
        if len(known):
            hit |= known[np.minimum(np.searchsorted(known, marks), len(known) - 1)] == marks
    return owner[order[hit]], offset[order[hit]], marks


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, tag, text): the tag tells rows of one id apart, and is 0 where ids are unique."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    unique = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    return rows.withColumn("tag", F.lit(0).cast("long") if unique else F.xxhash64("text")).select("doc", "tag", "text")


def _anchor_rows(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = buffers(batch.column(2))
            for i, j in slices(offs):
                gram, context, doc, start, size = anchors(raw[offs[i] : offs[j]], (offs[i : j + 1] - offs[i]).astype(np.int64))
                index = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), batch.column(0).take(index), batch.column(1).take(index),
                                                  pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], names=["anchor", "context", "doc", "tag", "start", "size"])

    return rows.mapInArrow(run, "anchor long, context long, doc long, tag long, start int, size int")


def _fetched(rows: DataFrame, open_rows: DataFrame) -> DataFrame:
    """The bytes of the given contexts: (anchor, doc, tag, start, bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, tag, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                data = text.encode()
                for w in wanted:
                    for held, value in zip(out, (w["anchor"], doc, tag, w["start"], data[w["start"] : w["start"] + w["size"]]), strict=True):
                        held.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()),
                                              pa.array(out[4], pa.binary())], names=["anchor", "doc", "tag", "start", "bytes"])

    # contexts of one document: their number is bounded by its length
    lists = open_rows.groupBy("doc", "tag").agg(F.collect_list(F.struct("anchor", "start", "size")).alias("wanted"))
    joined = rows.join(lists, ["doc", "tag"]).select("doc", "tag", "text", "wanted")
    return joined.mapInArrow(run, "anchor long, doc long, tag long, start int, bytes binary")


def _compared(contexts: DataFrame) -> DataFrame:
    """Covered ranges (doc, tag, start, stop) among contexts dealt and sorted by anchor."""
    def solve(held: list[tuple], known: np.ndarray, want: bool):
        arrays = [np.frombuffer(h[4], np.uint8) for h in held]
        docs = np.array([h[1] for h in held], np.int64)
        owner, offset, marks = repeated_windows(arrays, docs, known, want)
        by = np.lexsort((offset, owner))
        owner, offset = owner[by], offset[by]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(owner)) - 1 if len(at) else at
        who = owner[at]
        start = np.array([h[3] for h in held], np.int64)[who] if len(who) else who
        tags = np.array([h[2] for h in held], np.int64)
        batch = pa.RecordBatch.from_arrays([pa.array(docs[who]), pa.array(tags[who]), pa.array((start + offset[at]).astype(np.int32)),
                                            pa.array((start + offset[last] + LENGTH).astype(np.int32))], names=["doc", "tag", "start", "stop"])
        return batch, marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total, known, open_anchor = 0, np.zeros(0, np.uint64), None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if held and total >= BLOCK_BYTES and (row[0] != held[-1][0] or row[1] != held[-1][1]):
                    # rows of an anchor come by document, so what went before is from earlier ones
                    goes_on = row[0] == held[-1][0]
                    done, marks = solve(held, known if held[0][0] == open_anchor else known[:0], goes_on)
                    yield done
                    if goes_on:
                        same = held[0][0] == open_anchor == row[0]
                        known = np.union1d(known, marks) if same else np.unique(marks)
                        open_anchor = row[0]
                    else:
                        known, open_anchor = known[:0], None
                    held, total = [], 0
                held.append(row)
                total += len(row[4])
        if held:
            yield solve(held, known if held[0][0] == open_anchor else known[:0], False)[0]

    n = partitions(contexts.sparkSession)
    dealt = contexts.repartition(n, "anchor").sortWithinPartitions("anchor", "doc")
    return dealt.mapInArrow(run, "doc long, tag long, start int, stop int")


def covered(rows: DataFrame) -> DataFrame:
    """Covered ranges (doc, tag, start, stop) of (doc, tag, text) rows; they may overlap."""
    same, every = Window.partitionBy("anchor", "context"), Window.partitionBy("anchor")
    found = _anchor_rows(rows).repartition(partitions(rows.sparkSession), "anchor")
    found = found.withColumn("first", F.min("doc").over(same)).withColumns({
        "low": F.min("doc").over(every), "high": F.max("doc").over(every), "one": F.min("context").over(every) == F.max("context").over(every)})
    found = found.filter("low < high AND (doc > first OR NOT one)").withColumn("whole", F.col("doc") > F.col("first"))
    found = stage(found.select("anchor", "doc", "tag", "start", "size", "whole"), "anchors")
    whole = found.filter("whole").select("doc", "tag", "start", (F.col("start") + F.col("size")).alias("stop"))
    rest = _compared(_fetched(rows, found.filter("NOT whole")))
    return whole.unionByName(stage(rest, "ranges"))


def _applied(docs: DataFrame, id_col: str, text_col: str, schema: str, make) -> DataFrame:
    rows = _keyed(docs, id_col, text_col)
    ranges = covered(rows)
    # ranges of one document: their number is bounded by its length
    lists = ranges.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = []
                for doc, text, ranges in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    spans: list[list[int]] = []
                    for a, b in sorted((r["start"], r["stop"]) for r in ranges or ()):
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], b)
                        else:
                            spans.append([a, b])
                    out.append((None if doc == LAST else doc, *make(text.encode(), spans)))
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) if i else pa.array(list(c), pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names=names)

    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    joined = rows.join(lists, ["doc", "tag"], "left").select("doc", "text", "ranges")
    return joined.mapInArrow(run, schema).withColumnRenamed(names[0], id_col)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``kept``: the bytes that remain of each document."""
    def make(data: bytes, spans: list[list[int]]) -> tuple:
        return (_kept(data, spans),)

    return _applied(docs, id_col, text_col, "id long, kept binary", make)


def _kept(data: bytes, spans: list[list[int]]) -> bytes:
    cuts = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``deduplicated`` with the bytes replaced by counts and a digest in the task itself."""
    def make(data: bytes, spans: list[list[int]]) -> tuple:
        return len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_kept(data, spans)).hexdigest()

    return _applied(docs, id_col, text_col, "id long,n_bytes long,n_removed long,n_spans long,kept_sha256 string", make)
