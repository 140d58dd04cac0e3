"""Exact n-gram Jaccard join in a metric space of shingle sets.

Documents with equal sets are one class. Jaccard distance between sets is a
metric; two classes link when it is at most r = 1 - threshold.

1. First regions. Distance to any unrelated set is 1, so distances to sampled
   sets separate nothing at first. The first regions are therefore cut by the
   bound that the distance limit puts on the symmetric difference: at sizes up
   to U linked sets differ in at most D = floor((1-t)/(1+t) * 2U) shingles, so of
   D + 1 + s parts of the hash range at least s + 1 hold the same shingles. Each
   part's content names a region. Sizes are cut into rings around the empty set;
   a set within the size window of the next ring is replicated there. A set that shares
   fewer parts than that with all others together has no links and goes no further.
2. Voronoi regions. In a region of more than a few sets, pivots are drawn and
   all distances to them computed (which settles the pivots' own links); a set
   belongs to its nearest pivot, and by the triangle inequality a set whose
   distance to another pivot is at most 2r more is replicated there.
3. Recursion. A region whose sets are all connected already is settled, a small
   one is compared pair by pair, those of up to LEAF sets with one smallest set in
   products of them all (once the first pivots have settled what they can, so few sets
   travel), a larger one gets new pivots inside its cells.
   Once pivots no longer halve what is left (many sets, all a little too far
   from each other), the cells that share sets become one clump, and all pairs
   of a clump are compared block by block; nothing is left out.

Connectivity is kept whole; links inside a settled region are not enumerated.
Hashes have 64 bits; set sizes and overlaps are of these hashes.

Defined cases: null and empty texts have no set and link with nothing; fewer
words than a shingle count as one shingle; rows without id keep their row and
never lend their id to a component; repeated rows are equal sets. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BATCH, among, partitions, setting, stage
from tidemark.llm.components import components
from tidemark.llm.words import Words, buffers, mix, sets, slices

WORDS, PERCENT = 4, 85
#: regions up to PAIRED are compared pair by pair, up to LEAF in one task; pivots of a larger one
PAIRED, LEAF, PIVOTS = 8, 64, 3
RING = 1.4
#: bits of the filter that spares sets without any partner; its size is fixed
FILTER_BITS = 1 << 25
#: sets a task remembers to emit the parts of equal sets once
SEEN = 1_000_000
#: texts that travel to a Python worker at once
TEXTS = 1000
#: members of a block and columns of a product when a clump is compared
BLOCK, CHUNK = 256, 4096
#: passes in which sets travel to be compared, so that not all copies of sets are on the disk at once, and the
#: rows from which there is another one
PASSES, ENOUGH = 4, 20_000


def rings(top: int) -> np.ndarray:
    """Lower ends of the size rings, up to above ``top``."""
    ends = [1]
    while ends[-1] <= top:
        ends.append(max(ends[-1] + 1, int(ends[-1] * RING)))
    ends.append(max(ends[-1] + 1, int(ends[-1] * RING)))
    return np.array(ends)


def parts(hashes: np.ndarray, ends: np.ndarray, percent: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Names of the parts of one sorted set, in its ring and where its size reaches into the next.

    With each the number of named parts in that ring that any linked set has in common with it at least.
    """
    n = len(hashes)
    own = int(np.searchsorted(ends, n, "right")) - 1
    out, need = [], []
    if seed:
        hashes = np.sort(mix(hashes ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(hashes), out=total[1:])
    high = hashes >> np.uint64(32)
    for ring in (own, own + 1) if 100 * n >= percent * ends[own + 1] else (own,):
        most = (100 - percent) * 2 * int(ends[ring + 1] - 1) // (100 + percent)
        slack = 2 + most // 8 if most else 0
        m = most + 1 + slack
        bounds = np.searchsorted((high * np.uint64(m)) >> np.uint64(32), np.arange(m + 1))
        size = np.diff(bounds)
        name = mix(total[bounds[1:]] - total[bounds[:-1]] + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                   + np.arange(m).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(ring * 0x9FB21C651E98DF25 & (1 << 64) - 1))
        # agreeing on empty parts alone takes more than `slack` of them
        empty = int((size == 0).sum())
        out.append(name if empty > slack else name[size > 0])
        # of the parts that agree, those empty in both sets have no name unless both have more than `slack` empty ones
        need.append(np.full(len(out[-1]), slack + 1 - min(empty, slack), np.int32))
    return np.concatenate(out), np.concatenate(need)


def _set_hash(h: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ np.uint64(0xC2B2AE3D27D4EB4F)), out=total[1:])
    return mix(total[b[1:]] - total[b[:-1]] + np.diff(b).astype(np.uint64)).view(np.int64)


def _each(column: pa.Array, words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted sets, bounds and set hashes, slice by slice."""
    raw, offs = buffers(column)
    for i, j in slices(offs):
        h, b = sets(*Words(raw, offs, i, j).shingles(words))
        yield h, b, _set_hash(h, b)


def set_table(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id, n_shingles and set_hash (null without shingles) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(np.diff(b), k) for _, b, k in _each(batch.column(1), words)]
            n = np.concatenate([g[0] for g in got]) if got else np.zeros(0, np.int64)
            key = np.concatenate([g[1] for g in got]) if got else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.int64(), mask=n == 0)], names=["id", "n_shingles", "set_hash"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_shingles long, set_hash long")


def _part_rows(docs: DataFrame, text_col: str, words: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        ends = rings(1 << 12)
        for batch in batches:
            for h, b, keys in _each(batch.column(0), words):
                if (top := int(np.diff(b).max(initial=0))) >= ends[-2]:
                    ends = rings(top)
                names, owners, needs = [], [], []
                for d, key in enumerate(keys.tolist()):
                    if b[d] < b[d + 1] and key not in seen:
                        seen.add(key)
                        name, need = parts(h[b[d] : b[d + 1]], ends, percent)
                        names.append(name)
                        needs.append(need)
                        owners.append(np.full(len(name), key))
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names).view(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(needs))], names=["region", "member", "need"])
            if len(seen) > SEEN:
                seen.clear()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "region long, member long, need int")


def _enough(shared: DataFrame) -> DataFrame:
    """Rows (region, member) of the sets that share as many parts in a ring as a linked set would have in common."""
    kept = shared.groupBy("member", "need").agg(F.count(F.lit(1)).alias("n")).filter("n >= need").select("member", "need")
    return shared.join(kept, ["member", "need"]).select("region", "member")


def _sets_of(docs: DataFrame, text_col: str, words: int, members: DataFrame) -> DataFrame:
    """set_hash and sorted hashes of the wanted sets; a filter of fixed size spares the others the shuffle."""
    slot = F.pmod(F.xxhash64("set_hash"), F.lit(FILTER_BITS)).cast("long")
    bits = (members.select(slot.alias("slot")).selectExpr("slot div 64 AS word", "shiftleft(1L, CAST(slot % 64 AS INT)) AS bit")
            .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
    words_set = np.zeros(FILTER_BITS // 64, np.int64)
    words_set[bits["word"].to_numpy()] = bits["bits"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(words_set)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for h, b, keys in _each(batch.column(0), words):
                new = [d for d, key in enumerate(keys.tolist()) if b[d] < b[d + 1] and key not in seen and not seen.add(key)]
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array(keys[new]), pa.array([h[b[d] : b[d + 1]].tobytes() for d in new], pa.binary())], names=["set_hash", "hashes"])
            if len(seen) > SEEN:
                seen.clear()

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            keep = (table[at >> 6] >> (at & 63)) & 1 == 1
            yield batch.select([0, 1]).filter(pa.array(keep))

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(hashed, "set_hash long, hashes binary").withColumn("slot", slot)
    rows = rows.mapInArrow(wanted, "set_hash long, hashes binary")
    return rows.join(members, "set_hash", "left_semi").groupBy("set_hash").agg(F.any_value("hashes").alias("hashes"))


def _in_passes(rows: DataFrame, key: list[str], name: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``made`` of rows that are told apart by ``key``, in up to PASSES written parts; what a part shuffles goes at its end."""
    rows = stage(rows, f"{name}_rows")
    passes = min(PASSES, 1 + rows.count() // ENOUGH)
    place = F.pmod(F.xxhash64(F.lit(passes), *key), F.lit(passes))
    out = stage(made(rows.filter(place == 0)), name)
    for n in range(1, passes):
        out = out.unionByName(stage(made(rows.filter(place == n)), name))
    return out


def _measured(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sizes of intersection and union."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, union = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                shared.append(int((y[at] == x).sum()))
                union.append(len(x) + len(y) - shared[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "shared", "union"])

    def made(pairs: DataFrame) -> DataFrame:
        # only the sets of this part's pairs are dealt
        own = among(found, "set_hash", pairs.select(F.explode(F.array("a", "b")).alias("set_hash")))
        one = own.select(F.col("set_hash").alias("a"), F.col("hashes").alias("x"))
        two = own.select(F.col("set_hash").alias("b"), F.col("hashes").alias("y"))
        return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, shared long, union long")

    return _in_passes(pairs, ["a", "b"], "measured", made)


def _unsettled(regions: DataFrame) -> DataFrame:
    """Rows (region, member, label) of regions that still hold two components."""
    low = regions.groupBy("region").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size")).filter("low < high")
    return regions.join(low.select("region", "size"), "region")


def _labelled(regions: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return regions.withColumn("label", F.col("member"))
    named = labels.select(F.col("node").alias("member"), "label")
    return regions.join(named, "member", "left").withColumn("label", F.coalesce("label", "member"))


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := top.setdefault(x, x)) != x:
            top[x] = x = top[up]
        return x

    kept = []
    for x, y in links.tolist():
        fx, fy = find(x), find(y)
        if fx != fy:
            top[fx] = fy
            kept.append((x, y))
    return kept


def _overlaps(members: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a bounded number of sets, by products of 0/1 blocks."""
    n = len(members)
    column, where = np.unique(np.concatenate(members), return_inverse=True)
    row = np.repeat(np.arange(n), [len(m) for m in members])
    often = np.bincount(where, minlength=len(column)) > 1
    place = np.cumsum(often) - 1
    keep = often[where]
    row, where = row[keep], place[where[keep]]
    order = np.argsort(where, kind="stable")
    row, where = row[order], where[order]
    total = np.zeros((n, n), np.float64)
    for low in range(0, int(often.sum()), CHUNK):
        a, e = np.searchsorted(where, [low, low + CHUNK])
        block = np.zeros((n, CHUNK), np.float32)
        block[row[a:e], where[a:e] - low] = 1
        total += block @ block.T
    return total


def _joining(percent: int):
    """Links of a group of (member, label, hashes) that join components: a spanning forest of them."""
    def run(group):
        members = [np.frombuffer(h, np.uint64) for h in group["hashes"]]
        ids, labels = group["member"].to_numpy(), group["label"].to_numpy()
        size = np.array([len(m) for m in members], np.float64)
        shared = _overlaps(members)
        linked = (100 * shared >= percent * (size[:, None] + size[None, :] - shared)) & (labels[:, None] != labels[None, :])
        forest = _forest(np.argwhere(np.triu(linked, 1)))
        return pd.DataFrame({"a": ids[[x for x, _ in forest]], "b": ids[[y for _, y in forest]]}, dtype="int64")

    return run


def _together(regions: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components inside regions of up to LEAF sets.

    A set is in many regions of much the same sets, so those of one smallest set are united and
    compared as one clump: a set then travels once for them all. A clump holds no more sets than the
    regions of one set.
    """
    lowest = F.min("member").over(Window.partitionBy("region"))
    return _compared(regions.select(lowest.alias("clump"), "member", "label").distinct(), found, percent, "together")


def _compared(clumps: DataFrame, found: DataFrame, percent: int, name: str = "compared") -> DataFrame:
    """Links (a, b) that join components, from all pairs of each clump of (clump, member, label).

    Members are dealt to blocks; each pair of blocks of a clump is a group of at
    most twice the block size, and gives back no more than a spanning forest.
    """
    place = Window.partitionBy("clump").orderBy("member")
    rows = clumps.withColumn("block", F.floor((F.row_number().over(place) - 1) / BLOCK).cast("int"))
    last = rows.groupBy("clump").agg(F.max("block").alias("last"))
    rows = rows.join(last, "clump").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    rows = rows.select("clump", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "member", "label")
    kept = rows.groupBy("clump", "i", "j").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("clump", "i", "j")
    rows = rows.join(kept, ["clump", "i", "j"])
    block = ["clump", "i", "j"]

    def made(part: DataFrame) -> DataFrame:
        own = among(found, "set_hash", part.select("member")).select(F.col("set_hash").alias("member"), "hashes")
        return part.join(own, "member").groupBy(*block).applyInPandas(_joining(percent), "a long, b long")

    return _in_passes(rows, block, name, made)


def linked_classes(docs: DataFrame, text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame | None:
    """(node, label) of the set hashes that link with another one; None without any."""
    spark = docs.sparkSession
    every = Window.partitionBy("region")
    first = _part_rows(docs, text_col, words, percent).repartition(partitions(spark), "region")
    first = first.withColumns({"low": F.min("member").over(every), "high": F.max("member").over(every)}).filter("low < high")
    regions = stage(_enough(stage(first.select("region", "member", "need").distinct(), "shared_parts")), "regions")
    members = regions.select(F.col("member").alias("set_hash")).distinct()
    found = stage(_sets_of(docs, text_col, words, members), "sets")
    edges: DataFrame | None = None
    labels: DataFrame | None = None
    reach = 2 * (100 - percent) / 100 + 1e-9
    step, before = 0, None
    while True:
        step += 1
        now = stage(_unsettled(_labelled(regions, labels)), "unsettled")
        leaf = LEAF if step > 1 else PAIRED
        count, large = now.agg(F.count(F.lit(1)), F.count_if(F.col("size") > leaf)).first()
        if not count:
            return labels
        if before is not None and 2 * count > before:
            break
        before = count
        small, middle, big = now.filter(F.col("size") <= PAIRED), now.filter(F.col("size").between(PAIRED + 1, leaf)), now.filter(F.col("size") > max(PAIRED, leaf))
        other = small.select("region", F.col("member").alias("b"), F.col("label").alias("label_b"))
        pairs = small.join(other, "region").filter("member < b AND label <> label_b").select(F.col("member").alias("a"), "b")
        order = Window.partitionBy("region").orderBy(F.xxhash64("member", F.lit(step)), "member")
        pivots = big.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= PIVOTS).select("region", "place", F.col("member").alias("pivot"))
        near = big.join(pivots, "region").filter("member <> pivot").select(F.least("member", "pivot").alias("a"), F.greatest("member", "pivot").alias("b"))
        measured = _measured(pairs.unionByName(near).distinct(), found)
        links = measured.filter(100 * F.col("shared") >= percent * F.col("union")).select("a", "b")
        if leaf > PAIRED:
            links = links.unionByName(_together(middle, found, percent))
        edges = links if edges is None else edges.unionByName(links)
        labels = components(edges)
        if not large:
            return labels
        # the regions of the next step: Voronoi cells of the large ones
        far = big.join(pivots, "region").select("region", "member", "place", "pivot", F.least("member", "pivot").alias("a"), F.greatest("member", "pivot").alias("b"))
        far = far.join(measured, ["a", "b"], "left").withColumn("distance", F.when(F.col("a") == F.col("b"), 0.0).otherwise(1 - F.col("shared") / F.col("union")))
        home = Window.partitionBy("region", "member")
        far = far.withColumns({"nearest": F.min("distance").over(home)}).filter((F.col("nearest") > 0) & (F.col("distance") - F.col("nearest") <= reach))
        regions = stage(far.select(F.xxhash64("region", "place", F.lit(step)).alias("region"), "member"), "cells")
    # pivots no longer shrink what is left: regions that share sets become one clump, compared in blocks
    clump = components(now.select(F.col("region").alias("a"), F.col("member").alias("b")))
    members = now.select("member", "label").distinct().join(clump.select(F.col("node").alias("member"), F.col("label").alias("clump")), "member")
    assert edges is not None
    return components(edges.unionByName(_compared(members, found, percent)))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, set_hash and component_id (smallest id reachable by links) of every document."""
    # a worker holds a batch of texts several times over; the stages of a pipeline leave it little memory
    with setting(docs.sparkSession, BATCH, str(TEXTS)):
        own = stage(set_table(docs, id_col, text_col, words), "sets_of_documents")
        labels = linked_classes(docs, text_col, words, percent)
    least = own.filter("set_hash IS NOT NULL").groupBy("set_hash").agg(F.min("id").alias("least"))
    if labels is not None:
        named = labels.select(F.col("node").alias("set_hash"), "label")
        least = least.join(named, "set_hash", "left").withColumn("label", F.coalesce("label", "set_hash"))
        top = least.groupBy("label").agg(F.min("least").alias("top"))
        least = least.join(top, "label").select("set_hash", F.col("top").alias("least"))
    return own.join(least, "set_hash", "left").select(F.col("id").alias(id_col), "n_shingles", "set_hash", F.coalesce("least", "id").alias("component_id"))
