"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector, turned by a fast pseudo-rotation (three rounds of random signs
and a Hadamard transform), hashes to the signed axis it is nearest to. Rows are
dealt once a table to their bucket; queries go to the buckets whose axes are
nearest to them, in order, as many as a measured sample needs for the recall
asked for. What meets in a bucket is compared in double precision on the
original vectors.

Equal vectors are one class, of which the smallest ids stand for all: no more
of them can be in a result. A bucket is cut into cells of bounded numbers of
rows and queries, so a crowded one is many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, stage
from tidemark.llm.words import mix

#: queries whose true neighbours are found by comparison with all rows, to choose the number of probes
SAMPLE = 128
#: recall the probes are chosen for, on the sample
RECALL = 0.97
TABLES = 2
#: rows and queries of one cell at most; small tables are cut finer, to keep all cores busy
CELL_ROWS, CELL_QUERIES = 20_000, 2_000
#: a bucket holds about this many rows before keys take one more axis, while there are at most MOST_KEYS keys
BUCKET_ROWS, MOST_KEYS = 50_000, 1 << 16
ROUNDS = 3


@dataclass(frozen=True)
class Hashing:
    """``tables`` independent keys of ``depth`` signed axes each."""

    tables: int = TABLES
    depth: int = 1
    seed: int = 12


# -- rotations and keys ------------------------------------------------------------
def padded(dims: int) -> int:
    return 1 << max(dims - 1, 0).bit_length()


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    half = 1
    while half < width:
        y = x.reshape(n, width // (2 * half), 2, half)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, width)
        half *= 2
    return x / math.sqrt(width)


def rotated(x: np.ndarray, seed: int, k: int) -> np.ndarray:
    """Pseudo-rotation k of the rows of x."""
    width = padded(x.shape[1])
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    for r in range(ROUNDS):
        places = np.arange(width, dtype=np.uint64) + np.uint64(((seed * 1009 + k) * ROUNDS + r) * width + 1)
        signs = np.where(mix(mix(places)) >> np.uint64(63), -1.0, 1.0)
        x = hadamard(x * signs)
    return x


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def closeness(x: np.ndarray, table: int, h: Hashing) -> list[np.ndarray]:
    """For each axis of a table's key: the rows' inner product with every signed axis."""
    out = []
    for level in range(h.depth):
        y = rotated(x, h.seed, table * h.depth + level)
        out.append(np.concatenate((y, -y), axis=1))
    return out


def keys_of(x: np.ndarray, table: int, h: Hashing) -> np.ndarray:
    key = np.zeros(len(x), np.int64)
    for near in closeness(x, table, h):
        key = key * near.shape[1] + near.argmax(axis=1)
    return key


def key_closeness(x: np.ndarray, table: int, h: Hashing) -> np.ndarray:
    """Closeness of each row to every key of a table: the sum over the key's axes."""
    total = np.zeros((len(x), 1))
    for near in closeness(x, table, h):
        total = (total[:, :, None] + near[:, None, :]).reshape(len(x), -1)
    return total


# -- vectors as rows ---------------------------------------------------------------
def matrix(column: pa.Array, dims: int, kind: str) -> np.ndarray:
    """Vectors of equal length held as bytes, in double precision."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dims).astype(np.float64)


def _sound(kind: str):
    """Keep the vectors that take part, as bytes, with their length."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs, sizes = [], [], []
            for doc, vec in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if doc is None or not vec.is_valid or vec.values.null_count:
                    continue
                # adding zero makes -0.0 and 0.0 one value
                x = vec.values.to_numpy(zero_copy_only=False).astype(kind) + np.dtype(kind).type(0)
                if len(x) and np.isfinite(x).all() and x.any():
                    ids.append(doc)
                    vecs.append(x.tobytes())
                    sizes.append(len(x))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(vecs, pa.binary()), pa.array(sizes, pa.int64())], ["id", "vec", "dims"])

    return step


def _by_length(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dims, places in the batch, matrix) for each length of vector in it."""
    sizes = batch.column("dims").to_numpy(zero_copy_only=False)
    for dims in np.unique(sizes):
        at = np.flatnonzero(sizes == dims)
        yield int(dims), at, matrix(batch.column("vec").take(pa.array(at)), int(dims), kind)


def _keyed(h: Hashing, kind: str):
    """One row for each table, with the key of the vector."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, at, x in _by_length(batch, kind):
                rows, u = batch.take(pa.array(at)), units(x)
                for t in range(h.tables):
                    extra = [pa.array(np.full(len(at), t, np.int32)), pa.array(keys_of(u, t, h))]
                    yield pa.RecordBatch.from_arrays([*rows.columns, *extra], [*rows.schema.names, "tab", "key"])

    return step


def _probing(h: Hashing, kind: str, probes: int):
    """One row for each table and each of the query's nearest ``probes`` keys."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, at, x in _by_length(batch, kind):
                for lo in range(0, len(at), 256):
                    u, some = units(x[lo : lo + 256]), at[lo : lo + 256]
                    for t in range(h.tables):
                        order = np.argsort(-key_closeness(u, t, h), axis=1, kind="stable")[:, :probes]
                        rows = batch.take(pa.array(np.repeat(some, order.shape[1])))
                        extra = [pa.array(np.full(order.size, t, np.int32)), pa.array(order.ravel().astype(np.int64))]
                        yield pa.RecordBatch.from_arrays([*rows.columns, *extra], [*rows.schema.names, "tab", "key"])

    return step


# -- comparison ----------------------------------------------------------------------
def nearest(x: np.ndarray, ids: list[list[int]], query: np.ndarray, own: int, k: int, norms: np.ndarray, dots: np.ndarray) -> list[tuple[float, int]]:
    """The k nearest (distance, id) of one query among classes of equal vectors, its own id left out.

    ``dots`` are the inner products with all rows: they only rule out rows that are
    farther for certain, the rest is measured on the vectors themselves.
    """
    size = float(query @ query)
    rough = norms + size - 2 * dots
    # one class more than asked for, as the own row may be all of its class
    most = min(k + 1, len(rough)) - 1
    slack = 1e-9 * (size + float(norms.max(initial=0.0)))
    some = np.flatnonzero(~(rough > np.partition(rough, most)[most] + slack))
    exact = np.sqrt(((x[some] - query) ** 2).sum(axis=1))
    found = {(float(d), i) for d, at in zip(exact, some, strict=True) for i in ids[at] if i != own}
    return sorted(found)[:k]


def _cell(kind: str, k: int):
    def step(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float, int]] = []
        if rows.num_rows and queries.num_rows:
            dims = rows.column("dims")[0].as_py()
            x, ids = matrix(rows.column("vec"), dims, kind), rows.column("ids").to_pylist()
            q = matrix(queries.column("vec"), dims, kind)
            norms = (x * x).sum(axis=1)
            number, own = queries.column("q").to_pylist(), queries.column("id").to_pylist()
            for lo in range(0, len(q), 128):
                dots = q[lo : lo + 128] @ x.T
                for i in range(len(dots)):
                    j = lo + i
                    out += [(number[j], own[j], d, c) for d, c in nearest(x, ids, q[j], own[j], k, norms, dots[i])]
        names, types = ("q", "query_id", "score", "vec_id"), (pa.int64(), pa.int64(), pa.float64(), pa.int64())
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return step


def _sampled(h: Hashing, kind: str, k: int, sample: list[tuple[int, bytes, int]]):
    """Exact nearest rows of the sampled queries among a task's rows, with the probes each would have taken."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, at, x in _by_length(batch, kind):
                asked = [(s, own, np.frombuffer(v, kind).astype(np.float64)) for s, (own, v, d) in enumerate(sample) if d == dims]
                if not asked:
                    continue
                keys = [keys_of(units(x), t, h) for t in range(h.tables)]
                norms = (x * x).sum(axis=1)
                all_ids = batch.column("ids").to_pylist()
                # a class is told by its place here, with its ids beside it
                places = {}
                for n, i in enumerate(at):
                    for doc in all_ids[i]:
                        places.setdefault(doc, n)
                ids = [all_ids[i] for i in at]
                out = []
                for s, own, query in asked:
                    ranks = [np.argsort(np.argsort(-key_closeness(units(query[None]), t, h)[0], kind="stable")) for t in range(h.tables)]
                    for d, doc in nearest(x, ids, query, own, k, norms, x @ query):
                        n = places[doc]
                        out.append((s, d, doc, min(int(r[key[n]]) + 1 for r, key in zip(ranks, keys, strict=True))))
                if out:
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64()),
                         pa.array(columns[3], pa.int64())], ["s", "score", "vec_id", "probes"])

    return step


def probes_for(classes: DataFrame, asked: DataFrame, h: Hashing, kind: str, k: int, recall: float) -> int:
    """The fewest probes that find the share ``recall`` of the true neighbours of the sampled queries.

    One pass over the classes in which each task compares its rows with at most
    ``SAMPLE`` queries and sends on at most k rows for each.
    """
    drawn = asked.orderBy(F.xxhash64("vec", "id"), "q").limit(SAMPLE).select("id", "vec", "dims").collect()
    sample = [(r["id"], bytes(r["vec"]), r["dims"]) for r in drawn]
    found = classes.mapInArrow(_sampled(h, kind, k, sample), "s long, score double, vec_id long, probes long")
    order = Window.partitionBy("s").orderBy("score", "vec_id")
    needed = sorted(r["probes"] for r in found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("probes").collect())
    return needed[min(math.ceil(recall * len(needed)), len(needed)) - 1] if needed else 1


# -- the operator -----------------------------------------------------------------------
def nearest_neighbours(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, every: int = 100,
    tables: int = TABLES, recall: float = RECALL, seed: int = 12,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows of each row whose id is divisible by ``every``.

    ``score`` is the Euclidean distance of the original vectors. Ties go to the
    smaller id. Vectors that are null, empty, zero, or hold null or non-finite
    components, and rows without id, take no part; vectors are compared with those
    of their own length. Rows repeated in id and vector are one row; rows that share
    the query's id are its own and left out; an id with several vectors is a query
    with each. A query without candidates and an empty table give no rows. Columns
    but id and vector are not read, so their names can't clash.
    """
    spark = vectors.sparkSession
    element = vectors.schema[vec_col].dataType.elementType.typeName()
    kind = "<f4" if element == "float" else "<f8"
    as_read = F.col(vec_col) if element in ("float", "double") else F.col(vec_col).cast("array<double>")
    sound = vectors.select(F.col(id_col).cast("long").alias("id"), as_read.alias("vec")).mapInArrow(
        _sound(kind), "id long, vec binary, dims long").distinct()
    first = Window.partitionBy("dims", "vec").orderBy("id")
    kept = sound.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    classes = stage(kept.groupBy("dims", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids")), "classes")
    asked = stage(sound.filter(F.col("id") % every == 0).withColumn("q", F.monotonically_increasing_id()), "asked")

    size = classes.agg(F.count(F.lit(1)).alias("n"), F.max("dims").alias("dims")).first()
    axes, depth = 2 * padded(size["dims"] or 1), 1
    while size["n"] / axes**depth > BUCKET_ROWS and axes ** (depth + 1) <= MOST_KEYS:
        depth += 1
    h = Hashing(tables, depth, seed)
    probes = probes_for(classes, asked, h, kind, k, recall)

    place = ["dims", "tab", "key"]
    keyed = classes.mapInArrow(_keyed(h, kind), "dims long, vec binary, ids array<long>, tab int, key long")
    probing = asked.mapInArrow(_probing(h, kind, probes), "id long, vec binary, dims long, q long, tab int, key long")
    share = max(1, math.ceil(size["n"] / (4 * partitions(spark))))
    rows_cut, queries_cut = min(CELL_ROWS, max(256, share)), CELL_QUERIES
    row_cells = keyed.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / rows_cut).cast("int").alias("row_cells"))
    query_cells = probing.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / queries_cut).cast("int").alias("query_cells"))
    # at most one row a key and length: keys are bounded, the optimizer sees their size
    grid = stage(row_cells.join(query_cells, place), "grid")
    dealt = keyed.join(grid, place).select(
        *place, F.pmod(F.xxhash64("vec"), "row_cells").alias("rc"), F.explode(F.sequence(F.lit(0), F.col("query_cells") - 1)).alias("qc"), "vec", "ids")
    sent = probing.join(grid, place).select(
        *place, F.explode(F.sequence(F.lit(0), F.col("row_cells") - 1)).alias("rc"), F.pmod(F.xxhash64("q"), "query_cells").alias("qc"), "vec", "q", "id")
    cell = [*place, "rc", "qc"]
    dealt, sent = (df.withColumns({"rc": F.col("rc").cast("int"), "qc": F.col("qc").cast("int")}) for df in (dealt, sent))
    met = dealt.groupBy(*cell).cogroup(sent.groupBy(*cell)).applyInArrow(
        _cell(kind, k), "q long, query_id long, score double, vec_id long")
    # one neighbour may be met in several tables: equal rows share a rank, and go as a set
    best = Window.partitionBy("q", "query_id").orderBy("score", "vec_id")
    few = met.withColumn("r", F.dense_rank().over(best)).filter(F.col("r") <= k)
    lists = few.groupBy("q", "query_id").agg(F.array_sort(F.collect_set(F.struct("score", "vec_id"))).alias("found"))
    return lists.select("query_id", F.posexplode("found").alias("place", "near")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("near.vec_id").alias("vec_id"), F.col("near.score").alias("score"))
