"""Tables that change by whole snapshots.

A change writes new folders beside the old ones and then a small pointer file that
names the folders of the new snapshot. Readers follow the newest complete pointer,
so a job that ends early leaves the table as it was. Two writers can't take the same
pointer number: the second one fails instead of losing the first one's rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.series import cell

c = F.col
#: names with an underscore are passed over by readers of a plain table
POINTERS, DATA = "_pointers", "_data"
#: the last line of a complete pointer
END = "end"
#: files compaction aims at, in bytes
FILE_BYTES = 128 << 20


class Folder:
    """The few file system calls a snapshot needs, on whatever store the path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(name))) if self.exists(name) else []

    def folders(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(name)) if s.isDirectory()) if self.exists(name) else []

    def files(self, name: str) -> list[int]:
        """Sizes of the data files right in a folder."""
        found = self.fs.listStatus(self.at(name))
        return [s.getLen() for s in found if s.isFile() and not s.getPath().getName().startswith(("_", "."))]

    def leaves(self, name: str) -> list[str]:
        """Partition folders below a folder, as paths below the root; the folder itself if there are none."""
        below = [f for f in self.folders(name) if "=" in f]
        return [leaf for f in below for leaf in self.leaves(f"{name}/{f}" if name else f)] or [name]

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A new file; one that exists is an error."""
        stream = self.fs.create(self.at(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def _pointers(folder: Folder) -> list[tuple[int, list[str] | None]]:
    """(number, entries) of every pointer, oldest first; None for one that was not finished."""
    out = []
    for name in folder.names(POINTERS):
        if name.endswith(".json"):
            body, _, last = folder.read(f"{POINTERS}/{name}").rpartition("\n")
            out.append((int(name[:-5]), json.loads(body) if last == END else None))
    return sorted(out, key=lambda p: p[0])


def entries(spark: SparkSession, path: str) -> list[str] | None:
    """Folders of the current snapshot, below the path; None for a plain table."""
    done = [found for _, found in _pointers(Folder(spark, path)) if found is not None]
    return done[-1] if done else None


def _commit(folder: Folder, seen: int, found: list[str]) -> None:
    folder.create(f"{POINTERS}/{seen + 1:012d}.json", json.dumps(sorted(found)) + "\n" + END)


def read_entries(spark: SparkSession, path: str, found: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """The named folders as one table, with its partition columns."""
    parts = []
    for base in (f"{path.rstrip('/')}/{DATA}", path.rstrip("/")):
        own = [f"{path.rstrip('/')}/{e}" for e in found if e.startswith(f"{DATA}/") == base.endswith(f"/{DATA}")]
        if own:
            df = spark.read.format(fmt).option("basePath", base).load(own)
            parts.append(df.drop("batch"))
    if not parts:
        raise ValueError(f"the snapshot at {path} has no folders")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _key(entry: str) -> str:
    """The partition an entry holds, whatever batch wrote it."""
    return entry.split("/", 2)[2] if entry.startswith(f"{DATA}/") and entry.count("/") > 1 else "" if entry.startswith(f"{DATA}/") else entry


def _state(spark: SparkSession, path: str) -> tuple[Folder, int, list[str]]:
    folder = Folder(spark, path)
    pointers = _pointers(folder)
    done = [found for _, found in pointers if found is not None]
    plain = [x for x in folder.leaves("") if x.split("/")[0] not in (DATA, POINTERS)] if not done and folder.exists("") else []
    return folder, pointers[-1][0] if pointers else 0, done[-1] if done else plain


def _replace(folder: Folder, seen: int, old: list[str], df: DataFrame, partition_by: Sequence[str], fmt: str, whole: bool) -> None:
    """Write rows as a new batch and point to it in place of the partitions it holds."""
    batch = f"{DATA}/batch={uuid.uuid4().hex}"
    writer = df.write.format(fmt).mode("error")
    (writer.partitionBy(*partition_by) if partition_by else writer).save(f"{folder.root}/{batch}")
    new = folder.leaves(batch)
    held = {_key(e) for e in new}
    _commit(folder, seen, new + ([] if whole else [e for e in old if _key(e) not in held]))


def refuse_repeated(source: DataFrame, keys: Sequence[str]) -> None:
    twice = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the source holds the key {tuple(twice[0][k] for k in keys)} more than once")


def upsert(spark: SparkSession, source: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str] = (), fmt: str = "parquet") -> None:
    """Update matched, insert new, create if absent, all or nothing.

    A key may stand once in the source; NULL matches NULL. Only the partitions the
    source touches are read and written again, and a row whose partition changes has
    to be found in them: partition columns should follow from the keys.
    """
    refuse_repeated(source, keys)
    folder, seen, old = _state(spark, path)
    if not old:
        _replace(folder, seen, old, source, partition_by, fmt, whole=True)
        return
    target = read_entries(spark, path, old, fmt)
    rows = source.select(*[c(x) if x in source.columns else F.lit(None).cast(target.schema[x].dataType).alias(x) for x in target.columns])
    if partition_by:
        touched = source.select(cell(*partition_by).alias("_cell")).distinct()
        target = target.withColumn("_cell", cell(*partition_by)).join(touched, "_cell", "left_semi").drop("_cell")
    same = rows.select(cell(*keys).alias("_cell"))
    kept = target.withColumn("_cell", cell(*keys)).join(same, "_cell", "left_anti").drop("_cell")
    _replace(folder, seen, old, kept.unionByName(rows), partition_by, fmt, whole=not partition_by)


def small_partitions(folder: Folder, found: Sequence[str], file_bytes: int = FILE_BYTES) -> list[str]:
    """Entries of more files than their bytes need."""
    out = []
    for entry in found:
        sizes = folder.files(entry)
        if len(sizes) > max(1, -(-sum(sizes) // file_bytes)):
            out.append(entry)
    return out


def compact(spark: SparkSession, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet", file_bytes: int = FILE_BYTES) -> int:
    """Rewrite partitions of many small files, and only those; how many there were."""
    folder, seen, old = _state(spark, path)
    small = small_partitions(folder, old, file_bytes)
    if small:
        rows = read_entries(spark, path, small, fmt).hint("rebalance", *[c(p) for p in partition_by])
        _replace(folder, seen, old, rows, partition_by, fmt, whole=False)
    return len(small)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Remove batches that none of the last ``keep`` snapshots names; how many there were."""
    folder = Folder(spark, path)
    pointers = _pointers(folder)
    done = [p for p in pointers if p[1] is not None][-keep:]
    if not done:
        return 0
    used = {e.split("/")[1] for _, found in done for e in found if e.startswith(f"{DATA}/")}
    gone = [b for b in folder.folders(DATA) if b not in used]
    for batch in gone:
        folder.remove(f"{DATA}/{batch}")
    for number, _ in pointers:
        if number < done[0][0]:
            folder.remove(f"{POINTERS}/{number:012d}.json")
    return len(gone)


def remove_expired(spark: SparkSession, path: str, column: str, oldest: str, dry_run: bool = True) -> list[dict]:
    """Partitions whose ``column`` is below ``oldest``: what they free; gone from the table unless it is a dry run.

    Values compare as numbers where both are, else as text, as in ISO dates. The
    folders of a pointed table stay until ``vacuum``; those of a plain one go at once.
    """
    folder = Folder(spark, path)
    pointed = entries(spark, path) is not None
    _, seen, found = _state(spark, path)

    def value(entry: str) -> str | None:
        return dict(p.split("=", 1) for p in entry.split("/") if "=" in p).get(column)

    def below(x: str) -> bool:
        return float(x) < float(oldest) if x.lstrip("-").replace(".", "", 1).isdigit() and oldest.lstrip("-").replace(".", "", 1).isdigit() else x < oldest

    expired = [e for e in found if (v := value(e)) is not None and not v.startswith("__") and below(v)]
    report = [{"partition": _key(e) if pointed else e, "files": len(s := folder.files(e)), "bytes": sum(s)} for e in expired]
    if expired and not dry_run:
        if pointed:
            _commit(folder, seen, [e for e in found if e not in set(expired)])
        else:
            for e in expired:
                folder.remove(e)
    return report
