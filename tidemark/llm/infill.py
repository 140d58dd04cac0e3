"""Fill-in-the-middle: texts cut at unit borders and rearranged for infilling models.

A text is matched once, as a whole, by a repeated group; the ``regex`` library
keeps every repetition of that group, so the ends of its captures are the unit
borders: their number is n, and both cuts are two of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SCHEMA = "id string, n long, form string, prefix_chars long, middle_chars long, output string"
#: texts are handed back in Arrow batches of about so many characters
BATCH_CHARS = 1 << 22


def draws(seed: int, key: str) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers from the hash of seed and key."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def rearranged(text: str, key: str, unit: regex.Pattern, rate: int, spm: int, seed: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text; ``unit`` is the compiled ``(unit)*``."""
    found = unit.fullmatch(text)
    if found is None:
        raise ValueError("the unit pattern must be able to cover every text")
    ends = found.ends(1)
    n = len(ends)
    h1, h2, h3, h4 = draws(seed, key)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    borders = [0, *ends]
    a, b = sorted((borders[h1 % (n + 1)], borders[h2 % (n + 1)]))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _batches(unit: str, rate: int, spm: int, seed: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a unit already taken is never given back, so the match is one pass over the text
        pattern = regex.compile(f"(?:({unit}))*+")
        names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows, size = [], 0
            for i in range(batch.num_rows):
                key, text = ids[i].as_py(), texts[i].as_py() or ""
                rows.append((key, *rearranged(text, key or "", pattern, rate, spm, seed)))
                size += len(text)
                if size >= BATCH_CHARS or i + 1 == batch.num_rows:
                    arrays = [pa.array(column, t) for column, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names)
                    rows, size = [], 0

    return step


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINES, rate: int = 100, spm: int = 50, seed: int = 7
) -> DataFrame:
    """``<id_col>, n, form, prefix_chars, middle_chars, output`` of each row.

    ``rate`` percent of the rows are rearranged, ``spm`` percent of those with the
    suffix first. Every row is worked on by itself, whole, in one pass without a
    shuffle. A null or empty text, and one that holds a mark, stays as it is (form
    ``plain``, null text: empty output); a null id draws as the empty key; repeated
    rows give repeated results; an empty table an empty one. Other columns are not
    read, so their names can't clash.
    """
    kind = docs.schema[id_col].dataType
    cut = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _batches(unit, rate, spm, seed), SCHEMA)
    return cut.select(F.col("id").cast(kind).alias(id_col), "n", "form", "prefix_chars", "middle_chars", "output")


def restored(output: Column, form: Column) -> Column:
    """The text behind an output. The marks occur once each, as no rearranged text holds one."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(cut: DataFrame) -> DataFrame:
    """Hashes in place of the texts."""
    hashed = [F.sha2(x.cast("binary"), 256).alias(name) for name, x in (
        ("output_sha256", F.col("output")), ("restored_sha256", restored(F.col("output"), F.col("form"))))]
    return cut.select(*[c for c in cut.columns if c != "output"], *hashed)
