"""The registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    decontaminate, fingerprint, htmltext, infill, jaccard, lines, neighbours, oracles, pieces, pii, quality, resample, suffixes, toxicity,
)
from tidemark.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, quality.label_grades(table(spark, sf_dir, "labels")), quality.GRADES)
    return quality.graded(docs.select("doc_id", "text"), model).select("doc_id", "quality.*")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return htmltext.extracted(pages, htmltext.train(pages))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.detected(table(spark, sf_dir, "documents")))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.deduplicated(docs, short=True).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.with_matches(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select(
        "doc_id", F.col("leak.item").alias("item_id"), "leak.score", "leak.first_word", "leak.last_word")


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels = table(spark, sf_dir, "labels").filter(~held)
    found = toxicity.scored(docs, toxicity.build(docs, labels))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.fill_in_middle(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_html, op3_pii, op4_jaccard, op5_lines, op6_pieces, op7_decontamination, op8_suffixes, op9_toxicity, op10_fingerprint,
                               op11_resample, op12_neighbours, op13_infill)
}
ORACLES: dict[str, str] = {"op11_resample": oracles.OP11, "op13_infill": oracles.OP13}
