"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_model, langid, linededup, minhash, mixing, quality, rules, toxicity, warc
from .common import read, scratch_path


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.clean(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("lamella_lines").alias("n_lines"), F.col("lamella_removed").alias("n_removed"), F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return quality.apply(docs, quality.fit(docs, labels))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return warc.archive(pages, scratch_path(spark, "warc")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return rules.apply(docs, rules.fit(docs, labels))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return toxicity.apply(docs, toxicity.fit(docs, labels))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.apply(docs, langid.fit(docs))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_model.extract(read(spark, sf_dir, "pages"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(read(spark, sf_dir, "documents")).drop("mix_key")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontamination, op2_line_dedup, op3_quality_classifier, op4_warc, op5_quality_rules, op6_toxicity, op7_language_id, op8_html_extraction, op9_minhash_dedup, op10_mixing)
}

ORACLES: dict[str, str] = {"op2_line_dedup": linededup.ORACLE, "op4_warc": warc.ORACLE, "op9_minhash_dedup": minhash.ORACLE, "op10_mixing": mixing.ORACLE}
