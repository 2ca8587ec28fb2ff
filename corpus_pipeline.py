"""A training corpus from raw documents: five stages, each written and read back before the next.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``. In every stage nulls in any column, empty and very long texts are rows like others:
a null or empty text is rejected by the first stage. Repeated rows are judged alike by the first stage, the second keeps one of them;
of documents without id one a group at most. An empty table gives an empty one, and further columns pass through, whatever
their names. Where stages stage tables, those are deleted once the stage's result is written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.llm import mixing, pieces, quality, secrets, simhash
from orogen.llm.common import delete, scratch, shared_dir, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.classify(docs, table(spark, sf_dir, "labels")).where("__keep").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: fingerprints of five-word shingles that differ in six bits or fewer are linked."""
    return simhash.deduplicated(docs, width=5, distance=6)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live secrets in the texts are masked, and the length follows; no document goes."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their calibrated probabilities stay."""
    return mixing.mix(docs).where("__sampled").select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, lossless) of every document."""
    return pieces.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "lossless")


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL has no Kneser-Ney model, XXH64 or merge-dropout; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Only the last one's table stays in the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
