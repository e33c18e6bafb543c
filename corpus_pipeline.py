"""The corpus pipeline: quality, near duplicates, benchmark leaks, personal data, packing. Each stage works on all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyrine.llm import decontam, jaccard, kneser_ney, packing, pii
from zephyrine.llm.queries import table, tokenizer_path
from zephyrine.session import shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return kneser_ney.classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("keep").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the least doc_id (null the last); of rows that share it, the first by a 128-bit digest of id and text, and one of equal ones. Documents without words are no group, and stay."""
    # a digest of id and text stands for a row, so that one shuffle of the texts serves the join and the equal rows
    rows = docs.select(*COLUMNS).withColumn("digest", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), "text"))))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    groups = jaccard.similar(rows.select(key.alias("key"), "text"), id_col="key").where("set_id is not null and doc_id = component_id")
    kept = groups.select(F.col("doc_id.digest").alias("digest")).distinct()
    some = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    chosen = rows.where(some).join(kept, "digest", "left_semi").dropDuplicates(["digest"])
    return chosen.select(*COLUMNS).unionByName(rows.where(~some).select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets; n_chars follows."""
    rows = docs.select(*COLUMNS)
    found = pii.find(spark, rows, pii.train(rows), keep=list(COLUMNS))
    return found.withColumn("text", pii.redact(F.col("text"), F.col("spans"))).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of binary length, with their token ids."""
    return packing.decompose(docs, tokenizer_path()).select("doc_id", "start", "length", "sequence_id", "offset", "doc_tokens", "ids")


STAGES = [("quality_classifier", quality), ("jaccard_join", near_duplicates), ("decontamination", decontamination), ("pii", personal_data), ("packing", pack)]

#: A trained model and a tokenizer decide; SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
