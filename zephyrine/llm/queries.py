"""The queries opN_<name>: each operator over its whole table, with the columns that its contract names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, jaccard, kneser_ney, langid, media, packing, pii, sql, stupid_backoff, substring


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.train(docs.where(~held_out))
    return langid.predict(spark, docs, model, keep=[F.col("doc_id"), held_out.alias("held_out")])


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = kneser_ney.classify(docs, table(spark, sf_dir, "labels"), keep=["doc_id", "lang"])
    return judged.select("doc_id", "lang", "n_symbols", "perplexity", "threshold", "keep")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    records = chat.grouped(rows.unionByName(more))
    # the table has one layout: its conversations are dealt to several, of which each is known again by its fingerprint
    mixed = records.select("conv_id", chat.spread(chat.canonical_struct(records, "record"), F.col("conv_id")).alias("record"))
    turns, layout = chat.canonical_json(F.col("record"))
    known = mixed.select("conv_id", F.when(layout.isNull(), F.raise_error(F.lit("a record of no known layout"))).otherwise(turns).alias("turns"))
    out = chat.format_chats(known, F.col("turns"))
    back = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def tokenizer_path() -> str:
    """Where the vocabulary file is, on the driver and on executors alike."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.decompose(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = media.media_columns(table(spark, sf_dir, "documents"))
    return members.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substr("payload", F.length("payload") - 31, F.lit(32))).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "error",
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(spark, docs, pii.train(docs), keep=[F.col("doc_id")])
    counts = [pii.counted(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = stupid_backoff.score(table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round(F.try_divide("log_score", "n_words"), 5).alias("word_score"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_decontamination": op2_decontamination,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_packing": op6_packing,
    "op7_media_columns": op7_media_columns,
    "op8_pii": op8_pii,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_lm_scoring": op10_lm_scoring,
}

ORACLES: dict[str, str] = {
    "op3_substring_dedup": sql.SUBSTRING,
    "op5_chat_formatting": sql.CHAT,
    "op9_jaccard_join": sql.JACCARD,
    "op10_lm_scoring": sql.BACKOFF,
}
