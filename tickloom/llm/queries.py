"""The registered queries of the training-data operators: thin, whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import annsearch, chat, collocations, langid, mixing, pii, quality, sharding, simhash, tagpaths, tokencount, vectorcodes, winnowing
from tickloom.llm.common import crc32_mod, read_table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.train(docs, where=F.coalesce(crc32_mod(F.col("k"), 3) != 1, F.lit(True)))
    rows = docs.select("doc_id", F.coalesce(crc32_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "text")
    return langid.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"), shards=24)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), window=10, k=5)
    return found.drop("spans", "items")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annsearch.nearest(read_table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 50 == 0, top=5)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group_fingerprints(read_table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read_table(spark, sf_dir, "documents"))


#: A document is rejected below this score.
QUALITY_THRESHOLD = 0.3


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.FactorisationMachine:
    return quality.train(docs, labels, metadata=["n_chars"], where=crc32_mod(F.col("k"), 5) != 0)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality_model(docs, read_table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", F.coalesce(crc32_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "text", "n_chars")
    scored = quality.score(rows, model, metadata=["n_chars"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagpaths.extract(read_table(spark, sf_dir, "pages"))


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read_table(spark, sf_dir, "documents"), VOCABULARY)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(read_table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024).drop("label")


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select(*chat.CONVERSATION)
    return chat.digest(chat.format_chats(turns.unionByName(chat.injection(spark))))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"), longest=4, least=30, covered=80, top=2000)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_sharding": op2_sharding,
    "op3_mixing": op3_mixing,
    "op4_decontamination": op4_decontamination,
    "op5_nearest": op5_nearest,
    "op6_near_dedup": op6_near_dedup,
    "op7_pii": op7_pii,
    "op8_quality": op8_quality,
    "op9_html_extraction": op9_html_extraction,
    "op10_token_counts": op10_token_counts,
    "op11_vector_codes": op11_vector_codes,
    "op12_chat_formatting": op12_chat_formatting,
    "op13_collocations": op13_collocations,
}
