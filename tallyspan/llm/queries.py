"""The registered queries of these operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspan.llm import bpe, chat, collocations, conversation_repair, decontaminate, html_lstm, language, licenses, mixing, simhash, syncmers, url_reputation, warc
from tallyspan.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, with the items they hold."""
    return decontaminate.find_leaks(read(spark, folder, "documents", "doc_id", "text"), read(spark, folder, "benchmark", "item_id", "text"))


def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = read(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], turns.schema)
    return chat.read_chats(chat.format_chats(turns.unionByName(added)))


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text", "lang")
    found = language.identify(docs, language.labelled(docs))
    return found.select("doc_id", (language.training_fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(read(spark, folder, "pages", "page_id", "url", "html"))


def quality_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Sampling weights of labelled documents: good ones count twice, bad ones half."""
    labels = read(spark, folder, "labels", "doc_id", "quality")
    return labels.select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).alias("weight"))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text", "source")
    return mixing.mix(docs, quality_weights(spark, folder)).select("doc_id", "size", "source_size", "target", "taken")


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """A page's outcome is that of the label with its number: bad where quality is 0 or toxic is 1."""
    pages = read(spark, folder, "pages", "page_id", "url")
    labels = read(spark, folder, "labels", "doc_id", "quality", "toxic")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.col("toxic") == 1, F.col("quality") == 0).alias("bad"))
    return url_reputation.judge(pages, outcomes)


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_duplicates(read(spark, folder, "documents", "doc_id", "text"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(read(spark, folder, "documents", "doc_id", "text")).drop("spans")


def op9_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.edit_trial(read(spark, folder, "documents", "doc_id", "text"))


def op10_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_lstm.extract(read(spark, folder, "pages", "page_id", "url", "html"))


def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """The vocabulary file belongs to an installed package and is read by the driver alone."""
    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.round_trip(read(spark, folder, "documents", "doc_id", "text"), vocabulary)


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    found = collocations.collocations(read(spark, folder, "documents", "doc_id", "text", "lang"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = read(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    return conversation_repair.report(conversation_repair.plan_repair(conversation_repair.damage(turns)), turns)


def llm_queries() -> dict[str, Query]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_chat_format": op2_chat_format,
        "op3_language": op3_language,
        "op4_warc": op4_warc,
        "op5_mixing": op5_mixing,
        "op6_url_filter": op6_url_filter,
        "op7_simhash": op7_simhash,
        "op8_licenses": op8_licenses,
        "op9_syncmers": op9_syncmers,
        "op10_main_text": op10_main_text,
        "op11_byte_bpe": op11_byte_bpe,
        "op12_collocations": op12_collocations,
        "op13_conversation_repair": op13_conversation_repair,
    }
