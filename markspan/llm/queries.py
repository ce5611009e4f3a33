"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from markspan.llm import chat, dialogue, digest_index, minhash, packing, paragraphs, perplexity, phrases, pieces, pii, segments, sql, toxicity, warc
from markspan.llm.common import table

# Vocabulary files stay where the tokenizer package has them; the driver reads them once and ships their contents.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_minhash(spark: SparkSession, folder: str) -> DataFrame:
    classes = minhash.document_classes(table(spark, folder, "documents"))
    return classes.select("doc_id", "n_shingles", "component_id", "kept")


def op2_segments(spark: SparkSession, folder: str) -> DataFrame:
    return segments.top_scores(table(spark, folder, "embeddings"), every=20, k=20)


def op3_sentencepiece(spark: SparkSession, folder: str, model: str = PIECE_MODEL) -> DataFrame:
    return pieces.encoded_digests(table(spark, folder, "documents"), Path(model).read_bytes())


def op4_packing(spark: SparkSession, folder: str, tokenizer: str = WORD_TOKENIZER) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), Path(tokenizer).read_text())
    return packing.piece_digests(packed)


def op5_digest_index(spark: SparkSession, folder: str) -> DataFrame:
    return digest_index.exact_groups(table(spark, folder, "documents"))


def op6_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pii_report(table(spark, folder, "documents"))


def op7_chat_windows(spark: SparkSession, folder: str, tokenizer: str = WORD_TOKENIZER) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.window_digests(chat.format_windows(turns, Path(tokenizer).read_text()))


def op8_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return paragraphs.repeated_passages(table(spark, folder, "documents"))


def op9_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    return perplexity.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.page_records(table(spark, folder, "pages"))


def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


def op13_dialogue(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.repair_reports(dialogue.damaged(table(spark, folder, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash": op1_minhash,
        "op2_segments": op2_segments,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_packing": op4_packing,
        "op5_digest_index": op5_digest_index,
        "op6_personal_data": op6_personal_data,
        "op7_chat_windows": op7_chat_windows,
        "op8_paragraphs": op8_paragraphs,
        "op9_perplexity": op9_perplexity,
        "op10_warc": op10_warc,
        "op11_toxicity": op11_toxicity,
        "op12_phrases": op12_phrases,
        "op13_dialogue": op13_dialogue,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash": sql.NEAR_DUPLICATES,
        "op2_segments": sql.TOP_SCORES,
        "op5_digest_index": sql.EXACT_GROUPS,
        "op6_personal_data": sql.PII,
        "op10_warc": sql.WARC,
        "op12_phrases": sql.COLLOCATIONS,
        "op13_dialogue": sql.DIALOGUE,
    }
