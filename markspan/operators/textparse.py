"""Answers found in recognised text and in list-form documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markspan.functions.text import CHOICE_PATTERNS, RESPONSE_PATTERN, word_count
from markspan.functions.codes import strip
from markspan.schema import LEGACY_DOCUMENT


def choices(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Multiple-choice answers: per question the first hit of the strongest pattern."""
    def ranked(rank: int, pattern: Column) -> Column:
        numbers = F.regexp_extract_all(F.col(text), pattern, F.lit(1))
        letters = F.regexp_extract_all(F.col(text), pattern, F.lit(2))
        return F.transform(
            F.arrays_zip(numbers.alias("n"), letters.alias("a")),
            lambda p, i: F.struct(F.lit(rank).alias("rank"), i.alias("pos"), p["n"].alias("digits"), F.upper(p["a"]).alias("answer")),
        )

    found = [ranked(rank, F.lit(f"(?i){pattern}")) for rank, pattern in enumerate(CHOICE_PATTERNS)]
    hits = df.select(id_col, F.inline(F.concat(*found)))
    return keep_first(hits, [id_col, "digits"], ["rank", "pos"], "answer").select(
        id_col, F.col("digits").try_cast("bigint").alias("question"), "answer"
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value))


def responses(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Written responses: the text after each section head up to the next head or the end."""
    pattern = F.lit(f"(?is){RESPONSE_PATTERN}")
    numbers = F.regexp_extract_all(F.col(text), pattern, F.lit(1))
    bodies = F.regexp_extract_all(F.col(text), pattern, F.lit(2))
    rows = df.select(id_col, F.inline(F.arrays_zip(numbers.alias("digits"), bodies.alias("body"))))
    return rows.select(
        id_col, F.col("digits").try_cast("bigint").alias("question"), strip(F.col("body")).alias("response")
    ).filter(F.col("response") != "")


def all_answers(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Both kinds from one text, with a kind column."""
    picked = choices(df, id_col, text).select(id_col, "question", F.col("answer").alias("value"))
    written = responses(df, id_col, text).select(id_col, "question", F.col("response").alias("value"))
    return picked.withColumn("kind", F.lit("multiple_choice")).unionByName(written.withColumn("kind", F.lit("free_response")))


def distinct_in_order(df: DataFrame, ids: Sequence[str], value: str, pos: str) -> DataFrame:
    """The first spelling of each value, ignoring case, with its position. Rows that are already dealt out by the ids stay where they are."""
    first = df.groupBy(*ids, F.lower(value).alias("folded")).agg(F.min(F.struct(pos, value)).alias("f"))
    return first.select(*ids, f"f.{pos}", f"f.{value}")


def legacy_rows(df: DataFrame, id_col: str, document: str) -> DataFrame:
    """List-form documents as long rows: (id, kind, question, value, word_count)."""
    doc = df.select(id_col, F.from_json(document, LEGACY_DOCUMENT).alias("d"))
    both = F.concat(
        F.transform(
            F.coalesce("d.multiple_choice", F.array().cast("array<struct<question:bigint,answer:string>>")),
            lambda x: F.struct(F.lit("multiple_choice").alias("kind"), x["question"].alias("question"), x["answer"].alias("value")),
        ),
        F.transform(
            F.coalesce("d.free_response", F.array().cast("array<struct<question:bigint,response:string>>")),
            lambda x: F.struct(F.lit("free_response").alias("kind"), x["question"].alias("question"), x["response"].alias("value")),
        ),
    )
    rows = doc.select(id_col, F.inline(both))
    words = F.when(F.col("kind") == "free_response", word_count(F.col("value")))
    return rows.withColumn("word_count", words)
