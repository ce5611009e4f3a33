"""Files offered for processing and the names they are stored under."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markspan.functions.text import base_name, dated_path, safe_token, stem

# The size limit and the reasons shown.
MAX_BYTES = 50 * 1024 * 1024
NOT_PDF, TOO_LARGE = "Only PDF files are allowed", "File size must be less than 50MB"


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Path, size and time of every file below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("size_bytes"), "modificationTime")


def check_files(manifest: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Whether each file is taken in, and why not."""
    reason = F.when(~F.lower("path").endswith(".pdf"), F.lit(NOT_PDF)).when(F.col("size_bytes") > max_bytes, F.lit(TOO_LARGE))
    return manifest.withColumn("reject_reason", reason).withColumn("accepted", F.col("reject_reason").isNull())


def under_prefix(manifest: DataFrame, prefix: str = "") -> DataFrame:
    return manifest.filter(F.col("path").startswith(prefix)) if prefix else manifest


def archive_key(folder: str, at: Column, submission_id: Column, pdf_name: Column, image_path: Column) -> Column:
    """folder/YYYY/MM/DD/submission_N/pdf/image"""
    return F.concat_ws(
        "/", F.lit(folder), dated_path(at), F.concat(F.lit("submission_"), submission_id.cast("string")), stem(pdf_name),
        base_name(image_path),
    )


def run_tokens(context: Column, source: Column) -> tuple[Column, Column]:
    return safe_token(context), safe_token(stem(F.coalesce(source, F.lit("unknown"))))
